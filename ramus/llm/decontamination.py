"""Benchmark decontamination by greedy string tiling.

Words are hashed and Karp-Rabin hashes of MIN_MATCH-word windows join documents with benchmark
items. Items are tried by the share of their words that lies in shared windows, which no tiling can
exceed. For each pair that may still win, matches are the maximal runs of seeds on one
diagonal; the longest match whose words are still free on both sides is marked, again and
again, until none of MIN_MATCH words is left, and its words are compared themselves. Marked tiles may lie in any order, so a
document that holds an item's passages reordered is caught too. A document goes when its tiles cover
COVERAGE of an item. An item of fewer than MIN_MATCH words is one window of its own length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import mix64, stored, table

MIN_MATCH, COVERAGE = 5, 0.5
#: Benchmark text sent to executors at a time; a larger benchmark is matched block by block.
BLOCK_BYTES = 16 << 20
#: A list of covered texts of so many rows at most is broadcast, a longer one is shuffled.
SMALL_ROWS = 100_000
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(MIN_MATCH)]
_EDGES = b".,;:!?\"'()[]{}<>*#$%&|-_/\\"


def words_of(text: str | None) -> list[bytes]:
    """Words split at ASCII white space, A-Z lower-cased, without marks at their edges."""
    return [w.strip(_EDGES) or w for w in (text or "").encode("utf-8", "surrogatepass").lower().split()]


def windows(words: list[bytes], width: int = MIN_MATCH) -> np.ndarray:
    """Rolling hash of each window of so many words."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for k in range(width):
        acc += h[k : k + n] * _POWERS[k]
    return mix64(acc + np.uint64(width))


def spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ..., n[0] of them, then those of the next."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


@dataclass
class Block:
    """Some benchmark items: their words, and their seeds in order with item and position; of items
    shorter than a seed the window of all their words, by length."""

    words: list[list[bytes]]
    seed: np.ndarray
    item: np.ndarray
    at: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, texts: list[str | None]) -> Block:
        """Null items and those without words match nothing."""
        words = [words_of(t) for t in texts]
        parts = [windows(w) for w in words]
        seed = np.concatenate([np.zeros(0, np.uint64), *parts])
        item = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        at = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(p)) for p in parts)])
        order = np.argsort(seed, kind="stable")
        short = {}
        for n in range(1, MIN_MATCH):
            mine = [k for k, w in enumerate(words) if len(w) == n]
            if mine:
                h = np.concatenate([windows(words[k], n) for k in mine])
                o = np.argsort(h, kind="stable")
                short[n] = h[o], np.array(mine)[o]
        return cls(words, seed[order], item[order], at[order], short)


def tiles(doc_at: np.ndarray, item_at: np.ndarray, n_doc: int, n_item: int) -> list[tuple[int, int, int]]:
    """Greedy tiling (document position, item position, words), longest first, from seed pairs."""
    diagonal = doc_at - item_at
    order = np.lexsort((item_at, diagonal))
    d, i, g = doc_at[order], item_at[order], diagonal[order]
    new = np.ones(len(d), bool)
    new[1:] = (g[1:] != g[:-1]) | (i[1:] != i[:-1] + 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(d))) + MIN_MATCH - 1
    heap = [(-int(n), int(d[k]), int(i[k])) for k, n in zip(first, length)]
    heapq.heapify(heap)
    in_doc, in_item, out = np.zeros(n_doc, bool), np.zeros(n_item, bool), []
    while heap:
        n, p, q = heapq.heappop(heap)
        n = -n
        taken = in_doc[p : p + n] | in_item[q : q + n]
        if not taken.any():
            in_doc[p : p + n] = in_item[q : q + n] = True
            out.append((p, q, n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[1], taken.astype(np.int8), [1]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):  # what is still free of it
            if b - a >= MIN_MATCH:
                heapq.heappush(heap, (a - b, p + a, q + a))
    return out


def _tiled(block: Block, k: int, rows: np.ndarray, seen: np.ndarray, hit: np.ndarray, words: list[bytes]) -> float:
    """Share of item k that tiles cover; rows are its postings in the block, by position in the
    item, and hit the places in the text whose seeds are `seen`."""
    order = np.argsort(block.seed[rows], kind="stable")
    rows = rows[order]
    lo = np.searchsorted(block.seed[rows], seen, side="left")
    n = np.searchsorted(block.seed[rows], seen, side="right") - lo
    doc_at, item_at = np.repeat(hit, n), block.at[rows[spread(lo, n)]]
    item = block.words[k]
    same = [m for p, q, m in tiles(doc_at, item_at, len(words), len(item)) if words[p : p + m] == item[q : q + m]]
    return sum(same) / len(item)


def coverage(text: str | None, block: Block, least: float = 0.0) -> tuple[float, int]:
    """(largest share of an item that the text's tiles cover, that item); items whose share of words in
    shared windows is under `least`, or no larger than what another covers, aren't tiled."""
    words = words_of(text)
    for n, (h, items) in block.short.items():
        w = windows(words, n)
        at = np.minimum(np.searchsorted(h, w), len(h) - 1)
        for p in np.flatnonzero(h[at] == w).tolist():
            if words[p : p + n] == block.words[items[at[p]]]:
                return 1.0, int(items[at[p]])
    s = windows(words)
    if not len(s) or not len(block.seed):
        return 0.0, -1
    lo = np.searchsorted(block.seed, s, side="left")
    hit = np.flatnonzero(block.seed[np.minimum(lo, len(block.seed) - 1)] == s)
    if not len(hit):
        return 0.0, -1
    seen = s[hit]
    first = np.unique(lo[hit])  # each shared seed once, however often the text has it
    posts = spread(first, np.searchsorted(block.seed, block.seed[first], side="right") - first)
    posts = posts[np.lexsort((block.at[posts], block.item[posts]))]
    item, at = block.item[posts], block.at[posts]
    step = np.full(len(item), MIN_MATCH)
    next_same = item[1:] == item[:-1]
    step[:-1][next_same] = np.minimum(MIN_MATCH, (at[1:] - at[:-1])[next_same])
    names, begin = np.unique(item, return_index=True)
    bound = np.add.reduceat(step, begin) / np.array([len(block.words[k]) for k in names])
    ends = np.append(begin[1:], len(item))
    best = (0.0, -1)
    for j in np.argsort(-bound, kind="stable").tolist():
        if bound[j] < least or bound[j] <= best[0]:
            break
        share = _tiled(block, int(names[j]), posts[begin[j] : ends[j]], seen, hit, words)
        if share > best[0]:
            best = (share, int(names[j]))
    return best


def blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The distinct benchmark texts, in blocks of about BLOCK_BYTES."""
    held, size = [], 0
    for (text,) in benchmark.select(F.col("text").cast("string")).where("text is not null").distinct().toLocalIterator():
        held.append(text)
        size += len(text)
        if size >= BLOCK_BYTES:
            yield Block.of(held)
            held, size = [], 0
    if held:
        yield Block.of(held)


def text_key(text: str | None) -> bytes:
    return xxhash.xxh3_128_digest((text or "").encode("utf-8", "surrogatepass"))


def _covered(block, least: float):
    """Rows (key, coverage) of the texts that cover at least so much of an item, and some of it."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        for f in frames:
            keys, shares = [], []
            for t in f.column(0).to_pylist():
                share = coverage(t, b, least)[0]
                if share >= least and share > 0:
                    keys.append(text_key(t))
                    shares.append(share)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(shares, pa.float64())], ["key", "coverage"])

    return run


def _with_coverage(block, text_at: int):
    """Each row with its coverage of the block's items, or without a block with its text's key."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block and block.value
        for f in frames:
            texts = f.column(text_at).cast(pa.string()).to_pylist()
            more = pa.array([coverage(t, b)[0] for t in texts], pa.float64()) if block else pa.array([text_key(t) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*f.columns, more], [*f.schema.names, "_more"])

    return run


def _clean(block, least: float, text_at: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        for f in frames:
            keep = [coverage(t, b, least)[0] < least for t in f.column(text_at).cast(pa.string()).to_pylist()]
            yield f.filter(pa.array(keep, pa.bool_()))

    return run


def _by_text(docs: DataFrame, found: list[Block], rest: Iterator[Block], least: float) -> tuple[DataFrame, DataFrame]:
    """(docs with _key, a row (_key, coverage) for each text that covers at least so much): one scan of
    docs for each block, none of which writes them again."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col("text").cast("string"))
    parts = None
    for block in (b for bs in (found, rest) for b in bs):
        part = stored(texts.mapInArrow(_covered(sc.broadcast(block), least), "key binary, coverage double"), "covered")
        parts = part if parts is None else parts.union(part)
    best = parts.groupBy(F.col("key").alias("_key")).agg(F.max("coverage").alias("coverage"))
    best = F.broadcast(best) if best.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else best
    names = [f"c{i}" for i in range(len(docs.columns))]
    keyed = docs.toDF(*names)
    keyed = keyed.mapInArrow(_with_coverage(None, docs.columns.index("text")), StructType([*keyed.schema, StructField("_more", BinaryType())])).withColumnRenamed("_more", "_key")
    return keyed, best


def decontaminated(docs: DataFrame, benchmark: DataFrame, least: float = COVERAGE) -> DataFrame:
    """The rows of docs (text among their columns) that cover no benchmark item; columns unchanged.

    Null and empty texts and those shorter than every item's share stay; null items and those without words match nothing;
    repeated items count once, repeated rows are judged each, very long texts are read whole. Of equal matches the first in the
    text is marked first. Empty tables work on either side.
    """
    sent = docs.sparkSession.sparkContext.broadcast
    todo = blocks(benchmark)
    first = [b for _, b in zip(range(2), todo)]
    if not first:
        return docs
    if len(first) == 1:
        return docs.mapInArrow(_clean(sent(first[0]), least, docs.columns.index("text")), docs.schema)
    keyed, best = _by_text(docs, first, todo, least)
    return keyed.join(best, "_key", "left_anti").select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns)])


def item_coverage(docs: DataFrame, benchmark: DataFrame, least: float = COVERAGE) -> DataFrame:
    """(doc_id, coverage, contaminated) of each row: the largest share of an item it covers, 0 for null
    and empty texts, and without items. Other cases as in decontaminated()."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    todo = blocks(benchmark)
    first = [b for _, b in zip(range(2), todo)]
    if len(first) < 2:
        block = rows.sparkSession.sparkContext.broadcast(first[0] if first else Block.of([]))
        out = rows.mapInArrow(_with_coverage(block, 1), "doc_id long, text string, _more double").select("doc_id", F.col("_more").alias("coverage"))
    else:
        keyed, best = _by_text(rows, first, todo, 0.0)
        out = keyed.join(best, "_key", "left").select(F.col("c0").alias("doc_id"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
    return out.select("doc_id", "coverage", (F.col("coverage") >= least).alias("contaminated"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
