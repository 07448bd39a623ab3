"""Removal of long byte strings that occur more than once, by sharded suffix arrays.

A string of SPAN bytes is named by the least hash among its GRAM-byte grams: equal strings have
equal names, so a name met once needs no further look. A maximal run of string starts with one
name is a stretch; the bytes it covers are its context. Contexts met twice are repeated as a
whole. Where a name has several different contexts, these go to a shard: it builds a suffix array by
Larsson-Sadakane refinement in numpy, takes common prefixes by Kasai's algorithm (one lane for each context) and
marks starts with a neighbour that shares SPAN bytes. A name with many contexts is dealt over several shards, each of
which sends its sorted distinct window hashes; equal ranges of these meet and are merged by binary search,
and each shard gets one row back with those of its own starts that another shard holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt, forget, hot_from, mix64, release, stored, table

SPAN, GRAM = 400, 32
#: Bytes worked on at once, starts in a stretch, contexts of one name in a piece, contexts in a shard, hashes in a merge range.
SLICE, STRETCH, PIECE, SHARD, RANGE = 1 << 20, 1024, 128, 3000, 1 << 16
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
M = (1 << 64) - 1


def rolling(b: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of each width-byte window, by doubling."""
    h, size, power = _TABLE[b], 1, _BASE
    out, done = None, 0
    while width:
        if width & 1:
            if out is None:
                out, done = h, size
            else:  # windows of `done` bytes, followed by windows of `size`
                n = min(len(out), len(h) - done)
                if n <= 0:
                    return np.zeros(0, np.uint64)
                out = out[:n] + h[done : done + n] * np.uint64(pow(_BASE, done, 1 << 64))
                done += size
        width >>= 1
        if width:
            if len(h) <= size:
                return np.zeros(0, np.uint64)
            h = h[:-size] + h[size:] * np.uint64(power)
            power = power * power & M
            size *= 2
    return mix64(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def stretches(joined: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, first start, last start, name's gram comes twice) of each stretch of texts that
    lie end to end in joined. Only a stretch whose gram comes twice can repeat within itself."""
    empty = np.zeros(0, np.int64)
    if len(joined) < SPAN:
        return empty, empty, empty, empty.astype(bool)
    grams = rolling(joined, GRAM)
    name = sliding_min(grams, SPAN - GRAM + 1)
    owner = np.searchsorted(ends, np.arange(len(name)), side="right")
    valid = ends[np.minimum(owner, len(ends) - 1)] - np.arange(len(name)) >= SPAN
    cut = np.ones(len(name), bool)
    cut[1:] = (name[1:] != name[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])
    begin = np.flatnonzero(cut)
    last = np.append(begin[1:], len(name)) - 1
    keep = valid[begin]
    begin, last = begin[keep], last[keep]
    n = (last - begin) // STRETCH + 1  # long runs in steps
    part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin, last = np.repeat(begin, n) + part * STRETCH, np.repeat(last, n)
    name, last = name[begin], np.minimum(last, begin + STRETCH - 1)
    twice = [np.count_nonzero(grams[i : j + SPAN - GRAM + 1] == k) > 1 for k, i, j in zip(name, begin.tolist(), last.tolist())]
    return name.view(np.int64), begin, last, np.array(twice, bool)


def text_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def text_key(raw: bytes) -> bytes:
    return xxhash.xxh3_128_digest(raw)


def _fingerprints(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(group):
        joined = b"".join(r for _, r in group)
        ends = np.cumsum([len(r) for _, r in group])
        names, a, b, twice = stretches(np.frombuffer(joined, np.uint8), ends)
        owner = np.searchsorted(ends, a, side="right")
        base = ends - [len(r) for _, r in group]
        ctx = [xxhash.xxh3_64_intdigest(joined[i : j + SPAN]) for i, j in zip(a.tolist(), b.tolist())]
        ids = np.array([d for d, _ in group], np.int64)[owner] if len(owner) else np.zeros(0, np.int64)
        keys = [text_key(r) for _, r in group]
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array(ids), "key": pa.array([keys[o] for o in owner.tolist()], pa.binary()), "name": pa.array(names, pa.int64()),
            "ctx": pa.array(np.array(ctx, np.uint64).view(np.int64), pa.int64()), "a": pa.array(a - base[owner] if len(a) else a, pa.int64()),
            "b": pa.array(b - base[owner] if len(b) else b, pa.int64()), "twice": pa.array(twice, pa.bool_()),
        })

    group, size = [], 0
    for f in frames:
        for d, t in zip(f.column(0).to_pylist(), f.column(1).to_pylist()):
            raw = text_bytes(t)
            if len(raw) < SPAN:
                continue
            group.append((d, raw))
            size += len(raw)
            if size >= SLICE:
                yield rows(group)
                group, size = [], 0
    if group:
        yield rows(group)


# -- suffix arrays -------------------------------------------------------------------------------
def words_at(padded: np.ndarray) -> np.ndarray:
    """Big-endian word of the eight bytes at each position."""
    w = np.zeros(len(padded) - 8, np.uint64)
    for k in range(8):
        w |= padded[k : k + len(w)].astype(np.uint64) << np.uint64(56 - 8 * k)
    return w


def lay_out(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with eight zeros after each part, part starts, part lengths)."""
    lengths = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(lengths + 8) - lengths - 8
    return np.frombuffer(b"".join(x for p in parts for x in (p, b"\0" * 8)) + b"\0" * 8, np.uint8), starts, lengths


def suffix_array(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, rank of each position or -1) over all suffixes of all parts.

    Larsson-Sadakane: sort by eight bytes, then refine only groups that are not yet single, by
    the rank as far ahead as is already sorted. A part ends in a sentinel of its own, lower
    than any byte and ordered by part.
    """
    n = int(lengths.sum())
    part = np.repeat(np.arange(len(lengths)), lengths)
    pos = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[part]
    end = (starts + lengths)[part]
    order = np.argsort(words[pos])
    first = words[pos[order]]
    new = np.ones(n, bool)
    new[1:] = first[1:] != first[:-1]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.full(len(words) + 1, -1, np.int64)
    rank[pos[order]] = group
    sa, sa_end, sa_part = pos[order], end[order], part[order]
    depth = 8
    tail = np.append(new[1:], True)
    active = np.flatnonzero(~(new & tail))
    while len(active):
        p = sa[active]
        ahead = p + depth
        over = ahead >= sa_end[active]
        key = np.where(over, sa_part[active] - len(starts), rank[np.where(over, 0, ahead)])
        g = rank[p]
        o = np.argsort(g * (len(words) + len(starts)) + key + len(starts))  # both in one number
        p, key, g = p[o], key[o], g[o]
        sa[active] = p
        sa_end[active], sa_part[active] = sa_end[active][o], sa_part[active][o]
        fresh = np.ones(len(p), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
        rank[p] = np.maximum.accumulate(np.where(fresh, active, 0))
        single = fresh & np.append(fresh[1:], True)
        active = active[~single]
        depth *= 2
    return sa, rank


def kasai(words: np.ndarray, sa: np.ndarray, rank: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """lcp[r]: common prefix of the suffixes of rank r - 1 and r, in their parts. All parts
    advance together, one position a step; a prefix loses at most one byte from step to step."""
    limit = np.zeros(len(words) + 1, np.int64)
    for s, n in zip(starts, lengths):
        limit[s : s + n] = np.arange(n, 0, -1)
    lcp = np.zeros(len(sa) + 1, np.int64)
    by_length = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[by_length], lengths[by_length]
    h = np.zeros(len(starts), np.int64)
    for step in range(int(lengths[0]) if len(lengths) else 0):
        lanes = int(np.searchsorted(-lengths, -step, side="left"))  # parts longer than step
        i = starts[:lanes] + step
        r = rank[i]
        j = sa[np.maximum(r - 1, 0)]
        most = np.where(r > 0, np.minimum(limit[i], limit[j]), 0)
        got = np.minimum(np.maximum(h[:lanes] - 1, 0), most)
        live = np.flatnonzero(got < most)
        while len(live):
            x = words[i[live] + got[live]] ^ words[j[live] + got[live]]
            same = np.full(len(live), 8)
            ne = x != 0
            if ne.any():
                y = x[ne]
                same[ne] = sum((y < np.uint64(1 << s)).astype(np.int64) for s in range(56, 0, -8))
            got[live] = np.minimum(got[live] + same, most[live])
            live = live[(same == 8) & (got[live] < most[live])]
        lcp[r] = got
        h[:lanes] = got
    return lcp


def repeated_starts(parts: list[bytes], span: int = SPAN) -> list[np.ndarray]:
    """For each part, whether the span-byte string at each start occurs elsewhere in the parts."""
    padded, starts, lengths = lay_out(parts)
    words = words_at(padded)
    sa, rank = suffix_array(words, starts, lengths)
    lcp = kasai(words, sa, rank, starts, lengths)
    hit = np.zeros(len(sa), bool)
    long_ = lcp[: len(sa)] >= span
    hit |= long_
    hit[:-1] |= long_[1:]
    out = []
    for s, n in zip(starts, lengths):
        out.append(hit[rank[s : s + max(0, n - span + 1)]])
    return out


def runs(flags: np.ndarray) -> np.ndarray:
    """First and last index of each run of true flags, one after the other."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.column_stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1]).astype("<i4")


_SHARD_SCHEMA = pa.schema([
    ("name", pa.int64()), ("ctx", pa.int64()), ("starts", pa.binary()), ("shard", pa.int64()), ("range", pa.int64()),
    ("hashes", pa.binary()), ("asked", pa.binary()),
])
#: One start that a shard asks about: place of its hash in the row, context, start.
_ASK = np.dtype([("at", "<i4"), ("ctx", "<i8"), ("start", "<i4")])


def _shard(t: pa.Table) -> pa.Table:
    """One shard: the runs of starts found here, a row for each context, and for names split over
    shards their distinct window hashes, a row for each range. Only starts that nothing here
    repeats are asked about."""
    seen, rows = set(), []
    for r in t.to_pylist():
        if (r["name"], r["ctx"]) not in seen:
            seen.add((r["name"], r["ctx"]))
            rows.append(r)
    rows.sort(key=lambda r: (r["name"], r["ctx"]))
    found = repeated_starts([r["bytes"] for r in rows])
    out: list[dict] = [{"name": r["name"], "ctx": r["ctx"], "starts": runs(f).tobytes()} for r, f in zip(rows, found) if r["n"] == 1 and f.any()]
    split: dict[int, list[int]] = {}
    for k, r in enumerate(rows):
        if r["pieces"] > 1:
            split.setdefault(r["name"], []).append(k)
    for name, ks in split.items():
        parts = [rolling(np.frombuffer(rows[k]["bytes"], np.uint8), SPAN) for k in ks]
        owner = np.repeat(np.array([rows[k]["ctx"] for k in ks], np.int64), [len(x) for x in parts])
        start = np.concatenate([np.arange(len(x)) for x in parts])
        asks = np.concatenate([~found[k] & (rows[k]["n"] == 1) for k in ks])
        h, first, back = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
        # so many ranges that all shards' hashes of one fit a task
        n_ranges = max(1, rows[ks[0]]["pieces"] * PIECE * 256 // RANGE)
        which = (h >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)
        cuts = np.searchsorted(which, np.arange(n_ranges + 1, dtype=np.uint64))
        asked = np.zeros(int(asks.sum()), _ASK)
        asked["at"], asked["ctx"], asked["start"] = back[asks], owner[asks], start[asks]
        asked.sort(order="at")
        ask_cuts = np.searchsorted(asked["at"], cuts)
        for q in range(n_ranges):
            i, j = cuts[q], cuts[q + 1]
            if i < j:
                mine = asked[ask_cuts[q] : ask_cuts[q + 1]].copy()
                mine["at"] -= i
                out.append({"name": name, "shard": rows[ks[0]]["shard"], "range": q, "hashes": h[i:j].tobytes(), "asked": mine.tobytes()})
    return pa.Table.from_pylist(out, schema=_SHARD_SCHEMA)


def in_others(lists: list[np.ndarray]) -> list[np.ndarray]:
    """For sorted lists: whether each entry is in another list. Lists are merged two by two;
    each merge looks its entries up in the other side by binary search."""
    def has(values, sorted_):
        if not len(sorted_) or not len(values):
            return np.zeros(len(values), bool)
        at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
        return sorted_[at] == values

    found = [np.zeros(len(x), bool) for x in lists]
    nodes = [(x, [k]) for k, x in enumerate(lists)]
    while len(nodes) > 1:
        nxt = []
        for (x, ks), (y, ls) in zip(nodes[::2], nodes[1::2]):
            for k in ks:
                found[k] |= has(lists[k], y)
            for k in ls:
                found[k] |= has(lists[k], x)
            nxt.append((np.union1d(x, y), ks + ls))
        if len(nodes) % 2:
            nxt.append(nodes[-1])
        nodes = nxt
    return found


def _merge(t: pa.Table) -> pa.Table:
    """One range of a name's hashes from all shards -> for each shard the starts it asked about
    that another shard holds too."""
    rows = t.to_pylist()
    out: dict[str, list] = {"name": [], "shard": [], "hits": []}
    for r, f in zip(rows, in_others([np.frombuffer(r["hashes"], np.uint64) for r in rows])):
        asked = np.frombuffer(r["asked"], _ASK)
        hit = asked[f[asked["at"]]]
        if len(hit):
            out["name"].append(r["name"])
            out["shard"].append(r["shard"])
            out["hits"].append(hit.tobytes())
    return pa.table({"name": pa.array(out["name"], pa.int64()), "shard": pa.array(out["shard"], pa.int64()), "hits": pa.array(out["hits"], pa.binary())})


def _answers(t: pa.Table) -> pa.Table:
    """Hits of one name in one shard, from all ranges -> the runs of starts, a row for each context."""
    hits = np.concatenate([np.frombuffer(x, _ASK) for x in t.column("hits").to_pylist()])
    order = np.lexsort((hits["start"], hits["ctx"]))
    ctx, start = hits["ctx"][order], hits["start"][order].astype(np.int64)
    owners, at = np.unique(ctx, return_index=True)
    cuts = np.append(at, len(ctx))
    packed = []
    for i, j in zip(cuts[:-1], cuts[1:]):
        flags = np.zeros(start[j - 1] + 1, bool)
        flags[start[i:j]] = True
        packed.append(runs(flags).tobytes())
    name = np.full(len(owners), t.column("name")[0].as_py(), np.int64)
    return pa.table({"name": pa.array(name), "ctx": pa.array(owners.astype(np.int64)), "starts": pa.array(packed, pa.binary())})


def _cut_out(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of the stretches (name, ctx, n, pieces, a, b) asked of each text."""
    for f in frames:
        out: dict[str, list] = {k: [] for k in ("name", "ctx", "n", "pieces", "shard", "bytes")}
        for text, wants in zip(f.column(0).to_pylist(), f.column(1).to_pylist()):
            raw = text_bytes(text)
            for w in wants:
                for k in ("name", "ctx", "n", "pieces", "shard"):
                    out[k].append(w[k])
                out["bytes"].append(raw[w["a"] : w["b"] + SPAN])
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k == "bytes" else pa.int64()) for k, v in out.items()})


def starts_of(span) -> list[tuple[int, int]]:
    """(first, last start) of each run that a row (a, b, starts) names: a to b, or those packed in
    starts, counted from a."""
    if span["starts"] is None:
        return [(span["a"], span["b"])]
    return [(span["a"] + int(i), span["a"] + int(j)) for i, j in np.frombuffer(span["starts"], "<i4").reshape(-1, 2)]


def removed(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal byte runs [i, j) covered by the strings that start in spans (first, last start)."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + SPAN)
        else:
            out.append([a, b + SPAN])
    return [(i, j) for i, j in out]


def kept_bytes(raw: bytes, cuts: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for i, j in cuts:
        parts.append(raw[at:i])
        at = j
    return b"".join([*parts, raw[at:]])


def _apply(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for f in frames:
        ids, n, gone, count, sha, texts = f.column(0), [], [], [], [], []
        for text, spans in zip(f.column(1).to_pylist(), f.column(2).to_pylist()):
            raw = text_bytes(text)
            cuts = removed([x for s in spans or () for x in starts_of(s)])
            kept = kept_bytes(raw, cuts)
            n.append(len(raw))
            gone.append(len(raw) - len(kept))
            count.append(len(cuts))
            sha.append(hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_pydict({
            "doc_id": ids, "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(count, pa.int64()),
            "kept_sha256": pa.array(sha, pa.string()),
        })


def _with_key(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for f in frames:
        raw = [text_bytes(t) for t in f.column(1).to_pylist()]
        keys = [text_key(r) if len(r) >= SPAN else None for r in raw]
        yield pa.RecordBatch.from_arrays([f.column(0), f.column(1), pa.array(keys, pa.binary())], ["doc_id", "text", "key"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, key, spans): for each text with repeated strings, the runs (a, b, starts) of their starts.
    key is the text's 128-bit hash."""
    spark = docs.sparkSession
    prints = stored(docs.mapInArrow(_fingerprints, "doc_id long, key binary, name long, ctx long, a long, b long, twice boolean"), "sa-prints")
    release(spark)
    most = hot_from(prints.count())
    # names that occur once are dropped before any further step
    mixed = ((F.min("ctx") != F.max("ctx")) | F.max("twice")).alias("mixed")
    names = stored(prints.groupBy("name").agg(F.count("*").alias("k"), mixed, F.max("twice").alias("twice")).where("k > 1 or twice").drop("twice"), "sa-names")
    shared = stored(dealt(prints.drop("twice"), names, ["name"], "k", most, ("doc_id", "ctx", "a")), "sa-shared")
    forget(prints)
    release(spark)
    contexts = stored(
        shared.groupBy("name", "ctx").agg(F.count("*").alias("n"), F.first("mixed").alias("mixed"), F.first("k").alias("k"), F.min(F.struct("doc_id", "key", "a", "b")).alias("at")), "sa-contexts"
    )
    asked = contexts.where("mixed").select("name", "ctx", "n", "k", "at.*")
    # a name of few rows is one piece; others are counted by contexts, not by rows
    large = asked.where(F.col("k") > PIECE)
    many = stored(large.groupBy("name").agg(F.count("*").alias("c")), "sa-many")
    total = asked.count()
    n_shards = max(1, -(-total // SHARD))
    counted = dealt(large, many, ["name"], "c", most, ("doc_id", "ctx", "a")).withColumn("pieces", F.ceil(F.col("c") / PIECE).cast("long")).drop("c")
    reps = asked.where(F.col("k") <= PIECE).withColumn("pieces", F.lit(1).cast("long")).unionByName(counted)
    reps = stored(reps.withColumn("shard", F.pmod(F.xxhash64("name", F.pmod(F.xxhash64("ctx"), F.col("pieces"))), F.lit(n_shards))).drop("k"), "sa-reps")
    per_doc = reps.groupBy("doc_id", "key").agg(F.collect_list(F.struct("name", "ctx", "n", "pieces", "shard", "a", "b")).alias("wants"))
    keyed = docs.mapInArrow(_with_key, "doc_id long, text string, key binary").where("key is not null")
    cut = keyed.join(per_doc, ["doc_id", "key"]).select("text", "wants").mapInArrow(
        _cut_out, "name long, ctx long, n long, pieces long, shard long, bytes binary"
    )
    found = stored(
        cut.groupBy("shard").applyInArrow(_shard, "name long, ctx long, starts binary, shard long, range long, hashes binary, asked binary"), "sa-shards"
    )
    release(spark)
    merged = found.where("range is not null").groupBy("name", "range").applyInArrow(_merge, "name long, shard long, hits binary")
    answers = merged.groupBy("name", "shard").applyInArrow(_answers, "name long, ctx long, starts binary")
    single = reps.where("n = 1").select("name", "ctx", "doc_id", "key", "a")
    spans = found.where("range is null").select("name", "ctx", "starts").union(answers).join(single, ["name", "ctx"]).select("doc_id", "key", "a", F.lit(None).cast("long").alias("b"), "starts")
    whole = contexts.where("n > 1").select("name", "ctx", "n")
    direct = dealt(shared.drop("k", "mixed"), whole, ["name", "ctx"], "n", most, ("doc_id", "ctx", "a")).select("doc_id", "key", "a", "b", F.lit(None).cast("binary").alias("starts"))
    out = stored(direct.union(spans).groupBy("doc_id", "key").agg(F.collect_set(F.struct("a", "b", "starts")).alias("spans")), "sa-spans")
    forget(names, shared, contexts, many, reps, found)
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of docs (doc_id, text).

    Every byte covered by a SPAN-byte string that also starts elsewhere, in the same text or
    another, is removed. Null texts are empty; texts shorter than SPAN lose nothing; a row that
    repeats a text loses all of it, as its copy does (from SPAN bytes on). Null ids are treated as
    any other; other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sure = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    spans = repeated_spans(sure)
    keyed = docs.mapInArrow(_with_key, "doc_id long, text string, key binary")
    out = keyed.join(spans, ["doc_id", "key"], "left").select("doc_id", "text", "spans")
    return out.mapInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
