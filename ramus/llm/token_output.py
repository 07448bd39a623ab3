"""Token-ID / binary output.

Documents are tokenised once. Ids are then renumbered by falling frequency, so frequent ids
take one byte, and written in a byte-aligned variable-length code whose lengths stand in
separate control bytes (two bits an id, four ids a control byte). Files hold ascending
document ids; reading decodes each block with a 256-entry table of lengths and numpy.

Format of a block (fixed values: magic b"RTOK", version 1, little endian):
    magic, u8 version, u64 documents, u64 ids, then
    i64 document id x documents, u64 ids of each x documents,
    control bytes (ceil(ids / 4)), data bytes.
Blocks are rows (shard, block, first, n_ids, payload) of a Parquet container, so any Hadoop file system can
hold them; first counts the ids of earlier blocks of the shard. The table of ranks is written beside them once.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, fresh_path, release, stored, table

MAGIC, VERSION = b"RTOK", 1
HEAD = struct.Struct("<4sBQQ")
END_ID = 2
#: Ids after which a block is closed, pieces kept per worker and characters of each at most, characters encoded at a time.
BLOCK_IDS, CACHE_WORDS, CACHE_CHARS, BATCH_CHARS = 1 << 18, 500_000, 40, 4 << 20

_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space other than space and line end.
_OTHER_SPACE = [chr(c) for c in range(0x3001) if chr(c).isspace() and c not in (10, 32)]
#: A letter and marks after it; marks are no letter, digit, white space or apostrophe.
_MARKED = r"([A-Za-zÀ-ÖØ-öø-ɏ])([.,;:!?#$%&*)]+)"


def _letters(word: str) -> bool:
    """Whether word holds nothing but long-known letters, which any version of Unicode tells as such."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0530")


class Encoder:
    """Whole-text ids of one tokenizer file.

    A byte-level pre-tokenizer never joins across a single space between two non-spaces
    (the space belongs to what follows), nor across a line end that stands alone, nor a letter
    with a mark after it, so a text may be cut there, and pieces that came before need not be
    encoded again. A full cache takes no more; results do not depend on it. Tokenizers without
    that property are given whole texts.
    """

    def __init__(self, path: str, kind: str = "<u4"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.kind, self.code = kind, {"<u2": "H", "<u4": "I"}[kind]
        self.cache: dict[str, bytes] = {}  # ids of a piece with the space before it, or the line end it begins with
        probe = "a b, c. d\ne 12 'tis (so) it's #x\nfg, h.\nThe"
        self.line = self.encode(["\n"])[0]
        one = len(self.line) == np.dtype(kind).itemsize
        self.cuts = one and '"ByteLevel"' in self.tok.to_str() and self.encode([probe])[0] == self.batch([probe])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        code, out = self.code, []
        for i in range(0, len(texts), 20_000):
            out += [array(code, e.ids).tobytes() for e in self.tok.encode_batch_fast(texts[i : i + 20_000], add_special_tokens=False)]
        return out

    @staticmethod
    def plain(text: str) -> bool:
        """Whether every space may be a cut, and all other white space is line ends."""
        odd = "  " in text or "\n " in text or " \n" in text or text[:1] == " " or text[-1:] == " "
        return not odd and (text.isprintable() or not any(c in text for c in _OTHER_SPACE))

    def batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        if not getattr(self, "cuts", True):
            return self.encode(texts)
        out: list[bytes] = [b""] * len(texts)
        kinds = [(0 if not self.plain(t) else 1 if "\n\n" in t else 2) for t in texts]
        for kind in range(3):
            at = [k for k, x in enumerate(kinds) if x == kind]
            if not at:
                continue
            if kind:
                # marks after a letter become pieces, told from those after a space by a tab
                whole = pc.replace_substring_regex(pa.array([texts[k] for k in at], pa.large_string()), _MARKED, "\\1 \t\\2")
                if kind == 2:  # line ends stand alone, so they begin pieces too
                    whole = pc.replace_substring(whole, "\n", " \n")
                cut = pc.split_pattern(whole, " ")
                flat, offsets = cut.flatten(), cut.offsets.to_numpy()
            else:
                parts = [_SAFE_CUT.split(texts[k]) for k in at]
                flat = pa.array([p for ps in parts for p in ps], pa.large_string())
                offsets = np.cumsum([0, *map(len, parts)])
            for k, ids in zip(at, self._gather(flat, offsets)):
                out[k] = ids
        return out

    def _gather(self, flat: pa.Array, offsets: np.ndarray) -> list[bytes]:
        """Ids of texts given as pieces: each different piece is looked up once, then the ids
        are copied to where it stands. A text's first piece has no space before it."""
        coded = flat.dictionary_encode()
        words, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        known = list(map(self.cache.get, words))
        missing = [i for i, g in enumerate(known) if g is None]
        for i, ids in zip(missing, self._learn([words[i] for i in missing])):
            known[i] = ids
        index[offsets[:-1]] = len(words) + np.arange(len(offsets) - 1)
        known += self.encode(flat.take(pa.array(offsets[:-1])).to_pylist())
        held = np.empty(len(known), object)
        held[:] = known
        held = held[index].tolist()
        return [b"".join(held[i:j]) for i, j in zip(offsets.tolist(), offsets[1:].tolist())]

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces that the cache lacks. A piece begins with a line end, with a tab
        in place of nothing, or else stands for itself and a space before it."""
        out: list[bytes] = [b""] * len(pieces)
        inner, begun, rest = [], [], []
        for i, p in enumerate(pieces):
            (inner if _letters(p) else begun if p[:1] == "\n" and _letters(p[1:]) else rest).append(i)
        for i, ids in zip(inner, self._words([" " + pieces[i] for i in inner])):
            out[i] = ids
        for i, ids in zip(begun, self._words([pieces[i][1:] for i in begun])):
            out[i] = self.line + ids
        forms = [p if p[:1] == "\n" else p[1:] if p[:1] == "\t" else " " + p for p in (pieces[i] for i in rest)]
        for i, ids in zip(rest, self.encode(forms)):
            out[i] = ids
        if len(self.cache) < CACHE_WORDS:
            self.cache.update((p, ids) for p, ids in zip(pieces, out) if len(p) <= CACHE_CHARS)
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone, encoded as lines of a text and cut at its line ends."""
        out, end = [], int(np.frombuffer(self.line, self.kind)[0])
        for i in range(0, len(words), 5_000):
            part = words[i : i + 5_000]
            ids = np.array(self.tok.encode_batch_fast(["\n".join(part) + "\n"], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(ids == end) * ids.itemsize
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *(ends[:-1] + ids.itemsize).tolist()], ends.tolist())]
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]


# -- the variable-length code ---------------------------------------------------------------
#: Bytes of each of the four ids of a control byte, and of all four.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """uint32 values -> (control bytes, data bytes)."""
    v = np.ascontiguousarray(values, "<u4")
    n = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = n - 1
    c = codes.reshape(-1, 4)
    control = c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6
    keep = np.arange(4, dtype=np.uint8) < n[:, None]
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The inverse of pack(), by table lookup."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    keep = np.arange(4, dtype=np.uint8) < lengths[:, None]
    out = np.zeros((count, 4), np.uint8)
    out[keep] = np.frombuffer(data, np.uint8)[: int(lengths.sum(dtype=np.int64))]
    return out.view("<u4").reshape(-1)


def write_block(doc_ids: list[int], parts: list[np.ndarray]) -> bytes:
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    control, data = pack(ids)
    return b"".join([
        HEAD.pack(MAGIC, VERSION, len(doc_ids), len(ids)),
        np.array(doc_ids, "<i8").tobytes(), np.array([len(p) for p in parts], "<u8").tobytes(), control, data,
    ])


def read_block(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, ids of each, all ranks)."""
    magic, version, docs, count = HEAD.unpack_from(payload)
    if (magic, version) != (MAGIC, VERSION):
        raise ValueError("not a token block")
    at = HEAD.size
    doc_ids = np.frombuffer(payload, "<i8", docs, at)
    sizes = np.frombuffer(payload, "<u8", docs, at := at + 8 * docs)
    at += 8 * docs
    control = payload[at : (at := at + -(-count // 4))]
    return doc_ids, sizes, unpack(control, payload[at:], count)


# -- jobs ------------------------------------------------------------------------------------
def _encode(path: str, end_id: int, wide: bool):
    kind = "<u4" if wide else "<u2"

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, kind)
        tail = np.array([end_id], kind).tobytes()
        for b in frames:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            ends = np.cumsum([len(t or "") for t in texts])
            i = 0
            while i < len(ids):  # about BATCH_CHARS at a time, one text at least
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BATCH_CHARS)))
                got = [x + tail for x in enc.batch([t or "" for t in texts[i:j]])]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[i:j], pa.int64()), "ids": pa.array(got, pa.binary())})
                i = j

    return run


def _counts(kind: str, size: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in frames:
            for x in b.column(0).to_pylist():
                total += np.bincount(np.frombuffer(x, kind), minlength=size)[:size] if len(x) > size else 0
                if len(x) <= size:
                    np.add.at(total, np.frombuffer(x, kind), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    return run


def _blocks(rank, kind: str):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block, first, held, docs, parts = TaskContext.get().partitionId(), 0, 0, 0, [], []
        to_rank = rank.value

        def close():
            nonlocal block, first, held, docs, parts
            row = {"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "first": pa.array([first], pa.int64()), "n_ids": pa.array([held], pa.int64()), "payload": pa.array([write_block(docs, parts)], pa.binary())}
            block, first, held, docs, parts = block + 1, first + held, 0, [], []
            return pa.RecordBatch.from_pydict(row)

        for b in frames:
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = to_rank[np.frombuffer(x, kind)]
                docs.append(d if d is not None else -(1 << 63))
                parts.append(v)
                held += len(v)
                if held >= BLOCK_IDS:
                    yield close()
        if docs:
            yield close()

    return run


def _read(back, starts):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_id, at = back.value, starts.value
        for b in frames:
            for s, before, payload in zip(*(b.column(i).to_pylist() for i in range(3))):
                doc_ids, sizes, ranks = read_block(payload)
                ids = to_id[ranks].astype("<u4")
                ends = np.cumsum(sizes).astype(np.int64)
                begin = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
                crc = [zlib.crc32(ids[i:j].tobytes()) for i, j in zip(begin, ends)]
                null = doc_ids == -(1 << 63)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(doc_ids, pa.int64(), mask=null), "start": pa.array(begin + (at[s] + before), pa.int64()),
                    "n_tokens": pa.array(sizes.astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64()),
                })

    return run


BLOCKS = "shard int, block int, first long, n_ids long, payload binary"


def vocabulary(tokenizer: str, end_id: int = END_ID) -> int:
    """Ids that a tokenizer file and the end id need."""
    from tokenizers import Tokenizer

    return 1 + max(end_id, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values())


def encode_ids(docs: DataFrame, tokenizer: str, end_id: int = END_ID, vocab: int | None = None) -> DataFrame:
    """(doc_id, ids): little-endian ids of the whole text and the end id; two bytes an id
    where the vocabulary allows it, else four. A null or empty text gives the end id alone."""
    vocab = vocab or vocabulary(tokenizer, end_id)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _encode(tokenizer, end_id, vocab > 1 << 16), "doc_id long, ids binary"
    )


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Tokenise docs (doc_id, text) and write blocks under path/blocks and ranks under path/ranks.

    Ties of doc_id are ordered by a hash of the ids, then the ids themselves; null ids come first. Rows that
    repeat an id, or have none, are dealt over as many ranges as they fill. Very long texts are encoded whole. An empty
    table writes no block. Other columns are ignored. Only vocabulary-sized counts reach the driver.
    """
    spark = docs.sparkSession
    vocab = vocabulary(tokenizer, end_id)
    kind = "<u4" if vocab > 1 << 16 else "<u2"
    raw = stored(encode_ids(docs, tokenizer, end_id, vocab), "token-ids")
    counts = raw.select("ids").mapInArrow(_counts(kind, vocab), "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = counts.orderBy(F.desc("n"), "id").toArrow()  # at most one row per vocabulary entry
    order = ranked.column("id").to_numpy().astype(np.int64)
    rank = np.zeros(vocab, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(order)], "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the row number only parts rows that are equal in all else
    line = raw.select("doc_id", "ids", F.xxhash64("ids").alias("h"), F.monotonically_increasing_id().alias("r"))
    (
        line.repartitionByRange(parts, "doc_id", "h", "r")
        .sortWithinPartitions("doc_id", "h", "ids")
        .select("doc_id", "ids")
        .mapInArrow(_blocks(spark.sparkContext.broadcast(rank), kind), BLOCKS)
        .write.option("compression", "uncompressed")
        .parquet(f"{path}/blocks")
    )
    forget(raw)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files. Of the
    blocks only the totals of the shards (the partitions that wrote them) reach the driver."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    order = spark.read.schema("rank int, id int").parquet(f"{path}/ranks").orderBy("rank").toArrow().column("id").to_numpy()
    at, starts = 0, {}
    for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect():
        starts[r.shard] = at
        at += r.n
    sc = spark.sparkContext
    return blocks.select("shard", "first", "payload").mapInArrow(
        _read(sc.broadcast(order.astype(np.uint32)), sc.broadcast(starts)), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_output(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write docs as token files in the shared folder and return what the files say."""
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    write_tokens(docs, path, tokenizer or tokenizer_path())
    release(spark)
    return read_tokens(spark, path)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))
