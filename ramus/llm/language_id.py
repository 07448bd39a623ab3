"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a binary classifier over hashed byte
trigrams (log odds of the languages whose bit is 1 against the others) gives a margin; the
codeword with the least loss is the prediction, where each bit weighs by the least margin that the
training counts of any language have on their own side of it. The loss of the other codewords becomes
the score and flags ambiguous texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, mix64, table

#: Hashed features; labelled rows a language learns from; languages with exhaustive codes.
BITS, TRAIN_ROWS, EXHAUSTIVE = 15, 3_000, 6
RANDOM_CODE_BITS = 31
FOLDS, HELD = 4, 2
#: A score below this is ambiguous.
AMBIGUOUS = 0.55
SLICE = 1 << 20
_LETTER = regex.compile(r"\p{L}")
#: ASCII other than letters becomes a space: marks say little of the language.
_PLAIN = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def plain(text: str | None) -> np.ndarray:
    return np.frombuffer((" " + (text or "").lower() + " ").encode("utf-8", "replace").translate(_PLAIN), np.uint8)


def trigrams(b: np.ndarray) -> np.ndarray:
    """Feature of each byte trigram; a text of three bytes or more has len(b) - 2."""
    if len(b) < 3:
        return np.zeros(0, np.int64)
    x = b.astype(np.uint32)
    x = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)
    return ((x * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def codewords(n: int) -> np.ndarray:
    """n different codewords of +1/-1 bits. Few languages: every split of them once; more:
    fixed pseudo-random splits, none of them empty, none twice, until all rows differ."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= EXHAUSTIVE:
        cols = [[1, *((k >> i & 1) * 2 - 1 for i in range(n - 1))] for k in range(2 ** (n - 1) - 1)]
        return np.array(cols, np.int8).T
    width = max(RANDOM_CODE_BITS, 8 * int(np.ceil(np.log2(n))))
    cols, draw = {}, 0
    while len(cols) < width or len(np.unique(np.array(list(cols.values())), axis=1).T) < n:
        h = mix64(np.arange(draw * n, (draw + 1) * n, dtype=np.uint64) + np.uint64(0x51ED270B)) >> np.uint64(63)
        bits = h == h[0]  # a split and its mirror image are the same
        draw += 1
        if not bits.all():
            cols[bits.tobytes()] = bits
    return np.where(np.array(list(cols.values())).T, 1, -1).astype(np.int8)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits, float32
    trust: np.ndarray  # weight of each bit in the loss

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """Mean log odds of each text's trigrams for each bit."""
        out = np.zeros((len(texts), self.code.shape[1]))
        count = np.zeros(len(texts))
        group, size = [], 0

        def flush():
            nonlocal group, size
            if not group:
                return
            joined = np.concatenate([b for _, b in group])
            w = self.weights[trigrams(joined)]
            w = np.vstack([w, np.zeros((2, w.shape[1]), w.dtype)])
            ends = np.cumsum([len(b) for _, b in group])
            begins = ends - [len(b) for _, b in group]
            for e in (1, 2):  # trigrams that reach into the next text
                w[ends - e] = 0
            sums = np.add.reduceat(w, begins, axis=0)
            for (k, b), s in zip(group, sums):
                out[k] += s
                count[k] += len(b) - 2
            group, size = [], 0

        for k, text in enumerate(texts):
            b = plain(text)
            for i in range(0, max(1, len(b) - 2), SLICE):  # a very long text goes by slices that share two bytes
                part = b[i : i + SLICE + 2]
                if len(part) >= 3:
                    group.append((k, part))
                    size += len(part)
                if size >= SLICE:
                    flush()
        flush()
        return out / np.maximum(count, 1)[:, None]

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language or und, score) of each text."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        m = np.clip(self.margins(texts) * 4, -8, 8)
        loss = (np.log1p(np.exp(-m[:, None, :] * self.code[None])) * self.trust).sum(axis=2) / self.trust.sum()
        p = np.exp(-6 * (loss - loss.min(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        known = np.array([has_letter(t) for t in texts], bool)
        return [self.languages[k] if ok else "und" for k, ok in zip(best, known)], np.where(known, p.max(axis=1), 0.0)


def _count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for b in frames:
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            c = total.setdefault(lang, np.zeros(1 << BITS, np.int64))
            whole = plain(text)
            for i in range(0, max(1, len(whole) - 2), SLICE):
                c += np.bincount(trigrams(whole[i : i + SLICE + 2]), minlength=1 << BITS)
    for lang, c in total.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "f": pa.array(at, pa.int64()), "n": pa.array(c[at], pa.int64())})


def learn(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit from (doc_id, text, lang) outside the held-out fold, on about `rows` rows of each
    language picked by a hash of doc_id (all, if fewer). Null ids, texts and languages teach
    nothing; very long texts are counted whole. What reaches the driver is bounded by languages x 2^BITS counts."""
    known = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", FOLDS) != HELD)
    )
    per = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(per)
    if not languages:
        return Model([], codewords(0), np.zeros((1 << BITS, 1), np.float32), np.ones(1))
    share = F.lit(0)
    for lang, n in per.items():
        share = F.when(F.col("lang") == lang, int(1e6 * min(1.0, rows / n))).otherwise(share)
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)) < share).select("text", "lang")
    got = sample.mapInArrow(_count, "lang string, f long, n long").groupBy("lang", "f").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), 1 << BITS))
    at = {lang: i for i, lang in enumerate(languages)}
    rows_of = np.array([at[x] for x in got.column("lang").to_pylist()], np.int64)
    counts[rows_of, got.column("f").to_numpy()] = got.column("n").to_numpy()
    rate = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    code = codewords(len(languages))
    floor = 2e-6
    weights, trust = np.zeros((1 << BITS, code.shape[1]), np.float32), np.ones(code.shape[1])
    for j in range(code.shape[1]):
        one, other = code[:, j] > 0, code[:, j] < 0
        if not one.any() or not other.any():
            continue
        w = np.log(rate[one].mean(axis=0) + floor) - np.log(rate[other].mean(axis=0) + floor)
        weights[:, j] = w
        # how far the languages lie on their own side of this bit
        side = (rate @ w) * code[:, j]
        trust[j] = max(0.05, float(side.min()))
    return Model(languages, code, weights, trust)


def _predict(model):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in frames:
            texts = b.column(b.schema.names.index("text")).to_pylist()
            lang, score = [], []
            for i in range(0, len(texts), 256):
                x, y = m.decide(texts[i : i + 256])
                lang += x
                score += y.tolist()
            keep = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of each row of docs (doc_id, text).

    A null text and one without a letter (Unicode category L) is und with score 0; very short texts
    get the nearest codeword and a low score, ties the first language by code point; very long
    texts are read whole, in slices. Repeated rows are judged each; other columns are
    ignored; an empty table gives no rows, and a model without languages says und.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(_predict(sent), "doc_id long, lang_pred string, score double")
    return out.withColumn("ambiguous", (F.col("lang_pred") != "und") & (F.col("score") < AMBIGUOUS))


def _known(model, text_at: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            texts = b.column(text_at).cast(pa.string()).to_pylist()
            keep = [x != "und" for i in range(0, len(texts), 256) for x in model.value.decide(texts[i : i + 256])[0]]
            yield b.filter(pa.array(keep, pa.bool_()))

    return run


def known_language(docs: DataFrame, model: Model) -> DataFrame:
    """docs without rows whose language can't be told (und: null texts and those without a letter);
    ambiguous ones stay, repeated rows are judged each, very long texts are read whole. Without a
    labelled row there is no language to tell, and rows with a letter stay."""
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return docs.mapInArrow(_known(docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")), docs.schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, learn(docs))
    held = F.coalesce(crc_mod("doc_id", FOLDS) == HELD, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")
