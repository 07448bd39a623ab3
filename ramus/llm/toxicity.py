"""Toxicity by a weighted lexicon.

Texts are lower-cased and folded (homoglyphs, digit and sign substitutions, invisible
characters), then one Aho-Corasick automaton finds lexicon terms and exception phrases. A term
counts only where a word begins (a whole word also where it ends) and outside exception phrases;
the best term of a word counts. The summed weights, normalised by length, go through a logistic
curve.

The lexicon is learned: whole words and word beginnings whose document frequencies differ most
between toxic and other labelled rows, weighted by their log odds. So are exception phrases (a hit word with the one
before or after it, where these come in other rows rather than in toxic ones) beside a few known ones, and the curve.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, stored, table

#: Labelled rows learned from, about; they bound the lexicon.
TRAIN_ROWS = 12_000
PREFIXES = (4, 5, 6, 7)
#: A term must be in this many toxic training rows, and have at least these log odds.
MIN_TOXIC, MIN_ODDS = 4, 3.0
#: An exception must be in this many other rows, and have at most these log odds.
MIN_OTHER, MAX_ODDS = 4, -1.0
FOLDS = 5

# Look-alike letters, digits that stand for letters, invisible characters.
_LOOKS = dict(zip("аеорсхуіјѕһԁвкмнтαορεικντυ", "aeopcxyijshdbkmhtaopeikvtu"))
_DIGITS = dict(zip("013456789", "oieasgtbg"))
_INVISIBLE = "­​‌‍⁠﻿"
_FULL_WIDTH = {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
FOLD = str.maketrans(_LOOKS | _DIGITS | _FULL_WIDTH | dict.fromkeys(_INVISIBLE, ""))
_SIGNS = re.compile(r"[@$!](?=[^\W\d_])")
_SIGN = {"@": "a", "$": "s", "!": "i"}
_WORD = re.compile(r"[^\W_]+")
#: Phrases in which a lexicon term is not an insult.
EXCEPTIONS = ("trash bag", "trash bin", "trash can", "clown fish", "class clown", "pond scum", "circus clown", "sore loser")


def fold(text: str | None) -> str:
    low = (text or "").lower().translate(FOLD)
    return _SIGNS.sub(lambda m: _SIGN[m[0]], low) if "@" in low or "$" in low or "!" in low else low


def candidates(word: str) -> list[tuple[str, bool]]:
    """(term, is a whole word) of a folded word; 1-2 letter words give none."""
    if len(word) < 3:
        return []
    return [(word, True), *((word[:n], False) for n in PREFIXES if len(word) > n)]


@dataclass
class Lexicon:
    """terms: (text, whole word) -> weight. curve: logistic coefficients of (1, density, hits)."""

    terms: dict[tuple[str, bool], float] = field(default_factory=dict)
    curve: tuple[float, float, float] | None = None
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self):
        a = ahocorasick.Automaton()
        by_text: dict[str, dict] = {}
        for (t, whole), w in self.terms.items():
            by_text.setdefault(t, {})[whole] = w
        for e in self.exceptions:
            by_text.setdefault(e, {})[None] = 0.0
        for t, kinds in by_text.items():
            a.add_word(t, (len(t), kinds))
        if by_text:
            a.make_automaton()
        return a


def hit_words(a, text: str) -> dict[int, float]:
    """Place and weight of each word hit in a folded text."""
    best: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    last = len(text)
    if not len(a):
        return best
    for end, (n, kinds) in a.iter(text):
        begin = end - n + 1
        if begin and text[begin - 1].isalnum():
            continue
        ends = end + 1 == last or not text[end + 1].isalnum()
        for whole, w in kinds.items():
            if whole is None:
                if ends:
                    excused.append((begin, end))
            elif (ends or not whole) and w > best.get(begin, 0.0):
                best[begin] = w
    for i, j in excused:
        for k in [k for k in best if i <= k <= j]:
            del best[k]
    return best


def hits(a, text: str) -> tuple[float, int]:
    """(summed weights, words hit) in a folded text."""
    best = hit_words(a, text)
    return sum(best.values()), len(best)


def features(a, text: str | None) -> tuple[float, float]:
    """(log of weight a thousand words, log of words hit)."""
    low = fold(text)
    total, n = hits(a, low)
    length = max(20, len(low) / 5.6)  # words, by their mean length; short texts count as 20
    return float(np.log1p(1000 * total / length)), float(np.log1p(n))


def phrases(a, text: str | None) -> set[str]:
    """Each hit word with the word before it and with the word after it, one space between."""
    low, out = fold(text), set()
    best = hit_words(a, low)
    words = list(_WORD.finditer(low)) if best else []
    for x, y in zip(words, words[1:]):
        if (x.start() in best or y.start() in best) and low[x.end() : y.start()] == " ":
            out.add(f"{x[0]} {y[0]}")
    return out


def _counted(units):
    """Rows (term, whole, pos, neg): in how many toxic and other texts each of units(text) is."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
        of = units()

        def rows():
            keys = list(seen[True].keys() | seen[False].keys())
            out = pa.RecordBatch.from_pydict({
                "term": pa.array([k[0] for k in keys], pa.string()), "whole": pa.array([k[1] for k in keys], pa.bool_()),
                "pos": pa.array([seen[True][k] for k in keys], pa.int64()), "neg": pa.array([seen[False][k] for k in keys], pa.int64()),
            })
            seen[True].clear()
            seen[False].clear()
            return out

        for b in frames:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[bool(toxic)].update(of(text))
                if len(seen[True]) + len(seen[False]) > 300_000:
                    yield rows()
        yield rows()

    return run


def _term_units():
    return lambda text: {c for w in set(_WORD.findall(fold(text))) for c in candidates(w)}


def _phrase_units(lexicon: Lexicon):
    def units():
        a = lexicon.automaton()
        return lambda text: {(p, True) for p in phrases(a, text)}

    return units


def _points(lexicon: Lexicon):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for b in frames:
            f = [features(a, t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"x1": pa.array([x[0] for x in f], pa.float64()), "x2": pa.array([x[1] for x in f], pa.float64()), "y": b.column(1).cast(pa.float64())})

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    pen = np.diag([0.0] + [ridge] * (x.shape[1] - 1)) + 1e-9 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pen, x.T @ (p - y) + pen @ w)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Lexicon:
    """A lexicon and curve from labelled rows outside the held-out fold.

    At most about train_rows rows are used (all, if fewer), picked by a hash of doc_id. Rows
    with a null id, label or text teach nothing; without two classes the curve is None.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", FOLDS) != 0)).select(F.col("doc_id").cast("long"), (F.col("toxic") == 1).alias("toxic"))
    n = known.count()
    if n > train_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000)) < int(1e6 * train_rows / n))
    known = known.distinct()
    few = known.limit(2 * train_rows + 1).count() <= 2 * train_rows
    sample = stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null").join(F.broadcast(known) if few else known, "doc_id").select("text", "toxic"), "tox-sample")
    per = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = per.get(True, 0), per.get(False, 0)
    if not pos or not neg:
        return Lexicon()
    odds = F.log((F.col("pos") + 0.1) / (pos + 1)) - F.log((F.col("neg") + 0.1) / (neg + 1))

    def found(units) -> DataFrame:
        rows = sample.mapInArrow(_counted(units), "term string, whole boolean, pos long, neg long")
        return rows.groupBy("term", "whole").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).withColumn("odds", odds)

    best = found(_term_units).where((F.col("pos") >= MIN_TOXIC) & (F.col("odds") >= MIN_ODDS)).collect()  # words of the sample
    terms = {(r.term, r.whole): r.odds for r in best}
    # a word needs no entry where its beginning says as much
    for t, whole in sorted(terms, key=lambda k: (-len(k[0]), k)):  # longest first
        if any((t[:n], False) in terms and terms[t[:n], False] >= terms[t, whole] - 0.7 for n in PREFIXES if n < len(t) or whole and n == len(t)):
            del terms[t, whole]
    excused = found(_phrase_units(Lexicon(terms))).where((F.col("neg") >= MIN_OTHER) & (F.col("odds") <= MAX_ODDS)).select("term").collect()
    lexicon = Lexicon(terms, exceptions=tuple(sorted({*EXCEPTIONS, *(r.term for r in excused)})))
    points = sample.mapInArrow(_points(lexicon), "x1 double, x2 double, y double").toArrow()  # train_rows rows of three numbers
    x = np.column_stack([np.ones(len(points)), points.column("x1").to_numpy(), points.column("x2").to_numpy()])
    return Lexicon(terms, tuple(float(v) for v in _logistic(x, points.column("y").to_numpy())), lexicon.exceptions)


def _score(lexicon: Lexicon):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for b in frames:
            f = np.array([features(a, t) for t in b.column(1).to_pylist()]).reshape(-1, 2)
            if lexicon.curve is None:
                score = np.zeros(len(f))
            else:
                c = lexicon.curve
                score = 1 / (1 + np.exp(-np.clip(c[0] + f @ np.array(c[1:]), -30, 30)))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "score": pa.array(score, pa.float64())})

    return run


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, predicted) of each row; a null or empty text scores as one without
    hits, and a very long text is read whole. Repeated rows are scored each; a score of 0.5 is toxic. Other columns are ignored; empty tables give no rows."""
    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_score(lexicon), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(crc_mod("doc_id", FOLDS) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")
