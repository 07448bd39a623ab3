"""MinHash near-dedup by one-permutation hashing.

One hash of each shingle fills SLOTS bins; empty bins borrow from others by optimal
densification (each empty bin walks its own hash sequence over the bins until it meets a full
one). Bands of ROWS bins name buckets. Rows with the same shingle set are one set from here
on; in every bucket one centre is compared with the sets that are not yet in the centre's
component, so pair counts follow the bucket sizes. Every link is confirmed on full shingle
sets. Sets of a bucket that still holds several components are regrouped by their rarest shingles (an
exact prefix filter), where a passage shared by many unlinked sets groups none; there past centres
leave their group and the number of centres grows until all sets left in a group are joined or each
has been a centre, so no link between two sets of a bucket is lost.

A pair at similarity 0.75 shares no bucket with probability (1 - 0.75^ROWS)^BANDS = 5e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, dealt, forget, hot_from, mix64, release, stored, table

WORDS, NUM, DEN = 5, 75, 100
BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
#: A candidate list up to this many rows is broadcast, a longer one is shuffled.
SMALL_ROWS = 250_000

_POWERS = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space (bytes.split and bytes.lower do just that)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; the whole sequence if shorter."""
    ws = words_of(text)
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    n = min(k, len(h))
    acc = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        acc += h[i : len(h) - n + 1 + i] * _POWERS[i]
    return np.unique(mix64(acc + np.uint64(n)))


def _walks(slots: int, steps: int = 64) -> np.ndarray:
    """walk[i, a]: the bin that empty bin i asks at its a-th attempt."""
    i, a = np.meshgrid(np.arange(slots, dtype=np.uint64), np.arange(steps, dtype=np.uint64), indexing="ij")
    return (mix64(i * np.uint64(0x51_7C_C1_B7_27_22_0A_95) + a * np.uint64(0x2545F4914F6CDD1D) + np.uint64(7)) % np.uint64(slots)).astype(np.int64)


_WALKS = _walks(SLOTS)


def signature(shingles: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """One-permutation signature with optimal densification."""
    sig = np.full(slots, _EMPTY)
    h = mix64(shingles ^ np.uint64(0xA5A5A5A5DEADBEEF))
    slot = ((h >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(sig, slot, h)
    empty = np.flatnonzero(sig == _EMPTY)
    if len(empty) and len(shingles):
        full = sig != _EMPTY
        asks = full[_WALKS[empty]]
        first = asks.argmax(axis=1)
        got = _WALKS[empty, first]
        for row in np.flatnonzero(~asks.any(axis=1)):  # vanishingly rare: take the next full bin
            got[row] = np.flatnonzero(np.roll(full, -empty[row]))[0] + empty[row]
        sig[empty] = mix64(sig[got % slots] + first.astype(np.uint64) + np.uint64(1))
    return sig


def bands(sig: np.ndarray) -> np.ndarray:
    """A bucket hash for each band."""
    rows = sig.reshape(BANDS, ROWS)
    acc = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        acc = mix64(acc ^ rows[:, j])
    return acc.view(np.int64)


def _profile(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in frames:
        n, keys, buckets = [], [], []
        for t in b.column(1).to_pylist():
            s = shingle_set(t)
            n.append(len(s))
            keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            buckets.append(bands(signature(s)) if len(s) else [])
        yield pa.RecordBatch.from_pydict({
            "doc_id": b.column(0), "n_shingles": pa.array(n, pa.int64()), "key": pa.array(keys, pa.binary()),
            "buckets": pa.array(buckets, pa.list_(pa.int64())),
        })


def _sets(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in frames:
        ids, out = [], []
        for i, text, key in zip(*(b.column(c).to_pylist() for c in range(3))):
            s = shingle_set(text)
            if xxhash.xxh3_128_digest(s.tobytes()) == key:  # not another text under the same id
                ids.append(i)
                out.append(s.view(np.int64))
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "s": pa.array(out, pa.list_(pa.int64()))})


def _pick(df: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """df without most rows whose col isn't among ids, where those are counted and few."""
    few = ids.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    return df.join(F.broadcast(ids), col, "left_semi") if few else df


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    Null and empty texts have no shingles and are their own components; so is a row with a
    null doc_id, which is never linked (its component is null, kept true). Rows that repeat
    a doc_id are judged by their own text. Equal texts are always one component. Empty tables
    give no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    prof = stored(docs.mapInArrow(_profile, "doc_id long, n_shingles long, key binary, buckets array<long>"), "mh-profile")
    known = prof.where("key is not null and doc_id is not null")
    # one row for each distinct set; its smallest document stands for it
    sets = stored(known.groupBy("key").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets")), "mh-sets")
    pos = sets.select("id", "n", F.explode("buckets").alias("k"))
    full = pos.groupBy("k").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("k")
    members = stored(pos.join(full, "k").select("k", "id", "n", F.lit(0).alias("p")), "mh-members")
    wanted = sets.join(members.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("doc_id"), "key")
    texts = docs.join(wanted, "doc_id").select("doc_id", "text", "key")
    shingles = stored(texts.mapInArrow(_sets, "id long, s array<long>"), "mh-shingles")
    release(docs.sparkSession)
    labels = sets.select("id", F.col("id").alias("comp"))
    # first the stars of the buckets, then what buckets with several components leave open
    labels, _, _ = _stars(members, labels, shingles, one_a_set=True)
    labels, open_, _ = _stars(members, labels, shingles)
    if open_ is not None:
        groups, centres = _rare_groups(shingles, open_.select("id", "n").distinct()), 1
        while groups is not None:
            labels, open_, past = _stars(groups, labels, shingles, centres)
            # a past centre has met every other component of its group; a group ends with its last set
            left = None if open_ is None else stored(open_.select(groups.columns).join(past, ["k", "id"], "left_anti"), "mh-groups")
            forget(groups, open_)
            groups, centres = left, centres * 4
    forget(members, shingles)
    named = sets.select("key", "id").join(labels, "id").select("key", "comp")
    out = prof.select("doc_id", "n_shingles", "key").join(named, "key", "left")
    comp = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(True)).alias("kept"))


def _stars(members: DataFrame, labels: DataFrame, shingles: DataFrame, centres: int = 1, one_a_set: bool = False) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """One round: in each group k of members (k, id, n, p) that holds several components, compare up to
    `centres` sets (one for each salt that occurs) with the sets outside their component. n is a set's size and p the place of k among its
    shingles, 0 for buckets: what lies before the first shared one is not shared. Returns the new labels (id, comp),
    the members of such groups and their centres (k, id); None for both if there are no such groups."""
    here = members.join(labels, "id")
    spread = here.groupBy("k").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("w")).where("c0 <> c1").select("k", "w")
    most = hot_from(members.count())
    spread = stored(spread, "mh-spread")
    if not spread.limit(1).count():
        return labels, None, None
    open_ = stored(dealt(here, spread, ["k"], "w", most, ("id",)), "mh-open")
    salt = F.pmod(F.xxhash64("id", F.lit(centres)), F.lit(centres))
    centre = open_.groupBy("k", "w", salt.alias("salt")).agg(F.min(F.struct("id", "comp", "n", "p")).alias("c"))
    centre = centre.select("k", "w", F.col("c.id").alias("a"), F.col("c.comp").alias("ca"), F.col("c.n").alias("na"), F.col("c.p").alias("pa"))
    shared = F.least(F.col("n") - F.col("p"), F.col("na") - F.col("pa"))  # at most
    # a large group is dealt over several tasks, each of which gets its centres
    parts = F.ceil(F.col("w") / most).cast("int")
    mine = open_.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).drop("w")
    theirs = centre.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("w")
    pairs = (
        mine.join(theirs, ["k", "part"])
        .where((F.col("comp") != F.col("ca")) & (shared * (DEN + NUM) >= (F.col("n") + F.col("na")) * NUM))
        .select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"), F.least("ca", "comp").alias("ca"), F.greatest("ca", "comp").alias("cb"))
    )
    # the first round needs one centre a set, not one for each of its bands
    pairs = pairs.groupBy("b").agg(F.min(F.struct("a", "ca", "cb")).alias("p")).select("p.a", "b", "p.ca", "p.cb") if one_a_set else pairs.distinct()
    pairs = stored(pairs, "mh-pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    some = _pick(shingles, ids, "id")
    inter = F.size(F.array_intersect("sa", "sb"))
    links = (
        pairs.join(some.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
        .join(some.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
        .where(inter * DEN >= (F.size("sa") + F.size("sb") - inter) * NUM)
        .select(F.col("ca").alias("src"), F.col("cb").alias("dst"))
    )
    links = stored(links.distinct(), "mh-links")
    if links.limit(1).count():
        moved = connected_components(links).toDF("comp", "top")
        labels = stored(labels.join(moved, "comp", "left").select("id", F.coalesce("top", "comp").alias("comp")), "mh-labels")
    forget(pairs, links, spread)
    release(members.sparkSession)
    return labels, open_, centre.select("k", F.col("a").alias("id"))


def _rare_groups(shingles: DataFrame, ids: DataFrame) -> DataFrame:
    """Groups (k, id, n, p) in which any two linked sets of ids meet, by prefix filtering: with
    shingles ordered by frequency, linked sets share one of their first n - ceil(0.75 n) + 1.
    A passage that many sets hold comes last, and so groups none that it does not dominate."""
    mine = stored(shingles.join(ids, "id").select("id", "n", F.explode("s").alias("k")), "mh-residual")
    often = stored(mine.groupBy("k").agg(F.count("*").alias("df")).where("df > 1"), "mh-often")
    shared = dealt(mine, often, ["k"], "df", hot_from(mine.count()), ("id",)).groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "k"))).alias("own"))
    prefix = F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1
    room = (prefix - (F.col("n") - F.size("own"))).cast("int")  # shingles of one set alone come first
    return stored(shared.where(room > 0).select("id", "n", (F.col("n") - F.size("own")).cast("int").alias("first"), F.posexplode(F.slice("own", F.lit(1), room)).alias("at", "o")).select(F.col("o.k").alias("k"), "id", "n", (F.col("first") + F.col("at")).alias("p")), "mh-groups")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of docs for each near-duplicate group, the one with the smallest doc_id, and
    every row without an id; columns unchanged. Different texts under one doc_id are one document, which
    stays or goes as a whole; rows that repeat a doc_id and its text stay once. Other cases as in near_groups()."""
    ids = near_groups(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    kept = docs.join(ids.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)), "doc_id", "left_semi").select(*docs.columns)
    if docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.union(docs.where("doc_id is null"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
