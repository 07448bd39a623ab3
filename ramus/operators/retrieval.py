"""Vector and text retrieval over (versioned) tables, and retrieval metrics.

BM25 uses k = 1.2, b = 0.75 and a fixed mean length of 256; fusion by reciprocal ranks uses 60.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ramus.sources.storage import fresh_root

K, B, MEAN_LENGTH, RRF_K = 1.2, 0.75, 256.0, 60
CANDIDATES, CANDIDATE_FACTOR = 64, 8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def dense_search(points: DataFrame, query: list[float], limit: int, id_col: str = "vec_id", vector: str = "embedding", threshold: float | None = None) -> DataFrame:
    """(id, score): the nearest by cosine; ties by id. A top-k per task, then of those."""
    score = points.select(id_col, cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])).alias("score"))
    if threshold is not None:
        score = score.where(F.col("score") >= threshold)
    return score.where("score is not null").orderBy(F.desc("score"), id_col).limit(limit)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def term_weights(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, term, weight): BM25's saturated term frequencies, without the idf factor."""
    cut = docs.select(id_col, tokens(F.col(text)).alias("_t"))
    tf = cut.select(id_col, F.size("_t").alias("n"), F.explode("_t").alias("term")).groupBy(id_col, "n", "term").agg(F.count("*").alias("tf"))
    return tf.select(id_col, "term", saturated(F.col("tf"), F.col("n")).alias("weight"))


def saturated(tf: Column, n: Column) -> Column:
    return tf * (K + 1) / (tf + K * (1 - B + B * n / MEAN_LENGTH))


def bm25_search(docs: DataFrame, query: str, limit: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of the best documents for the words of a query; ties by id.

    Rows without a query word go before they are cut into words; each text is cut once, and what is left
    of it is a number for each query word. The idf comes from all documents.
    """
    words = sorted(set(w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()))
    if not words:
        return docs.select(id_col, F.lit(0.0).alias("score")).where("false")
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    some = docs.select(id_col, low.alias("_low")).where(reduce(lambda x, y: x | y, [F.contains("_low", F.lit(w)) for w in words]))
    cut = some.select(id_col, F.split("_low", "[^a-z0-9]+").alias("_t"))
    count = lambda w: F.size("_t") - F.size(F.array_remove("_t", w))
    hits = cut.select(id_col, (F.size("_t") - count("")).alias("_n"), *[count(w).alias(f"_f{i}") for i, w in enumerate(words)])
    # both uses read the same exchange, so texts are cut once; a filter on counts would be pushed below it and cut them again
    hits = hits.repartition(F.col(id_col))
    df = hits.agg(*[F.count(F.when(F.col(f"_f{i}") > 0, 1)).alias(f"_d{i}") for i in range(len(words))])
    known = df.crossJoin(docs.agg(F.count("*").alias("_total")))  # one row
    idf = lambda i: F.log(1 + (F.col("_total") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5))
    parts = [saturated(F.col(f"_f{i}"), F.col("_n")) * idf(i) for i in range(len(words))]
    scored = hits.crossJoin(F.broadcast(known)).select(id_col, reduce(lambda x, y: x + y, parts).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), id_col).limit(limit)


def fuse(legs: list[DataFrame], limit: int, id_col: str) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (id, score). Legs are top-k lists, so ranking
    them in one task is bounded by k."""
    out = None
    for leg in legs:
        one = leg.withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), id_col))).select(id_col, (1.0 / (RRF_K + F.col("r"))).alias("part"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(id_col).agg(F.sum("part").alias("score")).orderBy(F.desc("score"), id_col).limit(limit)


def search(docs: DataFrame, legs: list[DataFrame], limit: int, id_col: str) -> DataFrame:
    """(id, score): the legs fused, the only leg as it is, or without a leg the first rows by id, without a score."""
    if not legs:
        return docs.select(id_col, F.lit(None).cast("double").alias("score")).orderBy(id_col).limit(limit)
    return fuse(legs, limit, id_col) if len(legs) > 1 else legs[0].orderBy(F.desc("score"), id_col).limit(limit)


def candidates(limit: int) -> int:
    return max(CANDIDATES, CANDIDATE_FACTOR * limit)


def phrase(text: Column, words: str) -> Column:
    return F.contains(F.lower(text), F.lit(words.lower()))


def per_document(hits: DataFrame, catalog: DataFrame, most: int, limit: int | None = None) -> DataFrame:
    """Hits (chunk_id, score, content_hash) that the catalog (chunk_id, document_id,
    content_hash) still knows with that hash, at most `most` a document, best first. The rank
    is bounded, so Spark cuts each group before the shuffle (WindowGroupLimit)."""
    live = hits.join(catalog, ["chunk_id", "content_hash"])
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("score"), "chunk_id"))
    kept = live.withColumn("r", rank).where(F.col("r") <= most).drop("r")
    return kept.orderBy(F.desc("score"), "chunk_id").limit(limit) if limit else kept


def recall_mrr(hits: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """(questions, recall, mrr) over hits (question_id, document_id, rank) and expected
    (question_id, document_id). Questions without an expected document don't count."""
    docs = hits.groupBy("question_id", "document_id").agg(F.min("rank").alias("rank"))
    ranked = docs.withColumn("r", F.row_number().over(Window.partitionBy("question_id").orderBy("rank", "document_id"))).where(F.col("r") <= k)
    met = expected.distinct().join(ranked, ["question_id", "document_id"], "left")
    per = met.groupBy("question_id").agg((F.count("r") / F.count("*")).alias("recall"), F.coalesce(1.0 / F.min("r"), F.lit(0.0)).alias("rr"))
    return per.agg(F.count("*").alias("questions"), F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"))


def chunks(docs: DataFrame, size: int = 512, overlap: int = 64, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ordinal, content, content_hash): windows of `size` white-space tokens that share
    `overlap`; the last window ends with the text."""
    step = size - overlap
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    base = docs.select(id_col, words.alias("w")).where(F.size("w") > 0)
    n = F.greatest(F.lit(1), F.ceil((F.size("w") - overlap) / step)).cast("int")
    out = base.withColumn("ordinal", F.explode(F.sequence(F.lit(0), n - 1)))
    content = F.array_join(F.slice("w", F.col("ordinal") * step + 1, F.lit(size)), " ")
    return out.select(id_col, "ordinal", content.alias("content")).withColumn("content_hash", F.sha2("content", 256))


def packed(blocks: list[list], between: list, room: int, overlap: int) -> Iterator[list]:
    """Chunks of at most `room` tokens out of a document's blocks. Blocks stay whole, with `between` between
    them, as long as they fit; a chunk that follows a full one begins with its last `overlap` tokens. A block that is too
    long itself is cut into windows that share `overlap`."""
    def windows(tokens: list) -> list[list]:
        step = max(1, room - overlap)
        last = max(0, -(-(len(tokens) - room) // step))
        return [tokens[i * step : i * step + room] for i in range(last + 1)]

    held: list = []
    for block in blocks:
        if len(block) > room:
            yield from [held] * bool(held) + windows(block)
            held = []
            continue
        joined = [*held, *between, *block] if held else block
        if len(joined) > room:
            yield held
            carried = held[-overlap:] if overlap else []
            *full, joined = windows([*carried, *between, *block] if carried else block)
            yield from full
        held = joined
    if held:
        yield held


def packed_chunks(docs: DataFrame, tokenizer: str | None = None, size: int = 512, overlap: int = 64, header: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ordinal, content, content_hash): texts cut at blank lines, and the blocks packed into chunks of
    at most `size` tokens of a tokenizer file (white-space words without one). A header column stands before every
    chunk and takes of its room. Null and blank texts give no chunk."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to less than size")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = None
        if tokenizer:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(tokenizer)
        encode = (lambda t: tok.encode(t, add_special_tokens=False).ids) if tok else str.split
        decode = (lambda ids: tok.decode(ids, skip_special_tokens=False)) if tok else " ".join
        between = encode("\n\n")
        for b in frames:
            ids, ordinals, contents = [], [], []
            for i, t, head in zip(*(b.column(c).to_pylist() for c in range(3))):
                room = max(32, size - len(encode(head))) if head else size
                parts = [encode(x.strip()) for x in re.split(r"\n\s*\n", t or "") if x.strip()]
                bodies = (decode(p).strip() for p in packed(parts, between, room, min(overlap, room - 1)))
                for k, body in enumerate(x for x in bodies if x):
                    ids.append(i)
                    ordinals.append(k)
                    contents.append(f"{head}\n\n{body}" if head else body)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(ordinals, pa.int32()), pa.array(contents, pa.string())], [id_col, "ordinal", "content"])

    rows = docs.select(id_col, F.col(text).cast("string").alias("t"), (F.col(header).cast("string") if header else F.lit(None).cast("string")).alias("h"))
    return rows.mapInArrow(run, f"{id_col} {kind}, ordinal int, content string").withColumn("content_hash", F.sha2("content", 256))


def hash_embedding(docs: DataFrame, dim: int = 64, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, embedding): a signed bag of hashed words with unit length; zeros for no words. Slot and sign come from
    the digits of a word's md5, so other systems can make the same vectors."""
    part = lambda begin, n: F.conv(F.substring(F.md5("term"), begin, n), 16, 10).cast("long")
    cut = docs.select(id_col, F.explode_outer(tokens(F.col(text))).alias("term"))
    tf = cut.groupBy(id_col, "term").agg(F.count("*").alias("n"))
    sign = F.when(F.col("term").isNull(), 0).when(part(9, 1) % 2 == 0, F.col("n")).otherwise(-F.col("n"))
    slot = tf.select(id_col, F.coalesce(part(1, 8) % dim, F.lit(0)).cast("int").alias("slot"), sign.cast("double").alias("x"))
    summed = slot.groupBy(id_col, "slot").agg(F.sum("x").alias("x")).groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("slot", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(F.col("norm") > 0, F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm")).otherwise(0.0))
    return summed.select(id_col, vector.alias("embedding"))


def embedded_once(items: DataFrame, cache: DataFrame, embed, key: str = "content_hash") -> DataFrame:
    """The cache (key, embedding) with entries for all items; only unknown keys are computed."""
    new = items.join(cache.select(key), key, "left_anti").dropDuplicates([key])
    return cache.unionByName(embed(new).select(*cache.columns))


def nearest_rank(df: DataFrame, group: list[str], value: str, q: float) -> DataFrame:
    """(group..., value): the ceil(q n)-th smallest value of each group, nulls left out.

    Rows are range-sorted by group and value, so a large group lies in many partitions; counts of these tell
    which one holds the rank, and only that part is numbered.
    """
    spark = df.sparkSession
    path = fresh_root(spark, "ranks")
    keys = [F.col(c).alias(f"_g{i}") for i, c in enumerate(group)]
    names = [f"_g{i}" for i in range(len(group))]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    line = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v")).repartitionByRange(parts, *names, "_v")
    line.withColumn("_p", F.spark_partition_id()).write.parquet(path)  # where a row lies must not change any more
    line = spark.read.parquet(path)
    held = line.groupBy(*names, "_p").agg(F.count("*").alias("c"))
    in_group = Window.partitionBy(*names)
    upto = F.sum("c").over(in_group.orderBy("_p"))
    spots = held.select(*names, "_p", "c", upto.alias("upto"), F.sum("c").over(in_group).alias("n"))  # a row for each partition and group
    rank = F.greatest(F.lit(1), F.ceil(F.col("n") * q))
    spots = spots.where((rank <= F.col("upto")) & (rank > F.col("upto") - F.col("c"))).select(*[F.col(n).alias(f"_{n}") for n in names], F.col("_p").alias("_at"), (rank - F.col("upto") + F.col("c")).alias("_r"))
    same = reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names], F.col("_p") == F.col("_at"))
    near = line.join(spots, same)
    ranked = near.withColumn("_i", F.row_number().over(Window.partitionBy(*names, "_p").orderBy("_v"))).where("_i = _r")
    return ranked.select(*[F.col(n).alias(c) for n, c in zip(names, group)], F.col("_v").alias(value))


def rollup(runs: DataFrame) -> DataFrame:
    """Benchmark summary of (workflow, backend, operation, ms): medians, then their mean, least
    and greatest over workflows; only operations that every backend ran."""
    n = runs.select(F.countDistinct("backend").alias("all_backends"))
    full = runs.groupBy("operation").agg(F.countDistinct("backend").alias("k")).crossJoin(n).where("k = all_backends").select("operation")
    med = runs.join(full, "operation", "left_semi").groupBy("workflow", "backend", "operation").agg(F.percentile("ms", 0.5).alias("p50"))
    return med.groupBy("backend", "operation").agg(F.avg("p50").alias("mean_p50"), F.min("p50").alias("min_p50"), F.max("p50").alias("max_p50"), F.count("*").alias("workflows"))


def state_digest(df: DataFrame) -> DataFrame:
    """(rows, digest) of a table, independent of row order: row hashes are summed, so no
    group or order is ever gathered."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.select(part.alias("h")).agg(F.count("*").alias("rows"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("digest"))


def state_diff(left: DataFrame, right: DataFrame, key: str, content: Column) -> DataFrame:
    """(key, change) from one state to what another lacks of it: added where only the left has a key, deleted
    where only the right has it, modified where their contents (an expression over either's columns) differ."""
    a, b = left.select(key, content.alias("_a"), F.lit(True).alias("_l")), right.select(key, content.alias("_b"), F.lit(True).alias("_r"))
    change = F.when(F.col("_r").isNull(), "added").when(F.col("_l").isNull(), "deleted").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change is not null")
