"""Readers, layouts and retrieval pieces beside small plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from ramus.operators import files as FT
from ramus.operators import layouts as L
from ramus.operators import retrieval as R
from ramus.sources import readers


def test_readers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for kind in ("parquet", "orc", "json"):
        df.write.format(kind).save(str(tmp_path / f"t.{kind}"))
        assert sorted(r.v for r in readers.read_url(spark, str(tmp_path / f"t.{kind}")).collect()) == ["a", "b"]
    (tmp_path / "t.tsv").write_text("k\tv\n1\ta,b\n")
    assert [tuple(r) for r in readers.read_url(spark, str(tmp_path / "t.tsv")).collect()] == [("1", "a,b")]
    with pytest.raises(ValueError):
        readers.read_url(spark, "x.unknown")
    (tmp_path / "q.jsonl").write_text('{"question_id":"q1","question":"why","expected_doc_ids":["d"],"extra":1}\n{"question_id":"q2"}\n')
    assert [r.expected_doc_ids for r in readers.read_questions(spark, str(tmp_path / "q.jsonl"), 1).collect()] == [["d"]]


def test_folders(spark, tmp_path):
    root = tmp_path / "in"
    (root / "x" / "y").mkdir(parents=True)
    (root / "a.txt").write_text("plain\ntext")
    (root / "x" / "y" / "b.json").write_text('{"b": "2", "a": "one"}')
    objects = {r.object_key: r for r in readers.read_objects(spark, str(root), "bucket").collect()}
    assert set(objects) == {"a.txt", "x/y/b.json"} and objects["a.txt"].size == 10 and objects["a.txt"].bucket == "bucket"
    texts = {r.path.rsplit("/", 1)[-1]: r.text for r in readers.read_corpus(spark, str(root)).collect()}
    assert texts == {"a.txt": "plain\ntext", "b.json": "a: one\nb: 2"}
    inodes, dirents, blocks = FT.import_tree(spark, str(root), 4)
    found = {r.path: (r.kind, r.size) for r in FT.manifest(inodes, dirents, blocks).collect()}
    assert found == {"a.txt": ("file", 10), "x": ("dir", 0), "x/y": ("dir", 0), "x/y/b.json": ("file", 22)} and blocks.count() == 3 + 6


def test_record_lists(spark):
    data = spark.createDataFrame([(i * 40_000, i, f"v{i}") for i in range(9)], "rid long, id int, v string")
    index = L.rlist_index(data.select("rid"), 1)
    assert index.count() > 1  # lists are parted
    changed, gone = spark.createDataFrame([(2, "new"), (50, "more")], "id int, v string"), spark.createDataFrame([(3,)], "id int")
    data2, index2 = L.rlist_commit(data, index, 1, 2, changed, gone, ["id"], 10**7)
    want = {i: f"v{i}" for i in range(9) if i != 3} | {2: "new", 50: "more"}
    assert {r.id: r.v for r in L.rlist_scan(data2, index2, 2).collect()} == want and L.rlist_scan(data2, index2, 1).count() == 9
    delta = [(r.change, r.rid) for r in L.rlist_delta(index2, 1, 2).collect()]
    assert sorted(x for x in delta if x[0] == "removed") == [("removed", 80_000), ("removed", 120_000)] and len(delta) == 4
    own, ids = L.rlist_reshape(data2, index2, 2, lambda df: df.withColumn("w", F.upper("v")).drop("v"))
    assert {r.id: r.w for r in L.rlist_scan(own, ids, 2).collect()} == {k: v.upper() for k, v in want.items()}


def test_version_graphs():
    graph = {2: [1], 3: [1], 4: [2, 3], 5: [3], 6: [4, 5], 7: [], 1: [0]}
    assert [L.rlist_ancestor(graph, *x) for x in ((4, 5), (2, 3), (6, 3), (6, 6), (2, 7), (4, 2))] == [3, 1, 3, 6, None, 2]


def test_overlays_and_supersession(spark):
    path = lambda rows: spark.createDataFrame(rows, "branch string, depth int, cutoff long")
    left, right = path([("dev", 0, 9), ("mid", 1, 7), ("main", 2, 3)]), path([("other", 0, 9), ("mid", 1, 5), ("main", 2, 4)])
    assert [tuple(r) for r in L.overlay_common(left, right).collect()] == [("mid", 5)]
    revisions = spark.createDataFrame([("mid", 4, 1), ("mid", 6, 2), ("mid", 7, 2), ("dev", 6, 3)], "branch string, revision long, id int")
    assert sorted(r.id for r in L.overlay_changed_keys(revisions, "mid", 4, 7, ["id"]).collect()) == [2]
    points = spark.createDataFrame([(1, None), (2, []), (3, ["dev"]), (4, ["gone"])], "id int, overwritten_in array<string>")
    assert sorted(r.id for r in L.not_superseded(points, left).collect()) == [1, 2, 4]


def test_packed_blocks():
    """Every token is kept in order, chunks fit, and blocks are cut only where they must be."""
    r = random.Random(1)
    for _ in range(300):
        room, n = r.randrange(4, 30), iter(range(10**6))
        overlap = r.randrange(room)
        blocks = [[next(n) for _ in range(r.randrange(1, 40))] for _ in range(r.randrange(6))]
        got = list(R.packed(blocks, [-1], room, overlap))
        assert all(0 < len(c) <= room for c in got)
        seen = []
        for c in got:
            seen += [x for x in c if x >= 0 and x not in set(seen[-2 * room :])]
        assert seen == [x for b in blocks for x in b]
        if overlap == 0:
            for b in blocks:
                assert len(b) > room or any(" ".join(map(str, b)) in " ".join(map(str, c)) for c in got)
    assert list(R.packed([[1, 2], [3], [4, 5, 6]], [0], 4, 1)) == [[1, 2, 0, 3], [3, 0, 4, 5], [5, 6]]


def test_packed_chunks(spark):
    import public_tokenizers

    text = "first block here\n\nsecond block\n \n" + "long " * 90 + "\n\nlast"
    df = spark.createDataFrame([(1, text, "H"), (2, None, "H"), (3, "  \n\n ", "H")], "doc_id long, text string, head string")
    rows = R.packed_chunks(df, size=40, overlap=8, header="head").orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(len(rows))) and rows[0].content == "H\n\nfirst block here second block" and rows[-1].content.endswith("last")
    assert all(len(r.content.split()) <= 40 for r in rows) and sum(r.content.split().count("long") for r in rows) >= 90
    byte = R.packed_chunks(df, public_tokenizers.path("byte_bpe_50k.json"), size=64, overlap=8).orderBy("ordinal").collect()
    assert byte[0].content == "first block here\n\nsecond block"
    with pytest.raises(ValueError):
        R.packed_chunks(df, size=8, overlap=8)


def test_search_pieces(spark):
    docs = spark.createDataFrame([(1, "The Cat sat"), (2, "a dog"), (3, None)], "doc_id long, text string")
    assert [r.doc_id for r in docs.where(R.phrase(F.col("text"), "cat SAT")).collect()] == [1]
    assert [r.doc_id for r in R.search(docs, [], 2, "doc_id").collect()] == [1, 2]
    leg = docs.select("doc_id", F.col("doc_id").cast("double").alias("score"))
    assert [r.doc_id for r in R.search(docs, [leg], 2, "doc_id").collect()] == [3, 2]
    assert R.bm25_search(docs, "!!", 5).count() == 0 and [r.doc_id for r in R.bm25_search(docs, "Cat cat dog", 5).collect()] == [2, 1]
    made = []
    cache = spark.createDataFrame([("h1", [1.0])], "content_hash string, embedding array<double>")
    items = spark.createDataFrame([("h1",), ("h2",), ("h2",)], "content_hash string")
    out = R.embedded_once(items, cache, lambda new: made.append(new.count()) or new.withColumn("embedding", F.array(F.lit(2.0))))
    assert made == [1] and sorted(r.content_hash for r in out.collect()) == ["h1", "h2"]


def test_nearest_rank(spark):
    r = random.Random(5)
    data = [(r.choice(["a", "b", None]), r.choice([1, 1, 2, 3, r.random()]) * 1.0) for _ in range(500)] + [("c", 7.0), ("d", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(4)
    for q in (0.0, 0.5, 0.95, 1.0):
        want = {}
        for g in ("a", "b", None, "c"):
            mine = sorted(v for x, v in data if x == g and v is not None)
            want[g] = mine[max(1, -int(-len(mine) * q // 1)) - 1]
        assert {x.g: x.v for x in R.nearest_rank(df, ["g"], "v", q).collect()} == want
