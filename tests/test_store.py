"""Branch semantics: allocation, sessions, random histories against copies, merges, front end."""

import io
import json
import random
from concurrent.futures import ThreadPoolExecutor

import pytest

from ramus.__main__ import main
from ramus.operators import files as FT
from ramus.operators import workspace as W
from ramus.operators.store import BranchStore, DuplicateKeyError, MergeConflictError, ReadOnlyError, StalePreviewError, TableNotRegisteredError
from ramus.plans.allocator import Allocator, IntervalExhausted, reserve_bits
from ramus.plans.catalog import BranchError, Catalog
from ramus.plans.sqlfront import UnsupportedSQLError, parse
from ramus.sources.storage import CommitConflict, JsonVersions
from ramus.streaming.sink import upsert_stream


def spans(c):
    """Intervals of live segments that rows can be written to."""
    heads = [c.segments[x.current] for x in c.branches.values()]
    return sorted((s.lo, s.hi, s.owner) for s in heads)


def test_reserved_bits_shrink_with_depth_and_grow_with_the_domain():
    assert reserve_bits() == (20, 10, 6) and reserve_bits(decimal=True) == (33, 17, 10)  # pinned
    for bits in (1, 7, 48, 63, 200, 5000):
        a, b, c = reserve_bits(bits)
        assert a >= b >= c >= 1 and a * 16 >= 5 * bits and (a - 1) * 16 < 5 * bits
    for bad in ((3, 2), (1, 2, 3), (2, 1, 0)):
        with pytest.raises(ValueError):
            Allocator(bad)


@pytest.mark.parametrize("how", [{}, {"fanout": 1}, {"fanout": 7}, {"fanout": 300}, {"terminal": True}, {"width": 1000}])
def test_forks_nest_and_leave_room(how):
    """Any mix of forks: children lie in what their parent had, apart from each other, and parents keep room."""
    r, a, c = random.Random(repr(how)), Allocator(), Catalog.new()
    for i in range(60):
        source = r.choice(sorted(b.id for b in c.branches.values() if b.kind != "terminal"))
        before = c.head(source)
        try:
            c.fork(f"b{i}", source, a, **how)
        except IntervalExhausted:
            assert before.hi - before.lo < 5_000
            continue
        child, rest = c.head(f"b{i}"), c.head(source)
        assert before.lo < child.lo < child.hi == rest.lo < rest.hi == before.hi and child.hi - child.lo >= 2 and rest.hi - rest.lo >= 2
        assert child.lo <= child.point < child.hi and rest.lo <= rest.point < rest.hi
    line = spans(c)
    assert len(line) > 20 or how.get("width") and all(x[1] <= y[0] for x, y in zip(line, line[1:]))
    assert all(x[1] <= y[0] for x, y in zip(line, line[1:]))


def test_widths_follow_what_is_expected():
    a = Allocator()
    width = lambda depth, **how: a.child_width(10**15, 10**15, depth, 0, **how)
    assert width(5, fanout=1) > 10**15 * 0.99 and width(5, fanout=9) == (10**15 - 1) // 10 and width(5) == (10**15 - 1) // 9
    assert [width(k).bit_length() for k in range(3)] == [(10**15 - 1).bit_length() - x for x in a.reserve]
    assert width(0, terminal=True) == 2 and width(0, fixed=12_345) == 12_345
    kids = [a.child_width(10**15, 10**15, 5, n) for n in range(20)]
    assert kids == sorted(kids, reverse=True) and a.checkpoint_width(10**6, 0) > a.checkpoint_width(10**6, 5) > 2
    for bad in ({"fanout": -1}, {"fixed": 1}):
        with pytest.raises(ValueError):
            width(0, **bad)


def test_terminal_and_errors():
    a, c = Allocator(), Catalog.new()
    c.fork("leaf", "main", a, terminal=True)
    assert c.head("leaf").hi - c.head("leaf").lo == 2
    for wrong in (lambda: c.fork("x", "leaf", a), lambda: c.checkpoint("x", "leaf", a), lambda: c.fork("leaf", "main", a), lambda: c.delete("main"), lambda: c.fork("x", "nowhere", a)):
        with pytest.raises(BranchError):
            wrong()
    small = Catalog.new(40)
    with pytest.raises(IntervalExhausted):
        for i in range(40):
            small.fork(f"b{i}", "main", a, width=2)


def test_checkpoint_forks_are_disjoint():
    a, c = Allocator(), Catalog.new()
    c.checkpoint("cp", "main", a)
    for i in range(5):
        c.fork_checkpoint(f"f{i}", "cp", a)
        if i == 2:
            c.delete("f2")
    segs = sorted((s.lo, s.hi) for s in c.segments.values() if s.owner.startswith("f") and s.kind == "mutable")
    assert all(x[1] <= y[0] for x, y in zip(segs, segs[1:]))
    assert Catalog.from_json(__import__("json").loads(__import__("json").dumps(c.to_json()))).to_json() == c.to_json()


@pytest.fixture
def store(spark):
    s = BranchStore(spark)
    s.register_table("t", spark.createDataFrame([(i, f"n{i}", i * 10) for i in range(20)], "id int, name string, qty int"), ["id"])
    return s


def rows(session, table="t"):
    return sorted(tuple(r) for r in session.table(table).collect())


def test_random_histories_equal_copies(spark, store):
    r, copies = random.Random(11), {"main": {i: (i, f"n{i}", i * 10) for i in range(20)}}
    for step in range(22):
        b = r.choice(sorted(copies))
        op = r.choice(["fork", "upsert", "upsert", "delete", "update", "compact"])
        if op == "fork" and len(copies) < 6:
            store.create_branch(f"b{step}", b)
            copies[f"b{step}"] = dict(copies[b])
        elif op == "upsert":
            new = [(r.randrange(25), f"s{step}", step) for _ in range(3)]
            store.checkout(b).upsert("t", [dict(zip(("id", "name", "qty"), x)) for x in new])
            copies[b] |= {x[0]: x for x in new}
        elif op == "delete":
            k = r.randrange(25)
            store.checkout(b).delete_keys("t", [{"id": k}])
            copies[b].pop(k, None)
        elif op == "update":
            store.checkout(b).execute("UPDATE t SET qty = qty + 1 WHERE id % 3 = 1")
            copies[b] = {k: (i, n, q + 1) if k % 3 == 1 else (i, n, q) for k, (i, n, q) in copies[b].items()}
        elif op == "compact":
            store.compact("t")
    for b, want in copies.items():
        assert rows(store.checkout(b)) == sorted(want.values()), b
    reopened = BranchStore(spark, store.root)
    assert rows(reopened.checkout("main")) == sorted(copies["main"].values())


def test_insert_rules(store):
    m = store.checkout()
    with pytest.raises(DuplicateKeyError):
        m.execute("INSERT INTO t (id, name) VALUES (3, 'x')")
    with pytest.raises(DuplicateKeyError):
        m.insert("t", [{"id": 50}, {"id": 50}])
    assert m.execute("INSERT INTO t VALUES (3, 'x', 1), (30, 'y', 2) ON CONFLICT DO NOTHING") == 1
    with pytest.raises(TableNotRegisteredError):
        m.table("nope")
    with pytest.raises(UnsupportedSQLError):
        m.execute("UPDATE t SET id = 1")


def test_transactions_and_checkpoints(store):
    m = store.checkout()
    store.create_checkpoint("cp")
    with pytest.raises(ZeroDivisionError), m.transaction():
        m.execute("DELETE FROM t")
        assert rows(m) == []
        raise ZeroDivisionError
    assert len(rows(m)) == 20
    for sql in ("DELETE FROM t", "DROP TABLE t", "ALTER TABLE t DROP COLUMN qty", "CREATE TABLE u (id INT PRIMARY KEY)"):
        with pytest.raises(ReadOnlyError):
            store.checkout_checkpoint("cp").execute(sql)


def test_two_writers(spark, store):
    other = BranchStore(spark, store.root)
    store.create_branch("a")
    other.create_branch("b")  # publishes over the newer catalog
    store.refresh()
    assert {"a", "b"} <= set(store.catalog.branches)
    with pytest.raises(CommitConflict):
        store.log.publish(store.at, {})


def test_versions_are_created_once(spark, tmp_path):
    for scheme in ("file", "hdfs"):  # by a link; by a rename that refuses an existing target
        log = JsonVersions(spark, str(tmp_path / scheme))
        log.scheme = scheme
        assert log.latest() == -1
        log.publish(0, {"a": 1})
        with pytest.raises(CommitConflict):
            log.publish(0, {"a": 2})
        assert (log.latest(), log.read(0)) == (0, {"a": 1}) and [x.name for x in (tmp_path / scheme).iterdir() if not x.name.startswith(".")] == ["000000000.json"]
    log.scheme = "s3a"  # a store that can't promise to put a name once is refused
    with pytest.raises(Exception, match="conditional"):
        log.publish(1, {})


def in_threads(jobs):
    """Run jobs at once; their results, or what they raised."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        futures = [pool.submit(j) for j in jobs]
        return [f.exception() or f.result() for f in futures]


def test_concurrent_writers_lose_nothing(spark, store):
    def add(i):
        mine = BranchStore(spark, store.root)
        mine.create_branch(f"w{i}")
        for _ in range(2):
            mine.checkout().execute("UPDATE t SET qty = qty + 1 WHERE id = 0")
        mine.checkout(f"w{i}").execute(f"UPDATE t SET name = 'w{i}' WHERE id = 1")
        return "done"

    assert in_threads([lambda i=i: add(i) for i in range(4)]) == ["done"] * 4
    store.refresh()
    assert rows(store.checkout())[0] == (0, "n0", 8) and all(rows(store.checkout(f"w{i}"))[1][1] == f"w{i}" for i in range(4))
    known = {c.path for c in store.catalog.commits}
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{store.root}/data/t/v1")
    assert {x.getPath().getName() for x in store.log.fs.listStatus(folder)} == {k.rsplit("/", 1)[-1] for k in known}  # no orphans


def test_concurrent_shapes(spark, store):
    """Shapes of a branch changed at once: each change is made on what the others left."""
    add = lambda i: BranchStore(spark, store.root).checkout().execute(f"ALTER TABLE t ADD COLUMN c{i} INT DEFAULT {i}")
    assert in_threads([lambda i=i: add(i) for i in range(3)]) == [20] * 3
    store.refresh()
    row = store.checkout().table("t").where("id = 7").first().asDict()
    assert row == {"id": 7, "name": "n7", "qty": 70, "c0": 0, "c1": 1, "c2": 2}


def test_founding_and_registering_at_once(spark, store):
    root = store.root + "-new"
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    got = in_threads([lambda: BranchStore(spark, root).register_table("u", df, ["id"]) for _ in range(3)])
    assert sorted(type(x).__name__ for x in got) == ["BranchError", "BranchError", "NoneType"]
    assert rows(BranchStore(spark, root).checkout(), "u") == [(1, "a")]


def test_merge_sees_a_write_in_between(spark, store, monkeypatch):
    """Another store writes after the merge's check of the heads and before its publication."""
    store.create_branch("b")
    store.checkout("b").execute("UPDATE t SET qty = 1 WHERE id = 3")
    original, sly = BranchStore.publish, []

    def between(self, change):
        if not sly:
            sly.append(1)
            BranchStore(spark, store.root).checkout().execute("UPDATE t SET qty = 2 WHERE id = 3")
        return original(self, change)

    monkeypatch.setattr(BranchStore, "publish", between)
    with pytest.raises(MergeConflictError):
        store.merge("b", "main")
    sly.clear()
    preview = store.merge_preview("b", "main")
    with pytest.raises(StalePreviewError):
        store.merge("b", "main", "source_wins", preview=preview)
    assert dict((r[0], r[2]) for r in rows(store.checkout()))[3] == 2
    assert store.merge("b", "main", "source_wins") == {"t": 1}


def test_transactions_of_several_statements(spark, store):
    store.create_branch("b")
    m, other = store.checkout(), BranchStore(spark, store.root)
    with m.transaction(), m.transaction():  # another branch's write is no conflict
        m.execute("UPDATE t SET qty = 5 WHERE id = 1")
        other.checkout("b").execute("DELETE FROM t WHERE id = 2")
        m.execute("DELETE FROM t WHERE id = 3")
    assert [r[0] for r in rows(m)[:4]] == [0, 1, 2, 4] and [r[0] for r in rows(store.checkout("b"))[:3]] == [0, 1, 3]
    with pytest.raises(CommitConflict), m.transaction():  # one to this branch is
        m.execute("UPDATE t SET qty = qty + 1 WHERE id = 1")
        other.checkout().execute("UPDATE t SET qty = qty * 10 WHERE id = 1")
    store.refresh()
    assert rows(m)[1] == (1, "n1", 50)


def test_adopted_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(i, i % 2) for i in range(10)], "id int, v int").write.parquet(path)
    store = BranchStore(spark)
    store.adopt("t", path, ["id"])
    with pytest.raises(DuplicateKeyError):
        store.adopt("u", path, ["v"])
    store.create_branch("b")
    b = store.checkout("b")
    b.execute("DELETE FROM t WHERE v = 1")
    assert len(rows(b)) == 5 and len(rows(store.checkout())) == 10 and store.diff("main", "b", "t").count() == 5
    store.compact("t")
    store.vacuum()
    assert len(rows(b)) == 5 and len(rows(store.checkout())) == 10 and spark.read.parquet(path).count() == 10


def test_replayed_batches_change_nothing(spark, store, tmp_path):
    schema = "id int, name string, qty int"
    spark.createDataFrame([(1, "stream", 1), (40, "stream", 2)], schema).write.parquet(str(tmp_path / "in"))
    run = lambda: upsert_stream(store, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "main", "t", str(tmp_path / "cp"))
    run().trigger(availableNow=True).start().awaitTermination()
    assert rows(store.checkout())[1] == (1, "stream", 1) and store.catalog.streams
    store.checkout().execute("UPDATE t SET name = 'later' WHERE id = 1")
    for f in (tmp_path / "cp" / "commits").iterdir():  # as if the driver had died before the commit was noted
        f.unlink()
    run().trigger(availableNow=True).start().awaitTermination()
    assert rows(store.checkout())[1] == (1, "later", 1) and len(rows(store.checkout())) == 21


def test_workspaces(spark, tmp_path):
    w = W.Workspace.together(spark, str(tmp_path / "w"), ["a", "b"])
    for s in w.stores.values():
        s.register_table("t", spark.createDataFrame([(1, 1), (2, 2)], "id int, v int"), ["id"])
    w.create_branch("dev")
    w.create_checkpoint("cp")
    dev, main = w.checkout("dev"), w.checkout()
    for s in dev.values():
        s.execute("UPDATE t SET v = 9 WHERE id = 1")
    main["b"].execute("UPDATE t SET v = 8 WHERE id = 1")
    assert {(r.store, r.change) for r in w.diff("main", "dev").collect()} == {("a", "modified"), ("b", "modified")}
    with pytest.raises(MergeConflictError):
        w.merge_atomic("dev", "main")
    assert rows(main["a"])[0] == (1, 1)  # not merged, as b's side conflicts
    token = w.preview("dev", "main")[1]
    main["b"].execute("UPDATE t SET v = 7 WHERE id = 1")
    with pytest.raises(StalePreviewError):
        w.merge_atomic("dev", "main", "source_wins", token)
    assert w.merge_atomic("dev", "main", "source_wins", w.preview("dev", "main")[1]) == {"a": {"t": 1}, "b": {"t": 1}}
    assert rows(main["a"])[0] == rows(main["b"])[0] == (1, 9)
    again = W.Workspace.together(spark, str(tmp_path / "w"), ["a", "b"])
    assert rows(again.checkout()["b"])[0] == (1, 9)
    again.delete_branch("dev")
    with pytest.raises(BranchError):
        W.Workspace({"x": BranchStore(spark)}).merge_atomic("dev", "main")


def test_bundles_and_dependencies(spark, store):
    df = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    groups = W.dependency_groups(
        df([("d1",), ("d2",)], "document_id string"), df([("c1", "d1"), ("c2", "d2")], "chunk_id string, document_id string"), df([("p1", "c1")], "point_id string, chunk_id string"),
        df([("documents", "d1", "x1"), ("chunks", "c1", "x2"), ("points", "p1", "x3"), ("chunks", "c2", "x4")], "table string, id string, change_id string"),
    )
    assert {(r.bundle, r.change_id) for r in groups.collect()} == {("d1", "x1"), ("d1", "x2"), ("d1", "x3"), ("d2", "x4")}
    changes = groups.select("change_id")
    W.check_bundles(changes, groups, df([("x4",)], "change_id string"))
    with pytest.raises(W.IncompleteBundleError):
        W.check_bundles(changes, groups, df([("x1",), ("x2",)], "change_id string"))


def test_metadata_indexes_and_plans(store):
    store.create_branch("b", metadata={"team": "x"})
    store.update_branch_metadata("b", {"team": "y", "n": 1})
    assert [r.branch for r in store.list_branches(team="y").collect()] == ["b"] and store.list_branches(team="x").count() == 0
    store.create_checkpoint("cp", metadata={"k": 1})
    assert [r.checkpoint for r in store.list_checkpoints(k=1).collect()] == ["cp"]
    m = store.checkout()
    m.execute("CREATE INDEX by_name ON t (name, qty)")
    assert [tuple(r) for r in m.list_indexes("t").collect()] == [("by_name", ["name", "qty"])]
    with pytest.raises(BranchError):
        m.execute("CREATE INDEX odd ON t (nothing)")
    m.spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = m.explain("SELECT qty FROM t WHERE id = 3")
    assert "EqualTo(id,3)" in plan.split("PushedFilters")[1] and "name" not in plan.split("ReadSchema")[1]
    store.checkout("b").execute("DELETE FROM t WHERE id = 4")
    assert {(r.table, r.change) for r in store.diff_all("main", "b").collect()} == {("t", "deleted")}
    assert store.merge("b", "main", tables=["t"]) == {"t": 1}


def test_numbered_parameters_and_many_queries(store):
    m = store.checkout()
    assert [r.id for r in m.query("SELECT id FROM t WHERE id = $2 OR name = $1 AND '$9' = '$9' ORDER BY id", ["n7", 3]).collect()] == [3, 7]
    with pytest.raises(UnsupportedSQLError):
        m.query("SELECT $3", [1])
    got = m.query_many(["SELECT id FROM t WHERE id < :n", "SELECT count(*) AS c FROM t"], {"n": 2}).collect()
    assert sorted(map(tuple, got)) == [(0, '{"id":0}'), (0, '{"id":1}'), (1, '{"c":20}')]
    assert m.query_many([]).count() == 0
    assert m.execute("UPDATE t SET qty = CAST(-qty % 7 AS INT), name = CAST(current_date() AS STRING) WHERE id = 5") == 1
    assert rows(m)[5][2] == -(50 % 7)


def test_merge_policies(store):
    store.create_branch("s")
    store.checkout("s").execute("UPDATE t SET qty = 1 WHERE id < 4")
    store.checkout().execute("UPDATE t SET qty = 2 WHERE id IN (3, 4)")
    with pytest.raises(MergeConflictError):
        store.merge("s", "main")
    p = store.merge_preview("s", "main")
    assert (p.changes().count(), p.conflicts().count()) == (3, 1)
    with pytest.raises(MergeConflictError):
        store.merge("s", "main", "manual_review", preview=p)
    with pytest.raises(RuntimeError, match="no"):
        store.merge("s", "main", "source_wins", validators=[lambda _: (_ for _ in ()).throw(RuntimeError("no"))])
    token = p.token()
    store.checkout().execute("UPDATE t SET qty = 9 WHERE id = 0")
    with pytest.raises(StalePreviewError):
        store.merge("s", "main", "source_wins", preview=p)
    with pytest.raises(StalePreviewError):
        W.merge_atomic(store, "s", "main", token)
    assert store.merge("s", "main", "custom", resolver=lambda q: q.conflicts().selectExpr("conflict_id", "'source' AS choice"))["t"] == 4
    assert [r[2] for r in rows(store.checkout())[:5]] == [1, 1, 1, 1, 2]


def test_double_delete_conflicts_and_second_merge(store):
    store.create_branch("s")
    for b in ("s", "main"):
        store.checkout(b).execute("DELETE FROM t WHERE id = 1")
    store.checkout("s").execute("UPDATE t SET qty = 5 WHERE id = 2")
    c = store.merge_preview("s", "main").conflicts().collect()
    assert [(r.change, r.before, r.after) for r in c] == [("modified", None, None)]
    store.merge("s", "main", "target_wins")
    assert store.merge_preview("s", "main").conflicts().count() == 2  # what was merged now differs from the base on both sides


def test_schema_branches(store):
    store.create_branch("s")
    s = store.checkout("s")
    s.execute("ALTER TABLE t ADD COLUMN tag TEXT DEFAULT 'z'")
    s.execute("INSERT INTO t (id) VALUES (99)")
    assert s.query("SELECT tag FROM t WHERE id = 99").first().tag == "z" and "tag" not in store.checkout().table("t").columns
    with pytest.raises(BranchError):
        s.execute("ALTER TABLE t DROP COLUMN id")
    s.execute("DROP TABLE t")
    with pytest.raises(TableNotRegisteredError):
        s.table("t")
    s.execute("CREATE TABLE t (id INT PRIMARY KEY, v TEXT)")
    assert rows(s) == [] and len(rows(store.checkout())) == 20


def test_columns_come_and_go_without_a_copy(spark, store, tmp_path):
    spark.range(6).selectExpr("id", "id * 2 AS a").write.parquet(f"{tmp_path}/x")
    store.adopt("x", f"{tmp_path}/x", ["id"])
    for t, old in (("t", "qty"), ("x", "a")):
        files = {c.path for c in store.catalog.commits}
        m = store.checkout()
        m.execute(f"ALTER TABLE {t} ADD COLUMN tag TEXT DEFAULT 'it''s'")
        m.execute(f"ALTER TABLE {t} DROP COLUMN {old}")
        m.execute(f"ALTER TABLE {t} ADD COLUMN {old} TEXT")  # another column of that name, with no value yet
        assert {c.path for c in store.catalog.commits} == files
        got = m.table(t)
        assert dict(got.dtypes)[old] == "string" and {(r.tag, r[old]) for r in got.collect()} == {("it's", None)}
    rolled = store.checkout()
    rolled.execute("ALTER TABLE x ADD COLUMN r DOUBLE DEFAULT rand()")  # differs by row: copied
    assert rolled.query("SELECT r FROM x").distinct().count() == 6


def test_random_shapes_equal_copies(spark, store):
    r, copies = random.Random(5), {"main": {i: {"id": i, "name": f"n{i}", "qty": i * 10} for i in range(20)}}
    ops = ["fork", "upsert", "upsert", "delete", "update", "add", "drop", "compact", "vacuum", "delete branch"]
    for step in range(48):
        b = r.choice(sorted(copies))
        s, mine, op = store.checkout(b), copies[b], r.choice(ops)
        cols = s.table("t").columns
        if op == "fork" and len(copies) < 6:
            store.create_branch(f"b{step}", b)
            copies[f"b{step}"] = {k: dict(x) for k, x in mine.items()}
        elif op == "upsert":
            new = [{"id": r.randrange(25), **{c: (f"s{step}" if c == "name" else step) for c in cols if c != "id"}} for _ in range(3)]
            s.upsert("t", new)
            mine |= {x["id"]: x for x in new}
        elif op == "delete":
            k = r.randrange(25)
            s.delete_keys("t", [{"id": k}])
            mine.pop(k, None)
        elif op == "update" and "qty" in cols:
            s.execute("UPDATE t SET qty = coalesce(qty, 0) + 1 WHERE id % 3 = 1")
            copies[b] = {k: x | {"qty": (x["qty"] or 0) + 1} if k % 3 == 1 else x for k, x in mine.items()}
        elif op == "add":
            c = r.choice([c for c in ("qty", "e1", "e2") if c not in cols] or [None])
            if c:
                default = r.choice([None, step])
                s.add_column("t", c, "int", None if default is None else str(default))
                copies[b] = {k: x | {c: default} for k, x in mine.items()}
        elif op == "drop":
            c = r.choice([c for c in cols if c not in ("id", "name")] or [None])
            if c:
                s.drop_column("t", c)
                copies[b] = {k: {n: y for n, y in x.items() if n != c} for k, x in mine.items()}
        elif op == "compact":
            store.compact("t")
        elif op == "vacuum":
            store.vacuum()
        elif op == "delete branch" and b != "main" and r.random() < 0.4:
            for gone in store.delete_branch(b):
                copies.pop(gone)
    assert any(c.shared for c in store.catalog.commits)
    reopened = BranchStore(spark, store.root)
    for at in (store, reopened):
        for b, want in copies.items():
            assert sorted((x.asDict() for x in at.checkout(b).table("t").collect()), key=lambda x: x["id"]) == [want[k] for k in sorted(want)], b


def test_merges_over_a_shared_shape(store):
    store.create_branch("p")
    p = store.checkout("p")
    p.execute("UPDATE t SET qty = 1 WHERE id = 1")
    p.execute("ALTER TABLE t ADD COLUMN tag INT DEFAULT 3")
    store.create_branch("q", "p")
    store.checkout("q").execute("UPDATE t SET tag = 4 WHERE id = 2")
    p.execute("UPDATE t SET tag = 5 WHERE id = 3")
    assert {x.key for x in store.diff("p", "q", "t").collect()} == {'{"id":2}', '{"id":3}'}
    assert store.merge("q", "p") == {"t": 1}
    got = {x.id: (x.qty, x.tag) for x in p.table("t").collect()}
    assert [got[k] for k in range(4)] == [(0, 3), (1, 3), (20, 4), (30, 5)]
    assert "tag" not in store.checkout().table("t").columns and len(rows(store.checkout())) == 20


def test_command_line(spark, tmp_path, capsys):
    spark.range(4).selectExpr("id", "id * 2 AS v").write.parquet(f"{tmp_path}/x")

    def call(*argv):
        out = io.StringIO()
        return main([f"{tmp_path}/store", *argv], out), [json.loads(x) for x in out.getvalue().splitlines()]

    assert call("adopt", "x", f"{tmp_path}/x", "--key", "id") == (0, [{"table": "x"}])
    assert call("tables") == (0, [{"tables": ["x"]}])
    assert call("fork", "dev") == (0, [{"branch": "dev", "parent": "main"}])
    assert call("checkpoint", "c") == (0, [{"checkpoint": "c", "branch": "main"}])
    assert call("sql", "UPDATE x SET v = 9 WHERE id = 1", "--branch", "dev") == (0, [{"rows": 1}])
    assert call("diff", "main", "dev")[1] == call("diff", "main", "dev", "--table", "x")[1] != []
    assert [(r["outcome"], r["key"]) for r in call("preview", "dev", "main")[1]] == [("clean", '{"id":1}')]
    assert call("merge", "dev", "main") == (0, [{"applied": {"x": 1}}])
    assert call("sql", "SELECT v FROM x WHERE id = 1") == (0, [{"v": 9}])
    assert call("sql", "SELECT v FROM x WHERE id = 1", "--checkpoint", "c") == (0, [{"v": 2}])
    assert call("fork", "old", "--checkpoint", "c") == (0, [{"branch": "old", "parent": "main"}])
    assert {r["branch"] for r in call("branches")[1]} == {"main", "dev", "old"} and [r["checkpoint"] for r in call("checkpoints")[1]] == ["c"]
    assert call("compact", "x") == (0, [{"compacted": "x"}]) and call("delete", "dev") == (0, [{"deleted": ["dev"]}])
    assert call("vacuum") == (0, [{"deleted": 2}])
    assert call("delete", "main") == (1, []) and "main can't be deleted" in capsys.readouterr().err


def test_vacuum_spares_writers_and_pinned_readers(spark, store):
    other = BranchStore(spark, store.root)
    m = store.checkout()
    with m.transaction():
        m.execute("UPDATE t SET qty = 1 WHERE id = 1")
        assert other.vacuum() == 0  # written, not yet published
    assert m.query("SELECT qty FROM t WHERE id = 1").first().qty == 1
    with m.pinned() as fixed:
        before = fixed.table("t")
        other.compact("t")
        other.checkout().execute("DELETE FROM t")
        assert other.vacuum() == 0
        assert before.count() == fixed.table("t").count() == 20
        with pytest.raises(ReadOnlyError):
            fixed.execute("DELETE FROM t")
    assert other.vacuum() == 2 and other.vacuum() == 0  # the first load and the update
    store.refresh()
    assert rows(store.checkout()) == []


@pytest.mark.parametrize("sql", ["WITH a AS (SELECT 1) DELETE FROM t", "DELETE FROM t RETURNING id", "UPDATE t SET qty = 1 FROM u", "INSERT INTO t SELECT 1", "INSERT INTO t VALUES (1) ON CONFLICT (id) DO UPDATE SET qty = 1", "MERGE INTO t"])
def test_rejected(sql):
    with pytest.raises(UnsupportedSQLError):
        parse(sql)


def test_byte_ranges(spark):
    data = bytes(range(256)) * 40
    i, d, b = FT.from_contents(spark.createDataFrame([("a/b.bin", bytearray(data)), ("a/empty", bytearray(b""))], "path string, data binary"))
    node = d.where("name = 'b.bin'").first().inode_id
    assert bytes(FT.read_range(b, node, 4000, 300).first().data) == data[4000:4300]
    new = FT.overlay_merge(b, FT.write_range(b, node, 4090, b"hello world"), ["inode_id", "byte_start"])
    want = data[:4090] + b"hello world" + data[4101:]
    assert bytes(FT.read_range(new, node, 0, 20_000).first().data) == want
    assert {r.path for r in FT.paths(i, d).collect()} == {"a", "a/b.bin", "a/empty"}


def test_deep_file_trees_are_not_cut(spark):
    files = spark.createDataFrame([("a/b/c/d", bytearray(b"x"))], "path string, data binary")
    inodes, dirents, _ = FT.from_contents(files)
    assert {r.path for r in FT.paths(inodes, dirents, 3).collect()} == {"a", "a/b", "a/b/c", "a/b/c/d"}
    with pytest.raises(ValueError):
        FT.paths(inodes, dirents, 2)


def test_file_operations(spark):
    f = FT.FileTree.create(BranchStore(spark))
    f.mkdir("a")
    f.mkdir("a/b")
    f.write("a/b/x.txt", b"hello world" * 900)
    f.write("a/b/x.txt", b"HELLO", 4_094)
    want = bytearray(b"hello world" * 900)
    want[4_094:4_099] = b"HELLO"
    assert f.read("a/b/x.txt") == bytes(want) and f.read("a/b/x.txt", 4_090, 20) == bytes(want[4_090:4_110])
    f.truncate("a/b/x.txt", 5_000)
    f.truncate("a/b/x.txt", 12_000)
    assert f.read("a/b/x.txt") == bytes(want[:5_000]) + b"\0" * 7_000 and f.stat("a/b/x.txt")["size"] == 12_000
    f.write("a/b/x.txt", b"end", 11_997)
    assert f.read("a/b/x.txt") == bytes(want[:5_000]) + b"\0" * 6_997 + b"end"
    f.symlink("b/x.txt", "a/link")
    f.chmod("a/b/x.txt", 0o600)
    assert f.readlink("a/link") == "b/x.txt" and f.stat("a/b/x.txt")["mode"] == 0o600
    f.rename("a/b", "c")
    assert [tuple(r) for r in f.listdir().collect()] == [("a", "dir", 0), ("c", "dir", 0)] and f.exists("c/x.txt") and not f.exists("a/b")
    f.write("d.txt", b"d")
    f.rename("d.txt", "c/x.txt")
    assert f.read("c/x.txt") == b"d"
    for wrong, error in (
        (lambda: f.rename("c", "c/deeper"), OSError), (lambda: f.rmdir("c"), OSError), (lambda: f.unlink("c"), IsADirectoryError), (lambda: f.mkdir("c"), FileExistsError),
        (lambda: f.read("nowhere"), FileNotFoundError), (lambda: f.mkdir("x/y"), FileNotFoundError), (lambda: f.listdir("c/x.txt"), NotADirectoryError), (lambda: f.truncate("c/x.txt", -1), ValueError),
    ):
        with pytest.raises(error):
            wrong()
    f.unlink("c/x.txt")
    f.rmdir("c")
    assert [r.name for r in f.listdir().collect()] == ["a"] and f.session.table("blocks").count() == 0


def test_block_merges_show_text(spark):
    store = BranchStore(spark)
    f = FT.FileTree.create(store)
    f.write("a.txt", b"one\ntwo\nthree\n")
    f.write("b.bin", b"\0\1")
    store.create_branch("b")
    g = FT.FileTree(store.checkout("b"))
    g.write("a.txt", b"one\nTWO\nthree\n")
    g.write("b.bin", b"\0\2")
    f.write("b.bin", b"\0\3")
    got = {r.path: r for r in FT.block_merge_preview(store, "b", "main").collect()}
    assert (got["a.txt"].outcome, got["a.txt"].before, got["a.txt"].after) == ("clean", "one\ntwo\nthree\n", "one\nTWO\nthree\n")
    assert "-two\n+TWO" in got["a.txt"].text_diff
    assert (got["b.bin"].outcome, got["b.bin"].after, got["b.bin"].text_diff) == ("conflict", None, None)
