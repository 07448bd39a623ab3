"""Registered scenarios over the shared tables, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ramus.operators import files as FT
from ramus.operators import layouts as L
from ramus.operators import retrieval as R
from ramus.operators import scan as S
from ramus.operators import workspace as W
from ramus.operators.store import BranchStore
from ramus.plans import tpch
from ramus.sources.storage import fresh_root, scratch
from ramus.streaming.sink import upsert_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"],
    "orders": ["o_orderkey"], "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"],
}
#: The orders of a branch on which urgent orders cost a tenth less.
DISCOUNTED = "(SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice * 0.9 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders)"
DISCOUNT = "UPDATE orders SET o_totalprice = o_totalprice * 0.9 WHERE o_orderpriority = '1-URGENT'"
BY_PRIORITY = "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 4) AS total FROM {} GROUP BY o_orderpriority"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def store_of(spark: SparkSession, d: str, *names: str) -> BranchStore:
    store = BranchStore(spark)
    for n in names:
        store.adopt(n, f"{d}/{n}.parquet", KEYS[n], verify=False)  # keys are unique in these tables
    return store


def discounted(spark: SparkSession, d: str, *more: str):
    store = store_of(spark, d, "orders", *more)
    store.create_branch("dev")
    dev = store.checkout("dev")
    dev.execute(DISCOUNT)
    return store, dev


def passthrough(name: str, sql: str, *tables: str, free: tuple[str, ...] = (), args: dict | None = None, oracle: str | None = None) -> None:
    """A query over a branch on which orders were discounted; free tables are not versioned."""
    def run(spark: SparkSession, d: str) -> DataFrame:
        _, dev = discounted(spark, d, *tables)
        for t in free:
            read(dev.spark, d, t).createOrReplaceTempView(t)
        return dev.query(sql, args)

    run.__name__ = name
    QUERIES[name] = run
    body = (oracle or sql).replace(" orders ", " d_orders ").replace(" FROM orders", " FROM d_orders")
    with_ = f"d_orders AS {DISCOUNTED}"
    ORACLE[name] = body.replace("WITH ", f"WITH {with_}, ", 1) if body.startswith("WITH ") else f"WITH {with_} {body}"


# -- scans and writes -----------------------------------------------------------------------------
@query(BY_PRIORITY.format("orders"))
def visible_scan_main(spark, d):
    return store_of(spark, d, "orders").checkout().query(BY_PRIORITY.format("orders"))


@query(BY_PRIORITY.format(DISCOUNTED))
def update_branch_agg(spark, d):
    return discounted(spark, d)[1].query(BY_PRIORITY.format("orders"))


@query(BY_PRIORITY.format("orders"))
def parent_unchanged(spark, d):
    return discounted(spark, d)[0].checkout().query(BY_PRIORITY.format("orders"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 7 = 3")
def snapshot_by_key(spark, d):
    m = store_of(spark, d, "orders").checkout()
    keys = m.table("orders").where("o_orderkey % 7 = 3").select("o_orderkey")
    return m.get("orders", keys).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 100000) GROUP BY 1")
def delete_tombstone(spark, d):
    m = store_of(spark, d, "orders").checkout()
    m.execute("DELETE FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
    return m.query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")


@query("SELECT c_custkey, CASE WHEN c_custkey = 2 THEN 'back' ELSE c_name END AS c_name FROM customer WHERE c_custkey > 5 OR c_custkey = 2")
def resurrect_child(spark, d):
    store = store_of(spark, d, "customer")
    store.checkout().execute("DELETE FROM customer WHERE c_custkey <= 5")
    store.create_branch("child")
    c = store.checkout("child")
    c.execute("INSERT INTO customer (c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment) VALUES (2, 'back', 1, 0.0, 'X')")
    return c.query("SELECT c_custkey, c_name FROM customer")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 77, 'ATLANTIS'")
def insert_ignore(spark, d):
    m = store_of(spark, d, "region").checkout()
    m.execute("INSERT INTO region (r_regionkey, r_name) VALUES (0, 'TAKEN'), (77, 'ATLANTIS') ON CONFLICT DO NOTHING")
    return m.table("region")


@query("SELECT r_regionkey, CASE r_regionkey WHEN 1 THEN 'last' ELSE r_name END AS r_name FROM region UNION ALL SELECT 90, 'new'")
def upsert_last_wins(spark, d):
    m = store_of(spark, d, "region").checkout()
    m.upsert("region", [{"r_regionkey": 1, "r_name": "first"}, {"r_regionkey": 90, "r_name": "new"}, {"r_regionkey": 1, "r_name": "last"}])
    return m.table("region")


@query("SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'B' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_in_subquery(spark, d):
    m = store_of(spark, d, "orders", "customer").checkout()
    m.execute("UPDATE orders SET o_orderstatus = 'B' WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
    return m.query("SELECT o_orderkey, o_orderstatus FROM orders")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def delete_not_in(spark, d):
    m = store_of(spark, d, "orders", "customer").checkout()
    m.execute("DELETE FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
    return m.query("SELECT c_custkey, c_acctbal FROM customer")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_mktsegment IS NULL THEN 'none' ELSE coalesce(c_mktsegment, 'x') END AS c_mktsegment FROM customer WHERE c_custkey BETWEEN 3 AND 40 AND c_name LIKE '%1%'")
def update_case_between_like(spark, d):
    m = store_of(spark, d, "customer").checkout()
    m.execute("UPDATE customer SET c_mktsegment = CASE WHEN c_acctbal < :z THEN 'debt' WHEN c_mktsegment IS NULL THEN 'none' ELSE coalesce(c_mktsegment, 'x') END", {"z": 0})
    return m.query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey BETWEEN :a AND :b AND c_name LIKE '%1%'", {"a": 3, "b": 40})


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (3, 4)")
def delete_keys_bulk(spark, d):
    m = store_of(spark, d, "nation").checkout()
    m.delete_keys("nation", [{"n_nationkey": 3}, {"n_nationkey": 4}, {"n_nationkey": 999}])
    return m.query("SELECT n_nationkey, n_name FROM nation")


# -- branches and checkpoints -----------------------------------------------------------------------
@query("SELECT c_custkey, c_acctbal + 1 + 10 + 100 + 1000 AS c_acctbal FROM customer")
def deep_chain(spark, d):
    store = store_of(spark, d, "customer")
    at = "main"
    for i in range(4):
        store.create_branch(f"d{i}", at, fanout=1)
        at = f"d{i}"
        store.checkout(at).execute(f"UPDATE customer SET c_acctbal = c_acctbal + {10**i}")
    return store.checkout(at).query("SELECT c_custkey, c_acctbal FROM customer")


@query("SELECT 'w' || i AS branch, sum(CASE WHEN c_custkey % 8 = i THEN 1 ELSE 0 END)::BIGINT AS marked FROM customer, range(8) t(i) GROUP BY i")
def wide_fanout(spark, d):
    store, out = store_of(spark, d, "customer"), None
    for i in range(8):
        store.create_branch(f"w{i}", fanout=8)
        store.checkout(f"w{i}").execute(f"UPDATE customer SET c_mktsegment = 'w{i}' WHERE c_custkey % 8 = {i}")
    for i in range(8):
        t = S.visible(spark, store.catalog, store.catalog.bound("customer", store.catalog.head(f"w{i}").point), store.catalog.head(f"w{i}").point)
        one = t.agg(F.count(F.when(F.col("c_mktsegment") == f"w{i}", 1)).alias("marked")).select(F.lit(f"w{i}").alias("branch"), "marked")
        out = one if out is None else out.unionByName(one)
    return out


@query(BY_PRIORITY.format("orders"))
def fork_isolation(spark, d):
    store = store_of(spark, d, "orders")
    store.create_branch("kept")
    store.checkout().execute("DELETE FROM orders WHERE o_orderkey % 2 = 0")
    return store.checkout("kept").query(BY_PRIORITY.format("orders"))


@query(BY_PRIORITY.format("orders"))
def checkpoint_read(spark, d):
    store = store_of(spark, d, "orders")
    store.create_checkpoint("before")
    store.checkout().execute(DISCOUNT)
    return store.checkout_checkpoint("before").query(BY_PRIORITY.format("orders"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 5 THEN 'five' ELSE n_name END AS n_name FROM nation")
def branch_from_checkpoint(spark, d):
    store = store_of(spark, d, "nation")
    store.create_checkpoint("before")
    store.checkout().execute("DELETE FROM nation WHERE n_regionkey = 1")
    store.create_branch_from_checkpoint("again", "before")
    a = store.checkout("again")
    a.execute("UPDATE nation SET n_name = 'five' WHERE n_nationkey = 5")
    return a.query("SELECT n_nationkey, n_name FROM nation")


@query(BY_PRIORITY.format("orders"))
def txn_rollback(spark, d):
    m = store_of(spark, d, "orders").checkout()
    try:
        with m.transaction():
            m.execute("DELETE FROM orders WHERE o_orderkey > 10")
            raise KeyError
    except KeyError:
        return m.query(BY_PRIORITY.format("orders"))


@query("SELECT 'main' AS branch, CAST(NULL AS VARCHAR) AS parent, 2 AS child_count UNION ALL SELECT 'a', 'main', 1 UNION ALL SELECT 'b', 'a', 0")
def list_branches(spark, d):
    store = BranchStore(spark)
    store.create_branch("a")
    store.create_branch("b", "a")
    store.create_branch("gone")
    store.delete_branch("gone")
    return store.list_branches().select("branch", "parent", "child_count")


@query("SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey <> 2 GROUP BY 1")
def gc_reachable(spark, d):
    store = store_of(spark, d, "nation")
    store.create_branch("gone")
    store.checkout("gone").execute("UPDATE nation SET n_regionkey = 9")
    store.checkout().execute("DELETE FROM nation WHERE n_nationkey = 2")
    store.delete_branch("gone")
    store.compact("nation")
    store.vacuum()
    return store.checkout().query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")


@query(BY_PRIORITY.format("(SELECT * REPLACE (CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice + 5 ELSE o_totalprice END AS o_totalprice) FROM " + DISCOUNTED + " WHERE o_orderkey % 10 <> 0)"))
def compact_equivalence(spark, d):
    store, dev = discounted(spark, d)
    dev.execute("DELETE FROM orders WHERE o_orderkey % 10 = 0")
    store.compact("orders")
    dev.execute("UPDATE orders SET o_totalprice = o_totalprice + 5 WHERE o_orderpriority = '2-HIGH'")
    return dev.query(BY_PRIORITY.format("orders"))


# -- reads that the host engine answers ----------------------------------------------------------------
passthrough("inner_join_agg", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 4) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment", "customer")
passthrough("left_join_agg", "SELECT c_custkey, count(o_orderkey) AS n, CAST(coalesce(sum(floor(o_totalprice)), 0) AS BIGINT) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 150000 GROUP BY c_custkey", "customer")
passthrough("anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", "customer")
passthrough("anti_join_left", "SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 WHERE o_orderkey IS NULL", "customer")
passthrough("positional_args", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = $2 AND o_totalprice > $1", args=[350_000, "1-URGENT"], oracle="SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 350000")
passthrough("qualify_top", "SELECT c_mktsegment, c_custkey FROM (SELECT c_mktsegment, c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) AS r FROM customer) x WHERE r <= 3", "customer", oracle="SELECT c_mktsegment, c_custkey FROM customer QUALIFY rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) <= 3")
passthrough("window_named", "SELECT o_orderkey, sum(o_totalprice) OVER w AS running FROM orders WHERE o_custkey < 40 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
passthrough("semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 180000)", "customer")
passthrough("comma_join", "SELECT n_name, count(*) AS n FROM customer, nation WHERE c_nationkey = n_nationkey GROUP BY n_name", "customer", "nation")
passthrough("cte_topk", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) SELECT o_custkey, round(t, 4) AS total FROM big ORDER BY t DESC, o_custkey LIMIT 8")
passthrough("union_all", "SELECT o_orderkey AS k, 'o' AS kind FROM orders WHERE o_totalprice > 190000 UNION ALL SELECT c_custkey, 'c' FROM customer WHERE c_acctbal < 0", "customer")
passthrough("intersect_except", "SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 100000 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'", "customer", oracle="(SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 100000) EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
passthrough("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
passthrough("duplicate_check", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1", free=("lineitem",))
passthrough("global_aggregate", "SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_orderkey) AS hi FROM orders WHERE o_orderstatus IN ('O', 'P')")
passthrough("latest_per_key", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders ) x WHERE r = 1")
passthrough("correlated_scalar", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer", "customer")
passthrough("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice < 50000")


for _n, _sql in tpch.QUERIES.items():
    passthrough(f"tpch_q{_n}", _sql, *(t for t in tpch.VERSIONED if re.search(rf"\b{t}\b", _sql)), free=("lineitem",))


@query("SELECT k AS n_nationkey, depth FROM (WITH RECURSIVE r AS (SELECT 0 AS k, 0 AS depth UNION ALL SELECT n_nationkey, depth + 1 FROM r JOIN nation ON n_nationkey = 2 * k + 1 OR n_nationkey = 2 * k + 2 WHERE depth < 3) SELECT * FROM r)")
def recursive_reach(spark, d):
    m = store_of(spark, d, "nation").checkout()
    return m.query("WITH RECURSIVE r(n_nationkey, depth) AS (SELECT 0, 0 UNION ALL SELECT n.n_nationkey, depth + 1 FROM r JOIN nation n ON n.n_nationkey = 2 * r.n_nationkey + 1 OR n.n_nationkey = 2 * r.n_nationkey + 2 WHERE depth < 3) SELECT * FROM r")


# -- diff and merge -----------------------------------------------------------------------------------
TWO_SIDES = """WITH s AS (SELECT c_custkey AS k, c_acctbal + 1 AS v FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 7 <> 0),
t AS (SELECT c_custkey AS k, c_acctbal + 2 AS v FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 7 <> 0) """


def two_sides(spark, d):
    """Source adds 1 where the key is a multiple of 3, target 2 for multiples of 5; source deletes multiples of 7."""
    store = store_of(spark, d, "customer")
    store.create_branch("src")
    s, t = store.checkout("src"), store.checkout()
    with s.transaction():
        s.execute("UPDATE customer SET c_acctbal = c_acctbal + 1 WHERE c_custkey % 3 = 0")
        s.execute("DELETE FROM customer WHERE c_custkey % 7 = 0")
    t.execute("UPDATE customer SET c_acctbal = c_acctbal + 2 WHERE c_custkey % 5 = 0")
    return store


@query("SELECT 'customer' AS \"table\", '{\"c_custkey\":' || c_custkey || '}' AS key, CASE WHEN c_custkey % 7 = 0 THEN 'deleted' ELSE 'modified' END AS change, c_mktsegment AS segment, c_acctbal + CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 0 END AS before, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END END AS after FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0")
def diff_rows(spark, d):
    value = lambda side, name: F.get_json_object(side, f"$.{name}")
    got = two_sides(spark, d).diff("main", "src", "customer")
    return got.select("table", "key", "change", value("before", "c_mktsegment").alias("segment"), *[value(x, "c_acctbal").cast("double").alias(x) for x in ("before", "after")])


@query("SELECT CAST(count(*) AS BIGINT) AS n, 'modified' AS change FROM nation")
def diff_snapshot_schema(spark, d):
    store = store_of(spark, d, "nation")
    store.create_branch("wide")
    store.checkout("wide").execute("ALTER TABLE nation ADD COLUMN note TEXT DEFAULT 'x'")
    return store.diff("main", "wide", "nation").groupBy("change").agg(F.count("*").alias("n"))


@query("SELECT 0::BIGINT AS n")
def diff_reverted(spark, d):
    store = store_of(spark, d, "nation")
    store.create_branch("b")
    b = store.checkout("b")
    b.execute("UPDATE nation SET n_regionkey = n_regionkey + 1")
    b.execute("UPDATE nation SET n_regionkey = n_regionkey - 1")
    return store.diff("main", "b", "nation").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN c_custkey % 7 = 0 THEN 'deleted' ELSE 'modified' END AS change, count(*) AS n FROM customer WHERE (c_custkey % 7 = 0 OR c_custkey % 3 = 0) AND c_custkey % 5 <> 0 GROUP BY 1")
def merge_clean(spark, d):
    return two_sides(spark, d).merge_preview("src", "main").changes().groupBy("change").agg(F.count("*").alias("n"))


@query("SELECT '{\"c_custkey\":' || c_custkey || '}' AS key FROM customer WHERE (c_custkey % 7 = 0 OR c_custkey % 3 = 0) AND c_custkey % 5 = 0")
def merge_conflicts(spark, d):
    return two_sides(spark, d).merge_preview("src", "main").conflicts().select("key")


SOURCE_WINS = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 WHEN c_custkey % 5 = 0 THEN c_acctbal + 2 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 7 <> 0"
TARGET_WINS = "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 2 WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 7 <> 0 OR c_custkey % 5 = 0"


def merged_by(policy: str):
    def run(spark, d):
        store = two_sides(spark, d)
        store.merge("src", "main", policy)
        return store.checkout().query("SELECT c_custkey, c_acctbal FROM customer")

    return run


for _name, _policy, _sql in (("merge_source_wins", "source_wins", SOURCE_WINS), ("merge_target_wins", "target_wins", TARGET_WINS), ("merge_weak_si", "weak_snapshot_isolation", SOURCE_WINS)):
    QUERIES[_name], ORACLE[_name] = merged_by(_policy), _sql


@query("SELECT count(*) AS n FROM nation WHERE n_regionkey = 1")
def merge_same_value(spark, d):
    store = store_of(spark, d, "nation")
    store.create_branch("b")
    for s in ("b", "main"):
        store.checkout(s).execute("UPDATE nation SET n_name = 'same' WHERE n_regionkey = 1")
    return store.merge_preview("b", "main").conflicts().agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 15 = 0 AND c_custkey % 2 = 0 THEN c_acctbal + 1 WHEN c_custkey % 5 = 0 THEN c_acctbal + 2 WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 7 <> 0 OR (c_custkey % 5 = 0 AND c_custkey % 2 <> 0)")
def merge_manual_review(spark, d):
    store = two_sides(spark, d)
    p = store.merge_preview("src", "main")
    key = F.get_json_object("key", "$.c_custkey").cast("long")
    store.merge("src", "main", "manual_review", choices=p.conflicts().select("conflict_id", F.when(key % 2 == 0, "source").otherwise("target").alias("choice")), preview=p)
    return store.checkout().query("SELECT c_custkey, c_acctbal FROM customer")


@query("SELECT n_nationkey, CASE WHEN n_nationkey IN (2, 3) THEN 'picked' ELSE n_name END AS n_name FROM nation")
def merge_selection(spark, d):
    store = store_of(spark, d, "nation", "region")
    store.create_branch("b")
    b = store.checkout("b")
    b.execute("UPDATE nation SET n_name = 'picked' WHERE n_nationkey < 9")
    b.execute("UPDATE region SET r_name = 'not picked'")
    p, token = W.preview(store, "b", "main")
    chosen = p.changes().where((F.col("table") == "nation") & F.get_json_object("key", "$.n_nationkey").isin("2", "3")).select("change_id")
    W.merge_atomic(store, "b", "main", token, chosen)
    return store.checkout().query("SELECT n_nationkey, n_name FROM nation")


# -- schema branching ---------------------------------------------------------------------------------
@query("SELECT n_nationkey, n_name, n_regionkey, 7 AS score FROM nation")
def ddl_add_default(spark, d):
    store = store_of(spark, d, "nation")
    store.create_branch("b")
    b = store.checkout("b")
    b.execute("ALTER TABLE nation ADD COLUMN score INT DEFAULT 7")
    return b.table("nation")


@query("SELECT n_nationkey, n_name FROM nation")
def ddl_drop_column(spark, d):
    b = store_of(spark, d, "nation").checkout()
    b.execute("ALTER TABLE nation DROP COLUMN n_regionkey")
    return b.table("nation")


@query("SELECT n_nationkey, n_name, CAST(n_regionkey * 10 AS VARCHAR) AS n_regionkey FROM nation")
def ddl_alter_type(spark, d):
    b = store_of(spark, d, "nation").checkout()
    b.execute("ALTER TABLE nation ALTER COLUMN n_regionkey TYPE TEXT USING n_regionkey * 10")
    return b.table("nation")


@query("SELECT 1 AS id, 'a' AS name, 5 AS qty UNION ALL SELECT 2, 'b', 9")
def ddl_create(spark, d):
    store = store_of(spark, d, "nation")
    store.create_branch("b")
    b = store.checkout("b")
    b.execute("CREATE TABLE things (id INT PRIMARY KEY, name TEXT, qty INT DEFAULT 5)")
    b.execute("INSERT INTO things (id, name) VALUES (1, 'a')")
    b.execute("INSERT INTO things (id, name, qty) VALUES (2, 'b', 9)")
    return b.table("things")


@query("SELECT 'nation' AS name")
def ddl_drop_table(spark, d):
    store = store_of(spark, d, "nation", "region")
    store.create_branch("b")
    store.checkout("b").execute("DROP TABLE region")
    return spark.createDataFrame([(t,) for t in store.catalog.visible_tables(store.catalog.head("b").point)], "name string")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 3 UNION ALL SELECT r_regionkey + 100, r_name FROM region")
def query_many(spark, d):
    m = store_of(spark, d, "nation", "region").checkout()
    got = m.query_many(["SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey < 3", "SELECT r_regionkey + 100 AS k, r_name AS v FROM region"])
    return got.select(F.get_json_object("row", "$.k").cast("int").alias("n_nationkey"), F.get_json_object("row", "$.v").alias("n_name"))


@query("SELECT n_nationkey, n_name, 'nation' AS store FROM (SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'both' ELSE n_name END AS n_name FROM nation) x UNION ALL SELECT r_regionkey, CASE WHEN r_regionkey = 2 THEN 'both' ELSE r_name END, 'region' FROM region")
def merge_stores(spark, d):
    w = W.Workspace.together(spark, fresh_root(spark, "workspace"), ["a", "b"])
    for s, t in (("a", "nation"), ("b", "region")):
        w.stores[s].adopt(t, f"{d}/{t}.parquet", KEYS[t], verify=False)
    w.create_branch("dev")
    dev = w.checkout("dev")
    dev["a"].execute("UPDATE nation SET n_name = 'both' WHERE n_regionkey = 1")
    dev["b"].execute("UPDATE region SET r_name = 'both' WHERE r_regionkey = 2")
    w.merge_atomic("dev", "main", token=w.preview("dev", "main")[1])
    m = w.checkout()
    return m["a"].query("SELECT n_nationkey, n_name, 'nation' AS store FROM nation").union(m["b"].query("SELECT r_regionkey, r_name, 'region' FROM region"))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 4 = 0 AND vec_id % 8 <> 0")
def vector_merge(spark, d):
    """Points written alike on both sides agree; those written differently conflict."""
    store = BranchStore(spark)
    store.adopt("embeddings", f"{d}/embeddings.parquet", ["vec_id"], verify=False, agree=True)
    store.create_branch("b")
    for s, label in (("b", 70), ("main", 71)):
        store.checkout(s).execute(f"UPDATE embeddings SET label = CASE WHEN vec_id % 8 = 0 THEN 99 ELSE {label} END WHERE vec_id % 4 = 0")
    return store.merge_preview("b", "main").conflicts().select(F.get_json_object("key", "$.vec_id").cast("long").alias("vec_id"))


# -- layouts ------------------------------------------------------------------------------------------
HISTORY = BY_PRIORITY.format("(SELECT * FROM " + DISCOUNTED + " WHERE o_orderkey % 10 <> 0)")


def history(spark, d):
    """(base rows, changed rows, deleted keys) of the discount history."""
    o = read(spark, d, "orders")
    changed = o.where("o_orderpriority = '1-URGENT'").withColumn("o_totalprice", F.col("o_totalprice") * 0.9)
    return o, changed, o.where("o_orderkey % 10 = 0").select("o_orderkey")


def by_priority(df: DataFrame) -> DataFrame:
    return df.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 4).alias("total"))


@query(HISTORY)
def log_fold(spark, d):
    o, changed, gone = history(spark, d)
    tag = lambda df, branch, txn, op: df.select(F.lit(branch).alias("branch"), F.lit(txn).cast("long").alias("txn"), F.lit(txn).cast("long").alias("log_id"), F.lit(op).alias("op"), *[F.col(c) if c in df.columns else F.lit(None).cast(o.schema[c].dataType).alias(c) for c in o.columns])
    log = tag(o, "main", 1, "insert").unionByName(tag(changed, "dev", 2, "update")).unionByName(tag(gone, "dev", 3, "delete")).unionByName(tag(gone, "main", 4, "delete"))
    return by_priority(L.log_fold(log, L.lineage(spark, [("main", 0, 1), ("dev", 1, 9)]), ["o_orderkey"]))


@query(HISTORY)
def rlist_scan(spark, d):
    o, changed, gone = history(spark, d)
    data = o.select(F.col("o_orderkey").alias("rid"), *o.columns)
    index = L.rlist_index(data.select("rid"), 1)
    data, index = L.rlist_commit(data, index, 1, 2, changed.join(gone, "o_orderkey", "left_anti"), gone, ["o_orderkey"], 10**9)
    return by_priority(L.rlist_scan(data, index, 2))


@query("SELECT CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 10 <> 0 THEN 'replaced' ELSE 'removed' END AS why, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderkey % 10 = 0 GROUP BY 1")
def rlist_delta(spark, d):
    o, changed, gone = history(spark, d)
    data = o.select(F.col("o_orderkey").alias("rid"), *o.columns)
    index = L.rlist_index(data.select("rid"), 1)
    data, index = L.rlist_commit(data, index, 1, 2, changed.join(gone, "o_orderkey", "left_anti"), gone, ["o_orderkey"], 10**9)
    delta = L.rlist_delta(index, 1, 2).join(data, "rid")
    per = delta.groupBy("o_orderkey").agg(F.max(F.when(F.col("change") == "added", 1).otherwise(0)).alias("again"))
    return per.groupBy(F.when(F.col("again") == 1, "replaced").otherwise("removed").alias("why")).agg(F.count("*").alias("n"))


@query(HISTORY)
def copy_scan(spark, d):
    o, changed, gone = history(spark, d)
    new = FT.overlay_merge(o, changed, ["o_orderkey"]).join(gone, "o_orderkey", "left_anti")
    return by_priority(L.copy_branch(new, fresh_root(spark, "copy")))


@query(HISTORY)
def overlay_scan(spark, d):
    o, changed, gone = history(spark, d)
    tag = lambda df, b, r, t: df.select(F.lit(b).alias("branch"), F.lit(r).cast("long").alias("revision"), F.lit(t).alias("tombstone"), *[F.col(c) if c in df.columns else F.lit(None).cast(o.schema[c].dataType).alias(c) for c in o.columns])
    rows = tag(o, "main", 1, False).unionByName(tag(changed, "dev", 2, False)).unionByName(tag(gone, "dev", 3, True)).unionByName(tag(changed, "dev", 9, True))
    path = spark.createDataFrame([("dev", 0, 5), ("main", 1, 1)], "branch string, depth int, cutoff long")
    return by_priority(L.overlay(rows, path, ["o_orderkey"]))


# -- retrieval ----------------------------------------------------------------------------------------
COSINE = "round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 6)"


def probe(spark, d):
    return read(spark, d, "embeddings").where("vec_id = 7").first().embedding


@query(f"SELECT vec_id, {COSINE} AS score FROM embeddings ORDER BY {COSINE} DESC, vec_id LIMIT 10")
def vector_topk(spark, d):
    return R.dense_search(read(spark, d, "embeddings"), probe(spark, d), 10).select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, {COSINE} AS score FROM embeddings WHERE label = 3 AND vec_id % 5 <> 0 ORDER BY {COSINE} DESC, vec_id LIMIT 10")
def vector_branch_topk(spark, d):
    q = probe(spark, d)
    store = store_of(spark, d, "embeddings")
    store.create_branch("b")
    b = store.checkout("b")
    b.delete("embeddings", "vec_id % 5 = 0")
    return R.dense_search(b.table("embeddings").where("label = 3"), q, 10).select("vec_id", F.round("score", 6).alias("score"))


BM25 = """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM documents),
tf AS (SELECT doc_id, len(t) AS n, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM w) WHERE term IN ('the', 'idiot', 'einer') GROUP BY ALL),
df AS (SELECT term, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY term),
s AS (SELECT doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 256.0))) AS score FROM tf JOIN df USING (term) GROUP BY doc_id)
"""


@query(BM25 + "SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 20")
def bm25_topk(spark, d):
    return R.bm25_search(read(spark, d, "documents"), "The idiot, einer", 20).select("doc_id", F.round("score", 6).alias("score"))


@query(BM25 + ", a AS (SELECT doc_id, row_number() OVER (ORDER BY s.score DESC, doc_id) AS r FROM s QUALIFY r <= 64), b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents QUALIFY r <= 64) SELECT doc_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id ORDER BY sum(1.0::DOUBLE / (60 + r)) DESC, doc_id LIMIT 8")
def rrf_fusion(spark, d):
    docs = read(spark, d, "documents")
    a = R.bm25_search(docs, "the idiot einer", R.candidates(8))
    b = docs.select("doc_id", F.col("n_chars").cast("double").alias("score")).orderBy(F.desc("score"), "doc_id").limit(R.candidates(8))
    return R.fuse([a, b], 8, "doc_id").select("doc_id", F.round("score", 9).alias("score"))


@query("WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents), o AS (SELECT doc_id, w, unnest(range(greatest(1, ceil((len(w) - 64) / 448.0)::BIGINT)))::INT AS ordinal FROM t WHERE len(w) > 0) SELECT doc_id, ordinal, sha256(array_to_string(w[ordinal * 448 + 1 : ordinal * 448 + 512], ' ')) AS content_hash FROM o")
def chunk_windows(spark, d):
    return R.chunks(read(spark, d, "documents")).select("doc_id", "ordinal", "content_hash")


@query("SELECT source AS document_id, doc_id AS chunk_id FROM documents WHERE n_chars > 500 QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 2")
def per_doc_cap(spark, d):
    docs = read(spark, d, "documents")
    hits = docs.where("n_chars > 500").select(F.col("doc_id").alias("chunk_id"), F.col("n_chars").alias("score"), F.md5("text").alias("content_hash"))
    catalog = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.md5("text").alias("content_hash"))
    return R.per_document(hits, catalog, 2).select("document_id", "chunk_id")


@query("WITH h AS (SELECT o_custkey AS q, o_orderkey % 50 AS d, min(o_orderkey) AS k FROM orders GROUP BY 1, 2), r AS (SELECT q, d, row_number() OVER (PARTITION BY q ORDER BY k, d) AS r FROM h QUALIFY r <= 5), e AS (SELECT DISTINCT c_custkey AS q, c_custkey % 50 AS d FROM customer), p AS (SELECT e.q, count(r) / count(*)::DOUBLE AS recall, coalesce(1.0::DOUBLE / min(r), 0) AS rr FROM e LEFT JOIN r USING (q, d) GROUP BY e.q) SELECT count(*) AS questions, round(avg(recall), 9) AS recall, round(avg(rr), 9) AS mrr FROM p")
def recall_mrr(spark, d):
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    hits = o.select(F.col("o_custkey").alias("question_id"), (F.col("o_orderkey") % 50).alias("document_id"), F.col("o_orderkey").alias("rank"))
    want = c.select(F.col("c_custkey").alias("question_id"), (F.col("c_custkey") % 50).alias("document_id"))
    got = R.recall_mrr(hits, want, 5)
    return got.select("questions", F.round("recall", 9).alias("recall"), F.round("mrr", 9).alias("mrr"))


@query("SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE r = ceil(n * 0.95)")
def nearest_rank_p95(spark, d):
    return R.nearest_rank(read(spark, d, "events"), ["event_type"], "value", 0.95)


@query("WITH m AS (SELECT user_id % 4 AS w, 'b' || (event_id % 2) AS backend, event_type AS operation, median(value) AS p FROM events GROUP BY 1, 2, 3) SELECT backend, operation, round(avg(p), 6) AS mean_p50, round(min(p), 6) AS min_p50, round(max(p), 6) AS max_p50, count(*) AS workflows FROM m GROUP BY 1, 2")
def benchmark_rollup(spark, d):
    e = read(spark, d, "events").select((F.col("user_id") % 4).alias("workflow"), F.concat(F.lit("b"), F.col("event_id") % 2).alias("backend"), F.col("event_type").alias("operation"), F.col("value").alias("ms"))
    return R.rollup(e).select("backend", "operation", *[F.round(c, 6).alias(c) for c in ("mean_p50", "min_p50", "max_p50")], "workflows")


@query("SELECT count(*) AS rows, CAST(sum(CAST(CAST('0x' || substr(sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}'), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest FROM nation")
def state_digest(spark, d):
    return R.state_digest(store_of(spark, d, "nation").checkout().table("nation"))


@query("WITH t AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM documents) GROUP BY ALL), s AS (SELECT doc_id, (('0x' || substr(md5(term), 1, 8))::BIGINT % 64)::INT AS slot, sum(CASE WHEN ('0x' || substr(md5(term), 9, 1))::BIGINT % 2 = 0 THEN n ELSE -n END)::DOUBLE AS x FROM t GROUP BY ALL) SELECT doc_id, slot, round(x / (sqrt(sum(x * x) OVER (PARTITION BY doc_id)) + 0.0), 6) AS x FROM s WHERE x <> 0")
def hash_embedding(spark, d):
    e = R.hash_embedding(read(spark, d, "documents"))
    return e.select("doc_id", F.posexplode("embedding").alias("slot", "x")).select("doc_id", "slot", F.round("x", 6).alias("x")).where("x <> 0")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the ') AND source IS NOT NULL ORDER BY doc_id LIMIT 25")
def scroll_fallback(spark, d):
    docs = read(spark, d, "documents")
    return R.search(docs.where(R.phrase(F.col("text"), "The ") & F.col("source").isNotNull()), [], 25, "doc_id").select("doc_id")


@query("SELECT doc_id AS key, CASE WHEN doc_id % 10 = 0 THEN 'added' WHEN doc_id % 10 = 1 THEN 'deleted' ELSE 'modified' END AS change FROM documents WHERE doc_id % 10 IN (0, 1) OR (doc_id % 10 = 2 AND lower(text) <> text)")
def state_diff(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    left, right = docs.where("key % 10 <> 1"), docs.where("key % 10 <> 0")
    right = right.withColumn("text", F.when(F.col("key") % 10 == 2, F.lower("text")).otherwise(F.col("text")))
    return R.state_diff(left, right, "key", F.sha2(F.col("text"), 256))


@query("WITH t AS (SELECT doc_id, text, len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS n FROM documents), u AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM t) GROUP BY ALL) SELECT doc_id, term, round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 256.0)), 6) AS weight FROM u")
def sparse_encoding(spark, d):
    return R.term_weights(read(spark, d, "documents"), "doc_id", "text").select("doc_id", "term", F.round("weight", 6).alias("weight"))


# -- files, objects and streams -----------------------------------------------------------------------
def tree(spark, d):
    docs = read(spark, d, "documents").select(F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("data"))
    store = BranchStore(spark)
    for name, df, pk in zip(("inodes", "dirents", "blocks"), FT.from_contents(docs), (["inode_id"], ["parent_inode_id", "name"], ["inode_id", "byte_start"])):
        store.register_table(name, df, pk)
    return store


@query("WITH t AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, encode(text) AS b FROM documents), c AS (SELECT path, unnest(range((octet_length(b)::BIGINT + 4095) // 4096)) AS i FROM t), h AS (SELECT path, sha256(string_agg(sha256(array_slice(b, (i * 4096 + 1)::BIGINT, (i * 4096 + 4096)::BIGINT)), ',' ORDER BY i)) AS hash FROM c JOIN t USING (path) GROUP BY path) SELECT path, octet_length(b)::BIGINT AS size, hash FROM t LEFT JOIN h USING (path)")
def file_tree(spark, d):
    m = tree(spark, d).checkout()
    return FT.manifest(m.table("inodes"), m.table("dirents"), m.table("blocks")).where("kind = 'file'").select("path", "size", "hash")


@query("SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, CASE WHEN doc_id % 20 = 1 THEN 'deleted' ELSE 'modified' END AS change FROM documents WHERE doc_id % 20 = 1 OR (doc_id % 20 = 2 AND octet_length(encode(text)) > 0)")
def file_tree_diff(spark, d):
    store = tree(spark, d)
    store.create_branch("b")
    b = store.checkout("b")
    number = F.regexp_extract("name", r"^(\d+)\.txt$", 1).cast("long")
    files = b.table("dirents").where(F.col("name").endswith(".txt")).withColumn("n", number)
    b.delete_keys("dirents", files.where("n % 20 = 1").select("parent_inode_id", "name"))
    hit = files.where("n % 20 = 2").select("inode_id")
    b.upsert("blocks", b.table("blocks").where("byte_start = 0").join(hit, "inode_id", "left_semi").withColumn("data", F.unhex(F.concat(F.lit("00"), F.hex("data")))))
    views = [FT.manifest(s.table("inodes"), s.table("dirents"), s.table("blocks")).where("kind = 'file'") for s in (store.checkout(), b)]
    return FT.tree_diff(*views)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_upsert(spark, d):
    store = BranchStore(spark)
    e = read(spark, d, "events")
    store.checkout().create_table("events", e.schema.toDDL().replace(" NOT NULL", ""), ["event_id"])
    store.create_branch("live")
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    q = upsert_stream(store, stream, "live", "events", f"{scratch(spark)}/stream-{store.root.rsplit('-', 1)[-1]}").trigger(availableNow=True).start()
    q.awaitTermination()
    return store.checkout("live").query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")


@query("SELECT event_type, count(*) AS n, round(sum(CASE WHEN event_type = 'click' THEN value * 2 ELSE value END), 4) AS total FROM events WHERE event_type <> 'error' GROUP BY event_type")
def event_branch_rollup(spark, d):
    store = store_of(spark, d, "events")
    store.create_branch("fix")
    b = store.checkout("fix")
    b.execute("UPDATE events SET value = value * 2 WHERE event_type = 'click'")
    b.execute("DELETE FROM events WHERE event_type = 'error'")
    return b.query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
