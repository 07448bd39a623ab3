"""The 22 TPC-H questions in the form these tables allow, as SQL that Spark and DuckDB both read.

There is no partsupp, so Q2, Q9, Q11, Q16 and Q20 take it from lineitem: which supplier delivered which part, the
least price of a delivery, and how many. Ship modes, containers and phone numbers are replaced by columns at hand.
"""

from __future__ import annotations

REVENUE = "l_extendedprice * (1 - l_discount)"
PARTSUPP = "partsupp AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min(l_extendedprice) AS ps_supplycost, sum(l_quantity) AS ps_availqty FROM lineitem GROUP BY l_partkey, l_suppkey)"


def period(column: str, begin: str, end: str) -> str:
    return f"{column} >= TIMESTAMP '{begin} 00:00:00' AND {column} < TIMESTAMP '{end} 00:00:00'"


QUERIES: dict[int, str] = {
    1: f"SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice), 4) AS sum_base, round(sum({REVENUE}), 4) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    2: f"WITH {PARTSUPP}, offers AS (SELECT ps_partkey, s_acctbal, s_name, n_name, ps_supplycost FROM partsupp JOIN supplier ON ps_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE') SELECT s_acctbal, s_name, n_name, p_partkey, p_brand FROM offers JOIN part ON p_partkey = ps_partkey WHERE p_size < 16 AND p_type = 'PROMO' AND ps_supplycost = (SELECT min(o.ps_supplycost) FROM offers o WHERE o.ps_partkey = p_partkey) ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100",
    3: f"SELECT l_orderkey, round(sum({REVENUE}), 4) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10",
    4: f"SELECT o_orderpriority, count(*) AS n FROM orders WHERE {period('o_orderdate', '1997-07-01', '1997-10-01')} AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority",
    5: f"SELECT n_name, round(sum({REVENUE}), 4) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND {period('o_orderdate', '1996-01-01', '1999-01-01')} GROUP BY n_name",
    6: f"SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE {period('l_shipdate', '1997-01-01', '1998-01-01')} AND l_discount BETWEEN 0.02 AND 0.06 AND l_quantity < 24",
    7: f"SELECT s.n_name AS supp_nation, c.n_name AS cust_nation, CAST(extract(year FROM l_shipdate) AS BIGINT) AS l_year, round(sum({REVENUE}), 4) AS revenue FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation s ON s_nationkey = s.n_nationkey JOIN nation c ON c_nationkey = c.n_nationkey WHERE ((s.n_name = 'NATION_6' AND c.n_name = 'NATION_7') OR (s.n_name = 'NATION_7' AND c.n_name = 'NATION_6')) AND {period('l_shipdate', '1997-01-01', '2000-01-01')} GROUP BY s.n_name, c.n_name, l_year",
    8: f"SELECT o_year, round(sum(CASE WHEN nation = 'NATION_7' THEN volume ELSE 0 END) / sum(volume), 6) AS share FROM (SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year, {REVENUE} AS volume, s.n_name AS nation FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation c ON c_nationkey = c.n_nationkey JOIN region ON c.n_regionkey = r_regionkey JOIN nation s ON s_nationkey = s.n_nationkey WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY') x GROUP BY o_year",
    9: f"WITH {PARTSUPP} SELECT n_name, CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year, round(sum({REVENUE} - ps_supplycost * l_quantity), 4) AS profit FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN partsupp ON ps_suppkey = l_suppkey AND ps_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE p_name LIKE '%blue%' GROUP BY n_name, o_year",
    10: f"SELECT c_custkey, round(sum({REVENUE}), 4) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND {period('o_orderdate', '1997-10-01', '1998-01-01')} GROUP BY c_custkey ORDER BY revenue DESC, c_custkey LIMIT 20",
    11: f"WITH {PARTSUPP}, held AS (SELECT ps_partkey, ps_supplycost * ps_availqty AS value FROM partsupp JOIN supplier ON ps_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_7') SELECT ps_partkey, round(sum(value), 4) AS value FROM held GROUP BY ps_partkey HAVING sum(value) > (SELECT 2 * sum(value) / count(*) FROM held)",
    12: f"SELECT l_linestatus, count(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 END) AS high, count(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 END) AS low FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate AND {period('l_shipdate', '1997-01-01', '1998-01-01')} GROUP BY l_linestatus",
    13: "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%SPEC%' GROUP BY c_custkey) x GROUP BY c_count",
    14: f"SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {REVENUE} ELSE 0 END) / sum({REVENUE}), 4) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {period('l_shipdate', '1997-09-01', '1997-10-01')}",
    15: f"WITH revenue AS (SELECT l_suppkey, sum({REVENUE}) AS total FROM lineitem WHERE {period('l_shipdate', '1998-01-01', '1998-04-01')} GROUP BY l_suppkey) SELECT s_suppkey, s_name, round(total, 4) AS total FROM supplier JOIN revenue ON s_suppkey = l_suppkey WHERE total = (SELECT max(total) FROM revenue)",
    16: f"WITH {PARTSUPP} SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM partsupp JOIN part ON p_partkey = ps_partkey WHERE p_brand <> 'Brand#5' AND p_type NOT LIKE 'MED%' AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49) AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size",
    17: "SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#23' AND p_type = 'SMALL' AND l_quantity < (SELECT 0.5 * avg(i.l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey)",
    18: "SELECT o_custkey, o_orderkey, round(o_totalprice, 4) AS price, round(sum(l_quantity), 4) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) GROUP BY o_custkey, o_orderkey, o_totalprice",
    19: f"SELECT round(sum({REVENUE}), 4) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 21 AND p_size BETWEEN 1 AND 15) OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 30 AND p_size BETWEEN 1 AND 30) OR (p_brand = 'Brand#4' AND l_quantity BETWEEN 20 AND 40 AND p_size BETWEEN 1 AND 45)",
    20: f"WITH {PARTSUPP} SELECT s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2 AND s_suppkey IN (SELECT ps_suppkey FROM partsupp WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'blue%') AND ps_availqty > (SELECT 0.5 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND {period('l_shipdate', '1997-01-01', '1998-01-01')}))",
    21: "SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem a ON s_suppkey = a.l_suppkey JOIN orders ON o_orderkey = a.l_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE o_orderstatus = 'F' AND a.l_shipdate > o_orderdate AND n_regionkey = 1 AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey) AND NOT EXISTS (SELECT 1 FROM lineitem c WHERE c.l_orderkey = a.l_orderkey AND c.l_suppkey <> a.l_suppkey AND c.l_returnflag = 'R') GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100",
    22: "WITH idle AS (SELECT c_nationkey, c_acctbal FROM customer WHERE c_nationkey IN (1, 3, 7, 13, 18, 23) AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 200000)) SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 4) AS totacctbal FROM idle GROUP BY c_nationkey",
}
#: Tables of each question that branch; lineitem is read as it lies.
VERSIONED = ("customer", "supplier", "part", "nation", "region")
