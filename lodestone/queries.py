"""The engine's queries over the harness tables, each with the same in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import algebra
from lodestone.catalog.store import Store
from lodestone.operators import relational
from lodestone.operators.recursion import Limits
from lodestone.scripts import SCRIPTS
from lodestone.session import Session
from lodestone.sources.files import checkpoint_root
from lodestone.sources.tables import ParquetFolder

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables(ParquetFolder):
    """The harness tables, and small relations made from them: graphs, and one with NULL keys."""

    def __contains__(self, name: object) -> bool:
        return name in TABLES or name in ("hops", "tree", "sparse_customer")

    def made(self, name: str) -> DataFrame:
        if name == "hops":  # a graph with a cycle: k to 2k + 1 modulo 25
            return self["nation"].selectExpr("n_nationkey AS src", "CAST((n_nationkey * 2 + 1) % 25 AS INT) AS dst")
        if name == "tree":  # k below (k - 1) / 2
            return self["nation"].selectExpr("n_nationkey AS id", "CAST(IF(n_nationkey = 0, -1, (n_nationkey - 1) div 2) AS INT) AS parent", "n_name AS name")
        if name == "sparse_customer":
            return self["customer"].selectExpr("c_custkey", "IF(c_nationkey % 3 = 0, NULL, c_nationkey) AS nation", "IF(c_custkey % 4 = 0, NULL, c_acctbal) AS balance")
        return super().made(name)


HOPS = "hops AS (SELECT n_nationkey AS src, CAST((n_nationkey * 2 + 1) % 25 AS INTEGER) AS dst FROM nation)"
TREE = "tree AS (SELECT n_nationkey AS id, CAST(CASE WHEN n_nationkey = 0 THEN -1 ELSE (n_nationkey - 1) // 2 END AS INTEGER) AS parent, n_name AS name FROM nation)"
SPARSE = "sparse_customer AS (SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE c_nationkey END AS nation, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS balance FROM customer)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return Session(spark, tables=Tables(spark, sf_dir)).query(sql)


def sql(name: str, statement: str, oracle: str, names: str = "", rounded: str = "") -> None:
    """Register a query given as SQL of the dialect. `names` rename its columns; `rounded` ones lose what summation order changes."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = run(spark, sf_dir, statement)
        df = df.toDF(*names.split()) if names else df
        return df.withColumns({c: F.round(c, 2) for c in rounded.split()}) if rounded else df

    QUERIES[name], ORACLE_SQL[name] = query, oracle


# scans, projections, filters
sql("scan_star", "SELECT * FROM nation", "SELECT * FROM nation")
sql("project_columns", "SELECT c_name, c_custkey, c_mktsegment FROM customer", "SELECT c_name, c_custkey, c_mktsegment FROM customer")
sql("project_qualified", "SELECT c.c_name, c.c_acctbal FROM customer AS c", "SELECT c_name, c_acctbal FROM customer")
sql("filter_eq", 'SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = "F"', "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
sql("filter_lt", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 3.0", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 3.0")
sql("filter_gt", "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000.0", "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000.0")
sql("filter_col_col", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_discount < l_tax", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_discount < l_tax")
sql("filter_expr_neg", "SELECT c_custkey FROM customer WHERE (-c_acctbal) > -500.0", "SELECT c_custkey FROM customer WHERE -c_acctbal > -500.0")
sql("filter_expr_plus", "SELECT p_partkey FROM part WHERE (p_size+1) = 10", "SELECT p_partkey FROM part WHERE p_size + 1 = 10")
sql("filter_expr_minus", "SELECT p_partkey FROM part WHERE (p_size-5) < 3", "SELECT p_partkey FROM part WHERE p_size - 5 < 3")
sql("filter_and_or", "SELECT p_partkey FROM part WHERE p_size = 7 AND (p_retailprice > 1500.0 OR p_size = 9 OR p_retailprice < 950.0)", "SELECT p_partkey FROM part WHERE p_size = 7 AND (p_retailprice > 1500.0 OR p_size = 9 OR p_retailprice < 950.0)")
sql("filter_union_or", 'SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR c_mktsegment = "BUILDING" OR c_acctbal < -900.0', "SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR c_mktsegment = 'BUILDING' OR c_acctbal < -900.0")
sql("filter_intersect_and", 'SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_mktsegment = "BUILDING"', "SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING'")
sql("filter_nested_or", "SELECT c_custkey FROM customer WHERE (c_nationkey = 3 OR c_acctbal > 5000.0) AND (c_nationkey = 4 OR c_custkey < 500)", "SELECT c_custkey FROM customer WHERE (c_nationkey = 3 OR c_acctbal > 5000.0) AND (c_nationkey = 4 OR c_custkey < 500)")
sql("filter_in_list", 'SELECT c_custkey FROM customer WHERE c_mktsegment IN ("BUILDING", "MACHINERY", "BUILDING")', "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
sql("filter_null_lt", "SELECT c_custkey FROM sparse_customer WHERE balance < 0.0", f"WITH {SPARSE} SELECT c_custkey FROM sparse_customer WHERE balance IS NULL OR balance < 0")
sql("filter_null_gt", "SELECT c_custkey FROM sparse_customer WHERE balance > NULL", f"WITH {SPARSE} SELECT c_custkey FROM sparse_customer WHERE balance IS NOT NULL")
sql("filter_null_eq", "SELECT c_custkey FROM sparse_customer WHERE nation = NULL", f"WITH {SPARSE} SELECT c_custkey FROM sparse_customer WHERE nation IS NULL")
sql("filter_null_in", "SELECT c_custkey FROM sparse_customer WHERE nation IN (4, NULL)", f"WITH {SPARSE} SELECT c_custkey FROM sparse_customer WHERE nation = 4 OR nation IS NULL")
sql("filter_cross_type", "SELECT c_custkey FROM customer WHERE c_acctbal > 100000", "SELECT c_custkey FROM customer")
sql("like_prefix", 'SELECT c_custkey FROM customer WHERE c_name LIKE "Customer#00000001%"', "SELECT c_custkey FROM customer WHERE c_name LIKE 'Customer#00000001%'")
sql("like_contains", 'SELECT p_partkey FROM part WHERE p_name LIKE "%an%"', "SELECT p_partkey FROM part WHERE p_name LIKE '%an%'")
sql("like_underscore", 'SELECT n_nationkey FROM nation WHERE n_name LIKE "_A%"', "SELECT n_nationkey FROM nation WHERE n_name LIKE '_A%'")
sql("regex_search", 'SELECT p_partkey FROM part WHERE p_name ~ "^[a-m].*e"', "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^[a-m].*e')")

# joins
sql("join_inner", "SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey", "SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey", "c_name n_name")
sql("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey", "c_custkey o_orderkey")
sql("join_right", "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT OUTER JOIN customer c ON o.o_custkey = c.c_custkey", "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey", "o_orderkey c_custkey")
sql("join_full", "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL JOIN customer c ON s.s_suppkey = c.c_custkey", "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey", "s_suppkey c_custkey")
sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation", "SELECT r_name, n_name FROM region CROSS JOIN nation", "r_name n_name")
sql("join_theta_lt", "SELECT r_regionkey, n_nationkey FROM region JOIN nation ON r_regionkey < n_regionkey", "SELECT r_regionkey, n_nationkey FROM region JOIN nation ON r_regionkey < n_regionkey", "r_regionkey n_nationkey")
sql("join_theta_left", "SELECT n_nationkey, r_regionkey FROM nation LEFT JOIN region ON n_nationkey < r_regionkey", "SELECT n_nationkey, r_regionkey FROM nation LEFT JOIN region ON n_nationkey < r_regionkey", "n_nationkey r_regionkey")
sql("join_theta_full", "SELECT n_nationkey, r_regionkey FROM nation FULL OUTER JOIN region ON n_regionkey > r_regionkey", "SELECT n_nationkey, r_regionkey FROM nation FULL JOIN region ON n_regionkey > r_regionkey", "n_nationkey r_regionkey")
sql("join_swapped_operands", "SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey", "c_custkey n_name")
sql("join_self", "SELECT a.n_name, b.n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey", "x y")
sql("join_null_keys", "SELECT a.c_custkey, b.n_name FROM sparse_customer a JOIN nation b ON a.nation = b.n_nationkey", f"WITH {SPARSE} SELECT c_custkey, n_name FROM sparse_customer JOIN nation ON nation IS NOT DISTINCT FROM n_nationkey", "c_custkey n_name")
sql("join_null_pairs", "SELECT r.r_name, s.c_custkey FROM sparse_customer s RIGHT JOIN region r ON s.nation = r.r_regionkey", f"WITH {SPARSE} SELECT r_name, c_custkey FROM sparse_customer RIGHT JOIN region ON nation IS NOT DISTINCT FROM r_regionkey", "r_name c_custkey")
sql("join_chain", 'SELECT c.c_name, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = "ASIA"', "SELECT c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'", "c_name n_name r_name")
sql("join_where_after", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 150000.0", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 150000", "c_custkey o_orderkey")

# aggregates
sql("agg_global", "SELECT COUNT(*), SUM(l_quantity), AVG(l_extendedprice) FROM lineitem", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_extendedprice), 2) AS price FROM lineitem", "n quantity price", "quantity price")
sql("agg_group", "SELECT l_returnflag, l_linestatus, COUNT(*), SUM(l_quantity) FROM lineitem WHERE l_quantity < 24.0 GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_quantity < 24 GROUP BY ALL", "l_returnflag l_linestatus n quantity", "quantity")
sql("agg_sum_int", "SELECT p_brand, SUM(p_size), COUNT(p_size) FROM part GROUP BY p_brand", "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS sizes, count(p_size) AS n FROM part GROUP BY p_brand", "p_brand sizes n")
sql("agg_minmax", "SELECT o_orderpriority, MIN(o_totalprice), MAX(o_totalprice), MIN(o_orderstatus) FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, min(o_totalprice) AS low, max(o_totalprice) AS high, min(o_orderstatus) AS status FROM orders GROUP BY ALL", "o_orderpriority low high status")
sql("agg_avg", "SELECT p_brand, AVG(p_size) FROM part GROUP BY p_brand", "SELECT p_brand, round(avg(p_size), 2) AS size FROM part GROUP BY p_brand", "p_brand size", "size")
sql("agg_null_group", "SELECT nation, COUNT(*), COUNT(balance), MAX(balance) FROM sparse_customer GROUP BY nation", f"WITH {SPARSE} SELECT nation, count(*) AS n, count(balance) AS known, max(balance) AS high FROM sparse_customer GROUP BY nation", "nation n known high")
sql("agg_empty", "SELECT COUNT(*), MAX(o_totalprice) FROM orders WHERE o_orderkey < 0", "SELECT count(*) AS n, max(o_totalprice) AS high FROM orders WHERE o_orderkey < 0", "n high")
sql("group_distinct", "SELECT c_mktsegment, c_nationkey FROM customer GROUP BY c_mktsegment, c_nationkey", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
sql("agg_over_join", "SELECT n.n_name, COUNT(*), SUM(o.o_totalprice) FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", "n_name n total", "total")

# order and limit
sql("order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 25", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 25")
sql("order_hidden_column", "SELECT c_name FROM customer ORDER BY c_custkey LIMIT 10", "SELECT c_name FROM customer ORDER BY c_custkey LIMIT 10")
sql("order_after_group", "SELECT c_nationkey, COUNT(*) FROM customer GROUP BY c_nationkey ORDER BY c_nationkey DESC LIMIT 7", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey ORDER BY c_nationkey DESC LIMIT 7", "c_nationkey n")
sql("order_null_first", "WITH b AS (SELECT balance FROM sparse_customer GROUP BY balance) SELECT balance FROM b ORDER BY balance LIMIT 40", f"WITH {SPARSE} SELECT DISTINCT balance FROM sparse_customer ORDER BY balance NULLS FIRST LIMIT 40")
sql("limit_zero", "SELECT c_name FROM customer LIMIT 0", "SELECT c_name FROM customer LIMIT 0")

# set operations
for _op in ("union", "intersect", "except"):
    for _all in ("", "_all"):
        _word = f"{_op} {_all[1:]}".strip().upper()
        sql(f"{_op}{_all}", f"SELECT p_size FROM part {_word} SELECT c_nationkey FROM customer", f"SELECT p_size FROM part {_word} SELECT c_nationkey FROM customer")
sql("setop_chain", "SELECT n_nationkey FROM nation UNION ALL SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT ALL SELECT r_regionkey FROM region", "((SELECT n_nationkey FROM nation UNION ALL SELECT c_nationkey FROM customer) INTERSECT SELECT s_nationkey FROM supplier) EXCEPT ALL SELECT r_regionkey FROM region")
sql("setop_order_limit", "SELECT n_nationkey FROM nation UNION ALL SELECT r_regionkey FROM region ORDER BY n_nationkey LIMIT 8", "SELECT n_nationkey FROM nation UNION ALL SELECT r_regionkey FROM region ORDER BY n_nationkey LIMIT 8")

# WITH and derived tables
_RICH = "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_acctbal > 5000.0"
sql("cte_inline", f"WITH rich AS ({_RICH}) SELECT c_name FROM rich WHERE c_nationkey = 3", f"WITH rich AS ({_RICH}) SELECT c_name FROM rich WHERE c_nationkey = 3")
sql("cte_not_materialized", f"WITH rich AS NOT MATERIALIZED ({_RICH}) SELECT r.c_name FROM rich r WHERE r.c_nationkey = 3", f"WITH rich AS ({_RICH}) SELECT c_name FROM rich WHERE c_nationkey = 3")
sql("cte_materialized", f"WITH rich AS MATERIALIZED ({_RICH}) SELECT c_name FROM rich WHERE c_nationkey = 3", f"WITH rich AS MATERIALIZED ({_RICH}) SELECT c_name FROM rich WHERE c_nationkey = 3")
sql("cte_nested", f"WITH mid AS (WITH deep AS ({_RICH}) SELECT * FROM deep WHERE c_nationkey < 5) SELECT c_name FROM mid", f"WITH rich AS ({_RICH}) SELECT c_name FROM rich WHERE c_nationkey < 5")
sql("cte_siblings", f"WITH rich AS ({_RICH}), near AS (SELECT c_custkey, c_name FROM rich WHERE c_nationkey < 5) SELECT c_name FROM near", f"WITH rich AS ({_RICH}) SELECT c_name FROM rich WHERE c_nationkey < 5")
sql("cte_limit_then_filter", "WITH few AS (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 50) SELECT o_custkey FROM few WHERE o_orderkey > 20", "WITH few AS (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 50) SELECT o_custkey FROM few WHERE o_orderkey > 20")
sql("cte_grouped", "WITH g AS (SELECT c_nationkey, COUNT(*) FROM customer GROUP BY c_nationkey) SELECT COUNT(*) FROM g", "SELECT count(DISTINCT c_nationkey) AS n FROM customer", "n")
sql("cte_join_target", f"WITH rich AS ({_RICH}) SELECT o.o_orderkey, rich.c_name FROM orders o JOIN rich ON o.o_custkey = rich.c_custkey", f"WITH rich AS ({_RICH}) SELECT o_orderkey, c_name FROM orders JOIN rich ON o_custkey = c_custkey", "o_orderkey c_name")
sql("cte_join_body", "WITH j AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT customer.c_name, nation.n_name FROM j WHERE n_regionkey = 2", "SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2", "c_name n_name")
sql("cte_setop_body", "WITH keys AS (SELECT c_nationkey FROM customer UNION SELECT r_regionkey FROM region) SELECT COUNT(*) FROM keys", "SELECT count(*) AS n FROM (SELECT c_nationkey FROM customer UNION SELECT r_regionkey FROM region)", "n")
sql("derived_table", "SELECT name FROM (SELECT id, name FROM tree WHERE parent = 1) AS t WHERE id > 3", f"WITH {TREE} SELECT name FROM tree WHERE parent = 1 AND id > 3")

# subqueries
sql("in_subquery", 'SELECT c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name LIKE "NATION_1%")', "SELECT c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name LIKE 'NATION_1%')")
sql("in_correlated", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000.0 AND o_custkey = customer.c_custkey)", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
sql("in_setop", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT r_regionkey FROM region UNION SELECT s_nationkey FROM supplier)", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT r_regionkey FROM region UNION SELECT s_nationkey FROM supplier)")
sql("exists_correlated", "SELECT c_name FROM customer c WHERE EXISTS (SELECT * FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 180000.0)", "SELECT c_name FROM customer c WHERE EXISTS (SELECT * FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 180000)")
sql("exists_theta", "SELECT s_name FROM supplier s WHERE EXISTS (SELECT * FROM customer c WHERE c.c_nationkey = s.s_nationkey AND c.c_acctbal < s.s_acctbal)", "SELECT s_name FROM supplier s WHERE EXISTS (SELECT * FROM customer c WHERE c.c_nationkey = s.s_nationkey AND c.c_acctbal < s.s_acctbal)")
sql("exists_two_level", "SELECT n_name FROM nation n WHERE EXISTS (SELECT c_custkey FROM customer c WHERE c.c_nationkey = n.n_nationkey AND EXISTS (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 180000.0 AND n.n_regionkey < 3))", "SELECT n_name FROM nation n WHERE n_regionkey < 3 AND EXISTS (SELECT 1 FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_nationkey = n.n_nationkey AND o.o_totalprice > 180000)")
sql("exists_or", 'SELECT c_custkey FROM customer c WHERE c_mktsegment = "BUILDING" OR EXISTS (SELECT * FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 180000.0)', "SELECT c_custkey FROM customer c WHERE c_mktsegment = 'BUILDING' OR EXISTS (SELECT * FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 180000)")
sql("exists_uncorrelated", "SELECT r_name FROM region WHERE EXISTS (SELECT * FROM nation WHERE n_nationkey > 20)", "SELECT r_name FROM region")
sql("exists_aggregate", "SELECT r_name FROM region WHERE EXISTS (SELECT COUNT(*) FROM nation WHERE n_nationkey > 900)", "SELECT r_name FROM region")
sql("exists_limit", "SELECT n_name FROM nation n WHERE EXISTS (SELECT c_custkey FROM customer c WHERE c.c_nationkey = n.n_nationkey LIMIT 1)", "SELECT n_name FROM nation n WHERE EXISTS (SELECT * FROM customer c WHERE c.c_nationkey = n.n_nationkey)")
sql("in_join_subquery", "SELECT c_name FROM customer WHERE c_nationkey IN (SELECT nation.n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 1)", "SELECT c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
sql("subquery_over_join", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE EXISTS (SELECT * FROM supplier s WHERE s.s_nationkey = n.n_nationkey)", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)", "n_name r_name")

_deep = "SELECT r_regionkey FROM region r WHERE r.r_regionkey = n.n_regionkey AND r.r_regionkey > 0"
for _level in range(7):
    _deep = f"SELECT s_suppkey FROM supplier s{_level} WHERE s{_level}.s_nationkey = n.n_nationkey AND EXISTS ({_deep})"
sql("exists_eight_level", f"SELECT n_name FROM nation n WHERE EXISTS ({_deep})", "SELECT n_name FROM nation WHERE n_regionkey > 0 AND n_nationkey IN (SELECT s_nationkey FROM supplier)")
sql("exists_theta_limit", "SELECT n_name FROM nation n WHERE EXISTS (SELECT * FROM customer c WHERE c.c_custkey < n.n_nationkey AND c.c_acctbal > 5000.0 ORDER BY c_custkey LIMIT 1)", "SELECT n_name FROM nation n WHERE EXISTS (SELECT * FROM customer c WHERE c.c_custkey < n.n_nationkey AND c.c_acctbal > 5000)")
# recursion
sql("recursive_union_all", "WITH RECURSIVE below AS (SELECT id, parent, name FROM tree WHERE id = 1 UNION ALL SELECT tree.id, tree.parent, tree.name FROM tree JOIN below ON tree.parent = below.id) SELECT id, name FROM below", f"WITH RECURSIVE {TREE}, below AS (SELECT id, name FROM tree WHERE id = 1 UNION ALL SELECT tree.id, tree.name FROM tree JOIN below ON tree.parent = below.id) SELECT id, name FROM below")
sql("recursive_union_dedup", "WITH RECURSIVE walk AS (SELECT src FROM hops WHERE src = 2 UNION SELECT hops.dst FROM hops JOIN walk ON hops.src = walk.src) SELECT src FROM walk", f"WITH RECURSIVE {HOPS}, walk AS (SELECT src FROM hops WHERE src = 2 UNION SELECT hops.dst FROM hops JOIN walk ON hops.src = walk.src) SELECT src FROM walk")
sql("recursive_mutual", "WITH RECURSIVE even AS (SELECT id FROM tree WHERE id = 0 UNION SELECT tree.id FROM tree JOIN odd ON tree.parent = odd.id), odd AS (SELECT id FROM tree WHERE parent = 0 UNION SELECT tree.id FROM tree JOIN even ON tree.parent = even.id) SELECT id FROM even", f"WITH RECURSIVE {TREE}, walk AS (SELECT id, 0 AS depth FROM tree WHERE id = 0 UNION SELECT tree.id, 1 - walk.depth FROM tree JOIN walk ON tree.parent = walk.id) SELECT id FROM walk WHERE depth = 0")
sql("recursive_accumulator", "WITH RECURSIVE walk AS ACCUMULATOR (SELECT src FROM hops WHERE src = 1 UNION SELECT hops.dst FROM hops JOIN walk ON hops.src = walk.src) SELECT src FROM walk", f"WITH RECURSIVE {HOPS}, walk AS (SELECT src FROM hops WHERE src = 1 UNION SELECT hops.dst FROM hops JOIN walk ON hops.src = walk.src) SELECT src FROM walk")
sql("recursive_independent", "WITH RECURSIVE a AS (SELECT id FROM tree WHERE id = 1 UNION ALL SELECT tree.id FROM tree JOIN a ON tree.parent = a.id), b AS (SELECT id FROM tree WHERE id = 2 UNION ALL SELECT tree.id FROM tree JOIN b ON tree.parent = b.id) SELECT id FROM a UNION SELECT id FROM b", f"WITH {TREE} SELECT id FROM tree WHERE id > 0")


# what columns are called, as rows
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    statements = ["SELECT c_nationkey, COUNT(*), MAX(c_acctbal), COUNT(c_name) FROM customer GROUP BY c_nationkey", "SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey", "SELECT * FROM region", "WITH w AS (SELECT r_name FROM region) SELECT x.r_name FROM w x"]
    found = [(i, k, name) for i, statement in enumerate(statements) for k, name in enumerate(run(spark, sf_dir, statement).columns)]
    return spark.createDataFrame(found, "query int, place int, name string")


QUERIES["output_names"] = output_names
ORACLE_SQL["output_names"] = "SELECT * FROM (VALUES (0, 0, 'c_nationkey'), (0, 1, 'COUNT(*)'), (0, 2, 'MAX(c_acctbal)'), (0, 3, 'COUNT(c_name)'), (1, 0, 'customer.c_custkey'), (1, 1, 'nation.n_name'), (2, 0, 'r_regionkey'), (2, 1, 'r_name'), (3, 0, 'r_name')) t(query, place, name)"


# statements, through versioned tables in the shared folder
IMPORTED = {"C": ("customer", ("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")), "O": ("orders", ("o_orderkey", "o_custkey", "o_totalprice"))}


def engine(spark: SparkSession, sf_dir: str, *names: str) -> Session:
    """A session on a new database, with customers (C) or orders (O) as tables, keyed by their first column."""
    session = Session(spark, f"{checkpoint_root(spark)}/engine-{uuid.uuid4().hex}")
    done(session, "CREATE DATABASE company")
    tables = Tables(spark, sf_dir)
    for name in names:
        source, columns = IMPORTED[name]
        session.import_table(name, tables[source].select(*columns), primary=columns[0])
    return session


def done(session: Session, *statements: str) -> Session:
    for statement in statements:
        result = session.execute(statement)
        if not result.success:
            raise RuntimeError(f"{statement}: {result.message}")
    return session


def engine_query(name: str, oracle: str, names: str = ""):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(spark, sf_dir).toDF(*names.split()) if names else f(spark, sf_dir)
        ORACLE_SQL[name] = oracle
        return f

    return register


@engine_query("update_delete", "SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.5 ELSE c_acctbal END AS c_acctbal FROM customer WHERE NOT c_nationkey = 4")
def update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = done(engine(spark, sf_dir, "C"), 'UPDATE C SET c_acctbal = 0.5 WHERE c_mktsegment = "BUILDING"', "DELETE FROM C WHERE c_nationkey = 4")
    return session.query("SELECT c_custkey, c_nationkey, c_acctbal FROM C")


@engine_query("insert_values", "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region WHERE r_regionkey < 0 UNION ALL VALUES (1, 'one'), (2, NULL), (3, 'three')")
def insert_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = done(engine(spark, sf_dir), "CREATE TABLE T (id INT PRIMARY KEY, name STRING NULL)", 'INSERT INTO T VALUES (1, "one"), (2, NULL)', 'INSERT INTO T VALUES (3, "three")')
    session.execute('INSERT INTO T VALUES (3, "again")')
    return session.query("SELECT * FROM T")


def with_children(spark: SparkSession, sf_dir: str, action: str) -> Session:
    session = engine(spark, sf_dir)
    done(session, "CREATE TABLE P (id INT PRIMARY KEY)", f"CREATE TABLE K (id INT PRIMARY KEY, p INT NULL REFERENCES P(id) {action})")
    return done(session, "INSERT INTO P VALUES (1), (2), (3)", "INSERT INTO K VALUES (10, 1), (11, 1), (20, 2), (30, NULL)")


@engine_query("fk_cascade", "SELECT * FROM (VALUES (CAST(20 AS BIGINT), CAST(2 AS BIGINT)), (30, NULL)) t(id, p)")
def fk_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return done(with_children(spark, sf_dir, "ON DELETE CASCADE"), "DELETE FROM P WHERE id = 1").query("SELECT * FROM K")


@engine_query("fk_set_null", "SELECT * FROM (VALUES (CAST(10 AS BIGINT), CAST(NULL AS BIGINT)), (11, NULL), (20, 2), (30, NULL)) t(id, p)")
def fk_set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return done(with_children(spark, sf_dir, "ON DELETE SET NULL"), "DELETE FROM P WHERE id = 1").query("SELECT * FROM K")


@engine_query("fk_update_cascade", "SELECT * FROM (VALUES (CAST(10 AS BIGINT), CAST(7 AS BIGINT)), (11, 7), (20, 2), (30, NULL)) t(id, p)")
def fk_update_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return done(with_children(spark, sf_dir, "ON UPDATE CASCADE"), "UPDATE P SET id = 7 WHERE id = 1").query("SELECT * FROM K")


def answers(rows: list[tuple[int, str, str]]) -> str:
    """SQL of the steps of a script, its statements and their messages."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join(f'({n}, {quoted(a)}, {quoted(b)})' for n, a, b in rows)}) t(step, statement, message)"


def script(name: str, tables: tuple[str, ...], steps: list[tuple[str, str]]) -> None:
    """Register a script: each statement of `steps` must get its message."""

    @engine_query(name, answers([(n, *step) for n, step in enumerate(steps)]))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = engine(spark, sf_dir, *tables)
        got = [(n, statement, session.execute(statement).message) for n, (statement, _) in enumerate(steps)]
        return spark.createDataFrame(got, "step int, statement string, message string")


for _name, (_tables, _steps) in SCRIPTS.items():
    script(_name, _tables, _steps)


@engine_query("fk_update_set_null", "SELECT * FROM (VALUES (CAST(10 AS BIGINT), CAST(NULL AS BIGINT)), (11, NULL), (20, 2), (30, NULL)) t(id, p)")
def fk_update_set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return done(with_children(spark, sf_dir, "ON UPDATE SET NULL"), "UPDATE P SET id = 7 WHERE id = 1").query("SELECT * FROM K")


@engine_query("index_definitions", """SELECT * FROM (VALUES ('T', '__pk_id', 'id'), ('T', '__uq_a_b', 'a,b'), ('T', 'by_b', 'b'), ('T', 'near', 'a,id'), ('T', 'shifted', 'a+1')) t("table", name, columns)""")
def index_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = done(engine(spark, sf_dir), "CREATE TABLE T (id INT PRIMARY KEY, a INT NULL, b INT NULL, UNIQUE (a, b))", "CREATE INDEX by_b ON T(b)", "CREATE INDEX near ON T(a, id)", "CREATE INDEX gone ON T(a)", "CREATE INDEX shifted ON T((a+1))", "DROP INDEX gone ON T")
    found = [("T", i.name, str(i.expression) if i.expression else ",".join(i.columns)) for i in session.current_database.table("T").indexes]
    return spark.createDataFrame(found, "table string, name string, columns string")


@engine_query("dml_subquery", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) THEN 1.5 ELSE c_acctbal END AS c_acctbal FROM customer WHERE EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey)")
def dml_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = done(engine(spark, sf_dir, "C", "O"), "UPDATE C SET c_acctbal = 1.5 WHERE c_custkey IN (SELECT o_custkey FROM O WHERE o_totalprice > 300000.0)", "CREATE TABLE Kept (id INT)")
    done(session, "BEGIN", "UPDATE C SET c_nationkey = 1000 WHERE EXISTS (SELECT * FROM O WHERE O.o_custkey = C.c_custkey)", "DELETE FROM C WHERE c_nationkey < 1000", "COMMIT")
    return session.query("SELECT c_custkey, c_acctbal FROM C")


#: What two transactions do side by side, and whether the second may commit.
PAIRS = [
    ("write skew", ["SELECT v FROM T WHERE id = 2", "UPDATE T SET v = 0 WHERE id = 1"], ["SELECT v FROM T WHERE id = 1", "UPDATE T SET v = 0 WHERE id = 2"], False),
    ("one row twice", ["UPDATE T SET v = 5 WHERE id = 1"], ["UPDATE T SET v = 6 WHERE id = 1"], False),
    ("phantom", ["INSERT INTO T VALUES (7, 50)"], ["SELECT id FROM T WHERE v > 40", "INSERT INTO T VALUES (8, 1)"], False),
    ("phantom of an expression", ["INSERT INTO T VALUES (7, 50)"], ["SELECT id FROM T WHERE (v+1) = 51", "INSERT INTO T VALUES (8, 1)"], False),
    ("no phantom of an expression", ["INSERT INTO T VALUES (7, 50)"], ["SELECT id FROM T WHERE (v+1) = 52", "INSERT INTO T VALUES (8, 1)"], True),
    ("deleted under a reader", ["DELETE FROM T WHERE id = 2"], ["SELECT v FROM T WHERE v > 1", "INSERT INTO U VALUES (1)"], False),
    ("other rows", ["INSERT INTO T VALUES (7, 50)"], ["INSERT INTO T VALUES (8, 60)"], True),
    ("other tables", ["UPDATE T SET v = 5 WHERE id = 1"], ["SELECT v FROM U", "INSERT INTO U VALUES (1)"], True),
    ("subquery", ["INSERT INTO U VALUES (9)"], ["SELECT id FROM T WHERE v IN (SELECT v FROM U)", "INSERT INTO T VALUES (8, 60)"], False),
    ("one key twice", ["INSERT INTO U VALUES (1)"], ["INSERT INTO U VALUES (1)"], False),
    ("reader only", ["UPDATE T SET v = 5 WHERE id = 1"], ["SELECT v FROM T WHERE id = 2"], True),
]


@engine_query("serializable", f"SELECT * FROM (VALUES {', '.join(f"('{name}', {fine})" for name, _, _, fine in PAIRS)}) t(pair, commits)")
def serializable(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = []
    for name, first, second, _ in PAIRS:
        setup = done(engine(spark, sf_dir), "CREATE TABLE T (id INT, v INT)", "CREATE TABLE U (v INT PRIMARY KEY)", "INSERT INTO T VALUES (1, 1), (2, 2)")
        one, two = (done(Session(spark, setup.store.root), "BEGIN") for _ in range(2))
        done(one, *first)
        done(two, *second)
        done(one, "COMMIT")
        result = two.execute("COMMIT")
        if not result.success and result.message != "serialization failure":
            raise RuntimeError(result.message)
        found.append((name, result.success))
    return spark.createDataFrame(found, "pair string, commits boolean")


@engine_query("txn_visibility", "SELECT * FROM (VALUES (0, 'reader', 2, 3), (1, 'writer', 2, 30), (2, 'reader', 2, 3), (3, 'other', 2, 3), (4, 'reader', 2, 3), (5, 'other', 2, 30), (6, 'later', 2, 30)) t(step, who, n, total)")
def txn_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader keeps its snapshot, a writer sees its own changes, and others see them once they are committed."""
    other = done(engine(spark, sf_dir), "CREATE TABLE T (id INT, v INT)", "INSERT INTO T VALUES (1, 1), (2, 2)")
    reader, writer = (done(Session(spark, other.store.root), "BEGIN") for _ in range(2))
    seen: list[tuple] = []

    def look(who: str, session: Session) -> None:
        seen.append((len(seen), who, *session.execute("SELECT COUNT(*), SUM(v) FROM T").rows[0]))

    look("reader", reader)
    done(writer, "UPDATE T SET v = 15")
    look("writer", writer)
    look("reader", reader)
    look("other", other)
    done(writer, "COMMIT")
    look("reader", reader)
    look("other", other)
    done(reader, "ROLLBACK", "BEGIN")
    look("later", reader)
    done(reader, "ROLLBACK")
    return spark.createDataFrame(seen, "step int, who string, n int, total int")


@engine_query("crash_points", "SELECT * FROM (VALUES ('before', 'simulated crash before commit', 1), ('after', 'simulated crash after commit', 2)) t(point, message, n)")
def crash_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store that is read again after a crash on either side of a commit's rename has."""
    found = []
    for point in ("before", "after"):
        session = done(engine(spark, sf_dir), "CREATE TABLE T (id INT)", "INSERT INTO T VALUES (1)", "BEGIN", "INSERT INTO T VALUES (2)")
        session.arm_crash(point)
        message = session.execute("COMMIT").message
        again = Session(spark, session.store.root)
        again.store = Store(spark, session.store.root)
        found.append((point, message, again.execute("SELECT COUNT(*) FROM T").rows[0][0]))
    return spark.createDataFrame(found, "point string, message string, n int")


@engine_query("recursion_caps", "SELECT * FROM (VALUES ('rounds', 'WITH RECURSIVE exceeded maximum iteration count'), ('rows', 'WITH RECURSIVE exceeded maximum row count')) t(cap, message)")
def recursion_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    walk = "WITH RECURSIVE walk AS (SELECT src FROM hops WHERE src = 2 UNION ALL SELECT hops.dst FROM hops JOIN walk ON hops.src = walk.src) SELECT src FROM walk"
    limits = {"rounds": Limits(iterations=5, rows=1000), "rows": Limits(iterations=1000, rows=7)}
    found = [(cap, Session(spark, tables=Tables(spark, sf_dir), limits=limit).execute(walk).message) for cap, limit in limits.items()]
    return spark.createDataFrame(found, "cap string, message string")


@engine_query("txn_rollback_state", "SELECT count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer", "n balance")
def txn_rollback_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = done(engine(spark, sf_dir, "C"), "BEGIN", "UPDATE C SET c_acctbal = 1.0", "DELETE FROM C WHERE c_nationkey < 20", "ROLLBACK")
    df = session.query("SELECT COUNT(*), SUM(c_acctbal) FROM C")
    return df.select(df.columns[0], F.round(F.col("`SUM(c_acctbal)`"), 2))


@engine_query("txn_commit_state", "SELECT count(*) AS n FROM customer WHERE c_nationkey >= 20", "n")
def txn_commit_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return done(engine(spark, sf_dir, "C"), "BEGIN", "DELETE FROM C WHERE c_nationkey < 20", "COMMIT").query("SELECT COUNT(*) FROM C")


@engine_query("snapshot_roundtrip", "SELECT count(*) AS n FROM orders WHERE o_orderkey >= 100", "n")
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = done(engine(spark, sf_dir, "O"), "DELETE FROM O WHERE o_orderkey < 100", "SAVE DATABASE", "DELETE FROM O", "LOAD DATABASE company")
    return session.query("SELECT COUNT(*) FROM O")


@engine_query("alter_table", "SELECT c_custkey AS id, CAST(7 AS BIGINT) AS grade FROM customer")
def alter_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = done(engine(spark, sf_dir, "C"), "ALTER TABLE C ADD COLUMN mark INT NOT NULL DEFAULT 7", "ALTER TABLE C RENAME COLUMN mark TO grade", "ALTER TABLE C RENAME COLUMN c_custkey TO id", "ALTER TABLE C DROP COLUMN c_mktsegment", "RENAME TABLE C TO People")
    return session.query("SELECT id, grade FROM People")


@engine_query("list_tables", "SELECT * FROM (VALUES ('C'), ('O')) t(\"table\")")
def list_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, "C", "O").execute("LIST TABLES").df


@engine_query("prepared_bind", "SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_acctbal > 1000")
def prepared_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = done(engine(spark, sf_dir, "C"), 'PREPARE q AS "SELECT c_custkey FROM C WHERE c_nationkey = ? AND c_acctbal > ?;"')
    return session.execute("EXECUTE q VALUES (3, 1000.0)").df


@engine_query("analyze_histogram", """
WITH v AS (SELECT c_nationkey AS value, count(*) AS n FROM customer GROUP BY c_nationkey),
r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM v)
SELECT CAST(min(value) AS BIGINT) AS low, CAST(max(value) AS BIGINT) AS high, CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_values
FROM r GROUP BY CAST(before * 32 AS BIGINT) // CAST(total AS BIGINT)
""")  # fmt: skip
def analyze_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = done(engine(spark, sf_dir, "C"), "ANALYZE TABLE C")
    found = session.current_database.table("C").histograms["c_nationkey"]
    return spark.createDataFrame([tuple(b) for b in found["buckets"]], "low long, high long, rows long, distinct_values long")


#: Queries on E (200 rows: id, dept = id % 10, city = id // 10 % 10, name) and the plans that they must have.
PLANS: list[tuple[str, str]] = [
    ("EXPLAIN SELECT name FROM E WHERE id = 1", "hash index equality lookup on id\nresidual: no\nest_rows=1 cost=1"),
    ("EXPLAIN SELECT name FROM E WHERE dept = 1 AND city = 1", "multi-index intersect on dept, city\nresidual: no\nest_rows=2 cost=2"),
    ("EXPLAIN SELECT name FROM E WHERE dept = 1 OR city = 1", "multi-index union on dept, city\nresidual: no\nest_rows=37 cost=38"),
    ("EXPLAIN SELECT name FROM E WHERE id < 190 AND dept = 1 AND (dept = 2 OR city = 1)", "multi-index intersect on dept with union(dept, city)\ncomposite intersect and union for nested OR under AND\nresidual filter applied after index lookup\nresidual: yes\nest_rows=3 cost=3.8"),
    ("EXPLAIN SELECT name FROM E WHERE dept IN (1, 2)", "hash index IN lookup on dept (2 values)\nresidual: no\nest_rows=40 cost=40"),
    ("EXPLAIN SELECT name FROM E WHERE id > 190", "ordered index range lookup on id\nresidual: no\nest_rows=9 cost=9.6"),
    ('EXPLAIN SELECT name FROM E WHERE dept = 1 AND city = 1 AND name = "n1"', "multi-index intersect on dept, city\nresidual filter applied after index lookup\nresidual: yes\nest_rows=2 cost=2"),
    ('EXPLAIN SELECT name FROM E WHERE name ~ "x"', "full table scan\nresidual: yes\nest_rows=200 cost=200"),
    ('EXPLAIN SELECT name FROM E WHERE name LIKE "%n19%"', "trigram index intersect on name\nresidual filter applied after index lookup\nresidual: yes\nest_rows=10 cost=10"),
    ("EXPLAIN SELECT name FROM E WHERE (-id) = -5", "expression hash index equality lookup on (-id)\nresidual: no\nest_rows=1 cost=1"),
    ("EXPLAIN SELECT COUNT(*) FROM E", "full table scan\nest_rows=200 cost=200\naggregation"),
    ("EXPLAIN WITH w AS (SELECT id, name FROM E WHERE dept > 2) SELECT name FROM w WHERE id = 1", "hash index equality lookup on id\nresidual filter applied after index lookup\ninlined CTE w\nresidual: yes\nest_rows=1 cost=1"),
    ("EXPLAIN WITH w AS MATERIALIZED (SELECT id, name FROM E) SELECT name FROM w WHERE id = 1", "hash index equality lookup on id\nmaterialized CTE w\nresidual: no\nest_rows=10 cost=10"),
    ("EXPLAIN SELECT * FROM E a JOIN E b ON a.id = b.dept", "nested loop join (index probe on E.id)\nest_rows=200 cost=200"),
    ("EXPLAIN SELECT * FROM E a JOIN E b ON a.name = b.name", "hash join\nest_rows=200 cost=400"),
    ("EXPLAIN SELECT id FROM E UNION SELECT dept FROM E WHERE city = 1", "set operation left arm\nfull table scan\nest_rows=200 cost=200\nUNION\nhash index equality lookup on city\nresidual: no\nest_rows=20 cost=20"),
    ('EXPLAIN UPDATE E SET name = "x" WHERE id = 1', "update: hash index equality lookup on id\nresidual: no\nest_rows=1 cost=1"),
    ("EXPLAIN DELETE FROM E WHERE id = 1", "delete: hash index equality lookup on id\nresidual: no\nest_rows=1 cost=1"),
    ('EXPLAIN INSERT INTO E VALUES (1, 1, 1, "a")', "insert: 1 row(s) into E"),
]


@engine_query("explain_text", answers([(n, *plan) for n, plan in enumerate(PLANS)]))
def explain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = done(engine(spark, sf_dir), "CREATE TABLE E (id INT PRIMARY KEY, dept INT, city INT, name STRING)", "CREATE INDEX b ON E(dept)", "CREATE INDEX c ON E(city)", "CREATE INDEX t ON E((trigram(name)))", "CREATE INDEX n ON E((-id))")
    done(session, "INSERT INTO E VALUES " + ", ".join(f'({i}, {i % 10}, {i // 10 % 10}, "n{i}")' for i in range(200)), "ANALYZE TABLE E")
    found = [(n, statement, "\n".join(r[0] for r in session.execute(statement).rows)) for n, (statement, _) in enumerate(PLANS)]
    return spark.createDataFrame(found, "step int, statement string, message string")


@engine_query("explain_analyze", "SELECT 0 AS line, count(*) AS actual_rows FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 1, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def explain_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = 'SELECT c.c_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = "ASIA"'
    lines = Session(spark, tables=Tables(spark, sf_dir)).execute(f"EXPLAIN ANALYZE {joined}").df
    numbered = [(n, r["plan"]) for n, r in enumerate(lines.collect())]
    return spark.createDataFrame(numbered, "line int, plan string").select("line", F.regexp_extract("plan", "actual_rows=([0-9]+)", 1).cast("long").alias("actual_rows"))


@engine_query("index_lookup", "SELECT c_name FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING'")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.index_lookup(Tables(spark, sf_dir)["customer"], {"c_nationkey": 3, "c_mktsegment": "BUILDING"}).select("c_name")


@engine_query("trigram_lookup", "SELECT p_partkey FROM part WHERE p_name LIKE '%dge%'")
def trigram_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = Tables(spark, sf_dir)["part"]
    return part.where(F.array_contains(algebra.trigrams(F.col("p_name")), "dge")).select("p_partkey")
