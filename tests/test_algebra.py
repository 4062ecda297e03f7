"""The comparison algebra against its plain-Python form, on all pairs of values; and registered oracles."""

import itertools
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone import queries
from lodestone.functions import algebra, rows

VALUES = {"INT": [None, -1, 0, 1, 5], "DOUBLE": [None, -1.5, 0.0, 1.0], "STRING": [None, "", "a", "b"]}
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("left", "right"), list(itertools.product(VALUES, VALUES)))
def test_all_pairs(spark, left, right):
    pairs = list(itertools.product(VALUES[left], VALUES[right]))
    spark_type = {"INT": "long", "DOUBLE": "double", "STRING": "string"}
    df = spark.createDataFrame(pairs, f"a {spark_type[left]}, b {spark_type[right]}")
    a, b = algebra.Operand(F.col("a"), left), algebra.Operand(F.col("b"), right)
    got = df.select("a", "b", *(algebra.compare(a, op, b).alias(op) for op in "=<>")).collect()
    for r in got:
        assert tuple(map(bool, tuple(r)[2:])) == tuple(rows.compare(r["a"], op, r["b"]) for op in "=<>")


@pytest.mark.parametrize("value", [None, 0, 1.0, "a"])
def test_literals(spark, value):
    df = spark.createDataFrame([(v,) for v in VALUES["INT"]], "a long")
    a, b = algebra.Operand(F.col("a"), "INT"), algebra.literal(value)
    for r in df.select("a", *(algebra.compare(a, op, b).alias(op) for op in "=<>")).collect():
        assert tuple(map(bool, tuple(r)[1:])) == tuple(rows.compare(r["a"], op, value) for op in "=<>")


def test_filters_reach_the_scan(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(100).selectExpr("id AS a", "id AS b", "id AS c").write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("pushed")
    df = spark.table("pushed")
    a = algebra.Operand(F.col("a"), "INT")
    for op, pushed in (("=", "EqualTo(a,5)"), ("<", "Or(IsNull(a),LessThan(a,5))"), (">", "GreaterThan(a,5)")):
        text = df.where(algebra.compare(a, op, algebra.literal(5))).select("b")._jdf.queryExecution().executedPlan().toString()
        assert pushed in text and "c#" not in text.split("ReadSchema")[1]


def test_trigrams(spark):
    df = spark.createDataFrame([("banana",), ("ab",)], "t string").select(algebra.trigrams(F.col("t")).alias("g"))
    assert [r["g"] for r in df.collect()] == [["ban", "ana", "nan"], ["ab"]]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered(spark, name):
    con = duckdb.connect()
    for table in queries.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    plain = lambda v: round(v, 4) if isinstance(v, float) else v
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*names).collect())
    assert got == sorted(repr([plain(v) for v in r]) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_set_operations_count_rows(spark):
    tables = queries.Tables(spark, SF)
    left, right = ([r[0] for r in tables[t].select(c).collect()] for t, c in (("part", "p_size"), ("customer", "c_nationkey")))
    found = {op: queries.QUERIES[op](spark, SF).collect() for op in ("union_all", "intersect_all", "except_all")}
    assert Counter(r[0] for r in found["union_all"]) == Counter(left) + Counter(right)
    assert Counter(r[0] for r in found["intersect_all"]) == Counter(left) & Counter(right)
    assert Counter(r[0] for r in found["except_all"]) == Counter(left) - Counter(right)
