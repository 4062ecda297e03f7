"""Sharding by extendible hashing: shards are hash prefixes, and only those over the byte limit split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import extendible
from lodestone.llm.common import Scratch

#: Bits of the row number within a block; what one task of `paged` adds up for a key is a row a block.
BLOCK_BITS = 12


def key_of(column: Column) -> Column:
    """The first 60 bits of the md5 of a key as text; null counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def paged(over: DataFrame, limit: int) -> DataFrame:
    """Adds the page of each row (key, row, n_bytes) of keys over the limit, and `weight` and `entries` of that page.

    Running byte offsets over the rows of a key, from sums of blocks, are cut every half limit, so a page
    holds less than that and its last row. Rows larger than the other half have pages of their own.
    """
    half = max(1, limit // 2)
    small = F.when(F.col("n_bytes") <= limit - half, F.col("n_bytes")).otherwise(0)
    alone = (F.col("n_bytes") > limit - half).cast("long")
    over = over.drop("weight", "entries").withColumn("block", F.shiftright("row", BLOCK_BITS))
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    running = lambda column, window: F.coalesce(F.sum(column).over(window), F.lit(0))
    blocks = over.groupBy("key", "block").agg(F.sum(small).alias("small"), F.sum(alone).alias("alone"))
    within = earlier("key").orderBy("block")
    blocks = blocks.select("key", "block", running("small", within).alias("small"), running("alone", within).alias("alone"))
    within = earlier("key", "block").orderBy("row")
    over = over.withColumns({"small_here": running(small, within), "alone_here": running(alone, within)}).join(blocks, ["key", "block"])
    page = F.when(alone == 1, 2 * (F.col("alone") + F.col("alone_here")) + 1).otherwise(2 * F.expr(f"(small + small_here) div {half}"))
    over = over.withColumn("page", page).drop("block", "small", "alone", "small_here", "alone_here")
    sums = over.groupBy("key", "page").agg(F.sum("n_bytes").alias("weight"), F.count(F.lit(1)).alias("entries"))
    return over.join(sums, ["key", "page"])


def assign_rows(rows: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """`assign_shards` of rows (doc_id, n_bytes, row), with `row`."""
    keyed = scratch.write(rows.select("doc_id", "n_bytes", key_of(F.col("doc_id")).alias("key"), "row"), "keyed")
    directory = extendible.build(keyed.select("key", F.col("n_bytes").alias("weight")), limit, scratch)
    placed = extendible.place(keyed, directory)
    names = ["row", "doc_id", "n_bytes", "depth", "prefix", "weight", "entries"]
    found = placed.withColumn("page", F.lit(None).cast("long"))
    if not directory.where(F.col("pages") > 1).isEmpty():
        over = scratch.write(placed.where(F.col("pages") > 1), "over")
        found = found.where(F.col("pages") == 1).select(*names, "page").unionByName(paged(over, limit).select(*names, "page"))
    shard = F.concat_ws("-", "depth", "prefix", "page").alias("shard")
    return found.select("row", "doc_id", "n_bytes", shard, F.col("depth").alias("shard_depth"), F.col("weight").alias("shard_bytes"), F.col("entries").alias("shard_docs"))


def size_of(text_col: str) -> Column:
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")


def assign_shards(df: DataFrame, limit: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, shard (depth and prefix, `page` after it if there are several), shard_depth, shard_bytes, shard_docs.

    A shard holds at most `limit` bytes of UTF-8 text, except that a document above the limit has a shard
    without others. The rows of one key that exceed the limit together are cut into pages, which are the
    shards then. Null text counts 0 bytes. An empty table gives no row; other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), size_of(text_col).alias("n_bytes"), F.monotonically_increasing_id().alias("row"))
    return assign_rows(rows, limit, Scratch(df.sparkSession, "shards")).drop("row")


def write_shards(df: DataFrame, path: str, limit: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents, a folder for each shard (`__shard`), and return the assignment as read from what was written."""
    scratch = Scratch(df.sparkSession, "shards")
    rows = df.select(F.struct("*").alias("document"), size_of(text_col).alias("n_bytes"), key_of(F.col(id_col)).alias("key"))
    directory = extendible.build(scratch.write(rows.select("key", F.col("n_bytes").alias("weight")), "keyed"), limit, scratch)
    placed = extendible.place(rows, directory)
    names = ["document", "depth", "prefix"]
    found = placed.where(F.col("pages") == 1).select(*names, F.lit(None).cast("long").alias("page"))
    if not directory.where(F.col("pages") > 1).isEmpty():
        over = scratch.write(placed.where(F.col("pages") > 1).withColumn("row", F.monotonically_increasing_id()), "over")
        found = found.unionByName(over.join(paged(over.drop("document"), limit).select("row", "page"), "row").select(*names, "page"))
    found = found.select("document.*", F.concat_ws("-", "depth", "prefix", "page").alias("__shard"))
    found.repartition("__shard").write.partitionBy("__shard").parquet(path)
    written = df.sparkSession.read.schema(found.schema).parquet(path)
    written = written.select(F.col(id_col).alias("doc_id"), size_of(text_col).alias("n_bytes"), F.col("__shard").alias("shard"))
    sums = written.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_docs"))
    depth = F.substring_index("shard", "-", 1).cast("int").alias("shard_depth")
    return written.join(sums, "shard").select("doc_id", "n_bytes", "shard", depth, "shard_bytes", "shard_docs")


#: The same in DuckDB: a shard is the shortest prefix that fits or is one key.
ORACLE = """
WITH keyed AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM documents),
nodes AS (
  SELECT d, key >> (60 - d) AS prefix, sum(n_bytes) AS bytes, count(*) AS docs
  FROM keyed, range(0, 40) t(d) GROUP BY ALL
  HAVING sum(n_bytes) <= {limit} OR min(key) = max(key)),
leaf AS (
  SELECT k.doc_id, min(n.d) AS d FROM keyed k JOIN nodes n ON n.prefix = k.key >> (60 - n.d) GROUP BY ALL)
SELECT k.doc_id, k.n_bytes, n.d || '-' || n.prefix AS shard, CAST(n.d AS INTEGER) AS shard_depth,
       CAST(n.bytes AS BIGINT) AS shard_bytes, n.docs AS shard_docs
FROM keyed k JOIN leaf USING (doc_id) JOIN nodes n ON n.d = leaf.d AND n.prefix = k.key >> (60 - n.d)
"""
