"""Extendible-hash directories over 60-bit keys, built with DataFrame operations alone.

A bucket is a prefix of the key. A bucket over its limit splits on one more bit, and only such a bucket
does; one whose rows all share a key cannot split and keeps overflow pages instead. The directory is a
table with a row a bucket; nothing of it is collected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch

KEY_BITS = 60
#: Bits that a round looks ahead below buckets that are still too large.
STEP = 8


def prefix(key: Column, depth: int) -> Column:
    return F.shiftright(key, KEY_BITS - depth)


def build(keyed: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """Buckets of `keyed` (key, weight): depth, prefix, weight, entries, pages; each weighs `limit` at most or is one key."""
    total = keyed.agg(F.sum("weight")).first()[0] or 0
    base, top = -1, min(KEY_BITS, max(0, math.ceil(math.log2(max(1.0, total / limit)))) + 2)
    rows, found = keyed, []
    while True:
        fine = rows.groupBy(prefix(F.col("key"), top).alias("cell")).agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("entries"), F.min("key").alias("low"), F.max("key").alias("high"))
        levels = fine.withColumn("depth", F.explode(F.sequence(F.lit(base + 1), F.lit(top))))
        nodes = levels.groupBy("depth", F.expr(f"shiftright(cell, {top} - depth)").alias("prefix")).agg(F.sum("weight").alias("weight"), F.sum("entries").alias("entries"), F.min("low").alias("low"), F.max("high").alias("high"))
        nodes = nodes.withColumn("fits", (F.col("weight") <= limit) | (F.col("low") == F.col("high")))
        nodes = scratch.write(nodes, f"nodes-{top}")
        above = nodes.where(~F.col("fits")).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        inner = nodes.where("fits").withColumn("parent", F.shiftright("prefix", 1)).join(above, ["depth", "parent"], "left_semi")
        found.append(inner.drop("parent").unionByName(nodes.where(F.col("fits") & (F.col("depth") == base + 1))).distinct())
        over = nodes.where(~F.col("fits") & (F.col("depth") == top)).select(F.col("prefix").alias("cell"))
        if over.isEmpty():
            break
        rows = rows.join(over, prefix(rows["key"], top) == over["cell"], "left_semi")
        base, top = top, min(KEY_BITS, top + STEP)
    leaves = found[0]
    for more in found[1:]:
        leaves = leaves.unionByName(more)
    pages = F.when(F.col("weight") <= limit, 1).when(F.col("entries") == 1, 1).otherwise(F.ceil(2 * F.col("weight") / limit))
    return scratch.write(leaves.select(F.col("depth").cast("int").alias("depth"), "prefix", "weight", "entries", pages.cast("int").alias("pages")), "directory")


def place(keyed: DataFrame, directory: DataFrame, *, broadcast: bool = False) -> DataFrame:
    """Adds the columns of its bucket to each row of `keyed` (key).

    The directory is spread over the cells of its most common depth, or a lesser one with at most about
    eight cells to a bucket, so a row finds its bucket by one equality join; a cell that was split further
    holds an array of its buckets. `broadcast` is for directories whose size the caller has checked.
    """
    common = directory.groupBy("depth").count().orderBy(F.desc("count"), "depth").collect()  # a row a depth
    level = min(common[0]["depth"], 3 + math.ceil(math.log2(sum(r["count"] for r in common)))) if common else 0
    leaf = F.struct(*directory.columns).alias("leaf")
    wide = directory.where(F.col("depth") <= level).select(F.explode(F.expr(f"sequence(shiftleft(prefix, {level} - depth), shiftleft(prefix + 1, {level} - depth) - 1)")).alias("cell"), leaf)
    deep = directory.where(F.col("depth") > level).select(F.expr(f"shiftright(prefix, depth - {level})").alias("cell"), leaf)
    cells = wide.unionByName(deep).groupBy("cell").agg(F.collect_list("leaf").alias("leaves"))
    joined = keyed.withColumn("cell", prefix(F.col("key"), level)).join(F.broadcast(cells) if broadcast else cells, "cell")
    own = F.expr(f"filter(leaves, x -> x.prefix = shiftright(key, {KEY_BITS} - x.depth))[0]")
    return joined.withColumn("leaf", own).select(*(keyed[c] for c in keyed.columns), "leaf.*")
