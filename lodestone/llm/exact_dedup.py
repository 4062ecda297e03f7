"""Exact deduplication over an extendible-hash index in shared files, with DataFrame functions alone.

Fingerprints (hash, digest and size) of all rows go to shared files. A directory over the hashes doubles
where a bucket is overfull, and a bucket of one hash that is still overfull has pages. Owner tasks take
ranges of buckets: each chains the texts of equal hash and tells them apart by their bytes, and writes the
entries of its range, sorted, to shared files. Rows on pages are combined page by page before they reach
their owner, so no group of copies is hot. Fingerprints are looked up with the owner that the directory
gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import extendible
from lodestone.llm.common import Scratch, ascii_lower

#: Bytes of rows that a bucket holds, and what a row has beside its text.
BUCKET_BYTES, ROW_BYTES = 64 << 20, 64
#: Buckets hold more than that rather than that a directory has many more of them than this, since every task gets it.
DIRECTORY_BUCKETS = 1 << 17


def hash_key(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - extendible.KEY_BITS)


def owned(directory: DataFrame, limit: int) -> DataFrame:
    """The directory with the first owner of each bucket, by running weight in the order of keys, and how many pages of `limit` it has.

    One task sorts it, which its bound on buckets allows.
    """
    place = Window.orderBy(F.expr(f"shiftleft(prefix, {extendible.KEY_BITS} - depth)")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("weight").over(place), F.lit(0))
    return directory.withColumns({"owner": (before / limit).cast("int"), "pages": F.ceil(F.col("weight") / limit).cast("int")})


def placed(keyed: DataFrame, directory: DataFrame) -> DataFrame:
    """`keyed` (doc_id, key, ...) with bucket, owner, pages, and the page of the row."""
    found = extendible.place(keyed, directory, broadcast=directory.count() <= 4 * DIRECTORY_BUCKETS)
    page = F.pmod(F.xxhash64("doc_id"), F.col("pages")).cast("int").alias("page")
    return found.select(*keyed.columns, F.concat_ws("-", "depth", "prefix").alias("bucket"), "owner", "pages", page)


def build_index(rows: DataFrame, directory: DataFrame, owners: int, scratch: Scratch) -> DataFrame:
    """The index of `rows` (doc_id, folded): bucket, owner, pages, key, digest, keep_id (largest id) and group_size of each distinct text."""
    texts = placed(rows.withColumn("key", hash_key(F.col("folded"))), directory)
    names = ("owner", "bucket", "pages", "key", "folded")
    single = texts.where("pages = 1").select(*names, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    if not directory.where("pages > 1").isEmpty():
        combined = texts.where("pages > 1").groupBy(*names, "page").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        single = single.unionByName(combined.drop("page"))
    chains = single.repartitionById(owners, F.col("owner")).groupBy(*names).agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    digest = F.unhex(F.sha2("folded", 256)).alias("digest")
    return scratch.write(chains.select("owner", "bucket", "pages", "key", digest, "keep_id", "group_size").sortWithinPartitions("owner", "key"), "index")


def exact_dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest (sha256 of the folded text).

    Texts are equal if identical after lower-casing A-Z alone; null counts as empty. The largest id of a
    group stays; rows that repeat that id all stay. An id that is null is never larger than another. An
    empty table gives no row; other columns are not read; texts are compared whole, however long.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "exact")
    rows = df.select(F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("folded"))
    weight = (F.octet_length("folded") + ROW_BYTES).cast("long").alias("weight")
    prints = scratch.write(rows.select("doc_id", hash_key(F.col("folded")).alias("key"), F.unhex(F.sha2("folded", 256)).alias("digest"), weight), "prints")
    total = prints.agg(F.sum("weight")).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = max(1, min(bucket_bytes, total // tasks), total // DIRECTORY_BUCKETS)
    directory = scratch.write(owned(extendible.build(prints.select("key", "weight"), limit, scratch), limit), "owners")
    index = build_index(rows, directory, total // limit + 1, scratch)
    scratch.keep("prints", "owners", "index")
    at = ["owner", "page", "key", "digest"]
    paged = index.withColumn("page", F.explode(F.sequence(F.lit(0), F.col("pages") - 1))).select(*at, "keep_id", "group_size")
    found = placed(prints.drop("weight"), directory).join(paged, at)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


ORACLE = """
WITH f AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM f WINDOW w AS (PARTITION BY t)
"""
