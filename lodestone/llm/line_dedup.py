"""Line deduplication with DataFrame functions alone.

Lines are exploded with their position, and the long ones hashed to 128 bits; documents are counted per
hash; positions that lose their line return to their document, which is reassembled by position. Only
hashes, ids and positions are grouped, so a line that a third of all documents share stays small, and it
combines before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ASCII_SPACE, Scratch, ascii_lower, clear_prefix


def line_keys(df: DataFrame, text: Column, least_chars: int) -> DataFrame:
    """Adds position and the hash of each line of at least `least_chars` code points, stripped and folded."""
    lines = df.select("*", F.posexplode(F.split(ascii_lower(text), "\n")).alias("position", "line"))
    lines = lines.withColumn("line", F.trim("line", F.lit(ASCII_SPACE))).where(F.char_length("line") >= least_chars)
    return lines.withColumns({"k1": F.xxhash64("line"), "k2": F.xxhash64(F.lit(17), "line")}).drop("line")


def dropped_positions(lines: DataFrame, least_documents: int, scratch: Scratch) -> DataFrame:
    """doc_id, print and the positions that go, of `lines` (doc_id, print, position, k1, k2).

    The common hashes are written first: with plain shuffles on both sides the join can split a hot hash.
    """
    documents = lines.select("k1", "k2", "doc_id").distinct()
    common = documents.groupBy("k1", "k2").agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= least_documents)
    common = scratch.write(common, "common")
    gone = lines.join(common, ["k1", "k2"]).where(F.col("doc_id") != F.col("last"))
    return gone.groupBy("doc_id", "print").agg(F.collect_set("position").alias("gone"))


def dedup_lines(df: DataFrame, *, least_chars: int = 40, least_documents: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `df` with __n_lines, __n_dropped and __kept, the text without its repeated lines.

    Lines end at \\n alone; null and empty texts are one empty line. A line of at least `least_chars` code
    points (stripped of ASCII white space, A-Z folded) found in `least_documents` documents goes, but from
    the largest id that holds it, which keeps all of its own. Rows that share an id are one document for
    the count. Rows without an id keep all lines. Ties cannot arise; empty tables give no row; other
    columns pass through whatever their names: where some begin with `__`, more underscores are put before
    the added ones (common.clear_prefix).
    """
    scratch, p = Scratch(df.sparkSession, "lines"), clear_prefix(df)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("print"), text.alias("text"))
    lines = line_keys(keyed, F.col("text"), least_chars).select("doc_id", "print", "position", "k1", "k2")
    gone = dropped_positions(scratch.write(lines, "lines"), least_documents, scratch)
    gone = gone.select(F.col("doc_id").alias(f"{p}id"), F.col("print").alias(f"{p}print"), F.col("gone").alias(f"{p}gone"))
    # split here, before the shuffle, so that the lambda below indexes an array at hand
    split = df.withColumns({f"{p}key": F.xxhash64(text), f"{p}lines": F.split(text, "\n")})
    joined = split.join(gone.hint("shuffle_hash"), (F.col(id_col) == F.col(f"{p}id")) & (F.col(f"{p}key") == F.col(f"{p}print")), "left")
    lost = F.coalesce(f"{p}gone", F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(f"{p}lines") - 1), lost)
    kept = F.when(F.col(f"{p}gone").isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(f"{p}lines", i)), "\n"))
    return joined.select(*(df[c] for c in df.columns), F.size(f"{p}lines").cast("long").alias(f"{p}n_lines"), F.size(lost).cast("long").alias(f"{p}n_dropped"), kept.alias(f"{p}kept"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
