"""The corpus pipeline: language, repeated lines, near duplicates, then packing along the curve."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import langid, line_dedup, near_dedup, packing
from lodestone.llm.common import Scratch, clear_prefix

#: A document is rejected if it has no letters or its best cosine is below this.
LEAST_SCORE = 0.05


def keep_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is in `ids` (one column), NULL too."""
    ids = ids.toDF(f"{clear_prefix(docs)}id").distinct()
    return docs.join(ids.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(ids[ids.columns[0]]), "left_semi")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language. Null and empty texts, and those without letters, go; repeated rows are judged alike."""
    p = clear_prefix(docs)
    profiles = langid.fit(docs.where(langid.fold() != 1))
    found = langid.annotate(docs, profiles)
    return found.where((F.col(f"{p}lang") != langid.UNKNOWN) & (F.col(f"{p}score") >= LEAST_SCORE)).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that five or more share; all rows stay, null texts become empty."""
    kept = F.col(f"{clear_prefix(docs)}kept")
    kept = line_dedup.dedup_lines(docs).withColumns({"text": kept, "n_chars": F.char_length(kept).cast("long")})
    return kept.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates. Texts without words stay; rows that repeat a kept id all stay."""
    return keep_ids(docs, near_dedup.near_groups(docs).where("kept").select("doc_id"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), length=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("packing", packed)]

#: Language identification and packing have no SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents. A stage's table goes once the next one is written."""
    docs, scratch, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline"), ""
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = scratch.last
    pieces = STAGES[-1][1](spark, docs, sf_dir)
    scratch.drop()  # packing has tokenised its documents into a table of its own
    return pieces
