"""License scans by diagonal voting.

All rolling word k-grams of the documents are hashed and joined with the positions that templates have
them at; of what joins, the words themselves are compared. A hit votes for the diagonal document position -
template position; neighbouring diagonals of a template merge (words put in or left out), and a span is
verified by how much of its template it covers and by the words that name the license, which related
notices lack.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import chunks, id_and_text
from lodestone.llm.words import ALPHANUMERIC, phrase, span_hashes, windows, words_of

K = 2
#: Diagonals as near as this merge.
GAP = 3
#: Places of a template that one number holds as bits.
BITS = 62
#: Templates are broadcast up to so many k-grams.
BROADCAST_GRAMS = 100_000
#: The phrases whose every place counts, and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Notices that the method looks for beside them.
NOTICES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("licensed under the gnu general public license version 3", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or "
        "other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other "
        "dealings in the software",
        "mit",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy "
        "of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under "
        "the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the "
        "specific language governing permissions and limitations under the license",
        "apache-2.0",
    ),
]
#: What tells a notice from related ones: a span holds a k-gram of it with these words. The other notices name nothing.
NAMING = {
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache",
    "licensed under cc by nc 4 0": "nc",
    "licensed under cc by sa 4 0": "sa",
    "licensed under a creative commons attribution": "attribution",
    "licensed under the gnu general public license version 3": "gnu general",
    "under the terms of the gnu lesser general public license": "lesser",
    "subject to the terms of the mozilla public license": "mozilla",
}


def template_rows(phrases, notices, naming) -> list[tuple]:
    """template, label, base, place, size, words, names (whether the words of `naming` are among them), named (whether some must be): a row for each k-gram of each template."""
    rows = []
    for number, (text, label, base) in enumerate([(*x, True) for x in phrases] + [(*x, False) for x in notices]):
        words, name = text.split(), None if base else naming.get(text)
        grams = [" ".join(words[i : i + K]) for i in range(len(words) - K + 1)]
        names = [name is not None and f" {name} " in f" {gram} " for gram in grams]
        if not grams:
            raise ValueError(f"a template has {K} words at least: {text!r}")
        if name is not None and not any(names):
            raise ValueError(f"no {K} words of {text!r} hold {name!r}")
        rows += [(number, label, base, place, len(grams), gram, own, name is not None) for place, (gram, own) in enumerate(zip(grams, names, strict=True))]
    return rows


def template_grams(spark, phrases, notices, naming) -> DataFrame:
    """The rows of the templates with the hash of each k-gram; broadcast only as far as their number allows."""
    rows = [(int(windows(phrase(row[5]), K).astype(np.int64)[0]), *row) for row in template_rows(phrases, notices, naming)]
    table = spark.createDataFrame(rows, "gram long, template int, label string, base boolean, place int, size int, words string, names boolean, named boolean")
    return F.broadcast(table) if len(rows) <= BROADCAST_GRAMS else table


def document_grams(df: DataFrame) -> DataFrame:
    """doc_id, row, n_words and all k-grams of each whole text: their hashes and their words, a space between."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                data, starts, ends, first = words_of(part.column("text"), ALPHANUMERIC)
                grams = windows(span_hashes(data, starts, ends), K)
                counts = np.diff(first)
                own = np.maximum(counts - K + 1, 0)
                bounds = np.cumsum(np.concatenate([[0], ends - starts])).astype(np.int32)
                words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data[ALPHANUMERIC[data]]))
                told = pc.binary_join_element_wise(*(words.slice(k, len(grams)) for k in range(K)), " ") if len(grams) else words.slice(0, 0)
                # the k-grams that reach into the next text go
                owner = np.repeat(np.arange(len(counts)), counts)
                whole = owner[: len(grams)] == owner[K - 1 :] if len(grams) else np.zeros(0, bool)
                pairs = pa.StructArray.from_arrays([pa.array(grams[whole].astype(np.int64)), told.filter(pa.array(whole))], ["gram", "words"])
                values = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *own]), pa.int32()), pairs)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("row"), pa.array(counts), values], ["doc_id", "row", "n_words", "grams"])

    return df.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, "doc_id long, row long, n_words long, grams array<struct<gram:long,words:string>>")


def scan_licenses(df: DataFrame, *, phrases=PHRASES, notices=NOTICES, naming=NAMING, least_cover: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z folded. A base
    phrase counts at each place where it stands whole; a notice labels a document where merged diagonals
    cover `least_cover` of it and hold the words of `naming`, if it has some. score is the largest cover (1 for a base phrase). spans: label, first and
    last word and cover of what was verified. Null and empty texts have no words; repeated rows each give
    a row; an empty table gives none; other columns are not read; texts are read whole.
    """
    templates = template_grams(df.sparkSession, phrases, notices, naming)
    grams = document_grams(id_and_text(df, id_col, text_col)).select("doc_id", "row", "n_words", F.posexplode_outer("grams").alias("position", "found"))
    same = (F.col("found.gram") == templates["gram"]) & (F.col("found.words") == templates["words"])
    hits = grams.join(templates, same, "left").withColumn("diagonal", F.col("position") - F.col("place"))
    # the places seen are bits, BITS of them to a part of the template
    hits = hits.withColumns({"part": F.floor(F.col("place") / BITS), "seen": F.expr(f"shiftleft(1L, place % {BITS})")})
    keys = ["doc_id", "row", "n_words", "template", "label", "base", "size", "named"]
    votes = hits.groupBy(*keys, "diagonal", "part").agg(F.bit_or("seen").alias("seen"), F.max("names").alias("names"), F.min("position").alias("first"), F.max("position").alias("last"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    # base phrases stand exactly, so their diagonals never merge
    fresh = F.col("diagonal") - F.lag("diagonal").over(order) > F.when(F.col("base"), 0).otherwise(GAP)
    islands = votes.withColumn("island", F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(order))
    ends = (F.max("names").alias("names"), F.min("first").alias("first"), F.max("last").alias("last"))
    parts = islands.groupBy(*keys, "island", "part").agg(F.bit_or("seen").alias("seen"), F.min("diagonal").alias("start"), *ends)
    spans = parts.groupBy(*keys, "island").agg(F.sum(F.bit_count("seen")).alias("seen"), F.min("start").alias("start"), *ends)
    cover = F.col("seen") / F.col("size")
    whole = F.col("base") & (cover == 1)
    found = spans.withColumn("cover", cover).withColumn("whole", F.coalesce(whole, F.lit(False)))
    notice = ~F.col("base") & (F.col("cover") >= least_cover) & (F.col("names") | ~F.col("named"))
    found = found.withColumn("verified", F.col("whole") | F.coalesce(notice, F.lit(False)))
    span = F.struct("label", F.col("first").cast("long").alias("first_word"), (F.col("last") + K - 1).cast("long").alias("last_word"), "cover")
    names = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(F.col(when), F.col("label")))), ",")
    return found.groupBy("row", "doc_id", "n_words").agg(
        F.count_if("whole").alias("n_base"),
        F.min(F.when(F.col("whole"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("whole"), F.col("start"))).cast("long").alias("last_word"),
        names("whole").alias("base_labels"),
        names("verified").alias("labels"),
        F.coalesce(F.max(F.when(F.col("verified"), F.col("cover"))), F.lit(0.0)).alias("score"),
        F.collect_list(F.when(F.col("verified"), span)).alias("spans"),
    ).drop("row")


def oracle(phrases=PHRASES, notices=NOTICES, naming=NAMING, least_cover: float = 0.75) -> str:
    """The same in DuckDB, over the words themselves."""
    rows = []
    for number, label, base, place, size, words, names, named in template_rows(phrases, notices, naming):
        one, two = words.split()
        rows.append(f"({number}, '{label}', {base}, {place}, {size}, '{one}', '{two}', {names}, {named})")
    return rf"""
WITH tpl(template, label, base, place, size, w1, w2, names, named) AS (VALUES {", ".join(rows)}),
t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
g AS (SELECT doc_id, unnest(ws) AS w1, unnest(range(len(ws))) AS pos FROM t),
h AS (SELECT *, lead(w1) OVER (PARTITION BY doc_id ORDER BY pos) AS w2 FROM g),
v AS (SELECT doc_id, template, label, base, size, named, names, place, pos - place AS diagonal FROM h JOIN tpl USING (w1, w2)),
f AS (SELECT *, CASE WHEN NOT base AND diagonal - lag(diagonal) OVER o <= {GAP} THEN 0 ELSE 1 END AS fresh
      FROM (SELECT DISTINCT doc_id, template, base, diagonal FROM v) WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
i AS (SELECT doc_id, template, diagonal, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS island FROM f),
s AS (SELECT doc_id, label, base, named, bool_or(names) AS names, count(DISTINCT place) / size AS cover, min(diagonal) AS start
      FROM v JOIN i USING (doc_id, template, diagonal) GROUP BY doc_id, template, label, base, size, named, island),
k AS (SELECT *, base AND cover = 1 AS whole, CASE WHEN base THEN cover = 1 ELSE cover >= {least_cover} AND (names OR NOT named) END AS verified FROM s)
SELECT t.doc_id, len(any_value(ws)) AS n_words, count(*) FILTER (whole) AS n_base,
       min(start) FILTER (whole) AS first_word, max(start) FILTER (whole) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (verified), '') AS labels,
       coalesce(max(cover) FILTER (verified), 0.0) AS score
FROM t LEFT JOIN k USING (doc_id) GROUP BY t.doc_id
"""
