"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram binds the vectors of its letters, permuted by
their place, into a product; a document bundles (sums) the vectors of its trigrams; a language bundles
its documents. A document goes to the language of largest cosine.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lodestone.llm.common import chunks, clear_prefix, id_and_text, let_go, prepare_workers

SYMBOLS, SIZE, GROUP = 40, 1024, 48
#: Trigrams whose vectors are made at once.
BLOCK = 1024
#: What a row's hash is taken modulo to choose the sample.
GRAINS = 1 << 50
GRAMS = SYMBOLS**3
UNKNOWN = "und"


@lru_cache(maxsize=1)
def slots() -> np.ndarray:
    """The symbol of each code point: 0 for all but letters, 1 to 26 for a to z, a hashed one for others."""
    table = np.zeros(0x110000, np.int8)
    for code in range(len(table)):
        letter = chr(code)
        if letter.isalpha():
            base = ord(letter.lower()[0])
            table[code] = base - 96 if 97 <= base <= 122 else 27 + base * 2654435761 % 4294967291 % (SYMBOLS - 27)
    return table


@lru_cache(maxsize=1)
def letter_vectors(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of symbols at the end of a trigram, and the bound ones of the two before it."""
    letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SYMBOLS, SIZE))
    first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    return letters, (first[:, None] * second[None]).reshape(-1, SIZE)


def gram_vectors(grams: np.ndarray, seed: int) -> np.ndarray:
    """The bound vectors of some trigrams, from their symbols: a table of all would take 64 MB a worker."""
    letters, pairs = letter_vectors(seed)
    return pairs[grams // SYMBOLS] * letters[grams % SYMBOLS]


def gram_counts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The trigrams of each text and their counts. Runs of other characters are one word boundary."""
    wrapped = [f"\n{x}\n" for x in texts]
    codes = np.frombuffer("".join(wrapped).encode("utf-32-le", "replace"), "<u4")
    symbols = slots()[codes].astype(np.int32)
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in wrapped])
    keep = symbols > 0
    keep[1:] |= (symbols[:-1] > 0) | (owner[1:] != owner[:-1])
    keep[:1] = True
    symbols, owner = symbols[keep], owner[keep]
    grams = (symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:]
    ends = np.searchsorted(owner, np.arange(len(texts)), "right")
    found, start = [], 0
    for end in ends.tolist():
        own = np.bincount(grams[start : max(start, end - 2)], minlength=GRAMS)
        at = np.flatnonzero(own)
        found.append((at, own[at]))
        start = end
    return found


def vectors(texts: list[str], seed: int) -> np.ndarray:
    """The bundled vector of each text, of unit length; zero if it has no letters."""
    out = np.zeros((len(texts), SIZE), np.float32)
    for k in range(0, len(texts), GROUP):
        found = gram_counts(texts[k : k + GROUP])
        used = np.unique(np.concatenate([at for at, _ in found]))
        dense = np.zeros((len(found), len(used)), np.float32)
        for i, (at, counts) in enumerate(found):
            dense[i, np.searchsorted(used, at)] = counts
        for a in range(0, len(used), BLOCK):
            out[k : k + GROUP] += dense[:, a : a + BLOCK] @ gram_vectors(used[a : a + BLOCK], seed).astype(np.float32)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=out, where=length > 0)


@dataclass(frozen=True)
class Profiles:
    languages: list[str]
    prototypes: np.ndarray
    seed: int


def fit(labelled: DataFrame, *, per_language: int = 4000, max_languages: int = 1000, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Language prototypes from labelled rows; rows without a language or text are left out.

    At most about `per_language` rows of each language are used, chosen by a hash of their id, and the
    `max_languages` of most rows (ties by name): the bounds of the sample and of what the driver holds.
    Every vector counts alike and is rounded, so sums do not depend on their order.
    """
    prepare_workers(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages)
    share = {r["lang"]: min(1.0, per_language / r["count"]) for r in counts.collect()}
    if not share:
        return Profiles([], np.zeros((0, SIZE), np.float32), seed)
    grains = F.element_at(F.create_map(*(F.lit(x) for lang, part in share.items() for x in (lang, int(GRAINS * part)))), F.col("lang"))
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(GRAINS)) < grains)

    def run(batches):
        let_go()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in chunks(batch, "text"):
                rounded = np.rint(1000 * vectors(part.column("text").to_pylist(), seed)).astype(np.int64)
                for lang in set(langs := part.column("lang").to_pylist()):
                    sums[lang] = sums.get(lang, 0) + rounded[[x == lang for x in langs]].sum(axis=0)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([total.tolist()], pa.list_(pa.int64()))], ["lang", "total"])

    partial = chosen.select("text", "lang").mapInArrow(run, "lang string, total array<long>")
    sums = partial.select("lang", F.posexplode("total").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    languages = sorted(share)
    prototypes = np.zeros((len(languages), SIZE))
    for r in sums.collect():
        prototypes[languages.index(r["lang"]), r["k"]] = r["x"]
    lengths = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return Profiles(languages, (prototypes / np.maximum(lengths, 1e-9)).astype(np.float32), seed)


def judge(texts: list[str], profiles: Profiles) -> tuple[list[str], np.ndarray]:
    """The language of each text and its cosine, cut to 0..1."""
    found = vectors(texts, profiles.seed)
    if not profiles.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    cosines, known = found @ profiles.prototypes.T, found.any(axis=1)
    langs = [profiles.languages[b] if k else UNKNOWN for b, k in zip(cosines.argmax(axis=1).tolist(), known.tolist(), strict=True)]
    return langs, np.where(known, np.clip(cosines.max(axis=1).astype(np.float64), 0, 1), 0)


def predict(df: DataFrame, profiles: Profiles, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred and score (the cosine, cut to 0..1), from the whole text alone.

    Null or empty texts and those without letters, and all texts if no language was learned, get `und`
    and 0. Of languages that tie, the first by name wins. Repeated rows each give a row; other columns
    are not read; an empty table gives an empty result.
    """

    def run(batches):
        let_go()
        for batch in batches:
            for part in chunks(batch, "text"):
                langs, scores = judge(part.column("text").to_pylist(), profiles)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def annotate(df: DataFrame, profiles: Profiles, *, text_col: str = "text") -> DataFrame:
    """All columns of `df` with __lang and __score, as predict() has them, in one pass and without a join.

    Where columns of `df` begin with `__`, more underscores are put before the added ones (common.clear_prefix).
    """
    prepare_workers(df.sparkSession)
    added = [f"{clear_prefix(df)}{name}" for name in ("lang", "score")]

    def run(batches):
        let_go()
        for batch in batches:
            texts = batch.column(text_col)
            whole = batch.set_column(batch.schema.get_field_index(text_col), text_col, pa.compute.fill_null(texts, ""))
            at = 0
            for part in chunks(whole, text_col):
                langs, scores = judge(part.column(text_col).to_pylist(), profiles)
                rows = batch.slice(at, part.num_rows)
                at += part.num_rows
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*rows.schema.names, *added])

    schema = StructType([*df.schema.fields, StructField(added[0], StringType()), StructField(added[1], DoubleType())])
    return df.mapInArrow(run, schema)


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3: rows with 1 are held out."""
    return F.crc32(F.col(id_col).cast("string")) % 3
