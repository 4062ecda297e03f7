"""The registered queries on the smallest tables: SQL oracles where there are some, else their contracts."""

import hashlib
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import entry, langid, line_dedup, sharding
from tests.llm.test_methods import brute_components

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(entry.ORACLE_SQL))
def test_oracles(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(entry.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    df = entry.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("limit", [3000, 60_000])
def test_sharding_at_small_limits(spark, limit):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(sharding.ORACLE.format(limit=limit))
    names = [c[0] for c in want.description]
    found = sharding.assign_shards(spark.read.parquet(f"{SF}/documents.parquet"), limit).select(*names)
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall()) and found.select("shard").distinct().count() > 5


def check_packing(pieces, texts):
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    per, sequences = {}, {}
    for p in pieces:
        per.setdefault(p["doc_id"], []).append(p)
        sequences.setdefault(p["sequence_id"], []).append(p)
    assert set(per) == set(texts)
    for doc, own in per.items():
        ids = np.array([*encoder.encode(texts[doc], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 2048 or at & (at - 1) == 0


def test_packing(spark, documents):
    check_packing(entry.op1_packing(spark, SF).collect(), documents)


def test_sharding_is_read_from_written_shards(spark, documents):
    df = entry.op3_sharding(spark, SF)
    files = [f for f in df.inputFiles() if "/__shard=" in f]
    assert files and {f.split("/__shard=")[1].split("/")[0] for f in files} == {r["shard"] for r in df.collect()}
    back = spark.read.parquet(files[0].split("/__shard=")[0]).collect()
    assert {r["doc_id"]: r["text"] or "" for r in back} == documents and len(back) == len(documents)


def test_bpe(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in entry.op2_bpe(spark, SF).collect():
        ids = library.encode(documents[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(documents[r["doc_id"]].encode()).hexdigest()


def test_held_out_languages(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = [r for r in entry.op4_langid(spark, SF).collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in found) and len(found) > 20
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in found) >= 0.95 * len(found)


def brute_languages(rows, fitted):
    """Language and cosine of each (id, text), by the definition: a loop over letters, vectors bound and added one by one."""
    letters = np.random.default_rng(11).choice(np.array([-1, 1], np.int8), (langid.SYMBOLS, langid.SIZE)).astype(np.int64)
    bound = {}

    def vector(text):
        symbols = [0]
        for c in text:
            base = ord(c.lower()[0])
            symbol = 0 if not c.isalpha() else base - 96 if 97 <= base <= 122 else 27 + base * 2654435761 % 4294967291 % (langid.SYMBOLS - 27)
            symbols += [symbol] if symbol or symbols[-1] else []
        symbols += [0] if symbols[-1] else []
        total = np.zeros(langid.SIZE, np.int64)
        for gram, n in Counter(zip(symbols, symbols[1:], symbols[2:])).items():  # noqa: B905
            if gram not in bound:
                bound[gram] = np.roll(letters[gram[0]], 2) * np.roll(letters[gram[1]], 1) * letters[gram[2]]
            total += n * bound[gram]
        length = np.sqrt((total.astype(float) ** 2).sum())
        return total / length if length else total.astype(float)

    sums = {}
    for _, text, lang in fitted:
        sums[lang] = sums.get(lang, 0) + np.rint(1000 * vector(text))
    found = {}
    for doc, text in rows:
        own = vector(text)
        scores = {lang: own @ total / np.sqrt((total**2).sum()) for lang, total in sums.items()}
        best = max(sorted(scores), key=lambda lang: scores[lang])
        found[doc] = (best, min(1, max(0, scores[best]))) if own.any() else ("und", 0.0)
    return found


def labelled(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    return [(r["doc_id"], r["text"], r["lang"]) for r in rows if r["text"] is not None and r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]


def test_languages_against_brute_force(spark, documents):
    want = brute_languages(documents.items(), labelled(spark))
    for r in entry.op4_langid(spark, SF).collect():
        lang, score = want[r["doc_id"]]
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 2e-3  # prototypes are sums of rounded 32-bit vectors


def test_pipeline_against_brute_force(spark, documents):
    """All four stages again, in plain Python; of the packing, what its contract says."""
    langs = brute_languages(documents.items(), labelled(spark))
    assert all(lang == "und" or abs(score - corpus_pipeline.LEAST_SCORE) > 2e-3 for lang, score in langs.values())
    texts = {d: t for d, t in documents.items() if langs[d][0] != "und" and langs[d][1] >= corpus_pipeline.LEAST_SCORE}
    fold = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(line_dedup.ASCII_SPACE))
    holders = {}
    for d, t in texts.items():
        for line in t.split("\n"):
            holders.setdefault(fold(line), set()).add(d)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    texts = {d: "\n".join(x for x in t.split("\n") if gone.get(fold(x), d) == d) for d, t in texts.items()}
    texts = {d: texts[d] for d, (_, _, kept) in brute_components(list(texts.items())).items() if kept}
    pieces = corpus_pipeline.run(spark, SF).collect()
    check_packing(pieces, texts)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "packing"]
