"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import json

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import bpe, exact_dedup, langid, license_scan, line_dedup, near_dedup, packing, sharding, token_count

LONG = "word another third " * 90_000  # more than a chunk
ROWS = [(1, None), (2, ""), (3, "Hello World"), (4, "hello world"), (4, "hello world"), (5, LONG), (6, "x" * 50_000), (7, " \n\n\t "), (None, "No id here"), (8, "日本語 é ½ <|endoftext|> <s>")]
WORDS, BYTES, PIECES = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def docs(spark, rows=ROWS):
    """With columns whose names operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({name: F.lit("clash") for name in ("row", "ids", "key", "band", "hub", "n_tokens", "position", "shard", "score")})


def empty(spark):
    return docs(spark, [])


def test_ids_are_integers(spark):
    texts = spark.createDataFrame([("a", "one")], "doc_id string, text string")
    for operator in (lambda df: packing.pack(df, WORDS), lambda df: bpe.round_trip(df, BYTES), lambda df: token_count.count_tokens(df, PIECES), near_dedup.near_groups, license_scan.scan_licenses):
        with pytest.raises(TypeError, match="must hold integers"):
            operator(texts)
    small = spark.createDataFrame([(1, "one two"), (None, "one two")], "doc_id short, text string")
    assert [r["component_id"] for r in near_dedup.near_groups(small).collect()] == [1, 1]
    assert sharding.assign_shards(texts, 10).count() == exact_dedup.exact_dedup(texts).count() == line_dedup.dedup_lines(texts).count() == 1


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_packing(spark):
    pieces = packing.pack(docs(spark), WORDS, length=64).collect()
    encoder = Tokenizer.from_file(WORDS)
    per = {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"] or 0, p["sequence_id"], p["offset"])):
        per.setdefault(p["doc_id"], []).append(p)
    for doc, text in ROWS:
        want = len(encoder.encode(text or "", add_special_tokens=False).ids) + 1
        assert {p["doc_tokens"] for p in per[doc]} == {want}
        assert sum(p["length"] for p in per[doc]) == want * [d for d, _ in ROWS].count(doc)
    assert packing.pack(empty(spark), WORDS).collect() == []


def test_packing_keeps_the_curve_in_a_heavy_cell(spark):
    words = "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system program question work".split()
    base = " ".join(words * 40)
    rows = [(i, base if i % 4 == 0 else f"{base} {words[i % 28]} {words[i // 28 % 28]}") for i in range(120)]
    rows += [(1000 + i, f"{words[i % 28]} {i} {words[i * 5 % 28]} !?" * (1 + i % 5)) for i in range(100)]
    df = docs(spark, rows)
    table = packing.tokenised(df.select("doc_id", "text"), WORDS, 1, 7).orderBy("doc_id").toArrow().combine_chunks().to_batches()[0]
    at = [table.column(f"c{k}").to_numpy() for k in range(packing.DIMS)]
    keys = packing.Curve([x.mean() for x in at], [x.std() for x in at]).keys(table)
    cells, tokens = {}, table.column("n_tokens").to_pylist()
    for key, n in zip(keys.tolist(), tokens, strict=True):
        cells.setdefault(key >> 33, {}).setdefault(key, []).append(n)
    heavy = max(cells.values(), key=lambda own: sum(map(sum, own.values())))
    assert sum(map(sum, heavy.values())) > sum(tokens) / 4 and len(heavy) > 20
    key_of = dict(zip(table.column("doc_id").to_pylist(), keys.tolist(), strict=True))
    pieces = sorted(packing.pack(df, WORDS, length=256).collect(), key=lambda p: (p["sequence_id"], p["offset"]))
    order = [key_of[p["doc_id"]] for p in pieces]
    assert order == sorted(order) and sum(p["length"] for p in pieces) == sum(tokens)


def test_bpe(spark):
    coded = bpe.decode_documents(bpe.encode_documents(docs(spark), BYTES), BYTES).collect()
    assert sorted(map(repr, coded)) == sorted(map(repr, bpe.round_trip(docs(spark), BYTES).collect()))
    library, texts = Tokenizer.from_file(BYTES), {}
    for doc, text in ROWS:
        texts[doc] = text or ""
    assert len(coded) == len(ROWS)
    for r in coded:
        assert r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["decoded"] == texts[r["doc_id"]]
    assert bpe.decode_documents(bpe.encode_documents(empty(spark), BYTES), BYTES).collect() == []


def test_token_count(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {doc: text or "" for doc, text in ROWS}
    counts = token_count.over_limit(token_count.count_tokens(docs(spark), PIECES), 4096).collect()
    assert len(counts) == len(ROWS)
    for r in counts:
        text = texts[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(library.encode(text)))
        assert r["over_limit"] == (r["n_tokens"] > 4096)
    assert token_count.count_tokens(empty(spark), PIECES).collect() == []


def test_sharding(spark):
    found = sharding.assign_shards(docs(spark), 1000).collect()
    assert len(found) == len(ROWS)
    sizes = {}
    for r in found:
        sizes.setdefault(r["shard"], []).append(r["n_bytes"])
    assert all(sum(x) <= 1000 or len(x) == 1 for x in sizes.values())
    assert sharding.assign_shards(empty(spark), 1000).collect() == []


def test_sharding_of_one_key(spark):
    rows = [(1, "x" * 100)] * 200 + [(2, "y")]
    found = sharding.assign_shards(docs(spark, rows), 1000).collect()
    sizes = {}
    for r in found:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["n_bytes"]
    assert len(found) == 201 and len(sizes) > 20 and max(sizes.values()) <= 2000


def test_sharding_holds_the_limit_within_one_key(spark, tmp_path):
    """Pages hold the limit itself, sums are those of the page, and what is written has the same shards."""
    sizes = [600] * 30 + [1500] + [i % 97 for i in range(6000)] + [500, 501, 499, 1000, 1001]
    rows = [(1, "x" * n) for n in sizes] + [(None, "z" * 400)] * 5 + [(2, "y"), (3, None)]
    df = docs(spark, rows).repartition(3)
    found = sharding.write_shards(df, f"file://{tmp_path}/shards", 1000).collect()
    held = {}
    for r in found:
        held.setdefault(r["shard"], []).append(r)
    assert len(found) == len(rows) and sorted(r["n_bytes"] for r in found if r["doc_id"] == 1) == sorted(sizes)
    for own in held.values():
        total = sum(r["n_bytes"] for r in own)
        assert total <= 1000 or len(own) == 1
        assert all((r["shard_bytes"], r["shard_docs"]) == (total, len(own)) for r in own)
    back = spark.read.parquet(f"file://{tmp_path}/shards").groupBy("__shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n"), F.count(F.lit(1)).alias("docs"))
    assert {r["__shard"]: (r["n"], r["docs"]) for r in back.collect()} == {k: (own[0]["shard_bytes"], len(own)) for k, own in held.items()}


def test_write_shards(spark, tmp_path):
    path = f"file://{tmp_path}/shards"
    df = spark.range(200).selectExpr("id AS doc_id", "repeat('a', 100) AS text")
    sharding.write_shards(df, path, 4000)
    back = spark.read.parquet(path)
    assert back.count() == 200
    assert max(r["n"] for r in back.groupBy("__shard").agg(F.sum(F.length("text")).alias("n")).collect()) <= 4000


def test_langid(spark):
    train = spark.createDataFrame([(i, "the quick brown fox and the dog" if i % 2 else "der schnelle braune fuchs und der hund", "en" if i % 2 else "de") for i in range(40)] + [(50, None, "en"), (51, "x", None)], "doc_id long, text string, lang string")
    profiles = langid.fit(train)
    assert profiles.languages == ["de", "en"]
    found = by_id(langid.predict(docs(spark, [(1, None), (2, ""), (3, "123 !!"), (4, "the dog and the fox"), (5, "der hund und der fuchs"), (6, "the dog " * 20_000)]), profiles))
    assert [found[i]["lang_pred"] for i in range(1, 7)] == ["und", "und", "und", "en", "de", "en"]
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert langid.predict(empty(spark), profiles).collect() == []
    nothing = langid.fit(train.where("false"))
    assert {r["lang_pred"] for r in langid.predict(train.drop("lang"), nothing).collect()} == {"und"}
    marked = langid.annotate(docs(spark), profiles)
    assert marked.count() == len(ROWS) and set(docs(spark).columns) < set(marked.columns)


def test_langid_of_many_labels(spark):
    """Labels beyond the bound, those of fewest rows, are not learned."""
    rows = [(i, "the quick brown fox" if i % 2 else "der schnelle fuchs", "en" if i % 2 else "de") for i in range(40)] + [(100 + i, f"zz {i}", f"label {i}") for i in range(30)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(train, max_languages=2).languages == ["de", "en"]
    assert langid.fit(train, max_languages=3).languages == ["de", "en", "label 0"]


def test_langid_knows_letters_of_all_planes(spark):
    assert all((langid.slots()[code] > 0) == chr(code).isalpha() for code in [*range(0x2FF00, 0x34000), 0x10FFFF])
    train = spark.createDataFrame([(i, "\U00030000\U00030123\U000313AF" if i % 2 else "der hund und die katze", "zh" if i % 2 else "de") for i in range(20)], "doc_id long, text string, lang string")
    found = langid.predict(docs(spark, [(1, "\U00030000\U00030123\U000313AF \U00030000")]), langid.fit(train)).first()
    assert found["lang_pred"] == "zh" and found["score"] > 0


def test_exact_dedup(spark):
    found = exact_dedup.exact_dedup(docs(spark)).collect()
    assert len(found) == len(ROWS)
    hello = [r for r in found if r["digest"] == hashlib.sha256(b"hello world").digest()]
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in hello} == {(3, 4, 3, False), (4, 4, 3, True)}
    assert {(r["doc_id"], r["keep_id"]) for r in found if r["group_size"] == 2} == {(1, 2), (2, 2)}
    assert exact_dedup.exact_dedup(empty(spark)).collect() == []


def test_exact_dedup_folds_ascii_alone(spark):
    found = by_id(exact_dedup.exact_dedup(docs(spark, [(1, "É A"), (2, "é a"), (3, "É a")])))
    assert {d: r["keep_id"] for d, r in found.items()} == {1: 3, 2: 2, 3: 3}


@pytest.mark.parametrize("keys", [1, 3, None])
def test_exact_dedup_in_chains_and_on_pages(spark, monkeypatch, keys):
    """Texts that share a hash are told apart by their bytes; a group of copies beyond a bucket has pages."""
    if keys:
        monkeypatch.setattr(exact_dedup, "hash_key", lambda text: F.length(text) % keys + (1 << 58))
    rows = [(i, "Copy " * 40 if i % 3 == 0 else f"text {i % 300}" + "x" * (i % 7)) for i in range(1500)] + [(None, "Copy " * 40), (9000, None), (9001, "")]
    groups = {}
    for i, text in rows:
        groups.setdefault((text or "").lower(), []).append(i)
    wanted = sorted((i or -1, max(x or -1 for x in own), len(own), i == max(x or -1 for x in own)) for own in groups.values() for i in own)
    found = exact_dedup.exact_dedup(docs(spark, rows), bucket_bytes=4000).collect()
    assert sorted((r["doc_id"] or -1, r["keep_id"], r["group_size"], r["kept"]) for r in found) == wanted


def test_exact_dedup_owners_hold_ranges_of_keys(spark):
    from lodestone.llm import extendible
    from lodestone.llm.common import Scratch

    scratch = Scratch(spark, "test")
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 700).alias("folded"))
    keyed = scratch.write(rows.select(exact_dedup.hash_key(F.col("folded")).alias("key"), F.lit(10).cast("long").alias("weight")), "keyed")
    directory = exact_dedup.owned(extendible.build(keyed, 1000, scratch), 1000)
    index = exact_dedup.build_index(rows, directory, 21, scratch).collect()
    assert len(index) == 700 and sum(r["group_size"] for r in index) == 2000
    order = sorted(index, key=lambda r: r["key"])
    assert [r["owner"] for r in order] == sorted(r["owner"] for r in order) and len({r["owner"] for r in order}) > 10


def test_near_dedup(spark):
    found = near_dedup.near_groups(docs(spark)).collect()
    assert len(found) == len(ROWS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found}
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[7] == (0, 7, True)
    assert got[3] == (1, 3, True) and got[4] == (1, 3, False)
    assert got[5] == (3, 5, True) and got[6] == (1, 6, True)
    assert near_dedup.near_groups(empty(spark)).collect() == []


def line_rows(n):
    boiler = "This very line stands in many documents, word for word."
    return [(i, f"own line {i}\n  {boiler.upper()}\t\nend {i}\n{boiler}") for i in range(n)]


def test_line_dedup(spark):
    found = by_id(line_dedup.dedup_lines(docs(spark, line_rows(6) + [(9, None), (10, ""), (11, "short\nshort")])))
    for i in range(5):
        assert (found[i]["__n_lines"], found[i]["__n_dropped"], found[i]["__kept"]) == (4, 2, f"own line {i}\nend {i}")
    assert found[5]["__n_dropped"] == 0 and found[5]["__kept"] == line_rows(6)[5][1]
    assert [(found[i]["__n_lines"], found[i]["__kept"]) for i in (9, 10)] == [(1, ""), (1, "")]
    assert all(r["row"] == "clash" for r in found.values())
    assert line_dedup.dedup_lines(empty(spark)).collect() == []
    few = by_id(line_dedup.dedup_lines(docs(spark, line_rows(4) + [line_rows(4)[0]] * 3)))
    assert all(r["__n_dropped"] == 0 for r in few.values())  # repeated rows are one document


def test_line_dedup_of_long_text(spark):
    boiler = "another line that is shared by more than five documents"
    rows = [(i, f"{boiler}\n" * 3000 + f"tail {i}") for i in range(6)]
    found = by_id(line_dedup.dedup_lines(docs(spark, rows)))
    assert found[0]["__n_dropped"] == 3000 and found[0]["__kept"] == "tail 0" and found[5]["__n_dropped"] == 0


def test_license_scan(spark):
    rows = [(1, "All rights RESERVED. cc by; all rights reserved"), (2, None), (3, ""), (4, "permission is hereby granted, free of any charge, to any person obtaining a copy"), (5, "nothing at all"), (5, "nothing at all"), (6, "a " * 30_000 + "General Public License")]
    found = {}
    for r in license_scan.scan_licenses(docs(spark, rows)).collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert len(found[5]) == 2
    one = found[1][0]
    assert (one["n_words"], one["n_base"], one["first_word"], one["last_word"], one["base_labels"], one["score"]) == (8, 3, 0, 5, "cc-by,reserved", 1.0)
    assert found[2][0]["n_words"] == 0 and found[3][0]["labels"] == "" and found[2][0]["first_word"] is None
    assert found[4][0]["labels"] == "mit" and 0.75 <= found[4][0]["score"] < 1 and found[4][0]["n_base"] == 0
    assert found[6][0]["first_word"] == 30_000
    assert license_scan.scan_licenses(empty(spark)).collect() == []


def test_license_scan_confirms_the_name(spark):
    wanted = [
        ("under the terms of the GNU General Public License", "gpl", 1.0),
        ("subject to the terms of the GNU General Public License", "gpl", 1.0),
        ("licensed under a Creative Commons Zero dedication", "", 0.0),
        ("under the terms of the GNU Lesser General Public License", "gpl,lgpl", 1.0),
        ("subject to the terms of the Mozilla Public License", "mpl", 1.0),
        ("under the terms of the new GNU Lesser General Public License", "gpl,lgpl", 1.0),
    ]
    found = by_id(license_scan.scan_licenses(docs(spark, [(i, text) for i, (text, _, _) in enumerate(wanted)])))
    assert [(found[i]["labels"], found[i]["score"]) for i in range(len(wanted))] == [(labels, score) for _, labels, score in wanted]
    lesser = by_id(license_scan.scan_licenses(docs(spark, [(1, "licensed under the GNU Lesser General Public License version 3")])))[1]
    assert [s["label"] for s in lesser["spans"] if s["last_word"] - s["first_word"] > 2] == []
    assert {s["label"] for s in license_scan.scan_licenses(docs(spark, [(1, text) for text, _ in license_scan.NOTICES[7:8]])).first()["spans"]} == {"gpl", "lgpl"}
    for text, label in license_scan.NOTICES:
        assert label in by_id(license_scan.scan_licenses(docs(spark, [(1, text)])))[1]["labels"].split(",")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_vocabularies_have_a_token_for_each_byte(name):
    vocab = json.load(open(public_tokenizers.path(name)))["model"]["vocab"]
    assert set(bpe.byte_letters()) <= set(vocab)


def test_pipeline_stages(spark):
    import corpus_pipeline

    texts = [(1, None, "en"), (2, "", "en"), (3, "the dog and the fox", None), (4, "1234", "de"), (5, "the dog and the cat and the bird", "en"), (6, "der hund und die katze", "de"), (6, "der hund und die katze", "de"), (None, "the cow and the hen", "en")]
    texts += [(i, f"the {i} dog and a fox of {i} hens" if i % 2 else f"der {i} hund und ein fuchs von {i} hennen", "en" if i % 2 else "de") for i in range(100, 120)]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({name: F.lit("clash") for name in ("__id", "__lang", "__kept", "__lines", "___id", "row", "band", "print", "key")})
    for rows in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, "").columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, rows, "").columns[:3] == ["doc_id", "start", "length"]
    kept = corpus_pipeline.language(spark, docs, "").collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 3, 5, 6, 6, *range(100, 120)]
    assert corpus_pipeline.lines(spark, docs, "").count() == len(texts)
    near = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r["doc_id"] or 0 for r in near) == [0, 1, 2, 3, 4, 5, 6, 6, *range(100, 120)]
