"""Operators against brute force on random inputs, and the parts of their methods by themselves."""

import itertools
import os
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import ann, bpe, license_scan, near_dedup, packing, token_count
from lodestone.llm.words import ALPHANUMERIC, SPACED, word_hashes

PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = st.text(st.sampled_from(list(" \n\t'saebcéß<|>▁日1.² \x1c\x85İΣ")) | st.characters(exclude_categories=["Cs"]), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_token_counts_are_the_library_s(text):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert token_count.counter(PIECES).count(text) == len(library.encode(text))


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_byte_pairs_are_the_library_s(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.coder(path)
    ids = np.frombuffer(own.encode(text), "<i4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_words_are_the_library_s(text):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert np.frombuffer(packing.encoder(path).encode(text), "<u2").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_fragments_end_at_forced_boundaries():
    own = bpe.coder(public_tokenizers.path("byte_bpe_50k.json"))
    raw = "zqxjkzzq éàü%%%$$$".encode()
    pieces = own.cut(raw)
    assert b"".join(pieces) == raw and len(pieces) > 3
    assert all(not own.inside[a[-1], b[0]] for a, b in itertools.pairwise(pieces))


def test_hilbert_neighbours_touch():
    cube = np.array(list(itertools.product(range(8), repeat=3)))
    keys = packing.hilbert(cube, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = cube[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list(" \n\x0b\x1c.aBzé9²")), max_size=25), max_size=6))
def test_word_hashes(texts):
    hashes, first = word_hashes(pa.array(texts, pa.string()), SPACED)
    wanted = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in wanted]
    fold = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w)
    seen = {}
    for word, h in zip([fold(w) for ws in wanted for w in ws], hashes.tolist(), strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    _, first = word_hashes(pa.array(texts, pa.string()), ALPHANUMERIC)
    assert np.diff(first).tolist() == [len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))) for t in texts]


def brute_components(texts):
    sets = {}
    for d, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(sets, 2):
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if both and 100 * both >= 75 * either and root[a] != root[b]:
                low = min(root[a], root[b])
                high = max(root[a], root[b])
                root = {d: low if r == high else r for d, r in root.items()}
                changed = True
    return {d: (len(sets[d]), root[d], root[d] == d) for d in sets}


@pytest.mark.parametrize("tests_a_pair", [near_dedup.TESTS_A_PAIR, 0, 1e9])
def test_near_groups_against_brute_force(spark, monkeypatch, tests_a_pair):
    """Chains, stars, copies, contained texts, and groups where many members miss the hub; past it by joins alone, and by blocks alone."""
    monkeypatch.setattr(near_dedup, "TESTS_A_PAIR", tests_a_pair)
    monkeypatch.setattr(near_dedup, "STARS", 1 if tests_a_pair != near_dedup.TESTS_A_PAIR else near_dedup.STARS)
    rng, words = random.Random(4), [f"w{i}" for i in range(5000)]
    texts = []
    for _ in range(6):
        base = rng.choices(words, k=rng.choice([8, 30, 150]))
        current = base
        for _ in range(30):
            kind = rng.random()
            edited = list(base if kind < 0.6 else current)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            if kind > 0.9:
                edited = edited[: rng.randrange(3, len(edited))]
            current = edited
            texts.append(" ".join(edited))
    texts = list(enumerate(texts + ["", "one two", "One TWO", None]))
    rng.shuffle(texts)
    found = near_dedup.near_groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == brute_components(texts)


def test_past_the_hub_against_brute_force(spark, monkeypatch):
    """Members that share popular passages, of which none is linked to the hub and some are to each other."""
    rng = random.Random(9)
    pool = [[f"p{k}w{i}" for i in range(10)] for k in range(12)]
    texts = [(i, " ".join(w for k in sorted(rng.sample(range(12), 7)) for w in pool[k]) + f" own{i % 90}") for i in range(160)]
    wanted = brute_components(texts)
    assert 5 < len({root for _, root, _ in wanted.values()}) < 155
    for tests_a_pair in (0, 1e9):
        monkeypatch.setattr(near_dedup, "TESTS_A_PAIR", tests_a_pair)
        monkeypatch.setattr(near_dedup, "STARS", 1)
        found = near_dedup.near_groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == wanted


@pytest.mark.parametrize(("common", "one", "two"), [(3, 1, 0), (6, 1, 1), (15, 5, 0), (20, 3, 3), (15, 2, 3)])
def test_small_sets_always_meet(common, one, two):
    """At exactly three quarters, or little more, no pair with a set of at most SMALL shingles goes without a shared bucket."""
    rng = np.random.default_rng(1)
    for _ in range(1000):
        pool = rng.integers(0, 1 << 63, common + one + two, dtype=np.uint64) * np.uint64(2)
        a, b = np.sort(pool[: common + one]), np.sort(np.concatenate([pool[:common], pool[common + one :]]))
        assert min(len(a), len(b)) <= near_dedup.SMALL or common == 20
        assert np.intersect1d(near_dedup.bucket_keys(a, 75), near_dedup.bucket_keys(b, 75)).size


def test_words_with_equal_sums_have_own_hashes(spark):
    """The Thue-Morse word and its complement collide in every polynomial hash modulo 2^64."""
    one, two = "a", "b"
    for _ in range(10):
        one, two = one + two, two + one
    assert len(set(word_hashes(pa.array([one, two, one + two, two + one, "x" * 256, "x" * 257]), SPACED)[0].tolist())) == 6
    texts = [(1, f"{one} one two three four"), (2, f"{two} one two three four"), (3, one), (4, two), (5, f"{one} one two three four")]
    found = near_dedup.near_groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(0)
    data = rng.standard_normal((600, 12))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    bad = [(1000, None), (1001, [0.0] * 12), (1002, [float("nan")] + [1.0] * 11), (1003, [None] + [1.0] * 11), (1004, [1.0] * 3), (None, [1.0] * 12), (1020, [float("inf")] + [1.0] * 11)]
    df = spark.createDataFrame(rows + [rows[0]] + bad, "vec_id long, embedding array<double>")
    found = ann.search(df, lambda x: x % 20 == 0, k=20, sample_rows=300).collect()
    per = {}
    for r in found:
        per.setdefault(r["query_id"], []).append(r)
    assert set(per) == set(range(0, 600, 20))
    hit = 0
    for q, got in per.items():
        got.sort(key=lambda r: r["rank"])
        scores = data @ data[q]
        assert [r["rank"] for r in got] == list(range(1, 21)) and all(abs(r["score"] - scores[r["vec_id"]]) < 1e-9 and r["vec_id"] != q for r in got)
        assert got == sorted(got, key=lambda r: (-r["score"], r["vec_id"]))
        best = sorted((i for i in range(600) if i != q), key=lambda i: (-scores[i], i))[:20]
        hit += len({r["vec_id"] for r in got} & set(best))
    assert hit / 600 >= 0.9


def test_neighbours_among_thousands_of_copies_and_near_copies(spark):
    """Ties go to the smallest ids, and near-copies that share a code are told apart."""
    rng = np.random.default_rng(5)
    data = rng.standard_normal((9000, 12))
    data[rng.permutation(6000)[:3000]] = data[0]
    data[6000:] = data[1] + 1e-6 * rng.standard_normal((3000, 12))
    data /= np.sqrt((data**2).sum(axis=1))[:, None]
    copies = np.flatnonzero((data == data[0]).all(axis=1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    asked = [int(copies[700]), int(copies[3]), 6020, 8000]
    found = ann.search(df, lambda x: x.isin(asked), k=20, sample_rows=300).collect()
    got = {q: [(r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in asked}
    for q in asked[:2]:
        assert [i for i, _ in got[q]] == [i for i in copies.tolist() if i != q][:20]
    for q in asked[2:]:
        scores = (data * data[q]).sum(axis=1)
        best = sorted((i for i in range(len(data)) if i != q), key=lambda i: (-scores[i], i))[:20]
        assert [i for i, _ in got[q]] == best and [s for _, s in got[q]] == [scores[i] for i in best]


def brute_recall(data, found, asked, k=20):
    got, hit = {}, 0
    for r in found:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q in asked:
        scores = data @ data[q]
        scores[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-scores, kind="stable")[:k].tolist()))
    return hit / (k * len(asked))


def test_clustered_neighbours_need_few_cells(spark):
    """Recall of 0.9 at least, from a small part of the cells where the data have clusters."""
    rng = np.random.default_rng(8)
    data = rng.standard_normal((60, 16))[rng.integers(0, 60, 8000)] + 0.15 * rng.standard_normal((8000, 16))
    model = ann.fit(data[:4000], 89, 0.95, 20, 3)
    assert model.probes <= 0.25 * len(model.centres)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    found = ann.search(df, lambda x: x % 20 == 0, sample_rows=4000).collect()
    assert brute_recall(data, found, range(0, 8000, 20)) >= 0.9


def test_all_cells_probed_is_exact_search(spark, monkeypatch):
    """With a target of 1, against DuckDB; many small shelves, each read by blocks of few queries; rows that repeat ids and clash in names."""
    monkeypatch.setattr(ann, "SHELF_ROWS", 100)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(2)
    rows = [(i % 950, rng.integers(-8, 9, 8).astype(float).tolist()) for i in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df = df.selectExpr("*", *(f"'clash' AS {x}" for x in ("cell", "shelf", "block", "vector", "query_id", "code", "rank")))
    found = ann.search(df, lambda x: x % 20 == 0, k=20, target=1.0, sample_rows=300)
    con = duckdb.connect()
    con.execute("CREATE TABLE v (vec_id BIGINT, e DOUBLE[])")
    con.executemany("INSERT INTO v VALUES (?, ?)", rows)
    want = con.execute("""
        WITH valid AS (SELECT * FROM v WHERE list_max(list_transform(e, lambda x: abs(x))) > 0),
        q AS (SELECT vec_id, min(e) AS e FROM valid WHERE vec_id % 20 = 0 GROUP BY vec_id),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score FROM q JOIN valid c ON c.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER), vec_id, score FROM r WHERE rank <= 20""").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_recall_on_the_harness_vectors(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    df = spark.read.parquet(path)
    data = np.array([r["embedding"] for r in df.orderBy("vec_id").collect()])
    found = ann.search(df, lambda x: x % 20 == 0).collect()
    assert brute_recall(data, found, range(0, len(data), 20)) >= 0.9


def test_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 0.5]), (4, [0.5, -0.5])], "vec_id long, embedding array<double>")
    found = {}
    for r in sorted(ann.search(df, lambda x: x % 20 == 0).collect(), key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert found == {0: [(20, 1.0), (3, 0.5), (4, 0.5)], 20: [(0, 1.0), (3, 0.5), (4, 0.5)]}
    assert ann.search(df.where("false"), lambda x: x % 20 == 0).collect() == []


def test_base_phrases_against_brute_force(spark):
    rng = random.Random(2)
    words = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "é", "x"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(200)]
    found = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for doc, text in texts:
        got = text.split()
        places, labels = [], set()
        for phrase, label in license_scan.PHRASES:
            own = phrase.split()
            here = [i for i in range(len(got)) if got[i : i + len(own)] == own]
            places += here
            labels |= {label} if here else set()
        r = found[doc]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(got), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r["labels"].split(","))


def test_grams_carry_their_words(spark):
    texts = [(1, "CC-by; All  rights"), (2, ""), (3, "one"), (4, "é 日本 x"), (5, None)]
    rows = license_scan.document_grams(spark.createDataFrame(texts, "doc_id long, text string").fillna("")).collect()
    assert {r["doc_id"]: [g["words"] for g in r["grams"]] for r in rows} == {1: ["cc by", "by all", "all rights"], 2: [], 3: [], 4: ["é 日本", "日本 x"], 5: []}


def test_long_notices_against_sql(spark):
    """Notices of any length, with words left out, put in and changed, against the same in DuckDB."""
    rng, texts = random.Random(3), []
    for i in range(120):
        words = rng.choice(license_scan.NOTICES)[0].split()
        for _ in range(rng.choice([0, 1, 3, len(words) // 8, len(words) // 4])):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = rng.choice([[], ["other"], ["two", "more"]])
        texts.append((i, " ".join(["before", *words, "after"]).title() if i % 2 else " - ".join(words)))
    wanted = duckdb.connect()
    wanted.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    wanted.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    wanted = wanted.execute(license_scan.oracle())
    names = [c[0] for c in wanted.description]
    found = license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).select(*names).collect()
    assert sorted(map(tuple, found)) == sorted(wanted.fetchall())
    assert {r["labels"] for r in found} > {"", "mit", "apache-2.0", "bsd"} and any(0.75 < r["score"] < 1 for r in found)


def test_scratch_tables_go(spark):
    from lodestone.llm.common import Scratch

    scratch = Scratch(spark, "test")
    for name in ("a", "b", "a", "c"):
        df = scratch.write(spark.range(3), name)
    folder, files = scratch.files()
    listed = lambda: sorted(x.getPath().getName() for x in files.listStatus(folder))
    scratch.keep("a", "c")
    assert listed() == ["003-a", "004-c"] and df.count() == 3
    scratch.drop("003-a")
    assert listed() == ["004-c"] == scratch.tables
    scratch.drop()
    assert not files.exists(folder)


def test_batches_are_bounded(spark, monkeypatch):
    """By bytes, unless the session has a limit of its own."""
    from lodestone.llm import common

    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    spark.conf.unset(common.BATCH_LIMIT)
    df = common.id_and_text(spark.range(4000).selectExpr("id AS doc_id", "repeat('x', 5000) AS text"), "doc_id", "text").coalesce(1)
    assert max(r["n"] for r in df.mapInArrow(sizes, "n long").collect()) < 2 * common.BATCH_BYTES
    spark.conf.set(common.BATCH_LIMIT, "1000000")
    common.prepare_workers(spark)
    assert spark.conf.get(common.BATCH_LIMIT) == "1000000"
    spark.conf.unset(common.BATCH_LIMIT)


def test_directory_splits_where_needed_alone(spark):
    """Keys that share 53 bits need many rounds; the rest of the directory stays shallow."""
    from pyspark.sql import functions as F

    from lodestone.llm import extendible
    from lodestone.llm.common import Scratch

    scratch = Scratch(spark, "test")
    crowd = spark.range(100).select(F.col("id").alias("key"))
    spread = spark.range(40).select((F.col("id") * (1 << 54) + 77).alias("key"))
    keyed = scratch.write(crowd.unionByName(spread).withColumn("weight", F.lit(10).cast("long")), "keyed")
    directory = extendible.build(keyed, 50, scratch)
    leaves = directory.collect()
    assert sum(r["entries"] for r in leaves) == 140 and all(r["weight"] <= 50 for r in leaves)
    assert max(r["depth"] for r in leaves) >= 56 and min(r["depth"] for r in leaves) <= 5
    for a, b in itertools.permutations(leaves, 2):  # no bucket lies within another
        assert a["depth"] > b["depth"] or b["prefix"] >> (b["depth"] - a["depth"]) != a["prefix"]
    placed = extendible.place(keyed, directory).collect()
    assert len(placed) == 140
    assert all(r["key"] >> (60 - r["depth"]) == r["prefix"] for r in placed)
