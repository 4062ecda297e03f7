"""Near-duplicate groups by one-permutation MinHash.

A text's shingles (five words) are hashed once; the smallest hash in each bin is its sketch, and an empty
bin takes the value of a filled one, found in the bin's own random order (optimal densification). Bands
of sketch values are bucket keys, and so are the first shingles, by hash, of small sets. Texts with equal
sets are one class from then on. In each bucket candidates are a star from a hub, and a few more stars
from hubs among what is not linked to one, so their number is linear; what is still apart in a bucket is
compared by the rarest shingles. All links are confirmed on full sets, and components come from
alternating star contractions.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, chunks, id_and_text, let_go
from lodestone.llm.words import SPACED, mix, windows, word_hashes

WORDS, BANDS, ROWS = 5, 45, 5
BINS = BANDS * ROWS
#: Sets of at most so many shingles are certain to meet all that they can be linked to.
SMALL = 20
#: Stars of a bucket, each from a hub among what the ones before it have not linked.
STARS = 3
#: A shingle is common in a hub's stars if more members hold it.
COMMON = 8
#: Counters of a sketch; least and most rows of the two sides of a block.
COUNTERS, BLOCK_MEMBERS, BLOCK_SEEKERS = 1024, (2048, 8192), (512, 2048)
#: How many pairs a block tests in the time in which a join makes one.
TESTS_A_PAIR = 16


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; one of all words if there are fewer than five."""
    hashes, first = word_hashes(texts, SPACED)
    rolled = windows(hashes, WORDS)
    sets = []
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        if b - a >= WORDS:
            sets.append(np.unique(rolled[a : b - WORDS + 1]))
        else:
            sets.append(windows(hashes[a:b], b - a) ^ np.uint64(b - a) if b > a else np.zeros(0, np.uint64))
    return sets


@lru_cache(maxsize=1)
def search_order() -> np.ndarray:
    """For each bin, the rank of every other bin in its search for a filled one."""
    rng = np.random.default_rng(5)
    return np.stack([rng.permutation(BINS) for _ in range(BINS)]).astype(np.int16)


def bucket_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The keys of a set's buckets, from sorted hashes: the bands of its sketch, and if it is small what a linked set must share one of.

    A linked set has `percent` of the larger one's shingles in common, so of all but percent - 1 of both,
    in one order, the first of those stands in both.
    """
    bands, least = band_keys(shingles), -(-percent * len(shingles) // 100)
    if len(shingles) * percent > 100 * SMALL:
        return bands
    return np.concatenate([bands, mix(shingles[: len(shingles) - least + 1] ^ np.uint64(0x5851F42D4C957F2D))])


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One bucket key a band, from sorted hashes: the bin is the hash's high part, so a bin's first is its smallest."""
    bins = ((shingles >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    lead = np.concatenate([[0], np.flatnonzero(np.diff(bins)) + 1])
    filled = bins[lead]
    sketch = np.zeros(BINS, np.uint64)
    if len(filled) == BINS:
        sketch = shingles[lead]
    else:
        ranks = search_order()[:, filled]
        sketch = shingles[lead[ranks.argmin(axis=1)]]
        sketch[filled] = shingles[lead]
    rows = sketch.reshape(BANDS, ROWS)
    total = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return total


def set_lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, sets)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *(x.astype(np.int64) for x in sets)])))


def signatures(df: DataFrame, percent: int) -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (a 128-bit hash of the set), buckets (keys)."""

    def run(batches):
        let_go()
        salt = np.uint64(0xD6E8FEB86659FD93)
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = shingle_sets(part.column("text"))
                k1 = np.array([np.add.reduce(mix(s)) for s in sets], np.uint64)
                k2 = np.array([np.add.reduce(mix(s ^ salt)) for s in sets], np.uint64)
                keys = [bucket_keys(s, percent) if len(s) else s for s in sets]
                columns = [part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1.astype(np.int64)), pa.array(k2.astype(np.int64)), set_lists(keys)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "k1", "k2", "buckets"])

    return df.mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, buckets array<long>")


def shingled(df: DataFrame) -> DataFrame:
    """id, n and the sorted distinct shingles of each text."""

    def run(batches):
        let_go()
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = shingle_sets(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), set_lists(sets)], ["id", "n", "shingles"])

    return df.mapInArrow(run, "id long, n long, shingles array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union, once each; pairs with a null id or one without a set go."""
    left, right = (sets.select(F.col("id").alias(i), F.col("n").alias(f"n{i}"), F.col("shingles").alias(f"s{i}")) for i in "ab")
    possible = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    met = F.size(F.array_intersect("sa", "sb"))
    linked = (100 + percent) * met >= percent * (F.col("na") + F.col("nb"))
    return pairs.join(left, "a").join(right, "b").where(possible & linked).select("a", "b").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root (the smallest node of its component) for every node of `links` (a, b) but roots themselves.

    Alternates large and small stars until nothing changes; the number of rounds is logarithmic in the
    longest chain for all practical graphs, and each is a written table.
    """
    edges = scratch.write(links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).where("node <> root").distinct(), "edges")
    mark = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            return edges
        mark = now
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("low")).select("node", F.least("node", "low").alias("low"))
        large = both.join(least, "node").where("root > node").select(F.col("root").alias("node"), F.col("low").alias("root")).distinct()
        before = scratch.last
        large = scratch.write(large, "large")
        least = large.groupBy("node").agg(F.min("root").alias("low"))
        small = large.join(least, "node").select(F.explode(F.array(F.struct(F.col("root").alias("node"), F.col("low").alias("root")), F.struct("node", F.col("low").alias("root")))).alias("e"))
        middle = scratch.last
        edges = scratch.write(small.select("e.*").where("node <> root").distinct(), "edges")
        scratch.drop(before)
        scratch.drop(middle)


def counters(shingles: np.ndarray) -> bytes:
    """Shingles by hash, as uint16. Beyond what those hold, all are full, and the bound says nothing."""
    if len(shingles) > 0xFFFF:
        return np.full(COUNTERS, 0xFFFF, "<u2").tobytes()
    return np.bincount((shingles % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS).astype("<u2").tobytes()


def past_the_hub(members: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of members (hub, id, root, seeker, n, shingles) of a hub's stars, of different components, that can be linked.

    A link needs percent / (100 + percent) of both sizes in common. Of common shingles a pair shares at
    most what the poorer member holds. If that cannot do, the pair shares a rare shingle, and there are at
    most COMMON members to each of those. If it can, and they share no rare one, they share a percent of
    either's shingles among its common ones, so the rarest that they share is one of the first of both.
    A hub's members are joined on those, or tried in blocks where that is less work.
    """
    items = members.select("hub", "id", "root", "seeker", "n", F.explode("shingles").alias("s"))
    shared = items.groupBy("hub", "s").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    rare = F.collect_list(F.when(F.col("held") <= COMMON, F.col("s")))
    common = F.sort_array(F.collect_list(F.when(F.col("held") > COMMON, F.struct("held", "s"))))
    known = items.join(shared, ["hub", "s"]).groupBy("hub", "id", "root", "seeker", "n").agg(rare.alias("rare"), common.alias("list"))
    least = F.ceil(F.col("n") * percent / 100)
    first = F.transform(F.slice("list", F.lit(1), F.greatest(F.size("list") - least + 1, F.lit(0)).cast("int")), lambda x: x["s"])
    known = scratch.write(known.select("hub", "id", "root", "seeker", "n", "rare", F.size("list").alias("common"), first.alias("first"), least.alias("least")), "known")
    names = ("id", "root", "n", "common", "least")
    met = F.count(F.lit(1)).alias("met")

    def meeting(known: DataFrame, column: str) -> DataFrame:
        """Pairs of a seeker and another member of its hub, by how many values of `column` they share."""
        one = known.where("seeker").select("hub", *names, F.explode(column).alias("s"))
        two = known.select("hub", *(F.col(c).alias(f"{c}2") for c in names), F.explode(column).alias("s"))
        fits = (F.col("root") != F.col("root2")) & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2"))
        return one.join(two, ["hub", "s"]).where(fits).groupBy("hub", "id", "id2", "n", "n2", "common", "common2", "least", "least2").agg(met)

    need, held = percent * (F.col("n") + F.col("n2")), (100 + percent) * F.least("common", "common2")
    by_rare = meeting(known, "rare").where((100 + percent) * F.col("met") >= need - held)
    able = known.where(F.size("first") > 0)
    joined = able.select("hub", "seeker", F.explode("first").alias("s")).groupBy("hub", "s").agg(F.count(F.lit(1)).alias("m"), F.count_if("seeker").alias("k"))
    joined = joined.groupBy("hub").agg(F.sum(F.col("m").cast("double") * F.col("k")).alias("join"))
    sizes = able.groupBy("hub").agg(F.count(F.lit(1)).alias("m"), F.count_if("seeker").alias("k")).where("k > 0")
    plans = scratch.write(sizes.join(joined, "hub").withColumn("by_join", F.col("join") * TESTS_A_PAIR < F.col("m").cast("double") * F.col("k")), "plans")
    by_first = meeting(able.join(plans.where("by_join").select("hub"), "hub", "left_semi"), "first")
    by_first = by_first.where((held >= need) & ((100 + percent) * (F.col("met") + F.greatest("least", "least2") - 1) >= need))
    by_block = tried_in_blocks(able.drop("rare", "first"), members, plans.where("NOT by_join"), percent)
    pairs = by_rare.select("id", "id2").unionByName(by_first.select("id", "id2")).unionByName(by_block)
    return pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def counted(members: DataFrame) -> DataFrame:
    """hub, id and the counters of each member: shingles by hash, as uint16. Beyond what those hold, all are full, and the bound says nothing."""

    def counters(shingles: np.ndarray) -> bytes:
        if len(shingles) > 0xFFFF:
            return np.full(COUNTERS, 0xFFFF, "<u2").tobytes()
        return np.bincount(shingles.view(np.uint64) % np.uint64(COUNTERS), minlength=COUNTERS).astype("<u2").tobytes()

    def run(batches):
        for batch in batches:
            found = pa.array([counters(x.values.to_numpy()) for x in batch.column("shingles")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("hub"), batch.column("id"), found], ["hub", "id", "counters"])

    return members.select("hub", "id", "shingles").mapInArrow(run, "hub long, id long, counters binary")


def tried_in_blocks(known: DataFrame, members: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """Pairs (id, id2) of members of `hubs` (hub, m members, k seekers) whose common shingles alone could make a link, and whose counters allow one.

    Members and seekers of a hub are dealt to blocks of bounded size, so a hub of any size is spread
    over tasks; a pair leaves its block only if the sum of the lesser counters reaches what a link needs.
    """
    count = lambda n, low, high: F.ceil(F.col(n) / F.least(F.greatest(F.col(n) / 64, F.lit(low)), F.lit(high))).cast("int")
    blocks = hubs.select("hub", count("m", *BLOCK_MEMBERS).alias("rows"), count("k", *BLOCK_SEEKERS).alias("columns"))
    known = known.join(blocks, "hub").join(counted(members.join(hubs.select("hub"), "hub", "left_semi")), ["hub", "id"])
    part = lambda count: F.pmod(F.xxhash64("id"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    columns = ("hub", "row", "column", "id", "root", "n", "common", "counters")
    left = known.withColumns({"row": part("rows"), "column": every("columns")}).select(*columns)
    right = known.where("seeker").withColumns({"column": part("columns"), "row": every("rows")}).select(*(F.col(c).alias(f"{c}2") for c in columns))

    def matrix(table: pa.Table, mark: str = "") -> tuple:
        plain = [table.column(c + mark).to_numpy() for c in ("id", "root", "n", "common")]
        return *plain, np.frombuffer(b"".join(table.column("counters" + mark).to_pylist()), "<u2").reshape(-1, COUNTERS)

    def run(members: pa.Table, seekers: pa.Table) -> pa.Table:
        ones, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if members.num_rows and seekers.num_rows:
            ids, roots, sizes, commons, sketch = matrix(members)
            for one, root, n, common, own in zip(*matrix(seekers, "2"), strict=True):
                need = percent * (n + sizes)
                near = 100 * np.minimum(n, sizes) >= percent * np.maximum(n, sizes)
                at = np.flatnonzero(near & (roots != root) & ((100 + percent) * np.minimum(common, commons) >= need))
                bound = np.concatenate([np.minimum(sketch[at[k : k + 256]], own).sum(axis=1, dtype=np.int64) for k in range(0, len(at), 256)] or [at])
                found = ids[at[(100 + percent) * bound >= need[at]]]
                others.append(found)
                ones.append(np.full(len(found), one, np.int64))
        return pa.table([pa.array(np.concatenate(x)) for x in (ones, others)], ["id", "id2"])

    return left.groupBy("hub", "row", "column").cogroup(right.groupBy("hub2", "row2", "column2")).applyInArrow(run, "id long, id2 long")


def near_groups(df: DataFrame, *, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    Words are runs of anything but ASCII white space, A-Z folded. Two documents are linked if 100 *
    intersection >= percent * union of their distinct five-word shingles; a text of fewer words is one
    shingle of them all; one without words, null or empty, has none and links with nothing. Rows that
    share an id are one node; a row without one has the component of the equal texts, if there are any.
    An empty table gives no row; other columns are not read; texts are read whole. Candidates come from 45 bands of five: a pair at 0.75
    shares none with probability 5e-6 if its bins were independent (measured: 3 of 420000 random pairs), and
    surely shares a bucket if one of the two has at most SMALL shingles.
    """
    scratch = Scratch(df.sparkSession, "near")
    documents = id_and_text(df, id_col, text_col)
    signed = scratch.write(signatures(documents, percent), "signatures")
    classes = signed.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.first("buckets").alias("buckets"))
    classes = scratch.write(classes, "classes")
    items = classes.where("id is not null").select("id", F.explode("buckets").alias("bucket"))
    buckets = items.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("hub")).where("n > 1").select("bucket", "hub")
    members = scratch.write(items.join(buckets, "bucket"), "members")
    wanted = members.select(F.col("id").alias("__id")).distinct()
    sets = scratch.write(shingled(documents.join(wanted, F.col("doc_id") == F.col("__id"), "left_semi")), "sets")
    roots, apart = None, members.withColumnRenamed("hub", "star")
    for _ in range(STARS):
        stars = apart.where("id <> star").select(F.col("star").alias("a"), F.col("id").alias("b")).distinct()
        links = confirm(stars, sets, percent)
        if roots is not None:
            links = scratch.write(links, "links")
            if links.isEmpty():
                break
            links = links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = components(links, scratch)
        # what is not linked to its star has another one among itself
        of_star = roots.select(F.col("node").alias("star"), F.col("root").alias("star_root"))
        left = apart.select("bucket", "id", "star").join(roots.withColumnRenamed("node", "id"), "id", "left").join(of_star, "star", "left")
        left = left.withColumn("root", F.coalesce("root", "id")).where(F.col("root") != F.coalesce("star_root", "star"))
        left = scratch.write(left.select("bucket", "id", "root"), "apart")
        again = left.groupBy("bucket").agg(F.min(F.struct("id", "root")).alias("one"), F.min("root").alias("low"), F.max("root").alias("high"))
        again = again.where("low < high").select("bucket", F.col("one.id").alias("star"), F.col("one.root").alias("own"))
        apart = left.join(again, "bucket").where("id = star OR root <> own").select("bucket", "id", "star")
    # what buckets still hold apart: only those that span components, and only pairs across these
    label = roots.select(F.col("node").alias("id"), "root")
    placed = members.join(label, "id", "left").select("bucket", "id", "hub", F.coalesce("root", "id").alias("root"))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    rest = scratch.write(placed.where("id <> hub").join(mixed, "bucket", "left_semi").select("hub", "id", "root").distinct(), "rest")
    open_hubs = rest.groupBy("hub").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("hub")
    of_hub = roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    rest = rest.join(open_hubs, "hub").join(of_hub, "hub", "left").withColumn("seeker", F.col("root") != F.coalesce("hub_root", "hub"))
    across = past_the_hub(scratch.write(rest.join(sets, "id").select("hub", "id", "root", "seeker", "n", "shingles"), "open"), percent, scratch)
    more = scratch.write(confirm(across, sets, percent), "more")
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), scratch)
    scratch.keep("signatures", "classes", "edges")
    named = classes.select("k1", "k2", "id").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("k1", "k2", F.coalesce("root", "id").alias("component"))
    found = signed.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


#: The same in DuckDB: exact sets, all links by joining shingles, and what can be reached over them.
ORACLE = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                          WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM met JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, edge.y FROM reach JOIN edge ON edge.x = reach.other),
root AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, root.component_id, d.doc_id = root.component_id AS kept
FROM documents d JOIN root USING (doc_id) LEFT JOIN n USING (doc_id)
"""
