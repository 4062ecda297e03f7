"""Nearest neighbours by inner product: an inverted file with product-quantised residuals.

Coarse centroids and the codebooks of the residuals are fitted on a bounded sample; every row is indexed
with its cell and code. Cells are put on shelves of bounded size (a larger cell is dealt to several), and
each query goes to the shelves of the cells it probes. A shelf that more queries ask than a task should
hold is read by several blocks of them, and one that none asks by no task. A shelf ranks its rows by asymmetric distance
tables, equal vectors as one, and reranks exactly all whose quantisation error could bring them among the
best, so only a few rows a query and shelf are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch

SUBSPACE = 4
CODES = 256
#: Rows that a shelf, and queries that a block of it, hold at most.
SHELF_ROWS, BLOCK_QUERIES = 8192, 4096


def kmeans(points: np.ndarray, count: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = points[rng.choice(len(points), min(count, len(points)), replace=False)].copy()
    for _ in range(rounds):
        owner = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, points)
        sizes = np.bincount(owner, minlength=len(centres))
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The closest centre of each point, the first of equals."""
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(half - points[k : k + 8192] @ centres.T).argmin(axis=1) for k in range(0, len(points), 8192)] or [np.zeros(0, np.int64)])


@dataclass(frozen=True)
class Model:
    centres: np.ndarray
    books: np.ndarray  # subspace, code, component
    probes: int

    def encode(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cells = nearest(points, self.centres)
        parts = self.split(points - self.centres[cells])
        codes = [nearest(parts[:, m], book) for m, book in enumerate(self.books)]
        return cells, np.stack(codes, axis=1).astype(np.uint8)

    def errors(self, points: np.ndarray, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How far each point is from what its cell and code stand for."""
        kept = self.books[np.arange(len(self.books)), codes]
        return np.sqrt(((self.split(points - self.centres[cells]) - kept) ** 2).sum(axis=(1, 2)))

    def split(self, points: np.ndarray) -> np.ndarray:
        pad = -points.shape[1] % SUBSPACE
        return np.pad(points, ((0, 0), (0, pad))).reshape(len(points), -1, SUBSPACE)


def fit(sample: np.ndarray, cells: int, target: float, k: int, seed: int) -> Model:
    """Centroids, codebooks, and as many probes as `target` of the k nearest need within the sample itself."""
    rng = np.random.default_rng(seed)
    centres = kmeans(sample, cells, rng)
    centres = centres[np.sort(np.unique(centres, axis=0, return_index=True)[1])]  # copies in the sample start as equal centres
    owner = nearest(sample, centres)
    model = Model(centres, np.zeros((0, 0, 0)), 0)
    books = np.stack([kmeans(part, CODES, rng, 6) for part in model.split(sample - centres[owner]).transpose(1, 0, 2)])
    asked = rng.choice(len(sample), min(400, len(sample)), replace=False)
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
    rank = np.argsort(np.argsort(-(sample[asked] @ centres.T), axis=1), axis=1)
    needed = np.take_along_axis(rank, owner[best], axis=1).ravel()
    probes = int(np.quantile(needed, target)) + 1 if needed.size and target < 1 else len(centres)
    return Model(centres, books, min(len(centres), probes))


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector of the rows that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (sizes["n"] if sizes else 0))


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def search(df: DataFrame, is_query, *, k: int = 20, sample_rows: int = 20_000, max_cells: int = 16_384, target: float = 0.95, shortlist: int = 256, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows of largest inner product for each row where `is_query` (a condition on vec_id) holds: query_id, rank, vec_id, score.

    There are as many cells as the root of the rows, `max_cells` at most. The index is fitted on
    `sample_rows` rows at least and four a cell, chosen by a hash; all rows are indexed. The number of
    probed cells is what `target` of the neighbours need within the sample, and more cells are probed
    until they hold enough rows for k; cells as near as the last are probed too. With a target of 1 all
    cells are probed. Within the probed cells the answer is exact: `shortlist` vectors a shelf set the cut, and every other one that its quantised
    score and error do not put below it is reranked. The scores are exact, in double precision. Vectors that are null,
    zero, of another length than most, or that hold null or non-finite components take no part, nor do
    rows without an id. A row is never its own neighbour, nor is another row of its id. Ties go to the
    smaller id. Rows that repeat an id are candidates each, but one query, that of the least vector. Empty
    tables give no row; other columns are not read.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "ann")
    rows = scratch.write(valid_vectors(df, id_col, vector_col), "vectors")
    total = rows.count()
    result = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], result)
    cells = max(1, min(max_cells, round(total**0.5)))
    wanted = max(sample_rows, 4 * cells)
    share = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 50)) < int((1 << 50) * min(1.0, 1.05 * wanted / total)) + 1
    taken = lambda chosen: matrix(chosen.orderBy("vec_id", "vector").select("vector").toArrow().column("vector").combine_chunks())
    sample = taken(rows.where(share).limit(2 * wanted))  # ids that many rows repeat could make it larger
    sample = sample if len(sample) else taken(rows.limit(1000))
    model = fit(sample, cells, target, k, seed)

    def index(batches):
        for batch in batches:
            cells, codes = model.encode(matrix(batch.column("vector")))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(cells.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "vector", "cell", "code"])

    indexed = scratch.write(rows.mapInArrow(index, "vec_id long, vector array<double>, cell int, code binary"), "index")
    counts = np.zeros(len(model.centres), np.int64)
    for r in indexed.groupBy("cell").count().collect():  # one row a cell, max_cells at most
        counts[r["cell"]] = r["count"]
    first, parts, shelf, room = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, SHELF_ROWS
    for cell, n in enumerate(counts.tolist()):
        if n > SHELF_ROWS:
            parts[cell] = -(-2 * n // SHELF_ROWS)
            first[cell], shelf, room = shelf + 1, shelf + 1 + int(parts[cell]), SHELF_ROWS
        else:
            if n > room:
                shelf, room = shelf + 1, SHELF_ROWS
            first[cell], room = shelf, room - n

    def route(batches):
        for batch in batches:
            points = matrix(batch.column("vector"))
            scores = points @ model.centres.T
            order = np.argsort(-scores, axis=1, kind="stable")
            slack = 1e-9 * np.sqrt((points**2).sum(axis=1)) * np.sqrt((model.centres**2).sum(axis=1).max())
            reach = np.cumsum(counts[order], axis=1)
            out = []
            for i, doc in enumerate(batch.column("vec_id").to_pylist()):
                enough = int(np.searchsorted(reach[i], min(total, 4 * k + 1))) + 1
                last = scores[i, order[i, min(len(counts), max(model.probes, enough)) - 1]]
                wanted: dict[int, list[int]] = {}
                for cell in order[i, : np.count_nonzero(~(scores[i] < last - slack[i]))].tolist():
                    for s in range(first[cell], first[cell] + parts[cell]):
                        wanted.setdefault(int(s), []).append(cell)
                out += [(i, doc, s, cells) for s, cells in wanted.items()]
            if out:
                at, docs, shelves, cells = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(shelves, pa.int32()), pa.array(cells, pa.list_(pa.int32())), batch.column("vector").take(pa.array(at))], ["query_id", "shelf", "cells", "query"])

    asked = rows.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    routed = scratch.write(asked.mapInArrow(route, "query_id long, shelf int, cells array<int>, query array<double>"), "routed")
    blocks = scratch.write(routed.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("blocks")), "blocks")
    scratch.keep("index", "routed", "blocks")
    routed = routed.join(blocks, "shelf").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int")).drop("blocks")

    def shelve(batches):
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            ids = batch.column("vec_id").to_numpy().astype(np.uint64)
            spread = (ids * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            shelves = first[cells] + spread % parts[cells]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shelves.astype(np.int32))], ["vec_id", "vector", "cell", "code", "shelf"])

    shelved = indexed.mapInArrow(shelve, "vec_id long, vector array<double>, cell int, code binary, shelf int")
    shelved = shelved.join(blocks, "shelf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            left = left.combine_chunks()
            left = left.sort_by("vec_id")
            ids, exact = left.column("vec_id").to_numpy(), matrix(left.column("vector").combine_chunks()) + 0.0  # no -0
            keys = np.column_stack([exact, left.column("cell").to_numpy()])
            _, at, group = np.unique(keys.view(f"V{keys.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
            exact, cells = exact[at], left.column("cell").to_numpy()[at]  # of each distinct vector
            members, copies = np.argsort(group, kind="stable"), np.bincount(group)
            begin = np.cumsum(copies) - copies
            codes = np.frombuffer(b"".join(left.column("code").take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1).astype(np.int64)
            errors = model.errors(exact, cells, codes)
            reach = np.sqrt((exact**2).sum(axis=1).max()) + np.sqrt((model.centres**2).sum(axis=1).max()) + errors.max()
            codes += np.arange(codes.shape[1]) * model.books.shape[1]
            queries = matrix(right.column("query").combine_chunks())
            parts, coarse = model.split(queries), queries @ model.centres.T
            for i, (query, probed) in enumerate(zip(right.column("query_id").to_pylist(), right.column("cells").to_pylist(), strict=True)):
                chosen = np.zeros(len(model.centres), bool)
                chosen[probed] = True
                own = group[np.searchsorted(ids, query) : np.searchsorted(ids, query, "right")]
                sizes = copies - np.bincount(own, minlength=len(copies))
                score = lambda g: (exact[g] * queries[i]).sum(axis=1)  # noqa: B023, E731 - equal vectors give equal bits, so ties are ties
                at = np.flatnonzero(chosen[cells] & (sizes > 0))
                if len(at) > shortlist:
                    table = np.einsum("md,mcd->mc", parts[i], model.books).ravel()
                    near = coarse[i, cells[at]] + table[codes[at]].sum(axis=1)
                    best = np.argpartition(-near, shortlist - 1)[:shortlist]
                    found = score(at[best])
                    falling = np.argsort(-found)
                    enough = np.searchsorted(np.cumsum(sizes[at[best]][falling]), k)
                    cut = found[falling[enough]] if enough < len(best) else -np.inf
                    length = np.sqrt((queries[i] ** 2).sum())
                    at = at[~(near + length * (errors[at] + 1e-9 * reach) < cut)]
                scores = score(at)
                falling = np.argsort(-scores)
                enough = np.searchsorted(np.cumsum(sizes[at][falling]), k)
                if enough < len(at):
                    keep = scores >= scores[falling[enough]]
                    at, scores = at[keep], scores[keep]
                rows = np.concatenate([members[begin[g] : begin[g] + copies[g]] for g in at.tolist()] or [np.zeros(0, np.int64)])
                scores = np.repeat(scores, copies[at])
                other = ids[rows] != query
                rows, scores = rows[other], scores[other]
                best = np.lexsort((ids[rows], -scores))[:k]
                out["query_id"].append(np.full(len(best), query, np.int64))
                out["vec_id"].append(ids[rows][best])
                out["score"].append(scores[best])
        kinds = {"query_id": np.int64, "vec_id": np.int64, "score": np.float64}
        return pa.table({name: np.concatenate([np.zeros(0, kinds[name]), *x]) for name, x in out.items()})

    keys = ("shelf", "block")
    found = shelved.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInArrow(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
