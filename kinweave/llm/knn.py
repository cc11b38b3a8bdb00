"""Operator 2: exact top-k inner products by a Voronoi kNN join.

Vectors become integers floor(64 * x). One more coordinate, sqrt(M - |x|^2) with M the largest
squared length, turns the largest inner product into the smallest Euclidean distance, so cells
around pivots and the triangle inequality apply. Every vector belongs to the cell of its nearest
pivot; a summary of each cell (its rows, its radius, its k + 1 smallest distances) bounds the
distance of each query's k-th neighbour and tells which cells can hold one. Queries are the smaller
side, so blocks of queries are what is replicated, to the cells they need; each vector moves once.
Cells are cut into chunks of bounded size, so a cell with a third of all vectors is many tasks.
Chunks are solved locally with exact integer scores and the best k of each query are merged.

Pivots and summaries are of bounded size (``n_pivots``), whatever the input.

Cases: vectors that are null, or hold a null or a non-finite component, take no part, nor do rows
without vec_id; of rows with one vec_id the one with the largest vector (in the order of arrays)
takes part; shorter vectors count as padded by zeros; fewer than k other rows give fewer results;
equal scores go to the smaller vec_id; an empty table gives no rows; other columns are not read.
Scores outside 64 bits are cut to the nearest 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import land

SCALE = 64
N_PIVOTS = 64
CHUNK_ROWS = 1024
BLOCK_QUERIES = 256
EXACT = 2.0 ** 53


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the integer vector; one row for each vec_id."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.max("v").alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as an integer matrix, padded by zeros."""
    ends = column.offsets.to_numpy()
    size = np.diff(ends)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    flat = column.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]]
    out[row, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], size)] = flat
    return out


class Cells:
    """Pivots with their extra coordinate, and distances to them."""

    def __init__(self, pivots: np.ndarray, largest: float) -> None:
        self.pivots, self.largest = pivots.astype(float), largest
        self.extra = np.sqrt(np.maximum(largest - (self.pivots ** 2).sum(1), 0))
        full = np.column_stack([self.pivots, self.extra])
        self.between = np.sqrt(np.maximum(((full[:, None] - full[None]) ** 2).sum(2), 0))

    def distances(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Of each row to each pivot; a query's extra coordinate is 0."""
        f = x.astype(float)
        own = (f ** 2).sum(1)
        extra = np.zeros(len(f)) if query else np.sqrt(np.maximum(self.largest - own, 0))
        square = own[:, None] + extra[:, None] ** 2 + self.largest - 2 * (f @ self.pivots.T + np.outer(extra, self.extra))
        return np.sqrt(np.maximum(square, 0))


def needed(cells: Cells, counts: np.ndarray, radius: np.ndarray, near: list[np.ndarray], q: np.ndarray, k: int) -> np.ndarray:
    """Which cells can hold one of the k nearest rows of each query, as a matrix of booleans."""
    d = cells.distances(q, query=True)
    full = counts > 0
    reach = np.column_stack([d[:, [j]] + near[j][None] for j in np.flatnonzero(full)])
    # the query's own row may be among the k + 1 nearest upper bounds
    bound = np.partition(reach, k, axis=1)[:, k] if reach.shape[1] > k else np.full(len(q), np.inf)
    slack = 1e-7 * (np.sqrt(cells.largest) + np.sqrt((q.astype(float) ** 2).sum(1))) + 1e-6
    lower = d - radius
    with np.errstate(divide="ignore", invalid="ignore"):
        for i in range(len(full)):  # rows of a cell are nearer to its pivot than to any other
            side = (d ** 2 - d[:, [i]] ** 2) / (2 * cells.between[i])
            lower = np.maximum(lower, np.where(cells.between[i] > 0, side, -np.inf))
    return full & (lower <= (bound + slack)[:, None])


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products."""
    if np.sqrt(((q.astype(float) ** 2).sum(1)).max(initial=0) * ((x.astype(float) ** 2).sum(1)).max(initial=0)) < EXACT:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    exact = q.astype(object) @ x.astype(object).T
    return np.clip(exact, -(1 << 63) + 1, (1 << 63) - 1).astype(np.int64)


UNIT_SCHEMA = "unit long, kind int, ids binary, rows binary"


def _unit(unit: int, kind: int, ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([unit], pa.int64()), pa.array([kind], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([rows.tobytes()], pa.binary())],
        names=["unit", "kind", "ids", "rows"])


def top_k(vectors: DataFrame, k: int, is_query: Column, n_pivots: int = N_PIVOTS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of each row for which ``is_query`` (over vec_id) holds."""
    rows = land(usable(vectors), "vectors")
    top = rows.agg(
        F.max(F.size("v")).alias("width"),
        F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("square")).first()
    width, largest = max(top["width"] or 0, 1), top["square"] or 0.0
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).toArrow()  # n_pivots rows
    pivots = matrix(chosen.column("v").combine_chunks(), width) if chosen.num_rows else np.zeros((1, width), np.int64)
    cells = Cells(np.unique(pivots, axis=0), largest)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = cells.distances(matrix(b.column(0), width))
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near])], names=["cell", "d"])

    placed = rows.select("v").mapInArrow(assign, "cell int, d double")
    first = Window.partitionBy("cell").orderBy("d")
    summary = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("radius")).toPandas()  # a row for each cell
    nearest = placed.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).select("cell", "d").toPandas()
    counts, radius = np.zeros(len(cells.pivots), np.int64), np.zeros(len(cells.pivots))
    counts[summary["cell"]], radius[summary["cell"]] = summary["n"], summary["radius"]
    near = [np.sort(nearest["d"][nearest["cell"] == j].to_numpy(float)) for j in range(len(counts))]
    chunks = np.maximum(-(-counts // chunk_rows), 1)
    before = np.concatenate([[0], np.cumsum(chunks)[:-1]])

    def data_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x, h = b.column(0).to_numpy(), matrix(b.column(1), width), b.column(2).to_numpy()
            cell = cells.distances(x).argmin(1)
            unit = before[cell] + h.astype(np.uint64) % chunks[cell].astype(np.uint64)
            for u in np.unique(unit).astype(int):
                yield _unit(u, 0, ids[unit == u], x[unit == u])

    def query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 4 * BLOCK_QUERIES):
                some = b.slice(s, 4 * BLOCK_QUERIES)
                ids, q = some.column(0).to_numpy(), matrix(some.column(1), width)
                group = np.argsort(cells.distances(q, query=True).argmin(1), kind="stable")  # queries of one pivot together
                ids, q = ids[group], q[group]
                wanted = needed(cells, counts, radius, near, q, k)
                for lo in range(0, len(ids), BLOCK_QUERIES):
                    own = slice(lo, lo + BLOCK_QUERIES)
                    for cell in np.flatnonzero(wanted[own].any(0)):
                        w = wanted[own][:, cell]
                        for c in range(chunks[cell]):
                            yield _unit(int(before[cell] + c), 1, ids[own][w], q[own][w])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, ids, x = -1, np.zeros(0, np.int64), np.zeros((0, width), np.int64)
        for b in batches:
            for u, kind, i, r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if u != unit:
                    unit, ids, x, ordered = u, np.zeros(0, np.int64), np.zeros((0, width), np.int64), False
                own, v = np.frombuffer(i, np.int64), np.frombuffer(r, np.int64).reshape(-1, width)
                if kind == 0:
                    ids, x = np.concatenate([ids, own]), np.concatenate([x, v])
                    continue
                if not ordered:
                    order = np.argsort(ids)
                    ids, x, ordered = ids[order], x[order], True
                s = scores(v, x)
                best = np.argsort(-s, axis=1, kind="stable")[:, :k + 1]  # equal scores stay in the order of vec_id
                line = np.repeat(np.arange(len(own)), best.shape[1])
                at = best.ravel()
                other = ids[at] != own[line]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[line][other]), pa.array(ids[at][other]), pa.array(s[line, at][other])], names=["query_id", "vec_id", "score"])

    data = rows.select("vec_id", "v", F.xxhash64("vec_id").alias("h")).mapInArrow(data_blocks, UNIT_SCHEMA)
    queries = rows.filter(is_query).select("vec_id", "v").mapInArrow(query_blocks, UNIT_SCHEMA)
    found = data.union(queries).repartition("unit").sortWithinPartitions("unit", "kind").mapInArrow(
        solve, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
