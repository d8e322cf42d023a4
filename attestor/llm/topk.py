"""Exact top-k inner products over a pivot-distance index.

Components are quantised to floor(scale * x). With M the largest norm, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0),
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x: the largest inner products are the nearest neighbours of q'. Every x' is keyed by
its nearest pivot and its distance to it; vectors sorted by that key are cut into annuli of at most ANNULUS rows.
For a query at distance d from a pivot, no row of an annulus [r, R] of it is nearer than max(d - R, r - d), which
bounds its score from above. A query starts with the k-th score of the annulus it lies in, expands annuli in order
of their bounds, and stops when the next bound is below its k-th score; bounds carry a margin for rounding and
scores are integers, so the result is exact and ties are whole. Pivots come from a bounded sample (PIVOTS rows of
least hash); every row is indexed.

Annuli lie on shelves (runs of annuli). A query is sent to the shelves whose bounds reach its k-th score, and a shelf to
the blocks of queries that ask for it; each such pair of a query block and a shelf is one bounded task.

Vectors that are null, empty, or hold null or non-finite components, and rows without an id, take no part. Only
vectors of equal length are compared. Rows that repeat an id are rows of their own: a query never meets its own
row, but may meet another row of the same id. Scores beyond 64 bits are clipped. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from attestor.llm.common import Scratch, batch, lean

SCALE, PIVOTS, ANNULUS, SHELF, QUERY_BLOCK = 256, 64, 1024, 8, 4096
EXACT = float(1 << 53)
#: Bounds of shelves (a row or two for about 8192 vectors, 28 bytes each) go to all tasks up to this many rows.
EDGES = 100_000


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; through doubles where every partial sum fits them."""
    if not len(queries) or not len(rows):
        return np.zeros((len(queries), len(rows)), np.int64)
    if np.abs(queries).max() * np.abs(rows).max() * queries.shape[1] < EXACT:
        return (queries @ rows.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    whole = exact(queries) @ exact(rows).T
    return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row, by score, then least id. ids rise."""
    return np.argsort(-score, axis=1, kind="stable")[:, :k]


def _vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, dim, norm, v: quantised vectors that take part."""
    x = F.col("x")
    good = F.col("vec_id").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    v = F.transform(x, lambda e: F.floor(e * F.lit(float(scale))).cast("double"))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).where(good).select("vec_id", F.size("x").alias("dim"), v.alias("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)))


def _augment(v: np.ndarray, most: float) -> np.ndarray:
    return np.c_[v, np.sqrt(np.maximum(most * most - (v * v).sum(1), 0))]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T, 0))


def _stack(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _bounds(q: np.ndarray, pivots: np.ndarray, most: float, slack: float, cell: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """No row between near and far of a cell's pivot has a higher score with a query (rows) than this."""
    d = _distances(np.c_[q, np.zeros(len(q))], pivots)[:, cell]
    gap = np.maximum(np.maximum(d - far, near - d) - slack, 0)
    return ((q * q).sum(1)[:, None] + most * most - gap * gap) / 2 + slack * (1 + most)


def search(spark: SparkSession, rows: DataFrame, *, k: int = 5, every: int = 50, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", stats: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows of every row whose id is divisible by `every`."""
    scratch = Scratch(spark, "topk")
    vectors = scratch.write(_vectors(rows, id_col, vector_col, scale), "vectors")
    out = StructType.fromDDL("query_id long, rank int, vec_id long, score long")
    dims = {r["dim"]: (r["n"], r["most"]) for r in vectors.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("most")).orderBy(F.desc("n"), "dim").collect()}
    parts = [_search(scratch, vectors.where(F.col("dim") == dim), dim, n, most, k, every) for dim, (n, most) in dims.items()]
    found = spark.createDataFrame([], StructType.fromDDL("uid long, query_id long, vec_id long, score long"))
    for part in parts:
        found = found.union(part)
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(*out.names)


def _search(scratch: Scratch, vectors: DataFrame, dim: int, n: int, most: float, k: int, every: int) -> DataFrame:
    pivots = _augment(np.array([r["v"] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(PIVOTS).collect()]), most)
    slack = 1e-6 * (1 + most)
    keyed_schema = StructType.fromDDL("cell int, far double, vec_id long, v array<double>")

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _distances(_augment(_stack(b.column("v"), dim), most), pivots)
                cell = d.argmin(1)
                yield batch(to_arrow_schema(keyed_schema), cell.astype(np.int32), d[np.arange(len(d)), cell], b.column("vec_id"), b.column("v"))

    parts = max(1, -(-n // (ANNULUS * SHELF)))
    ring_schema = StructType.fromDDL("shelf long, ring long, cell int, near double, far double, ids array<long>, v array<double>, query_ids array<long>, query_at array<int>, query_least array<double>")

    def rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Annuli in order of pivot and distance, and the k-th score of each query within its own."""
        schema, task = to_arrow_schema(ring_schema), TaskContext.get().partitionId()
        held, made = [], 0

        def close() -> pa.RecordBatch:
            nonlocal held, made
            ids = np.concatenate([x[2] for x in held])
            order = np.argsort(ids, kind="stable")
            v, ids, far = np.concatenate([x[3] for x in held])[order], ids[order], np.concatenate([x[1] for x in held])
            at = np.flatnonzero(ids % every == 0)
            own = scores(v[at], v).astype(float)
            own[np.arange(len(at)), at] = -np.inf
            least = -np.sort(-own, axis=1)[:, k - 1] if own.shape[1] >= k else np.full(len(at), -np.inf)
            made += 1
            cell, held = held[0][0], []
            return batch(schema, [task << 20 | (made - 1) // SHELF], [task << 32 | made], [cell], [far.min()], [far.max()], [ids], [v.ravel()], [ids[at]], [at.astype(np.int32)], [least])

        count = 0
        for b in batches:
            cells = b.column("cell").to_numpy(zero_copy_only=False)
            far, ids, v = b.column("far").to_numpy(zero_copy_only=False), b.column("vec_id").to_numpy(zero_copy_only=False), _stack(b.column("v"), dim)
            start = 0
            while start < len(cells):
                if held and (held[0][0] != cells[start] or count == ANNULUS):
                    yield close()
                    count = 0
                end = min(int(np.searchsorted(cells, cells[start], "right")), start + ANNULUS - count)
                held.append((int(cells[start]), far[start:end], ids[start:end], v[start:end]))
                count += end - start
                start = end
        if held:
            yield close()

    keyed = vectors.select("vec_id", "v").mapInArrow(lean(key), keyed_schema)
    index = keyed.repartitionByRange(parts, "cell", "far", "vec_id").sortWithinPartitions("cell", "far", "vec_id").mapInArrow(lean(rings), ring_schema)
    index = scratch.write(index, f"index{dim}")
    edges = index.groupBy("shelf", "cell").agg(F.min("near").alias("near"), F.max("far").alias("far"))
    edges = scratch.write(edges, f"edges{dim}")
    by_cell = edges.count() > EDGES  # too many shelves to tell every task: then queries ask for cells, and so for all shelves of a cell
    told = edges.groupBy("cell").agg(F.min("near").alias("near"), F.max("far").alias("far")).withColumn("shelf", F.col("cell").cast("long")) if by_cell else edges
    told = told.orderBy("shelf", "cell").toArrow()  # at most EDGES rows
    shelves = scratch.spark.sparkContext.broadcast(tuple(told.column(c).to_numpy() for c in ("shelf", "cell", "near", "far")))
    blocks = max(1, -(-n // (every * QUERY_BLOCK)))
    asked_schema = StructType.fromDDL("asked long, part int, ring long, q array<array<double>>, query_ids array<long>, query_at array<int>, query_least array<double>")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The queries of an annulus, for every shelf that may hold a score over the one they have; theirs is there already."""
        shelf, cell, near, far = shelves.value
        names, first = np.unique(shelf, return_index=True)
        for b in batches:
            rows = []
            for r in b.to_pylist():
                q = np.array(r["v"]).reshape(-1, dim)[r["query_at"]]
                may = _bounds(q, pivots, most, slack, cell, near, far) >= np.array(r["query_least"])[:, None]
                for k, hit in zip(names.tolist(), np.logical_or.reduceat(may, first, axis=1).T, strict=True):
                    at = np.flatnonzero(hit).tolist()
                    if at:
                        rows.append((k, r["block"], r["ring"], q[at].tolist(), *([r[c][i] for i in at] for c in ("query_ids", "query_at", "query_least"))))
            if rows:
                yield batch(to_arrow_schema(asked_schema), *zip(*rows, strict=True))

    block = F.pmod(F.xxhash64("ring"), F.lit(blocks)).cast("int").alias("block")
    queries = index.where(F.size("query_ids") > 0).select("ring", "v", "query_ids", "query_at", "query_least", block).mapInArrow(lean(route), asked_schema)
    if by_cell:
        queries = queries.join(edges.select(F.col("cell").cast("long").alias("asked"), "shelf"), "asked").drop("asked").withColumnRenamed("shelf", "asked").select(*asked_schema.names)
    queries = scratch.write(queries, f"asked{dim}")
    pairs = queries.select(F.col("asked").alias("shelf"), F.col("part").alias("block")).distinct()  # a shelf goes only to the blocks that ask for it
    index = scratch.read(f"index{dim}", ring_schema).select("shelf", "ring", "cell", "near", "far", "ids", "v").join(pairs, "shelf")
    found_schema = StructType.fromDDL("uid long, query_id long, vec_id long, score long")

    def expand(left: pa.Table, right: pa.Table) -> pa.Table:
        """One query block over one shelf, annulus by annulus from the best bound on."""
        schema = to_arrow_schema(found_schema)
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        asked = {(r["ring"], a): (r["ring"], i, a, least, q) for r in left.to_pylist() for i, a, least, q in zip(r["query_ids"], r["query_at"], r["query_least"], r["q"], strict=True)}
        asked = list(asked.values())  # once, though it may ask for two cells of the shelf
        q = np.array([x[4] for x in asked])
        ring, at, least = np.array([x[0] for x in asked]), np.array([x[2] for x in asked]), np.array([x[3] for x in asked])
        annuli = right.to_pylist()
        bound = _bounds(q, pivots, most, slack, *(np.array([r[c] for r in annuli]) for c in ("cell", "near", "far")))
        top = [np.empty((0, 2), np.int64) for _ in asked]
        for j in np.argsort(-bound.max(0), kind="stable").tolist():
            open_ = np.flatnonzero(bound[:, j] >= least)
            if not len(open_):
                continue
            ids, v = np.array(annuli[j]["ids"], np.int64), np.array(annuli[j]["v"]).reshape(-1, dim)
            score = scores(q[open_], v)
            for row, s in zip(open_.tolist(), score, strict=True):
                fits = np.flatnonzero(s >= least[row])
                if annuli[j]["ring"] == ring[row]:
                    fits = fits[fits != at[row]]
                if len(fits):
                    both = np.concatenate([top[row], np.c_[s[fits], ids[fits]]])
                    top[row] = both[np.lexsort((both[:, 1], -both[:, 0]))[:k]]
                    if len(top[row]) == k:
                        least[row] = max(least[row], float(top[row][-1, 0]))
        size = [len(t) for t in top]
        flat = np.concatenate(top)
        uid = np.repeat(ring * ANNULUS + at, size)
        return pa.table([uid, np.repeat(np.array([x[1] for x in asked], np.int64), size), flat[:, 1], flat[:, 0]], schema=schema)

    return queries.groupBy("asked", "part").cogroup(index.select(F.col("shelf").alias("s"), F.col("block").alias("b"), "ring", "cell", "near", "far", "ids", "v").groupBy("s", "b")).applyInArrow(expand, found_schema)
