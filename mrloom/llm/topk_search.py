"""Exact top-k search by inner product, with cover trees of queries and data walked together.

The tree's top is shared: pivots, taken farthest-first from a bounded sample, part queries and data
into cells, each with its covering radius. A cell's rows are dealt to chunks of bounded size (so a hot cell, or one very
common vector, is many chunks), its queries to groups. Each group first searches its own cell and those whose
pivots score best; its worst kth score then prunes the other cells: no row of a cell can score more than

    <q, p> + |q| r_p + |p| r_q + r_q r_p

with the centres q, p and the radii r_q, r_p. Within a task, a cover tree of the chunk and one of its queries go on in the
same way: pairs of nodes are taken best bound first and dropped when the bound is below the query
node's worst kth score; a bound is computed as its pair comes up. The number of pivots grows with the rows. A chunk goes out to
those blocks of queries alone that search its cell. The sample places the pivots alone: every row is indexed, and the result is
exact whatever they are.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor do rows
without an id; rows that share an id are candidates each for itself, and query rows that share one are ranked together, a candidate coming up once
for each of them (rows of the query's id are no candidates); components beyond a long count as its ends, and so do scores
(at the lower end one more than the least long); shorter vectors count as padded with zeros; with fewer than k candidates all are
returned; ties go to the smaller id; no queries or an empty table give an empty result; only the named columns are read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Rows that place the pivots, most pivots, rows of a chunk, queries of a group and of a task's block, points of a leaf, children of a node.
SAMPLE, PIVOTS, CHUNK, GROUP, QUERIES, LEAF, FANOUT = 4096, 1024, 8192, 512, 65_536, 512, 16
#: Rows for each pivot. A query goes to each cell that it must search, so fewer cells move fewer vectors.
PER_PIVOT = 4000
SEEDS = 3
#: No score: less than any that there is.
NONE = -(1 << 63)


class CoverTree:
    """Nodes as arrays: centre (a point's number), measured covering radius, children or a leaf's points.

    A node's children are points more than half its radius apart, its own centre the first, each with the
    points nearest to it; at most FANOUT of them.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.below: list[list[int]] = []
        self.held: list[np.ndarray] = []
        if len(points):
            todo = [(self._node(0, np.arange(len(points))))]
            while todo:
                todo += self._split(todo.pop())

    def _node(self, centre: int, members: np.ndarray) -> int:
        self.centre.append(centre)
        self.radius.append(float(np.sqrt(((self.points[members] - self.points[centre]) ** 2).sum(axis=1).max())))
        self.below.append([])
        self.held.append(members)
        return len(self.centre) - 1

    def _split(self, node: int) -> list[int]:
        members, radius = self.held[node], self.radius[node]
        if len(members) <= LEAF or radius == 0:
            return []
        own = self.points[members]
        centres, owner = [self.centre[node]], np.zeros(len(members), np.int64)
        gap = ((own - self.points[centres[0]]) ** 2).sum(axis=1)
        while len(centres) < FANOUT and gap.max() > (radius / 2) ** 2:
            far = int(gap.argmax())
            d = ((own - own[far]) ** 2).sum(axis=1)
            closer = d < gap
            owner[closer], gap[closer] = len(centres), d[closer]
            centres.append(int(members[far]))
        self.below[node] = [self._node(c, members[owner == k]) for k, c in enumerate(centres)]
        return self.below[node]


def _largest(queries: np.ndarray, data: np.ndarray) -> int:
    """No inner product of these, nor a sum on the way to one, is greater."""
    return max(1, *(abs(int(f(x))) for x in (queries, data) for f in (np.min, np.max))) ** 2 * max(1, queries.shape[1]) if queries.size and data.size else 1


def inner_products(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, cut to longs above NONE."""
    largest = _largest(queries, data)
    if largest < 1 << 53:
        return (queries.astype(np.float64) @ data.astype(np.float64).T).astype(np.int64)
    if largest < 1 << 62:
        return queries @ data.T
    whole = queries.astype(object) @ data.astype(object).T
    return np.clip(whole, NONE + 1, -NONE - 1).astype(np.int64)


def merge_hits(best: np.ndarray, at: np.ndarray, own: np.ndarray, rows: np.ndarray, scores: np.ndarray, low: np.ndarray) -> None:
    """Takes the scores (queries own, data rows) that reach low into the k best of each query. The few that do are sorted, not all."""
    k = best.shape[1]
    hit = scores >= low[:, None]
    if hit.sum() > 4 * k * len(own):
        kth = np.partition(scores, -k, axis=1)[:, -k]
        hit &= scores >= kth[:, None]
    row, column = np.nonzero(hit)
    if not len(row):
        return
    touched = np.unique(row)
    r = np.concatenate([np.repeat(touched, k), row])
    s = np.concatenate([best[own[touched]].ravel(), scores[row, column].astype(np.int64)])
    w = np.concatenate([at[own[touched]].ravel(), rows[column]])
    order = np.lexsort((w, ~s, r))
    starts = np.searchsorted(r[order], touched)
    first = order[starts[:, None] + np.arange(k)[None, :]]
    best[own[touched]], at[own[touched]] = s[first], w[first]


def dual_search(queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the scores and row numbers of its k best rows (NONE where there are fewer); data by ascending id.
    floors: scores that k other rows are known to reach, so that lesser ones are of no use."""
    q_tree, d_tree = CoverTree(queries.astype(np.float64)), CoverTree(data.astype(np.float64))
    best = np.full((len(queries), k), NONE, np.int64)
    at = np.full((len(queries), k), -1, np.int64)
    q_norm, d_norm = (np.sqrt((t.points[t.centre] ** 2).sum(axis=1)) for t in (q_tree, d_tree))
    q_centre, d_centre = (np.array(t.centre) for t in (q_tree, d_tree))
    q_r, d_r = np.array(q_tree.radius), np.array(d_tree.radius)
    exact = _largest(queries, data) < 1 << 53  # the trees' points are doubles, and so are the scores
    shared = np.isin(query_ids, ids)

    def bounds(qs: list[int], ds: list[int]) -> np.ndarray:
        """Of all pairs of these nodes, as one row. There is room for rounding; scores themselves are whole numbers, cut at the least long."""
        a, b, r, s = q_norm[qs, None], d_norm[None, ds], q_r[qs, None], d_r[None, ds]
        found = (q_tree.points[q_centre[qs]] @ d_tree.points[d_centre[ds]].T + a * s + r * b + r * s) * (1 + 1e-9) + 1 + 2e-9 * (a * b + a * s + r * b + r * s)
        return np.maximum(found, float(NONE) + 4096).ravel()

    def worst(q: int) -> int:
        own = q_tree.held[q]
        return int(np.maximum(best[own, -1], floors[own]).min())

    heap = [(-bounds([0], [0])[0], 0, 0)]
    while heap:
        bound, q, d = heapq.heappop(heap)
        if -bound < worst(q):
            continue
        q_down, d_down = q_tree.below[q], d_tree.below[d]
        if q_down and (not d_down or q_r[q] >= d_r[d]):
            qs, ds = q_down, [d]
        elif d_down:
            qs, ds = [q], d_down
        else:
            own, rows = q_tree.held[q], d_tree.held[d]
            low = np.maximum(best[own, -1], floors[own])
            if exact:
                scores, low, none = q_tree.points[own] @ d_tree.points[rows].T, low.astype(np.float64), -np.inf
            else:
                scores, low, none = inner_products(queries[own], data[rows]), np.maximum(low, NONE + 1), NONE
            if shared[own].any():
                scores[query_ids[own][:, None] == ids[rows][None, :]] = none
            merge_hits(best, at, own, rows, scores, low)
            continue
        for most, x in zip(bounds(qs, ds).tolist(), [(a, b) for a in qs for b in ds], strict=True):
            if most >= worst(x[0]):
                heapq.heappush(heap, (-most, *x))
    return best, at


def matrix(column: pa.ChunkedArray | pa.Array, width: int = 0) -> np.ndarray:
    """Vectors as rows, shorter ones padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    width = max(width, int(sizes.max(initial=0)))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _task(k: int):
    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not queries.num_rows or not data.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        data = data.sort_by("vec_id")
        width = max(matrix(queries.column("vector")).shape[1], matrix(data.column("vector")).shape[1])
        query_ids, ids = queries.column("query_id").to_numpy(), data.column("vec_id").to_numpy()
        best, at = dual_search(matrix(queries.column("vector"), width), query_ids, queries.column("floor").to_numpy(), matrix(data.column("vector"), width), ids, k)
        row, rank = np.nonzero(at >= 0)
        return pa.table({"query_id": query_ids[row], "vec_id": ids[at[row, rank]], "score": best[row, rank]})

    return run


def farthest_first(sample: np.ndarray, n: int) -> np.ndarray:
    chosen = [0]
    gap = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < n and gap.max(initial=0) > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _cells(pivots: np.ndarray):
    """Nearest pivot and the distance to it. Pivots are as wide as the widest vector of the sample."""

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("vector"), pivots.shape[1]).astype(np.float64)
            p = np.pad(pivots, ((0, 0), (0, x.shape[1] - pivots.shape[1])))
            cell = ((p**2).sum(axis=1)[None, :] - 2 * x @ p.T).argmin(axis=1) if len(x) else np.zeros(0, np.int64)
            distance = np.sqrt(((x - p[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(cell, pa.int32()), pa.array(distance * (1 + 1e-9))], names=["vec_id", "vector", "cell", "distance"])

    return run


def _survivors(pivots: np.ndarray, radii: np.ndarray, seeds: list[list[int]]):
    """The cells that a group of queries must still search."""
    norms = np.sqrt((pivots**2).sum(axis=1))

    def run(batches):
        for batch in batches:
            rows: list[tuple[int, int, int]] = []
            for own, group, radius, worst in zip(*(batch.column(c).to_pylist() for c in ("own", "grp", "radius", "worst")), strict=True):
                bound = pivots @ pivots[own] + norms[own] * radii + radius * norms + radius * radii
                slack = 1 + 1e-6 * (norms[own] * norms + norms[own] * radii + radius * norms + radius * radii)
                rows += [(own, group, int(c)) for c in np.flatnonzero((bound + slack >= worst) & (radii >= 0)) if c not in seeds[own]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in (zip(*rows, strict=True) if rows else [[]] * 3)], names=["own", "grp", "cell"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score). is_query: a condition on vec_id; components become floor(scale * x)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("e")).where("vec_id IS NOT NULL AND e IS NOT NULL")
    rows = rows.where(F.forall("e", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    rows = rows.select("vec_id", F.transform("e", lambda x: F.floor(x.cast("double") * scale)).alias("vector"))
    rows = stored(rows, "vectors")
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    width = max((len(r["vector"]) for r in sample), default=0)
    held = np.array([[*r["vector"], *[0] * (width - len(r["vector"]))] for r in sample], np.float64).reshape(len(sample), width)
    pivots = farthest_first(held, max(1, min(PIVOTS, total // PER_PIVOT))) if len(held) else held
    celled = stored(rows.mapInArrow(_cells(pivots), "vec_id long, vector array<long>, cell int, distance double"), "cells")
    n, radii = np.zeros(len(pivots), np.int64), np.full(len(pivots), -1.0)
    for r in celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("r")).collect():  # at most as many rows as pivots
        n[r["cell"]], radii[r["cell"]] = r["n"], r["r"]
    chunks = F.lit([int(-(-x // CHUNK)) or 1 for x in n] or [1])
    queries = celled.where(is_query)
    per_cell = {r["cell"]: r["n"] for r in queries.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    groups = F.lit([-(-per_cell.get(c, 0) // GROUP) or 1 for c in range(len(pivots))] or [1])
    blocks = -(-sum(per_cell.values()) // QUERIES) or 1
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    queries = queries.select(F.col("vec_id").alias("query_id"), "vector", F.col("cell").alias("own"), "distance", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.get(groups, "cell")).cast("int").alias("grp"))
    # The vector is dealt with the id, so that rows that share one are no hot chunk.
    data = celled.select("vec_id", "vector", "cell", F.pmod(F.xxhash64("vec_id", "vector"), F.get(chunks, "cell")).cast("int").alias("chunk"))

    reach = pivots @ pivots.T
    seeds = [sorted({own, *(int(c) for c in np.argsort(-reach[own])[:SEEDS])}) for own in range(len(pivots))]

    def search(asked: DataFrame) -> DataFrame:
        """asked: query_id, vector, floor and the cell to search."""
        asked = stored(asked.withColumn("block", block), "asked")
        wanted = spark.read.schema(asked.schema).parquet(asked.stored_at).select("cell", "block").distinct()  # read anew: no self-join
        asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.get(chunks, "cell") - 1)))
        key = ["cell", "chunk", "block"]
        return asked.groupBy(*key).cogroup(data.join(wanted, "cell").groupBy(*key)).applyInArrow(_task(k), "query_id long, vec_id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = stored(search(queries.select("query_id", "vector", F.lit(NONE).cast("long").alias("floor"), F.explode(F.get(F.lit(seeds or [[0]]), "own")).alias("cell"))).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "seeds")
    floors = first.where(F.col("rank") == k).groupBy("query_id").agg(F.max("score").alias("floor"))
    floored = stored(queries.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(NONE).cast("long"))), "floors")
    left = floored.groupBy("own", "grp").agg(F.max("distance").alias("radius"), F.min("floor").alias("worst")).mapInArrow(_survivors(pivots, radii, seeds), "own int, grp int, cell int")
    second = search(floored.join(left, ["own", "grp"]).select("query_id", "vector", "floor", "cell"))
    found = first.select("query_id", "vec_id", "score").unionByName(second)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
