"""Grid search over sizes and depths of forests, by nested forests.

The trees of a forest are grown independently, each from a seed of its own, and a tree is grown level by level, so the first trees of a large forest are a smaller
forest, and a deep tree that is cut at a depth is the tree of that depth. One forest of the greatest size and depth for each fold
therefore holds all settings. Spark deals the trees out in blocks; a task grows its block's trees on the rows of the other folds, lets the fold's own rows walk
them, and sums their votes at each depth of the grid. The blocks' votes are then added up in the order of the trees, by fold and depth.

The rows that a search reads are a balanced sample of a given size, so they go to the tasks by broadcast, as codes of their values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _short(codes: np.ndarray) -> np.ndarray:
    """Codes as 16 bits where they fit: those are sorted by digits."""
    return codes.astype(np.uint16) if len(codes) and codes.max() < 1 << 16 else codes


def _best_cuts(x: np.ndarray, y: np.ndarray, weight: np.ndarray, node: np.ndarray, total: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node (0, 1, ...) the feature, cut and gain of its best split among its chosen features; gain 0: none. A value of the cut goes left."""
    nodes, classes = total.shape
    found = np.zeros(nodes)
    feature, cut = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    pure = (total**2).sum(1) / total.sum(1)
    counts = np.zeros((len(y), classes))
    counts[np.arange(len(y)), y] = weight
    for k in range(chosen.shape[1]):
        v = x[np.arange(len(y)), chosen[node, k]]
        order = np.argsort(_short(v), kind="stable")
        order = order[np.argsort(_short(node[order]), kind="stable")]
        n, v = node[order], v[order]
        left = np.cumsum(counts[order], axis=0)
        ends = np.flatnonzero((n[1:] == n[:-1]) & (v[1:] != v[:-1]))
        if not len(ends):
            continue
        first = np.searchsorted(n, np.arange(nodes))
        base = np.where((first > 0)[:, None], left[first - 1], 0.0)
        at = n[ends]
        one = left[ends] - base[at]
        two = total[at] - one
        gain = (one**2).sum(1) / one.sum(1) + (two**2).sum(1) / two.sum(1) - pure[at]
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        most = np.maximum.reduceat(gain, starts)
        here = np.flatnonzero(gain == np.repeat(most, np.diff(np.append(starts, len(at)))))
        here = here[np.unique(at[here], return_index=True)[1]]
        better = gain[here] > found[at[here]] + 1e-9
        here = here[better]
        found[at[here]], feature[at[here]], cut[at[here]] = gain[here], chosen[at[here], k], v[ends[here]]
    return feature, cut, found


def grow(x: np.ndarray, y: np.ndarray, classes: int, depth: int, tries: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """A tree on a bootstrap of the rows: feature, cut, left and right by node (a leaf's are itself), and shares of the classes.

    x: values coded by rank; a split takes the best cut by Gini of so many features drawn for the node. Level by level, so a smaller depth gives the same tree, cut.
    """
    weight = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float)
    rows = np.flatnonzero(weight)
    slot = np.zeros(len(rows), np.int64)  # of each row, among the nodes of the level
    total = np.bincount(y[rows], weight[rows], classes)[None]
    first, levels = 0, []
    while True:
        n = len(total)
        own = first + np.arange(n)
        level = [np.zeros(n, np.int64), np.zeros(n, np.int64), own.copy(), own.copy(), total]
        levels.append(level)
        live = np.flatnonzero((total > 0).sum(1) > 1) if len(levels) <= depth else np.zeros(0, np.int64)
        if not len(live):
            break
        among = np.full(n, -1)
        among[live] = np.arange(len(live))
        inside = among[slot] >= 0
        rows, slot = rows[inside], among[slot[inside]]
        chosen = np.argsort(rng.random((len(live), x.shape[1])), axis=1)[:, :tries]
        f, c, gain = _best_cuts(x[rows], y[rows], weight[rows], slot, total[live], chosen)
        split = np.flatnonzero(gain > 0)
        if not len(split):
            break
        child = np.full((len(live), 2), -1)
        child[split] = np.arange(2 * len(split)).reshape(-1, 2)
        for column, value in zip(level, (f, c, first + n + child[:, 0], first + n + child[:, 1]), strict=False):
            column[live[split]] = value[split]
        slot = child[slot, (x[rows, f[slot]] > c[slot]).astype(int)]
        rows, slot = rows[slot >= 0], slot[slot >= 0]
        total = np.bincount(slot * classes + y[rows], weight[rows], 2 * len(split) * classes).reshape(-1, classes)
        first += n
    feature, cut, left, right, counts = (np.concatenate(c) for c in zip(*levels, strict=True))
    return feature, cut, left, right, counts / counts.sum(1, keepdims=True)


def depth_votes(tree: tuple[np.ndarray, ...], x: np.ndarray, depths: list[int]) -> np.ndarray:
    """For each depth (ascending) the shares of the classes at the node that each row reaches there."""
    feature, cut, left, right, shares = tree
    at, done, out = np.zeros(len(x), np.int64), 0, []
    for depth in depths:
        for _ in range(done, depth):
            at = np.where(x[np.arange(len(x)), feature[at]] <= cut[at], left[at], right[at])
        done = depth
        out.append(shares[at])
    return np.array(out)


def _grower(held, classes: int, depths: list[int], tries: int, seed: int):
    schema = pa.schema([("fold", pa.int32()), ("depth", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("votes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, folds = held.value
        for batch in batches:
            for row in batch.to_pylist():
                own = folds == row["fold"]
                votes = 0
                for t in range(row["first"], row["last"] + 1):
                    tree = grow(x[~own], y[~own], classes, depths[-1], tries, np.random.default_rng((seed, row["fold"], t)))
                    votes = votes + depth_votes(tree, x[own], depths)
                out = [(row["fold"], d, row["first"], row["last"], v.tobytes()) for d, v in zip(depths, votes, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _adder(held, classes: int, trees: list[int]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        _, y, folds = held.value
        fold, total, out = rows["fold"].iloc[0], 0, []
        code = y[folds == fold]
        for last, votes in rows.sort_values("first")[["last", "votes"]].itertuples(index=False):
            total = total + np.frombuffer(votes).reshape(-1, classes)
            if last in trees:
                out.append((fold, last, rows["depth"].iloc[0], int((total.argmax(1) == code).sum()), len(code)))
        return pd.DataFrame(out, columns=["fold", "trees", "depth", "right", "n"])

    return run


def blocks(trees: list[int], size: int) -> list[tuple[int, int]]:
    """First and last tree of blocks of at most size trees that end at each number of trees."""
    out, first = [], 1
    for last in sorted(set(trees)):
        for at in range(first, last + 1, size):
            out.append((at, min(last, at + size - 1)))
        first = last + 1
    return out


def accuracies(rows: DataFrame, features: list[str], trees: list[int], depths: list[int], fold: str = "fold", label: str = "code", tries: int | None = None, seed: int = 99, block: int = 5) -> DataFrame:
    """(fold, trees, depth, accuracy) of every setting: the share of a fold's rows that a forest on the other folds gets right.

    rows: a bounded sample (it goes through the driver to all tasks) with codes from 0, folds and features without nulls; tries: features drawn for a node, default the root of their number.
    """
    spark = rows.sparkSession
    held = rows.select(F.col(fold).cast("int").alias("_fold"), F.col(label).cast("int").alias("_code"), *(F.col(f"`{f}`").cast("double").alias(f"_{i}") for i, f in enumerate(features))).toPandas()
    held = held.sort_values(list(held.columns), kind="stable")  # whatever order the rows come in
    x = np.column_stack([np.unique(held[f"_{i}"].to_numpy(), return_inverse=True)[1] for i in range(len(features))]).astype(np.int64)
    y = held["_code"].to_numpy()
    classes = int(y.max()) + 1 if len(y) else 1
    shared = spark.sparkContext.broadcast((x, y, held["_fold"].to_numpy()))
    work = [(int(f), a, b) for a, b in blocks(trees, block) for f in sorted(set(held["_fold"]))]
    dealt = spark.createDataFrame(work, "fold int, first int, last int").repartitionByRange(max(1, len(work)), "first", "fold")
    votes = dealt.mapInArrow(_grower(shared, classes, sorted(depths), tries or max(1, round(len(features) ** 0.5)), seed), "fold int, depth int, first int, last int, votes binary")
    counts = votes.groupBy("fold", "depth").applyInPandas(_adder(shared, classes, trees), "fold int, trees int, depth int, right long, n long")
    return counts.select("fold", "trees", "depth", (F.col("right") / F.col("n")).alias("accuracy"))
