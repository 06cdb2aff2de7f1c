import random

from mrloom.llm import topk_search as M
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, cell int, score long"


def brute(rows, k, step):
    import math

    import numpy as np

    held = [(i, [max(-(1 << 63), min((1 << 63) - 1, math.floor(1024 * float(np.float32(x))))) for x in e]) for i, e, *_ in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    cut = lambda s: max(-(1 << 63) + 1, min((1 << 63) - 1, s))
    out = []
    for q in sorted({i for i, _ in held if i % step == 0}):
        scored = sorted((-cut(sum(a * b for a, b in zip(v, w, strict=False))), i) for j, v in held if j == q for i, w in held if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return out


def made(n, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)], 0, 1, 2) for i in range(n)]
    same = [0.5] * 8
    rows += [(n + i, same, 0, 1, 2) for i in range(n // 3)]
    return [*rows, (None, same, 0, 1, 2), (4 * n, None, 0, 1, 2), (4 * n + 1, [float("nan")] * 8, 0, 1, 2), (4 * n + 2, [None] * 8, 0, 1, 2), (4 * n + 3, [float("inf")] + [0.0] * 7, 0, 1, 2), (0, [9.0] * 8, 0, 1, 2), (3, rows[3][1], 0, 1, 2), (4 * n + 5, [0.1, 0.2], 0, 1, 2)]


def found(spark, rows, k, step):
    frame = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in M.top_k(frame, F.col("vec_id") % step == 0, k).collect())


def test_against_brute_force(spark, monkeypatch):
    rows = made(600, 1)
    assert found(spark, rows, 10, 20) == brute(rows, 10, 20)
    for name, value in (("CHUNK", 100), ("GROUP", 5), ("QUERIES", 7), ("LEAF", 8), ("PIVOTS", 6), ("SAMPLE", 50), ("FANOUT", 4)):
        monkeypatch.setattr(M, name, value)
    rows = made(2500, 2)
    assert found(spark, rows, 10, 50) == brute(rows, 10, 50)


def test_few_candidates_and_empty(spark):
    rows = [(0, [1.0, 2.0], 0, 1, 2), (100, [1.0, 2.0], 0, 1, 2), (7, [0.5, 0.5], 0, 1, 2)]
    assert found(spark, rows, 10, 100) == brute(rows, 10, 100)
    assert found(spark, [], 10, 100) == []
    assert found(spark, [(1, [1.0], 0, 1, 2)], 10, 100) == []


def test_extreme_values_and_shared_ids(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1, 1]) * 10 ** rng.randint(0, 17) for _ in range(4)], 0, 1, 2) for i in range(60)]
    rows = [(i, [float(x) for x in e], *r) for i, e, *r in rows]
    rows += [(20, [1e13] * 4, 0, 1, 2), (0, [-1e13] * 4, 0, 1, 2), (7, rows[7][1], 0, 1, 2), (8, [1e30, -1e30, 0.0, 1.0], 0, 1, 2)]
    assert found(spark, rows, 10, 20) == brute(rows, 10, 20)
    assert found(spark, [(0, [1e13], 0, 1, 2), (1, [1e13], 0, 1, 2), (2, [-1e13], 0, 1, 2)], 10, 10) == [(0, 1, 1, (1 << 63) - 1), (0, 2, 2, -(1 << 63) + 1)]


def test_query_rows_of_one_id_are_ranked_together(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [3.0, 1.0]), (1, [1.0, 1.0]), (2, [0.0, 5.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in M.top_k(frame, F.col("vec_id") % 100 == 0, 4, scale=1).orderBy("rank").collect()]
    every = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for k, q in rows if k == 0 for i, v in rows if i)
    assert got == [(0, r + 1, i, int(-s)) for r, (s, i) in enumerate(every[:4])]


def test_only_scores_that_reach_the_floor_are_sorted(monkeypatch):
    """Vectors without structure prune nothing; all pairs are then multiplied, but few are sorted."""
    import numpy as np

    rng, seen, lexsort = np.random.default_rng(1), [], np.lexsort
    data = rng.integers(-400, 400, (3000, 16))
    monkeypatch.setattr(np, "lexsort", lambda keys, axis=-1: seen.append(np.size(keys[0])) or lexsort(keys, axis=axis))
    ids = np.arange(3000)
    best, at = M.dual_search(data[:200], ids[:200], np.full(200, M.NONE), data, ids, 10)
    scores = data[:200] @ data.T
    scores[ids[:200], ids[:200]] = M.NONE
    order = lexsort((np.broadcast_to(ids, scores.shape), ~scores), axis=1)[:, :10]
    assert (at == order).all() and (best == np.take_along_axis(scores, order, axis=1)).all()
    assert sum(seen) < 200 * 3000 / 4
