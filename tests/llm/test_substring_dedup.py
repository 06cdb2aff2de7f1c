import random

import numpy as np
from mrloom.llm import substring_dedup as M

SCHEMA = "doc_id long, text string, key string, kept int"


def brute(rows):
    docs = [(i if i is not None else -(1 << 63), (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in docs:
        for s in range(len(w) - 19):
            x = tuple(w[s : s + 20])
            first[x] = min(first.get(x, (i, s)), (i, s))
    out = []
    for (i, w), (doc_id, _) in zip(docs, rows, strict=True):
        gone = {k for s in range(len(w) - 19) if first[tuple(w[s : s + 20])] < (i, s) for k in range(s, s + 20)}
        out.append((doc_id, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def found(spark, rows, **how):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in M.drop_repeats(frame, **how).collect()), key=str)


def made(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "bé", "c,", "dd"]) + str(rng.randint(0, 40))
    passages = [" ".join(word() for _ in range(rng.randint(18, 45))) for _ in range(6)]
    rows = []
    for i in range(60):
        pieces = [rng.choice(passages) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 5))]
        rows.append((rng.randint(0, 40), " ".join(pieces)))
    loop = " ".join(str(k % 7) for k in range(200))
    return [*rows, (None, passages[0]), (3, None), (4, ""), (500, loop), (501, " ".join([loop] * 20)), (7, rows[7][1]), (7, rows[7][1])]


def test_against_brute_force(spark):
    for seed, how in ((1, {}), (2, {"part_chars": 500})):
        rows = made(seed)
        assert found(spark, rows, **how) == brute(rows)


def test_many_parts_go_by_groups(spark, monkeypatch):
    rows = [*made(5), (900, " ".join(f"n{k}" for k in range(40_000)) + " " + (made(5)[0][1] or "x"))]  # past a segment
    want = brute(rows)
    for width in (1, 3, 50):
        assert found(spark, rows, part_chars=200, width=width) == want
    monkeypatch.setattr(M, "SLICE_WORDS", 60)
    monkeypatch.setattr(M, "DEALT_BYTES", 500)
    assert found(spark, rows, part_chars=200, width=3) == want


def test_small_slices_and_partitions(spark, monkeypatch):
    monkeypatch.setattr(M, "SLICE_WORDS", 50)
    rows = made(4)
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(7)
    assert sorted((tuple(r) for r in M.drop_repeats(frame).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_rolling_equals_direct_hash():
    v = np.random.default_rng(0).integers(0, 1 << 63, 57).astype(np.uint64)
    for width in (1, 5, 10, 20, 57, 58):
        direct = [sum(int(v[i + j]) * pow(M.FACTORS[0], j, 1 << 64) for j in range(width)) % (1 << 64) for i in range(57 - width + 1)]
        assert M.rolling(v, width, M.FACTORS[0]).tolist() == M.mixed(np.array(direct, np.uint64)).tolist()
