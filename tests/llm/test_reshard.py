import itertools
import random

from mrloom.llm import reshard as M
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, source string, size int, shard string, slot int"


def test_cheapest_moves_meet_capacities_and_keep_the_most():
    rng = random.Random(1)
    for _ in range(200):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        sizes = [rng.randint(0, 30) for _ in range(n)]
        room = M.even_capacities(sum(sizes) + rng.randint(0, 9), m)
        homes = [j if j < m else None for j in range(n)]
        moves = M.cheapest_moves(sizes, homes, room)
        assert [sum(a for i, _, a in moves if i == k) for k in range(n)] == sizes
        assert all(sum(a for _, j, a in moves if j == k) <= room[k] for k in range(m))
        stay = sum(a for i, j, a in moves if homes[i] == j)
        assert stay == sum(min(sizes[k], room[k]) for k in range(min(n, m)))


def made():
    rng = random.Random(2)
    rows = [(rng.randint(0, 900), "wörd " * rng.randint(0, 60), f"s{rng.choice([0, 0, 0, 1, 2, 3])}", 1, "x", 2) for _ in range(700)]
    return [*rows, (None, "a", None, 1, None, 2), (5, None, "s1", 1, "x", 2), (5, "", "s1", 1, "x", 2), (6, "same", "s1", 1, "x", 2), (6, "same", "s1", 1, "x", 2), (7, "long " * 400, "s2", 1, "x", 2)]


def test_laws(spark, tmp_path):
    docs = spark.createDataFrame(made(), SCHEMA)
    rows = M.reshard(docs, M.by_source(docs, 4), 4, str(tmp_path / "a"), bucket_rows=50).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in rows) == sorted((r[0] or -1, r[1] or "") for r in made())
    size = {s: sum(r["size"] for r in rows if r["shard"] == s) for s in range(4)}
    assert max(size.values()) - min(size.values()) < 0.05 * max(size.values())
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert all(r["size"] == len((r["text"] or "").encode()) + 8 for r in rows)


def test_clashing_columns_and_untouched_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, "abc", "s", 1, "x", 2) for i in range(40)], SCHEMA).withColumn("_k", F.lit(1))
    old = (F.col("doc_id") % 4).cast("int")
    out = M.reshard(docs, old, 4, str(tmp_path / "b"), capacities=[11 * 10] * 4).collect()
    assert len(out) == 40 and all(r["shard"] == r["doc_id"] % 4 for r in out)
    assert not (tmp_path / "b" / "_r_shard=0").exists()


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.reshard(docs, M.by_source(docs), 4, str(tmp_path / "c")).count() == 0
    assert list(itertools.chain(M.even_capacities(5, 3))) == [2, 2, 1]
