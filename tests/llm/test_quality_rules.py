import random

from mrloom.llm import quality_rules as M
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, quality string, label int"


def made(n=400):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randint(0, 200)) for _ in range(rng.randint(20, 80))]
        bad = rng.random() < 0.3
        if bad:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [w + "$$$" for w in words]
        rows.append((i, " ".join(words) + ".", "x", 1))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def test_learns_and_ignores_held_out(spark):
    rows, labels = made()
    docs = spark.createDataFrame([*rows, (None, None, None, None), (1, "", "", 0), (2, "word " * 20000, "", 0)], SCHEMA)
    table = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, quality int")
    rules = M.fit(M.add_statistics(docs), table)
    assert 0 < len(rules.weights) < 120
    scored = M.add_statistics(docs).select("doc_id", rules.score().alias("s"), M.held_out("doc_id").alias("h")).collect()
    assert len(scored) == len(rows) + 3 and all(0 <= r["s"] <= 1 for r in scored)
    truth = dict(labels)
    held = [r for r in scored[: len(rows)] if r["h"]]
    assert sum((r["s"] >= M.CUT) == truth[r["doc_id"]] for r in held) > 0.97 * len(held)
    flipped = spark.createDataFrame([(i, 1 - q) for i, q in labels], "doc_id long, quality int")
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    mixed = table.where(~out).unionByName(flipped.where(out))
    assert M.fit(M.add_statistics(docs), mixed) == rules


def test_keep_good_keeps_columns(spark):
    rows, labels = made(200)
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = M.keep_good(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, q in labels if q}


def test_without_labels_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "a", "", 0)], SCHEMA)
    assert M.fit(M.add_statistics(docs), none).weights == {}
    assert M.keep_good(docs, none).count() == 1
    assert M.keep_good(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_statistics_of_odd_texts():
    assert M.statistics(None) == M.statistics(b"") == [0.0] * len(M.STATISTICS)
    for text in (" ", "\n\n", "é" * 50, "| | |", "a" * 100000):
        assert len(M.statistics(text.encode())) == len(M.STATISTICS)
    got = dict(zip(M.STATISTICS, M.statistics("Aa bb bb\nAa bb bb\n9!".encode()), strict=True))
    assert got["words"] == 7 and got["lines"] == 3 and abs(got["repeated_lines"] - 1 / 3) < 1e-9 and got["stutter"] == 2 / 7
