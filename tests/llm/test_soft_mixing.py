import numpy as np
from mrloom.llm import soft_mixing as M
from pyspark.sql import functions as F


def test_rates_meet_targets_and_equal_a_plain_solver(spark):
    rng = np.random.default_rng(0)
    n = rng.integers(0, 200, 300)
    p = rng.dirichlet([0.2, 0.2, 0.2], 300)
    posts = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p, strict=True)], "_m_words long, _m_p0 double, _m_p1 double, _m_p2 double")
    shares = [0.1, 0.3, 0.6]
    rate = M.fit_rates(posts, shares, growth=1.0)
    got = np.array([r[0] for r in posts.select(rate.alias("r")).collect()])
    assert (got >= 0).all()
    a = n[:, None] * p
    off = (got[:, None] * a).sum(axis=0) - np.array(shares) * n.sum()
    assert np.abs(off).max() < 2e-4 * n.sum()
    m, r = np.linalg.inv(a.T @ a), np.ones(300)
    for _ in range(200):
        r = np.maximum(0, r - a @ (m @ ((r[:, None] * a).sum(axis=0) - np.array(shares) * n.sum())))
    assert np.abs(got - r).max() < 0.02


def test_rows_without_words_and_empty_tables(spark):
    schema = "_m_words long, _m_p0 double, _m_p1 double"
    assert spark.createDataFrame([(0, 0.5, 0.5)], schema).select(M.fit_rates(spark.createDataFrame([(0, 0.5, 0.5)], schema), [1.0, 1.0])).first()[0] == 1.0
    assert spark.createDataFrame([], schema).select(M.fit_rates(spark.createDataFrame([], schema), [1.0, 1.0]).alias("r")).count() == 0


def test_copies_meet_rates_in_the_mean(spark):
    rows = spark.range(4000).withColumn("rate", F.lit(1.25)).select(M.copies(F.col("rate"), "id").alias("c"))
    counts = {r["c"]: r["count"] for r in rows.groupBy("c").count().collect()}
    assert set(counts) == {1, 2} and 850 < counts[2] < 1150


def docs_and_labels(spark):
    rows = [(i, ("plain words here " * 8 if i % 3 else "you idiot moron clown ") + f"u{i}", "x", 1) for i in range(240)]
    rows += [(None, None, "x", 1), (500, "", "x", 1), (7, rows[7][1], "x", 1)]
    labels = [(i, int(i % 3 == 0)) for i in range(0, 240, 2)] + [(None, 1), (3, None), (5, 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, domain string, held int"), spark.createDataFrame(labels, "doc_id long, domain int")


def test_mix(spark):
    docs, labels = docs_and_labels(spark)
    mixed = M.mix(docs, labels, [0.98, 0.02], 1.0)
    assert mixed.columns == docs.columns
    n = {r["t"]: r["count"] for r in mixed.groupBy(F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False)).alias("t")).count().collect()}
    assert n[False] >= 160 and n.get(True, 0) < 60
    assert M.mix(docs.where("false"), labels, [0.5, 0.5]).count() == 0
    assert M.mix(docs, labels.where("false"), [0.5, 0.5]).count() > 0


def test_classifier_on_held_out_rows(spark):
    docs, labels = docs_and_labels(spark)
    posts = M.add_posteriors(docs.select("doc_id", "text"), *M.fit_posteriors(docs, labels, 2)).where("doc_id < 240 AND doc_id % 2 = 1").collect()
    assert sum((r["_m_p1"] > 0.5) == (r["doc_id"] % 3 == 0) for r in posts) > 0.95 * len(posts)
    assert all(abs(r["_m_p0"] + r["_m_p1"] - 1) < 1e-9 for r in posts)
