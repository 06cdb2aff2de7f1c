import corpus_pipeline as P
from mrloom.llm import decontaminate, jaccard_join, registry

DATA = "/root/testdata/sf0.001"


def test_stages_do_what_they_say(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    columns = docs.columns
    names = [n for n, _ in P.STAGES]
    assert names[0].startswith("quality") and names[4] == "sharding" and len(names) == 5
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good = P.keep_quality(spark, docs, DATA).cache()
    kept = {r["doc_id"] for r in good.collect()}
    known = [d for d in labels if d in {r["doc_id"] for r in docs.select("doc_id").collect()}]
    assert good.columns == columns and sum((d in kept) == bool(labels[d]) for d in known) > 0.95 * len(known)

    single = P.keep_one_of_each(spark, good, DATA).cache()
    classes = jaccard_join.similar_classes(good).collect()
    assert single.columns == columns and {r["doc_id"] for r in single.collect()} == {r["class_id"] for r in classes}

    clean = P.keep_unleaked(spark, single, DATA).cache()
    leaked = {r["doc_id"] for r in decontaminate.leaks(single, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in single.collect()} - leaked

    mixed = P.mix(spark, clean, DATA).cache()
    assert mixed.columns == columns
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 1").collect()}
    taken = {r["doc_id"] for r in mixed.collect()}
    plain = [r["doc_id"] for r in clean.collect() if r["doc_id"] in labels and r["doc_id"] not in toxic]
    assert sum(d in taken for d in plain) > 0.97 * len(plain)

    sharded = P.shard(spark, mixed, DATA).collect()
    assert len(sharded) == mixed.count() and {r["shard"] for r in sharded} <= set(range(24))


def test_one_of_each_with_null_and_repeated_ids(spark):
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(60))
    rows = [(None, text(0)), (None, text(1)), (None, text(2)), (None, text(2))]  # two copies
    rows += [(5, text(3)), (5, text(4)), (5, text(4) + " more"), (6, text(3))]  # an id of two classes
    rows += [(None, text(5)), (9, text(5) + " more"), (-(1 << 63), text(6)), (None, text(6))]
    rows += [(None, None), (None, ""), (7, " \t"), (7, " \t"), (8, "\u00a0")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string")
    single = P.keep_one_of_each(spark, docs, DATA)
    got = sorted(((r["doc_id"], r["text"]) for r in single.collect()), key=str)
    want = [(None, text(0)), (None, text(1)), (None, text(2)), (5, text(3)), (9, text(5) + " more"), (-(1 << 63), text(6)), (None, None), (None, ""), (7, " \t"), (7, " \t"), (8, "\u00a0")]
    four = [x for x in got if x[1] and x[1].startswith("t4")]
    assert single.columns == docs.columns and len(four) == 1 and four[0][0] == 5
    assert [x for x in got if x not in four] == sorted(want, key=str)


def test_odd_rows_and_empty_tables_pass_every_stage(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars int, shard string, label int, _q string"
    plain = " ".join(f"Plain sentence number {i} stands here, and it is of no note." for i in range(30))
    rows = [(None, None, None, None, None, None, None, None), (1, "", "en", None, 0, "x", 1, "y"), (2, plain, "en", "a", 9, "x", 1, "y"), (2, plain, "en", "a", 9, "x", 1, "y"), (None, plain + " More.", "en", "b", 9, "x", 1, "y"), (3, plain * 60, "en", "a", 9, "x", 1, "y"), (4, " \t", "en", "a", 2, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for frame in (docs, docs.where("false")):
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, frame, DATA)
            found = out.collect()
            assert out.columns == docs.columns and {r["text"] for r in found} <= {r["text"] for r in frame.collect()}, name
            if frame is docs and name != P.STAGES[0][0]:
                assert {plain, plain * 60} & {r["text"] for r in found}, name
        assert P.STAGES[-1][1](spark, frame, DATA).count() == frame.count()


def test_every_operator_is_registered():
    names = registry.queries()
    assert [any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [True] * 10
    assert set(registry.oracle_sql()) <= set(names)
