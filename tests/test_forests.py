"""Stored forests: compiled scores, and the chain with a model."""

import random

import pytest
from mrloom import schema as S
from mrloom.operators import classify, forests, training
from mrloom.plans import base, registry
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
NAMES = ["a", "b", "c d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    made = [(f"f{i:03d}", i % 3, i % 3 + rng.random() * 1.5, rng.random(), float(rng.randint(0, 4)), i % 4) for i in range(240)]
    return spark.createDataFrame(made, "file_name string, code int, a double, b double, `c d` double, fold int").coalesce(2).cache()


def stored(spark, rows, path, **how):
    model = training.train_forest(rows, NAMES, **how)
    forests.save(model, str(path))
    return model, forests.nodes(spark, str(path))


def test_compiled_scores_equal_transform(spark, rows, tmp_path):
    model, nodes = stored(spark, rows, tmp_path / "m", trees=7, depth=6)
    classes = {"x": 0, "y": 1, "z": 2}
    columns = ["file_name", "GUESS_ONNX_CODE", "GUESS_ONNX", "GUESS_ONNX_x", "GUESS_ONNX_y", "GUESS_ONNX_z", "volume_modality"]
    asked = rows.where("code <> 1 OR b < 0.5")
    want = {r["file_name"]: r for r in classify.score(asked, model, NAMES, classes, 0.7).select(*columns).collect()}
    scored = forests.score(asked, nodes, NAMES, classes, 0.7, depth=6, valid=F.col("file_name") != "f007")
    assert set(scored.columns) == {*asked.columns, *columns}
    for r in scored.select(*columns).collect():
        w = want[r["file_name"]]
        if r["file_name"] == "f007":
            assert (r["volume_modality"], r["GUESS_ONNX"], r["GUESS_ONNX_CODE"], r["GUESS_ONNX_x"]) == ("INVALID", "INVALID", None, None)
            continue
        assert (r[1], r[2], r[6]) == (w[1], w[2], w[6])
        assert all(abs(r[i] - w[i]) < 1e-9 for i in (3, 4, 5))
    assert any(w["volume_modality"].startswith("LOW") for w in want.values())
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "AS _trees" not in plan  # no row carries the model


def test_chain_with_a_model(spark):
    nodes, path = base.stored_forest(spark, DATA, trees=5, depth=5)
    vols = base.results(spark, DATA, ["GUESS_ONNX", "GUESS_ONNX_CODE"], nodes).collect()
    assert {r["GUESS_ONNX"] for r in vols} <= {*S.IMAGE_TYPES, "INVALID"} and len({r["GUESS_ONNX"] for r in vols}) > 4
    model = forests.RandomForestClassificationModel.load(path)
    valid = base.with_features(base.volumes(spark, DATA)).where("is_valid")
    want = {r["file_name"]: r["GUESS_ONNX_CODE"] for r in classify.score(valid, model, S.FEATURES).select("file_name", "GUESS_ONNX_CODE").collect()}
    got = {r["file_name"]: r["GUESS_ONNX_CODE"] for r in base.guessed(spark, DATA, nodes).where("is_valid").select("file_name", "GUESS_ONNX_CODE").collect()}
    assert got == want and len(got) > 100
    sessions = registry.queries()["e2_session_dictionary_model"](spark, DATA)
    shown = [c for c in sessions.columns if c.startswith("GUESS_ONNX_")]
    assert len(shown) == len(S.IMAGE_TYPES)
    row = sessions.where("VolumeModality IS NOT NULL").first()
    assert abs(sum(float(row[c]) for c in shown) - 1) < 1e-6


def test_the_chain_makes_its_volumes_once_and_walks_trees_in_the_model(spark, monkeypatch):
    made, volumes = [], base.volumes
    monkeypatch.setattr(base, "volumes", lambda *a: made.append(a) or volumes(*a))
    rows = registry.queries()["d15_run_inference_model"](spark, DATA).collect()
    assert len(made) == 1 and len(rows) == volumes(spark, DATA).count()
    nodes, _ = base.stored_forest(spark, DATA, trees=3, depth=3)
    scored = base.guessed(spark, DATA, nodes)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" not in plan and "Python" not in plan
    gone = scored.where("NOT is_valid").select("volume_modality", "GUESS_ONNX", "GUESS_ONNX_CODE", *(f"GUESS_ONNX_{n}" for n in S.IMAGE_TYPES)).distinct().collect()
    assert [tuple(r) for r in gone] == [("INVALID", "INVALID", *[None] * 11)]


def test_rows_that_no_tree_tells_apart_are_scored_once(spark, rows):
    model = training.train_one_vs_rest(rows, NAMES, trees=4, depth=4)
    cuts = forests.thresholds(spark, model.models, NAMES)
    assert all(c == sorted(set(c)) for c in cuts.values()) and len(cuts["a"]) > 3
    near = cuts["a"][1]
    edge = spark.createDataFrame([("e", 0, a, b, c, 0) for a in (near, near + 1e-12, near - 1e-12, float("nan"), -1e300, 1e300) for b in (0.0, *cuts["b"][:1]) for c in (-1.0, 2.0)], rows.schema)
    asked = rows.unionByName(edge).unionByName(rows).withColumn("label", F.concat(F.lit("c"), F.col("code").cast("string")))
    want = {(r[0], r[1]): r[2] for r in model.transform(training.assembled(asked, NAMES)).groupBy("label", "prediction").count().collect()}
    seen = spark.sparkContext.accumulator(0)
    note = F.udf(lambda x: seen.add(1) or x, "double").asNondeterministic()

    class Counting:
        def transform(self, table):
            return model.transform(table.withColumn("_seen", note(F.lit(0.0)))).where("_seen = 0")

    got = {(r["label"], r["prediction"]): r["n"] for r in forests.counted(Counting(), model.models, asked, NAMES, "label", ["c0", "c1", "c2"]).collect()}
    assert got == want and sum(got.values()) == 2 * 240 + 24
    assert 0 < seen.value <= 240 + 24
