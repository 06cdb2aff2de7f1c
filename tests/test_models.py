
from mrloom import schema as S
from mrloom.operators import training
from mrloom.plans import base, models

DATA = "/root/testdata/sf0.001"


class Stopped(Exception):
    pass


def asked(monkeypatch, spark, name, of):
    """Arguments with which a query calls a function of training."""
    seen = {}

    def stop(*args, **how):
        seen.update(args=args, how=how)
        raise Stopped

    monkeypatch.setattr(training, of, stop)
    try:
        base.QUERIES[name](spark, DATA)
    except Stopped:
        pass
    monkeypatch.undo()
    return seen["args"], seen["how"]


def sizes(rows):
    return {r["count"] for r in rows.groupBy("code").count().collect()}


def test_parameters(spark, monkeypatch):
    assert (training.forest().getNumTrees(), training.forest().getMaxDepth(), training.forest().getFeatureSubsetStrategy()) == (50, 9, "20")
    for name, of in [("g4_train_forest", "train_forest"), ("g5_one_vs_rest", "train_one_vs_rest"), ("g8_feature_importance", "train_forest"), ("d6_score_modality", "train_forest"), ("d7_label_decode", "train_forest"), ("g11_batch_inference", "train_forest"), ("g12_metric_test", "train_forest")]:
        (rows, features), how = asked(monkeypatch, spark, name, of)
        assert features == S.FEATURES and len(features) == 28 and not how, name
    assert sizes(rows) == {800}
    (rows, features, k), how = asked(monkeypatch, spark, "g9_k_fold_models", "cross_validate")
    assert (features, k, how, sizes(rows)) == (S.FEATURES, 5, {}, {800})
    (rows, features, trees, depths, k), how = asked(monkeypatch, spark, "g13_grid_search", "grid_accuracies")
    assert (features, len(trees) * len(depths), max(trees), max(depths), k, how, sizes(rows)) == (S.FEATURES, 88, 200, 30, 5, {}, {5000})


def test_features_are_filled(spark):
    row = models._coded_rows(spark, DATA).first()
    assert all(row[f] is not None for f in S.FEATURES) and row["SAR"] == S.MISSING


def small(spark):
    rows = [(f"f{i:03d}", i % 3, float(i % 3) + (i % 7) / 100, float(i % 5), 0.0) for i in range(150)]
    return spark.createDataFrame(rows, "file_name string, code int, a double, b double, c double"), ["a", "b", "c"]


def test_one_vs_rest_importances_folds_and_grid(spark):
    rows, names = small(spark)
    right = lambda model, x: model.transform(training.assembled(x, names)).where("prediction = code").count()
    assert right(training.train_one_vs_rest(rows, names, trees=3, depth=3), rows) == 150
    ranked = training.importances(spark, training.train_forest(rows, names, trees=5, depth=3), names).collect()
    assert ranked[0]["feature"] == "a" and abs(sum(r["importance"] for r in ranked) - 1) < 1e-9
    assert {r["feature"]: r["is_zero"] for r in ranked}["c"] and all(r["spread"] >= 0 for r in ranked)
    folded = training.with_folds(rows, "code", "file_name", 5).cache()
    accuracies, best = training.cross_validate(folded, names, 5, trees=3, depth=3)
    assert len(accuracies) == 5 and min(accuracies) > 0.9 and right(best, rows) > 140
    model, table = training.grid_search(rows, names, [1, 3], [1, 3], 2)
    assert sorted(t[:2] for t in table) == [(1, 1), (1, 3), (3, 1), (3, 3)] and right(model, rows) > 140
    for tree in (True, False):
        assert right(training.train_orientation(rows, names, tree), rows) == 150


def test_balanced_rows(spark):
    rows = spark.createDataFrame([("a", i) for i in range(7)] + [("b", i) for i in range(2)] + [(None, 1)], "label string, k int")
    got = sorted(((r["label"], r["k"], r["copy"]) for r in training.balanced(rows, "label", "k", 5).collect()), key=str)
    assert got == sorted([("a", i, 0) for i in range(5)] + [("b", i, c) for i in range(2) for c in range(2)] + [("b", 0, 2)] + [(None, 1, c) for c in range(5)], key=str)


def test_nested_forests_equal_forests_by_themselves(spark):
    """Every setting of the grid against trees that are grown to its depth alone, summed tree by tree."""
    import numpy as np
    from mrloom.operators import grid

    rng = np.random.default_rng(3)
    made = [(f"f{i:03d}", int(c), i % 4, float(c + rng.normal()), float(rng.integers(0, 5)), 0.0) for i, c in enumerate(rng.integers(0, 3, 260))]
    names, trees, depths = ["a", "b", "c"], [1, 4, 7], [1, 2, 5, 30]
    rows = spark.createDataFrame(made, "file_name string, code int, fold int, a double, b double, c double")
    got = {(r["fold"], r["trees"], r["depth"]): r["accuracy"] for r in grid.accuracies(rows, names, trees, depths, seed=5, block=2).collect()}
    assert len(got) == 4 * 12
    held = sorted((r[2], r[1], *r[3:]) for r in made)
    x = np.column_stack([np.unique([r[2 + i] for r in held], return_inverse=True)[1] for i in range(3)])
    y, folds = np.array([r[1] for r in held]), np.array([r[0] for r in held])
    for f in range(4):
        for d in depths:
            total = 0
            for t in range(1, 8):
                tree = grid.grow(x[folds != f], y[folds != f], 3, d, 2, np.random.default_rng((5, f, t)))
                total = total + grid.depth_votes(tree, x[folds == f], [d])[0]
                if t in trees:
                    assert got[f, t, d] == (total.argmax(1) == y[folds == f]).mean()
    assert np.mean([got[f, 7, 5] for f in range(4)]) > 0.5


def test_grown_trees_split_by_gini(spark):
    import numpy as np
    from mrloom.operators import grid

    rng = np.random.default_rng(0)
    for _ in range(40):
        n, m, classes = int(rng.integers(2, 40)), 3, 3
        x, y = rng.integers(0, 6, (n, m)), rng.integers(0, classes, n)
        weight, node = rng.integers(1, 3, n).astype(float), rng.integers(0, 2, n)
        node[:2] = 0, 1
        total = np.array([np.bincount(y[node == k], weight[node == k], classes) for k in (0, 1)])
        feature, cut, gain = grid._best_cuts(x, y, weight, node, total, np.array([[0, 1, 2], [2, 0, 1]]))
        square = lambda t: (t**2).sum() / t.sum() if t.sum() else 0.0
        for k in (0, 1):
            best = 0.0
            for j in range(m):
                for c in range(6):
                    low, own = x[:, j] <= c, node == k
                    one, two = (np.bincount(y[own & s], weight[own & s], classes) for s in (low, ~low))
                    if one.sum() and two.sum():
                        best = max(best, square(one) + square(two) - square(total[k]))
            assert abs(gain[k] - best) < 1e-8 or best < 1e-8 and gain[k] == 0
    tree = grid.grow(rng.integers(0, 50, (300, 4)), rng.integers(0, 2, 300), 2, 30, 4, np.random.default_rng(1))
    leaf = tree[2] == np.arange(len(tree[0]))
    assert (tree[4][leaf].max(1) == 1).mean() > 0.9 and leaf.sum() == (len(leaf) + 1) // 2
    assert grid.blocks([10, 1, 25], 5) == [(1, 1), (2, 6), (7, 10), (11, 15), (16, 20), (21, 25)]
