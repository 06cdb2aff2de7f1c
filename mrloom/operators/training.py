"""Model training on sheets, and its evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import DecisionTreeClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import forget, stored
from . import grid
from .ranks import ranked


def unique_rows(table: DataFrame, features: list[str], order: str) -> DataFrame:
    """The first row of each feature vector."""
    w = Window.partitionBy(*features).orderBy(order)
    return table.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def stratified_split(table: DataFrame, label: str, key: Column, share: float) -> DataFrame:
    """is_test: the first floor(share * n) rows of each class by the key. Exact and repeatable; a class lies in many tasks."""
    numbered = ranked(table, label, [key], "_rank", "_size")
    return numbered.withColumn("is_test", F.col("_rank") <= F.floor(F.col("_size") * share)).drop("_rank", "_size")


#: Limits on ranks that Spark puts below the exchange, so that every task keeps its first rows of a class (spark.sql.optimizer.windowGroupLimitThreshold).
PUSHED = 1000
#: Parts of a class whose first rows are found apart, where the limit is greater.
DEALS = 64


def _first(table: DataFrame, group: list[str], order: str, n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of each group; rank: a column for their rank."""
    found = table.withColumn(rank or "_n", F.row_number().over(Window.partitionBy(*group).orderBy(order))).where(F.col(rank or "_n") <= n)
    return found if rank else found.drop("_n")


def balanced(table: DataFrame, label: str, key: str, n: int) -> DataFrame:
    """n rows of each class: the first by the key, and again from the first where a class is smaller. copy tells them apart."""
    # Labels and keys alone say how far a class is taken; the rows themselves move only if they are taken.
    keys = table.select(F.col(label).alias("_label"), F.col(key).alias("_key"))
    if n > PUSHED:
        keys = _first(keys.withColumn("_deal", F.pmod(F.xxhash64("_key"), F.lit(DEALS))), ["_label", "_deal"], "_key", n)
    last = stored(_first(keys, ["_label"], "_key", n).groupBy("_label").agg(F.max("_key").alias("_last"), F.count("*").alias("_size")), "balance")
    reached = F.col(label).eqNullSafe(F.col("_label")) & (F.col(key).isNull() | F.col("_last").isNull() | (F.col(key) <= F.col("_last")))
    taken = _first(table.join(F.broadcast(last), reached), [label], key, n, "_rank")
    # _size is that of the class or n, which gives one copy as any greater size does.
    times = F.floor((F.lit(n) - F.col("_rank")) / F.col("_size")).cast("int")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(0), times))).drop("_rank", "_size", "_label", "_last")


def assembled(table: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(table)


#: Training rows in one task at most: a fit holds each of them with a count for every tree.
TAUGHT = 200_000


def _fitted(estimator, table: DataFrame, features: list[str]):
    """The estimator's model. It reads its rows many times, so these are written once."""
    held = stored(table.select("code", *(F.col(f"`{f}`") for f in features)), "taught")
    parts = -(-held.count() // TAUGHT)
    rows = held.repartition(parts) if parts > held.rdd.getNumPartitions() else held
    model = estimator.fit(assembled(rows, features))
    forget(held)
    return model


def forest(trees: int = 50, depth: int = 9, per_split: int = 20, seed: int = 99) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol="code", numTrees=trees, maxDepth=depth, featureSubsetStrategy=str(per_split), seed=seed)


def train_forest(table: DataFrame, features: list[str], **how):
    """how: as for forest(). per_split is cut to the number of features."""
    how["per_split"] = min(how.get("per_split", 20), len(features))
    return _fitted(forest(**how), table, features)


def train_one_vs_rest(table: DataFrame, features: list[str], **how):
    how["per_split"] = min(how.get("per_split", 20), len(features))
    return _fitted(OneVsRest(classifier=forest(**how), labelCol="code"), table, features)


def train_orientation(table: DataFrame, features: list[str], tree: bool = True):
    """A tree of depth 2, or a forest of 100 trees of depth 3."""
    kind = DecisionTreeClassifier(labelCol="code", maxDepth=2, seed=3) if tree else RandomForestClassifier(labelCol="code", numTrees=100, maxDepth=3, seed=3)
    return _fitted(kind, table, features)


def confusion(predictions: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, prediction, n, share): counts and shares of the label's rows, in two decimals."""
    n = predictions.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("label")), 2))


def classification_report(predictions: DataFrame, label: str, prediction: str) -> DataFrame:
    """(class, precision, recall, f1, support) of each class, and the macro and weighted averages."""
    pairs = predictions.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    sides = pairs.select(F.col("l").alias("class"), F.col("n").alias("support"), F.lit(0).alias("said"), F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("right"))
    sides = sides.unionByName(pairs.select(F.col("p").alias("class"), F.lit(0).alias("support"), F.col("n").alias("said"), F.lit(0).alias("right")))
    per = sides.groupBy("class").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("right").alias("right"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    per = per.withColumns({"precision": ratio(F.col("right"), F.col("said")), "recall": ratio(F.col("right"), F.col("support"))})
    per = per.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("class", "precision", "recall", "f1", "support")
    mean = lambda c: F.avg(c).alias(c)
    weighted = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    metrics = ["precision", "recall", "f1"]
    rows = [per, per.agg(F.lit("macro avg").alias("class"), *map(mean, metrics), F.sum("support").alias("support")), per.agg(F.lit("weighted avg").alias("class"), *map(weighted, metrics), F.sum("support").alias("support"))]
    return reduce(DataFrame.unionByName, rows)


def importances(spark: SparkSession, model, features: list[str]) -> DataFrame:
    """(feature, importance, spread, is_zero), greatest first; spread: over the trees of a forest."""
    trees = [t.featureImportances.toArray() for t in model.trees]
    spread = [(sum((t[i] - sum(x[i] for x in trees) / len(trees)) ** 2 for t in trees) / len(trees)) ** 0.5 for i in range(len(features))]
    rows = [(f, float(v), float(s), bool(v == 0)) for f, v, s in zip(features, model.featureImportances.toArray(), spread, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double, spread double, is_zero boolean").orderBy(F.desc("importance"), "feature")


def with_folds(table: DataFrame, label: str, key: str, k: int) -> DataFrame:
    """fold: rows of each class dealt in turn; a class lies in many tasks."""
    return ranked(table, label, [F.col(key)], "_rank", "_size").withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_size")


def cross_validate(table: DataFrame, features: list[str], k: int, **how) -> tuple[list[float], object]:
    """Accuracy of each fold, and the model of the best. table: code and fold, best cached."""
    found = []
    for fold in range(k):
        model = train_forest(table.where(F.col("fold") != fold), features, **how)
        scored = model.transform(assembled(table.where(F.col("fold") == fold), features))
        found.append((scored.agg(F.avg((F.col("prediction") == F.col("code")).cast("double"))).first()[0], model))
    return [a for a, _ in found], max(found, key=lambda x: x[0] or 0)[1]


def spread_so_far(accuracies: DataFrame, fold: str = "fold", accuracy: str = "accuracy") -> DataFrame:
    w = Window.orderBy(fold).rowsBetween(Window.unboundedPreceding, 0)
    return accuracies.withColumn("spread", F.stddev_pop(accuracy).over(w))


def grid_accuracies(table: DataFrame, features: list[str], trees: list[int], depths: list[int], folds: int = 5, key: str = "file_name") -> DataFrame:
    """(trees, depth, accuracy) of every setting: the mean over folds that hold each class alike. table: a sample of bounded size, with code."""
    folded = with_folds(table.select(key, "code", *(F.col(f"`{f}`") for f in features)), "code", key, folds)
    return grid.accuracies(folded, features, trees, depths).groupBy("trees", "depth").agg(F.avg("accuracy").alias("accuracy"))


def grid_search(table: DataFrame, features: list[str], trees: list[int], depths: list[int], folds: int = 5, key: str = "file_name"):
    """(model of the best setting, its table of settings and mean accuracies as rows); of equal settings the smallest is best."""
    found = [tuple(r) for r in grid_accuracies(table, features, trees, depths, folds, key).collect()]  # a row for each setting
    n, depth, _ = min(found, key=lambda r: (-r[2], r[0], r[1]))
    return train_forest(table, features, trees=n, depth=depth), found


def threshold_rules(a0: Column, a1: Column, a5: Column, t1: Column, t2: Column) -> tuple[Column, Column]:
    """Planes by two hand-made trees with thresholds t1 and t2."""
    one = F.when(a5 <= t1, "ax").when(a0 <= t2, "sag").otherwise("cor")
    two = F.when(a5 <= t1, "ax").when(a1 <= t2, "cor").otherwise("sag")
    return one, two
