"""Fitted forests as tables: a store, and scores by column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.fields import with_low_probability
from ..scratch import scratch
from . import classify, training


def save(model: RandomForestClassificationModel, path: str) -> None:
    model.write().overwrite().save(path)


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """(tree, node, feature, threshold, left, right, shares) of a stored forest: feature is -1 at a leaf; shares of the
    training rows' classes are given at every node, so that a tree can be cut at any depth."""
    held = spark.read.parquet(f"{path.rstrip('/')}/data")
    n, total = F.col("nodeData"), F.aggregate("nodeData.impurityStats", F.lit(0.0), lambda a, x: a + x)
    out = held.select(
        F.col("treeID").alias("tree"),
        n["id"].alias("node"),
        F.when(n["leftChild"] < 0, -1).otherwise(n["split"]["featureIndex"]).cast("int").alias("feature"),
        F.coalesce(F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)), F.lit(0.0)).alias("threshold"),
        n["leftChild"].alias("left"),
        n["rightChild"].alias("right"),
        F.transform(n["impurityStats"], lambda x: x / total).alias("shares"),
    )
    out.stored_at = path
    return out


def compiled(forest: DataFrame) -> DataFrame:
    """nodes() as one row: trees, an array of a struct of arrays by node. Its size is that of the model: trees times 2 to the depth."""
    by_node = F.array_sort(F.collect_list(F.struct("node", "feature", "threshold", "left", "right", "shares")))
    trees = forest.groupBy("tree").agg(by_node.alias("n")).select("tree", *(F.col(f"n.{c}").alias(c) for c in ("feature", "threshold", "left", "right", "shares")))
    whole = F.array_sort(F.collect_list(F.struct("tree", "feature", "threshold", "left", "right", "shares")))
    return trees.agg(whole.alias("trees"))


def votes(trees: Column, features: Column, depth: int, classes: int) -> Column:
    """The sum over all trees of the shares at the leaf that the features reach, by class. trees: of compiled(); depth: the greatest of a tree."""

    def walk(tree: Column) -> Column:
        step = lambda at, _: F.when(F.get(tree["feature"], at) < 0, at).when(F.get(features, F.get(tree["feature"], at)) <= F.get(tree["threshold"], at), F.get(tree["left"], at)).otherwise(F.get(tree["right"], at))
        return F.get(tree["shares"], F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step))

    return F.aggregate(F.transform(trees, walk), F.array_repeat(F.lit(0.0), classes), lambda a, s: F.zip_with(a, s, lambda x, y: x + F.coalesce(y, F.lit(0.0))))


def score(table: DataFrame, forest: DataFrame, features: list[str], classes: dict[str, int] = S.IMAGE_TYPES, threshold: float = 0.4, depth: int = 9, valid: Column | None = None) -> DataFrame:
    """The columns of classify.score() by a stored forest, as expressions in the table's own plan: the model comes in as a scalar subquery.

    Rows that are not valid get no code and probabilities, and the modality INVALID.
    """
    n = max(classes.values()) + 1
    found = votes(F.col("_trees"), F.array(*(F.col(f"`{f}`").cast("double") for f in features)), depth, n)
    # A subquery may not be written inside a lambda's function, so it is a column first; the optimizer puts it into the one place that reads it, and no row carries it.
    scored = table.withColumn("_trees", compiled(forest).scalar()).select(*table.columns, (found if valid is None else F.when(valid, found)).alias("_votes"))
    total = F.aggregate("_votes", F.lit(0.0), lambda a, x: a + x)
    scored = scored.withColumn("_p", F.transform("_votes", lambda x: x / total)).withColumn("GUESS_ONNX_CODE", (F.array_position("_votes", F.array_max("_votes")) - 1).cast("int"))
    names = F.create_map(*(x for name, code in classes.items() for x in (F.lit(code), F.lit(name))))
    scored = scored.withColumn("GUESS_ONNX", F.when(F.col("_votes").isNull(), "INVALID").otherwise(F.coalesce(F.try_element_at(names, F.col("GUESS_ONNX_CODE")), F.lit("INVALID"))))
    named = F.when(F.col("_votes").isNull(), "INVALID").otherwise(with_low_probability(F.col("GUESS_ONNX"), F.col("_p"), threshold))
    return scored.withColumns({**{f"GUESS_ONNX_{name}": F.get("_p", F.lit(c)) for name, c in classes.items()}, "volume_modality": named}).drop("_votes", "_p")


def score_by_model(table: DataFrame, forest: DataFrame, features: list[str], classes: dict[str, int] = S.IMAGE_TYPES, threshold: float = 0.4, valid: Column | None = None) -> DataFrame:
    """The columns of score() by the model behind nodes(), for large tables: its own transform walks the trees, in far less time than
    expressions do, which are interpreted step by step."""
    scored = classify.score(table, RandomForestClassificationModel.load(forest.stored_at), features, classes, threshold)
    if valid is None:
        return scored
    gone = {**{c: F.lit(None) for c in ("GUESS_ONNX_CODE", *(f"GUESS_ONNX_{n}" for n in classes))}, "GUESS_ONNX": F.lit("INVALID"), "volume_modality": F.lit("INVALID")}
    return scored.withColumns({c: F.when(valid, F.col(f"`{c}`")).otherwise(v) for c, v in gone.items()})


def thresholds(spark: SparkSession, forests: list[RandomForestClassificationModel], features: list[str]) -> dict[str, list[float]]:
    """The thresholds of each feature in any tree of the forests, ascending: fewer than the bins of a fit, for each fit."""
    held = []
    for forest in forests:
        save(forest, path := scratch(spark, "forest"))
        held.append(nodes(spark, path).where("feature >= 0").select("feature", "threshold"))
    found: dict[str, list[float]] = {f: [] for f in features}
    for r in reduce(DataFrame.union, held).distinct().orderBy("threshold").collect():
        found[features[r["feature"]]].append(r["threshold"])
    return found


def counted(model, forests: list[RandomForestClassificationModel], table: DataFrame, features: list[str], label: str, labels: list[str]) -> DataFrame:
    """(label, prediction, n) of the rows with these labels, by a model that is made of the forests.

    Rows whose features lie between the same thresholds are told apart by no tree. They are counted first, and each such cell is
    scored once; there are no more of them as the rows grow. A cell's key is the numbers of its intervals, packed into longs.
    """
    cuts = {f: c for f, c in thresholds(table.sparkSession, forests, features).items() if c}
    keys: list[Column] = []
    place, size = {}, 1 << 62
    for f, c in cuts.items():
        if size * (len(c) + 1) >= 1 << 62:
            keys.append(F.lit(0).cast("long"))
            size = 1
        number = reduce(lambda w, j: w.when(F.col(f"`{f}`") <= c[j], j), range(1, len(c)), F.when(F.col(f"`{f}`") <= c[0], 0)).otherwise(len(c))  # noqa: B023
        keys[-1] = keys[-1] + number * F.lit(size).cast("long")
        place[f] = f"(_k{len(keys) - 1} DIV {size}L) % {len(c) + 1}L"
        size *= len(c) + 1
    cells = table.select(label, *(k.alias(f"_k{i}") for i, k in enumerate(keys))).groupBy(*(f"_k{i}" for i in range(len(keys))))
    cells = cells.agg(*(F.count_if(F.col(label) == name).alias(f"_n{i}") for i, name in enumerate(labels)))
    # The least threshold that is not below a value lies on the same side of all of them as the value.
    value = lambda f: F.element_at(F.lit([*cuts[f], float("inf")]), (F.expr(place[f]) + 1).cast("int")) if f in cuts else F.lit(0.0)
    n = F.array(*(F.struct(F.lit(name).alias("label"), F.col(f"_n{i}").alias("n")) for i, name in enumerate(labels)))
    scored = model.transform(training.assembled(cells.select(*(value(f).alias(f) for f in features), n.alias("_n")), features))
    each = scored.select("prediction", F.explode("_n").alias("_n")).where("_n.n > 0")
    return each.groupBy(F.col("_n.label").alias(label), "prediction").agg(F.sum("_n.n").alias("n"))
