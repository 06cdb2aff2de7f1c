"""Quality classifier as a sparse rule ensemble.

Statistics of each text (shares of capitals, symbols, repeated words and lines, ...) are columns. A forest of shallow
trees is fitted on labelled rows, every path from a root to a node becomes a rule (a conjunction of
comparisons of statistics), and a logistic regression with an absolute-value penalty gives most
rules the weight 0. The others are compiled into one Spark column expression, the score.

The trees and weights are fitted on at most SAMPLE labelled rows (those with the least hash of their
id, drawn from the labels alone, so that only their texts are measured for it); all rows are scored, each where it is read.

Defined results: a null text counts as empty, and an empty text has all statistics 0 and the score
that the rules give these; rows without a label, or labels without a quality, teach nothing; without
labels of both kinds the score is the smoothed share of label 1; null and repeated ids are scored like others
(a null id is held out: its remainder is unknown); an empty table gives an empty result; extra columns
are carried through by add_score (the statistics are named _q_...).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table, texts

#: Labelled rows that a fit reads at most; the score from which a row is predicted 1.
SAMPLE, CUT = 20_000, 0.3
STATISTICS = ["chars", "words", "word_length", "capitals", "digits", "marks", "shouts", "symbols", "bars", "distinct", "stutter", "top_word", "lines", "repeated_lines", "line_words", "other_letters"]

_BYTES = np.zeros((7, 256))
for _row, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()-", b"!", b"#$%&*+=<>@^~\\/_{}[]", b"abcdefghijklmnopqrstuvwxyz", bytes(range(128, 192)))):
    _BYTES[_row, list(_chars)] = 1


def statistics(text: bytes | None) -> list[float]:
    """The STATISTICS of a UTF-8 text."""
    if not text:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    capitals, digits, marks, shouts, symbols, small, tails = (_BYTES @ counts).tolist()
    chars = len(text) - tails
    own = text.split()
    n = max(1, len(own))
    lines = [x for x in text.split(b"\n") if x]
    lower = text.lower().split()
    times = Counter(lower)
    return [
        float(chars),
        float(len(own)),
        sum(map(len, own)) / n,
        capitals / max(1.0, capitals + small),
        digits / chars,
        marks / n,
        shouts / n,
        symbols / n,
        times[b"|"] / n,
        len(times) / n,
        sum(map(bytes.__eq__, lower, lower[1:])) / n,
        max(times.values(), default=0) / n,
        float(len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        n / max(1, len(lines)),
        tails / chars,
    ]


def _measure(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([statistics(t) for t in texts(batch, text)], np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, values.T)], names=[*batch.schema.names, *(f"_q_{s}" for s in STATISTICS)])

    return run


def add_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    schema = T.StructType([*docs.schema, *(T.StructField(f"_q_{s}", T.DoubleType()) for s in STATISTICS)])
    return docs.mapInArrow(_measure(text), schema)


@dataclass
class Rules:
    """weights: rule (conditions of statistic, side and threshold) to weight; the score is the logistic of their sum."""

    intercept: float
    weights: dict[tuple, float] = field(default_factory=dict)

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weights.items():
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def holds(rule: tuple) -> Column:
    out = F.lit(True)
    for statistic, below, threshold in rule:
        c = F.col(f"_q_{STATISTICS[statistic]}")
        out = out & (c <= threshold if below else c > threshold)
    return out


def tree_rules(tree) -> list[tuple]:
    """The conjunctions on all paths from the root of a fitted tree, nested bounds merged."""
    rules: list[tuple] = []
    todo = [(tree._call_java("rootNode"), {})]
    while todo:
        node, bounds = todo.pop()
        if bounds:
            rules.append(tuple(sorted((s, below, t) for (s, below), t in bounds.items())))
        if node.subtreeDepth() == 0:
            continue
        split = node.split()
        s, t = split.featureIndex(), split.threshold()
        left, right = dict(bounds), dict(bounds)
        left[s, True] = min(t, bounds.get((s, True), t))
        right[s, False] = max(t, bounds.get((s, False), t))
        todo += [(node.leftChild(), left), (node.rightChild(), right)]
    return rules


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def _taught(labels: DataFrame, doc_id: str, target: str) -> DataFrame:
    return labels.select(F.col(doc_id).alias("_id"), F.col(target).cast("double").alias("label")).where("label IS NOT NULL AND _id IS NOT NULL")


def measured_sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", target: str = "quality", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The id and statistics of the documents of at most `sample` labels that are not held out."""
    drawn = _taught(labels, doc_id, target).where(~held_out("_id")).select("_id").distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample)
    drawn = stored(drawn.withColumnRenamed("_id", doc_id), "drawn")
    rows = docs.select(doc_id, text).join(F.broadcast(drawn), doc_id, "left_semi")  # at most `sample` numbers
    return add_statistics(rows, text).drop(text)


def fit(measured: DataFrame, labels: DataFrame, doc_id: str = "doc_id", target: str = "quality", sample: int = SAMPLE, trees: int = 20, depth: int = 3, penalty: float = 0.002) -> Rules:
    """Fits on the labelled rows that are not held out. measured: rows with their statistics."""
    taught = _taught(labels, doc_id, target)
    columns = [f"_q_{s}" for s in STATISTICS]
    rows = measured.where(~held_out(doc_id)).select(F.col(doc_id).alias("_id"), *columns).join(taught, "_id")
    rows = stored(rows.orderBy(F.xxhash64("_id"), "_id", "label", *columns).limit(sample).select("label", *columns), "taught")
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Rules(float(np.log((n.get(1.0, 0) + 1) / (n.get(0.0, 0) + 1))))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="0.4", seed=7, featuresCol="_features").fit(rows.select("label", array_to_vector(F.array(*columns)).alias("_features")))
    rules = sorted({rule for tree in forest.trees for rule in tree_rules(tree)})
    coded = rows.select("label", array_to_vector(F.array(*(holds(r).cast("double") for r in rules))).alias("_features"))
    model = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, featuresCol="_features").fit(coded)
    return Rules(float(model.intercept), {r: float(w) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if w})


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    rules = fit(measured_sample(docs, labels), labels)
    return add_statistics(docs).select("doc_id", held_out("doc_id").alias("held_out"), rules.score().alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that are predicted 1, with their own columns."""
    rules = fit(measured_sample(docs, labels, doc_id, text=text), labels, doc_id)
    return add_statistics(docs, text).where(rules.score() >= CUT).select(*docs.columns)
