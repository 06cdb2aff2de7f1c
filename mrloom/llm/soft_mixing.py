"""Mixing to target weights with soft membership.

A classifier is fitted on the labelled table (multinomial logistic regression on hashed words, at most SAMPLE labelled
rows) and gives each document a posterior over the domains. With n words, posterior p and rate r, a
document is expected to bring r n p[k] words to domain k. Rates start at 1, and projected gradient steps

    r <- max(0, r - n p M^-1 (S - T)),    M = sum of n^2 p p',  S = sum of r n p,  T the targets

lower the squared distance of S from T in the metric of M (its largest eigenvalue is 1, so the step is safe). A step is one
aggregation over the cluster that brings back a number for each domain; the steps so far are an expression of
n and p, so no rate is ever stored or collected.

Defined results: null and empty texts have no words and keep the rate 1; without labels of two domains all
posteriors are equal; a domain that no document belongs to leaves its target unmet (the greatest distance of a domain from
its target, as a share of all words, comes with the rates; mix() warns of it); null and repeated ids
are mixed like others; labels of unknown domains teach nothing; an empty table gives an empty result; extra columns are
carried through (working columns are named _m_...).
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table, texts

BUCKETS, SAMPLE, STEPS, TOLERANCE = 1 << 13, 20_000, 40, 1e-4
#: Words whose buckets a worker keeps from batch to batch.
KEPT_WORDS = 100_000
#: Domains by quality and toxicity, and the share of all words that each is to have.
DOMAINS = {"junk": (0, 0), "toxic_junk": (0, 1), "clean": (1, 0), "toxic": (1, 1)}
SHARES = {"junk": 0.02, "toxic_junk": 0.01, "clean": 0.93, "toxic": 0.04}
#: Words that the mixture is to have, as a share of those that are there.
GROWTH = 1.05


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        plain = word.strip(b".,;:!?\"'()").lower()
        bucket = self[word] = xxhash.xxh3_64_intdigest(plain) % BUCKETS
        return bucket


def _featured(text: bytes | None, buckets: _Buckets) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of words, the buckets that they fall into, and the logarithm of one more than their counts."""
    own = text.split() if text else []
    held, n = np.unique(np.fromiter(map(buckets.__getitem__, own), np.int64, len(own)), return_counts=True)
    return len(own), held, np.log1p(n)


CODED = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT())])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CODED rows; a sparse vector is a struct of kind 0, size, indices and values."""
    buckets = _Buckets()
    for batch in batches:
        rows = [_featured(t, buckets) for t in texts(batch)]
        buckets = buckets if len(buckets) < KEPT_WORDS else _Buckets()
        n = len(rows)
        vector = {"type": pa.array([0] * n, pa.int8()), "size": pa.array([BUCKETS] * n, pa.int32()), "indices": pa.array([r[1] for r in rows], pa.list_(pa.int32())), "values": pa.array([r[2] for r in rows], pa.list_(pa.float64()))}
        yield pa.RecordBatch.from_arrays([batch.column("domain").cast(pa.float64()), pa.StructArray.from_arrays(list(vector.values()), names=list(vector))], names=["label", "features"])


def fit_posteriors(docs: DataFrame, labels: DataFrame, n_domains: int, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Weights (buckets x domains) and intercepts. docs: doc_id, text; labels: doc_id, domain (an integer from 0)."""
    taught = labels.select("doc_id", F.col("domain").cast("int").alias("domain")).where(f"doc_id IS NOT NULL AND domain >= 0 AND domain < {n_domains}")
    # The sample is drawn from the labels alone, so that only its texts move.
    drawn = stored(taught.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(sample), "drawn")
    if drawn.select("domain").distinct().count() < 2:
        return np.zeros((BUCKETS, n_domains)), np.zeros(n_domains)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("domain", "text")  # at most SAMPLE rows of two numbers
    coded = stored(rows.mapInArrow(_features, CODED), "taught")
    if coded.select("label").distinct().count() < 2:
        return np.zeros((BUCKETS, n_domains)), np.zeros(n_domains)
    model = LogisticRegression(family="multinomial", regParam=0.01, maxIter=40, aggregationDepth=2).fit(coded)
    found = model.coefficientMatrix.toArray()  # as many rows as the greatest label asks for
    weights, intercepts = np.zeros((BUCKETS, n_domains)), np.full(n_domains, -30.0)
    weights[:, : len(found)] = found.T
    intercepts[: len(found)] = model.interceptVector.toArray()
    return weights, intercepts


def _posteriors(text: str, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercepts = model.value
        buckets = _Buckets()
        for batch in batches:
            n, posts = [], []
            for t in texts(batch, text):
                size, held, counts = _featured(t, buckets)
                z = counts @ weights[held] + intercepts
                e = np.exp(z - z.max())
                n.append(size)
                posts.append(e / e.sum())
            buckets = buckets if len(buckets) < KEPT_WORDS else _Buckets()
            p = np.array(posts).reshape(len(n), -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), *map(pa.array, p.T.reshape(len(intercepts), -1))], names=[*batch.schema.names, "_m_words", *(f"_m_p{k}" for k in range(len(intercepts)))])

    return run


def add_posteriors(docs: DataFrame, weights: np.ndarray, intercepts: np.ndarray, text: str = "text") -> DataFrame:
    """docs with _m_words and _m_p0, _m_p1, ..."""
    k = len(intercepts)
    schema = T.StructType([*docs.schema, T.StructField("_m_words", T.LongType()), *(T.StructField(f"_m_p{i}", T.DoubleType()) for i in range(k))])
    model = docs.sparkSession.sparkContext.broadcast((weights, intercepts))  # BUCKETS x domains numbers, whatever the data
    return docs.mapInArrow(_posteriors(text, model), schema)


def rate_after(steps: list[np.ndarray], scale: float) -> Column:
    """The rate of a row after these steps; a step is M^-1 (S - T)."""
    rate = F.lit(1.0)
    for step in steps:
        change = sum((F.col(f"_m_p{k}") * float(v) for k, v in enumerate(step)), start=F.lit(0.0))
        rate = F.greatest(F.lit(0.0), rate - F.col("_m_words") / scale * change)
    return rate


def fit_rates(posts: DataFrame, shares: list[float], growth: float = GROWTH, steps: int = STEPS, tolerance: float = TOLERANCE) -> Column:
    return fit_rates_and_gap(posts, shares, growth, steps, tolerance)[0]


def fit_rates_and_gap(posts: DataFrame, shares: list[float], growth: float = GROWTH, steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[Column, float]:
    """The rate as an expression of _m_words and _m_p0, ..., and how far the domain that is furthest from its target stays
    from it, as a share of all words (at most tolerance if all targets are met). shares: of all words, by domain."""
    k = len(shares)
    bring = [F.col("_m_words") * F.col(f"_m_p{i}") for i in range(k)]
    first = posts.agg(F.sum("_m_words").alias("n"), *(F.sum(bring[i] * bring[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k))).first()
    total = float(first["n"] or 0)
    if not total:
        return F.lit(1.0), 0.0
    m = np.array([[first[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    scale = float(np.sqrt(np.trace(m)))
    inverse = np.linalg.pinv(m / scale**2, rcond=1e-10, hermitian=True)
    targets = np.array(shares) / sum(shares) * growth * total
    done: list[np.ndarray] = []
    while True:
        rate = rate_after(done, scale)
        now = posts.agg(*(F.sum(rate * b).alias(f"s{i}") for i, b in enumerate(bring))).first()
        off = np.array([now[f"s{i}"] for i in range(k)]) - targets
        gap = float(np.abs(off).max() / total)
        if gap <= tolerance or len(done) == steps:
            return rate, gap
        done.append(inverse @ off / scale)


def copies(rate: Column, *keys: str) -> Column:
    """How often a row is taken: the rate, rounded up or down by a hash of the keys."""
    return F.floor(rate + F.pmod(F.xxhash64(*keys), F.lit(1 << 20)) / float(1 << 20)).cast("int")


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) by the order of DOMAINS."""
    domain = F.lit(None).cast("int")
    for k, (quality, toxic) in enumerate(DOMAINS.values()):
        domain = F.when((F.col("quality") == quality) & (F.col("toxic") == toxic), k).otherwise(domain)
    return labels.select("doc_id", domain.alias("domain"))


def op2_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, posterior of each domain, rate, how often the mixture takes it, and the gap that the fit leaves."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    posts = stored(add_posteriors(docs, *fit_posteriors(docs, label_domains(table(spark, sf_dir, "labels")), len(DOMAINS))).drop("text"), "posteriors")
    rate, gap = fit_rates_and_gap(posts, list(SHARES.values()))
    return posts.select("doc_id", F.col("_m_words").alias("n_words"), *(F.col(f"_m_p{k}").alias(f"p_{d}") for k, d in enumerate(DOMAINS)), rate.alias("rate"), F.lit(gap).alias("target_gap")).withColumn("n_copies", copies(F.col("rate"), "doc_id"))


def mix(docs: DataFrame, labels: DataFrame, shares: list[float], growth: float = GROWTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The mixture: each row as often as its rate says, with its own columns.

    labels: doc_id and domain, an integer from 0; shares: of all words, by domain. A domain that hardly any text
    belongs to should have no share here, as rates of texts with a trace of it would have to make it up.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # Written with the texts: each is scored once, and the steps read the columns of the posteriors alone.
    posts = stored(add_posteriors(docs, *fit_posteriors(own, labels, len(shares)), text), "posteriors")
    rate, gap = fit_rates_and_gap(posts, shares, growth)
    if gap > 10 * TOLERANCE:
        warnings.warn(f"a domain stays {gap:.2%} of all words from its target", stacklevel=2)
    taken = posts.withColumn("_m_copies", copies(rate, doc_id)).where("_m_copies > 0")
    return taken.withColumn("_m_copy", F.explode(F.sequence(F.lit(1), F.col("_m_copies")))).select(*docs.columns)
