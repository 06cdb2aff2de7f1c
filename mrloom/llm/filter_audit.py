"""How filters interact: what each removes in every order, and its Shapley share, from all coalitions.

The filters of a row make a mask of failures. One aggregation counts the rows, and those of other tallies, of each part
and mask; another sums these into what every coalition of filters removes (2 to the number of filters values for each
tally). What a filter removes at a step of an order is the difference of two coalitions. Its Shapley value is the
solution of the kernel-weighted least squares of the coalition values by one number for each filter, which must add up to
the value of all filters. The normal equations are solved in rationals, once, for the unit values of all coalitions; the
solution is linear in them, so a Spark expression applies it to every part. Nothing but column expressions runs on the rows.

The duplicate filter groups rows by their text's hash and id before any text's rows meet, so a text that many rows share
is a few rows by then; texts themselves never move.

Defined results: a null text counts as empty, a null part as the empty string; rows without an id are no earlier
copy and have none; rows of one id and text are no earlier copies of each other; labels may repeat (one that says 1
counts) and labels without id count for nothing; an empty table gives an empty result; only the named columns
are read.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table

SPACE = r"[\x20\x09-\x0D]+"
LETTERS = "ABCDE"


def kernel_solution(n: int) -> list[list[Fraction]]:
    """For each of n filters the factor of every coalition's value (by mask) in its Shapley value.

    Least squares over all coalitions but the empty and the full one, weighted by the Shapley kernel, under the
    condition that the numbers add up to the full coalition's value: a linear system bordered by that condition.
    """
    full = (1 << n) - 1
    weight = {s: Fraction(n - 1, comb(n, k) * k * (n - k)) for s in range(1, full) for k in [s.bit_count()]}
    rows = [[sum((w for s, w in weight.items() if s >> i & s >> j & 1), Fraction(0)) for j in range(n)] + [Fraction(1)] for i in range(n)]
    rows.append([Fraction(1)] * n + [Fraction(0)])
    for i, row in enumerate(rows):  # the right sides of all unit values
        row += [weight.get(s, Fraction(0)) if s >> i & 1 else Fraction(0) for s in range(full + 1)] if i < n else [Fraction(int(s == full)) for s in range(full + 1)]
    for c in range(n + 1):
        pivot = next(r for r in range(c, n + 1) if rows[r][c])
        rows[c], rows[pivot] = rows[pivot], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(n + 1):
            if r != c and rows[r][c]:
                rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[c], strict=True)]
    return [rows[i][n + 1 :] for i in range(n)]


def count_masks(rows: DataFrame, mask: Column, part: str, tallies: list[str]) -> DataFrame:
    """One row for each part and mask: the sums of the tallies. part and tallies: columns of rows."""
    return rows.groupBy(part, mask.alias("_f_mask")).agg(*(F.sum(t).alias(t) for t in tallies))


def audit(counts: DataFrame, names: str, part: str = "part", rows: str = "n", others: list[str] | None = None) -> DataFrame:
    """All orders and steps for each part of count_masks(): n! x n rows.

    names: a letter for each filter, by bit. rows: the tally that counts the rows; others: tallies of which the loss
    at the step is given.
    Columns: part, filter_order, step, filter, kept, removed, redundant, unique_fails, <tally>_lost, shapley (times n!).
    """
    n, full, others = len(names), (1 << len(names)) - 1, others or []
    failing = lambda tally, s: F.sum(F.when(F.col("_f_mask").bitwiseAND(s) != 0, F.col(tally)).otherwise(0))
    values = counts.groupBy(part).agg(F.sum(rows).alias("_f_all"), *(F.array(F.lit(0).cast("long"), *(failing(t, s) for s in range(1, full + 1))).alias(f"_f_{t}") for t in [rows, *others]))
    value = lambda s, tally=rows: F.get(F.col(f"_f_{tally}"), s)
    shares = []
    for factors in kernel_solution(n):
        whole = [f * factorial(n) for f in factors]
        assert all(f.denominator == 1 for f in whole)
        shares.append(sum((value(F.lit(s)) * int(f) for s, f in enumerate(whole) if f), F.lit(0).cast("long")))
    place = lambda x: F.locate(x, F.col("filter_order"))
    bits = dict(zip(names, (1 << i for i in range(n)), strict=True))
    orders = ["".join(p) for p in permutations(names)]
    steps = (
        values.withColumn("_f_shares", F.array(*shares))
        .withColumn("filter_order", F.explode(F.array(*map(F.lit, orders))))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
        .withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
        .withColumn("_f_bit", sum((F.when(F.col("filter") == x, b).otherwise(0) for x, b in bits.items()), F.lit(0)))
        .withColumn("_f_before", sum((F.when(place(x) < F.col("step"), b).otherwise(0) for x, b in bits.items()), F.lit(0)))
        .withColumn("_f_after", F.col("_f_before") + F.col("_f_bit"))
    )
    gone = lambda tally=rows: value(F.col("_f_after"), tally) - value(F.col("_f_before"), tally)
    return steps.select(
        part,
        "filter_order",
        "step",
        "filter",
        (F.col("_f_all") - value(F.col("_f_after"))).alias("kept"),
        gone().alias("removed"),
        (value(F.col("_f_bit")) - gone()).alias("redundant"),
        (value(F.lit(full)) - value(F.lit(full) - F.col("_f_bit"))).alias("unique_fails"),
        *(gone(t).alias(f"{t}_lost") for t in others),
        F.get(F.col("_f_shares"), F.instr(F.lit(names), F.col("filter")) - 1).alias("shapley"),
    )


def failures(text: Column) -> Column:
    """The mask of the filters that a text fails by itself: few words, few distinct words, many capitals, symbols."""
    own = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, distinct = F.size(own).cast("long"), F.size(F.array_distinct(own)).cast("long")
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]", ""))
    tests = [n < 100, 100 * distinct < 80 * n, 100 * capitals.cast("long") > 10 * F.char_length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))


#: The bit of the filter of later copies.
COPY = 1 << 4


def masked(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each part and mask of failures, and those that labels call good or toxic."""
    whole = F.coalesce(F.col(text), F.lit(""))
    each = docs.select(F.col(doc_id).alias("_f_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(whole, 256)).alias("_f_hash"), failures(whole).alias("_f_own"))
    same = ["part", "_f_hash", "_f_own"]
    # ids that are null have no labels: they take part under many keys
    each = each.groupBy("_f_id", *same).agg(F.count("*").alias("n")).withColumn("_f_salt", F.when(F.col("_f_id").isNull(), F.crc32("_f_hash")).otherwise(0))
    told = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_f_id"), F.lit(0).cast("long").alias("_f_salt")).agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    tallies = ["n", "good", "toxic"]
    each = each.join(told, ["_f_id", "_f_salt"], "left").select("_f_id", *same, "n", *((F.col("n") * F.coalesce(F.col(t), F.lit(0))).alias(t) for t in tallies[1:]))
    known = F.col("_f_id").isNotNull()
    texts = each.groupBy(*same).agg(
        *(F.sum(t).alias(t) for t in tallies),
        *(F.sum(F.when(known, F.lit(0)).otherwise(F.col(t))).alias(f"_f_free_{t}") for t in tallies),
        F.min(F.when(known, F.struct("_f_id", *tallies))).alias("_f_first"),
    )
    least = F.min("_f_first._f_id").over(Window.partitionBy("_f_hash"))  # over at most one row for each part
    texts = texts.withColumn("_f_is_first", F.coalesce(F.col("_f_first._f_id") == least, F.lit(False)))
    first = lambda t: F.col(f"_f_free_{t}") + F.when(F.col("_f_is_first"), F.col(f"_f_first.{t}")).otherwise(0)
    split = F.array(F.struct(F.col("_f_own").alias("mask"), *(first(t).alias(t) for t in tallies)), F.struct((F.col("_f_own") + COPY).alias("mask"), *((F.col(t) - first(t)).alias(t) for t in tallies)))
    return count_masks(texts.select("part", F.inline(split)), F.col("mask"), "part", tallies).withColumnRenamed("_f_mask", "mask")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, by language: every order and step."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    counts = masked(docs, table(spark, sf_dir, "labels")).withColumnRenamed("mask", "_f_mask")
    return audit(counts, LETTERS, others=["good", "toxic"]).drop("filter")


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS ws FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(ws) < 100)::INT + 2 * (100 * list_unique(ws) < 80 * len(ws))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), FALSE)::INT AS mask
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(x, b)),
o AS (
  SELECT x1.x || x2.x || x3.x || x4.x || x5.x AS filter_order, [x1.b, x2.b, x3.b, x4.b, x5.b] AS bs
  FROM x x1 JOIN x x2 ON x2.x <> x1.x JOIN x x3 ON x3.x NOT IN (x1.x, x2.x) JOIN x x4 ON x4.x NOT IN (x1.x, x2.x, x3.x) JOIN x x5 ON x5.x NOT IN (x1.x, x2.x, x3.x, x4.x)
),
s AS (SELECT filter_order, step, bs[step] AS b, coalesce(list_sum(bs[1:step - 1]), 0)::INT AS a FROM o, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)),
r AS (
  SELECT part, filter_order, step, b,
    sum(n) FILTER (mask & a = 0 AND mask & b = 0) AS kept,
    sum(n) FILTER (mask & a = 0 AND mask & b <> 0) AS removed,
    sum(n) FILTER (mask & a <> 0 AND mask & b <> 0) AS redundant,
    sum(n) FILTER (mask = b) AS unique_fails,
    sum(good) FILTER (mask & a = 0 AND mask & b <> 0) AS good_lost,
    sum(toxic) FILTER (mask & a = 0 AND mask & b <> 0) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, b
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, b), 0)::BIGINT AS shapley
FROM r
"""
