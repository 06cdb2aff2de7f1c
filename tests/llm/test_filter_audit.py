import random
from collections import Counter
from fractions import Fraction
from itertools import permutations
from math import factorial

from mrloom.llm import filter_audit as M
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, mask string, good int"


def fails(text):
    w = text.encode().split()
    return {
        x
        for x, bad in zip(
            "ABCD",
            (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), any(c in "#$%&*|" for c in text)),
            strict=True,
        )
        if bad
    }


def plain(rows, labels):
    """Every order applied to the documents, one after another."""
    least, good, toxic = {}, {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    parts = {}
    for i, text, lang, *_ in rows:
        own = fails(text or "") | ({"E"} if i is not None and least[text or ""] < i else set())
        parts.setdefault(lang or "", []).append((i, own))
    out = []
    for part, docs in parts.items():
        total, found = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, x in enumerate(order, 1):
                gone = [i for i, own in left if x in own]
                left = [d for d in left if x not in d[1]]
                total[x] += len(gone)
                found.append((part, order, step, x, len(left), len(gone), sum(x in own for _, own in docs) - len(gone), sum(own == {x} for _, own in docs), sum(i in good for i in gone), sum(i in toxic for i in gone)))
        out += [(*r[:3], *r[4:], total[r[3]]) for r in found]
    return sorted(out)


def test_kernel_solution_is_the_mean_over_orders():
    for n in (2, 3, 5):
        for i, factors in enumerate(M.kernel_solution(n)):
            want = [Fraction(0)] * (1 << n)
            for order in permutations(range(n)):
                before = sum(1 << j for j in order[: order.index(i)])
                want[before] -= Fraction(1, factorial(n))
                want[before | 1 << i] += Fraction(1, factorial(n))
            assert factors[1:] == want[1:]  # the empty coalition's value is 0


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    bodies = [" ".join(rng.choice(["alpha", "BETA", "c$", "d"]) + str(rng.randint(0, k)) for _ in range(rng.randint(60, 140))) for k in (1, 40, 10**6) for _ in range(25)]
    texts = [None, "", " \t", "#", "A" * 9, "é" * 90 + "A" * 10, "É" * 89 + "A" * 10, *bodies, " ".join(map(str, range(100))), " ".join(f"Q{i}" for i in range(120)), "w " * 30000]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", "fr", None, ""]), "m", 1) for i in range(400)]
    rows += [(None, rng.choice(texts), "en", None, None) for _ in range(40)] + [(5, rows[5][1], "de", "", 0), (5, rows[5][1], "en", "", 0), rows[9], rows[9], (9, "other", "fr", "", 0)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 400, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = M.op11_filter_audit(spark, str(tmp_path))
    assert frame.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, frame.collect())) == plain(rows, labels)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert M.op11_filter_audit(spark, str(tmp_path)).count() == 0


def test_other_filters_and_tallies(spark):
    rows = spark.createDataFrame([("p", 0, 2), ("p", 1, 3), ("p", 3, 5), ("q", 2, 7)], "who string, bits int, bytes long")
    counts = M.count_masks(rows, F.col("bits"), "who", ["bytes"])
    got = {(r["who"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in M.audit(counts, "XY", "who", "bytes").collect()}
    assert got["p", "XY", 1] == (2, 8, 0, 3, 11) and got["p", "XY", 2] == (2, 0, 5, 0, 5)
    assert got["q", "YX", 1] == (0, 7, 0, 7, 14) and len(got) == 8
