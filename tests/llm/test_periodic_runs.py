import hashlib
import random
import zlib

from hypothesis import example, given, settings
from hypothesis import strategies as st
from mrloom.llm import periodic_runs as M
from pyspark.sql import functions as F


def plain_runs(w, least=12):
    """Every run by trying all periods from every start."""
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i:
                if j + q - i >= max(least, 2 * q):
                    found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def coded(w):
    first = {}
    return M.np.array([first.setdefault(x, i) for i, x in enumerate(w)], M.np.int64)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text("ab", max_size=80), st.text("abc", max_size=120), st.builds(lambda u, k, t: (u * k)[: len(u) * k - t] + u[::-1], st.text("ab", min_size=1, max_size=20), st.integers(2, 6), st.integers(0, 9))), st.sampled_from([2, 12]))
@example("a" * 50, 12)
@example(fibonacci(150), 2)
@example("ab" * 30 + "c" + "ab" * 30, 12)
def test_runs_equal_plain_search(w, least):
    assert M.find_runs(coded(w), least) == plain_runs(w, least)


def test_exhaustive_short_words():
    for n in range(13):
        for bits in range(1 << n):
            w = f"{bits:b}".zfill(n) if n else ""
            assert M.find_runs(coded(w), 2) == plain_runs(w, 2)


def test_long_structured_words():
    rng = random.Random(3)
    for _ in range(30):
        w = ""
        for _ in range(rng.randint(1, 5)):
            u = "".join(rng.choice("ab") for _ in range(rng.randint(1, 60)))
            w += u * rng.randint(1, 5) + u[: rng.randint(0, len(u))]
            w += rng.choice(["", fibonacci(rng.randint(1, 90)), w[: rng.randint(0, 80)]])
        w = w[:900]
        assert M.find_runs(coded(w), 12) == plain_runs(w)


def replant(doc_id, w):
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is None or h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def digest(doc_id, text):
    w = replant(doc_id, (text or "").encode().split())
    runs = plain_runs(w)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    told = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in drop)
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_equals_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(11)
    texts = [None, "", " \t\n", "a " * 500, "x", "a b c \x1c d " * 9, "é ü\x0bß " * 7]
    for _ in range(150):
        texts.append(" ".join(rng.choice(["a", "b", "cc", "dé"]) for _ in range(rng.randint(0, 150))) + rng.choice(["", " end", " \n"]))
        texts.append(" ".join(str(rng.randint(0, 10**6)) for _ in range(rng.randint(0, 200))))
    rows = [(i, t, "en", "doc") for i, t in enumerate(texts)] + [(None, "a " * 40, None, None), (3, "a " * 500, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, runs string")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((digest(i, t) for i, t, *_ in rows), key=repr)
    for bound in (M.SLICE_WORDS, 50):
        monkeypatch.setattr(M, "SLICE_WORDS", bound)
        assert sorted((tuple(r) for r in M.op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr) == want
    assert M.periodic_runs(frame.where("false")).count() == 0
    assert sum(r[1] for r in want) > 20


def test_given_documents(spark):
    """Short documents of the smallest table against brute force; all of them agree with it on what is replanted."""
    data = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r) for r in M.op13_periodic_runs(spark, data).collect()}
    assert got.keys() == docs.keys()
    short = [i for i, t in docs.items() if len((t or "").split()) < 700]
    assert len(short) > 50 and all(got[i] == digest(i, docs[i]) for i in short)
    texts = {r["doc_id"]: r["text"] for r in M.replanted(spark.read.parquet(f"{data}/documents.parquet")).collect()}
    assert all((texts[i] or "").encode().split() == replant(i, (t or "").encode().split()) for i, t in docs.items())


def test_other_columns(spark):
    frame = spark.createDataFrame([(7, "a b " * 8, "x")], "key int, body string, doc_id string")
    (row,) = M.periodic_runs(frame, "key", "body").select("doc_id", "runs", F.col("collapsed").cast("string").alias("c")).collect()
    assert (row["doc_id"], [tuple(r) for r in row["runs"]], row["c"]) == (7, [(0, 16, 2)], "a b")
