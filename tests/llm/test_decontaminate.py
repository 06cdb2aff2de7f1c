import random

from mrloom.llm import decontaminate as M

SCHEMA = "doc_id long, text string, item_id string, found int"


def made():
    rng = random.Random(7)
    common = ["the", "of", "and", "in"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else f"w{rng.randint(0, 3000)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 40))) + ". " + " ".join(word() for _ in range(rng.randint(3, 15))) + ".") for i in range(60)]
    items += [(None, items[0][1]), (100, None), (101, ""), (3, items[4][1]), (102, " ".join(word() for _ in range(200)))]
    rows, n = [], 0
    for _ in range(150):
        parts = [" ".join(word() for _ in range(rng.randint(0, 120))) for _ in range(3)]
        if rng.random() < 0.4:
            leak = rng.choice(items)[1] or ""
            if rng.random() < 0.3:
                own = leak.split()
                own = own[: int(len(own) * rng.choice([0.5, 0.8]))]
                leak = " ".join(own)
            parts.insert(1, leak.upper() if rng.random() < 0.2 else leak)
        rows.append((n, "\n".join(parts)))
        n += 1
    return [*rows, (None, items[1][1]), (n, None), (n + 1, ""), (0, rows[0][1]), (n + 2, " ".join(word() for _ in range(30000)) + " " + items[2][1])], items


def brute(rows, items):
    out = []
    for doc_id, text in rows:
        words = M.clean_words(text)
        for item_id, item in items:
            q, a = (M.shingles(x) for x in M.parts(item))
            if q and M.overlap(words, q) >= M.OVERLAP and M.overlap(words, a) >= M.OVERLAP:
                out.append((doc_id, item_id))
    return sorted(out, key=str)


def test_against_brute_force(spark, monkeypatch):
    rows, items = made()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in M.leaks(docs, benchmark).collect()), key=str)
    assert got == brute(rows, items) and len(got) > 30
    monkeypatch.setattr(M, "SLAB_ITEMS", 17)
    again = sorted(((r["doc_id"], r["item_id"]) for r in M.leaks(docs, benchmark).collect()), key=str)
    assert again == got
    monkeypatch.setattr(M, "PASS_SLABS", 2)
    monkeypatch.setattr(M, "PIECE", 3000)
    assert sorted(((r["doc_id"], r["item_id"]) for r in M.leaks(docs, benchmark).collect()), key=str) == got
    clean = M.keep_clean(docs, benchmark)
    assert clean.columns == docs.columns
    leaked = {d for d, _ in got}
    assert sorted((r["doc_id"] for r in clean.collect()), key=str) == sorted((i for i, _ in rows if i not in leaked), key=str)


def test_question_and_answer_apart(spark):
    rng = random.Random(3)
    items = [(i, " ".join(f"q{i}x{k}" for k in range(20)) + ". " + " ".join(f"a{i}x{k}" for k in range(20)) + ".") for i in range(30)]
    items += [(30, "Why so? " + " ".join(f"b{k}" for k in range(9))), (31, "one two three four. five six."), (32, "word")]
    filler = lambda n: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))
    rows = []
    for i, (_, text) in enumerate(items):
        q, a = (" ".join(x[: max(1, len(x) * 3 // 4)]) for x in M.parts(text))
        q_all, a_all = (" ".join(x) for x in M.parts(text))
        rows += [(10 * i, f"{filler(30)} {q} {filler(200)} {a} {filler(30)}"), (10 * i + 1, f"{a_all} {filler(900)} {q_all}"), (10 * i + 2, f"{q_all} {filler(50)}")]
        words = q_all.split()
        rows.append((10 * i + 3, filler(100).join([" ".join(words[:10]), " " + " ".join(words[4:]) + " ", " " + a_all])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in M.leaks(docs, benchmark).collect()), key=str)
    assert got == brute(rows, items) and {(10 * i, i) for i in range(30)} <= set(got)
    leaked = {d for d, _ in got}
    assert sorted(r["doc_id"] for r in M.keep_clean(docs, benchmark).collect()) == sorted(i for i, _ in rows if i not in leaked)


def test_the_bound_alone_retrieves_all_that_the_check_passes():
    """Items and texts over few words, with repeats: whatever passes the check was retrieved, and not all is."""
    rng = random.Random(9)
    asked = passed = 0
    for n_words in (3, 8, 40):
        word = lambda n=n_words: f"w{rng.randint(0, n)}"
        items = [(i, " ".join(word() for _ in range(rng.randint(1, 25))) + ". " + " ".join(word() for _ in range(rng.randint(0, 9)))) for i in range(30)]
        index = M.Index(items)
        numbers = M._Numbers(index.vocabulary)
        texts = []
        for _ in range(120):
            own = rng.choice(items)[1].split()
            pieces = [own[a : a + rng.randint(1, 20)] for a in (rng.randint(0, max(0, len(own) - 3)) for _ in range(rng.randint(0, 4)))]
            texts.append(" ".join(w for p in pieces for w in (*p, *(f"x{rng.randint(0, 9)}" for _ in range(rng.randint(0, 3))))))
        numbered = [M._numbered(t.encode(), numbers) for t in texts]
        found = index.retrieve(numbered)
        for k, ids in enumerate(numbered):
            right = {j for j, *_ in index.verify(ids, list(range(len(index.items))))}
            assert right <= found.get(k, set())
            passed += len(right)
            asked += len(found.get(k, set()))
    assert 60 < passed < asked


def test_empty(spark):
    docs, none = spark.createDataFrame([(1, "a b", "x", 1)], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert M.leaks(docs, none).count() == 0 and M.keep_clean(docs, none).count() == 1
    assert M.leaks(docs.where("false"), spark.createDataFrame([(1, "a b c d e f.")], "item_id long, text string")).count() == 0


def test_parts():
    assert M.parts("Who is it? It is me.") == (["who", "is", "it"], ["it", "is", "me"])
    assert M.parts("one two three") == (["one", "two"], ["three"])
    assert M.parts(None) == ([], [])
