import random

from mrloom.llm import jaccard_join as M

SCHEMA = "doc_id long, text string, node int, root string, fold string"


def brute(rows):
    def shingles(t):
        w = (t or "").encode().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    link = [[k for k in range(len(rows)) if k != i and s and 5 * len(s & sets[k]) >= 4 * len(s | sets[k])] for i, s in enumerate(sets)]
    out, seen = [], {}
    for i in range(len(rows)):
        todo, group = [i], {i}
        while todo and i not in seen:
            for k in link[todo.pop()]:
                if k not in group:
                    group.add(k)
                    todo.append(k)
        for k in group:
            seen.setdefault(k, group)
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[k][0] for k in seen[i] if rows[k][0] is not None]
        out.append((doc_id, (min(ids) if ids else None) if sets[i] else doc_id, len(link[i])))
    return sorted(out, key=str)


def made(seed, size=30):
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randint(0, 300)}" for _ in range(n)]
    rows, n = [], 0
    for _ in range(12):
        base = text(rng.randint(20, 150))
        for _ in range(rng.choice([1, 1, 2, 5, size])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 9)}"
            rows.append((n, " ".join(own)))
            n += 1
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "one  two"), (None, rows[0][1]), (2, rows[5][1]), (3, rows[3][1]), (n + 5, " ".join(text(5000)))]


def found(spark, rows):
    frame = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in M.similar_classes(frame).collect()), key=str)


def test_against_brute_force(spark):
    rows = made(1)
    assert found(spark, rows) == brute(rows)


def test_large_groups_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "SMALL", 10)
    monkeypatch.setattr(M, "BLOCK", 8)
    rows = made(2, 60)
    assert found(spark, rows) == brute(rows)


def test_empty_and_runs(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, "")]) == [(1, 1, 0), (2, 2, 0)]
    assert M.runs_for(0.999, 3) == 15


def test_recall_of_pairs_just_above_the_threshold(spark):
    """Pairs of a similarity of 0.80 to 0.85: at least 0.99 of 1000 are linked."""
    rng = random.Random(12)
    rows = []
    for k in range(1000):
        one = [f"p{k}w{i}" for i in range(rng.randint(95, 125))]
        two = list(one)
        a = rng.randint(5, 40)
        two[a], two[a + rng.randint(6, 40)] = "x", "y"
        rows += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(two))]
        shared = 2 * (len(one) - 4 - 10) / 2 / (len(one) - 4 + 10)
        assert 0.8 <= shared <= 0.85
    linked = sum(n > 0 for _, _, n in found(spark, rows))
    assert linked >= 0.99 * len(rows)
