import math

from hypothesis import given, settings
from hypothesis import strategies as st
from mrloom.llm import token_counts as M

SCORES = {"a": -1.0, "b": -2.0, "ab": -1.5, "abc": -2.0, "bc": -1.2, "c": -3.0, "é": -4.0, M.MARK: -0.5, M.MARK + "a": -0.9}


def plain(token, scores):
    """Best score and least tokens by recursion over suffixes."""
    memo = {len(token): (0.0, 0)}
    for i in reversed(range(len(token))):
        width = len(token[i].encode())
        options = [(memo[i + 1][0] + M.BYTE_SCORE * width, memo[i + 1][1] + width)]
        options += [(memo[j][0] + scores[token[i:j]], memo[j][1] + 1) for j in range(i + 1, len(token) + 1) if token[i:j] in scores]
        memo[i] = max(options, key=lambda x: (round(x[0], 9), -x[1]))
    return memo[0][1]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abcéz", max_size=9), max_size=20))
def test_trie_equals_plain_dynamic_programming(tokens):
    marked = sorted(M.MARK + t for t in tokens)
    assert M.trie_counts(marked, M.piece_ends(SCORES), 3) == {t: plain(t, SCORES) for t in marked}


def test_vocabulary_is_a_distribution():
    scores, longest = M.vocabulary()
    assert abs(sum(map(math.exp, scores.values())) - 1) < 1e-9 and longest > 5


def test_counts(spark):
    rows = [(1, "the the cat", "x"), (2, None, "x"), (3, "", "x"), (None, "the", "x"), (1, "the the cat", "x"), (5, "é" * 3000, "x")]
    got = sorted((tuple(r) for r in M.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")).collect()), key=str)
    scores, longest = M.vocabulary()
    ends = M.piece_ends(scores)
    count = lambda t: sum(M.trie_counts([M.MARK + w], ends, longest)[M.MARK + w] for w in (t or "").split())
    assert got == sorted(((i, len((t or "").split()), count(t)) for i, t, _ in rows), key=str)
    assert M.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bytes_that_are_no_text_and_small_bounds(spark, monkeypatch):
    rows = spark.createDataFrame([(1, bytearray(b"a\xff a\xfe ab")), (2, bytearray(b"ab abc ab"))], "doc_id long, raw binary").selectExpr("doc_id", "cast(raw AS string) AS text")
    want = {1: (3, 2 * plain(M.MARK + "a\ufffd", SCORES) + plain(M.MARK + "ab", SCORES)), 2: (3, 2 * plain(M.MARK + "ab", SCORES) + plain(M.MARK + "abc", SCORES))}
    for bound in (M.KEPT_COUNTS, 0):
        monkeypatch.setattr(M, "KEPT_COUNTS", bound)
        monkeypatch.setattr(M, "PIECE", bound)
        got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in M.token_counts(rows, scores=SCORES).collect()}
        assert got == want
