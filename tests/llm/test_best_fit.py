import functools
import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from mrloom.llm import best_fit as M

DATA = "/root/testdata/sf0.001"


def plain(lengths, capacity, open_bins):
    """Best fit by a look at every open bin."""
    bins, out, opened = [], [], 0
    for n in lengths:
        fit = [b for b in bins if b[0] >= n]
        if fit:
            low = min(b[0] for b in fit)
            b = next(b for b in reversed(bins) if b[0] == low)  # the last that came to this free space
        else:
            if len(bins) >= open_bins:
                low = min(b[0] for b in bins)
                bins.remove(next(b for b in reversed(bins) if b[0] == low))
            b = [capacity, opened]
            opened += 1
            bins.append(b)
        out.append((b[1], capacity - b[0]))
        b[0] -= n
        bins.remove(b)
        if b[0]:
            bins.append(b)
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=60), st.integers(1, 6))
def test_bitset_equals_plain_best_fit(lengths, open_bins):
    fit = M.BestFit(20, open_bins)
    assert [fit.put(n) for n in lengths] == plain(lengths, 20, open_bins)
    assert fit.n_open == sum(map(len, fit.bins)) <= open_bins and fit.bits == sum(1 << f for f, b in enumerate(fit.bins) if b)


def test_lengths_beyond_the_capacity():
    for n in (21, -1):
        with pytest.raises(ValueError):
            M.BestFit(20, 3).put(n)


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(M.TOKENIZER)


def ids_of(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 0]


def contract(docs, rows, capacity=2048):
    """docs: id to the ids of its documents; rows as the query gives them."""
    cut = sorted((i, k, at, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for i, many in docs for k, at in enumerate(range(0, len(many), capacity)) for x in [many[at : at + capacity]])
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == cut
    filled = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"], r["length"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(0 < n <= capacity for n in filled.values())
    return len(filled), -(-sum(filled.values()) // capacity)


def test_whole_table(spark):
    docs = [(r["doc_id"], ids_of(r["text"])) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    frame = M.op12_best_fit(spark, DATA)
    assert frame.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    used, least = contract(docs, frame.collect())
    assert used <= 1.02 * least + 1


WORDS = ["don't", "'s", "<|endoftext|>", "<|startoftext|>x", "é", "́x", "é", "Σ", "ΑΣ", "İ", "가", "ᆨ", "12,5", "a\x85b", "\xa0", "\x1c", "ﬁ", "--", "😀", "ß", "ÄÖÜß'S", "naïve're--x9", "²½", "µ×÷", "ÿÑþ'll", "\u00ad", "A<|ENDOFTEXT|>b"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(WORDS), st.text(max_size=6), st.text("aZé'sSt1-ßÿ×.", max_size=9)), max_size=8), st.sampled_from([" ", "\n", "\t ", "\x0b"]))
def test_words_are_tokenized_alone(parts, gap):
    text = gap.join(parts)
    (ids,) = M._word_ids(M.TOKENIZER).of([text.encode().split()])
    assert [*struct.unpack(f"<{len(ids) // 4}I", ids), 0] == ids_of(text)


def test_odd_rows(spark, monkeypatch):
    rng = random.Random(2)
    texts = [None, "", "  \n", "word", "a" * 5000, "long text " * 9000, "x y", "x y"] + [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 300))) for _ in range(60)]
    rows = [(i, t, "s", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, offset int").repartition(3)
    monkeypatch.setattr(M, "KEPT_WORDS", 5)
    monkeypatch.setattr(M, "PIECE", 3000)
    cut = M.pieces(docs, capacity=64)
    packed = M.pack(cut, capacity=64, open_bins=8, slice_rows=300)
    rows = [r.asDict() | {"ids_crc32": zlib.crc32(r["ids"])} for r in packed.collect()]
    used, least = contract([(i, ids_of(t)) for i, t in enumerate(texts)], rows, 64)
    assert used <= 1.1 * least + 2
    whole = M.sequences(packed).collect()
    assert len(whole) == used and all(len(r["ids"]) == 4 * r["n_tokens"] for r in whole)
    assert sum(r["n_pieces"] for r in whole) == len(rows)
    again = M.pack(cut, capacity=64, open_bins=8, slice_rows=300).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, packed.collect()))
    assert M.pack(M.pieces(docs.where("false"))).count() == 0


def test_other_columns_and_repeated_rows(spark):
    rows = [(None, 5, "a"), (1, 5, "b"), (1, 5, "b"), (2, 0, None), (3, 10, "c"), (4, 3, "d")]
    items = spark.createDataFrame(rows, "id long, n long, offset string")
    got = M.pack(items, "n", capacity=10).collect()
    assert len(got) == 6 and len({r["sequence_id"] for r in got}) == 3 and got[0].asDict().keys() == {"id", "n", "sequence_id", "offset"}
