"""Benchmark decontamination: BM25 retrieval with block-max WAND, then overlap checks.

The benchmark is cut into slabs of bounded size, each slab is an inverted index. An item is two entries, its question and its answer, each with the BM25 impacts of its terms and the
least score that it asks for: a text that holds OVERLAP of a part's shingles, wherever they stand, holds all of the part's terms but a known number, so its score is
at least that of all terms less the greatest impacts of so many. The part with more shingles leads. Leading entries lie in blocks of like length, with the greatest impact of each
term in each block. Slabs go to the tasks by broadcast, at most PASS_SLABS of them for a pass over the texts, and a
broadcast ends with its pass: driver and workers hold no more than that of the benchmark, whatever its size.

Every training text is a query, its terms counting once. Terms that many items hold are not essential: a text can only reach a block's least asked score if
its other, essential terms bring what the most that the common ones can bring leaves to ask. So the essential
terms' short lists of blocks are walked alone, the block maxima are summed for each text, and a
block that stays below is skipped unread. For the others the block maxima of the common terms that the text
does hold are added, which skips most of them; what is left is scored exactly, the leading entry first. Every item of which both entries reach what they ask for is retrieved, so
the bound loses no pair that the check would pass, however far question and answer stand apart, and whatever items share a slab (whose own counts make up its BM25 weights). Retrieved pairs are then verified on the whole
text: at least OVERLAP of the question's and of the answer's word shingles stand in it.

Words are parted at ASCII white space, in lower case, without what is no letter or digit at either end; what
is then empty is no word. An item's answer is its last sentence, its question what stands before; an
item of one sentence is parted in the middle. A part shorter than a shingle is one shingle.

Defined results: null and empty texts and items match nothing; items that repeat are judged each for
itself; rows that repeat give repeated results; null ids are carried through; an empty table of either
kind gives no rows. Texts never move, and whole texts are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, texts

SHINGLE = 5
#: Share of a part's shingles that verifies it.
OVERLAP = 0.6
#: Share of the items from which a term is common.
COMMON = 0.04
K1, B = 1.2, 0.75
#: Items of a block, and of a slab (with its bytes): what one broadcast holds.
BLOCK, SLAB_ITEMS, SLAB_BYTES = 2, 2048, 8 << 20
#: Slabs of a pass, and so indexes that a worker keeps.
PASS_SLABS = 4
#: Bounds (of text and block) that are held at once.
BOUNDS = 1_000_000
KEPT_WORDS = 100_000
#: Bytes of texts that are searched at once.
PIECE = 2 << 20
_EDGES = bytes(c for c in range(128) if not chr(c).isalnum())


def clean(word: str) -> str:
    """The word in lower case from its first to its last letter or digit."""
    word = word.lower()
    a, z = 0, len(word)
    while a < z and not word[a].isalnum():
        a += 1
    while z > a and not word[z - 1].isalnum():
        z -= 1
    return word[a:z]


def clean_words(text: str | None) -> list[str]:
    return [c for w in (text or "").encode("utf-8", "replace").split() if (c := clean(w.decode()))]


def parts(text: str | None) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer."""
    body = (text or "").rstrip()
    ends = [m.end() for m in re.finditer(r"[.!?][\x20\x09-\x0D]+", body)]
    question, answer = (clean_words(body[: ends[-1]]), clean_words(body[ends[-1] :])) if ends else ([], clean_words(body))
    if not question or not answer:
        whole = question or answer
        question, answer = whole[: (len(whole) + 1) // 2], whole[(len(whole) + 1) // 2 :]
    return question, answer


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def least_terms(words: list[str], impacts: dict[str, float]) -> float:
    """The least score of a text that holds OVERLAP of the part's shingles.

    h different shingles begin at h places and so cover SHINGLE - 1 places more; what the other places hold may be absent. And one shingle is there at least.
    """
    wanted = shingles(words)
    held = max(1, math.ceil(OVERLAP * len(wanted) - 1e-9))
    absent = max(0, len(words) - held - SHINGLE + 1) if len(words) >= SHINGLE else 0
    most = sorted(impacts.values(), reverse=True)
    one = min(sum(impacts[t] for t in set(x)) for x in wanted)
    return max(one, sum(most[absent:])) - 1e-6


class Index:
    """The block-max index of a slab of items."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        split = [(i, *parts(t)) for i, t in items]
        self.items = sorted((x for x in split if x[1]), key=lambda x: len(x[1]) + len(x[2]))
        n = len(self.items)
        df = Counter(t for _, q, a in self.items for t in {*q, *a})
        self.vocabulary = {t: k for k, t in enumerate(sorted(df))}
        idf = {t: math.log(1 + (n - f + 0.5) / (f + 0.5)) for t, f in df.items()}
        mean = sum(len(q) + len(a) for _, q, a in self.items) / max(1, 2 * n)
        leads, others = [], []
        for _, q, a in self.items:
            entries = []
            for part in (q, a):
                norm = K1 * (1 - B + B * len(part) / mean)
                own = {t: idf[t] * f * (K1 + 1) / (f + norm) for t, f in Counter(part).items()}
                entries.append(({self.vocabulary[t]: x for t, x in own.items()}, least_terms(part, own) if part else 0.0))
            lead = int(len(shingles(a)) > len(shingles(q)))
            leads.append(entries[lead])
            own, asked = entries[1 - lead]
            ids = np.array(sorted(own), np.int64)
            others.append((ids, np.array([own[t] for t in ids.tolist()]), asked))
        self.others = others
        common = {self.vocabulary[t] for t, f in df.items() if f > max(2, COMMON * n)}
        self.column = np.full(len(self.vocabulary) + 1, -1, np.int64)  # of a common term in common_most
        self.column[sorted(common)] = np.arange(len(common))
        self.common_most = np.zeros((len(common), -(-n // BLOCK)))
        self.blocks, rest, least, lists = [], [], [], {k: [] for k in range(len(self.vocabulary) + 1)}  # the last: words that no item has
        for b in range(-(-n // BLOCK)):
            own, need = zip(*leads[b * BLOCK : (b + 1) * BLOCK], strict=True)
            need = np.array(need)
            ids = np.array(sorted({t for x in own for t in x}), np.int64)
            dense = np.array([[x.get(t, 0.0) for x in own] for t in ids])
            self.blocks.append((ids, dense, need))
            shared = np.isin(ids, list(common))
            rest.append((need - dense[shared].sum(axis=0)).min())
            least.append(need.min())
            self.common_most[self.column[ids[shared]], b] = dense[shared].max(axis=1, initial=0)
            for t, most in zip(ids[~shared].tolist(), dense[~shared].max(axis=1).tolist(), strict=True):
                lists[t].append((b, most))
        self.wanted = [tuple({tuple(self.vocabulary[w] for w in x) for x in shingles(part)} for part in (q, a)) for _, q, a in self.items]
        self.rest, self.least = np.array(rest), np.array(least)
        self.sizes = np.array([len(x) for x in lists.values()])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.list_blocks = np.array([b for x in lists.values() for b, _ in x], np.int64)
        self.list_maxima = np.array([m for x in lists.values() for _, m in x])

    def retrieve(self, texts: list[np.ndarray]) -> dict[int, set[int]]:
        """Numbers of the texts that retrieve anything, with the numbers of their items. texts: their words' numbers in the vocabulary."""
        found: dict[int, set[int]] = {}
        step = max(1, BOUNDS // max(1, len(self.blocks)))
        for at in range(0, len(texts) if self.blocks else 0, step):
            for j, items in self._retrieve(texts[at : at + step]).items():
                found[at + j] = items
        return found

    def _retrieve(self, texts: list[np.ndarray]) -> dict[int, set[int]]:
        n_blocks, size = len(self.blocks), len(self.column)
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
        ids = np.concatenate(texts)
        own = ids < size - 1
        pairs = np.unique(owner[own] * size + ids[own])
        owner, term = pairs // size, pairs % size
        ends = np.searchsorted(owner, np.arange(len(texts) + 1))
        listed = np.flatnonzero(self.sizes[term])
        n = self.sizes[term[listed]]
        entry = np.repeat(self.starts[term[listed]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        bounds = np.bincount(np.repeat(owner[listed], n) * n_blocks + self.list_blocks[entry], self.list_maxima[entry], len(texts) * n_blocks).reshape(-1, n_blocks)
        asking = bounds >= self.rest
        rows = np.flatnonzero(asking.any(axis=1))
        held = np.zeros((len(texts), len(self.common_most)), bool)
        shared = self.column[term] >= 0
        held[owner[shared], self.column[term[shared]]] = True
        hits = np.argwhere(asking[rows] & (bounds[rows] + held[rows].astype(np.float64) @ self.common_most >= self.least))
        found: dict[int, set[int]] = {}
        for k, b in zip(rows[hits[:, 0]].tolist(), hits[:, 1].tolist(), strict=True):
            entry_ids, dense, asked = self.blocks[b]
            query = term[ends[k] : ends[k + 1]]
            for j in np.flatnonzero(dense[_present(entry_ids, query)].sum(axis=0) >= asked).tolist():
                item = b * BLOCK + j
                other, impacts, least = self.others[item]
                if not len(other) or impacts[_present(other, query)].sum() >= least:
                    found.setdefault(k, set()).add(item)
        return found

    def verify(self, ids: np.ndarray, items: list[int]) -> Iterator[tuple[int, float, float]]:
        """(item, question's overlap, answer's overlap) of the items whose parts stand in the text with these words.

        Words are compared by their numbers: an item's words all have one of their own. Runs with a word that no item has match nothing and are left out.
        """
        known, runs = ids < len(self.vocabulary), {0: set()}
        for k in items:
            shares = []
            for wanted in self.wanted[k]:
                n = len(next(iter(wanted), ()))
                if n not in runs:
                    at = np.flatnonzero(np.logical_and.reduce([known[i : max(0, len(ids) - n + 1) + i] for i in range(n)])) if len(ids) >= n else []
                    runs[n] = set(zip(*(ids[at + i].tolist() for i in range(n)), strict=True)) if len(at) else set()
                shares.append(len(wanted & runs[n]) / len(wanted) if wanted else 1.0)
            if min(shares) >= OVERLAP:
                yield k, *shares


def _present(wanted: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which of the wanted numbers are among the held ones; both sorted, each number once."""
    if not len(held):
        return np.zeros(len(wanted), bool)
    near = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
    return held[near] == wanted


@lru_cache(maxsize=PASS_SLABS)
def _index(items: tuple) -> Index:
    return Index(list(items))


class _Numbers(dict):
    """Raw word to its number in the vocabulary: -1 is no word, the vocabulary's size a word that no item has."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary

    def __missing__(self, raw: bytes) -> int:
        word = raw.strip(_EDGES).lower().decode() if raw.isascii() else clean(raw.decode("utf-8", "replace"))
        number = self[raw] = self.vocabulary.get(word, len(self.vocabulary)) if word else -1
        return number


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about PIECE bytes, with the number of the first."""
    first, held, size = 0, [], 0
    for k, text in enumerate(texts(batch)):
        held.append(text or b"")
        size += len(held[-1])
        if size >= PIECE:
            yield first, held
            first, held, size = k + 1, [], 0
    if held:
        yield first, held


def _search(slabs):
    out = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [_index(slab) for slab in slabs.value]
        numbers = [_Numbers(index.vocabulary) for index in indexes]
        for batch in batches:
            rows: list[tuple] = []
            doc_ids = batch.column("doc_id")
            for first, piece in _pieces(batch):
                for n, index in enumerate(indexes):
                    numbered = [_numbered(text, numbers[n]) for text in piece]
                    found = index.retrieve(numbered)
                    for j in sorted(found):
                        for k, q_share, a_share in index.verify(numbered[j], sorted(found[j])):
                            rows.append((doc_ids[first + j].as_py(), index.items[k][0], q_share, a_share))
                    if len(numbers[n]) > KEPT_WORDS:
                        numbers[n] = _Numbers(index.vocabulary)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, out, strict=True)], schema=out)

    return run


def _numbered(text: bytes, numbers: _Numbers) -> np.ndarray:
    raw = text.split()
    own = np.fromiter(map(numbers.__getitem__, raw), np.int64, len(raw))
    return own[own >= 0]


def overlap(words: list[str], wanted: set[tuple[str, ...]]) -> float:
    """Share of the wanted shingles (all of one length) that stand in the words; 1 if none is wanted."""
    if not wanted:
        return 1.0
    n = len(next(iter(wanted)))
    return len(wanted & set(zip(*(words[i:] for i in range(n)), strict=False))) / len(wanted)


def slabs(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[tuple]:
    """The items, in slabs of at most SLAB_ITEMS items and about SLAB_BYTES; the driver holds one at a time."""
    held, size = [], 0
    rows = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).orderBy("i", "t")
    for row in rows.toLocalIterator():
        held.append((row["i"], row["t"]))
        size += len(row["t"] or "")
        if len(held) >= SLAB_ITEMS or size >= SLAB_BYTES:
            yield tuple(held)
            held, size = [], 0
    if held:
        yield tuple(held)


def passes(benchmark: DataFrame) -> Iterator[tuple[tuple, ...]]:
    held: list[tuple] = []
    for slab in slabs(benchmark):
        held.append(slab)
        if len(held) == PASS_SLABS:
            yield tuple(held)
            held = []
    if held:
        yield tuple(held)


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, question_overlap, answer_overlap) of the verified pairs."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, question_overlap double, answer_overlap double"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0)
    found = None
    for some in passes(benchmark):
        held = spark.sparkContext.broadcast(some)
        one = stored(rows.mapInArrow(_search(held), schema), "leaks")  # a few rows; the broadcast can go
        held.destroy()
        found = one if found is None else found.unionByName(one)
    return found if found is not None else spark.createDataFrame([], schema)


def _flag(slabs, text: str):
    """Rows that hold no item of the slabs."""
    search = _search(slabs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(text)], names=["doc_id", "text"])
            found = {k for part in search(iter([numbered])) for k in part.column("doc_id").to_pylist()}
            yield batch.filter(pa.array([k not in found for k in range(batch.num_rows)], pa.bool_()))

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with their own columns."""
    held = None
    for some in passes(benchmark):
        if held is not None:  # a benchmark of more than one pass: what the last one kept is written
            docs = stored(docs, "unleaked")
            held.destroy()
        held = docs.sparkSession.sparkContext.broadcast(some)
        docs = docs.mapInArrow(_flag(held, text), docs.schema)
    return docs


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verified pairs of document and benchmark item."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""WITH d AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+'), lambda w: regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda w: w <> '') AS w FROM documents),
i AS (SELECT item_id, rtrim(text, E' \t\n\r\v\f') AS t, length(regexp_extract(rtrim(text, E' \t\n\r\v\f'), '^(.*[.!?][\x20\x09-\x0D]+)[^\x20\x09-\x0D]', 1, 's')) AS cut FROM benchmark),
h AS (SELECT item_id, 'q' AS part, substr(t, 1, cut) AS t FROM i UNION ALL SELECT item_id, 'a', substr(t, cut + 1) FROM i),
hw AS (SELECT item_id, part, list_filter(list_transform(regexp_extract_all(lower(t), '[^\x20\x09-\x0D]+'), lambda w: regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda w: w <> '') AS w FROM h),
both_parts AS (SELECT item_id, max(CASE WHEN part = 'q' THEN w END) AS q, max(CASE WHEN part = 'a' THEN w END) AS a FROM hw GROUP BY item_id),
fixed AS (SELECT item_id, CASE WHEN len(q) > 0 AND len(a) > 0 THEN q ELSE (q || a)[1:(len(q || a) + 1) // 2] END AS q, CASE WHEN len(q) > 0 AND len(a) > 0 THEN a ELSE (q || a)[(len(q || a) + 1) // 2 + 1:] END AS a FROM both_parts),
long_parts AS (SELECT item_id, 'q' AS part, q AS w FROM fixed UNION ALL SELECT item_id, 'a', a FROM fixed),
sh AS (SELECT DISTINCT item_id, part, least(5, len(w)) AS n, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS k FROM long_parts WHERE len(w) > 0)),
ds AS (SELECT DISTINCT doc_id, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM sh))),
total AS (SELECT item_id, part, count(*) AS c FROM sh GROUP BY item_id, part),
hit AS (SELECT doc_id, item_id, part, count(*) AS c FROM ds JOIN sh USING (n, s) GROUP BY doc_id, item_id, part),
pair AS (SELECT DISTINCT doc_id, item_id FROM hit)
SELECT p.doc_id, p.item_id, CASE WHEN tq.c IS NULL THEN 1.0 ELSE coalesce(hq.c, 0) / tq.c::double END AS question_overlap, CASE WHEN ta.c IS NULL THEN 1.0 ELSE coalesce(ha.c, 0) / ta.c::double END AS answer_overlap
FROM pair p LEFT JOIN total tq ON tq.item_id = p.item_id AND tq.part = 'q' LEFT JOIN total ta ON ta.item_id = p.item_id AND ta.part = 'a'
LEFT JOIN hit hq ON hq.doc_id = p.doc_id AND hq.item_id = p.item_id AND hq.part = 'q' LEFT JOIN hit ha ON ha.doc_id = p.doc_id AND ha.item_id = p.item_id AND ha.part = 'a'
WHERE CASE WHEN tq.c IS NULL THEN 1.0 ELSE coalesce(hq.c, 0) / tq.c::double END >= 0.6 AND CASE WHEN ta.c IS NULL THEN 1.0 ELSE coalesce(ha.c, 0) / ta.c::double END >= 0.6"""
