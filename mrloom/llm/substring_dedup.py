"""Exact substring deduplication with fixed-block anchors.

A window is WINDOW consecutive words of a document. A window that also starts earlier (in a smaller doc_id, or
in the same document further left) goes, with all words that it covers; windows are judged on
the input. Any window holds a whole block of BLOCK words that starts at a multiple of BLOCK in its document, so:

1. Each document's non-overlapping blocks are the index, and its rolling runs of BLOCK words are the
   probes. Both go, as short hashes with their places, to the part that owns the hash. A run that
   equals an indexed block elsewhere is a hit, on both sides.
2. Hits are extended: every window around a hit is hashed in full (96 bits) and meets its equals in the part that owns the
   hash; all but the earliest go. Neighbouring windows make up the maximal repeats.
3. The documents drop the words that their windows cover.

A hash that a third of all documents hold would swamp its part, so a task first settles what it can
among its own documents: hits that it sees itself stay at home and send one index entry, and of
equal windows it sends the earliest alone. So a part gets from each slice of the input at most one
entry of a hash. Texts move once, dealt by a key of 128 bits, and that exchange serves both joins. A slice sends a row to each part
that it has something for, and to at most WIDTH: beyond as many parts, its rows go to groups of parts first, where the rows of
many slices are dealt on together, so that rows never number slices times parts.

Defined results: null and empty texts have no words (the digest is that of the empty text); documents
shorter than a window stay whole; null ids are ordered first; rows that share a doc_id but not
the text are documents of equal rank (a window that starts at the same place in both is no repeat of the other); equal rows come back as often as
they came, with equal results; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, words

WINDOW, BLOCK = 20, 10
#: Words of a slice (what a task settles at a time), characters of text for each part, known word hashes.
SLICE_WORDS, PART_CHARS, KEPT_HASHES = 1_000_000, 24_000_000, 500_000
#: Odd factors of the rolling hashes.
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SEGMENT = 1 << 15
#: Parts, or groups of parts, that a slice writes rows for at most; bytes of rows that a group deals on at once.
WIDTH, DEALT_BYTES = 4096, 64 << 20

_RUNS = "keys array<bigint>, keys2 array<bigint>, n array<int>, starts array<int>, lens array<int>"
_ENTRIES = "entry_keys array<bigint>, entry_keys2 array<bigint>, entry_n array<int>"
ASKS = f"part int, {_RUNS}, {_ENTRIES}, entry_segments array<smallint>, hashes array<int>, places array<smallint>, indexed array<int>"
CLAIMS = f"part int, {_RUNS}, {_ENTRIES}, entry_ids array<bigint>, high array<bigint>, low array<int>, places array<int>"
#: What rows to groups of parts hold besides: which part of the group each place (each indexed hash) is for.
SUBS, INDEXED_SUBS = ", subs array<int>", ", indexed_subs array<int>"
REPLIES = f"bucket int, {_RUNS}"
RUNS = "key bigint, key2 bigint, starts array<int>, lens array<int>"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all others."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def rolling(values: np.ndarray, width: int, factor: int) -> np.ndarray:
    """Polynomial hash, modulo 2**64, of every run of width values; from runs of 1, 2, 4, ... values."""
    out, done, run, span = None, 0, values, 1
    while True:
        if width & span:
            if out is None:
                out = run
            else:
                m = len(run) - done
                out = out[:m] + run[done:] * np.uint64(pow(factor, done, 1 << 64)) if m > 0 else out[:0]
            done += span
        if done == width:
            return mixed(out[: max(0, len(values) - width + 1)])
        m = len(run) - span
        run = run[:m] + run[span:] * np.uint64(pow(factor, span, 1 << 64)) if m > 0 else run[:0]
        span *= 2


class Slice:
    """The words of some documents, as hashes in one array."""

    def __init__(self, docs: list[list[bytes]], hashes: _Hashes):
        self.sizes = np.array([len(d) for d in docs], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.values = np.fromiter((hashes[w] for d in docs for w in d), np.uint64, int(self.sizes.sum()))
        self.doc = np.repeat(np.arange(len(docs)), self.sizes)
        self.place = np.arange(len(self.values)) - self.starts[self.doc]

    def runs_at(self, width: int) -> np.ndarray:
        """Where runs of width words start."""
        return np.flatnonzero(self.place + width <= self.sizes[self.doc])


def slices(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[Slice, dict[str, list]]]:
    """Slices of about SLICE_WORDS words, with the named columns of their rows."""
    hashes, docs, held, size = _Hashes(), [], {c: [] for c in columns}, 0
    for batch in batches:
        rows = {c: batch.column(c).to_pylist() for c in columns}
        for k, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            docs.append(words(text))
            size += len(docs[-1])
            for c in columns:
                held[c].append(rows[c][k])
            if size >= SLICE_WORDS:
                yield Slice(docs, hashes), held
                docs, held, size = [], {c: [] for c in columns}, 0
                if len(hashes) > KEPT_HASHES:
                    hashes = _Hashes()
    if docs:
        yield Slice(docs, hashes), held


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before it."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def _as_runs(owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, sorted by owner and place: owner and number of its runs, then start and length of each run."""
    new = _changes(owner, place - np.arange(len(place)))
    at = np.flatnonzero(new)
    lens = np.diff(np.append(at, len(place)))
    first = np.flatnonzero(_changes(owner[at]))
    return owner[at][first], np.diff(np.append(first, len(at))), place[at], lens


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _expand(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(values, n)


def _messages(part: np.ndarray, n_parts: int, entries: dict, places: dict, local: tuple, turn: int, extra: dict | None = None) -> pa.RecordBatch:
    """One row for each part that there is something for. part: of each place, sorted; entries: name to (values at a place, type), one value
    for each stretch of a part with the same owner; places: name to (values, type); local: runs settled at
    home, which ride with the part whose turn it is; extra: name to (part of each value, values, type)."""
    bounds = np.searchsorted(part, np.arange(n_parts + 1))
    owner = entries.pop("owner")
    at = np.flatnonzero(_changes(part, owner))
    entry_bounds = np.searchsorted(part[at], np.arange(n_parts + 1))
    names, arrays = ["part"], [pa.array(np.arange(n_parts), pa.int32())]
    turn %= n_parts
    keys, keys2, n, starts, lens = local
    for name, values, kind in (("keys", keys, pa.int64()), ("keys2", keys2, pa.int64()), ("n", n, pa.int32()), ("starts", starts, pa.int32()), ("lens", lens, pa.int32())):
        names.append(name)
        arrays.append(_lists(values, np.where(np.arange(n_parts + 1) > turn, len(values), 0), kind))
    used = np.diff(bounds) > 0
    used[turn] |= len(keys) > 0
    for name, (values, kind) in entries.items():
        names.append(name)
        arrays.append(_lists(values[at], entry_bounds, kind))
    names.append("entry_n")
    arrays.append(_lists(np.diff(np.append(at, len(part))), entry_bounds, pa.int32()))
    for name, (values, kind) in places.items():
        names.append(name)
        arrays.append(_lists(values, bounds, kind))
    for name, (owners, values, kind) in (extra or {}).items():
        names.append(name)
        arrays.append(_lists(values, own := np.searchsorted(owners, np.arange(n_parts + 1)), kind))
        used |= np.diff(own) > 0
    return pa.RecordBatch.from_arrays(arrays, names=names).filter(pa.array(used))


def _group(part: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The group of each part, and its number there; up to width parts the part itself, and 0."""
    return part % width, part // width


def _ask(n_parts: int, width: int):
    """Blocks and probes of each slice, to the parts that own their hashes."""
    names = _names(ASKS + (SUBS + INDEXED_SUBS if n_parts > width else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, (s, rows) in enumerate(slices(batches, ["key", "key2"])):
            keys, keys2 = np.array(rows["key"], np.int64), np.array(rows["key2"], np.int64)
            at = s.runs_at(BLOCK)
            if not len(at):
                continue
            x = rolling(s.values, BLOCK, FACTORS[0])[at]
            order = np.argsort(x, kind="stable")
            new = _changes(x[order])
            group = np.empty(len(x), np.int64)
            group[order] = np.cumsum(new) - 1
            block = s.place[at] % BLOCK == 0
            settled = (np.bincount(group) >= 2) & (np.bincount(group, weights=block) > 0)
            home = settled[group]
            hit = at[home]
            owner, n, starts, lens = _as_runs(s.doc[hit], s.place[hit])
            rest = np.flatnonzero(~home)
            part, part_sub = _group(((x[rest] >> np.uint64(32)) % np.uint64(n_parts)).astype(np.int64), width)
            by = np.argsort(part, kind="stable")
            rest, part, part_sub = rest[by], part[by], part_sub[by]
            doc, place = s.doc[at[rest]], s.place[at[rest]]
            indexed = x[order][new][settled]
            indexed_part, indexed_sub = _group(((indexed >> np.uint64(32)) % np.uint64(n_parts)).astype(np.int64), width)
            by = np.argsort(indexed_part, kind="stable")
            yield _messages(
                part,
                min(n_parts, width),
                {"owner": doc * (1 << 20) + place // SEGMENT, "entry_keys": (keys[doc], pa.int64()), "entry_keys2": (keys2[doc], pa.int64()), "entry_segments": (place // SEGMENT, pa.int16())},
                {"hashes": (x[rest].astype(np.uint32).view(np.int32), pa.int32()), "places": ((place % SEGMENT * 2 + block[rest]).astype(np.uint16).view(np.int16), pa.int16()), "subs": (part_sub, pa.int32())},
                (keys[owner], keys2[owner], n, starts, lens),
                turn,
                {"indexed": (indexed_part[by], indexed[by].astype(np.uint32).view(np.int32), pa.int32()), "indexed_subs": (indexed_part[by], indexed_sub[by], pa.int32())},
            ).select(names)

    return run


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _deal_on(n_parts: int, width: int, schema: str):
    """Rows to groups of parts, some of them at a time, as rows to their parts."""
    names = _names(schema)
    entries, places = [c for c in names if c.startswith("entry_") and c != "entry_n"], [c for c in ("hashes", "places", "high", "low") if c in names]

    def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        groups = rows.column("part").to_numpy()
        for group in np.unique(groups).tolist():
            t = rows.filter(pa.array(groups == group))
            n = _flat(t, "entry_n")
            entry, subs = _expand(np.arange(len(n)), n), _flat(t, "subs")
            by = np.argsort(subs, kind="stable")
            kind = lambda c: t.schema.field(c).type.value_type
            extra = {}
            if "indexed" in names:
                own = np.argsort(_flat(t, "indexed_subs"), kind="stable")
                extra["indexed"] = _flat(t, "indexed_subs")[own], _flat(t, "indexed")[own], kind("indexed")
            dealt = _messages(
                subs[by],
                -(-(n_parts - group) // width),
                {"owner": entry[by]} | {c: (_flat(t, c)[entry][by], kind(c)) for c in entries},
                {c: (_flat(t, c)[by], kind(c)) for c in places},
                tuple(_flat(t, c) for c in ("keys", "keys2", "n", "starts", "lens")),
                0,
                extra,
            ).select(names)
            yield dealt.set_column(0, "part", pa.array(dealt.column("part").to_numpy() * width + group, pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) >= DEALT_BYTES:
                yield from out(held)
                held = []
        if held:
            yield from out(held)

    return run


def _replies(keys: np.ndarray, keys2: np.ndarray, n: np.ndarray, starts: np.ndarray, lens: np.ndarray, n_parts: int) -> pa.Table:
    """Runs, n of each key, packed into a row for each bucket of keys: as many rows as parts, however many documents reply."""
    bucket = (keys.view(np.uint64) % np.uint64(n_parts)).astype(np.int64)
    by, runs_by = np.argsort(bucket, kind="stable"), np.argsort(np.repeat(bucket, n), kind="stable")
    held = np.unique(bucket)
    bounds = lambda of: np.append(np.searchsorted(of, held), len(of))
    own, runs = bounds(bucket[by]), bounds(np.repeat(bucket, n)[runs_by])
    return pa.Table.from_arrays(
        [pa.array(held, pa.int32()), _lists(keys[by], own, pa.int64()), _lists(keys2[by], own, pa.int64()), _lists(n[by], own, pa.int32()), _lists(starts[runs_by], runs, pa.int32()), _lists(lens[runs_by], runs, pa.int32())],
        names=["bucket", "keys", "keys2", "n", "starts", "lens"],
    )


def _with_settled(owner: np.ndarray, place: np.ndarray, t: pa.Table, n_parts: int) -> pa.Table:
    """Replies for these places (sorted by owner and place) and for the runs that tasks settled at home."""
    own, n, starts, lens = _as_runs(owner, place)
    both = [np.append(x, _flat(t, c)) for x, c in ((_flat(t, "entry_keys")[own], "keys"), (_flat(t, "entry_keys2")[own], "keys2"), (n, "n"), (starts, "starts"), (lens, "lens"))]
    return _replies(*(x.astype(np.int64) for x in both), n_parts)


def _merge(t: pa.Table) -> pa.Table:
    """The replies to a bucket of keys, as one row for each key."""
    keys, keys2, n, starts, lens = (_flat(t, c) for c in ("keys", "keys2", "n", "starts", "lens"))
    of, of2 = np.repeat(keys, n), np.repeat(keys2, n)
    by = np.lexsort((of2, of))
    first = np.flatnonzero(_changes(of[by], of2[by]))
    bounds = np.append(first, len(of))
    return pa.Table.from_arrays([pa.array(of[by][first], pa.int64()), pa.array(of2[by][first], pa.int64()), _lists(starts[by], bounds, pa.int32()), _lists(lens[by], bounds, pa.int32())], names=["key", "key2", "starts", "lens"])


def _answer(t: pa.Table, n_parts: int) -> pa.Table:
    """Hits among the entries of a part: hashes of two places or more, one of them a block."""
    n = _flat(t, "entry_n")
    entry = _expand(np.arange(len(n)), n)
    coded = _flat(t, "places").view(np.uint16).astype(np.int64)
    place = coded // 2 + _expand(_flat(t, "entry_segments").astype(np.int64), n) * SEGMENT
    x = _flat(t, "hashes")
    order = np.argsort(x, kind="stable")
    new = _changes(x[order])
    group = np.empty(len(x), np.int64)
    group[order] = np.cumsum(new) - 1
    known = np.isin(x[order][new], _flat(t, "indexed"))
    hit = known | (np.bincount(group, minlength=len(known)) >= 2) & (np.bincount(group, weights=coded % 2, minlength=len(known)) > 0)
    at = np.flatnonzero(hit[group])
    return _with_settled(entry[at], place[at], t, n_parts)


def _repeats(high: np.ndarray, low: np.ndarray, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """True for windows that are not the earliest of their kind."""
    order = np.lexsort((place, ids, low, high))
    new = _changes(high[order], low[order])
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
    out = np.empty(len(order), bool)
    out[order] = (ids[order] != ids[first]) | (place[order] != place[first])
    return out


def _claim(n_parts: int, width: int):
    """Windows around hits, to the parts that own their hashes; of equal ones in a slice the earliest alone."""
    names = _names(CLAIMS + (SUBS if n_parts > width else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, (s, rows) in enumerate(slices(batches, ["key", "key2", "rank", "starts", "lens"])):
            keys, keys2, ids = (np.array(rows[c], np.int64) for c in ("key", "key2", "rank"))
            n = [len(x) for x in rows["starts"]]
            doc = np.repeat(np.arange(len(n)), n)
            first = np.array([v for x in rows["starts"] for v in x], np.int64)
            last = first + np.array([v for x in rows["lens"] for v in x], np.int64) - 1
            first, last = np.maximum(first - (WINDOW - BLOCK), 0), np.minimum(last, s.sizes[doc] - WINDOW)
            real = last >= first
            edge = np.zeros(len(s.values) + 1, np.int64)
            np.add.at(edge, s.starts[doc][real] + first[real], 1)
            np.add.at(edge, s.starts[doc][real] + last[real] + 1, -1)
            at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            if not len(at):
                continue
            high = rolling(s.values, WINDOW, FACTORS[0])[at]
            low = (rolling(mixed(s.values + np.uint64(FACTORS[1])), WINDOW, FACTORS[1])[at] >> np.uint64(32)).astype(np.uint32)
            doc, place = s.doc[at], s.place[at]
            gone = _repeats(high, low, ids[doc], place)
            owner, n, starts, lens = _as_runs(doc[gone], place[gone])
            rest = np.flatnonzero(~gone)
            part, part_sub = _group(((high[rest] >> np.uint64(32)) % np.uint64(n_parts)).astype(np.int64), width)
            by = np.argsort(part, kind="stable")
            rest, part, part_sub = rest[by], part[by], part_sub[by]
            yield _messages(
                part,
                min(n_parts, width),
                {"owner": doc[rest], "entry_keys": (keys[doc[rest]], pa.int64()), "entry_keys2": (keys2[doc[rest]], pa.int64()), "entry_ids": (ids[doc[rest]], pa.int64())},
                {"high": (high[rest].view(np.int64), pa.int64()), "low": (low[rest].view(np.int32), pa.int32()), "places": (place[rest], pa.int32()), "subs": (part_sub, pa.int32())},
                (keys[owner], keys2[owner], n, starts, lens),
                turn,
            ).select(names)

    return run


def _judge(t: pa.Table, n_parts: int) -> pa.Table:
    """The windows of a part that start earlier elsewhere."""
    n = _flat(t, "entry_n")
    entry = _expand(np.arange(len(n)), n)
    place = _flat(t, "places").astype(np.int64)
    gone = _repeats(_flat(t, "high"), _flat(t, "low"), _expand(_flat(t, "entry_ids"), n), place)
    return _with_settled(entry[gone], place[gone], t, n_parts)


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        columns = (batch.column("text").cast(pa.binary()).to_pylist(), batch.column("starts").to_pylist(), batch.column("lens").to_pylist())
        for text, starts, lens in zip(*columns, strict=True):
            own = words(text)
            n_words.append(len(own))
            if starts:
                edge = np.zeros(len(own) + 1, np.int64)
                first = np.array(starts, np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + np.array(lens, np.int64) - 1 + WINDOW, -1)
                stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                own = [own[k] for k in stay.tolist()]
            n_removed.append(n_words[-1] - len(own))
            kept.append(b" ".join(own).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part_chars: int = PART_CHARS, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is the text of the words that stay, joined by one space."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.select(F.xxhash64("doc_id", "text").alias("key"), F.xxhash64(F.lit(1), "text", "doc_id").alias("key2"), "doc_id", "text")
    n_parts = 1 + (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // part_chars

    def judged(texts: DataFrame, send, by, schema: str, subs: str) -> DataFrame:
        sent = texts.mapInArrow(send(n_parts, width), schema + (subs if n_parts > width else ""))
        if n_parts > width:  # as many tasks as parts deal the rows on
            sent = sent.repartition("part", F.pmod(F.xxhash64("entry_keys"), F.lit(-(-n_parts // width)))).mapInArrow(_deal_on(n_parts, width, schema), schema)
        return sent.groupBy("part").applyInArrow(lambda t: by(t, n_parts), REPLIES).groupBy("bucket").applyInArrow(_merge, RUNS)

    # Written, so that the shuffle of the probes is gone before the texts and windows move.
    hits = stored(judged(rows.select("key", "key2", "text"), _ask, _answer, ASKS, SUBS + INDEXED_SUBS), "hits")
    rank = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("rank")
    # Both joins read the same columns of the texts, so they share one exchange.
    gone = judged(rows.join(hits, ["key", "key2"]).select("key", "key2", rank, "text", "starts", "lens"), _claim, _judge, CLAIMS, SUBS)
    return rows.join(gone, ["key", "key2"], "left").select("doc_id", "text", "starts", "lens").mapInArrow(_drop, "doc_id long, n_words long, n_removed long, kept string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its words, how many went, and the digest of the text that stays."""
    kept = drop_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS x FROM p JOIN d USING (doc_id)),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS k FROM h),
c AS (SELECT DISTINCT doc_id, s + o AS i FROM r, range(0, 20) t(o) WHERE k > 1),
g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
t AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) AS kept FROM u ANTI JOIN c ON u.doc_id = c.doc_id AND u.i = c.i GROUP BY u.doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(len(gone), 0)::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN t USING (doc_id)"""
