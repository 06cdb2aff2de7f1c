"""Maximal periodic runs of words, by a dictionary of basic factors.

The words of a document get a number each, and so does every stretch of 2, 4, 8, ... words (a basic factor), made from the
numbers of its two halves; equal stretches have equal numbers. Only stretches that occur again go on to the next length, so the
dictionary shrinks fast on ordinary text. For a length of span words, the occurrences of a stretch are linked to their
successors. Successors at most half a span apart have one distance throughout: they make arithmetic progressions. A
run with a period q from span to below twice the span starts with a stretch that occurs q words later, at most three
progressions on; and, as the run can't be longer to the left, the stretch at its start or the one q words later is the
first of its progression. So each stretch proposes its distances to the first ones of the next three progressions, and from those of the three
before it. A proposal stands if the words before the two differ and if two more stretches prove the whole period equal;
then it is extended to the right. A run that comes up with multiples of its period keeps the least.

Documents stay where they are read; those of a stretch of rows are worked on together, with marks between them that equal nothing.

Defined results: null and empty texts have no runs and an empty collapsed text; repeated rows and null ids are
treated like others; very long texts are one stretch of their own; an empty table gives an empty result; only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts, words

#: A run has at least so many words; words of documents that are worked on together, about.
LEAST, SLICE_WORDS = 12, 1 << 18
#: Progressions on, at most: each step between them is over half a span, and a period is under two.
AHEAD = 3


def _proposals(at: np.ndarray, name: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of equal stretches from span to below twice the span apart, one of them first in its progression."""
    at = at[np.argsort(name[at], kind="stable")]
    key = name[at]
    joined = (key[1:] == key[:-1]) & (2 * np.diff(at) <= span)
    new = np.concatenate([[True], ~joined])
    head = np.flatnonzero(new)
    chain = np.cumsum(new) - 1
    left, right = [], []
    for ahead in range(1, AHEAD + 1):
        for here, there in ((chain + ahead, 1), (chain - ahead, -1)):
            own = np.flatnonzero((here >= 0) & (here < len(head)))
            other = head[here[own]]
            a, b = (at[own], at[other]) if there > 0 else (at[other], at[own])
            good = (key[own] == key[other]) & (b - a >= span) & (b - a < 2 * span)
            left.append(a[good])
            right.append(b[good])
    return np.concatenate(left), np.concatenate(right)


def _end(codes: np.ndarray, start: int, period: int) -> int:
    """Where the stretch from start with this period ends; two periods are known."""
    at, width = start + period, 64
    while True:
        m = min(width, len(codes) - at - period)
        differ = codes[at : at + m] != codes[at + period : at + period + m]
        k = int(differ.argmax()) if m else 0
        if m and differ[k]:
            return at + k + period
        at += m
        if m < width:
            return at + period
        width *= 2


def find_runs(codes: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run, sorted. codes: for every word the place of its first occurrence."""
    m = len(codes)
    name, span = codes, 1
    at = np.flatnonzero(np.bincount(codes, minlength=m)[codes] > 1) if m else codes
    found: dict[tuple[int, int], int] = {}
    while len(at):
        i, j = _proposals(at, name, span)
        q = j - i
        keep = (j + q <= m) & ((i == 0) | (codes[i - 1] != codes[j - 1]))
        i, j, q = i[keep], j[keep], q[keep]
        keep = name[i + q - span] == name[j + q - span]
        for start, period in set(zip(i[keep].tolist(), q[keep].tolist(), strict=True)):
            end = _end(codes, start, period)
            if end - start >= least:
                found.setdefault((start, end), period)
        again = np.zeros(m + span, bool)
        again[at] = True
        at = at[again[at + span]]
        pair = name[at] * m + name[at + span]
        order = np.argsort(pair, kind="stable")
        at, pair = at[order], pair[order]
        new = np.concatenate([[True], pair[1:] != pair[:-1]]) if len(at) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        name = np.arange(m)
        name[at] = np.repeat(at[first], size)
        at = np.sort(at[np.repeat(size > 1, size)])
        span *= 2
    return sorted((start, end - start, period) for (start, end), period in found.items())


def _slices(batch: pa.RecordBatch) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for text in texts(batch):
        held.append(words(text))
        size += len(held[-1])
        if size >= SLICE_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def runs_of(docs: list[list[bytes]], least: int = LEAST) -> tuple[list[list[tuple[int, int, int]]], np.ndarray, np.ndarray]:
    """The runs of each document, a flag for each place (the word stays), and the documents' first places.

    Each document is followed by a place for a mark.
    """
    sizes = np.array([len(d) + 1 for d in docs], np.int64)
    starts = np.cumsum(sizes) - sizes
    codes = np.arange(int(sizes.sum()))
    for start, doc in zip(starts.tolist(), docs, strict=True):
        codes[start : start + len(doc)] = np.fromiter(map({}.setdefault, doc, count(start)), np.int64, len(doc))
    found: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    drop = np.zeros(len(codes) + 1, np.int64)
    for start, length, period in find_runs(codes, least):
        k = int(np.searchsorted(starts, start, "right")) - 1
        found[k].append((start - int(starts[k]), length, period))
        drop[start + period] += 1
        drop[start + length] -= 1
    return found, np.cumsum(drop) == 0, starts


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _finder(least: int, id_type: pa.DataType):
    out = pa.schema([("doc_id", id_type), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for docs in _slices(batch):
                found, stays, starts = runs_of(docs, least)
                kept = [b" ".join(compress(d, stays[s : s + len(d)].tolist()) if f else d) for d, f, s in zip(docs, found, starts.tolist(), strict=True)]
                runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in f] for f in found], pa.list_(_RUN))
                ids = batch.column("doc_id").slice(done, len(docs)).cast(id_type)
                yield pa.RecordBatch.from_arrays([ids, pa.array(list(map(len, docs)), pa.int64()), runs, pa.array(kept, pa.binary())], schema=out)
                done += len(docs)

    return run


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs: array of start, length, period by start and period, collapsed: the text's words without what runs repeat, UTF-8)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_finder(least, pa.int64()), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")


def replanted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in documents chosen by their id's checksum, the words from a place on repeat; others are unchanged."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    own = F.when(chosen, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    n, g, a, w = F.size("_w"), F.floor(h / 10), F.col("_a"), F.col("_w")
    p = 1 + F.floor((n - a) / (3 + g % 8))
    return (
        docs.select("doc_id", "text", own.alias("_w"))
        .withColumn("_a", F.when(n > 0, g % n).cast("int"))
        .withColumn("_p", p.cast("int"))
        .select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + (i - a) % F.col("_p")))), " ")).otherwise(F.col("text")).alias("text"))
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document and what is left without their repeats."""
    found = periodic_runs(replanted(table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("_l", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_l.start").alias("start"),
        (-F.col("_l.less")).alias("length"),
        F.col("_l.period").alias("period"),
        F.floor(-1000 * F.col("_l.less") / F.col("_l.period")).alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
