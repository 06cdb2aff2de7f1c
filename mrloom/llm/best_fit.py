"""Packing of tokenized documents into sequences: bounded-space best fit, open bins in a bitset keyed by free space.

Every document's ids, with an end id after them, are cut into pieces of at most a sequence's length where they are longer. The
pieces are dealt evenly to tasks of about SLICE_ROWS pieces, in each of which they come longest first. A piece goes
into the open sequence with the least free space that holds it: that is the lowest set bit, from the piece's length on, of a number that
has a bit for each free space. At most OPEN_BINS sequences are open; when one more is opened, the fullest closes. A
task is a pure function of its sorted pieces, so a lost one is repeated with the same result, and its sequences are its own.

Ids come from a public tokenizer that splits texts at white space: a word's ids do not depend on its neighbours, so each
distinct word is tokenized once, as long as a worker remembers it (a bounded number of short words).

Defined results: a null or empty text is the end id alone; bytes that are no UTF-8 count as replacement characters; null
and repeated ids and equal rows are packed like others; very long texts become many pieces; an empty table gives an
empty result. pack() carries all columns of its input along; those called sequence_id and offset give way to the result's.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, texts, words

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END = 2048, 0
#: Sequences that are open at most, and pieces of a task, about.
OPEN_BINS, SLICE_ROWS = 65_536, 100_000
#: Words that a worker remembers (two generations of so many, and as many stretches of words), and the bytes of the longest; bytes of texts that are tokenized together, about.
KEPT_WORDS, KEPT_BYTES, PIECE = 300_000, 48, 4 << 20


# How the tokenizer parts lower-case words into stretches, each of which it encodes by itself.
STRETCHES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for words of ASCII characters (but the bar, which special tokens hold) and letters of Western Europe, which are their own composed forms.
LETTERS = "a-zß-öø-ÿ"
PLAIN = re.compile(r"[!-{}~À-ÖØ-öø-ÿ]+")
PLAIN_STRETCHES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")


class WordIds:
    """The ids of words, as little-endian unsigned 32-bit numbers.

    New plain words are parted here, and only stretches that are not known go to the tokenizer's model; all others are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task its core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.stretches: dict[str, bytes] = {}
        own = json.loads(self.tokenizer.to_str())
        steps = [*((own["normalizer"] or {}).get("normalizers") or []), *((own["pre_tokenizer"] or {}).get("pretokenizers") or [])]
        self.known = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] and steps[3]["pattern"].get("Regex") == STRETCHES
        self.known &= all("|" in x["content"] for x in own["added_tokens"])
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in (*range(0x21, 0x7F), *range(0xDF, 0x100))}

    def _stretch(self, text: str) -> bytes:
        found = [t.id for t in self.model.tokenize(text.translate(self.letters))]
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(text) <= KEPT_BYTES:
            self.stretches[text] = ids
        return ids

    def _encoded(self, new: list[bytes]) -> None:
        rest, held = [], self.stretches.get
        for w in new:
            text = w.decode("utf-8", "replace")
            if self.known and PLAIN.fullmatch(text):
                self.young[w] = b"".join([held(x) or self._stretch(x) for x in PLAIN_STRETCHES.findall(text.lower())])
            else:
                rest.append((w, text))
        encoded = self.tokenizer.encode_batch_fast([t for _, t in rest], add_special_tokens=False)
        self.young.update((w, struct.pack(f"<{len(ids)}I", *ids)) for (w, _), ids in zip(rest, (e.ids for e in encoded), strict=True))
        if len(self.stretches) > KEPT_WORDS:
            self.stretches = {}

    def of(self, docs: list[list[bytes]]) -> list[bytes]:
        """The ids of each document."""
        missing = set().union(*docs).difference(self.young)
        again = missing & self.old.keys()
        self.young.update((w, self.old[w]) for w in again)
        new = list(missing - again)
        self._encoded(new)
        out = [b"".join(map(self.young.__getitem__, d)) for d in docs]
        for w in new:
            if len(w) > KEPT_BYTES:
                del self.young[w]
        if len(self.young) > KEPT_WORDS:
            self.old, self.young = self.young, {}
        return out


@cache
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def _cutter(path: str, capacity: int, end: int):
    out = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
    step, last = 4 * capacity, struct.pack("<I", end)

    def rows(ids: list, docs: list[list[bytes]]) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in out]
        for doc_id, tokens in zip(ids, _word_ids(path).of(docs), strict=True):
            tokens += last
            for k, at in enumerate(range(0, len(tokens), step)):
                cut = tokens[at : at + step]
                for column, value in zip(columns, (doc_id, k, at // 4, len(cut) // 4, cut), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, docs, size = batch.column("doc_id").to_pylist(), [], [], 0
            for doc_id, text in zip(ids, texts(batch), strict=True):
                held.append(doc_id)
                docs.append(words(text))
                size += len(text or b"")
                if size >= PIECE:
                    yield rows(held, docs)
                    held, docs, size = [], [], 0
            if held:
                yield rows(held, docs)

    return run


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids): every document's tokens in pieces of at most capacity; ids as little-endian unsigned 32-bit numbers.

    tokenizer: the file of one that never joins what white space parts.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_cutter(tokenizer, capacity, end), "doc_id long, piece int, start long, length long, ids binary")


class BestFit:
    """Bins of a capacity, of which a fixed number is open."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.room = capacity, open_bins
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free space
        self.bits = self.opened = self.n_open = 0

    def _take(self, free: int) -> int:
        found = self.bins[free].pop()
        if not self.bins[free]:
            self.bits ^= 1 << free
        self.n_open -= 1
        return found

    def put(self, length: int) -> tuple[int, int]:
        """The bin of an item and its offset there."""
        if not 0 <= length <= self.capacity:
            raise ValueError(f"a length of {length} for a capacity of {self.capacity}")
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            found = self._take(free)
        else:
            if self.n_open >= self.room:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, found = self.capacity, self.opened
            self.opened += 1
        left = free - length
        if left:
            self.bins[left].append(found)
            self.bits |= 1 << left
            self.n_open += 1
        return found, self.capacity - free


def _packer(length: str, capacity: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = BestFit(capacity, open_bins)
        for batch in batches:
            put = [fit.put(n) for n in batch.column(length).to_pylist()]
            first = pa.array([b for b, _ in put], pa.int64())
            base = pa.array([p << 32 for p in batch.column("_p_task").to_pylist()], pa.int64())
            names = [c for c in batch.schema.names if c != "_p_task"]
            columns = [*map(batch.column, names), pc.add(base, first), pa.array([o for _, o in put], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    return run


def pack(items: DataFrame, length: str = "length", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The items with sequence_id (any numbers) and offset. items are written once; lengths from 0 to the capacity."""
    columns = [c for c in items.columns if c.lower() not in ("sequence_id", "offset")]
    held = stored(items.select(*columns), "pieces")
    n = -(-max(1, held.count()) // slice_rows)
    dealt = held.repartition(n).sortWithinPartitions(F.col(length).desc(), F.xxhash64(*columns), *(c for c, kind in held.dtypes if "map" not in kind and "variant" not in kind))
    return dealt.withColumn("_p_task", F.spark_partition_id()).mapInArrow(_packer(length, capacity, open_bins), held.schema.add("sequence_id", "long").add("offset", "long"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_pieces, n_tokens, ids): the pieces of each sequence, one after another; needs their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most capacity tokens
    return packed.groupBy("sequence_id").agg(F.count("*").alias("n_pieces"), F.sum("length").alias("n_tokens"), parts.alias("_p")).select("sequence_id", "n_pieces", "n_tokens", F.aggregate("_p.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"))


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    cut = pieces(table(spark, sf_dir, "documents"))
    return pack(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
