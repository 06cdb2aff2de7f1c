"""Similarity self-join of texts on word shingles, by chosen paths.

Equal texts fold into one node first. A node's shingles (five words) are embedded in COORDINATES minhashes. From the root of a run, a bucket
chooses each coordinate with probability 1 / (threshold * COORDINATES), and its nodes part by their values there: one
child bucket for each chosen coordinate and value, 1 / threshold children in the mean for each node. So two nodes at the
threshold share one child in the mean, while others part soon. Small buckets are compared at
once, large ones chosen from anew. The number of rounds grows with the logarithm of the number of texts; a pair at the
threshold survives them with the probability of a branching process, and the number of runs follows from that and the target recall.

The comparison of a bucket (on the minhashes, with 4.5 standard errors to spare) ties nodes to a candidate group. Each group's texts are then
compared in full, shingle by shingle and all with all, in tasks of two blocks of at most about
BLOCK texts, which count links and leave a spanning forest: pairs themselves are never written out. The
classes are the components of these links. The buckets that stay large after the last round are compared in the same
blocks, so no bucket is capped.

Defined results: texts without words have no shingles, link to nothing and are classes of their own;
texts of under five words have one shingle, all their words; equal texts are linked; rows that repeat count
as documents of their own (two equal rows link to each other); the class id is the least doc_id of the
class (null only if all are null); an empty table gives an empty result; only the named columns are
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, stored, table, texts, words
from .components import components, local_roots
from .substring_dedup import FACTORS, Slice, _changes, _Hashes, mixed, rolling

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.999
COORDINATES, DEPTH = 64, 3
#: Texts up to which DEPTH rounds part what is not alike; every tenfold asks for one more.
SHALLOW = 10_000_000
#: Nodes of a bucket that are compared at once, and texts of a block.
SMALL, BLOCK = 400, 256
MULTIPLIERS = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(FACTORS[0])) | np.uint64(1)
#: Words that a task hashes at a time, and word hashes that it keeps.
SLICE, KEPT_HASHES = 200_000, 100_000


def runs_for(recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold was in one bucket of the given depth with this probability."""
    lost = 0.0
    for _ in range(depth):
        lost = math.exp(lost - 1)
    return math.ceil(math.log(1 - recall) / math.log(lost))


def depth_for(nodes: int) -> int:
    return DEPTH + math.ceil(math.log10(max(1.0, nodes / SHALLOW)))


def shingle_hashes(docs: list[list[bytes]], hashes: dict) -> tuple[np.ndarray, np.ndarray]:
    """(document's number, hash) of every shingle, by document; repeats are kept."""
    s = Slice(docs, hashes)
    at = s.runs_at(SHINGLE)
    short = [k for k, d in enumerate(docs) if 0 < len(d) < SHINGLE]
    doc = np.append(s.doc[at], np.array(short, np.int64))
    x = np.append(rolling(s.values, SHINGLE, FACTORS[1])[at], np.array([xxhash.xxh3_64_intdigest(b" ".join(docs[k])) for k in short], np.uint64))
    if short:
        by = np.argsort(doc, kind="stable")
        doc, x = doc[by], x[by]
    return doc, x


def minhashes(docs: list[list[bytes]], hashes: dict) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the documents that have words, and their minhashes, a row each."""
    doc, x = shingle_hashes(docs, hashes)
    starts = np.flatnonzero(_changes(doc))
    if not len(starts):
        return starts, np.zeros((0, COORDINATES), np.uint32)
    return doc[starts], np.stack([np.minimum.reduceat((x * a) >> np.uint64(32), starts) for a in MULTIPLIERS], axis=1).astype(np.uint32)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()

    def out(docs: list, rows: list) -> pa.RecordBatch:
        held, signs = minhashes(docs, hashes)
        lists = [None] * len(docs)
        for k, sign in zip(held.tolist(), signs.view(np.int32), strict=True):
            lists[k] = sign
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "fold", "signs"])

    for batch in batches:
        docs, rows, size = [], [], 0
        for doc_id, fold, text in zip(batch.column("doc_id").to_pylist(), batch.column("fold").to_pylist(), texts(batch), strict=True):
            docs.append(words(text))
            rows.append((doc_id, fold))
            size += len(docs[-1])
            if size > SLICE:
                yield out(docs, rows)
                docs, rows, size = [], [], 0
        if docs:
            yield out(docs, rows)
        if len(hashes) > KEPT_HASHES:
            hashes = _Hashes()


def _children(threshold: float):
    """The child buckets of each row: path, node and minhashes."""
    chance = np.uint64(min((1 << 64) - 1, int((1 << 64) / (threshold * COORDINATES))))
    spread = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(FACTORS[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column("path").to_numpy(zero_copy_only=False).view(np.uint64)
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            signs = batch.column("signs").flatten().to_numpy(zero_copy_only=False).view(np.uint32).reshape(-1, COORDINATES)
            rows, coordinates = np.nonzero(mixed(path[:, None] ^ spread[None, :]) < chance)
            child = mixed(mixed(path[rows] + spread[coordinates]) ^ signs[rows, coordinates].astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(nodes[rows], pa.int64())], names=["path", "node"])

    return run


def _near(least: int):
    """Ties the nodes of each (bucket, first block, second block) whose minhashes agree in `least` coordinates.
    Rows come sorted by task; the ties of a batch of tasks leave as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task, rows in _tasks(batches, ["node", "side", "signs"], 20_000):
            node, at = np.unique(rows["node"].to_numpy(), return_inverse=True)
            signs = rows["signs"].combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint32).reshape(-1, COORDINATES)
            side = rows["side"].to_numpy()
            first = np.flatnonzero(_changes(task))
            sizes = np.diff(np.append(first, len(task)))
            a, b = [], []
            small = np.repeat(sizes <= 24, sizes)
            for step in range(1, int(sizes[sizes <= 24].max(initial=1))):
                i = np.flatnonzero(small[:-step] & (task[:-step] == task[step:]))
                i = i[(signs[i] == signs[i + step]).sum(axis=1) >= least]
                a.append(i)
                b.append(i + step)
            for start, size in zip(first[sizes > 24].tolist(), sizes[sizes > 24].tolist(), strict=True):
                own, two = signs[start : start + size], side[start : start + size]
                left = np.flatnonzero(two == 0)
                right = np.flatnonzero(two == 1) if (two == 1).any() else left
                same = np.zeros((len(left), len(right)), np.int16)
                for k in range(COORDINATES):
                    same += own[left, k, None] == own[None, right, k]
                i, j = np.nonzero(same >= least)
                a.append(start + left[i])
                b.append(start + right[j])
            a, b = np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])
            root = local_roots(len(node), at[a], at[b])
            tied = np.flatnonzero(root != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[tied]), pa.array(node[root[tied]])], names=["u", "v"])

    return run


def _tasks(batches: Iterator[pa.RecordBatch], columns: list[str], rows_at_once: int) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Whole tasks, about so many rows at once: the number of each row's task, and the rows."""
    held: list[pa.RecordBatch] = []

    def out(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, pa.Table]:
        t = pa.Table.from_batches(parts)
        keys = [t.column(c).to_numpy() for c in ("bucket", "i", "j")]
        return np.cumsum(_changes(*keys)) - 1, t.select(columns)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows_at_once:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "i", "j")]
            last = int(np.flatnonzero(_changes(*keys))[-1])
            if last:
                yield out([*held[:-1], batch.slice(0, last)])
                held = [batch.slice(last)]
            elif len(held) > 1:
                before = held[-2]
                if any(before.column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in ("bucket", "i", "j")):
                    yield out(held[:-1])
                    held = [batch]
    if held:
        yield out(held)


def _blocks(members: DataFrame, bucket: str, block: int) -> DataFrame:
    """members (bucket, node, m: size of the bucket, ...), dealt to tasks of two blocks (i, j); side: 0 in block i, 1 in block j (all 0 if i = j)."""
    n = F.ceil(F.col("m") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), n.cast("long")).cast("int")
    return (
        members.withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), n - 1)))
        .withColumns({"i": F.least("_own", "_other"), "j": F.greatest("_own", "_other"), "side": F.when(F.col("_own") > F.col("_other"), 1).otherwise(0)})
        .drop("_own", "_other")
        .withColumnRenamed(bucket, "bucket")
    )


def dealt(tasks: DataFrame) -> DataFrame:
    return tasks.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def _verify(threshold: float):
    """Links of each task's texts: (node, links, root), links weighed by the copies of the partner; and the least node tied to it here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for task, rows in _tasks(batches, ["node", "side", "copies", "text"], 256):
            if len(hashes) > KEPT_HASHES:
                hashes = _Hashes()
            node, side, copies = (rows.column(c).to_numpy() for c in ("node", "side", "copies"))
            text = rows.column("text").cast(pa.binary())
            links, root = np.zeros(len(node), np.int64), np.arange(len(node))
            first = np.flatnonzero(_changes(task))
            for start, end in zip(first.tolist(), np.append(first[1:], len(task)).tolist(), strict=True):
                own = slice(start, end)
                doc, x = _all_hashes((t.as_py() for t in text[own]), hashes)
                pair = linked(doc, x, end - start, threshold)
                two = side[own] == 1
                if two.any():
                    pair &= two[:, None] != two[None, :]
                np.fill_diagonal(pair, False)
                links[own] = pair @ copies[own]
                i, j = np.nonzero(np.triu(pair) if not two.any() else pair)
                root[own] = start + local_roots(end - start, i, j)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(node[root])], names=["node", "links", "root"])

    return run


def _all_hashes(found: Iterator[bytes | None], hashes: dict) -> tuple[np.ndarray, np.ndarray]:
    """shingle_hashes of many texts, about SLICE words at a time."""
    parts, docs, first, size = [], [], 0, 0
    for text in found:
        docs.append(words(text))
        size += len(docs[-1])
        if size > SLICE:
            parts.append((first, *shingle_hashes(docs, hashes)))
            docs, first, size = [], first + len(docs), 0
    parts.append((first, *shingle_hashes(docs, hashes)))
    return np.concatenate([a + doc for a, doc, _ in parts]), np.concatenate([x for _, _, x in parts])


def linked(doc: np.ndarray, x: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """Which of n documents have at least this Jaccard similarity. doc, x: the document and hash of each shingle."""
    order = np.lexsort((doc, x))
    doc, x = doc[order], x[order]
    once = _changes(x, doc)
    doc, x = doc[once], x[once]
    size = np.bincount(doc, minlength=n)
    value = np.cumsum(_changes(x)) - 1
    shared = (np.bincount(value) > 1)[value] if len(value) else np.zeros(0, bool)
    doc, value = doc[shared], value[shared]
    value = np.cumsum(_changes(value)) - 1
    both = np.zeros((n, n))
    for low in range(0, int(value[-1]) + 1 if len(value) else 0, 4096):
        a, b = np.searchsorted(value, (low, low + 4096))
        held = np.zeros((n, min(4096, int(value[-1]) + 1 - low)), np.float32)
        held[doc[a:b], value[a:b] - low] = 1
        both += held @ held.T
    union = size[:, None] + size[None, :] - both
    return (both >= threshold * union - 1e-9) & (both > 0)


def _folded(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("fold", F.unhex(F.md5("text")))


def _node_classes(rows: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(fold, first_id, copies, has_words, links, root) of every different text; root: its class."""
    sketches = rows.mapInArrow(_sketch, "doc_id long, fold binary, signs array<int>")
    # Copies of a text fold in the task that reads them, then across tasks; the numbers are fixed by writing them.
    nodes = stored(sketches.groupBy("fold").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("signs").alias("signs")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    signed = nodes.where("signs IS NOT NULL").select("node", "signs")

    rounds = depth_for(nodes.count())
    n_runs = runs_for(recall, rounds)
    schema = "path long, node long"
    level = signed.withColumn("path", F.explode(F.transform(F.sequence(F.lit(1), F.lit(n_runs)), lambda r: F.xxhash64(r.cast("long"))))).mapInArrow(_children(threshold), schema)
    least = math.ceil(COORDINATES * (threshold - 4.5 * math.sqrt(threshold * (1 - threshold) / COORDINATES)))
    found, used = [], []
    for depth in range(rounds):
        held = stored(level, "paths")
        # Written, so that the joins on the path stand between plain exchanges, of which a large one can be split.
        sizes = stored(held.groupBy("path").agg(F.count("*").alias("m")).where("m > 1"), "path-sizes")
        used += [held, sizes]
        whole = held.join(sizes if depth == rounds - 1 else sizes.where(f"m <= {SMALL}"), "path")
        found.append(dealt(_blocks(whole, "path", SMALL).join(signed, "node").select("bucket", "i", "j", "node", "side", "signs")).mapInArrow(_near(least), "u long, v long"))
        if depth == rounds - 1 or (large := sizes.where(f"m > {SMALL}")).isEmpty():
            break
        level = held.join(large, "path").join(signed, "node").select("path", "node", "signs").mapInArrow(_children(threshold), schema)
    ties = found[0]
    for more in found[1:]:
        ties = ties.unionByName(more)

    groups = components(ties)
    forget(*used)
    sizes = stored(groups.groupBy("root").agg(F.count("*").alias("m")), "group-sizes")
    members = stored(groups.join(sizes, "root").join(nodes.select("node", "fold", "first_id", "copies"), "node"), "groups")
    # A node's text is that of its first document; the pair of id and hash is dealt evenly, whatever is copied.
    # Always a merge join: the groups grow with the corpus, so texts are dealt alike at every size.
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    texts = rows.withColumn("key", key).join(members.withColumn("key", F.coalesce("first_id", F.lit(-(1 << 63)))).drop("first_id").hint("merge"), ["key", "fold"]).dropDuplicates(["node"]).select("root", "m", "node", "copies", "text")
    checked = stored(dealt(_blocks(texts, "root", BLOCK).select("bucket", "i", "j", "node", "side", "copies", "text")).mapInArrow(_verify(threshold), "node long, links long, root long"), "links")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    forget(sizes, members)
    classes = components(checked.select(F.col("node").alias("u"), F.col("root").alias("v")))
    return nodes.select("node", "fold", "first_id", "copies", F.col("signs").isNotNull().alias("has_words")).join(links, "node", "left").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))


def similar_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links) of every row."""
    rows = _folded(docs, doc_id, text)
    per_node = _node_classes(rows, threshold, recall)
    least_id = per_node.groupBy("root").agg(F.min("first_id").alias("class_id"))
    per_node = per_node.join(least_id, "root").select("fold", "has_words", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return rows.select("doc_id", "fold").join(per_node, "fold").select("doc_id", F.when(F.col("has_words"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(F.col("has_words"), F.col("n_links")).otherwise(F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row of each class, with the documents' own columns: the row with the least id (nulls last, then the least fold hash). Rows are
    told apart by id and text together, so null or repeated ids tie nothing; each row without words is a class of its own."""
    nodes = _node_classes(_folded(docs, doc_id, text), threshold, recall).where("has_words")
    chosen = nodes.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("no_id"), "first_id", "fold")).alias("c"))
    key = lambda c: F.coalesce(c, F.lit(-(1 << 63)))
    chosen = chosen.select(key(F.col("c.first_id")).alias("_key"), F.col("c.no_id").alias("_no_id"), F.col("c.fold").alias("_fold"))
    worded = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    own = F.col(doc_id).cast("long")
    keyed = docs.where(worded).withColumns({"_key": key(own), "_no_id": own.isNull(), "_fold": F.unhex(F.md5(F.col(text)))})
    # Rows of a chosen text and id are dealt by both, so that copies with other ids never meet; repeated rows leave one.
    kept = keyed.join(chosen, ["_key", "_no_id", "_fold"], "left_semi").dropDuplicates(["_key", "_no_id", "_fold"])
    return kept.select(*docs.columns).unionByName(docs.where(~worded))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the class of texts that links of similarity 0.8 or more tie together, and its number of links."""
    return similar_classes(table(spark, sf_dir, "documents"))


SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, least(d.doc_id, coalesce(m.low, d.doc_id)) AS class_id, coalesce(k.n_links, 0) AS n_links FROM d
LEFT JOIN (SELECT a, min(b) AS low FROM r GROUP BY a) m ON m.a = d.doc_id LEFT JOIN (SELECT a, count(*) AS n_links FROM l GROUP BY a) k ON k.a = d.doc_id"""
