"""Resharding by minimum-cost flow: from old shard sizes and new capacities to the cheapest moves.

The sizes of the old shards are summed on the cluster. On the driver, a minimum-cost flow over a graph
of old and new shards (its size depends on the number of shards alone) finds how many bytes go from
each old shard to each new one so that every capacity is met and the fewest bytes move; bytes that
stay cost nothing. Each old shard is then seen as one long run of rows (long texts first, so that cuts fall among
short ones), the flows cut this run into blocks, and the shards that lose or gain rows are
rewritten. The place of a row in the run comes from sums over buckets of rows and a running sum
inside its bucket, so that no task ever holds a shard. Buckets take about as many rows each (BUCKETS of them, or more of
BUCKET_ROWS rows) and are stretches of the run, so a task writes files for the few shards that its buckets lie in.

Defined results: a null text has no bytes; every row weighs 8 bytes more than its text; null or
repeated ids and equal rows are placed like any others; a null old shard is a shard of its own; an
empty table gives an empty result. Columns of the input beside those named are carried along; working
columns have names of their own (_r_...), and input columns called size, old_shard, shard or slot
give way to the result's.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, stored, table

#: Buckets that all rows make at least, and most and fewest rows of a bucket, about; a bucket is the unit of the running sums.
BUCKETS, BUCKET_ROWS, LEAST_ROWS = 2000, 50_000, 500
N_SHARDS = 24


def cheapest_moves(sizes: list[int], homes: list[int | None], capacities: list[int]) -> list[tuple[int, int, int]]:
    """(old, new, bytes) of a minimum-cost flow by successive shortest paths.

    sizes: of the old shards; homes: the new shard that each old one may stay in for nothing (None: it has
    none); capacities: of the new shards, at least sum(sizes) together. A byte that moves costs 1.
    """
    n, m = len(sizes), len(capacities)
    source, sink = n + m, n + m + 1
    edges: list[list[int]] = []  # from, to, what is left, cost; the reverse edge has the index xor 1
    at: list[list[int]] = [[] for _ in range(n + m + 2)]

    def edge(a: int, b: int, room: int, cost: int) -> None:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            at[x].append(len(edges))
            edges.append([x, y, r, c])

    for i, size in enumerate(sizes):
        edge(source, i, size, 0)
        for j in range(m):
            edge(i, n + j, size, 0 if homes[i] == j else 1)
    for j, room in enumerate(capacities):
        edge(n + j, sink, room, 0)
    while True:
        cost: dict[int, int] = {source: 0}
        by: dict[int, int] = {}
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for k in at[x]:
                _, y, room, c = edges[k]
                if room and cost[x] + c < cost.get(y, 1 << 60):
                    cost[y], by[y] = cost[x] + c, k
                    queue.append(y)
        if sink not in by:
            break
        path, x = [], sink
        while x != source:
            path.append(by[x])
            x = edges[by[x]][0]
        amount = min(edges[k][2] for k in path)
        for k in path:
            edges[k][2] -= amount
            edges[k ^ 1][2] += amount
    return [(e[0], e[1] - n, edges[k + 1][2]) for k, e in enumerate(edges) if k % 2 == 0 and e[0] < n and edges[k + 1][2]]


def even_capacities(total: int, n_shards: int) -> list[int]:
    return [total // n_shards + (j < total % n_shards) for j in range(n_shards)]


def reshard(docs: DataFrame, old_shard: Column, n_shards: int, path: str, doc_id: str = "doc_id", text: str = "text", capacities: list[int] | None = None, bucket_rows: int | None = None) -> DataFrame:
    """Rewrites the affected shards under path (folders _r_shard=0, 1, ...) and gives all rows with shard and slot.

    old_shard: an integer column; old shard j stays in new shard j as far as that has room.
    capacities: bytes that each new shard takes, sum at least that of all rows; default: even shares.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c.lower() not in ("size", "old_shard", "shard", "slot")]
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + 8
    sized = docs.select(
        "*",
        size.alias("_r_size"),
        F.coalesce(old_shard.cast("int"), F.lit(-1)).alias("_r_old"),
        (-F.floor(F.log2(size.cast("double"))).cast("int")).alias("_r_class"),
    )
    run, bucket = ["_r_old", "_r_class"], ["_r_old", "_r_class", "_r_bucket"]
    classes = [r.asDict() for r in sized.groupBy(*run).agg(F.sum("_r_size").alias("_r_bytes"), F.count("*").alias("_r_rows")).collect()]  # for each old shard at most a row for each power of two
    total = sum(r["_r_rows"] for r in classes)
    per = bucket_rows or min(BUCKET_ROWS, max(LEAST_ROWS, total // BUCKETS))
    old: dict[int, int] = {}
    before: dict[int, list[int]] = {}
    laid = []
    for r in sorted(classes, key=lambda r: (r["_r_old"], r["_r_class"])):
        b, n = before.setdefault(r["_r_old"], [0, 0])
        laid.append((r["_r_old"], r["_r_class"], 1 + r["_r_rows"] // per, b, n))
        before[r["_r_old"]] = [b + r["_r_bytes"], n + r["_r_rows"]]
        old[r["_r_old"]] = b + r["_r_bytes"]
    laid = F.broadcast(spark.createDataFrame(laid, "_r_old int, _r_class int, _r_n long, _r_bytes0 long, _r_rows0 long"))  # as few
    sized = sized.join(laid.select(*run, "_r_n"), run).withColumn("_r_bucket", F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.col("_r_n"))).drop("_r_n")
    sums = stored(sized.groupBy(*bucket).agg(F.sum("_r_size").alias("_r_bytes"), F.count("*").alias("_r_rows")), "bucket-sums")
    names = sorted(old)
    room = capacities or even_capacities(sum(old.values()), n_shards)
    moves = cheapest_moves([old[k] for k in names], [k if 0 <= k < n_shards else None for k in names], room)
    cuts, touched = [], {names[i] for i, j, _ in moves if names[i] != j} | {j for i, j, _ in moves if names[i] != j}
    for i, k in enumerate(names):
        low = 0
        for _, j, amount in sorted((m for m in moves if m[0] == i), key=lambda m: (m[1] != k, m[1])):
            cuts.append((k, low, low + amount, j))
            low += amount
        if cuts:
            cuts[-1] = (*cuts[-1][:2], None, cuts[-1][3])  # the last block of an old shard is open
    blocks = spark.createDataFrame(cuts, "_r_k int, _r_low long, _r_high long, _r_shard int")

    ahead = Window.partitionBy(*run).orderBy("_r_bucket").rowsBetween(Window.unboundedPreceding, -1)
    since = lambda c: F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c)
    starts = sums.select(*bucket, since("_r_bytes"), since("_r_rows")).join(laid, run).select(*bucket, (F.col("_r_bytes0") + F.col("_r_bytes")).alias("_r_bytes"), (F.col("_r_rows0") + F.col("_r_rows")).alias("_r_rows"))
    inside = Window.partitionBy(*bucket).orderBy(F.col(doc_id), F.col("_r_size"), F.crc32(F.coalesce(F.col(text), F.lit("")))).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        sized.withColumns({"_r_sum": F.sum("_r_size").over(inside), "_r_n": F.row_number().over(inside)})
        .join(starts, bucket)
        .withColumns({"_r_middle": F.col("_r_bytes") + F.col("_r_sum") - F.floor(F.col("_r_size") / 2), "_r_place": F.col("_r_rows") + F.col("_r_n")})
        .join(F.broadcast(blocks), (F.col("_r_old") == F.col("_r_k")) & (F.col("_r_middle") >= F.col("_r_low")) & ((F.col("_r_middle") < F.col("_r_high")) | F.col("_r_high").isNull()))  # at most as many rows as old and new shards
        .select(*columns, "_r_size", "_r_old", "_r_place", "_r_shard")
    )
    affected = F.col("_r_old").isin(*touched) | F.col("_r_shard").isin(*touched) if touched else F.lit(False)
    placed.where(affected).write.partitionBy("_r_shard").parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path)
    if set(names) - touched:
        rows = rows.unionByName(placed.where(~affected))
    first = rows.groupBy("_r_shard", "_r_old").agg(F.min("_r_place").alias("_r_first"), F.count("*").alias("_r_rows"))
    base = first.select(F.col("_r_shard").alias("_r_s"), F.col("_r_old").alias("_r_o"), (F.coalesce(F.sum("_r_rows").over(Window.partitionBy("_r_shard").orderBy("_r_old").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_r_first")).alias("_r_shift"))
    base = spark.createDataFrame(base.collect(), base.schema)  # at most as many rows as blocks
    return rows.join(F.broadcast(base), (F.col("_r_shard") == F.col("_r_s")) & (F.col("_r_old") == F.col("_r_o"))).select(
        *columns, F.col("_r_size").alias("size"), F.col("_r_old").alias("old_shard"), F.col("_r_shard").alias("shard"), (F.col("_r_place") + F.col("_r_shift")).alias("slot")
    )


def by_source(docs: DataFrame, n_shards: int = N_SHARDS) -> Column:
    """The old shard of a row: the layout in which each source has a shard."""
    return F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit(""))), F.lit(n_shards)).cast("int")


def op4_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, moved from a shard per source to 24 shards of near equal bytes; read back from the new files."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return reshard(docs, by_source(docs), N_SHARDS, scratch(spark, "shards")).select(
        "doc_id",
        "size",
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
