"""Secret scan over the history of a store of texts, with a ledger of scanned blobs.

Every version of every path is addressed by the SHA-256 of its text (its blob). A blob is scanned
once per version of the rules: pairs that the ledger holds are skipped, the others are scanned and
appended. Findings are then joined back to all paths that hold the blob. The hashes alone are compared with the ledger, so a
text that was scanned before does not move. The ledger is partitioned by the version of the rules; a blob that
two runs at once (or a retried one) have appended twice counts once.

Defined results: a null text counts as empty and has no findings; rows repeat as often as they
came (each with the same findings); null or repeated path values are carried through; an empty
table gives an empty result; only the named columns are read, so clashing extra columns are of no
account. Spans count code points, ends are exclusive, and no text is cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, scratch, stored, table

SPANS = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob binary, rules string, spans {SPANS}"

# Kind, a literal that any match must hold (lower case; empty: none), pattern, the group
# whose length counts, and the least length. The first three are the base kinds, in the order of the digest.
RULES = [
    ("assign", (":", "="), r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
    ("access", ("AKIA",), r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", (), r"[0-9a-f]{24,}", 0, 24),  # a run is taken whole, so the bound drops what a later test would
    ("pem", ("-----BEGIN",), r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0),
    ("hub", ("gh",), r"gh[oprsu]_[A-Za-z0-9]{36,}", 0, 0),
    ("jwt", ("eyJ",), r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("login", ("://",), r"[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D/:@]{1,100}:[^\x20\x09-\x0D/:@]{3,100}@", 0, 0),
]
BASE = ("assign", "access", "hex")


#: Unseen blobs (of 32 bytes) up to which their hashes are broadcast.
FEW = 100_000


def rules_version(rules: list[tuple] = RULES) -> str:
    """Begins with a letter, so that it stays a text as a partition's name."""
    return "v" + hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def find_secrets(text: str | None, rules: list[tuple] = RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each finding, by start, then by the order of the kinds."""
    found = []
    for order, (kind, needles, pattern, group, least) in enumerate(rules):
        if text and (not needles or any(n in text for n in needles)):
            for m in re.finditer(pattern, text):
                if m.end(group) - m.start(group) >= least:
                    found.append((m.start(), order, m.end(), kind))
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def _scan(rules: list[tuple]):
    out = pa.schema([("blob", pa.binary()), ("rules", pa.string()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])
    version = rules_version(rules)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t.as_py(), rules)] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("blob").cast(pa.binary()), pa.array([version] * len(spans), pa.string()), pa.array(spans, out.field("spans").type)], schema=out)

    return scan


def addressed(history: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """path, text and blob of every version; text is never null."""
    rows = history.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.withColumn("blob", F.unhex(F.sha2("text", 256)))


def scan_history(spark: SparkSession, history: DataFrame, ledger: str, path: str = "doc_id", text: str = "text", rules: list[tuple] = RULES) -> DataFrame:
    """Scans what the ledger has not seen, appends it there, and gives (path, spans) for every version.

    ledger is a path in a store that all executors share; it is made if it isn't there.
    """
    spark.createDataFrame([], LEDGER).write.mode("append").partitionBy("rules").parquet(ledger)
    version = rules_version(rules)
    versions = addressed(history, path, text)
    known = lambda: spark.read.schema(LEDGER).parquet(ledger).where(F.col("rules") == version)
    unseen = stored(versions.select("blob").distinct().join(known().select("blob"), "blob", "left_anti"), "unseen")
    # Copies fold before the shuffle (a task sends a blob once).
    if unseen.count() <= FEW:
        new = versions.join(F.broadcast(unseen), "blob", "left_semi").groupBy("blob").agg(F.first("text").alias("text"))
    else:
        new = versions.groupBy("blob").agg(F.first("text").alias("text")).join(unseen, "blob", "left_semi")
    new.mapInArrow(_scan(rules), LEDGER).write.mode("append").partitionBy("rules").parquet(ledger)
    forget(unseen)
    # Written, so that the join back stands between plain exchanges and a blob of very many paths can be split.
    findings = stored(known().select("blob", "spans").dropDuplicates(["blob"]), "findings")
    return versions.select("path", "blob").join(findings, "blob").select("path", "spans")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with counts and a digest of the base findings and all spans."""
    found = scan_history(spark, table(spark, sf_dir, "documents"), scratch(spark, "secret-ledger"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("path").alias("doc_id"),
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def _letters(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _sql() -> str:
    """Positions from the gaps between matches: a match starts where the gaps and matches before it end."""
    plain = {kind: pattern for kind, _, pattern, _, _ in RULES}
    keys = "|".join(_letters(k) for k in ("password", "passwd", "secret", "token")) + "|" + _letters("api") + "_?" + _letters("key")
    plain["assign"] = rf"""(?:{keys})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
    least = {"access": "length(m) >= 20"}
    head = rf"""^(?:{keys})["']?\x20*[:=]\x20*["']?"""
    least["assign"] = f"length(regexp_replace(m, '{head.replace(chr(39), chr(39) * 2)}', '')) >= 6"
    parts, quoted = [], lambda p: p.replace("'", "''")
    for order, (kind, *_rest) in enumerate(RULES):
        p = quoted(plain[kind])
        parts.append(
            f"SELECT doc_id, '{kind}' AS kind, {order} AS ord, s, s + length(m) AS e FROM (SELECT doc_id, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0))) AS s "
            f"FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{p}') AS ms, string_split_regex(coalesce(text, ''), '{p}') AS gs FROM documents)) WHERE {least.get(kind, 'true')}"
        )
    return f"""WITH found AS ({" UNION ALL ".join(parts)}),
per AS (SELECT doc_id, sum((kind = 'assign')::int)::bigint AS n_assign, sum((kind = 'access')::int)::bigint AS n_access, sum((kind = 'hex')::int)::bigint AS n_hex,
 string_agg(CASE WHEN ord < 3 THEN concat(kind, ':', s::bigint, ':', e::bigint) END, ',' ORDER BY s, ord) AS base, string_agg(concat(kind, ':', s::bigint, ':', e::bigint), ',' ORDER BY s, ord) AS spans FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per USING (doc_id)"""


SQL = _sql()
