"""The SQL of the corpus operators at the smallest size, and op4's contract over the whole table."""

import os
import zlib
from collections import Counter

import duckdb
import pytest
from mrloom.llm import registry

DATA = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for table in os.listdir(DATA):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS FROM '{DATA}/{table}'")
    frame = registry.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = Counter(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())
    assert Counter(tuple(r[c] for c in columns) for r in frame.collect()) == want


def test_reshard_contract(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = registry.queries()["op4_reshard"](spark, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        text = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 8, zlib.crc32(text), "bytes", None)
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(24)]
    assert max(sizes) - min(sizes) <= max(r["size"] for r in rows)
    for s in range(24):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
