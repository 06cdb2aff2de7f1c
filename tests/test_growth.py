"""What a query moves and reads: these hold for tables of any size."""

import re

from mrloom.operators import training
from mrloom.plans import base, fixtures, headers
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_files_move_as_columns_of_the_tables(spark):
    # One exchange of files for the join and one by series: neither the rank nor the split moves what is made of them.
    text = plan(base.split(spark, DATA))
    made = text[: text.index("REPARTITION_BY_COL")]
    assert "Exchange" not in made.replace("Exchange hashpartitioning(study_key", "") and text.count("REPARTITION_BY_COL") == 1
    assert "dense_rank(o_orderkey" in text and "l_quantity" not in "".join(re.findall(r"Window \[dense_rank.*", text))


def test_a_number_is_that_of_the_orders_with_files(spark):
    orders, lineitem = spark.createDataFrame([(5, 1), (6, 1), (7, 1), (8, 2)], "o_orderkey long, o_custkey long"), spark.createDataFrame([(5,), (7,), (7,), (8,)], "l_orderkey long")
    assert sorted(tuple(r) for r in fixtures._numbered(orders, lineitem).select("o_orderkey", "series_number").collect()) == [(5, 1), (7, 2), (8, 1)]


def test_packed_headers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(headers, "scratch", lambda *_: f"{tmp_path}/headers")
    assert headers.a1_files(spark, DATA).count() == fixtures.inst(spark, DATA, numbered=False).count()
    assert list(tmp_path.glob("headers/*.txt.gz")) and not list(tmp_path.glob("headers/*.txt"))


def test_headers_bring_their_study_along(spark):
    # No join by file name, which would move the texts: the only one is that of the tables, and that of their orders.
    assert plan(headers.b7(spark, DATA)).count("Join") == 2


def test_more_than_a_thousand_rows_of_a_class(spark):
    rows = spark.range(9000).selectExpr("IF(id % 3 = 0, 'a', 'b') AS label", "lpad(id, 5, '0') AS k", "id AS wide").unionByName(spark.createDataFrame([("c", "x", 1), ("c", "x", 2)], "label string, k string, wide long"))
    text = plan(training.balanced(rows, "label", "k", 2500))
    assert text.index("BroadcastHashJoin") < text.index("Range")  # rows that are not taken go before the window's exchange
    got = training.balanced(rows, "label", "k", 2500).groupBy("label").agg(F.count("*"), F.max("k"), F.max("copy"), F.count_distinct("wide")).collect()
    assert sorted(tuple(r) for r in got) == [("a", 2500, "07497", 0, 2500), ("b", 2500, "03749", 0, 2500), ("c", 2500, "x", 1249, 2)]
    assert text.index("BroadcastHashJoin") > text.index("Exchange hashpartitioning(label")


def test_a_fit_reads_its_table_once(spark):
    seen = spark.sparkContext.accumulator(0)
    note = F.udf(lambda x: seen.add(1) or float(x), "double")
    training.train_forest(spark.range(40).select((F.col("id") % 2).alias("code"), note(F.col("id")).alias("x")), ["x"], trees=2, depth=2)
    assert seen.value == 40


def test_session_texts_do_not_move(spark):
    # The volumes move by study as columns; no exchange stands above the aggregate of the texts, nor above the join.
    text = plan(headers.a5(spark, DATA))
    above = text[: text.index("REPARTITION_BY_COL")]
    assert "collect_list(struct(k" in above.replace("named_struct", "struct") and above.count("Exchange hashpartitioning(study_key") == 1, text
