from mrloom.streaming import headers


def test_each_header_is_coded_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put = lambda name, b: (folder / name).write_text(f'{{"00189087": {{"vr": "FD", "Value": [{b}]}}}}')
    put("a.json", 1000)
    (folder / "bad.json").write_text("no header")
    run = lambda: headers.write_available(headers.coded(headers.watch(spark, str(folder))), str(tmp_path / "out"), str(tmp_path / "state"))
    run()
    put("b.json", 0)
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["file_name"][-6:], r["b_value"], r["has_b0"], r["has_pos_b0"]) for r in rows) == [("a.json", 1000.0, 0, 1), ("b.json", 0.0, 1, 0)]
