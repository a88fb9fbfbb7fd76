"""Text logs: line numbers across files and splits."""

from fieldrecon.sources import documents, files


def test_line_numbers_run_through_splits_and_files(spark, tmp_path):
    expected = []
    for name, n in (("b.log", 3000), ("a.log", 5000), ("c.log", 0), ("d.log", 1)):
        lines = ["" if k % 50 == 0 else f"{name} {k} " + "x" * (k % 40) for k in range(n)]
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))
        expected.append((name, lines))
    expected = [x for _, lines in sorted(expected) for x in lines]
    for name, value in (("spark.sql.files.maxPartitionBytes", "7000"), ("spark.sql.files.openCostInBytes", "0")):
        spark.conf.set(name, value)
    try:
        log = files.read_log(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        assert sorted(map(tuple, log.collect())) == [(k + 1, x) for k, x in enumerate(expected)]
    finally:
        for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(name)
    assert files.read_log(spark, str(tmp_path / "none")).count() == 0


def test_sidecars_of_odd_folders_and_of_none(spark, tmp_path):
    rows = [("BTP JAK", "A/B", "W 1%2 =x", "Senin, Jan 16 1999"), ("BTP BD", "007", "1e3", "Rabu")]
    made = spark.createDataFrame(rows, "region string, category string, identifier string, date_text string")
    keys = ["region", "category", "identifier"]
    files.write_sidecars(made, keys, str(tmp_path / "tree"))
    assert sorted(map(tuple, files.sidecar_texts(spark, str(tmp_path / "tree"), keys).collect())) == sorted(rows)
    assert files.sidecar_texts(spark, str(tmp_path / "none"), keys).count() == 0


def test_nested_documents_by_file_and_by_line(spark, tmp_path):
    doc = '{"_metadata": {"n": %d}, "WESEL": {"W%d": {"asset_id": %d}, "_note": {}}}'
    (tmp_path / "one.json").write_text(doc.replace(", ", ",\n") % (1, 1, 1))
    (tmp_path / "many.jsonl").write_text("".join(doc % (k, k, k) + "\n" for k in range(50)))
    load = lambda name, **how: documents.load_nested(spark, str(tmp_path / name), about={"n": "long"}, **how).select("n", "detail", "asset_id")
    assert [tuple(r) for r in load("one.json").collect()] == [(1, "W1", 1)]
    assert sorted(map(tuple, load("many.jsonl", per_line=True).collect())) == [(k, f"W{k}", k) for k in range(50)]
    assert load("none.json").count() == 0
