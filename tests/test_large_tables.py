"""Queries over tables whose keys and groups are those of much larger data."""

import datetime as dt
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from fieldrecon.operators import layout, ordering
from fieldrecon.plans import joins, schedule
from fieldrecon.session import scratch_folder
from fieldrecon.sources import files


@pytest.fixture(scope="module")
def far_keys(sf, tmp_path_factory):
    """The smallest tables with order keys as high as in tables six thousand times as long."""
    folder = str(tmp_path_factory.mktemp("far"))
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        rows = f"SELECT * REPLACE ({key} + 9000000 AS {key}) FROM '{sf}/{name}.parquet'"
        duckdb.sql(f"COPY ({rows}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    for name in os.listdir(sf):
        if not os.path.exists(f"{folder}/{name}"):
            os.symlink(f"{sf}/{name}", f"{folder}/{name}")
    return folder


def test_plan_documents_of_entries_with_millions_of_minutes(spark, far_keys):
    expected = []
    for r in schedule.plan_items(spark, far_keys).collect():
        for mark in (0, 50, 100):
            at = dt.datetime.combine(r["plan_date"], dt.time(7)) + dt.timedelta(minutes=round(mark * r["minutes"] / 100))
            expected.append((r["region"], r["path"], r["identifier"], mark, at.strftime("%Y-%m-%dT%H:%M:%S")))
    assert max(x[4] for x in expected) > "2100"
    got = entry.queries()["s4_plan_nested_io"](spark, far_keys).select("region", "path", "identifier", "milestone", "at")
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_sidecars_need_far_fewer_files_than_sets(spark, sf):
    made = lambda: set(glob.glob(scratch_folder(spark).removeprefix("file:") + "/sidecars-*"))
    before = made()
    rows = entry.queries()["s6_sidecar_text_join"](spark, sf)
    sets = rows.filter("note is not null").select("region", "category", "identifier").distinct().count()
    (folder,) = made() - before
    assert len(glob.glob(f"{folder}/**/part-*", recursive=True)) < sets / 2


def test_packed_sidecars_keep_odd_keys_and_texts(spark, tmp_path):
    rows = [("BTP JAK", "A/B", "", "Rabu"), ("BTP JAK", "A/B", "W 1%2 =x", "a\n\"b\""), ("BTP BD", "007", "1e3", "Senin, Jan 16 1999")]
    made = spark.createDataFrame(rows, "region string, category string, identifier string, date_text string")
    files.write_sidecar_packs(made, ["region", "category"], str(tmp_path / "packs"))
    read = lambda name: files.packed_sidecars(spark, str(tmp_path / name), ["region", "category"], ["identifier"])
    assert sorted(map(tuple, read("packs").collect())) == sorted(rows)
    assert read("none").count() == 0


def test_ranges_follow_the_rows_not_the_session(spark, monkeypatch):
    frame = spark.range(20_000).selectExpr("id % 2 AS g", "cast(id / 7 AS double) AS x")
    dealt = ordering.deal(frame, ["g", "x"], size=500)
    sizes = [r["count"] for r in dealt.groupBy("_part").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 2000
    monkeypatch.setattr(ordering.deal, "__defaults__", (500,))
    monkeypatch.setattr(ordering.gather, "__defaults__", (500,))
    tops = [k * 15 if k % 4 else k * 15 - 14 for k in range(8000)]
    images = spark.createDataFrame([(1, float(t)) for t in tops], "page int, top double")
    got = [(r["row_no"], r["row_top"], r["row_size"]) for r in layout.page_rows(images, ["page"], least=2).orderBy("row_no").collect()]
    # every fourth coordinate stands right behind the one before it
    assert got == [(i, float(k * 15 - 15), 2) for i, k in enumerate(range(4, 8000, 4), 1)]


def test_only_borders_are_joined_to_ranges(spark):
    """No join of all groups of a table: a group of few rows has nothing to carry."""
    frame = spark.range(5000).selectExpr("id AS g", "cast(id AS double) AS x")
    rows = ordering.previous(ordering.deal(frame, ["g", "x"]), ["g"], ["x"], "x", "before")
    assert "SortMergeJoin" not in rows._jdf.queryExecution().sparkPlan().toString()
    assert rows.filter("before is not null").count() == 0


def test_only_reports_with_unnamed_rows_have_their_lines_numbered(spark, sf, monkeypatch):
    asked, number = [], joins.line_ordinals
    monkeypatch.setattr(joins, "line_ordinals", lambda spark, sf, reports: (asked.append(reports.count()), number(spark, sf, reports))[1])
    rows = entry.queries()["j11_positional_fallback"](spark, sf)
    assert asked == [rows.filter("source <> 'above'").select("report_id").distinct().count()]
    assert 0 < asked[0] < rows.select("report_id").distinct().count()


def test_images_of_full_pages_are_not_sorted(spark, sf):
    plan = entry.queries()["j17_semi_photo_pages"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_texts_of_lines_are_not_fused_into_one_method(spark, sf, monkeypatch):
    """The JVM does not compile the method that a fused stage makes of them."""
    seen = []
    monkeypatch.setattr(schedule.planning, "expand_assets", lambda reports, lines: seen.append(lines) or lines.selectExpr("*", "'' category", "'' path", "line identifier"))
    schedule.planned_assets(spark, sf)
    plan = seen[0].select("report_id", "line_no", "line")._jdf.queryExecution().executedPlan().toString()
    made = [row for row in plan.splitlines() if "PENGGERAK" in row]
    assert made and not any("*(" in row for row in made)
    plain = schedule.view(spark, sf, "b_asset_line")
    assert seen[0].schema.names == plain.schema.names and seen[0].exceptAll(plain).count() == 0 == plain.exceptAll(seen[0]).count()
