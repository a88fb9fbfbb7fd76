"""Values carried over ranges of a large group, and lines folded chain by chain, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from fieldrecon.operators import consensus, layout, ordering


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Ranges of small tables aren't merged, so groups cross their borders."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_previous_and_total_cross_borders(spark):
    rng = random.Random(1)
    rows = [("ab"[rng.random() < 0.1], v / 7, rng.randint(-5, 5)) for v in rng.sample(range(10_000), 3000)]
    dealt = ordering.deal(spark.createDataFrame(rows, "g string, x double, n int").repartition(6), ["g", "x"])
    assert dealt.select("_part").distinct().count() > 1
    out = ordering.running_total(ordering.previous(dealt, ["g"], ["x"], "x", "before"), ["g"], ["x"], "n", "total")
    got = {(r["g"], r["x"]): (r["before"], r["total"]) for r in out.collect()}
    for g in "ab":
        before, total = None, 0
        for _, x, n in sorted(r for r in rows if r[0] == g):
            total += n
            assert got[g, x] == (before, total)
            before = x


def lines(words):
    """(line_top, n_lines, n_words) of one group, word by word."""
    found = []
    for _, top, height, left in sorted(words):
        cy = top + height / 2
        if not any(abs(f[0] - cy) < 10 for f in found):
            found.append((cy, top, left))
    left = [f[1] for f in found if f[2] < 30]
    return min(left or [f[1] for f in found]), len(found), len(words)


def test_leader_lines_on_one_hot_group_with_unrounded_positions(spark):
    rng = random.Random(2)
    rows = []
    for g, n in ((1, 4000), (2, 300), (3, 1), (4, 60)):
        for k in range(n):  # group 4 lies in one place only
            top = 5.25 if g == 4 else rng.choice([0, 2000]) + rng.random() * (900 if g == 1 else 400)
            rows.append((g, rng.random(), top, rng.randint(1, 9), rng.randint(0 if g != 2 else 30, 60)))
    frame = spark.createDataFrame(rows, "g int, pos double, top double, height int, left_x int").repartition(5)
    got = {r["g"]: (r["line_top"], r["n_lines"], r["n_words"]) for r in consensus.leader_lines(frame, ["g"], "pos").collect()}
    assert got == {g: lines([r[1:] for r in rows if r[0] == g]) for g in (1, 2, 3, 4)}
    assert consensus.leader_lines(frame.filter(F.lit(False)), ["g"], "pos").count() == 0


def test_following_and_carried_down_cross_borders(spark):
    rng = random.Random(2)
    rows = [("ab"[rng.random() < 0.1], v / 7, "m" + str(v) if rng.random() < 0.01 else None) for v in rng.sample(range(10_000), 3000)]
    dealt = ordering.deal(spark.createDataFrame(rows, "g string, x double, m string").repartition(6), ["g", "x"])
    out = ordering.carried_down(ordering.following(dealt, ["g"], ["x"], "x", "after"), ["g"], ["x"], "m", "mark")
    got = {(r["g"], r["x"]): (r["after"], r["mark"]) for r in out.collect()}
    for g in "ab":
        own = sorted((x, m) for h, x, m in rows if h == g)
        mark = None
        for (x, m), after in zip(own, [x for x, _ in own[1:]] + [None]):
            mark = m or mark
            assert got[g, x] == (after, mark)


def test_one_page_is_dealt_to_many_tasks(spark):
    """Rows, labels above and bands of one page against loops, coordinates not rounded, ranges smaller than the page."""
    rng = random.Random(3)
    tops = sorted({rng.randint(0, 40) * 40 + rng.random() * 20 for _ in range(2000)})
    marks = sorted(rng.random() * 1700 for _ in range(300))
    images = spark.createDataFrame([(1, t) for t in tops] + [(2, 5.0)], "page int, top double").repartition(4)
    labels = spark.createDataFrame([(1, t, f"c{t}") for t in marks], "page int, top double, label string").repartition(4)

    rows, before = [], None
    for t in tops:
        if before is None or t - before >= 15:
            rows.append([t, 0])
        rows[-1][1] += 1
        before = t
    got = layout.page_rows(images, ["page"]).orderBy("row_no").collect()
    assert [(r["row_no"], r["row_top"], r["row_size"]) for r in got] == [(i, t, n) for i, (t, n) in enumerate((r for r in rows if r[1] >= 3), 1)]

    above = {r["top"]: r["label"] for r in layout.nearest_above(images, labels, ["page"], ["label"]).collect()}
    assert above == {t: f"c{max(m for m in marks if m < t)}" for t in tops if t > marks[0]}

    bands = {r["top"]: r["band_end"] for r in layout.row_bands(labels, ["page"], height=2000).collect()}
    assert bands == {t: after - 2 for t, after in zip(marks, marks[1:] + [2000])}
