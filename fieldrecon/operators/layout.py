"""Page layout: lines, rows, captions and bands from coordinates.

Rows with the same coordinate get the same answer, so every operator reduces a
page to its DISTINCT coordinates first (a partial aggregate), works on those
and joins the answer back.  Coordinates are not rounded, so one page may hold a
third of all of them: they are dealt to tasks in ranges of (page, coordinate),
and what a range needs of its neighbours is carried over the border
(`ordering.previous`, `following`, `carried_down`, `running_total`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldrecon import vocab
from fieldrecon.functions.text import ASSET_CODE, normalize_spaces
from fieldrecon.operators import ordering
from fieldrecon.session import cut_lineage

C = F.col


def words_to_lines(words: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Words of equal rounded top, left to right: line text, code and title.

    The collected array is the line that is put out; it is as long as the line.
    """
    line = F.array_sort(F.collect_list(F.struct("x0", *order, "text")))
    lines = words.groupBy(*keys, F.bround(C("top"), 1).alias("top")).agg(line.alias("w"))
    texts = F.transform("w", lambda s: s["text"])
    at = F.array_position(F.transform(texts, lambda t: t.rlike(ASSET_CODE)), True).cast("int")
    lines = lines.select(*keys, "top", texts.alias("t"), at.alias("at"))
    title = F.array_join(F.slice("t", C("at") + 1, F.size("t")), " ")
    return lines.select(
        *keys, "top", F.array_join("t", " ").alias("line"),
        F.when(C("at") > 0, F.get("t", C("at") - 1)).alias("code"),
        F.when(C("at") > 0, F.ltrim(normalize_spaces(title), F.lit(": -"))).alias("title"),
    )


def _clustered(images: DataFrame, page: list[str], gap: int) -> DataFrame:
    """_part, page, top, n, cluster: a new cluster starts where the step from the coordinate before is >= gap."""
    tops = ordering.deal(images.groupBy(*page, "top").agg(F.count("*").alias("n")), [*page, "top"])
    steps = ordering.previous(tops, page, ["top"], "top", "_before")
    steps = steps.withColumn("break", F.when(C("top") - C("_before") >= gap, 1).otherwise(0))
    return ordering.running_total(steps, page, ["top"], "break", "cluster").select("_part", *page, "top", "n", "cluster")


def _rows_of(clustered: DataFrame, page: list[str], least: int) -> DataFrame:
    """page, cluster, row_no, row_top, row_size: clusters of at least `least` images, numbered in order.

    A cluster belongs to the range it starts in, so clusters stay dealt in ranges of their order.
    """
    # summed within ranges first: few clusters lie in two
    pieces = clustered.groupBy("_part", *page, "cluster").agg(F.sum("n").alias("n"), F.min("top").alias("top"))
    rows = pieces.groupBy(*page, "cluster").agg(
        F.sum("n").alias("row_size"), F.min("top").alias("row_top"), F.min("_part").alias("_part")
    )
    rows = cut_lineage(rows.filter(C("row_size") >= least).withColumn("_one", F.lit(1)))
    return ordering.running_total(rows, page, ["cluster"], "_one", "row_no").drop("_one", "_part")


def row_clusters(images: DataFrame, page: list[str], gap: int = vocab.ROW_GAP, least: int = 3) -> DataFrame:
    """page, top, row_no, row_top, row_size: which row each coordinate belongs to.

    A new row starts where the step from the previous coordinate is >= gap;
    rows of fewer than `least` images are dropped, the rest keep their order.
    """
    tops = cut_lineage(_clustered(images, page, gap))  # read twice below
    rows = _rows_of(tops, page, least)
    return tops.drop("_part").join(rows, [*page, "cluster"]).select(*page, "top", "row_no", "row_top", "row_size")


def page_rows(images: DataFrame, page: list[str], gap: int = vocab.ROW_GAP, least: int = 3) -> DataFrame:
    """page, row_no, row_top, row_size: the rows of `row_clusters`, once each."""
    return _rows_of(_clustered(images, page, gap), page, least).select(*page, "row_no", "row_top", "row_size")


def nearest_above(points: DataFrame, labels: DataFrame, page: list[str], order: list[str], strict: bool = True) -> DataFrame:
    """page, top -> label with the greatest top above it on the same page.

    As-of join without a range join: distinct coordinates of both sides are
    merged and the last label is carried down.  Of several labels at one
    coordinate the first in `order` counts.  strict: a label at the same
    coordinate is not above.
    """
    marks = labels.groupBy(*page, "top").agg(F.min_by("label", F.struct(*order)).alias("label"))
    marks = marks.filter("label is not null").select(
        *page, "top", F.lit(1 if strict else 0).alias("kind"), F.struct("label", C("top").alias("label_top")).alias("mark")
    )
    wanted = points.select(*page, "top").distinct().select(
        *page, "top", F.lit(0 if strict else 1).alias("kind"), F.lit(None).cast(marks.schema["mark"].dataType).alias("mark")
    )
    both = ordering.deal(marks.unionByName(wanted), [*page, "top", "kind"])
    carried = ordering.carried_down(both, page, ["top", "kind"], "mark", "last")
    found = carried.filter(C("kind") == (0 if strict else 1)).filter("last is not null")
    return found.select(*page, "top", "last.label", "last.label_top")


def row_bands(rows: DataFrame, page: list[str], height: int = vocab.PAGE_HEIGHT, margin: int = vocab.BAND_MARGIN) -> DataFrame:
    """Band of each distinct row coordinate: from itself to the next, clamped."""
    tops = ordering.deal(rows.select(*page, "top").distinct(), [*page, "top"])
    tops = ordering.following(tops, page, ["top"], "top", "next_top").fillna(height, "next_top")
    return tops.select(
        *page, "top", F.greatest(F.lit(0), C("top") - margin).alias("band_start"),
        F.least(F.lit(height), C("next_top") - margin).alias("band_end"),
    )


def interval_containment(images: DataFrame, rows: DataFrame, page: list[str]) -> DataFrame:
    """Image -> the band that contains its centre.

    Bands of a page do not overlap, so containment is an as-of lookup of the
    band start followed by a check of the band end.
    """
    bands = row_bands(rows, page).filter("band_end > band_start")
    starts = bands.select(*page, C("band_start").cast("double").alias("top"), F.struct("top", "band_end").alias("label"))
    centre = ((C("top") + C("bottom")) / 2).cast("double")
    points = images.withColumn("centre", centre)
    hits = nearest_above(points.select(*page, C("centre").alias("top")), starts, page, ["label"], strict=False)
    hits = hits.filter(C("top") < C("label.band_end"))
    hits = hits.select(*page, C("top").alias("centre"), C("label.top").alias("row_top"))
    return points.join(hits, [*page, "centre"])


def label_first_three(images: DataFrame, clusters: DataFrame, page: list[str], order: list[str]) -> DataFrame:
    """Images of each row by x0; the first three carry the milestones 0/50/100."""
    placed = images.join(clusters, [*page, "top"])
    w = Window.partitionBy(*page, "row_no").orderBy("x0", *order)
    first = placed.withColumn("slot", F.row_number().over(w)).filter("slot <= 3")
    return first.withColumn("milestone", F.element_at(F.array(*map(F.lit, vocab.MILESTONES)), C("slot")))


def contiguous_runs(points: DataFrame, keys: list[str], pos: str, chunk: int = 4096) -> DataFrame:
    """Maximal runs of consecutive positions: keys, run_start, run_end, score.

    Runs are found inside chunks of the position axis, then runs that touch a
    chunk border are merged: the second window sees a few rows per chunk.
    """
    distinct = points.groupBy(*keys, C(pos).alias("p")).agg(F.count("*").alias("n"))
    distinct = distinct.withColumn("chunk", F.floor(C("p") / chunk))
    island = C("p") - F.row_number().over(Window.partitionBy(*keys, "chunk").orderBy("p"))
    local = distinct.withColumn("island", island).groupBy(*keys, "chunk", "island").agg(
        F.min("p").alias("s"), F.max("p").alias("e"), F.sum("n").alias("n")
    )
    border = (C("s") == C("chunk") * chunk) | (C("e") == C("chunk") * chunk + chunk - 1)
    inner = local.filter(~border).select(*keys, C("s").alias("run_start"), C("e").alias("run_end"), C("n").alias("score"))
    by_start = Window.partitionBy(*keys).orderBy("s")
    outer = local.filter(border).withColumn(
        "new", F.when(C("s") == F.lag("e").over(by_start) + 1, 0).otherwise(1)
    ).withColumn("run", F.sum("new").over(by_start))
    merged = outer.groupBy(*keys, "run").agg(
        F.min("s").alias("run_start"), F.max("e").alias("run_end"), F.sum("n").alias("score")
    ).drop("run")
    return inner.unionByName(merged).withColumn("run_len", C("run_end") - C("run_start") + 1)


def best_run(runs: DataFrame, keys: list[str], least: int, most: int) -> DataFrame:
    """Longest admissible run of each key; score, then position break ties."""
    best = F.max(F.struct("run_len", "score", "run_start", "run_end")).alias("b")
    return runs.filter(C("run_len").between(least, most)).groupBy(*keys).agg(best).select(*keys, "b.*")
