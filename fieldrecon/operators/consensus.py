"""Agreement of several readings of one position.

Groups may be of any size, so nothing is collected per reading: readings are
reduced to (value, count) pairs by a partial aggregate, and the rules are
windows over the distinct values, of which a pixel axis has few.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldrecon import vocab
from fieldrecon.functions.text import strip
from fieldrecon.operators import ordering

C = F.col
TOL = vocab.CONSENSUS_TOLERANCE

# fixed values: words of a time stamp and the confidence each class needs
MONTH_WORDS = [
    "JANUARI", "FEBRUARI", "MARET", "APRIL", "MEI", "JUNI", "JULI", "AGUSTUS",
    "SEPTEMBER", "OKTOBER", "NOVEMBER", "DESEMBER", "JAN", "FEB", "MAR", "APR",
    "JUN", "JUL", "AGU", "AGS", "SEP", "OKT", "NOV", "DES",
]
DAY_WORDS = ["SENIN", "SELASA", "RABU", "KAMIS", "JUMAT", "SABTU", "MINGGU"]
MARKER_WORDS = ["AM", "PM", "WIB", "WITA", "WIT"]
MIN_CONFIDENCE = {"month": 0, "marker": 15, "other": 20, "day": 15}
SPREAD = 8


def value_counts(readings: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    rows = readings.filter(C(value).isNotNull())
    return rows.groupBy(*keys, C(value).alias("v")).agg(F.count("*").alias("n"), F.min(pos).alias("first_pos"))


def consensus_median(readings: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """Upper median of >= 2 readings, where all lie within the tolerance of it."""
    counts = value_counts(readings, keys, value, pos)
    up = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    counts = counts.withColumn("cum", F.sum("n").over(up)).withColumn("total", F.sum("n").over(whole))
    median = F.min(F.when(C("cum") > F.floor(C("total") / 2), C("v"))).alias("consensus")
    stats = counts.groupBy(*keys).agg(
        median, F.max("total").alias("n_readings"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    agree = (C("n_readings") >= 2) & (C("hi") - C("consensus") <= TOL) & (C("consensus") - C("lo") <= TOL)
    return stats.filter(agree).select(*keys, "consensus", "n_readings")


def consensus_cluster(readings: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """Mean of the largest set of readings close to one of them (first wins ties)."""
    counts = value_counts(readings, keys, value, pos)
    axis = Window.partitionBy(*keys).orderBy("v")

    def near(value: Column) -> Column:
        """Sum over the readings strictly closer than the tolerance: those at the very tolerance are taken off again."""
        edges = [F.coalesce(F.sum(value).over(axis.rangeBetween(d, d)), F.lit(0)) for d in (-TOL, TOL)]
        return F.sum(value).over(axis.rangeBetween(-TOL, TOL)) - edges[0] - edges[1]

    counts = counts.withColumn("v", C("v").cast("double"))
    counts = counts.withColumn("size", near(C("n"))).withColumn("total", near(C("n") * C("v")))
    best = F.max_by(F.struct("size", "total"), F.struct("size", -C("first_pos"))).alias("b")
    return counts.groupBy(*keys).agg(best).filter("b.size >= 2").select(
        *keys, (C("b.total") / C("b.size")).alias("consensus"), C("b.size").alias("n_readings")
    )


def staged_value(readings: DataFrame, consensus: DataFrame, keys: list[str], default: int) -> DataFrame:
    """Override, own reading, consensus or default, with the stage that supplied it.

    An own reading counts when it lies within the tolerance of the consensus
    or of a second detector, or when there is no second detector.
    """
    rows = readings.join(consensus.select(*keys, "consensus"), keys, "left")
    near = F.coalesce(F.abs(C("y") - C("consensus")) <= TOL, F.lit(False))
    second = F.coalesce(F.abs(C("y") - C("y_second")) <= TOL, C("y_second").isNull())
    own = F.when(near | second, C("y"))
    stage = (
        F.when(C("y_override").isNotNull(), vocab.STAGES[0]).when(own.isNotNull(), vocab.STAGES[1])
        .when(C("consensus").isNotNull(), vocab.STAGES[2]).otherwise(vocab.STAGES[3])
    )
    value = F.coalesce(C("y_override"), own, C("consensus"), F.lit(default))
    return rows.select("pos", *keys, value.alias("y_used"), stage.alias("stage"))


def word_class(word: Column) -> Column:
    """month / marker / other / day of a cleaned word, NULL for anything else."""
    year = F.regexp_extract(word, "20[0-9]{2}", 0)
    is_year = (year != "") & (year != "2000")
    months, markers = "|".join(MONTH_WORDS), "|".join(MARKER_WORDS)
    prefix = "|".join(m for m in MONTH_WORDS if len(m) == 3)
    return (
        F.when(word.isin(MONTH_WORDS), "month").when(word.isin(MARKER_WORDS), "marker")
        .when(is_year | (F.length(word) >= 5) & word.rlike(f"(?:{markers})$|^(?:{prefix})[0-9]+$"), "other")
        .when(word.isin(DAY_WORDS), "day")
    )


def keyword_mean(words: DataFrame, keys: list[str], attempt: str) -> DataFrame:
    """Mean position of the time stamp's words, from the attempt that saw most.

    Primary words (months, years, markers) decide; day names only where no
    primary word is sure enough.  The mean is then widened to all words near it.
    """
    clean = F.regexp_replace(F.upper("text"), "[^A-Z0-9]", "")
    rows = words.filter(strip(C("text")) != "").withColumn("clean", clean).withColumn("class", word_class(C("clean")))
    floor = F.try_element_at(F.create_map(*[F.lit(x) for kv in MIN_CONFIDENCE.items() for x in kv]), C("class"))
    sure = C("conf") >= floor
    rows = rows.select(
        *keys, attempt, (C("top") + C("height") / 2).alias("cy"),
        F.when(sure & (C("class") != "day"), 1).otherwise(0).alias("primary"),
        F.when(sure & (C("class") == "day"), 1).otherwise(0).alias("day"),
    )
    spots = rows.groupBy(*keys, attempt, "cy").agg(
        F.count("*").alias("n"), F.sum("primary").alias("np"), F.sum("day").alias("nd")
    )
    w = Window.partitionBy(*keys, attempt)

    def mean(weight: str) -> Column:
        total = F.sum(weight).over(w)
        return F.when(total > 0, F.sum(C("cy") * C(weight)).over(w) / F.when(total > 0, total))

    spots = spots.withColumn("ref", F.coalesce(mean("np"), mean("nd"))).filter(F.abs(C("cy") - C("ref")) < SPREAD)
    tries = spots.groupBy(*keys, attempt).agg(F.sum("n").alias("size"), F.sum(C("cy") * C("n")).alias("total"))
    best = F.max_by(F.struct("size", "total"), F.struct("size", -C(attempt))).alias("b")
    return tries.groupBy(*keys).agg(best).select(
        *keys, (C("b.total") / C("b.size")).alias("y"), C("b.size").alias("n_words")
    )


def _founders(keys: list[str]):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Spots of one chain after another, in the order of their words: a spot with no founder near it is a founder.

        Founders lie apart by the tolerance or more, so few are held however long a chain is.
        """
        chain, held = None, []
        for rows in batches:
            keep = []
            for key, cy in zip(rows[[*keys, "chain"]].itertuples(index=False, name=None), rows["cy"], strict=True):
                if key != chain:
                    chain, held = key, []
                at = bisect.bisect_left(held, cy)
                near = any(abs(held[i] - cy) < TOL for i in (at - 1, at) if 0 <= i < len(held))
                if not near:
                    held.insert(at, cy)
                keep.append(not near)
            yield rows[keep]

    return fold


def leader_lines(words: DataFrame, keys: list[str], pos: str, left_edge: int = 30) -> DataFrame:
    """Text lines by their founding word; the top-most left-aligned line wins.

    Words in order join the first line whose founder is within the tolerance.
    A repeated position joins the line its first occurrence joined, so only
    distinct positions count.  Sorted, they are cut into chains where neighbours
    lie apart by the tolerance or more: no founder reaches over such a gap, so
    chains are folded alone.  A chain is read in order, never held as a whole.
    """
    spots = words.withColumn("cy", C("top") + C("height") / 2)
    founder = F.min_by(F.struct("top", "left_x"), pos)
    spots = spots.groupBy(*keys, "cy").agg(F.min(pos).alias("p"), founder.alias("f"), F.count("*").alias("n"))
    spots = spots.select(*keys, "cy", "p", C("f.top").alias("top"), C("f.left_x").alias("left_x"), "n")
    dealt = ordering.deal(spots, [*keys, "cy"])
    gaps = ordering.previous(dealt, keys, ["cy"], "cy", "before")
    gaps = gaps.withColumn("cut", F.when(C("cy") - C("before") < TOL, 0).otherwise(1))
    chains = ordering.running_total(gaps, keys, ["cy"], "cut", "chain").select(*keys, "chain", "p", "cy", "top", "left_x")
    chains = chains.repartition(*keys, "chain").sortWithinPartitions(*keys, "chain", "p")
    lines = chains.mapInPandas(_founders(keys), chains.schema)
    aligned = F.min(F.when(C("left_x") < left_edge, C("top")))
    lines = lines.groupBy(*keys).agg(F.coalesce(aligned, F.min("top")).alias("line_top"), F.count("*").cast("int").alias("n_lines"))
    return lines.join(dealt.groupBy(*keys).agg(F.sum("n").alias("n_words")), keys)
