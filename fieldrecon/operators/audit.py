"""Audits and roll-ups: outcomes, conflicts, completeness, labour, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldrecon import vocab
from fieldrecon.functions.text import found

C = F.col


def outcome_counts(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """success / failed / skipped per key, one row each."""
    return outcomes.groupBy(*keys).agg(
        *[F.count_if(C("status") == s).alias(s) for s in ("success", "failed", "skipped")]
    )


def stage_counts(events: DataFrame, keys: list[str]) -> DataFrame:
    """Events per key and stage over the fixed stages; absent stages count 0."""
    counted = events.groupBy(*keys).agg(*[F.count_if(C("stage") == s).alias(s) for s in vocab.STAGES])
    return counted.unpivot(keys, vocab.STAGES, "stage", "n")


def date_conflicts(assignments: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys that were given more than one value, with the number of values; each row stands for `n` assignments."""
    pairs = assignments.groupBy(*keys, value).agg(F.sum("n").alias("n"))
    sums = pairs.groupBy(*keys).agg(
        F.count(value).alias("n_values"), F.sum("n").alias("n_writes"),
        F.min(value).alias("lowest"), F.max(value).alias("highest"),
    )
    return sums.filter("n_values > 1")


def uniform_groups(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Whether each group of two or more agrees on one value."""
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    return sums.select(*keys, "n", ((C("n") >= 2) & F.coalesce(C("lo") == C("hi"), F.lit(False))).alias("uniform"))


def completeness(sets: DataFrame, report: list[str]) -> DataFrame:
    """Per report: complete sets, and the strict and the lenient verdict."""
    return sets.groupBy(*report).agg(
        F.count("*").alias("n_assets"), F.count_if("complete").alias("n_complete"),
        F.bool_and("complete").alias("strict_ok"), F.bool_or("complete").alias("lenient_ok"),
    )


def labour_rollup(assets: DataFrame, labour: DataFrame) -> DataFrame:
    """Staff and minutes of the planned assets by class, and overall.

    Assets are counted per labour reference first, so the roll-up expands at
    most one row per reference, not one per asset.
    """
    counted = assets.groupBy("asset_id").agg(F.count("*").alias("n"))
    rows = counted.join(F.broadcast(labour), counted["asset_id"] == labour["id"])
    return rows.rollup("class").agg(
        F.sum("n").alias("n_assets"), F.sum(C("n") * C("staff")).alias("staff"),
        F.sum(C("n") * C("senior_staff")).alias("senior_staff"), F.sum(C("n") * C("minutes")).alias("minutes"),
    )


def category_region_cube(entries: DataFrame) -> DataFrame:
    """Entries per category, per region, per both and overall."""
    counted = entries.groupBy("category", "region").agg(F.count("*").alias("n"))
    return counted.cube("category", "region").agg(F.sum("n").alias("n"))


def index_size(index: DataFrame) -> DataFrame:
    """Distinct keys and folder references of a folder index."""
    keys = index.groupBy("category", "key").agg(F.count("*").alias("n"))
    return keys.agg(F.count("*").alias("n_keys"), F.sum("n").alias("n_refs"))


def prefix_inventory(lines: DataFrame) -> DataFrame:
    """Per code prefix: distinct reports and an example report."""
    pairs = lines.select(found(C("code"), "^([A-Z]{2,4})[0-9]{4,}$").alias("prefix"), "report_id")
    pairs = pairs.filter("prefix is not null").distinct()
    return pairs.groupBy("prefix").agg(F.count("*").alias("n_reports"), F.min("report_id").alias("example"))


def vocabulary_drift(first: DataFrame, second: DataFrame, value: str) -> DataFrame:
    """Distinct values of two rule versions: in both, or in one only."""
    a, b = first.select(value).distinct(), second.select(value).distinct()
    return (
        a.intersect(b).withColumn("side", F.lit("both"))
        .unionByName(a.exceptAll(b).withColumn("side", F.lit("first")))
        .unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))
    )
