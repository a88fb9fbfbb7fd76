"""Sinks: audit logs, report tables, the partitioned output tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldrecon.functions.text import sanitize_segment
from fieldrecon.sources.files import exists

C = F.col
TREE = ["team", "region", "category"]


def append_audit(outcomes: DataFrame, path: str) -> None:
    """Add outcomes to an append-only log."""
    outcomes.write.mode("append").parquet(path)


def read_audit(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    """One report table as CSV with a header."""
    rows.write.mode("overwrite").option("header", "true").csv(path)


def read_report(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def output_path(team, region, category, identifier):
    """Tim_n/region/category/identifier with safe segments."""
    return F.concat_ws(
        "/", F.concat(F.lit("Tim_"), team.cast("string")), sanitize_segment(region), category, sanitize_segment(identifier)
    )


def missing_keys(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not present yet: what a run without overwrite still does."""
    return rows.join(existing.select(*keys), keys, "left_anti")


def write_tree(rows: DataFrame, path: str, keys: list[str], overwrite: bool = True) -> None:
    """Write rows below team=/region=/category=.

    overwrite: replace the partitions that occur in `rows`, keep all others.
    otherwise: append only rows whose key is not stored yet.
    """
    spark = rows.sparkSession
    if not overwrite and exists(spark, path):
        rows = missing_keys(rows, spark.read.parquet(path), keys)
    # partitions follow the tree; adaptive execution splits a hot folder by its size
    spread = rows.hint("rebalance", *[C(c) for c in TREE])
    writer = spread.write.partitionBy(*TREE)
    if overwrite:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("append").parquet(path)
