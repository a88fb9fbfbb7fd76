"""Nested JSON documents: dimension maps and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col
MAP_OF_MAP = "map<string,map<string,struct<asset_id:int,catatan:string>>>"
PLAN_DOC = "struct<version:int,region:string,path:string,identifier:string,minutes:int,photos:map<string,string>>"


def flatten_nested(docs: DataFrame, column: str) -> DataFrame:
    """type -> detail -> info documents as rows; keys that start with _ are notes.

    Metadata entries may hold anything, so the inner maps are parsed only
    after they were dropped.
    """
    keep = [c for c in docs.columns if c != column]
    outer = docs.select(*keep, F.posexplode(F.map_entries(F.from_json(column, "map<string,string>"))).alias("ord", "e"))
    outer = outer.filter(~C("e.key").startswith("_")).select(*keep, "ord", C("e.key").alias("asset_type"), C("e.value").alias("v"))
    inner = F.from_json("v", "map<string,struct<asset_id:int,catatan:string>>")
    rows = outer.select(*keep, "ord", "asset_type", F.posexplode(F.map_entries(inner)).alias("ord2", "e"))
    return rows.filter(~C("e.key").startswith("_")).select(
        *keep, "asset_type", C("e.key").alias("detail"), C("e.value.asset_id").alias("asset_id"),
        C("e.value.catatan").alias("note"), "ord", "ord2",
    )


def load_nested(spark: SparkSession, path: str, per_line: bool = False, about: dict[str, str] | None = None) -> DataFrame:
    """Rows of nested JSON files; no rows where the path does not exist.

    A file is one document, or holds one in each line.  `about` names entries of
    the documents' `_metadata` that become columns, with their types.
    """
    from fieldrecon.sources.files import exists

    if not exists(spark, path):
        docs = spark.createDataFrame([], "value string")
    else:
        docs = spark.read.text(path, wholetext=not per_line)
    for name, kind in (about or {}).items():
        docs = docs.withColumn(name, F.get_json_object("value", f"$._metadata.{name}").cast(kind))
    return flatten_nested(docs, "value")


def nest_plan(entries: DataFrame, marks: list[tuple[int, Column]]) -> DataFrame:
    """One JSON document per plan entry, photos as a map of milestone to time."""
    photos = F.create_map(
        *[x for m, at in marks for x in (F.lit(f"{m}.jpg"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))]
    )
    doc = F.struct(F.lit(3).alias("version"), "region", "path", "identifier", "minutes", photos.alias("photos"))
    return entries.select(F.to_json(doc).alias("value"))


def flatten_plan(docs: DataFrame) -> DataFrame:
    """Rows region, path, identifier, minutes, milestone, at of plan documents."""
    rows = docs.select(F.from_json("value", PLAN_DOC).alias("d"))
    rows = rows.select("d.region", "d.path", "d.identifier", "d.minutes", F.explode("d.photos").alias("photo", "at"))
    return rows.withColumn("milestone", F.split_part("photo", F.lit("."), F.lit(1)).cast("int"))


def write_plan(entries: DataFrame, marks: list[tuple[int, Column]], path: str) -> None:
    nest_plan(entries, marks).write.mode("overwrite").text(path)


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    return flatten_plan(spark.read.text(path))
