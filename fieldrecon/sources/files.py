"""File listings, paths and text sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldrecon import vocab
from fieldrecon.functions.text import strip
from fieldrecon.operators import ordering

C = F.col


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def is_file(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(jpath) and fs.getFileStatus(jpath).isFile()


def any_case_glob(extension: str) -> str:
    """*.[pP][dD][fF] for pdf."""
    return "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in extension)


def file_scan(spark: SparkSession, folder: str, extension: str = "pdf") -> DataFrame:
    """Files of a folder tree by extension in any case: path, file_name, length.

    Only the listing is read: the content column is pruned from the scan.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", any_case_glob(extension)).load(folder)
    )
    return files.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("file_name"), "length")


def bounded_listing(files: DataFrame, order: str, limit: int = 100) -> DataFrame:
    """First `limit` rows in order, each with the total and whether it was cut."""
    total = files.agg(F.count("*").alias("total")).scalar()
    first = files.orderBy(order).limit(limit)
    return first.withColumn("total", total).withColumn("truncated", C("total") > limit)


def path_order(files: DataFrame, column: str = "path") -> DataFrame:
    """Total order by path; Spark range-partitions, no single task sorts all."""
    return files.orderBy(column)


def path_keys(path: Column) -> Column:
    """struct(region, category, identifier, photo, milestone) of a stored path.

    [region/]category/identifier/photo; the region defaults when the first part
    is none.  All NULL for shorter paths.
    """
    parts = F.split(path, "/")
    shift = F.when(path.startswith("BTP"), 1).otherwise(0)

    def part(i: int) -> Column:
        return F.try_element_at(parts, shift + i)

    deep = F.size(parts) >= 3 + shift
    region = F.when(shift == 1, F.try_element_at(parts, F.lit(1))).otherwise(vocab.DEFAULT_REGION)
    stem = F.regexp_replace(part(3), r"\.[^.]*$", "")
    return F.struct(
        F.when(deep, region).alias("region"), F.when(deep, part(1)).alias("category"),
        F.when(deep, part(2)).alias("identifier"), F.when(deep, part(3)).alias("photo"),
        F.when(deep & stem.isin("0", "50", "100"), stem.cast("int")).alias("milestone"),
    )


def sidecar_texts(spark: SparkSession, folder: str, keys: list[str], name: str = "*.txt") -> DataFrame:
    """keys and text of every sidecar file in a tree of key=value folders; a missing tree gives no rows."""
    if not exists(spark, folder):
        return spark.createDataFrame([], ", ".join(f"{k} string" for k in [*keys, "date_text"]))
    schema = ", ".join(f"{k} string" for k in ["value", *keys])
    found = spark.read.schema(schema).option("pathGlobFilter", name).text(folder, wholetext=True)
    return found.select(*keys, strip(C("value")).alias("date_text"))


def write_sidecars(sidecars: DataFrame, keys: list[str], folder: str) -> None:
    """One text file in each folder of the tree; `sidecars` has one row for each key."""
    rows = sidecars.select(*keys, C("date_text").alias("value")).repartition(*keys)
    rows.write.partitionBy(*keys).text(folder)


def write_sidecar_packs(sidecars: DataFrame, tree: list[str], folder: str) -> None:
    """Sidecars of many folders in few files: below the keys of `tree`, one JSON line holds a folder's other keys and text.

    The number of files follows the bytes, not the folders, of which large data has millions.
    """
    line = F.to_json(F.struct(*[c for c in sidecars.columns if c not in tree]))
    rows = sidecars.select(*tree, line.alias("value")).hint("rebalance", *[C(c) for c in tree])
    rows.write.partitionBy(*tree).text(folder)


def packed_sidecars(spark: SparkSession, folder: str, tree: list[str], keys: list[str]) -> DataFrame:
    """tree, keys and text of every sidecar in packs; a missing folder gives no rows."""
    if not exists(spark, folder):
        return spark.createDataFrame([], ", ".join(f"{k} string" for k in [*tree, *keys, "date_text"]))
    found = spark.read.schema(", ".join(f"{k} string" for k in ["value", *tree])).text(folder)
    found = found.withColumn("v", F.from_json("value", ", ".join(f"{k} string" for k in [*keys, "date_text"])))
    return found.select(*tree, *[C(f"v.{k}").alias(k) for k in keys], strip(C("v.date_text")).alias("date_text"))


def sidecar_join(photos: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Every photo with the text of its folder's sidecar, NULL where there is none."""
    return photos.join(sidecars, ["region", "category", "identifier"], "left")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """line_id, line of text logs: lines are numbered from 1 through the files in the order of their paths.

    A large file is read in splits by many tasks: each numbers its own lines,
    and the numbers of lines of the splits before it are added.  A missing path
    gives no rows.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], "line_id long, line string")
    place = [C("_metadata.file_path").alias("file"), C("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")]
    lines = spark.read.text(path).select(*place, C("value").alias("line"))
    return ordering.rank_in_groups(lines, [], ["file", "block"], ["row"], "line_id").select("line_id", "line")
