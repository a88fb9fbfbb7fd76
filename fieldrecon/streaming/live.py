"""The same event operators over streams, with bounded state.

Sources are file streams: a restart continues from the offsets in the query's
checkpoint, which is the replay-then-follow behaviour of a live view.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldrecon.session import scratch_folder
from fieldrecon.streaming.tables import BATCH, BatchTable, all_rows, newest_by, tail_by

C = F.col


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files as a stream; `path` may be one file, a folder or a pattern."""
    from fieldrecon.sources.files import is_file

    reader = spark.readStream.schema(schema)
    if is_file(spark, path):  # a stream watches folders
        folder, name = path.rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


#: settings that a stream's session takes over from the caller's
_SHARED = ("spark.sql.shuffle.partitions", "spark.sql.ansi.enabled", "spark.sql.adaptive.enabled", "spark.checkpoint.dir")


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of its own for streams: UTC, keyed state in RocksDB, session windows merged in each task first."""
    own = spark.newSession()
    for name in _SHARED:
        value = spark.conf.get(name, None)
        if value is not None and own.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.session.timeZone", "UTC")
    own.conf.set("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")
    return own


def run_to_table(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Append all available input to a parquet table and read it back; called again with the same folder it handles only what is new."""
    folder = folder or f"{scratch_folder(stream.sparkSession)}/{uuid.uuid4().hex}"
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", folder + "/state")
    writer.outputMode("append").format("parquet").option("path", folder + "/out").start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder + "/out")


def follow(stream: DataFrame, kept: BatchTable, mode: str = "append") -> DataFrame:
    """Bring a table up to date with all available input and read it."""
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", kept.folder + "-state")
    query.outputMode(mode).foreachBatch(kept.add).start().awaitTermination()
    return kept.read()


def fork(stream: DataFrame, branches: dict[str, Callable[[DataFrame], DataFrame]], folder: str | None = None) -> dict[str, DataFrame]:
    """One reading of a stream into several tables, each a function of the batch; a replayed batch replaces its own rows."""
    spark = stream.sparkSession
    folder = folder or f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    empty = spark.createDataFrame([], stream.schema)
    kept = {name: BatchTable(spark, f"{folder}/{name}", f(empty).schema, all_rows) for name, f in branches.items()}

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()  # the source is read once for all branches
        for name, f in branches.items():
            kept[name].add(f(batch), number)
        batch.unpersist()

    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", folder + "/state")
    query.foreachBatch(write).start().awaitTermination()
    return {name: t.read() for name, t in kept.items()}


def running_stage_counts(events: DataFrame) -> DataFrame:
    """Live count per run and stage."""
    return events.groupBy("run_id", "stage").agg(F.count("*").alias("n"))


def event_rate(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events per window and type; state older than the watermark is dropped."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    counted = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(C("w.start").alias("start"), C("w.end").alias("end"), "event_type", "n")


def event_sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Bursts of events of one user, closed by a pause of `gap`."""
    counted = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(
        F.count("*").alias("n")
    )
    return counted.select("user_id", C("w.start").alias("start"), C("w.end").alias("end"), "n")


def count_table(counts: DataFrame, keys: list[str], folder: str | None = None) -> DataFrame:
    """Running counts: each batch adds those that it changed, the newest of a key counts."""
    return follow(counts, _table(counts, folder, newest_by(keys, [BATCH])), "update")


def tail_table(stream: DataFrame, size: int, folder: str | None = None) -> DataFrame:
    """Newest `size` lines of each run; a batch adds at most as many for each run that it holds."""
    return follow(stream, _table(stream, folder, tail_by("run_id", "line_id", size)))


def upsert_table(stream: DataFrame, keys: list[str], order: list[str], folder: str | None = None) -> DataFrame:
    """Newest row of each key; a batch adds one row for each key that it holds."""
    return follow(stream, _table(stream, folder, newest_by(keys, order)))


def change_table(changes: DataFrame, keys: list[str], folder: str | None = None, reader: SparkSession | None = None) -> DataFrame:
    """What the changes of a stateful operator, numbered by `version` within a batch, leave for each key; read by the session `reader`."""
    return follow(changes, _table(changes, folder, newest_by(keys, [BATCH, "version"]), reader), "update").drop("version")


def _table(stream: DataFrame, folder: str | None, merge, reader: SparkSession | None = None) -> BatchTable:
    spark = reader or stream.sparkSession
    return BatchTable(spark, folder or f"{scratch_folder(spark)}/{uuid.uuid4().hex}", stream.schema, merge)
