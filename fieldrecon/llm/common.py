"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldrecon.session import scratch_folder

#: the six ASCII white-space characters that part words
SPACES = "\t\n\x0b\x0c\r "
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: bytes of rows in a batch that is sent to a Python worker
ARROW_BATCH = 4 << 20

#: tables of at most this many rows may be broadcast; longer ones are joined by shuffle
BROADCAST_ROWS = 50_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Register a query, with its DuckDB SQL where there is one."""

    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and all executors share."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, temporary: list[str] | None = None) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: lineage ends here.

    `temporary` collects the folders of tables that the caller will `drop`.
    """
    path = new_folder(df.sparkSession, name)
    if temporary is not None:
        temporary.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Meanwhile, batches sent to Python workers hold about `size` bytes, or fewer where the session asks for fewer."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name, None)
    # the setting is one of bytes, with or without a unit
    least = size if held is None else min(size, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(held))
    spark.conf.set(name, str(least if least > 0 else size))
    try:
        yield
    finally:
        if held is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, held)


def save_lean(df: DataFrame, name: str, temporary: list[str] | None = None) -> DataFrame:
    """`save` for tables that Python workers make of texts: these reach them in batches of ARROW_BATCH bytes, not of 10,000 rows."""
    with _batches_of(df.sparkSession, ARROW_BATCH):
        return save(df, name, temporary)


#: empty the caches that a Python worker keeps between partitions
_EMPTY: list[Callable[[], None]] = []


def worker_cache(empty: Callable[[], None]) -> None:
    """Name what empties a cache of this worker; steps that are `lean` and don't use caches call it."""
    _EMPTY.append(empty)


def empty_caches() -> None:
    for empty in _EMPTY:
        empty()


def release() -> None:
    """Give memory that is free back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable, uses_caches: bool = False) -> Callable:
    """`run`, a function over Arrow batches, in a worker that gives back what it freed after every batch.

    Workers outlive their tasks and are reused by all steps, so without this each holds the most that any step took.
    """

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given() -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b
                release()

        if not uses_caches:
            empty_caches()
        yield from run(given())
        release()

    return held


def drop(spark: SparkSession, folders: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match; the right side's keys are dropped."""
    right = right.select([F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in right.columns])
    on = None
    for c in keys:
        one = left[c].eqNullSafe(right[f"_k_{c}"])
        on = one if on is None else on & one
    return left.join(right, on, how).drop(*[f"_k_{c}" for c in keys])


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a saved table for broadcast if it was counted to be short enough; else leave it to a shuffle join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def text_key(text: str = "text"):
    """Hash that stands for a text in join keys next to the row's id (null is not empty)."""
    return F.xxhash64(F.col(text).isNull(), F.coalesce(F.col(text), F.lit("")))


def shield(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`df` with columns c0, c1, ... and the new name of each old one: names of its columns can't clash with ours."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


def unshield(df: DataFrame, at: dict[str, str]) -> DataFrame:
    """The columns that `shield` renamed, under their old names."""
    return df.select(*at.values()).toDF(*at)
