"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fieldrecon")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("FIELDRECON_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # split a hot join key even where that costs one more exchange
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` once to the cluster's shared folder and read it back, which restarts its lineage.

    The folder is `spark.checkpoint.dir`.  Only a local master that names none
    gets a temporary one, because there the driver and the executors share one disk.
    (`checkpoint` would derive the rows twice: once to count them, once to write them.)
    """
    path = new_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _shared(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir, or the checkpoint folder that was set, or (local master) a new one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the scratch folder."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def scratch_folder(spark: SparkSession) -> str:
    """A folder all executors can write: next to the checkpoints."""
    return _shared(spark).rstrip("/") + "/fieldrecon"
