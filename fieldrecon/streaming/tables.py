"""Tables that a stream keeps up to date by adding, batch by batch, only what changed.

Every batch writes its own rows, reduced, into a folder named by its number; a
batch that is replayed writes the same folder again.  Readers merge the folders.
Once the folders added since the last merge hold as many bytes as that merge,
they are merged anew, so a row is rewritten about log(table / batch) times.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

C = F.col
BATCH = "_batch"
#: folders that are merged at once, at least
FOLDERS = 8


class BatchTable:
    """A table below `folder`; `merge` reduces rows with a batch number to those that still count, and may be applied repeatedly."""

    def __init__(self, spark: SparkSession, folder: str, schema, merge: Callable[[DataFrame], DataFrame]):
        self.spark, self.folder, self.schema, self.merge = spark, folder, schema, merge

    def add(self, batch: DataFrame, number: int) -> None:
        self.merge(batch.withColumn(BATCH, F.lit(number).cast("long"))).write.mode("overwrite").parquet(f"{self.folder}/added-{number}")
        merged, added = self._current()
        if len(added) >= FOLDERS and sum(map(self._bytes, added.values())) >= sum(map(self._bytes, merged.values())):
            newest = max(added)
            self._rows([*merged.values(), *added.values()]).write.mode("overwrite").parquet(f"{self.folder}/merged-{newest}")
            # what this merge replaces stays until the next one: somebody may be reading it
            for n, path in {**self._folders("merged"), **self._folders("added")}.items():
                if n < min([*merged, newest]):
                    self._fs(path).delete(path, True)

    def read(self) -> DataFrame:
        merged, added = self._current()
        return self._rows([*merged.values(), *added.values()]).drop(BATCH)

    def bytes_added(self) -> dict[int, int]:
        """Bytes that each batch wrote, by its number."""
        return {n: self._bytes(path) for n, path in self._folders("added").items()}

    def _rows(self, paths: list) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField(BATCH, LongType())])
        reader = self.spark.read.schema(schema)
        return self.merge(reader.parquet(*[p.toString() for p in paths]) if paths else self.spark.createDataFrame([], schema))

    def _current(self) -> tuple[dict, dict]:
        """The newest complete merge (one or none) and the complete folders added since, by batch number."""
        merged = self._folders("merged")
        last = max(merged, default=-1)
        return {n: p for n, p in merged.items() if n == last}, {n: p for n, p in self._folders("added").items() if n > last}

    def _folders(self, kind: str) -> dict:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = self._fs(path)
        found = [f.getPath() for f in fs.listStatus(path)] if fs.exists(path) else []
        found = [p for p in found if p.getName().startswith(kind + "-") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return {int(p.getName().rsplit("-", 1)[1]): p for p in found}

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _bytes(self, path) -> int:
        return self._fs(path).getContentSummary(path).getLength()


def newest_by(keys: list[str], order: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Merge that keeps the row of each key that is last in `order`."""

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")

    return merge


def tail_by(key: str, row_id: str, size: int) -> Callable[[DataFrame], DataFrame]:
    """Merge that keeps the `size` rows of each key with the largest `row_id`, each once."""

    def merge(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(key).orderBy(C(row_id).desc())
        once = rows.groupBy(key, row_id).agg(F.max_by(F.struct(*rows.columns), BATCH).alias("r")).select("r.*")
        return once.withColumn("_age", F.row_number().over(w)).filter(C("_age") <= size).drop("_age")

    return merge


def all_rows(rows: DataFrame) -> DataFrame:
    """Merge that keeps every row."""
    return rows
