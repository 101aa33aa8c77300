"""Intermediate tables in the folder that all executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.session import use_checkpoints

#: Rows and bytes that Python gets at a time: texts are long, and several workers share an executor's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds of Arrow batches to BATCH_ROWS and BATCH_BYTES, where they are larger (or 0, without bound)."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < _number(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def _number(text: str) -> int:
    """A setting's number; one in another unit than bytes counts as unset."""
    digits = text.removesuffix("b")
    return int(digits) if digits.isdigit() else 0


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores appended until no column of ``taken`` and no earlier one has it."""
    used = {x.lower() for x in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """The column of just this name, dots and all."""
    quoted = name.replace("`", "``")
    return F.col(f"`{quoted}`")


class Scratch:
    """Tables written below the session's checkpoint folder, read back from there; the folder goes when the driver ends."""

    def __init__(self, spark: SparkSession) -> None:
        use_checkpoints(spark)
        small_batches(spark)
        self.spark = spark
        self.top = f"{spark.sparkContext.getCheckpointDir()}/weirflow-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def _folder(self, name: str = ""):
        """The file system and path of a table, or of all of them."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.top}/{name}"
        frame.write.mode("overwrite").parquet(path)
        if not self.names:
            system, top = self._folder()
            system.deleteOnExit(top)
        self.names.add(name)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for name in self.names & set(names):
            system, path = self._folder(name)
            system.delete(path, True)
            self.names.remove(name)

    def drop_all_but(self, *names: str) -> None:
        self.drop(*(self.names - set(names)))
