"""Materialised intermediate tables in the folder all executors share.

Iterative operators cut their lineage by writing a table and reading it back.  The tables go
below ``spark.checkpoint.dir``; only where the session has no such setting (tests, a laptop)
is a local folder made.  A written table survives the loss of any executor.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
CLEANUP = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled",)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; in local mode, where none is configured, a fresh temporary one."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"{SETTING} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set(SETTING, found) if spark.conf.isModifiable(SETTING) else None
    return found.rstrip("/")


class Workspace:
    """A private folder of named parquet tables; what is left in it goes when the session ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.serial = 0
        path = self._path(self.root)
        self._fs(path).deleteOnExit(path)

    @contextmanager
    def cleaning(self) -> Iterator[None]:
        """Within it, shuffle files of an execution go when it ends; the session's own settings come back after."""
        before = {name: self.spark.conf.get(name, None) for name in CLEANUP if self.spark.conf.isModifiable(name)}
        for name in before:
            self.spark.conf.set(name, "true")
        try:
            yield
        finally:
            for name, value in before.items():
                self.spark.conf.unset(name) if value is None else self.spark.conf.set(name, value)

    def _path(self, where: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)

    def _fs(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def where(self, name: str) -> str:
        self.serial += 1
        return f"{self.root}/{self.serial:03d}-{name}"

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` and return the table read back, with its lineage cut."""
        where = self.where(name)
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        with self.cleaning():
            writer.parquet(where)
        back = self.spark.read.schema(df.schema).parquet(where)
        back.tessera_path = where
        return back

    def drop(self, df: DataFrame | None) -> None:
        """Remove a saved table that nothing reads any more."""
        where = getattr(df, "tessera_path", None)
        if where:
            path = self._path(where)
            self._fs(path).delete(path, True)
