"""State tables that are kept between batches, in buckets of their key.

A ledger is a folder of buckets, each a list of written parts, and a manifest that says which parts
count.  A batch is first written by buckets, which tells the buckets it touches; only those are read,
joined and written anew, or added to.  What a batch changed counts from ``commit`` on, and only then
are the parts removed that no longer do; a run that dies before leaves the ledgers as they were.
Ledgers at a given folder are found again by the next run.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.workspace import Workspace

#: Rows of a bucket aimed at, and above so many buckets.
BUCKET_ROWS, MANY, MORE_ROWS = 100_000, 4096, 1_000_000


def buckets_for(rows: int) -> int:
    """A power of two, so that a bucket of evenly spread keys stays a small part of a task's memory."""
    wanted = min(rows // BUCKET_ROWS, max(MANY, rows // MORE_ROWS))
    return 1 << max(0, wanted).bit_length()


class Ledgers:
    """Several ledgers in one folder under one manifest, so that a batch changes all of them or none."""

    def __init__(self, ws: Workspace, name: str, at: str | None = None):
        self.ws, self.at = ws, (at or ws.where(name)).rstrip("/")
        self.version, self.held, self.spare = 0, {}, []
        for file in ("manifest.json", "manifest.new"):
            path = ws._path(f"{self.at}/{file}")
            if ws._fs(path).exists(path):
                stream = ws._fs(path).open(path)
                found = json.loads(bytes(stream.readAllBytes()))
                stream.close()
                self.version = found["version"]
                self.held = {n: {"buckets": t["buckets"], "parts": {int(b): p for b, p in t["parts"].items()}} for n, t in found["held"].items()}
                break

    def table(self, name: str, key: str, schema: str, buckets: int) -> BucketLedger:
        return BucketLedger(self, name, key, schema, self.held.setdefault(name, {"buckets": buckets, "parts": {}}))

    def commit(self) -> None:
        """Makes all changes since the last commit count, and removes what no longer does."""
        new, path = self.ws._path(f"{self.at}/manifest.new"), self.ws._path(f"{self.at}/manifest.json")
        fs = self.ws._fs(path)
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps({"version": self.version, "held": self.held}), "utf-8"))
        stream.close()
        fs.delete(path, False)
        fs.rename(new, path)
        for folder in self.spare:
            fs.delete(self.ws._path(folder), True)
        self.spare = []


class BucketLedger:
    """One row per key, or several where rows are only appended."""

    def __init__(self, ledgers: Ledgers, name: str, key: str, schema: str, held: dict):
        self.ledgers, self.ws, self.name, self.key, self.schema = ledgers, ledgers.ws, name, key, schema
        self.parts, self.buckets = held["parts"], held["buckets"]

    def _write(self, df: DataFrame, label: str) -> tuple[str, dict[int, str]]:
        """The folder written, and in it that of each bucket."""
        self.ledgers.version += 1
        where = f"{self.ledgers.at}/{self.name}-{label}-{self.ledgers.version:05d}"
        bucketed = df.withColumn("_b", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        with self.ws.cleaning():
            bucketed.repartition(self.buckets, "_b").write.partitionBy("_b").option("compression", "zstd").parquet(where)
        root = self.ws._path(where)
        names = [s.getPath().getName() for s in self.ws._fs(root).listStatus(root)]
        return where, {int(n[3:]): f"{where}/{n}" for n in names if n.startswith("_b=")}

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        spark = self.ws.spark
        return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)

    def read(self, touched: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        wanted = None if touched is None else set(touched)
        return self._read([f for b in sorted(self.parts) if wanted is None or b in wanted for f in self.parts[b]], self.schema)

    def stage(self, df: DataFrame, schema: str) -> tuple[DataFrame, list[int]]:
        """A batch written by buckets: read back, and the buckets it touches."""
        where, staged = self._write(df, "batch")
        self.ledgers.spare.append(where)
        return self._read(list(staged.values()), schema), sorted(staged)

    def append(self, df: DataFrame) -> DataFrame:
        """Adds rows of keys that are not yet held; returns them as written."""
        written = self._write(df, "part")[1]
        for b, folder in written.items():
            self.parts.setdefault(b, []).append(folder)
        return self._read(list(written.values()), self.schema)

    def replace(self, df: DataFrame, touched: list[int]) -> None:
        """The new rows of the touched buckets; the other buckets are not rewritten."""
        written = self._write(df, "part")[1]
        self.ledgers.spare += [f for b in touched for f in self.parts.pop(b, [])]
        self.parts.update({b: [folder] for b, folder in written.items()})
