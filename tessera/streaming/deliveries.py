"""Streams of deliveries and events, run until what is there has been taken in.

State is kept in the stream's checkpoint in the shared folder, results in a written table, so a stream that
is stopped goes on where it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ledger import Ledgers, buckets_for
from tessera.plans.workspace import Workspace


def _stream(ws: Workspace, path: str, schema) -> DataFrame:
    """A stream of the files of a table, which is a folder or one file."""
    where = ws._path(path)
    reader = ws.spark.readStream.schema(schema)
    if not ws._fs(where).getFileStatus(where).isDirectory():
        reader, path = reader.option("pathGlobFilter", where.getName()), where.getParent().toString()
    return reader.parquet(path)


def upserted(spark: SparkSession, path: str, key: str, columns: list[str], at: str = "loaded_at") -> DataFrame:
    """A table of the last delivery of each key, upserted batch by batch; deliveries seen before change nothing."""
    ws = Workspace(spark, "upsert")
    given = spark.read.parquet(path)
    kinds = dict(given.select(key, at, *columns).dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (key, at, *columns))
    ledgers = Ledgers(ws, "standing")
    standing = ledgers.table("standing", key, schema, buckets_for(given.count()))

    def take(batch: DataFrame, _: int) -> None:
        last = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(at, *columns)).alias("s")).select(key, "s.*")
        staged, touched = standing.stage(last, schema)
        both = standing.read(touched).unionByName(staged)
        standing.replace(both.groupBy(key).agg(F.max(F.struct(at, *columns)).alias("s")).select(key, "s.*"), touched)
        ledgers.commit()

    stream = _stream(ws, path, given.schema).select(key, at, *columns)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", ws.where("checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return standing.read()


def windowed(spark: SparkSession, path: str, length: str, late: str) -> DataFrame:
    """Events per window of event time and type; a window is given out once no event as late as ``late`` can still come."""
    ws = Workspace(spark, "windows")
    schema = spark.read.parquet(path).schema
    events = _stream(ws, path, schema).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = events.groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    out = ws.where("windows")
    (counted.select(F.col("window.start").alias("start"), "event_type", "n", "total").writeStream.outputMode("append").format("parquet").option("path", out)
     .option("checkpointLocation", ws.where("checkpoint")).trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema("start timestamp, event_type string, n long, total double").parquet(out)


def once(spark: SparkSession, path: str, key: str, late: str) -> DataFrame:
    """The first row of each key in a stream, with state kept for as long as repetitions may be late."""
    ws = Workspace(spark, "once")
    schema = spark.read.parquet(path).schema
    stream = _stream(ws, path, schema).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    out = ws.where("once")
    stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", ws.where("checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
