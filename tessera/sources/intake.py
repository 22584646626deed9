"""Files and deliveries as they come in: listing, changes against the register, numbering of what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def listing(spark: SparkSession, root: str, glob: str = "*", without: tuple[str, ...] = ()) -> DataFrame:
    """(path, size, modified, sha256) of the files under a folder, in any depth; ``without`` are patterns of paths to leave out.
    Spark's scan passes over empty files, so these are not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    for pattern in without:
        files = files.where(~F.col("path").rlike(pattern))
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def changes(register: DataFrame, found: DataFrame, key: str = "rel_path", content: str = "sha256") -> DataFrame:
    """(key, change): new, unchanged, modified or missing, by content."""
    old = register.select(F.col(key), F.col(content).alias("_old"), F.lit(True).alias("_had"))
    new = found.select(F.col(key), F.col(content).alias("_new"), F.lit(True).alias("_has"))
    change = (F.when(F.col("_had").isNull(), "new").when(F.col("_has").isNull(), "missing").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("modified"))
    return old.join(new, key, "full_outer").select(key, change.alias("change"))


def numbered(df: DataFrame, *order: Column | str, name: str = "n", first: int = 1) -> DataFrame:
    """Rows numbered in order, without gaps, by all tasks at once: ranges of the order, and the sizes of those before.

    Sizes are one row per range, a number of rows set by the cluster and not by the data."""
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).drop("_size")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_within", within).join(F.broadcast(before), "_range").withColumn(name, (F.col("_within") + F.col("_before") + (first - 1)).cast("bigint")).drop("_range", "_within", "_before")
