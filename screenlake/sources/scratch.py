"""A fresh folder in the cluster's shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """``spark.checkpoint.dir`` names the shared folder; only where it is unset (local tests) a
    temporary one is taken."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later plans start from the files, and a lost executor costs
    no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrivals(df: DataFrame, by: str, slices: int, name: str, key: str | None = None) -> DataFrame:
    """``df`` as a stream: slices in the order of ``by``, each written by all tasks as one number of files and read
    as one batch.  With a ``key`` all rows of one are in one file, in order."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    low, high = df.selectExpr(f"min({by})", f"max({by})").first()
    files, width = 1, max(1, (high - low + slices) // slices) if low is not None else 1
    if low is not None:
        numbered = df.withColumn("_slice", F.floor((F.col(by) - low) / width).cast("int"))
        each = F.floor(F.approx_count_distinct(key) / 32) if key else F.count(F.lit(1))
        counts = [r["n"] for r in numbered.groupBy("_slice").agg(each.alias("n")).collect()]  # a row for each slice
        # No file may be empty, since a batch is as many files as a slice has.
        files = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), *counts))
        for k in range(slices):
            rows = numbered.where(F.col("_slice") == k).drop("_slice")
            rows = rows.repartition(files, key).sortWithinPartitions(by) if key else rows.repartition(files)
            rows.write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)
