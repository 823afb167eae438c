"""Sources and sinks: evidence files, the attempt trace and tables derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

CHURN_PERIOD, ROTATION_PERIOD, TOKEN_KINDS, REGIONS = 50_000, 5_000, 4, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_evidence(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON-lines shards with the file and shard each row came from; a malformed row is an error."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    file = F.col("_metadata.file_path")
    return rows.withColumns({"source_file": file, "shard": F.regexp_extract(file, r"(\d+)[^/\d]*$", 1).try_cast("int")})


def write_no_replace(df: DataFrame, path: str, kind: str = "json") -> None:
    """Write results; existing results are an error."""
    getattr(df.write.mode("errorifexists"), kind)(path)


def from_json_props(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The named fields of an open JSON payload as columns, and all of it as a map."""
    parsed = F.from_json(column, schema)
    return df.withColumn("parsed", parsed).withColumn(f"{column}_map", F.from_json(column, "map<string,string>")).select("*", "parsed.*").drop("parsed")


def read_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed attempt trace: identity, time, scope, token, label, result, weight, value."""
    events = table(spark, sf_dir, "events")
    scope = S.scope_at("event_index", "account", CHURN_PERIOD, ROTATION_PERIOD)
    rows = events.select(
        F.col("event_id").alias("event_index"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("ts_ms"),
        F.col("user_id").alias("account"),
        F.concat_ws("-", "event_type", (F.get_json_object("props", "$.k").cast("long") % TOKEN_KINDS).cast("string")).alias("token"),
        "event_type", "value", (1.0 + F.col("user_id") % 2).alias("weight"),
    ).withColumns(scope)
    # Partitioned by scope, not by tuple: later windows over scopes and tuples then find their rows in
    # place, and this window's order (token, event_index) is the one that tuple windows need.
    before = F.lag("token").over(Window.partitionBy("account", "generation", "version").orderBy("token", "event_index"))
    first = ~F.col("token").eqNullSafe(before)
    label = F.when(F.col("event_type") == "purchase", "VALID").when(F.col("event_type") == "signup", "NO_ACCOUNT").when(first, "INVALID_DISTINCT").otherwise("INVALID_REPEATED")
    return rows.withColumn("label", label).withColumn("result", S.label_to_result("label"))


def read_members(attempts: DataFrame) -> DataFrame:
    """One current credential per account: its most frequent token, ties to the smallest."""
    counted = attempts.groupBy("account", "token").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("account").agg(F.min_by("token", F.struct(-F.col("n"), F.col("token"))).alias("token"))


def read_versions(attempts: DataFrame) -> DataFrame:
    """Directory log: (account, generation, version, valid_from), one row per change of scope."""
    return attempts.groupBy("account", "generation", "version").agg(F.min("event_index").alias("valid_from"))


def read_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment points: one row per seed, method, profile and load, with counts and a latency."""
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy(
        (F.col("l_suppkey") % 20).alias("seed"), F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("profile"), F.col("l_linenumber").cast("long").alias("load")
    ).agg(
        F.count(F.lit(1)).alias("offered"),
        F.sum(F.when(F.col("l_discount") < 0.03, 1).otherwise(0)).alias("dropped"),
        F.sum(F.when(F.col("l_tax") > 0.06, 1).otherwise(0)).alias("timed_out"),
        F.sum(F.col("l_quantity").cast("long")).alias("checks"),
        F.round(F.avg("l_extendedprice"), 6).alias("p99"),
    )


def read_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screen configurations: family, memory and false-forward rate."""
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("spec"), F.col("p_brand").alias("family"), F.col("p_size").cast("long").alias("memory"), (F.col("p_retailprice") / 2500.0).alias("ffr"))
