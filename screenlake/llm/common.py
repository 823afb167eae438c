"""Shared helpers: the scratch folder, cut lineage, table access."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text contracts: space and the five ASCII controls 9 to 13.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder path under the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session.  Only where it is unset and driver and tasks are
    one process (local tests) a temporary folder is chosen; a cluster without it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later plans start from the
    files, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Bytes of an Arrow batch.  Ten thousand rows of whole texts would hold tens of megabytes several times over.
BATCH_BYTES = 4 << 20


def in_batches(rows: DataFrame) -> DataFrame:
    """``rows`` for a function on Arrow batches, which are bounded by bytes from here on in the session, unless
    the session has a limit of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if rows.sparkSession.conf.get(key, None) is None:
        rows.sparkSession.conf.set(key, str(BATCH_BYTES))
    return rows


#: Bytes a core reads at least before an input counts as large enough for the cores there are.
SMALL_SHARE = 8 << 20


def spread(rows: DataFrame) -> DataFrame:
    """``rows``, dealt over all cores where the input is small: a table of one row group is one task's reading, and
    whatever Python does with it would be, too.  Larger inputs never move."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(cores) if size < cores * SMALL_SHARE else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    """The text, null counted as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def to_shuffle_width(df: DataFrame) -> int:
    """The session's shuffle width, for salts and block counts that follow the cluster."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file is installed (on every machine, like the libraries)."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Most bits of a key filter: its broadcast takes at most an eighth as many bytes (8 MB).
FILTER_BITS = 1 << 26


def key_filter(keys: DataFrame, column: str, name: str) -> DataFrame:
    """A one-hash Bloom filter of a column's values as a table (bucket, bitmap, bits).

    About eight bits a key, FILTER_BITS at most, so its broadcast is bounded whatever the input.  With
    more keys than FILTER_BITS / 8 it lets a rising share of other rows through, in the end all of them:
    what it saves then is nothing, and the join behind it moves each row once.  It never loses one.
    """
    n = keys.count()
    bits = min(FILTER_BITS, max(1 << 15, 1 << (8 * n).bit_length()))
    h = F.pmod(F.xxhash64(column), F.lit(bits))
    table = keys.groupBy(F.bitmap_bucket_number(h).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("bitmap"))
    return saved(table.withColumn("bits", F.lit(bits)), name)


def may_hold(rows: DataFrame, key: str, filter_: DataFrame) -> DataFrame:
    """``rows`` with ``maybe``: false only where the key is not among the filter's.  No row moves."""
    first = filter_.select("bits").first()
    if first is None:
        return rows.withColumn("maybe", F.lit(False))
    h = F.pmod(F.xxhash64(key), F.lit(first["bits"]))
    place = F.bitmap_bit_position(h)
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    # The bit's own value, 2 ^ (place mod 8), from a literal table: shifts take literal widths only.
    bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (place % 8 + 1).cast("int")).cast("long")
    met = rows.withColumn("bucket", F.bitmap_bucket_number(h)).join(F.broadcast(filter_.drop("bits")), "bucket", "left")
    return met.withColumn("maybe", F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False))).drop("bucket", "bitmap")
