"""Exact deduplication by keyed streaming state.

Method: the documents' digests arrive as a stream; a stateful aggregation on disk-backed
(RocksDB) state, without watermark and so without expiry, keeps for every digest the
smallest document id, the locator of that row's content (file and row in it) and the number of
rows.  A digest seen more than once is a hit; when the stream has read what there is, the full
normalised bytes of all hits are compared with those at the kept rows' locators, in one scan.  With a
folder of the caller, state and progress outlive a call.  Only DataFrame operations are used.

Why it scales: what is shuffled for grouping is one short row per digest and task
(map-side partial aggregation), so a text that a third of all rows share costs no more than
any other.  Texts move only for the byte check, once for each task that holds one with copies.
A bounded filter keeps texts without a copy out of it; from some eight million repeated
digests on it lets more and more of them through, and the join then moves every text once.

Defined results: null text counts as empty; null ``doc_id`` sorts last; rows repeated with
one ``doc_id`` and text keep one of them; an empty table gives no rows; further columns of
any name are ignored by ``exact_dedup`` and carried through by ``drop_exact_copies``.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_RUN, key_filter, may_hold, saved, scratch, text_or_empty

_LAST = (1 << 63) - 1
_ARRIVAL = "doc_id long, locator struct<file:string,row:long>, digest string, text_sha256 string"
_STATE = "digest string, first_id long, first_locator struct<file:string,row:long>, n_rows long"


def normalised(text):
    return F.regexp_replace(text, SPACE_RUN, " ")


@contextmanager
def _rocksdb(spark: SparkSession):
    """Disk-backed state for the streams started inside; earlier settings come back."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
        "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
        # Small stores stay small on disk: no preallocated files, and commits write changes only.
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        # Stores that no query uses any more are closed soon.
        "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keyed_state(arrivals: DataFrame) -> DataFrame:
    """Per digest: smallest id, its locator, number of rows.

    ``arrivals`` (digest, doc_id, locator) may be a stream: then this is the stateful
    operator, whose state is one short row per digest and never expires.
    """
    order = F.struct(F.coalesce(F.col("doc_id"), F.lit(_LAST)), "locator")
    return arrivals.groupBy("digest").agg(
        F.min(F.coalesce(F.col("doc_id"), F.lit(_LAST))).alias("first_id"),
        F.min_by("locator", order).alias("first_locator"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_locator``: the file and the row in it.  Rows that come from no file are written first."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return docs.select("*", place.alias("_locator"))
    except AnalysisException:
        return saved(docs, "dedup-rows").select("*", place.alias("_locator"))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows under ``path``, none if nothing has been written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def stream_groups(arrivals: str, home: str, spark: SparkSession, files_per_batch: int | None = None) -> DataFrame:
    """Run the stateful stream over the files under ``arrivals`` that ``home``'s progress has not met, and return the
    last state of every digest with the last ``batch`` that touched it.

    State and progress live under ``home``: a stream that was stopped goes on behind its last batch, and later files
    meet the state of all earlier ones.  Each batch is written to a folder of its own; one that is repeated after a
    failure overwrites its folder.
    """
    out = f"{home}/state"
    reader = spark.readStream.schema(_ARRIVAL)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    with _rocksdb(spark):
        query = (
            keyed_state(reader.option("recursiveFileLookup", True).parquet(arrivals))
            .writeStream.outputMode("update")
            .option("checkpointLocation", f"{home}/progress")
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
        query.awaitTermination()
    found = _read(spark, out, f"{_STATE}, batch int")
    last = query.lastProgress["batchId"] if query.lastProgress else 0
    if not last:
        return found
    # A digest is reported by every batch that touched it; its count only rises.
    return found.groupBy("digest").agg(*[F.max_by(c, "n_rows").alias(c) for c in ("first_id", "first_locator")], F.max("n_rows").alias("n_rows"), F.max("batch").alias("batch"))


def differing(rows: DataFrame, hits: DataFrame, digest) -> DataFrame:
    """The byte check of hits: (digest, text_sha256) of the rows of ``rows`` (doc_id, text, _locator) whose digest
    is among ``hits`` though their bytes differ from those at the kept row's locator.

    Rows are grouped by digest and whole text, and the group that holds the row at the kept locator is right: state and
    rows cover the same deliveries, so that row is its group's least.  Partial aggregation leaves one row per text and
    task, so a text with any number of copies is no hot key.
    """
    texts = rows.withColumn("digest", digest(F.col("text")))
    # Most texts have no copy: a filter keeps them out of the shuffle.
    texts = may_hold(texts, "digest", key_filter(hits, "digest", "dedup-filter")).where("maybe")
    least = F.min(F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), F.col("_locator").alias("at"))).alias("least")
    groups = texts.groupBy("digest", "text").agg(least).select("digest", F.sha2("text", 256).alias("text_sha256"), "least")
    return groups.join(hits, "digest").where(F.col("least.at") != F.col("first_locator")).select("digest", "text_sha256")


def exact_dedup(docs: DataFrame, files_per_batch: int | None = None, digest=None, home: str | None = None, delivery: str = "all", batches: int = 1) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    ``digest`` maps the normalised text to the key of the state; SHA-256 unless a test
    passes a weaker one to force collisions, which the byte check then resolves by text.

    With ``home`` (a shared folder of the caller) state, progress, digests and contents stay there.  A call under the
    same ``delivery`` goes on where the last one stopped, another delivery is held against all before it, and the
    result has the rows of all deliveries.  ``batches`` spreads the arrivals over so many batches, unless
    ``files_per_batch`` says how many files make one.
    """
    spark, digest = docs.sparkSession, digest or (lambda t: F.sha2(t, 256))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("text", normalised(text_or_empty()))
    if home:
        if _read(spark, f"{home}/contents/delivery={delivery}", "doc_id long").isEmpty():
            rows.write.mode("overwrite").parquet(f"{home}/contents/delivery={delivery}")
        new = located(spark.read.schema(rows.schema).parquet(f"{home}/contents/delivery={delivery}"))
        rows = located(_read(spark, f"{home}/contents", "doc_id long, text string"))
    else:
        home, rows = scratch(spark, "dedup"), located(docs).select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"), "_locator")
        new = rows
    folder = f"{home}/arrivals/delivery={delivery}"
    if _read(spark, folder, "digest string").isEmpty():
        new.select("doc_id", F.col("_locator").alias("locator"), digest(F.col("text")).alias("digest"), F.sha2("text", 256).alias("text_sha256")).write.mode("overwrite").parquet(folder)
    arrivals = spark.read.option("recursiveFileLookup", True).schema(_ARRIVAL).parquet(f"{home}/arrivals")
    if batches > 1 and not files_per_batch:
        files_per_batch = -(-len(arrivals.inputFiles()) // batches)
    groups = stream_groups(f"{home}/arrivals", home, spark, files_per_batch)
    several = groups.where("n_rows > 1")
    bad = saved(differing(rows, several, digest), "dedup-collisions").distinct()
    if bad.isEmpty():
        return _labelled(arrivals, groups.drop("batch"))
    # Different bytes under one digest: those rows get the digest of their own bytes as key.
    split = arrivals.join(bad.withColumn("other", F.lit(True)), ["digest", "text_sha256"], "left").select(
        "doc_id", "locator", F.when(F.col("other"), F.concat_ws(":", "digest", "text_sha256")).otherwise(F.col("digest")).alias("digest"), "text_sha256"
    )
    return _labelled(split, saved(keyed_state(split), "dedup-groups"))


def _labelled(arrivals: DataFrame, groups: DataFrame) -> DataFrame:
    """Arrivals with the decision of their group.  Groups of one need no join partner, so only
    digests met more than once are joined; the hot ones are split by adaptive execution."""
    several = groups.where("n_rows > 1")
    return arrivals.join(several, "digest", "left").select(
        "doc_id",
        F.when(F.col("n_rows").isNull(), F.col("doc_id")).when(F.col("first_id") != _LAST, F.col("first_id")).alias("keep_id"),
        F.coalesce("n_rows", F.lit(1)).alias("group_size"),
        (F.col("n_rows").isNull() | (F.col("locator") == F.col("first_locator"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns."""
    dropped = exact_dedup(docs).where("not kept")
    decided = saved(
        dropped.groupBy("text_sha256").agg(F.min("keep_id").alias("keep_id"), F.max(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("repeats")), "dedup-decided"
    )
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.sha2(normalised(text_or_empty()), 256).alias("key"), F.col("doc_id").cast("long").alias("id"))
    keyed = may_hold(keyed, "key", key_filter(decided, "text_sha256", "dedup-filter"))
    kept = keyed.where("maybe").join(decided, F.col("key") == F.col("text_sha256"), "left").where(F.col("text_sha256").isNull() | F.col("id").eqNullSafe(F.col("keep_id")))
    if not decided.where("repeats").isEmpty():
        # Some rows repeat both id and text: one of each stays.
        kept = kept.where("not coalesce(repeats, false)").select("row").unionByName(kept.where("repeats").dropDuplicates(["key"]).select("row"))
    # What the filter rules out has no copy and never moves.
    return keyed.where("not maybe").select("row").unionByName(kept.select("row")).select("row.*")
