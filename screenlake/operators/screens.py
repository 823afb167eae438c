"""Membership screens as Spark jobs: exact, fingerprint and Bloom, and what they forward.

A screen is built once per member set and probed by joins.  Attempts are reduced to distinct
tuples before they probe, so repeats cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.scratch import saved


def exact_screen(attempts: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Attempts with ``represented``: whether the member set holds their key."""
    known = members.select(*keys).distinct().withColumn("_known", F.lit(True))
    return attempts.join(known, keys, "left").withColumn("represented", F.coalesce("_known", F.lit(False))).drop("_known")


def tag_screen(attempts: DataFrame, members: DataFrame, account: str, token: str, bits: int) -> DataFrame:
    """Attempts with ``represented``: equality of the account's b-bit fingerprints."""
    tag = S.token_prefix(token, bits)
    known = members.select(account, tag.alias("_tag")).distinct().withColumn("_known", F.lit(True))
    return attempts.withColumn("_tag", tag).join(known, [account, "_tag"], "left").withColumn("represented", F.coalesce("_known", F.lit(False))).drop("_known", "_tag")


def bloom_build(members: DataFrame, positions: Column) -> DataFrame:
    """The set bits as a table (position)."""
    return members.select(F.explode(positions).alias("position")).distinct()


def bloom_pack(bits: DataFrame) -> DataFrame:
    """The set bits packed into 32-bit words (word, bits)."""
    word = F.floor(F.col("position") / 32).cast("long")
    bit = F.expr("shiftleft(1L, cast(position % 32 as int))")
    return bits.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))


#: A filter of at most so many bits (16 MB) is carried to the queries; a larger one is asked by joins.
CARRIED_BITS = 1 << 27


def bloom_probe(queries: DataFrame, keys: list[str], positions: Column, bits: DataFrame, k: int, m: int) -> DataFrame:
    """Distinct keys with ``represented`` (all k places set) and ``probes`` (places read until the first zero).

    ``m`` is the filter's size.  Up to CARRIED_BITS it goes to the tasks whole and no query moves.  Beyond, the
    places are asked one after the other and only queries that are still alive go on, so a query moves as often as it
    probes: about twice for one that is not a member."""
    asked = queries.select(*keys, positions.alias("_at"))
    return _probe_carried(asked, keys, bits, k, m) if m <= CARRIED_BITS else _probe_in_turn(asked, keys, bits, k)


def _probe_carried(asked: DataFrame, keys: list[str], bits: DataFrame, k: int, m: int) -> DataFrame:
    words = np.zeros(-(-m // 32), np.uint32)
    for word, value in bloom_pack(bits).toLocalIterator():
        words[word] = value
    carried = asked.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = carried.value
        for b in batches:
            at = b.column(len(keys)).flatten().to_numpy().reshape(-1, k)
            hit = (words[at >> 5] >> (at & 31).astype(np.uint32)) & 1
            probes = np.where(hit.all(axis=1), k, np.argmin(hit, axis=1) + 1)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(hit.all(axis=1)), pa.array(probes.astype(np.int64))], [*keys, "represented", "probes"])

    types = dict(asked.dtypes)
    return asked.mapInArrow(run, ", ".join([f"`{c}` {types[c]}" for c in keys] + ["represented boolean", "probes long"]))


def _probe_in_turn(asked: DataFrame, keys: list[str], bits: DataFrame, k: int) -> DataFrame:
    known = bits.select(F.col("position").alias("_p"), F.lit(True).alias("_set"))
    alive, out = asked, []
    for i in range(k):
        met = saved(alive.join(known, F.element_at("_at", i + 1) == F.col("_p"), "left").drop("_p"), "probe")
        out.append(met.where("_set is null").select(*keys, F.lit(False).alias("represented"), F.lit(i + 1).cast("long").alias("probes")))
        alive = met.where("_set").drop("_set")
    out.append(alive.select(*keys, F.lit(True).alias("represented"), F.lit(k).cast("long").alias("probes")))
    return reduce(DataFrame.unionByName, out)


def blocked_bloom_build(members: DataFrame, positions: Column, k: int) -> DataFrame:
    """A row per block of 512 bits: block and its eight words.  A member sets its bits in one row of masks; nothing is
    exploded."""
    rows = members.select(positions.alias("_at"))
    rows = rows.select(F.floor(F.element_at("_at", 1) / 512).cast("long").alias("block"), F.transform("_at", lambda p: p % 512).alias("_bits"))
    one = F.expr("transform(_bits, b -> shiftleft(1L, cast(b % 64 as int)))")
    word = F.transform("_bits", lambda b: F.floor(b / 64).cast("int"))
    rows = rows.select("block", one.alias("_ones"), word.alias("_words"))
    masks = []
    for w in range(8):
        mask = F.lit(0).cast("long")
        for i in range(k):
            mask = mask.bitwiseOR(F.when(F.element_at("_words", i + 1) == w, F.element_at("_ones", i + 1)).otherwise(F.lit(0).cast("long")))
        masks.append(F.bit_or(mask).alias(f"w{w}"))
    return rows.groupBy("block").agg(*masks)


def blocked_bloom_probe(queries: DataFrame, keys: list[str], positions: Column, blocks: DataFrame, k: int) -> DataFrame:
    """``bloom_probe`` against blocks: one equi-join on the block, then bit tests in its words.  A query is one row."""
    asked = queries.select(*keys, positions.alias("_at")).withColumn("block", F.floor(F.element_at("_at", 1) / 512).cast("long"))
    words = blocks.select("block", F.array(*[F.col(f"w{w}") for w in range(8)]).alias("_words"))
    met = asked.join(words, "block", "left")
    hits = F.expr("transform(_at, p -> coalesce(shiftright(element_at(_words, cast(floor((p % 512) / 64) as int) + 1), cast(p % 64 as int)) & 1, 0L))")
    met = met.withColumn("_miss", F.array_position(hits, 0))
    return met.select(*keys, (F.col("_miss") == 0).alias("represented"), F.when(F.col("_miss") == 0, k).otherwise(F.col("_miss")).cast("long").alias("probes"))


def bit_density(bits: DataFrame, m: int) -> DataFrame:
    return bits.agg(F.count(F.lit(1)).alias("set_bits"), (F.count(F.lit(1)) / m).alias("density"))


def blocked_realised_fpr(bits: DataFrame, blocks: int, k: int) -> DataFrame:
    """Mean over blocks of (occupied / 512) ^ k; empty blocks count zero."""
    per = bits.groupBy(F.floor(F.col("position") / 512).alias("block")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg((F.sum(F.pow(F.col("n") / 512.0, k)) / blocks).alias("realised_fpr"))


def false_forward_rates(screened: DataFrame, keys: list[str], region: str) -> DataFrame:
    """Rates at which invalid tuples are forwarded: by first-seen tuple, by request, and in the worst region.

    ``screened``: one row per attempt with ``invalid`` and ``represented``.
    """
    tuples = screened.where("invalid").groupBy(region, *keys).agg(F.count(F.lit(1)).alias("n"), F.max("represented").alias("p"))
    per = tuples.groupBy(region).agg(F.count(F.lit(1)).alias("t"), F.count_if("p").alias("tp"), F.sum("n").alias("r"), F.sum(F.when(F.col("p"), F.col("n")).otherwise(0)).alias("rp"))
    return per.agg(
        F.try_divide(F.sum("tp"), F.sum("t")).alias("first_seen_ffr"), F.try_divide(F.sum("rp"), F.sum("r")).alias("request_ffr"), F.max(F.try_divide("tp", "t")).alias("worst_region_ffr")
    )


def false_positive_discovery(stream: DataFrame, run: str, at: str, need: int, need_same: int) -> DataFrame:
    """Per run: positions scanned until enough positives overall and enough in one account.

    ``stream``: run, position, account, positive.
    """
    overall = F.sum(F.col("positive").cast("int")).over(Window.partitionBy(run).orderBy(at))
    same = F.sum(F.col("positive").cast("int")).over(Window.partitionBy(run, "account").orderBy(at))
    rows = stream.withColumns({"_n": overall, "_s": same})
    out = rows.groupBy(run).agg(F.min(F.when(F.col("_n") >= need, F.col(at))).alias("overall_at"), F.min(F.when(F.col("_s") >= need_same, F.col(at))).alias("same_at"))
    both = F.when(F.col("overall_at").isNotNull() & F.col("same_at").isNotNull(), F.greatest("overall_at", "same_at"))
    return out.select(run, "overall_at", "same_at", both.alias("scanned"))


def select_conditioned(positives: DataFrame, run: str, at: str, k: int, same_account: bool) -> DataFrame:
    """Per run the first k positives, or those of the first account that has k of them."""
    if not same_account:
        return positives.withColumn("_r", F.row_number().over(Window.partitionBy(run).orderBy(at))).where(F.col("_r") <= k).drop("_r")
    rows = positives.withColumn("_r", F.row_number().over(Window.partitionBy(run, "account").orderBy(at)))
    first = rows.where(F.col("_r") == k).groupBy(run).agg(F.min_by("account", at).alias("account"))
    return rows.where(F.col("_r") <= k).join(first, [run, "account"], "left_semi").drop("_r")


def member_false_negatives(members: DataFrame, screened: DataFrame, keys: list[str]) -> DataFrame:
    """Number of members the screen rejects; a sound screen has none."""
    return members.join(screened.where("represented"), keys, "left_anti").agg(F.count(F.lit(1)).alias("false_negatives"))


def snapshot_intersection(snapshots: DataFrame, key: str, p: str, weight: str) -> DataFrame:
    """Mass of identities that all snapshots let through, and its expectation, the product per identity."""
    per = snapshots.groupBy(key).agg(F.bool_and("passed").alias("all_pass"), F.max(weight).alias("w"), F.min(p).alias("low"), F.sum(F.when(F.col(p) > 0, F.log(p))).alias("log_p"))
    product = F.when(F.col("low") == 0, 0.0).otherwise(F.exp("log_p"))
    return per.agg(F.sum(F.when(F.col("all_pass"), F.col("w")).otherwise(0.0)).alias("survived_mass"), F.sum(F.col("w") * product).alias("expected_mass"))


def member_snapshot(accounts: DataFrame, boundary: int, churn: int, rotation: int, key: str) -> DataFrame:
    """The current credential of each account at an event index."""
    scope = S.scope_at(F.lit(boundary), "account", churn, rotation)
    rows = accounts.select("account", scope["generation"].alias("generation"), scope["version"].alias("version"))
    return rows.withColumn("token", S.stable_token(key, "account", "generation", "version"))


def compact_members(base: DataFrame, delta: DataFrame, keys: list[str], epoch: int) -> DataFrame:
    """Base and delta merged under a new epoch, each key once."""
    return base.select(*keys).unionByName(delta.select(*keys)).distinct().withColumn("epoch", F.lit(epoch).cast("long"))


def delta_retirable(base: DataFrame, delta: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Per group: delta keys that the base lacks; only a group with none may retire its delta."""
    missing = delta.select(*keys).distinct().join(base.select(*keys), keys, "left_anti").groupBy(*by).agg(F.count(F.lit(1)).alias("missing"))
    groups = delta.select(*by).distinct()
    return groups.join(missing, by, "left").select(*by, F.coalesce("missing", F.lit(0)).alias("missing"), F.col("missing").isNull().alias("retirable"))


def prescreen(attempts: DataFrame, directory: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """End to end: resolve the account's record, derive the token under its scope, ask the screen.

    Accounts without a record fail open.
    """
    known = members.select(F.col("token").alias("derived")).distinct().withColumn("_known", F.lit(True))
    rows = attempts.join(directory, "account", "left").withColumn("derived", S.stable_token(key, "account", "current_generation", "current_version", "secret"))
    rows = rows.join(known, "derived", "left")
    decision = F.when(F.col("current_version").isNull(), "FAIL_OPEN").when(F.col("_known"), "POSITIVE").otherwise("NEGATIVE")
    return rows.withColumn("decision", decision).drop("_known")
