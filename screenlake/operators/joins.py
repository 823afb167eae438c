"""Joins of evidence and state: baselines, as-of directories, certificates, grids, fronts."""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import saved
from .ordered import HOT_ROWS, numbered, running, width_of

#: Most points of a block of a front in three criteria, one task's work.
FRONT_BLOCK = 1 << 17


def pair_with_baseline(rows: DataFrame, baseline: str, method: str, keys: list[str], values: list[str], must_match: list[str] = ()) -> DataFrame:
    """Each other method's row beside the baseline's of the same keys, with the paired fields that disagree."""
    base = rows.where(F.col(method) == baseline).select(*keys, *[F.col(c).alias(f"base_{c}") for c in (*values, *must_match)])
    out = rows.where(F.col(method) != baseline).join(base, keys)
    differs = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"base_{c}")), F.lit(c)) for c in must_match])) if must_match else F.array().cast("array<string>")
    return out.withColumn("mismatched", differs)


def directory_asof(attempts: DataFrame, versions: DataFrame, replicas: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """The directory state an edge sees at each attempt.

    ``attempts`` (event_index, edge, account), ``versions`` (account, version, valid_from: authoritative),
    ``replicas`` (edge, account, version, valid_from: what reached the edge).  MISSING: no
    authoritative record; UNCERTAIN: the edge has no replica; STALE: the edge's version is behind.
    One union and one running value per side replace a range join; an account of any share of the attempts is
    cut into slices of its time.
    """
    if aliases is not None:
        a = aliases.select(F.col("alias").alias("account"), F.col("canonical"))
        attempts = attempts.join(a, "account", "left").withColumn("account", F.coalesce("canonical", "account")).drop("canonical")

    def latest(log: DataFrame, keys: list[str], name: str, rows: DataFrame) -> DataFrame:
        both = rows.select(*rows.columns, F.col("event_index").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_v")).unionByName(
            log.select(*keys, F.col("valid_from").alias("_at"), F.lit(0).alias("_side"), F.col("version").alias("_v")), allowMissingColumns=True
        )
        return running(both, keys, ["_at", "_side", "_v"], {name: ("last", "_v")}).where("_side = 1").drop("_at", "_side", "_v")

    rows = latest(versions, ["account"], "current", attempts)
    rows = latest(replicas, ["edge", "account"], "seen", rows)
    status = F.when(F.col("current").isNull(), "MISSING").when(F.col("seen").isNull(), "UNCERTAIN").when(F.col("seen") != F.col("current"), "STALE").otherwise("PRESENT")
    return rows.withColumn("status", status)


def certificate_cover(views: DataFrame, certificates: DataFrame, scope: list[str], current_epoch: DataFrame) -> DataFrame:
    """Views with ``covered``: a certificate of the same edge and scope, not behind the view's directory
    epoch, made for the current representation epoch."""
    good = certificates.join(current_epoch, scope).where("representation_epoch = current_epoch").groupBy("edge", *scope).agg(F.max("watermark").alias("watermark"))
    return views.join(good, ["edge", *scope], "left").withColumn("covered", F.coalesce(F.col("watermark") >= F.col("directory_epoch"), F.lit(False))).drop("watermark")


def coverage_diff(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Grid points that are missing from, or extra in, the observations."""
    e, o = expected.select(*keys).distinct(), observed.select(*keys).distinct()
    return e.join(o, keys, "left_anti").withColumn("problem", F.lit("missing")).unionByName(o.join(e, keys, "left_anti").withColumn("problem", F.lit("extra")))


def case_pairs(df: DataFrame, keys: list[str], case: str, value: str) -> DataFrame:
    """All unordered pairs of cases within the keys; ``df`` has one row per key and case."""
    right = df.select(*keys, F.col(case).alias("case_b"), F.col(value).alias("value_b"))
    return df.select(*keys, F.col(case).alias("case_a"), F.col(value).alias("value_a")).join(right, keys).where("case_a < case_b")


def pareto_front(df: DataFrame, mins: list[str], group: list[str], hot_rows: int = HOT_ROWS, block: int = FRONT_BLOCK) -> DataFrame:
    """Rows no other row of the group dominates (no worse in all of ``mins``, better in one).

    Two criteria: a running minimum over the sorted group.  Three: see ``_front_of_three``.  A row with a null
    criterion is on no front and beats none.
    """
    for c in mins:
        df = df.where(F.col(c).isNotNull())
    if len(mins) == 2:
        x, y = mins
        # Per x only its least y can survive; it must be under every y of smaller x.
        per_x = df.groupBy(*group, x).agg(F.min(y).alias("_y"))
        front = running(per_x, group, [x], {"_b": ("min", "_y")}, before=True, hot_rows=hot_rows)
        front = front.where(F.col("_b").isNull() | (F.col("_y") < F.col("_b"))).select(*group, x, F.col("_y").alias(y))
    else:
        front = _front_of_three(df, mins, group, hot_rows, block)
    keys = [*group, *mins]
    return df.join(front.select(*[F.col(c).alias(f"_f{i}") for i, c in enumerate(keys)]), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_f{i}")) for i, c in enumerate(keys)]), "left_semi")


def _front_of_three(df: DataFrame, mins: list[str], group: list[str], hot_rows: int, block: int) -> DataFrame:
    """The different points (group, mins) on the fronts, by divide and conquer.

    Points in the order of (group, first, second, third criterion) are cut into equal blocks.  A block keeps its own
    front (a staircase of the other two criteria).  Then blocks merge in pairs: a point on the right is beaten if
    the least third criterion among points on the left with no greater second is no greater than its own, a running
    minimum.  Beaten points beat nothing that others don't, so each round sorts fronts only."""
    x, y, z = mins
    points = numbered(df.groupBy(*group, x, y).agg(F.min(z).alias(z)), [*group, x, y], "_i")
    n = points.count()
    blocks = max(1, min(n, width_of(points)), -(-n // block))
    points = points.withColumn("_block", F.floor(F.col("_i") / max(1, -(-n // blocks))).cast("long")).drop("_i")
    types = dict(points.dtypes)

    def own(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in (*group, x, y, z)])
        of = list(zip(*(table.column(c).to_pylist() for c in group))) if group else [()] * len(table)
        now, ys, zs, kept = None, [], [], []
        for k, (g, b, c) in enumerate(zip(of, table.column(y).to_pylist(), table.column(z).to_pylist())):
            if g != now:
                now, ys, zs = g, [], []
            # The staircase: second criterion rising, third falling.
            at = bisect_right(ys, b)
            if at and zs[at - 1] <= c:
                continue
            kept.append(k)
            stop = at
            while stop < len(ys) and zs[stop] >= c:
                stop += 1
            start = at - 1 if at and ys[at - 1] == b else at
            ys[start:stop], zs[start:stop] = [b], [c]
        return table.take(pa.array(kept, pa.int64()))

    front = saved(points.groupBy("_block").applyInArrow(own, ", ".join(f"`{c}` {t}" for c, t in points.dtypes)), "front")
    while blocks > 1:
        blocks = (blocks + 1) // 2
        sides = front.withColumns({"_side": F.col("_block") % 2, "_block": F.floor(F.col("_block") / 2).cast("long")})
        sides = sides.withColumn("_left", F.when(F.col("_side") == 0, F.col(z)).cast(types[z]))
        met = running(sides, [*group, "_block"], [y, "_side"], {"_least": ("min", "_left")}, hot_rows=hot_rows)
        front = saved(met.where((F.col("_side") == 0) | F.col("_least").isNull() | (F.col("_least") > F.col(z))).drop("_side", "_left", "_least"), "front")
    return front.drop("_block")


def certified_front(df: DataFrame, group: list[str], memory: str, low: str, high: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows whose lower bound no other row's upper bound beats at no more memory.

    The least upper bound at smaller or equal memory decides; a row does not dominate itself because
    low <= high.
    """
    best = df.groupBy(*group, memory).agg(F.min(high).alias("_h"))
    best = running(best, group, [memory], {"_least": ("min", "_h")}, hot_rows=hot_rows).drop("_h").withColumnRenamed("_least", "_h")
    return df.join(best, [*group, memory]).where(F.col(low) <= F.col("_h")).drop("_h")


def expand_grid(spark, axes: dict[str, list], rows: DataFrame | None = None, when: dict[str, Column] | None = None) -> DataFrame:
    """The grid of all combinations of the axes' values, a bounded list each, for each of ``rows`` if given.

    ``when`` has conditions over earlier axes: an axis whose condition fails is null in one row instead of spread.
    """
    out = rows if rows is not None else spark.range(1).select()
    for name, values in axes.items():
        spread = F.array(*map(F.lit, values))
        if when and name in when:
            spread = F.when(when[name], spread).otherwise(F.array(F.lit(None)))
        out = out.withColumn(name, F.explode(spread))
    return out


def replicate_trace(keys: DataFrame, key: str, rank: str, multiplicity: int, order: str, interval_ms: int, n_keys: int) -> DataFrame:
    """Each key ``multiplicity`` times, grouped or round robin; ``rank`` numbers the keys from 0."""
    rows = keys.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(multiplicity - 1))))
    pos = F.col(rank) * multiplicity + F.col("copy") if order == "grouped" else F.col("copy") * n_keys + F.col(rank)
    return rows.select(key, "copy", pos.cast("long").alias("pos"), (pos * interval_ms).cast("long").alias("ts_ms"))


def reference_integrity(calls: DataFrame, registry: DataFrame) -> DataFrame:
    """Calls whose caller or callee is not registered with the same role and endpoint, or whose
    connection id repeats."""
    r = registry.select(F.col("session"), F.col("role").alias("_role"), F.col("endpoint").alias("_endpoint"), F.lit(True).alias("_known"))
    out = calls
    for side in ("caller", "callee"):
        s = r.select(*[F.col(c).alias(f"{side}{c}" if c != "session" else side) for c in r.columns])
        out = out.join(s, side, "left").withColumn(
            f"{side}_problem",
            F.when(F.col(f"{side}_known").isNull(), "unregistered").when(F.col(f"{side}_role") != F.col(f"{side}_is"), "role").when(F.col(f"{side}_endpoint") != F.col(f"{side}_at"), "endpoint"),
        ).drop(f"{side}_role", f"{side}_endpoint", f"{side}_known")
    repeated = calls.groupBy("connection").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("connection", F.lit(True).alias("repeated"))
    out = out.join(repeated, "connection", "left").withColumn("repeated", F.coalesce("repeated", F.lit(False)))
    return out.where(F.col("caller_problem").isNotNull() | F.col("callee_problem").isNotNull() | F.col("repeated"))


def within_budget(specs: DataFrame, budgets: DataFrame, n_items: int, overhead: int) -> DataFrame:
    """Specs under each budget: memory <= ceil(n * bits / 8) + overhead.  Budgets are a short list."""
    limit = F.ceil(F.lit(n_items) * F.col("bits") / 8) + overhead
    return specs.join(F.broadcast(budgets.withColumn("limit_bytes", limit)), F.col("memory") <= F.col("limit_bytes"))
