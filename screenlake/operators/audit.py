"""Audits of evidence: provenance, duplicates, recomputation, limits, gates.  Results are tables of
what is wrong, so an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import paired_log_ratio


def union_stages(*stages: tuple[str, DataFrame]) -> DataFrame:
    """Rows of several collection stages with the stage's name; columns a stage lacks are null."""
    out = None
    for name, df in stages:
        df = df.withColumn("stage", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def grid_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset difference: rows of ``a`` beyond their count in ``b``."""
    return a.exceptAll(b)


def grid_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def single_provenance(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column the number of values and whether it is one."""
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "values").withColumn("single", F.col("values") == 1)


def duplicate_ids(df: DataFrame, ids: list[str]) -> DataFrame:
    return df.groupBy(*ids).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def measurement_validity(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """Ordered list of reasons that make a row invalid, and its status."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in reasons.items()]))
    return df.withColumn("reasons", found).withColumn("status", F.when(F.size("reasons") == 0, "VALID").otherwise("INVALID"))


def _observations(df: DataFrame, ids: list[str], limits: dict[str, float]) -> DataFrame:
    """A row for each row and resource with its limit."""
    long = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in limits]).unpivot(ids, list(limits), "resource", "observed")
    limit = F.element_at(F.create_map(*[F.lit(x) for p in limits.items() for x in p]), F.col("resource")).cast("double")
    return long.withColumn("limit", limit)


def resource_maxima(df: DataFrame, ids: list[str], limits: dict[str, float]) -> DataFrame:
    """Per resource its rows, how many lack it, and its greatest value with the row that holds it (ties: least ids)."""
    top = F.min(F.when(F.col("observed").isNotNull(), F.struct((-F.col("observed")).alias("_least"), *ids)))
    out = _observations(df, ids, limits).groupBy("resource", "limit").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("observed").isNull()).alias("missing"), top.alias("t"))
    return out.select("resource", "n", "missing", (-F.col("t._least")).alias("greatest"), *[F.col(f"t.{c}").alias(c) for c in ids], "limit", (-F.col("t._least") <= F.col("limit")).alias("within_limit"))


def missing_observations(df: DataFrame, ids: list[str], resources: list[str]) -> DataFrame:
    """The rows and resources without an observation."""
    return _observations(df, ids, dict.fromkeys(resources, 0.0)).where("observed IS NULL").select(*ids, "resource")


def resource_violations(df: DataFrame, ids: list[str], limits: dict[str, float]) -> DataFrame:
    """Long table of observations over their limits, or missing."""
    return _observations(df, ids, limits).where(F.col("observed").isNull() | (F.col("observed") > F.col("limit"))).withColumn("problem", F.when(F.col("observed").isNull(), "missing").otherwise("over"))


def safety_summary(events: DataFrame, group: list[str], guards: DataFrame | None = None) -> DataFrame:
    """Counters of a fault log: false rejects, wrong acceptances both ways, fail-open, forwarding and recovery
    violations, and failed guards.

    Columns: expected_valid, accepted, rejected, require_fail_open, fail_open, require_backend, backend_calls,
    recovery_check, directory_present, backend_match; ``guards``: group and passed.  An answer that is missing
    (null) counts as a failure; a group without events or guards counts 0.
    """
    valid, yes = F.col("expected_valid"), lambda c: F.coalesce(F.col(c), F.lit(False))
    counters = {
        "attempts": F.lit(True),
        "valid_attempts": valid,
        "false_rejects": valid & F.col("rejected"),
        "acceptance_failures": valid & ~yes("accepted"),
        "invalid_acceptance_failures": ~valid & F.coalesce(F.col("accepted"), F.lit(True)),
        "fail_open_expectations": F.col("require_fail_open"),
        "fail_open_violations": F.col("require_fail_open") & ~yes("fail_open"),
        "forward_violations": F.col("require_backend") & (F.coalesce("backend_calls", F.lit(0)) < 1),
        "recovery_checks": F.col("recovery_check"),
        "recovery_failures": F.col("recovery_check") & ~(yes("accepted") & ~yes("rejected") & yes("directory_present") & yes("backend_match")),
    }
    out = events.groupBy(*group).agg(*[F.count_if(c).alias(name) for name, c in counters.items()])
    if guards is None:
        return out
    held = guards.groupBy(*group).agg(F.count(F.lit(1)).alias("guard_expectations"), F.count_if(~yes("passed")).alias("guard_failures"))
    names = [*counters, "guard_expectations", "guard_failures"]
    return out.join(held, group, "full").select(*group, *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def coverage_floors(counts: DataFrame, floors: DataFrame, key: str) -> DataFrame:
    """Per scenario whether its count reaches its floor; scenarios without rows count 0."""
    return floors.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), "floor", (F.coalesce("n", F.lit(0)) >= F.col("floor")).alias("complete"))


def recompute_and_compare(df: DataFrame, stored: str, recomputed: Column, tolerance: float = 2e-12) -> DataFrame:
    """Rows whose stored value is off its recomputation by more than the relative tolerance."""
    out = df.withColumn("recomputed", recomputed)
    scale = F.greatest(F.lit(1.0), F.abs(F.col(stored)), F.abs("recomputed"))
    return out.where(~F.coalesce(F.abs(F.col(stored) - F.col("recomputed")) <= tolerance * scale, F.lit(False)))


def gate_combine(components: DataFrame, group: list[str], decision: str, name: str) -> DataFrame:
    """FAIL over INDETERMINATE over PASS, with the components that are not PASS."""
    severity = F.when(F.col(decision) == "FAIL", 2).when(F.col(decision) == "PASS", 0).otherwise(1)
    out = components.groupBy(*group).agg(F.max(severity).alias("s"), F.array_sort(F.collect_set(F.when(severity > 0, F.col(name)))).alias("reasons"))
    return out.select(*group, F.element_at(F.array(F.lit("PASS"), F.lit("INDETERMINATE"), F.lit("FAIL")), F.col("s") + 1).alias("gate"), "reasons")


def backend_work_gate(pairs: DataFrame, checks: str, distinct: str, base: str) -> DataFrame:
    """Per seed, in whole numbers: 10 checks <= 11 distinct, and the baseline did ten times the work."""
    return pairs.withColumns({"near_bound": 10 * F.col(checks) <= 11 * F.col(distinct), "tenfold": F.col(base) >= 10 * F.col(checks)}).withColumn(
        "decision", F.when(F.col("near_bound") & F.col("tenfold"), "PASS").otherwise("FAIL")
    )


def look_decision(summary: DataFrame, half_width: str, limit: float, stratum: str, timer: str, least_ratio: float) -> DataFrame:
    """Whether a first look ends: more than one stratum or too coarse a timer ends it without a result, intervals
    all within the limit end it with one, else it is extended.

    ``timer``: the least ratio of a point's measures to the clock's own cost.  A null fails its rule.
    """
    meets = lambda ok: F.every(F.coalesce(ok, F.lit(False)))
    out = summary.agg(
        F.max(half_width).alias("widest"), F.count_distinct(stratum).alias("strata"), meets(F.col(half_width) <= limit).alias("precise"), meets(F.col(timer) >= least_ratio).alias("timer_pass")
    )
    decision = F.when(F.col("strata") != 1, "STOP_STRATA").when(~F.col("timer_pass"), "STOP_TIMER").when(F.col("precise"), "STOP_PRECISE").otherwise("EXTEND")
    return out.withColumn("decision", decision)


def invalid_reason_subset(df: DataFrame, reasons: str, allowed: list[str]) -> DataFrame:
    extra = F.array_except(reasons, F.array(*map(F.lit, allowed)))
    return df.withColumn("only_allowed", F.size(extra) == 0)


def state_invariants(snapshots: DataFrame) -> DataFrame:
    """Snapshots that break an invariant, with the invariants' names.

    Columns: cached (array), valid (array), edge_certain, edge_version, directory_version, backend_version.
    """
    rules = {
        "cached_proof_contradicts_valid_set": F.arrays_overlap("cached", "valid"),
        "edge_certain_but_stale": F.col("edge_certain") & (F.col("edge_version") < F.col("directory_version")),
        "directory_and_backend_diverged": F.col("directory_version") != F.col("backend_version"),
    }
    return measurement_validity(snapshots, rules).where("status = 'INVALID'").drop("status")


def grid_refinement_audit(coarse: DataFrame, fine: DataFrame, keys: list[str], at: str, value: str, tolerance: float) -> DataFrame:
    """Coarse points missing from the fine grid, midpoints missing from it, and points whose value
    changed by more than the tolerance."""
    f = fine.select(*keys, at, F.col(value).alias("_fine"))
    missing = coarse.join(f, [*keys, at], "left_anti").select(*keys, F.col(at).cast("double").alias(at), F.lit("missing").alias("problem"))
    following = F.lead(at).over(Window.partitionBy(*keys).orderBy(at))
    mids = coarse.withColumn("_n", following).where("_n is not null").select(*keys, ((F.col(at) + F.col("_n")) / 2).alias(at))
    no_mid = mids.join(f.select(*keys, F.col(at).cast("double").alias(at)), [*keys, at], "left_anti").withColumn("problem", F.lit("no midpoint"))
    moved = coarse.join(f, [*keys, at]).where(F.abs(F.col(value) - F.col("_fine")) > tolerance * F.abs(F.col(value))).select(*keys, F.col(at).cast("double").alias(at), F.lit("moved").alias("problem"))
    return missing.unionByName(no_mid).unionByName(moved)


def replay_identities(rows: DataFrame) -> DataFrame:
    """Rows of replay counters that break an accounting identity, with the identities' names."""
    rules = {
        "hits_and_misses": F.col("hits") + F.col("misses") != F.col("positives"), "confirmations": F.col("misses") != F.col("confirmations"), "checks": F.col("checks") != F.col("confirmations") + F.col("races"),
        "admitted": F.col("admitted") > F.col("confirmations"), "removed": F.col("evictions") + F.col("expirations") > F.col("admitted"),
    }
    return measurement_validity(rows, rules).where("status = 'INVALID'").drop("status")


def replication_check(old: DataFrame, new: DataFrame, relation: list[str], candidate: str, baseline: str, alpha: float, relations: int, threshold: float) -> DataFrame:
    """Each relation decided on old and on new pairs, and whether the decisions agree."""
    decide = lambda df: paired_log_ratio(df, relation, candidate, baseline, alpha, relations, threshold, "upper").select(*relation, "decision")
    return decide(old).withColumnRenamed("decision", "old").join(decide(new).withColumnRenamed("decision", "new"), relation, "full").withColumn("agrees", F.col("old").eqNullSafe(F.col("new")))


def discrepancy_check(rows: DataFrame, observed: str, analytic: str, density: str, k: int, tolerance: float) -> DataFrame:
    """Rows whose observed rate differs from the analytic one, with whether the realised density explains it."""
    realised = F.pow(F.col(density), k)
    off = F.abs(F.col(observed) - F.col(analytic)) > tolerance
    return rows.where(off).withColumn("explained", F.abs(F.col(observed) - realised) <= tolerance)


def index_evidence_audit(rows: DataFrame, index: str, expected: int, value: str, limit: float) -> DataFrame:
    """Coverage of indices 0..n-1, duplicates, and the greatest value against its limit."""
    per = rows.groupBy(index).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("v"))
    inside = (F.col(index) >= 0) & (F.col(index) < expected)
    return per.agg((F.lit(expected) - F.count_if(inside)).alias("missing"), F.count_if(~inside).alias("outside"), F.count_if(F.col("n") > 1).alias("duplicated"), F.max("v").alias("greatest"), (F.max("v") <= limit).alias("within_limit"))
