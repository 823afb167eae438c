"""Saturation curves: safe points, brackets, capacity bounds, and ranking of configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import pareto_front, within_budget
from .stats import log_t_summary, paired_log_ratio


# The statuses of a curve.
INVALID_ROWS, NO_BASELINE = "INVALID_MEASUREMENT_ROWS", "BASELINE_REFERENCE_INVALID"
CENSORED, BELOW, BRACKETED = "LOWER_BOUND_CENSORED", "BELOW_TESTED_GRID", "BRACKETED"


def safe_points(rows: DataFrame, baseline: str, keys: list[str], max_timeout: float, max_drop: float, min_throughput: float, regression: float) -> DataFrame:
    """Flags of each point: timeouts, drops, throughput (``succeeded`` of ``offered``), whether it is
    ``operational`` (valid and these three), latency against the baseline method at the same keys, and whether
    it passes all."""
    base = rows.where(F.col("method") == baseline).select(*keys, F.col("p99").alias("base_p99"), F.col("valid").alias("base_valid"))
    out = rows.join(base, keys, "left")
    flags = {
        "timeout_pass": F.coalesce(F.try_divide("timed_out", "offered") <= max_timeout, F.lit(False)),
        "drop_pass": F.coalesce(F.try_divide("dropped", "offered") <= max_drop, F.lit(False)),
        "throughput_pass": F.coalesce(F.col("succeeded") >= F.col("offered") * min_throughput, F.lit(False)),
        "p99_pass": F.coalesce(F.col("base_valid") & (F.col("p99") <= F.col("base_p99") * (1 + regression)), F.lit(False)),
    }
    out = out.withColumns(flags).withColumn("operational", F.col("valid") & F.col("timeout_pass") & F.col("drop_pass") & F.col("throughput_pass"))
    return out.withColumn("passed", F.col("operational") & F.col("p99_pass"))


def bracket_saturation(points: DataFrame, curve: list[str], load: str) -> DataFrame:
    """Per curve the last safe load before the first failure, that failure, and the status.

    ``points``: load, ``passed``, ``valid``, ``base_valid``.
    """
    first_fail = F.min(F.when(~F.col("passed"), F.col(load))).over(Window.partitionBy(*curve))
    rows = points.withColumn("first_fail", first_fail)
    safe = F.col("passed") & (F.col("first_fail").isNull() | (F.col(load) < F.col("first_fail")))
    out = rows.groupBy(*curve).agg(
        F.max(F.when(safe, F.col(load))).alias("lower"), F.max("first_fail").alias("upper"),
        (F.count_if(F.col("passed") & (F.col(load) > F.col("first_fail"))) > 0).alias("nonmonotone"),
        F.bool_or(~F.col("valid")).alias("invalid"), F.bool_or(~F.coalesce("base_valid", F.lit(False))).alias("no_baseline"),
    )
    status = (
        F.when(F.col("invalid"), INVALID_ROWS).when(F.col("no_baseline"), NO_BASELINE).when(F.col("upper").isNull(), CENSORED)
        .when(F.col("lower").isNull(), BELOW).otherwise(BRACKETED)
    )
    known = ~(F.col("invalid") | F.col("no_baseline"))
    return out.withColumn("status", status).select(*curve, F.when(known, F.col("lower")).alias("lower"), F.when(known, F.col("upper")).alias("upper"), "nonmonotone", "status")


def summarize_saturation(brackets: DataFrame, method: str, seed: str, baseline: str, strata: list[str]) -> DataFrame:
    """Per method: number of curves and brackets, mean ends, and the range of differences from the
    baseline's interval on the same seeds."""
    base = brackets.where(F.col(method) == baseline).select(seed, *strata, F.col("lower").alias("_l"), F.col("upper").alias("_u"))
    rows = brackets.join(base, [seed, *strata], "left")
    return rows.groupBy(method, *strata).agg(
        F.count(F.lit(1)).alias("curves"), F.count_if(F.col("status") == BRACKETED).alias("bracketed"), F.avg("lower").alias("mean_lower"), F.avg("upper").alias("mean_upper"),
        F.avg(F.col("lower") - F.col("_u")).alias("least_difference"), F.avg(F.col("upper") - F.col("_l")).alias("greatest_difference"),
    )


def extreme_points(points: DataFrame, curve: list[str], load: str) -> DataFrame:
    """Greatest passing and least failing load with their point ids."""
    return points.groupBy(*curve).agg(
        F.max(F.when(F.col("passed"), F.col(load))).alias("max_safe"), F.min(F.when(~F.col("passed"), F.col(load))).alias("min_fail"),
        F.max_by(F.when(F.col("passed"), F.col("checks")), F.when(F.col("passed"), F.col(load))).alias("checks_at_max_safe"),
    )


def capacity_lower_bound(points: DataFrame, profile: str, seed: str, load: str, capacity: str, alpha: float, seeds: int) -> DataFrame:
    """Per profile: geometric mean and one-sided simultaneous lower bound of the capacity at each
    seed's greatest safe load; INDETERMINATE unless every seed has one."""
    best = points.where(F.col("passed") & (F.col(load) > 0)).groupBy(profile, seed).agg(F.max_by(capacity, load).alias("capacity"))
    out = log_t_summary(best, [profile], "capacity", 2 * alpha)
    ok = F.col("n") == seeds
    return out.select(profile, "n", F.when(ok, F.col("geometric_mean")).alias("geometric_mean"), F.when(ok, F.col("ci_low")).alias("lower_bound"), F.when(ok, "VALID_COMPLETE").otherwise("INDETERMINATE").alias("status"))


def saturation_ratio(brackets: DataFrame, method: str, seed: str, strata: list[str], baseline: str, alpha: float, relations: int, threshold: float) -> DataFrame:
    """Candidate's safe lower end over the baseline's failing upper end per seed, as a paired log ratio,
    with the number of seeds that lack an end."""
    base = brackets.where(F.col(method) == baseline).select(seed, *strata, F.col("upper").alias("_u"))
    pairs = brackets.where(F.col(method) != baseline).join(base, [seed, *strata])
    lacking = pairs.groupBy(method, *strata).agg(F.count_if(F.col("lower").isNull()).alias("no_candidate_end"), F.count_if(F.col("_u").isNull()).alias("no_baseline_end"))
    ratio = paired_log_ratio(pairs, [method, *strata], "lower", "_u", alpha, relations, threshold, "lower")
    return lacking.join(ratio, [method, *strata], "left")


def p99_at_common_safe_load(points: DataFrame, seed: str, strata: list[str], load: str, baseline: str, alpha: float, relations: int, threshold: float) -> DataFrame:
    """Latency ratio at the greatest load both methods pass, per seed, as a paired log ratio."""
    ok = points.where("passed")
    base = ok.where(F.col("method") == baseline).select(seed, *strata, load, F.col("p99").alias("_p"))
    both = ok.where(F.col("method") != baseline).join(base, [seed, *strata, load])
    top = both.groupBy("method", seed, *strata).agg(F.max_by("p99", load).alias("p99"), F.max_by("_p", load).alias("_p"))
    return paired_log_ratio(top, ["method", *strata], "p99", "_p", alpha, relations, threshold, "upper")


def budget_candidates(specs: DataFrame, budgets: DataFrame, group: list[str], n_items: int, overhead: int, order: list[str]) -> DataFrame:
    """Per group and budget the front's first row by ``order`` within the budget."""
    front = pareto_front(specs, ["memory", "ffr"], group)
    fits = within_budget(front, budgets, n_items, overhead)
    key = F.struct(*[F.col(c) for c in order])
    return fits.groupBy(*group, "bits").agg(F.min(key).alias("best")).select(*group, "bits", "best.*")


def matched_neighbors(specs: DataFrame, group: list[str], axis: str, ident: str) -> DataFrame:
    """The specs next below and above on the tuning axis."""
    w = Window.partitionBy(*group).orderBy(axis, ident)
    return specs.select(*group, ident, F.lag(ident).over(w).alias("lower"), F.lead(ident).over(w).alias("upper"))


def best_by(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Deterministic least row by the metric and its ties."""
    return df.groupBy(*group).agg(F.min(F.struct(*order, value)).alias("b")).select(*group, F.col(f"b.{order[0]}").alias(order[0]), F.col(f"b.{value}").alias(value))


def quantile_partition(bins: DataFrame, bin_: str, mass: str, regions: int) -> DataFrame:
    """Cuts of a bounded grid of bins into regions at the boundaries nearest to the mass quantiles.

    Each cut leaves room for the others.  ``bins`` has one row per bin, numbered from 0.  A fold over the
    quantiles picks each cut from the prefix sums, held as one array.
    """
    w = Window.orderBy(bin_)  # the grid is bounded by its resolution, not by the data
    prefix = bins.select(F.col(bin_).alias("bin"), F.sum(mass).over(w).alias("upto"))
    sums = prefix.agg(F.array_sort(F.collect_list(F.struct("bin", "upto"))).alias("p")).select(F.transform("p", lambda x: x["upto"]).alias("p")).withColumn("n", F.size("p"))

    def step(cuts, q):
        low = F.when(F.size(cuts) == 0, 1).otherwise(F.element_at(cuts, -1) + 1)
        options = F.sequence(low, F.col("n") - (regions - q))
        distance = F.transform(options, lambda c: F.struct(F.abs(regions * F.element_at("p", c) - q * F.element_at("p", F.col("n"))).alias("d"), c.alias("c")))
        return F.concat(cuts, F.array(F.array_min(distance)["c"]))

    cuts = F.aggregate(F.sequence(F.lit(1), F.lit(regions - 1)), F.array().cast("array<int>"), step)
    return sums.select(F.posexplode(cuts).alias("cut_index", "cut"))


def interval_kl(bins: DataFrame, bin_: str, p: str, q: str) -> DataFrame:
    """Smoothed divergence term of every run of bins [start, stop) of a bounded grid.

    Each bin counts half more than it holds; prefix sums make a run a difference.
    """
    w = Window.orderBy(bin_)
    s = bins.select(F.col(bin_).alias("bin"), F.sum(F.col(p) + 0.5).over(w).alias("p"), F.sum(F.col(q) + 0.5).over(w).alias("q"))
    total = s.agg(F.max("p").alias("tp"), F.max("q").alias("tq"))
    ends = s.select((F.col("bin") + 1).alias("stop"), F.col("p").alias("p1"), F.col("q").alias("q1"))
    starts = s.select((F.col("bin") + 1).alias("start"), F.col("p").alias("p0"), F.col("q").alias("q0")).unionByName(bins.sparkSession.sql("SELECT 0L AS start, 0.0D AS p0, 0.0D AS q0"))
    rows = ends.join(F.broadcast(starts), F.col("start") < F.col("stop")).join(F.broadcast(total), F.lit(True))
    mp, mq = (F.col("p1") - F.col("p0")) / F.col("tp"), (F.col("q1") - F.col("q0")) / F.col("tq")
    return rows.select("start", "stop", (mp * F.log(mp / mq)).alias("kl"))


def allocation_sweep(problems: DataFrame, lambdas: list[float], nus: list[float]) -> DataFrame:
    """Per instance the best weak-duality bound over a grid of multipliers, and the best feasible
    objective among the minimisers.

    ``problems``: instance, a, weight, compromise, low, high, budget, floor (one row per region).
    """
    grid = problems.withColumn("lam", F.explode(F.array(*map(F.lit, lambdas)))).withColumn("nu", F.explode(F.array(*map(F.lit, nus))))
    q = F.col("weight") - F.col("nu") * F.col("compromise")
    eps = F.when(F.col("lam") == 0, F.when(q > 0, F.col("low")).otherwise(F.col("high"))).otherwise(
        F.when(q > 0, F.least("high", F.greatest(F.col("low"), F.col("lam") * F.col("a") / q))).otherwise(F.col("high"))
    )
    rows = grid.withColumn("eps", eps)
    sums = rows.groupBy("instance", "lam", "nu").agg(
        F.sum(F.col("weight") * F.col("eps")).alias("objective"), F.sum(-F.col("a") * F.log("eps")).alias("memory"), F.sum(F.col("compromise") * F.col("eps")).alias("work"), F.max("budget").alias("budget"), F.max("floor").alias("floor")
    )
    value = F.col("objective") + F.col("lam") * (F.col("memory") - F.col("budget")) + F.col("nu") * (F.col("floor") - F.col("work"))
    feasible = (F.col("memory") <= F.col("budget") + 1e-9) & (F.col("work") >= F.col("floor") - 1e-9)
    return sums.groupBy("instance").agg(F.max(value).alias("bound"), F.min(F.when(feasible, F.col("objective"))).alias("best_feasible"))


def grid_allocation(problems: DataFrame, points: int) -> DataFrame:
    """Least feasible objective over a grid of rates for instances of one region."""
    step = (F.col("high") - F.col("low")) / (points - 1)
    # The grid stays inside its row: a row per rate would be sorted, since the least of structs is.
    rates = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.col("low") + k * step)
    ok = F.filter(rates, lambda e: (-F.col("a") * F.log(e) <= F.col("budget") + 1e-9) & (F.col("compromise") * e >= F.col("floor") - 1e-9))
    least = problems.select("instance", F.array_min(F.transform(ok, lambda e: F.struct((F.col("weight") * e).alias("objective"), e.alias("eps")))).alias("b"))
    return least.where("b is not null").groupBy("instance").agg(F.min("b").alias("b")).select("instance", "b.objective", "b.eps")


def unique_seen_report(points: DataFrame, group: list[str], load: str) -> DataFrame:
    """Mean latency and checks at each group's greatest load."""
    top = points.groupBy(*group).agg(F.max(load).alias(load))
    return points.join(top, [*group, load]).groupBy(*group, load).agg(F.avg("p99").alias("mean_p99"), F.avg("checks").alias("mean_checks"))
