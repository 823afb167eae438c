"""Statistics over evidence tables; the replicate (seed) is the unit of every interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quantiles as Q
from ..functions import scalars as S


def mean_t_ci(df: DataFrame, group: list[str], value: str, confidence: float = 0.95) -> DataFrame:
    """Mean with its t interval; a single sample gives no interval."""
    out = df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    half = Q.t_critical(F.col("n") - 1, 1 - (1 - confidence) / 2) * F.col("sd") / F.sqrt("n")
    return out.select(*group, "n", "mean", (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"))


def log_t_summary(df: DataFrame, group: list[str], value: str, alpha: float, limit: float = 0.05) -> DataFrame:
    """Geometric mean, its interval, relative half width and whether that is within the limit."""
    out = df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(F.log(value)).alias("m"), F.stddev_samp(F.log(value)).alias("sd"))
    half = Q.t_critical(F.col("n") - 1, 1 - alpha / 2) * F.col("sd") / F.sqrt("n")
    return out.select(
        *group, "n", F.exp("m").alias("geometric_mean"), F.exp(F.col("m") - half).alias("ci_low"), F.exp(F.col("m") + half).alias("ci_high"),
        F.expm1(half).alias("relative_half_width"), (half <= F.log1p(F.lit(limit))).alias("precise"),
    )


def paired_log_ratio(pairs: DataFrame, group: list[str], candidate: str, baseline: str, alpha: float, relations: int, threshold: float, direction: str) -> DataFrame:
    """One-sided simultaneous bound on the geometric mean ratio of pairs, and the decision.

    ``direction`` 'lower': PASS when the lower bound reaches the threshold, FAIL when the mean is below;
    'upper' mirrors that; anything else is INDETERMINATE.
    """
    log = F.log(F.col(candidate) / F.col(baseline))
    out = pairs.groupBy(*group).agg(F.count(log).alias("n"), F.avg(log).alias("m"), F.stddev_samp(log).alias("sd"))
    half = Q.t_critical(F.col("n") - 1, 1 - alpha / relations) * F.col("sd") / F.sqrt("n")
    low, high, edge = F.col("m") - half, F.col("m") + half, F.log(F.lit(threshold))
    good, bad = ((low >= edge), (F.col("m") < edge)) if direction == "lower" else ((high <= edge), (F.col("m") > edge))
    return out.select(
        *group, "n", F.exp("m").alias("ratio"), F.exp(low).alias("ratio_low"), F.exp(high).alias("ratio_high"), F.when(good, "PASS").when(bad, "FAIL").otherwise("INDETERMINATE").alias("decision")
    )


def binomial_ci(df: DataFrame, group: list[str], hits: Column, alpha: float, sided: int = 2) -> DataFrame:
    """Clopper-Pearson interval of the share of hits per group."""
    counts = df.groupBy(*group).agg(F.count_if(hits).alias("x"), F.count(F.lit(1)).alias("n"))
    return Q.with_clopper_pearson(counts, "x", "n", alpha, sided).withColumn("rate", F.try_divide("x", "n"))


def ffr_envelope(df: DataFrame, group: list[str], seed: str, hits: Column, alpha: float) -> DataFrame:
    """Outer envelope of the pooled exact interval and the t interval over seeds."""
    pooled = binomial_ci(df, group, hits, alpha)
    per_seed = df.groupBy(*group, seed).agg(F.avg(hits.cast("double")).alias("r"))
    t = mean_t_ci(per_seed, group, "r", 1 - alpha).select(*group, F.col("ci_low").alias("t_low"), F.col("ci_high").alias("t_high"))
    return pooled.join(t, group).select(
        *group, "x", "n", "rate", F.greatest(F.lit(0.0), F.least("ci_low", F.coalesce("t_low", "ci_low"))).alias("ci_low"), F.least(F.lit(1.0), F.greatest("ci_high", F.coalesce("t_high", "ci_high"))).alias("ci_high")
    )


def cluster_bootstrap(df: DataFrame, group: list[str], seed: str, value: str, draws: int, namespace: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval of the mean over resampled seeds.

    Draw b takes, for each place i, the seed whose number is a hash of (namespace, b, i) modulo the number
    of seeds.  Per group there is one row per seed; draws are an explode and an equi-join.
    """
    means = _bootstrap_means(df, group, seed, {"m": F.col(value)}, draws, namespace)
    ci = means.groupBy(*group).agg(F.percentile("m", low).alias("ci_low"), F.percentile("m", high).alias("ci_high"))
    return df.groupBy(*group).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n_seeds")).join(ci, group)


def _bootstrap_means(df: DataFrame, group: list[str], seed: str, values: dict[str, Column], draws: int, namespace: str) -> DataFrame:
    """(group, b): the means of the values over the seeds of draw b."""
    w = Window.partitionBy(*group)
    rows = df.select(*group, seed, *[v.alias(k) for k, v in values.items()])
    rows = rows.withColumns({"k": F.row_number().over(w.orderBy(seed)) - 1, "n": F.count(F.lit(1)).over(w)})
    places = rows.select(*group, F.col("k").alias("i"), "n").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    pick = S.hash32(F.concat_ws("|", F.lit(namespace), "b", "i")) % F.col("n")
    drawn = places.withColumn("k", pick.cast("int")).join(rows.select(*group, "k", *values), [*group, "k"])
    return drawn.groupBy(*group, "b").agg(*[F.avg(k).alias(k) for k in values])


def auc_bootstrap(df: DataFrame, group: list[str], seed: str, auc: str, draws: int, namespace: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Intervals of the mean AUC over resampled seeds, in three forms from the same draws.

    Raw; fixed: one direction for all seeds, so an interval round one half reaches down to it; oracle: each
    seed in its better direction.
    """
    a = F.col(auc)
    forms = {"raw": a, "oracle": F.greatest(a, 1 - a)}
    ends = [F.percentile(k, p).alias(f"{k}_{e}") for k in forms for p, e in ((low, "low"), (high, "high"))]
    ci = _bootstrap_means(df, group, seed, forms, draws, namespace).groupBy(*group).agg(*ends)
    means = df.groupBy(*group).agg(*[F.avg(v).alias(k) for k, v in forms.items()], F.count(F.lit(1)).alias("n_seeds"))
    out, better = means.join(ci, group), lambda c: F.greatest(F.col(c), 1 - F.col(c))
    least = F.when(F.lit(0.5).between(F.col("raw_low"), F.col("raw_high")), 0.5).otherwise(F.least(better("raw_low"), better("raw_high")))
    return out.withColumns({"fixed": better("raw"), "fixed_low": least, "fixed_high": F.greatest(F.col("raw_high"), 1 - F.col("raw_low"))})


def auc(df: DataFrame, group: list[str], positive: str, score: str) -> DataFrame:
    """Mid-rank Mann-Whitney AUC per group, its direction-free form and Cliff's delta.

    Equal scores are counted first, so ranks run over distinct scores.
    """
    counts = df.groupBy(*group, score).agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy(*group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = counts.withColumn("won", F.col("p") * (below + F.col("q") / 2.0))
    out = won.groupBy(*group).agg(F.sum("won").alias("u"), F.sum("p").alias("n_positive"), F.sum("q").alias("n_negative"))
    a = F.try_divide(F.col("u"), F.col("n_positive") * F.col("n_negative"))
    return out.select(*group, "n_positive", "n_negative", a.alias("auc"), F.greatest(a, 1 - a).alias("auc_any"), (2 * a - 1).alias("cliffs_delta"))


def ks_statistic(df: DataFrame, group: list[str], side: str, value: str) -> DataFrame:
    """Largest difference of the two sides' distribution functions."""
    counts = df.groupBy(*group, value).agg(F.count_if(side).alias("a"), F.count_if(~F.col(side)).alias("b"))
    run, every = Window.partitionBy(*group).orderBy(value), Window.partitionBy(*group)
    gap = F.abs(F.sum("a").over(run) / F.sum("a").over(every) - F.sum("b").over(run) / F.sum("b").over(every))
    return counts.withColumn("gap", gap).groupBy(*group).agg(F.max("gap").alias("ks"))


def brier(df: DataFrame, group: list[str], p: str, y: str) -> DataFrame:
    return df.groupBy(*group).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.count(F.lit(1)).alias("n"))


def expected_calibration_error(df: DataFrame, p: str, y: str, bins: int) -> DataFrame:
    bin_ = F.least(F.lit(bins - 1), F.floor(F.col(p) * bins))
    per = df.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("p"), F.avg(F.col(y).cast("double")).alias("y"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def planning_bound(df: DataFrame, gate: str, failed: Column, alpha: float) -> DataFrame:
    """Sum over gates of upper bounds on failing, and the joint lower bound on passing all."""
    per = binomial_ci(df, [gate], failed, alpha, sided=1)
    return per.agg(F.sum("ci_high").alias("failure_bound"), F.greatest(F.lit(0.0), 1 - F.sum("ci_high")).alias("joint_lower_bound"), F.count(F.lit(1)).alias("gates"))


def interval_coverage(df: DataFrame, group: list[str], analytic: str, low: str, high: str) -> DataFrame:
    inside = (F.col(analytic) >= F.col(low)) & (F.col(analytic) <= F.col(high))
    return df.groupBy(*group).agg(F.avg(inside.cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n"))


def relative_reduction(base: Column, candidate: Column) -> Column:
    """(base - candidate) / base; equal zeros reduce nothing, and from zero there is no ratio."""
    return F.when((base == 0) & (candidate == 0), 0.0).when(base != 0, (base - candidate) / base)


def paired_replay_summary(pairs: DataFrame, group: list[str], checks: str, base_checks: str, tuples: str) -> DataFrame:
    """Per group over seeds: checks per tuple, share of the baseline, saved, reduction with its interval."""
    rows = pairs.withColumns(
        {
            "per_tuple": F.try_divide(checks, tuples), "fraction": F.try_divide(checks, base_checks), "saved": F.col(base_checks) - F.col(checks),
            "reduction": relative_reduction(F.col(base_checks), F.col(checks)), "zero": (F.col(checks) == 0).cast("int"),
        }
    )
    out = rows.groupBy(*group).agg(F.avg("per_tuple").alias("checks_per_tuple"), F.avg("fraction").alias("fraction"), F.sum("saved").alias("saved"), F.sum("zero").alias("zero_check_seeds"))
    ci = mean_t_ci(rows, group, "reduction")
    return out.join(ci.withColumnsRenamed({"mean": "reduction", "ci_low": "reduction_low", "ci_high": "reduction_high"}), group)


def filter_summary(df: DataFrame, group: list[str], seed: str, hits: Column, memory: str, latency: str, alpha: float) -> DataFrame:
    """Per specification: pooled counts, false-forward rate with envelope, memory, latency, front flag."""
    from .joins import pareto_front

    rates = ffr_envelope(df, group, seed, hits, alpha)
    means = df.groupBy(*group).agg(F.avg(memory).alias("memory"), F.avg(latency).alias("latency"))
    rows = rates.join(means, group).withColumn("everything", F.lit(1))
    front = pareto_front(rows, ["memory", "rate"], ["everything"], hot_rows=0).select(*group, F.lit(True).alias("on_front"))
    return rows.join(front, group, "left").withColumn("on_front", F.coalesce("on_front", F.lit(False))).drop("everything")


def point_summary(df: DataFrame, group: list[str], value: str, alpha: float, memory: str) -> DataFrame:
    """Log-t summary of a value per specification with its place on the plain and the certified front."""
    from .joins import certified_front, pareto_front

    rows = log_t_summary(df, group, value, alpha).join(df.groupBy(*group).agg(F.min(memory).alias("memory"), F.avg(value).alias("mean")), group).withColumn("everything", F.lit(1))
    plain = pareto_front(rows, ["memory", "geometric_mean"], ["everything"], hot_rows=0).select(*group, F.lit(True).alias("on_front"))
    sure = certified_front(rows, ["everything"], "memory", "ci_low", "ci_high", hot_rows=0).select(*group, F.lit(True).alias("not_certainly_beaten"))
    out = rows.join(plain, group, "left").join(sure, group, "left").drop("everything")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("on_front", "not_certainly_beaten")})
