"""Service metrics from event logs: counters, conservation, histograms, percentiles, resources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import saved
from .ordered import running


def region_traffic(attempts: DataFrame, region: str, keys: list[str], invalid: Column, valid: Column, missed: Column, positive: Column) -> DataFrame:
    """Per region: accounts, distinct invalid tuples, request counts, cache misses and positive ones.

    Counts are taken per tuple first, so distinct counts need no wide aggregation.
    """
    per = attempts.groupBy(region, "account", *[k for k in keys if k != "account"]).agg(
        F.count_if(invalid).alias("i"), F.count_if(valid).alias("v"), F.count_if(invalid & missed).alias("m"), F.count_if(invalid & missed & positive).alias("pm")
    )
    per = per.groupBy(region, "account").agg(F.count_if(F.col("i") > 0).alias("t"), *[F.sum(c).alias(c) for c in ("i", "v", "m", "pm")])
    return per.groupBy(region).agg(
        F.count(F.lit(1)).alias("accounts"), F.sum("t").alias("distinct_invalid"), F.sum("i").alias("invalid_requests"), F.sum("v").alias("valid_requests"), F.sum("m").alias("misses"), F.sum("pm").alias("positive_misses")
    )


def predict_cost(traffic: DataFrame, ffr: str, seconds: float, service_ms: float, workers: int) -> DataFrame:
    """Expected backend checks and M/M/c queueing from per-region traffic.

    Erlang's B recursion is a fold over the workers; an overloaded queue has no mean wait.
    """
    sums = traffic.agg(
        F.sum(F.col("distinct_invalid") * F.col(ffr)).alias("first_seen_checks"), F.sum(F.col("invalid_requests") * F.col(ffr)).alias("static_checks"),
        F.sum("positive_misses").alias("adaptive_checks"), F.sum("valid_requests").alias("valid_checks"), F.sum(F.col("invalid_requests") + F.col("valid_requests")).alias("requests"),
    )
    rate = 1000.0 / service_ms
    arrival = (F.col("valid_checks") + F.col("adaptive_checks")) / seconds
    offered = F.col("arrival_rps") / rate
    erlang_b = F.aggregate(F.sequence(F.lit(1), F.lit(workers)), F.lit(1.0), lambda b, k: F.col("offered") * b / (k + F.col("offered") * b))
    u, b = F.col("utilisation"), F.col("erlang_b")
    wait = F.when(F.col("arrival_rps") == 0, 0.0).when(u < 1, b / (1 - u + u * b) / (workers * rate - F.col("arrival_rps")) * 1000.0)
    out = sums.withColumn("arrival_rps", arrival).withColumn("offered", offered).withColumn("utilisation", F.col("offered") / workers).withColumn("erlang_b", erlang_b).withColumn("queue_ms", wait)
    share = F.try_divide(F.col("valid_checks") + F.col("adaptive_checks"), "requests")
    return out.withColumns({"stable": F.col("queue_ms").isNotNull(), "forwarded_ms": service_ms + F.col("queue_ms"), "mean_backend_ms": share * (service_ms + F.col("queue_ms"))}).drop("offered", "erlang_b")


def outcome_counters(events: DataFrame, group: list[str], conditions: dict[str, Column]) -> DataFrame:
    """Counters per group, each the number of events that meet its condition."""
    return events.groupBy(*group).agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def conservation_checks(counters: DataFrame, identities: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """Boolean column per identity (sum of left = sum of right), and whether all hold."""
    total = lambda names: sum((F.col(n) for n in names[1:]), F.col(names[0]))
    out = counters.withColumns({name: total(a) == total(b) for name, (a, b) in identities.items()})
    return out.withColumn("all_hold", F.forall(F.array(*identities), lambda x: x))


def rate(num: Column, den: Column) -> Column:
    """A rate; null when its denominator is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def busy_overlap(spans: DataFrame, group: list[str], start: str, stop: str, window_start: Column, window_stop: Column, workers: int) -> DataFrame:
    """Time of spans inside the window, and the share of the workers' time."""
    inside = F.greatest(F.lit(0), F.least(F.col(stop), window_stop) - F.greatest(F.col(start), window_start))
    out = spans.groupBy(*group).agg(F.sum(inside).alias("busy"))
    return out.withColumn("utilisation", rate(F.col("busy"), workers * (window_stop - window_start)))


def log_bucket(value: Column, growth: float) -> Column:
    """Bucket number: 0 up to 1, then the upper edge's power of ``growth``."""
    return F.when(value <= 1, 0).otherwise(F.ceil(F.log(value.cast("double")) / F.log(F.lit(growth)))).cast("long")


def log_histogram(df: DataFrame, group: list[str], value: str, growth: float, quantiles: dict[str, float]) -> DataFrame:
    """Percentiles from a logarithmic histogram: the upper edge of the bucket that holds the rank."""
    counts = df.groupBy(*group, log_bucket(F.col(value), growth).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("m"))
    w = Window.partitionBy(*group)
    rows = counts.withColumns({"below": F.sum("n").over(w.orderBy("bucket")), "total": F.sum("n").over(w)})
    edge = F.pow(F.lit(growth), F.col("bucket"))
    return rows.groupBy(*group).agg(
        *[F.min(F.when(q * (F.col("total") - 1) < F.col("below"), edge)).alias(name) for name, q in quantiles.items()], F.max("m").alias("maximum"), F.sum("n").alias("n")
    )


def percentiles(df: DataFrame, group: list[str], value: str, ps: dict[str, float], n: str | None = None) -> DataFrame:
    """Exact interpolated percentiles by selection: different values are counted, running counts place them, and the
    values at the two ranks of each percentile are picked.  No task holds a group's values.

    ``n`` names a column of counts where ``df`` already has one row per different value."""
    rows = df.where(F.col(value).isNotNull())
    counts = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n")) if n is None else rows.select(*group, value, F.col(n).alias("_n"))
    counts = running(counts, group, [value], {"_upto": ("sum", "_n")})
    total = counts.groupBy(*group).agg(F.sum("_n").alias("_total")).select(*[F.col(g).alias(f"_t{i}") for i, g in enumerate(group)], "_total")
    on = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_t{i}")) for i, g in enumerate(group)]) if group else None
    counts = counts.join(total, on) if group else counts.crossJoin(F.broadcast(total))  # one row
    picks = []
    for i, p in enumerate(ps.values()):
        at = p * (F.col("_total") - 1)
        picks += [F.min(F.when(F.col("_upto") > F.floor(at), F.col(value))).alias(f"_low{i}"), F.min(F.when(F.col("_upto") > F.ceil(at), F.col(value))).alias(f"_high{i}"), F.max(at - F.floor(at)).alias(f"_part{i}")]
    out = counts.groupBy(*group).agg(*picks)
    return out.select(*group, *[((1 - F.col(f"_part{i}")) * F.col(f"_low{i}") + F.col(f"_part{i}") * F.col(f"_high{i}")).alias(name) for i, name in enumerate(ps)])


def distribution(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Count, least, interpolated percentiles, greatest, mean."""
    out = df.groupBy(*group).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.avg(value).alias("mean"))
    p = percentiles(df, group, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}).withColumnsRenamed({g: f"_p{i}" for i, g in enumerate(group)})
    on = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_p{i}")) for i, g in enumerate(group)])
    return out.join(p, on, "left").select(*group, "n", "least", "p50", "p95", "p99", "greatest", "mean")


def nearest_rank(df: DataFrame, group: list[str], value: str, num: int, den: int) -> DataFrame:
    """The value at rank ceil(n * num / den).  Equal values are counted first."""
    counts = running(df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n")), group, [value], {"upto": ("sum", "n")})
    total = counts.groupBy(*group).agg(F.sum("n").alias("total"))
    rows = counts.join(total, group)
    return rows.where(F.col("upto") * den >= F.col("total") * num).groupBy(*group).agg(F.min(value).alias("nearest_rank"))


def value_histogram(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Exact counts of values as a sorted array of (value, count)."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("count"))
    return counts.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(F.col(value).alias("value"), "count"))).alias("histogram"))


def histogram_percentile(df: DataFrame, group: list[str], p: float) -> DataFrame:
    """The interpolated percentile of the values a histogram stands for."""
    rows = df.select(*group, F.explode("histogram").alias("h")).select(*group, "h.value", "h.count")
    return percentiles(rows, group, "value", {"percentile": p}, "count")


def resource_summary(samples: DataFrame, group: list[str], rss: str, queue: str) -> DataFrame:
    return samples.groupBy(*group).agg(
        F.min(rss).alias("rss_min"), F.max(rss).alias("rss_peak"), F.avg(queue).alias("queue_mean"), F.max(queue).alias("queue_peak"), F.count(F.lit(1)).alias("samples"), (F.count(queue) == F.count(F.lit(1))).alias("complete")
    )


def first_last_decile_growth(samples: DataFrame, group: list[str], at: str, value: str) -> DataFrame:
    """Means of the first and the last tenth of the samples, for at least 100 samples."""
    w = Window.partitionBy(*group)
    rows = samples.withColumns({"r": F.row_number().over(w.orderBy(at)), "n": F.count(F.lit(1)).over(w)})
    k = F.floor(F.col("n") / 10)
    first, last = F.avg(F.when(F.col("r") <= k, F.col(value))), F.avg(F.when(F.col("r") > F.col("n") - k, F.col(value)))
    out = rows.groupBy(*group).agg(F.max("n").alias("n"), first.alias("first_mean"), last.alias("last_mean"))
    enough = F.col("n") >= 100
    return out.select(*group, "n", F.when(enough, F.col("first_mean")).alias("first_mean"), F.when(enough, F.col("last_mean")).alias("last_mean"), F.when(enough, F.col("last_mean") - F.col("first_mean")).alias("growth"))


def multiplicity_profile(df: DataFrame, run: list[str], keys: list[str]) -> DataFrame:
    """Per run: tuples, least and greatest multiplicity, and a digest of how often each multiplicity occurs."""
    per = df.groupBy(*run, *keys).agg(F.count(F.lit(1)).alias("m")).groupBy(*run, "m").agg(F.count(F.lit(1)).alias("n"))
    entry = F.concat_ws(":", F.lpad(F.col("m").cast("string"), 20, "0"), "n")
    return per.groupBy(*run).agg(F.sum("n").alias("tuples"), F.min("m").alias("least"), F.max("m").alias("greatest"), F.sha2(F.array_join(F.sort_array(F.collect_list(entry)), ","), 256).alias("profile"))


def pooled_and_stratified(df: DataFrame, stratum: str, aggs: list[Column]) -> DataFrame:
    """The same summary per stratum and pooled (stratum null) in one pass."""
    return df.rollup(stratum).agg(*aggs, F.grouping(stratum).cast("int").alias("pooled"))


def delivery_shapes(df: DataFrame, group: list[str], shape: Column, port: str) -> DataFrame:
    """Distinct shapes and ports, and the distribution of the number of calls; ``shape_counts`` has the shapes."""
    rows = df.withColumn("_shape", shape).withColumn("_calls", F.size("_shape"))
    return rows.groupBy(*group).agg(
        F.count_distinct("_shape").alias("shapes"), F.count_distinct(port).alias("ports"), F.min("_calls").alias("fewest_calls"), F.max("_calls").alias("most_calls"),
        F.avg("_calls").alias("mean_calls"), *[F.percentile("_calls", p).alias(f"p{round(100 * p)}_calls") for p in (0.5, 0.95, 0.99)],
    )


def shape_counts(df: DataFrame, group: list[str], shape: Column) -> DataFrame:
    """A row for each distinct shape of a group with its count."""
    return df.groupBy(*group, shape.alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def response_signature_count(df: DataFrame, group: list[str], signature: Column) -> DataFrame:
    """Distinct outward signatures; more than one tells cases apart."""
    return df.groupBy(*group).agg(F.count_distinct(signature).alias("signatures")).withColumn("uniform", F.col("signatures") == 1)


def replay_ratios(df: DataFrame, checks: str, base: str, tuples: str) -> DataFrame:
    return df.withColumns({"amplification": F.try_divide(checks, tuples), "work_fraction": F.try_divide(checks, base), "reduction_factor": F.try_divide(base, checks)})


def matched_system_totals(df: DataFrame, system: str, mismatches: str, checks: str, p99: str, expected_points: int) -> DataFrame:
    return df.groupBy(system).agg(
        F.sum(mismatches).alias("mismatches"), F.sum(checks).alias("checks"), F.avg(p99).alias("mean_p99"), (F.lit(expected_points) - F.count(F.lit(1))).alias("missing_points")
    )


def order_digest(df: DataFrame, shard: list[str], at: str, *columns: str) -> DataFrame:
    """Per shard a digest chained over its rows in order, and one over all shards' digests.

    A chain is a fold over one shard's rows; shards are the unit of writing and bounded.
    """
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    rows = df.groupBy(*shard).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), row.alias("h")))).alias("rows"))
    chain = F.aggregate("rows", F.lit(""), lambda s, r: F.sha2(F.concat(s, r["h"]), 256))
    return rows.select(*shard, F.size("rows").cast("long").alias("n"), chain.alias("digest"))


def digest_tree(df: DataFrame, shard: list[str], at: str, *columns: str, leaf: int = 1024) -> DataFrame:
    """Per shard of any size a digest of its rows in order: shard, n, digest.

    A leaf digests the digests of ``leaf`` rows that follow each other, a node those of ``leaf`` nodes below it; a shard's
    digest is its first node that stands alone.  Every level is made by all tasks, and no group holds more than
    ``leaf`` digests."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    rows = running(df.select(*shard, at, row.alias("_h"), F.lit(1).cast("long").alias("_one")), shard, [at, "_h"], {"_k": ("sum", "_one")})
    level = rows.select(*shard, (F.col("_k") - 1).alias("_k"), "_h", F.col("_one").alias("_n"))
    done = None
    while True:
        inside = F.array_sort(F.collect_list(F.struct((F.col("_k") % leaf).alias("k"), F.col("_h").alias("h"))))
        level = level.groupBy(*shard, F.floor(F.col("_k") / leaf).cast("long").alias("_k")).agg(F.sha2(F.array_join(F.transform(inside, lambda x: x["h"]), ""), 256).alias("_h"), F.sum("_n").alias("_n"))
        level = saved(level, "digest-level")
        # Nodes are numbered from 0 without gaps: a shard with a second one goes on.
        more = level.where("_k = 1").select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(shard)])
        on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(shard)])
        ended = level.where("_k = 0").join(more, on, "left_anti").select(*shard, F.col("_n").alias("n"), F.col("_h").alias("digest"))
        done = ended if done is None else done.unionByName(ended)
        if more.isEmpty():
            return done
        level = level.join(more, on, "left_semi")


def bin_counts(scores: DataFrame, score: str, bins: int, member: Column) -> DataFrame:
    """Member and other mass per equal-width bin of [0, 1]."""
    bin_ = F.least(F.lit(bins - 1), F.floor(F.col(score) * bins)).cast("long")
    return scores.groupBy(bin_.alias("bin")).agg(F.count_if(member).alias("members"), F.count_if(~member).alias("others"))


def compare_masses(bins: DataFrame, p: str, q: str) -> DataFrame:
    """Total variation and least ratio q / p of two mass columns of a bounded table of bins."""
    total = bins.agg(F.sum(p).alias("_p"), F.sum(q).alias("_q"))
    rows = bins.crossJoin(F.broadcast(total)).select((F.col(p) / F.col("_p")).alias("p"), (F.col(q) / F.col("_q")).alias("q"))
    return rows.agg((F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("total_variation"), F.min(F.when(F.col("p") > 0, F.col("q") / F.col("p"))).alias("density_ratio"))


def predicate_mass(bins: DataFrame, mass: str, predicate: Column) -> DataFrame:
    """Share of a mass column on which a predicate holds."""
    return bins.agg((F.sum(F.when(predicate, F.col(mass)).otherwise(0)) / F.sum(mass)).alias("predicate_mass"))
