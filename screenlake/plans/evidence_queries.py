"""Queries of statistics, curves, ranking and audits over experiment points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quantiles as Q
from ..functions import scalars as S
from ..operators import audit as K
from ..operators import curves as C
from ..operators import joins as J
from ..operators import stats as T
from ..sources import tables as src
from .registry import POINTS, SPECS, h32, query, rounded

P = f"WITH {POINTS}"
SP = f"WITH {SPECS}"
CURVE = ["seed", "method", "profile"]


def t_sql(p: float, df: str) -> str:
    """SQL of a t quantile for small degrees of freedom."""
    return f"[{', '.join(repr(Q.t_quantile(p, k)) for k in range(1, 41))}][{df}]"


def points(spark, d):
    return src.read_points(spark, d)


@query("i1_mean_t_ci", f"{P} SELECT method, profile, load, count(*) AS n, round(avg(p99), 4) AS mean, round(avg(p99) - {t_sql(0.975, 'count(*) - 1')} * stddev_samp(p99) / sqrt(count(*)), 4) AS ci_low, round(avg(p99) + {t_sql(0.975, 'count(*) - 1')} * stddev_samp(p99) / sqrt(count(*)), 4) AS ci_high FROM points GROUP BY ALL")
def _(spark, d):
    return rounded(T.mean_t_ci(points(spark, d), ["method", "profile", "load"], "p99"), 4)


@query("i2_log_t_summary", f"{P}, g AS (SELECT method, profile, load, count(*) AS n, avg(ln(p99)) AS m, stddev_samp(ln(p99)) / sqrt(count(*)) AS se FROM points GROUP BY ALL), h AS (SELECT *, {t_sql(0.995, 'n - 1')} * se AS h FROM g) SELECT method, profile, load, n, round(exp(m), 4) AS geometric_mean, round(exp(m - h), 4) AS ci_low, round(exp(m + h), 4) AS ci_high, round(exp(h) - 1, 9) AS relative_half_width, h <= ln(1.05) AS precise FROM h")
def _(spark, d):
    return rounded(T.log_t_summary(points(spark, d), ["method", "profile", "load"], "p99", 0.01).withColumn("relative_half_width", F.round("relative_half_width", 9)), 9).withColumns({c: F.round(c, 4) for c in ("geometric_mean", "ci_low", "ci_high")})


PAIRS = "pairs AS (SELECT c.seed, c.method, c.profile, c.load, c.p99, b.p99 AS base_p99, c.checks, b.checks AS base_checks, c.offered, b.offered AS base_offered FROM points c JOIN points b ON b.method = 'A' AND c.method <> 'A' AND c.seed = b.seed AND c.profile = b.profile AND c.load = b.load)"


def ratio_sql(source: str, num: str, den: str, group: str, p: float, edge: float, upper: bool) -> str:
    good, bad = ("m + h <= e", "m > e") if upper else ("m - h >= e", "m < e")
    return f"""r AS (SELECT {group}, count(ln({num} / {den}::DOUBLE)) AS n, avg(ln({num} / {den}::DOUBLE)) AS m, stddev_samp(ln({num} / {den}::DOUBLE)) AS sd FROM {source} GROUP BY ALL),
    q AS (SELECT *, {t_sql(p, 'n - 1')} * sd / sqrt(n) AS h, ln({edge}) AS e FROM r)
    SELECT {group}, n, round(exp(m), 6) AS ratio, round(exp(m - h), 6) AS ratio_low, round(exp(m + h), 6) AS ratio_high, CASE WHEN {good} THEN 'PASS' WHEN {bad} THEN 'FAIL' ELSE 'INDETERMINATE' END AS decision FROM q"""


def pairs(spark, d):
    return J.pair_with_baseline(points(spark, d), "A", "method", ["seed", "profile", "load"], ["p99", "checks", "offered"])


@query("i3_paired_log_ratio", f"{P}, {PAIRS}, {ratio_sql('pairs', 'p99', 'base_p99', 'method, profile, load', 1 - 0.05 / 14, 1.05, True)}")
def _(spark, d):
    return rounded(T.paired_log_ratio(pairs(spark, d), ["method", "profile", "load"], "p99", "base_p99", 0.05, 14, 1.05, "upper"))


HIT = "l_discount < 0.005"


def hits(spark, d):
    li = src.table(spark, d, "lineitem")
    return li.withColumns({"seed": F.col("l_suppkey") % 20, "gate": F.col("l_linenumber").cast("long")})


@query("i4_clopper_pearson")
def _(spark, d):
    return rounded(T.binomial_ci(hits(spark, d), ["l_returnflag", "gate"], F.expr(HIT), 0.05))


@query("i5_ffr_envelope")
def _(spark, d):
    return rounded(T.ffr_envelope(hits(spark, d), ["l_returnflag", "gate"], "seed", F.expr(HIT), 0.05))


@query("i6_cluster_bootstrap", f"""{P}, s AS (SELECT method, seed, avg(p99) AS v FROM points GROUP BY ALL), k AS (SELECT method, v, row_number() OVER (PARTITION BY method ORDER BY seed) - 1 AS k, count(*) OVER (PARTITION BY method) AS n FROM s),
    m AS (SELECT a.method, b, avg(x.v) AS m FROM k a, range(0, 200) r(b) JOIN k x ON x.method = a.method AND x.k = {h32("'boot|' || b || '|' || a.k")} % a.n GROUP BY ALL)
    SELECT method, round((SELECT avg(v) FROM k WHERE k.method = m.method), 4) AS mean, (SELECT count(*) FROM k WHERE k.method = m.method) AS n_seeds, round(quantile_cont(m, 0.025), 4) AS ci_low, round(quantile_cont(m, 0.975), 4) AS ci_high FROM m GROUP BY method""")
def _(spark, d):
    s = points(spark, d).groupBy("method", "seed").agg(F.avg("p99").alias("v"))
    return rounded(T.cluster_bootstrap(s, ["method"], "seed", "v", 200, "boot"), 4)


SCORES = "s AS (SELECT l_linenumber AS g, l_suppkey % 20 AS seed, l_returnflag = 'R' AS pos, l_quantity AS x FROM lineitem WHERE l_returnflag IN ('R', 'A'))"


def scores(spark, d):
    li = src.table(spark, d, "lineitem").where("l_returnflag in ('R', 'A')")
    return li.select(F.col("l_linenumber").alias("g"), (F.col("l_suppkey") % 20).alias("seed"), (F.col("l_returnflag") == "R").alias("pos"), F.col("l_quantity").alias("x"))


@query("i7_auc", f"""WITH {SCORES}, r AS (SELECT *, rank() OVER (PARTITION BY g, seed ORDER BY x) + (count(*) OVER (PARTITION BY g, seed, x) - 1) / 2.0::DOUBLE AS r FROM s),
    u AS (SELECT g, seed, count(*) FILTER (pos) AS n_positive, count(*) FILTER (NOT pos) AS n_negative, sum(r) FILTER (pos) AS rs FROM r GROUP BY ALL), a AS (SELECT *, (rs - n_positive * (n_positive + 1) / 2.0::DOUBLE) / (n_positive * n_negative) AS a FROM u)
    SELECT g, seed, n_positive, n_negative, round(a, 6) AS auc, round(greatest(a, 1 - a), 6) AS auc_any, round(2 * a - 1, 6) AS cliffs_delta FROM a""")
def _(spark, d):
    return rounded(T.auc(scores(spark, d), ["g", "seed"], "pos", "x"))


@query("i6_auc_bootstrap", f"""WITH {SCORES}, r AS (SELECT *, rank() OVER (PARTITION BY g, seed ORDER BY x) + (count(*) OVER (PARTITION BY g, seed, x) - 1) / 2.0::DOUBLE AS r FROM s),
    u AS (SELECT g, seed, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS q, sum(r) FILTER (pos) AS rs FROM r GROUP BY ALL), a AS (SELECT g, seed, (rs - p * (p + 1) / 2.0::DOUBLE) / (p * q) AS v FROM u WHERE p > 0 AND q > 0),
    k AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY seed) - 1 AS k, count(*) OVER (PARTITION BY g) AS n FROM a),
    m AS (SELECT a.g, b, avg(x.v) AS m, avg(greatest(x.v, 1 - x.v)) AS o FROM k a, range(0, 200) t(b) JOIN k x ON x.g = a.g AND x.k = {h32("'auc|' || b || '|' || a.k")} % a.n GROUP BY ALL),
    c AS (SELECT g, quantile_cont(m, 0.025) AS raw_low, quantile_cont(m, 0.975) AS raw_high, quantile_cont(o, 0.025) AS oracle_low, quantile_cont(o, 0.975) AS oracle_high FROM m GROUP BY g),
    e AS (SELECT g, avg(v) AS raw, avg(greatest(v, 1 - v)) AS oracle, count(*) AS n_seeds FROM k GROUP BY g),
    z AS (SELECT *, greatest(raw, 1 - raw) AS fixed, CASE WHEN raw_low <= 0.5 AND raw_high >= 0.5 THEN 0.5 ELSE least(greatest(raw_low, 1 - raw_low), greatest(raw_high, 1 - raw_high)) END AS fixed_low, greatest(raw_high, 1 - raw_low) AS fixed_high FROM e JOIN c USING (g))
    SELECT g, n_seeds, {', '.join(f'round({form}{end}::DOUBLE, 6) AS {form}{end}' for form in ('raw', 'oracle', 'fixed') for end in ('', '_low', '_high'))} FROM z""")
def _(spark, d):
    per_seed = T.auc(scores(spark, d), ["g", "seed"], "pos", "x").where("auc is not null")
    return rounded(T.auc_bootstrap(per_seed, ["g"], "seed", "auc", 200, "auc"))


@query("i8_ks", f"""WITH {SCORES}, c AS (SELECT g, seed, x, count(*) FILTER (pos) AS a, count(*) FILTER (NOT pos) AS b FROM s GROUP BY ALL)
    SELECT g, seed, round(max(abs(ca / ta::DOUBLE - cb / tb::DOUBLE)), 6) AS ks FROM (SELECT *, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY g, seed) AS ta, sum(b) OVER (PARTITION BY g, seed) AS tb FROM c WINDOW w AS (PARTITION BY g, seed ORDER BY x)) GROUP BY ALL""")
def _(spark, d):
    return rounded(T.ks_statistic(scores(spark, d), ["g", "seed"], "pos", "x"))


LABELLED = "ls AS (SELECT quality, toxic, least(1.0::DOUBLE, n_chars / 5000.0::DOUBLE) AS p FROM labels JOIN documents USING (doc_id))"


def labelled(spark, d):
    return src.table(spark, d, "labels").join(src.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select("quality", "toxic", F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("p"))


@query("i9_brier", f"WITH {LABELLED} SELECT toxic, round(avg(pow(p - quality, 2)), 6) AS brier, count(*) AS n FROM ls GROUP BY 1")
def _(spark, d):
    return rounded(T.brier(labelled(spark, d), ["toxic"], "p", "quality"))


@query("i9_calibration_error", f"WITH {LABELLED}, b AS (SELECT least(9, floor(p * 10)) AS b, count(*) AS n, avg(p) AS p, avg(quality) AS y FROM ls GROUP BY 1) SELECT round(sum(n * abs(p - y)) / sum(n), 6) AS ece FROM b")
def _(spark, d):
    return rounded(T.expected_calibration_error(labelled(spark, d), "p", "quality", 10))


@query("i10_planning_bound")
def _(spark, d):
    return rounded(T.planning_bound(hits(spark, d), "gate", (F.col("l_discount") < 0.005) & (F.col("l_tax") < 0.005), 0.01))


@query("i11_interval_coverage", f"{P} SELECT method, round(avg((p99 BETWEEN 40000 AND 52000)::INT), 6) AS coverage, count(*) AS n FROM points GROUP BY 1")
def _(spark, d):
    return rounded(T.interval_coverage(points(spark, d).withColumns({"lo": F.lit(40000.0), "hi": F.lit(52000.0)}), ["method"], "p99", "lo", "hi"))


@query("i12_filter_summary")
def _(spark, d):
    return rounded(T.filter_summary(hits(spark, d), ["l_returnflag", "gate"], "seed", F.expr(HIT), "l_quantity", "l_extendedprice", 0.05), 4)


@query("i13_paired_replay_summary", f"""{P}, {PAIRS}, x AS (SELECT *, CASE WHEN base_checks <> 0 THEN (base_checks - checks) / base_checks::DOUBLE WHEN checks = 0 THEN 0 END AS red FROM pairs)
    SELECT method, profile, load, round(avg(checks / offered::DOUBLE), 6) AS checks_per_tuple, round(avg(checks / base_checks::DOUBLE), 6) AS fraction, sum(base_checks - checks)::BIGINT AS saved, sum((checks = 0)::INT)::BIGINT AS zero_check_seeds, count(*) AS n, round(avg(red), 6) AS reduction,
           round(avg(red) - {t_sql(0.975, 'count(*) - 1')} * stddev_samp(red) / sqrt(count(*)), 6) AS reduction_low, round(avg(red) + {t_sql(0.975, 'count(*) - 1')} * stddev_samp(red) / sqrt(count(*)), 6) AS reduction_high FROM x GROUP BY ALL""")
def _(spark, d):
    return rounded(T.paired_replay_summary(pairs(spark, d), ["method", "profile", "load"], "checks", "base_checks", "offered"))


@query("i14_point_summary", f"""{P}, v AS (SELECT method || profile AS spec, load, p99 FROM points), g AS (SELECT spec, load, count(*) AS n, avg(ln(p99)) AS m, stddev_samp(ln(p99)) / sqrt(count(*)) AS se, avg(p99) AS mean FROM v GROUP BY ALL),
    h AS (SELECT *, exp(m) AS gm, exp(m - {t_sql(0.995, 'n - 1')} * se) AS lo, exp(m + {t_sql(0.995, 'n - 1')} * se) AS hi FROM g)
    SELECT spec, load, n, round(gm, 4) AS geometric_mean, round(mean, 4) AS mean, NOT EXISTS (SELECT 1 FROM h b WHERE b.load <= a.load AND b.gm <= a.gm AND (b.load < a.load OR b.gm < a.gm)) AS on_front, NOT EXISTS (SELECT 1 FROM h b WHERE b.load <= a.load AND b.hi < a.lo) AS not_certainly_beaten FROM h a""")
def _(spark, d):
    p = points(spark, d).withColumn("spec", F.concat("method", "profile")).withColumn("memory", F.col("load"))
    return rounded(T.point_summary(p, ["spec", "load"], "p99", 0.01, "memory").select("spec", "load", "n", "geometric_mean", "mean", "on_front", "not_certainly_beaten"), 4)


@query("i15_unique_seen_report", f"{P}, t AS (SELECT method, profile, max(load) AS load FROM points GROUP BY ALL) SELECT method, profile, load, round(avg(p99), 4) AS mean_p99, round(avg(checks), 4) AS mean_checks FROM points JOIN t USING (method, profile, load) GROUP BY ALL")
def _(spark, d):
    return rounded(C.unique_seen_report(points(spark, d), ["method", "profile"], "load"), 4)


@query("i16_relative_reduction", f"{P}, {PAIRS} SELECT seed, method, profile, load, round(CASE WHEN base_checks <> 0 THEN (base_checks - checks) / base_checks::DOUBLE WHEN checks = 0 THEN 0 END, 6) AS reduction FROM pairs")
def _(spark, d):
    return rounded(pairs(spark, d).select("seed", "method", "profile", "load", T.relative_reduction(F.col("base_checks"), F.col("checks")).alias("reduction")))


@query("i17_wilson_ci", f"{P}, x AS (SELECT seed, method, profile, load, dropped / offered::DOUBLE AS p, offered::DOUBLE AS n, 3.8416::DOUBLE AS zz FROM points) SELECT seed, method, profile, load, round((p + zz / (2 * n)) / (1 + zz / n) - 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n), 6) AS low, round((p + zz / (2 * n)) / (1 + zz / n) + 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n), 6) AS high FROM x")
def _(spark, d):
    low, high = Q.wilson(F.col("dropped").cast("double"), F.col("offered").cast("double"), 1.96)
    return rounded(points(spark, d).select("seed", "method", "profile", "load", low.alias("low"), high.alias("high")))


# -- saturation curves --------------------------------------------------------------------------
SAFE = f"""{POINTS}, v AS (SELECT *, (seed * 7 + load) % 41 <> 0 AS valid FROM points),
    safe AS (SELECT a.*, b.valid AS base_valid, coalesce(timed_out / offered::DOUBLE <= 0.30, false) AS timeout_pass, offered - dropped - timed_out >= offered * 0.45::DOUBLE AS throughput_pass, coalesce(dropped / offered::DOUBLE <= 0.36, false) AS drop_pass, coalesce(b.valid AND a.p99 <= b.p99 * 1.25, false) AS p99_pass
        FROM v a LEFT JOIN (SELECT seed, profile, load, valid, p99 FROM v WHERE method = 'A') b USING (seed, profile, load)),
    passed AS (SELECT *, valid AND timeout_pass AND drop_pass AND throughput_pass AS operational, valid AND timeout_pass AND drop_pass AND throughput_pass AND p99_pass AS passed FROM safe)"""
BRACKET = f"""{SAFE}, ff AS (SELECT *, min(CASE WHEN NOT passed THEN load END) OVER (PARTITION BY seed, method, profile) AS ff FROM passed),
    br AS (SELECT seed, method, profile, max(load) FILTER (passed AND (ff IS NULL OR load < ff)) AS l, max(ff) AS u, count(*) FILTER (passed AND load > ff) > 0 AS nonmonotone, bool_or(NOT valid) AS inv, bool_or(NOT coalesce(base_valid, false)) AS nb FROM ff GROUP BY ALL),
    brackets AS (SELECT seed, method, profile, CASE WHEN NOT inv AND NOT nb THEN l END AS lower_, CASE WHEN NOT inv AND NOT nb THEN u END AS upper_, nonmonotone,
        CASE WHEN inv THEN 'INVALID_MEASUREMENT_ROWS' WHEN nb THEN 'BASELINE_REFERENCE_INVALID' WHEN u IS NULL THEN 'LOWER_BOUND_CENSORED' WHEN l IS NULL THEN 'BELOW_TESTED_GRID' ELSE 'BRACKETED' END AS status FROM br)"""


def safe(spark, d):
    p = points(spark, d).withColumns({"valid": (F.col("seed") * 7 + F.col("load")) % 41 != 0, "succeeded": F.col("offered") - F.col("dropped") - F.col("timed_out")})
    return C.safe_points(p, "A", ["seed", "profile", "load"], 0.30, 0.36, 0.45, 0.25)


def brackets(spark, d):
    return C.bracket_saturation(safe(spark, d), CURVE, "load")


@query("j1_safe_points", f"WITH {SAFE} SELECT seed, method, profile, load, timeout_pass, drop_pass, throughput_pass, operational, p99_pass, passed FROM passed")
def _(spark, d):
    return safe(spark, d).select(*CURVE, "load", "timeout_pass", "drop_pass", "throughput_pass", "operational", "p99_pass", "passed")


@query("j2_bracket_saturation", f'WITH {BRACKET} SELECT seed, method, profile, lower_ AS "lower", upper_ AS "upper", nonmonotone, status FROM brackets')
def _(spark, d):
    return brackets(spark, d)


@query("j3_summarize_saturation", f"WITH {BRACKET} SELECT a.method, a.profile, count(*) AS curves, count(*) FILTER (a.status = 'BRACKETED') AS bracketed, round(avg(a.lower_), 6) AS mean_lower, round(avg(a.upper_), 6) AS mean_upper, round(avg(a.lower_ - b.upper_), 6) AS least_difference, round(avg(a.upper_ - b.lower_), 6) AS greatest_difference FROM brackets a LEFT JOIN brackets b ON b.method = 'A' AND a.seed = b.seed AND a.profile = b.profile GROUP BY ALL")
def _(spark, d):
    return rounded(C.summarize_saturation(brackets(spark, d), "method", "seed", "A", ["profile"]))


@query("j4_capacity_lower_bound", f"""WITH {SAFE}, best AS (SELECT method || '-' || profile AS profile, seed, arg_max(checks, load) AS c FROM passed WHERE passed AND load > 0 GROUP BY ALL), g AS (SELECT profile, count(*) AS n, avg(ln(c)) AS m, stddev_samp(ln(c)) / sqrt(count(*)) AS se FROM best GROUP BY 1)
    SELECT profile, n, CASE WHEN n = 20 THEN round(exp(m), 4) END AS geometric_mean, CASE WHEN n = 20 THEN round(exp(m - {t_sql(0.975, 'n - 1')} * se), 4) END AS lower_bound, CASE WHEN n = 20 THEN 'VALID_COMPLETE' ELSE 'INDETERMINATE' END AS status FROM g""")
def _(spark, d):
    return rounded(C.capacity_lower_bound(safe(spark, d).withColumn("profile", F.concat_ws("-", "method", "profile")), "profile", "seed", "load", "checks", 0.025, 20), 4)


@query("j5_saturation_ratio", f"""WITH {BRACKET}, pr AS (SELECT c.method, c.profile, c.lower_ AS l, b.upper_ AS u FROM brackets c JOIN brackets b ON b.method = 'A' AND c.method <> 'A' AND c.seed = b.seed AND c.profile = b.profile),
    lack AS (SELECT method, profile, count(*) FILTER (l IS NULL) AS no_candidate_end, count(*) FILTER (u IS NULL) AS no_baseline_end FROM pr GROUP BY ALL), z AS (SELECT * FROM ({ratio_sql('pr', 'l', 'u', 'method, profile', 1 - 0.05 / 4, 1.0, False).replace('r AS (', 'WITH r AS (', 1)}))
    SELECT method, profile, no_candidate_end, no_baseline_end, n, ratio, ratio_low, ratio_high, decision FROM lack LEFT JOIN z USING (method, profile)""")
def _(spark, d):
    return rounded(C.saturation_ratio(brackets(spark, d), "method", "seed", ["profile"], "A", 0.05, 4, 1.0))


@query("j6_p99_at_common_safe_load", f"""WITH {SAFE}, both_ AS (SELECT c.method, c.seed, c.profile, arg_max(c.p99, c.load) AS p, arg_max(b.p99, c.load) AS q FROM passed c JOIN passed b ON b.method = 'A' AND c.method <> 'A' AND b.passed AND c.passed AND c.seed = b.seed AND c.profile = b.profile AND c.load = b.load GROUP BY ALL),
    {ratio_sql('both_', 'p', 'q', 'method, profile', 1 - 0.05 / 4, 1.05, True)}""")
def _(spark, d):
    return rounded(C.p99_at_common_safe_load(safe(spark, d), "seed", ["profile"], "load", "A", 0.05, 4, 1.05))


@query("f16_nonmonotone_curve", f"WITH {SAFE} SELECT seed, method, profile, load FROM (SELECT *, max(CASE WHEN passed THEN 0 ELSE 1 END) OVER (PARTITION BY seed, method, profile ORDER BY load ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM passed) WHERE passed AND f = 1")
def _(spark, d):
    from ..operators.trace import nonmonotone_curve

    return nonmonotone_curve(safe(spark, d), CURVE, "load", "passed").select(*CURVE, "load")


# -- ranking ------------------------------------------------------------------------------------
@query("g1_budget_candidates", f"""{SP}, f AS (SELECT * FROM specs a WHERE NOT EXISTS (SELECT 1 FROM specs b WHERE b.family = a.family AND b.memory <= a.memory AND b.ffr <= a.ffr AND (b.memory < a.memory OR b.ffr < a.ffr))),
    x AS (SELECT f.*, bits, row_number() OVER (PARTITION BY family, bits ORDER BY ffr, memory, spec) AS r FROM f JOIN (VALUES (4), (8), (16)) b(bits) ON memory <= ceil(20 * bits / 8.0) + 4) SELECT family, bits, round(ffr, 6) AS ffr, memory, spec FROM x WHERE r = 1""")
def _(spark, d):
    b = spark.sql("SELECT * FROM VALUES (4), (8), (16) AS b(bits)")
    return rounded(C.budget_candidates(src.read_specs(spark, d), b, ["family"], 20, 4, ["ffr", "memory", "spec"]))


@query("g2_matched_neighbors", f'{SP} SELECT family, spec, lag(spec) OVER w AS "lower", lead(spec) OVER w AS "upper" FROM specs WINDOW w AS (PARTITION BY family ORDER BY memory, spec)')
def _(spark, d):
    return C.matched_neighbors(src.read_specs(spark, d), ["family"], "memory", "spec")


@query("g3_extreme_points", f"WITH {SAFE} SELECT seed, method, profile, max(load) FILTER (passed) AS max_safe, min(load) FILTER (NOT passed) AS min_fail, arg_max(checks, load) FILTER (passed) AS checks_at_max_safe FROM passed GROUP BY ALL")
def _(spark, d):
    return C.extreme_points(safe(spark, d), CURVE, "load")


@query("g4_best_by", f"{SP} SELECT family, round(ffr, 6) AS ffr, spec FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY ffr, memory, spec) AS r FROM specs) WHERE r = 1")
def _(spark, d):
    return rounded(C.best_by(src.read_specs(spark, d), ["family"], ["ffr", "memory"], "spec"))


GRID = "bins AS (SELECT (event_id % 1000) // 50 AS bin, count(*) AS m, count(*) FILTER (value > 30) AS q FROM events GROUP BY 1)"


def grid(spark, d):
    e = src.table(spark, d, "events")
    return e.groupBy(F.floor((F.col("event_id") % 1000) / 50).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("value") > 30).alias("q"))


@query("g6_quantile_partition", f"""WITH RECURSIVE {GRID}, p AS (SELECT bin + 1 AS c, sum(q) OVER (ORDER BY bin)::BIGINT AS s FROM bins), t AS (SELECT count(*) AS n, max(s) AS total FROM p),
    k AS (SELECT 0 AS i, 0::BIGINT AS cut UNION ALL SELECT i + 1, (SELECT arg_min(c, (abs(4 * s - (k.i + 1) * total), c)) FROM p, t WHERE c > k.cut AND c <= n - (4 - (k.i + 1))) FROM k WHERE i < 3)
    SELECT (i - 1)::BIGINT AS cut_index, cut FROM k WHERE i > 0""")
def _(spark, d):
    return C.quantile_partition(grid(spark, d), "bin", "q", 4).select(F.col("cut_index").cast("long").alias("cut_index"), F.col("cut").cast("long").alias("cut"))


@query("g7_interval_kl", f"""WITH {GRID}, s AS (SELECT bin + 1 AS b, sum(m + 0.5::DOUBLE) OVER (ORDER BY bin) AS p, sum(q + 0.5::DOUBLE) OVER (ORDER BY bin) AS q FROM bins UNION ALL SELECT 0, 0, 0), t AS (SELECT max(p) AS tp, max(q) AS tq FROM s)
    SELECT a.b AS start, z.b AS stop, round((z.p - a.p) / tp * ln(((z.p - a.p) / tp) / ((z.q - a.q) / tq)), 9) AS kl FROM s a JOIN s z ON a.b < z.b, t""")
def _(spark, d):
    return rounded(C.interval_kl(grid(spark, d), "bin", "m", "q"), 9)


PROBLEMS = "pb AS (SELECT spec // 4 AS instance, 5.0::DOUBLE + memory % 7 AS a, 1.0::DOUBLE + spec % 3 AS w, 1.0::DOUBLE + memory % 2 AS c, 0.01::DOUBLE AS lo, 0.9::DOUBLE AS hi, 40.0::DOUBLE AS budget, 0.6::DOUBLE AS fl FROM specs)"


def problems(spark, d):
    s = src.read_specs(spark, d)
    return s.select(F.floor(F.col("spec") / 4).cast("long").alias("instance"), (5.0 + F.col("memory") % 7).alias("a"), (1.0 + F.col("spec") % 3).alias("weight"), (1.0 + F.col("memory") % 2).alias("compromise"), F.lit(0.01).alias("low"), F.lit(0.9).alias("high"), F.lit(40.0).alias("budget"), F.lit(0.6).alias("floor"))


@query("g8_allocation_sweep", f"""{SP}, {PROBLEMS}, g AS (SELECT *, w - nu * c AS q FROM pb, (VALUES (0.0), (0.1), (0.3), (1.0)) l(lam), (VALUES (0.0), (0.5), (2.0)) n(nu)),
    e AS (SELECT *, CASE WHEN lam = 0 THEN CASE WHEN q > 0 THEN lo ELSE hi END WHEN q > 0 THEN least(hi, greatest(lo, lam::DOUBLE * a / q)) ELSE hi END AS e FROM g),
    s AS (SELECT instance, lam::DOUBLE AS lam, nu::DOUBLE AS nu, sum(w * e) AS o, sum(-a * ln(e)) AS m, sum(c * e) AS k, max(budget) AS b, max(fl) AS f FROM e GROUP BY ALL)
    SELECT instance, round(max(o + lam * (m - b) + nu * (f - k)), 6) AS bound, round(min(o) FILTER (m <= b + 1e-9 AND k >= f - 1e-9), 6) AS best_feasible FROM s GROUP BY 1""")
def _(spark, d):
    return rounded(C.allocation_sweep(problems(spark, d), [0.0, 0.1, 0.3, 1.0], [0.0, 0.5, 2.0]))


@query("g9_grid_allocation", f"""{SP}, {PROBLEMS}, o AS (SELECT instance, min(a) AS a, min(w) AS w, min(c) AS c FROM pb GROUP BY 1), e AS (SELECT *, 0.01 + k * (0.89::DOUBLE / 200) AS e FROM o, range(0, 201) r(k)),
    f AS (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY w * e, e) AS r FROM e WHERE -a * ln(e) <= 6 + 1e-9 AND c * e >= 0.6 - 1e-9) SELECT instance, round(w * e, 6) AS objective, round(e, 6) AS eps FROM f WHERE r = 1""")
def _(spark, d):
    p = problems(spark, d).groupBy("instance").agg(F.min("a").alias("a"), F.min("weight").alias("weight"), F.min("compromise").alias("compromise")).withColumns({"low": F.lit(0.01), "high": F.lit(0.9), "budget": F.lit(6.0), "floor": F.lit(0.6)})
    return rounded(C.grid_allocation(p, 201))


# -- sets and audits -----------------------------------------------------------------------------
@query("h1_union_stages", f"{P} SELECT seed, method, load, 'look1' AS stage FROM points WHERE seed < 10 UNION ALL SELECT seed, method, load, 'look2' FROM points WHERE seed >= 10")
def _(spark, d):
    p = points(spark, d).select("seed", "method", "load")
    return K.union_stages(("look1", p.where("seed < 10")), ("look2", p.where("seed >= 10")))


@query("h2_grid_difference", "SELECT l_returnflag, l_linenumber FROM lineitem WHERE l_suppkey < 60 EXCEPT ALL SELECT l_returnflag, l_linenumber FROM lineitem WHERE l_suppkey >= 55")
def _(spark, d):
    li = src.table(spark, d, "lineitem")
    return K.grid_difference(*(li.where(c).select("l_returnflag", "l_linenumber") for c in ("l_suppkey < 60", "l_suppkey >= 55")))


@query("h2_grid_intersection", f"{P} SELECT seed, method, load FROM points WHERE profile = 'F' AND dropped > 10 INTERSECT SELECT seed, method, load FROM points WHERE profile = 'O' AND dropped > 10")
def _(spark, d):
    p = points(spark, d).where("dropped > 10")
    return K.grid_intersection(*(p.where(F.col("profile") == x).select("seed", "method", "load") for x in ("F", "O")))


@query("h3_single_provenance", "SELECT 'l_returnflag' AS \"column\", count(DISTINCT l_returnflag) AS \"values\", count(DISTINCT l_returnflag) = 1 AS single FROM lineitem UNION ALL SELECT 'kind', 1, true FROM (SELECT 1)")
def _(spark, d):
    return K.single_provenance(src.table(spark, d, "lineitem").withColumn("kind", F.lit("x")), ["l_returnflag", "kind"])


@query("h4_duplicate_ids", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return K.duplicate_ids(src.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("k1_measurement_validity", f"{P} SELECT seed, method, profile, load, concat_ws(',', CASE WHEN offered < 60 THEN 'too_few' END, CASE WHEN dropped * 10 > offered * 4 THEN 'drops' END, CASE WHEN timed_out * 10 > offered * 3 THEN 'timeouts' END) AS reasons, CASE WHEN offered < 60 OR dropped * 10 > offered * 4 OR timed_out * 10 > offered * 3 THEN 'INVALID' ELSE 'VALID' END AS status FROM points")
def _(spark, d):
    reasons = {"too_few": F.col("offered") < 60, "drops": F.col("dropped") * 10 > F.col("offered") * 4, "timeouts": F.col("timed_out") * 10 > F.col("offered") * 3}
    return K.measurement_validity(points(spark, d), reasons).select("seed", "method", "profile", "load", F.array_join("reasons", ",").alias("reasons"), "status")


@query("k2_resource_violations", f"{P}, l AS (SELECT seed, method, profile, load, CASE WHEN seed % 6 > 0 THEN dropped END::DOUBLE AS dropped, timed_out::DOUBLE AS timed_out FROM points), u AS (FROM l UNPIVOT INCLUDE NULLS (observed FOR resource IN (dropped, timed_out))), m AS (SELECT *, CASE resource WHEN 'dropped' THEN 28.0 ELSE 24.0 END::DOUBLE AS \"limit\" FROM u) SELECT seed, method, profile, load, resource, observed, \"limit\", CASE WHEN observed IS NULL THEN 'missing' ELSE 'over' END AS problem FROM m WHERE observed IS NULL OR observed > \"limit\"")
def _(spark, d):
    return K.resource_violations(observed(spark, d), [*CURVE, "load"], {"dropped": 28.0, "timed_out": 24.0})


def observed(spark, d):
    return points(spark, d).withColumn("dropped", F.when(F.col("seed") % 6 > 0, F.col("dropped")))


OBSERVED = f"{P}, l AS (SELECT seed, method, profile, load, CASE WHEN seed % 6 > 0 THEN dropped END::DOUBLE AS dropped, timed_out::DOUBLE AS timed_out FROM points), u AS (FROM l UNPIVOT INCLUDE NULLS (observed FOR resource IN (dropped, timed_out)))"


@query("k2_resource_maxima", f"""{OBSERVED}, r AS (SELECT *, row_number() OVER (PARTITION BY resource ORDER BY observed DESC NULLS LAST, seed, method, profile, load) AS k, count(*) OVER w AS n, count(*) FILTER (observed IS NULL) OVER w AS missing, CASE resource WHEN 'dropped' THEN 28.0 ELSE 24.0 END::DOUBLE AS "limit" FROM u WINDOW w AS (PARTITION BY resource))
    SELECT resource, n, missing, observed AS greatest, seed, method, profile, load, "limit", observed <= "limit" AS within_limit FROM r WHERE k = 1""")
def _(spark, d):
    return K.resource_maxima(observed(spark, d), [*CURVE, "load"], {"dropped": 28.0, "timed_out": 24.0})


@query("k2_missing_observations", f"{OBSERVED} SELECT seed, method, profile, load, resource FROM u WHERE observed IS NULL")
def _(spark, d):
    return K.missing_observations(observed(spark, d), [*CURVE, "load"], ["dropped", "timed_out"])


FAULTS = "f AS (SELECT event_id, user_id % 13 AS scenario, event_type = 'purchase' AS expected_valid, value < 70 AS accepted, value > 90 AS rejected, user_id % 13 < 4 AS require_fail_open, value < 80 AS fail_open, user_id % 13 > 8 AS require_backend, event_id % 4 AS backend_calls, event_id % 17 = 0 AS recovery_check, value < 60 AS directory_present, event_id % 5 > 0 AS backend_match FROM events), guards AS (SELECT (user_id + event_id) % 14 AS scenario, CASE WHEN event_type <> 'view' THEN value < 95 END AS passed FROM events)"


def faults(spark, d):
    return src.table(spark, d, "events").selectExpr("event_id", "user_id % 13 AS scenario", "event_type = 'purchase' AS expected_valid", "value < 70 AS accepted", "value > 90 AS rejected", "user_id % 13 < 4 AS require_fail_open", "value < 80 AS fail_open", "user_id % 13 > 8 AS require_backend", "event_id % 4 AS backend_calls", "event_id % 17 = 0 AS recovery_check", "value < 60 AS directory_present", "event_id % 5 > 0 AS backend_match")


SAFETY = ["attempts", "valid_attempts", "false_rejects", "acceptance_failures", "invalid_acceptance_failures", "fail_open_expectations", "fail_open_violations", "forward_violations", "recovery_checks", "recovery_failures", "guard_expectations", "guard_failures"]


@query("k3_safety_summary", f"""WITH {FAULTS}, e AS (SELECT scenario, count(*) AS attempts, count(*) FILTER (expected_valid) AS valid_attempts, count(*) FILTER (expected_valid AND rejected) AS false_rejects, count(*) FILTER (expected_valid AND accepted IS NOT TRUE) AS acceptance_failures,
        count(*) FILTER (NOT expected_valid AND accepted IS NOT FALSE) AS invalid_acceptance_failures, count(*) FILTER (require_fail_open) AS fail_open_expectations, count(*) FILTER (require_fail_open AND fail_open IS NOT TRUE) AS fail_open_violations, count(*) FILTER (require_backend AND coalesce(backend_calls, 0) < 1) AS forward_violations,
        count(*) FILTER (recovery_check) AS recovery_checks, count(*) FILTER (recovery_check AND (accepted IS NOT TRUE OR rejected IS TRUE OR directory_present IS NOT TRUE OR backend_match IS NOT TRUE)) AS recovery_failures FROM f GROUP BY 1),
    g AS (SELECT scenario, count(*) AS guard_expectations, count(*) FILTER (passed IS NOT TRUE) AS guard_failures FROM guards GROUP BY 1)
    SELECT scenario, {', '.join(f'coalesce({c}, 0) AS {c}' for c in SAFETY)} FROM e FULL JOIN g USING (scenario)""")
def _(spark, d):
    guards = src.table(spark, d, "events").selectExpr("(user_id + event_id) % 14 AS scenario", "CASE WHEN event_type <> 'view' THEN value < 95 END AS passed")
    return K.safety_summary(faults(spark, d), ["scenario"], guards)


@query("k4_coverage_floors", f"WITH {FAULTS} SELECT s AS scenario, count(f.event_id) AS n, 600 AS floor, count(f.event_id) >= 600 AS complete FROM range(0, 15) r(s) LEFT JOIN f ON f.scenario = s GROUP BY 1")
def _(spark, d):
    counts = faults(spark, d).groupBy("scenario").agg(F.count(F.lit(1)).alias("n"))
    floors = spark.range(15).select(F.col("id").alias("scenario"), F.lit(600).alias("floor"))
    return K.coverage_floors(counts, floors, "scenario")


@query("k5_recompute_and_compare", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE abs(l_extendedprice - round(l_extendedprice, 1)) > 2e-7 * greatest(1, l_extendedprice) GROUP BY ALL")
def _(spark, d):
    bad = K.recompute_and_compare(src.table(spark, d, "lineitem"), "l_extendedprice", F.round("l_extendedprice", 1), 2e-7)
    return bad.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


DECISIONS = f"dec AS (SELECT method, profile, load, CASE WHEN sum(dropped) * 100 > sum(offered) * 36 THEN 'FAIL' WHEN sum(timed_out) * 100 > sum(offered) * 24 THEN 'INDETERMINATE' ELSE 'PASS' END AS decision FROM points GROUP BY ALL)"


@query("k6_gate_combine", f"{P}, {DECISIONS} SELECT method, CASE max(CASE decision WHEN 'FAIL' THEN 2 WHEN 'PASS' THEN 0 ELSE 1 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'INDETERMINATE' ELSE 'PASS' END AS gate, coalesce(string_agg(DISTINCT CASE WHEN decision <> 'PASS' THEN profile || load END, ',' ORDER BY CASE WHEN decision <> 'PASS' THEN profile || load END), '') AS reasons FROM dec GROUP BY 1")
def _(spark, d):
    s = points(spark, d).groupBy("method", "profile", "load").agg(*[F.sum(c).alias(c) for c in ("dropped", "offered", "timed_out")])
    dec = s.withColumn("decision", F.when(F.col("dropped") * 100 > F.col("offered") * 36, "FAIL").when(F.col("timed_out") * 100 > F.col("offered") * 24, "INDETERMINATE").otherwise("PASS"))
    return K.gate_combine(dec.withColumn("name", F.concat("profile", F.col("load").cast("string"))), ["method"], "decision", "name").withColumn("reasons", F.array_join("reasons", ","))


@query("k7_backend_work_gate", f"{P} SELECT seed, method, 10 * sum(dropped) <= 11 * sum(timed_out) AS near_bound, sum(checks) >= 10 * sum(dropped) AS tenfold, CASE WHEN 10 * sum(dropped) <= 11 * sum(timed_out) AND sum(checks) >= 10 * sum(dropped) THEN 'PASS' ELSE 'FAIL' END AS decision FROM points GROUP BY ALL")
def _(spark, d):
    p = points(spark, d).groupBy("seed", "method").agg(*[F.sum(c).alias(c) for c in ("dropped", "timed_out", "checks")])
    return K.backend_work_gate(p, "dropped", "timed_out", "checks").select("seed", "method", "near_bound", "tenfold", "decision")


@query("k8_look_decision", f"""{P}, g AS (SELECT method, profile, load, {t_sql(0.995, 'count(*) - 1')} * stddev_samp(ln(p99)) / sqrt(count(*)) AS h, min(p99) / 250 AS m FROM points GROUP BY ALL),
    a AS (SELECT round(max(exp(h) - 1), 6) AS widest, count(DISTINCT profile) AS strata, bool_and(coalesce(exp(h) - 1 <= 0.05, false)) AS precise, bool_and(coalesce(m >= 100, false)) AS timer_pass FROM g)
    SELECT *, CASE WHEN strata <> 1 THEN 'STOP_STRATA' WHEN NOT timer_pass THEN 'STOP_TIMER' WHEN precise THEN 'STOP_PRECISE' ELSE 'EXTEND' END AS decision FROM a""")
def _(spark, d):
    keys = ["method", "profile", "load"]
    s = T.log_t_summary(points(spark, d), keys, "p99", 0.01)
    s = s.join(points(spark, d).groupBy(*keys).agg((F.min("p99") / 250).alias("timer")), keys)
    return rounded(K.look_decision(s, "relative_half_width", 0.05, "profile", "timer", 100))


@query("k9_invalid_reason_subset", "SELECT user_id, len(list_filter(list(DISTINCT event_type), lambda x: x NOT IN ('click', 'view', 'error', 'signup'))) = 0 AS only_allowed FROM events GROUP BY 1")
def _(spark, d):
    r = src.table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("reasons"))
    return K.invalid_reason_subset(r, "reasons", ["click", "view", "error", "signup"]).select("user_id", "only_allowed")


@query("k10_state_invariants", """WITH s AS (SELECT user_id, list(DISTINCT event_type) FILTER (event_id % 5 = 0) AS cached, list(DISTINCT event_type) FILTER (event_id % 7 = 0) AS valid, count(*) % 3 > 0 AS certain, count(*) % 5 AS ev, count(*) % 7 AS dv, count(*) % 7 - (user_id % 10 = 0)::INT AS bv FROM events GROUP BY 1)
    SELECT user_id, concat_ws(',', CASE WHEN coalesce(list_has_any(cached, valid), false) THEN 'cached_proof_contradicts_valid_set' END, CASE WHEN certain AND ev < dv THEN 'edge_certain_but_stale' END, CASE WHEN dv <> bv THEN 'directory_and_backend_diverged' END) AS reasons FROM s
    WHERE coalesce(list_has_any(cached, valid), false) OR (certain AND ev < dv) OR dv <> bv""")
def _(spark, d):
    e = src.table(spark, d, "events")
    n = F.count(F.lit(1))
    s = e.groupBy("user_id").agg(F.collect_set(F.when(F.col("event_id") % 5 == 0, F.col("event_type"))).alias("cached"), F.collect_set(F.when(F.col("event_id") % 7 == 0, F.col("event_type"))).alias("valid"), (n % 3 > 0).alias("edge_certain"), (n % 5).alias("edge_version"), (n % 7).alias("directory_version"))
    s = s.withColumn("backend_version", F.col("directory_version") - F.when(F.col("user_id") % 10 == 0, 1).otherwise(0))
    return K.state_invariants(s).select("user_id", F.array_join("reasons", ",").alias("reasons"))


@query("k11_index_evidence_audit", "SELECT 10500 - count(*) FILTER (i >= 0 AND i < 10500) AS missing, count(*) FILTER (NOT (i >= 0 AND i < 10500)) AS \"outside\", count(*) FILTER (n > 1) AS duplicated, max(v) AS greatest, max(v) <= 1e9 AS within_limit FROM (SELECT o_orderkey * 3 // 4 AS i, count(*) AS n, max(o_totalprice) AS v FROM orders GROUP BY 1)")
def _(spark, d):
    o = src.table(spark, d, "orders").withColumn("i", F.floor(F.col("o_orderkey") * 3 / 4).cast("long"))
    return K.index_evidence_audit(o, "i", 10500, "o_totalprice", 1e9)


@query("k12_grid_refinement_audit", f"""{P}, c AS (SELECT method, load, sum(p99) / 20 AS v FROM points WHERE load % 2 = 1 AND profile = 'F' GROUP BY ALL), f AS (SELECT method, load, sum(p99) / 20 AS v FROM points WHERE load < 6 AND profile = 'O' GROUP BY ALL),
    m AS (SELECT method, (load + lead(load) OVER (PARTITION BY method ORDER BY load)) / 2.0::DOUBLE AS load FROM c)
    SELECT method, load::DOUBLE AS load, 'missing' AS problem FROM c WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.method = c.method AND f.load = c.load) UNION ALL SELECT method, load, 'no midpoint' FROM m WHERE load IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f WHERE f.method = m.method AND f.load = m.load)
    UNION ALL SELECT c.method, c.load::DOUBLE, 'moved' FROM c JOIN f USING (method, load) WHERE abs(c.v - f.v) > 0.01 * abs(c.v)""")
def _(spark, d):
    p = points(spark, d)
    c = p.where("load % 2 = 1 and profile = 'F'").groupBy("method", "load").agg((F.sum("p99") / 20).alias("v"))
    f = p.where("load < 6 and profile = 'O'").groupBy("method", "load").agg((F.sum("p99") / 20).alias("v"))
    return K.grid_refinement_audit(c, f, ["method"], "load", "v", 0.01)


@query("k13_replay_identities", """WITH r AS (SELECT user_id, count(*) AS positives, count(*) FILTER (value < 50) AS hits, count(*) FILTER (value >= 50) + (user_id % 9 = 0)::INT AS misses, count(*) FILTER (value >= 50) AS confirmations, count(*) FILTER (event_id % 8 = 0) AS races, count(*) FILTER (value >= 50 AND event_id % 2 = 0) AS admitted, count(*) FILTER (value >= 80) AS evictions FROM events GROUP BY 1)
    SELECT user_id, concat_ws(',', CASE WHEN hits + misses <> positives THEN 'hits_and_misses' END, CASE WHEN misses <> confirmations THEN 'confirmations' END, CASE WHEN admitted > confirmations THEN 'admitted' END, CASE WHEN evictions > admitted THEN 'removed' END) AS reasons FROM r WHERE hits + misses <> positives OR misses <> confirmations OR admitted > confirmations OR evictions > admitted""")
def _(spark, d):
    e = src.table(spark, d, "events")
    r = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("positives"), F.count_if(F.col("value") < 50).alias("hits"), F.count_if(F.col("value") >= 50).alias("confirmations"), F.count_if(F.col("event_id") % 8 == 0).alias("races"), F.count_if((F.col("value") >= 50) & (F.col("event_id") % 2 == 0)).alias("admitted"), F.count_if(F.col("value") >= 80).alias("evictions"))
    r = r.withColumns({"misses": F.col("confirmations") + F.when(F.col("user_id") % 9 == 0, 1).otherwise(0), "checks": F.col("confirmations") + F.col("races"), "expirations": F.lit(0)})
    return K.replay_identities(r).select("user_id", F.array_join("reasons", ",").alias("reasons"))


@query("k14_replication_check", f"""{P}, {PAIRS}, o AS (SELECT * FROM ({ratio_sql("(SELECT * FROM pairs WHERE profile = 'F')", 'p99', 'base_p99', 'method, load', 1 - 0.05 / 14, 1.05, True).replace('r AS (', 'WITH r AS (', 1)})), w AS (SELECT * FROM ({ratio_sql("(SELECT * FROM pairs WHERE profile = 'O')", 'p99', 'base_p99', 'method, load', 1 - 0.05 / 14, 1.05, True).replace('r AS (', 'WITH r AS (', 1)}))
    SELECT method, load, o.decision AS old, w.decision AS new, o.decision IS NOT DISTINCT FROM w.decision AS agrees FROM o FULL JOIN w USING (method, load)""")
def _(spark, d):
    p = pairs(spark, d)
    return K.replication_check(p.where("profile = 'F'"), p.where("profile = 'O'"), ["method", "load"], "p99", "base_p99", 0.05, 14, 1.05)


@query("k15_discrepancy_check", f"{SP}, r AS (SELECT spec, memory / 50.0::DOUBLE AS density, ffr, pow(memory / 50.0::DOUBLE, 3) AS re FROM specs) SELECT spec, abs(ffr - re) <= 0.05 AS explained FROM r WHERE abs(ffr - 0.5) > 0.05")
def _(spark, d):
    r = src.read_specs(spark, d).withColumns({"density": F.col("memory") / 50.0, "analytic": F.lit(0.5)})
    return K.discrepancy_check(r, "ffr", "analytic", "density", 3, 0.05).select("spec", "explained")
