"""Queries of scalar functions and service metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import metrics as M
from ..sources import tables as src
from .registry import ATTEMPTS, POINTS, SPECS, encoded, h32, query, rounded

A = f"WITH {ATTEMPTS}"
P = f"WITH {POINTS}"
REGION = f"{h32(encoded('account'))} % 8"
INVALID = "label IN ('INVALID_DISTINCT', 'INVALID_REPEATED')"


@query("b1_keys", f"{A} SELECT count(DISTINCT (account, generation, version, token)) AS tuples, count(DISTINCT (account, generation, version)) AS scopes FROM attempts")
def _(spark, d):
    a = src.read_attempts(spark, d).groupBy(S.scope_key().alias("s"), F.col("token")).agg(F.count(F.lit(1)).alias("n"))
    return a.groupBy("s").agg(F.count(F.lit(1)).alias("t")).agg(F.sum("t").alias("tuples"), F.count(F.lit(1)).alias("scopes"))


@query("b2_label_to_result", f"{A} SELECT label, result, {INVALID} AS existing_invalid, count(*) AS n FROM attempts GROUP BY ALL")
def _(spark, d):
    a = src.read_attempts(spark, d)
    return a.groupBy("label", S.label_to_result("label").alias("result"), S.is_existing_invalid("label").alias("existing_invalid")).agg(F.count(F.lit(1)).alias("n"))


@query("b3_scope_at", f"{A} SELECT event_index, generation, version, round(age_fraction, 6) AS age_fraction, rotation_recent FROM attempts")
def _(spark, d):
    e = src.table(spark, d, "events").select(F.col("event_id").alias("event_index"), F.col("user_id").alias("account"))
    return rounded(e.withColumns(S.scope_at("event_index", "account", src.CHURN_PERIOD, src.ROTATION_PERIOD)).drop("account"))


@query("b4_encode_fields", f"SELECT n_nationkey, {encoded('n_nationkey', 'n_name', 'n_regionkey')} AS encoded FROM nation")
def _(spark, d):
    return src.table(spark, d, "nation").select("n_nationkey", S.encode_fields("n_nationkey", "n_name", "n_regionkey").alias("encoded"))


@query("b6_hash_unit", f"SELECT event_id, round({h32("'7|' || event_id::VARCHAR")} / 4294967296.0::DOUBLE, 9) AS u FROM events")
def _(spark, d):
    return rounded(src.table(spark, d, "events").select("event_id", S.hash_unit("event_id", 7).alias("u")), 9)


@query("b7_hash_region", f"SELECT {h32(encoded('user_id'))} % 8 AS region, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return src.table(spark, d, "events").groupBy(S.hash_region(8, "user_id").alias("region")).agg(F.count(F.lit(1)).alias("n"))


@query("b8_sticky_sample", f"SELECT event_id FROM events WHERE {h32("'3:0:16|' || user_id::VARCHAR")} / 4294967296.0::DOUBLE < 0.25")
def _(spark, d):
    return src.table(spark, d, "events").where(S.sticky_sample("user_id", 3, 0, 16, 0.25)).select("event_id")


@query("b9_token_prefix", f"SELECT n_nationkey, {", ".join(f"CAST('0x' || substr(sha256(n_name), 1, {-(-b // 4)}) AS BIGINT) >> {-b % 4} AS p{b}" for b in (8, 12, 18, 20, 32))}, substr(sha256(n_name), 1, 16) AS p64, substr(sha256(n_name), 1, 15) || printf('%x', CAST('0x' || substr(sha256(n_name), 16, 1) AS INT) & 12) AS p62, substr(sha256(n_name), 1, 32) AS p128 FROM (SELECT event_id AS n_nationkey, event_type || event_id AS n_name FROM events)")
def _(spark, d):
    e = src.table(spark, d, "events").select(F.col("event_id").alias("n_nationkey"), F.sha2(F.concat("event_type", F.col("event_id").cast("string")), 256).alias("t"))
    return e.select("n_nationkey", *[S.token_prefix("t", b).alias(f"p{b}") for b in (8, 12, 18, 20, 32, 62, 64, 128)])


@query("b10_probe_positions", f"SELECT event_id, i, ({h32('event_id::VARCHAR')} + i * ({h32('event_id::VARCHAR', 1)} | 1)) % 1000 AS position FROM events, range(0, 4) r(i)")
def _(spark, d):
    e = src.table(spark, d, "events")
    return e.select("event_id", F.posexplode(S.probe_positions("event_id", 4, 1000)).alias("i", "position")).withColumn("i", F.col("i").cast("long"))


@query("b11_bloom_fpr", f"WITH {SPECS} SELECT spec, round(pow(1 - exp(4 * n * ln(1 - 1.0::DOUBLE / m)), 4), 9) AS finite, round(pow(1 - exp(-4.0::DOUBLE * n / m), 4), 9) AS standard FROM (SELECT spec, memory * 64 AS m, 1 + spec % 200 AS n FROM specs)")
def _(spark, d):
    s = src.read_specs(spark, d).select("spec", (F.col("memory") * 64).alias("m"), (1 + F.col("spec") % 200).alias("n"))
    return rounded(s.select("spec", S.bloom_fpr_finite("m", "n", F.lit(4)).alias("finite"), S.bloom_fpr_standard("m", "n", F.lit(4)).alias("standard")), 9)


@query(
    "b12_blocked_bloom_fpr",
    f"""WITH {SPECS}, s AS (SELECT DISTINCT 2 + memory % 20 AS b, 100 + spec % 40 * 25 AS n FROM specs),
    w AS (SELECT b, n, greatest(0, floor(n / b - 12 * sqrt(n / b * (1 - 1 / b)) - 8))::BIGINT AS lo, least(n, ceil(n / b + 12 * sqrt(n / b * (1 - 1 / b)) + 8))::BIGINT AS hi FROM (SELECT b::DOUBLE AS b, n::DOUBLE AS n FROM s)),
    x AS (SELECT b, n, exp(lgamma(n + 1) - lgamma(v + 1) - lgamma(n - v + 1) + v * ln(1 / b) + (n - v) * ln(1 - 1 / b)) AS p, CASE WHEN v = 0 THEN 0 ELSE pow(1 - exp(6 * v * ln(1 - 1 / 512.0::DOUBLE)), 6) END AS r
          FROM (SELECT b, n, unnest(range(lo, hi + 1))::DOUBLE AS v FROM w))
    SELECT b::BIGINT AS blocks, n::BIGINT AS n, round(sum(p * r) / sum(p), 9) AS fpr FROM x GROUP BY ALL""",
)
def _(spark, d):
    s = src.read_specs(spark, d).select((2 + F.col("memory") % 20).alias("blocks"), (100 + F.col("spec") % 40 * 25).alias("n")).distinct()
    return rounded(s.withColumn("fpr", S.blocked_bloom_fpr("blocks", F.lit(512), "n", F.lit(6))), 9)


@query("b13_fingerprint_fpr", f"WITH {SPECS} SELECT spec, round(1 - pow(1 - (memory / 60.0::DOUBLE) / (pow(2, 8) - 1), 8), 9) AS fpr FROM specs")
def _(spark, d):
    return rounded(src.read_specs(spark, d).select("spec", S.fingerprint_fpr(F.col("memory") / 60.0, F.lit(8), F.lit(4)).alias("fpr")), 9)


@query(
    "b14_expected_probes",
    f"""WITH {SPECS}, s AS (SELECT spec, memory / 50.0::DOUBLE AS p, memory AS b FROM specs) SELECT spec, round(CASE WHEN p = 1 THEN 5 ELSE (1 - pow(p, 5)) / (1 - p) END, 9) AS one_layer,
    round(1 + (b / 64.0::DOUBLE) * (1 + (b - 1) / 63.0::DOUBLE * (1 + greatest(0, b - 2) / 62.0::DOUBLE)), 9) AS no_replacement,
    round(CASE WHEN p = 1 THEN 3 ELSE (1 - pow(p, 3)) / (1 - p) END + pow(p, 3) * (1 - pow(0.5, 2)) / 0.5, 9) AS layers FROM s""",
)
def _(spark, d):
    s = src.read_specs(spark, d).withColumns({"p": F.col("memory") / 50.0, "ps": F.array(F.col("memory") / 50.0, F.lit(0.5)), "ks": F.array(F.lit(3), F.lit(2))})
    return rounded(s.select("spec", S.expected_probes("p", F.lit(5)).alias("one_layer"), S.expected_probes_without_replacement("memory", F.lit(64), 4).alias("no_replacement"), S.expected_probes_layers("ps", "ks").alias("layers")), 9)


@query("b15_memory_bytes", f"WITH {SPECS} SELECT spec, ceil(memory / 0.75::DOUBLE)::BIGINT * 48 + 1024 AS bytes FROM specs")
def _(spark, d):
    return src.read_specs(spark, d).select("spec", S.memory_bytes("memory", 41, 16, 0.75, 1024).alias("bytes"))


@query(
    "b15_cache_memory",
    f"""WITH {SPECS}, c AS (SELECT spec, memory, ['lru', 'fixed_ttl', 'lfu', 'tinylfu', NULL][1 + spec % 5] AS policy FROM specs), b AS (SELECT *, CASE WHEN policy IS NULL THEN 0 ELSE memory * 76 END AS entry_bytes,
        CASE policy WHEN 'lru' THEN memory * 8 WHEN 'fixed_ttl' THEN memory * 8 WHEN 'lfu' THEN memory * 16 WHEN 'tinylfu' THEN NULL ELSE 0 END AS policy_bytes, CASE WHEN policy IS NULL THEN 0 ELSE 96 END AS fixed_bytes FROM c)
    SELECT spec, entry_bytes::BIGINT AS entry_bytes, policy_bytes::BIGINT AS policy_bytes, fixed_bytes::BIGINT AS fixed_bytes, (entry_bytes + policy_bytes + fixed_bytes)::BIGINT AS total_bytes, policy IS DISTINCT FROM 'tinylfu' AS accounted FROM b""",
)
def _(spark, d):
    policy = F.array(*map(F.lit, ["lru", "fixed_ttl", "lfu", "tinylfu", None]))[(F.col("spec") % 5).cast("int")]
    bytes_ = S.cache_memory("memory", policy, S.slot_bytes(41, 8, 4, 5, 16), {"lru": 8, "fixed_ttl": 8, "lfu": 16}, 96)
    return src.read_specs(spark, d).select("spec", *[c.alias(name) for name, c in bytes_.items()])


@query(
    "b16_timing_features",
    """WITH s AS (SELECT o_orderkey, o_totalprice, list(l_quantity::BIGINT ORDER BY l_linenumber, l_partkey, l_quantity) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
    SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS log_o_totalprice, len(q)::BIGINT AS n_sizes, q[1] AS first_size, q[-1] AS last_size, list_min(q) AS min_size, list_max(q) AS max_size,
           list_sum(list_transform(q, lambda x, i: x * i))::BIGINT AS weighted_sizes FROM s""",
)
def _(spark, d):
    li = src.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("x"))
    s = src.table(spark, d, "orders").join(li, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("q", F.transform("x", lambda r: r["l_quantity"].cast("long")))
    return rounded(s.select("o_orderkey", *[c.alias(n) for n, c in S.timing_features(["o_totalprice"], "q").items()]))


@query("b17_semantic_id", """SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS id FROM nation""")
def _(spark, d):
    return src.table(spark, d, "nation").select("n_nationkey", S.semantic_id("n_nationkey", "n_name", "n_regionkey").alias("id"))


@query("b18_exact_ratio", f"{P} SELECT seed, method, profile, load, round_even(checks::DOUBLE / offered, 6) AS ratio, dropped * 10 <= offered * 4 AS within FROM points")
def _(spark, d):
    p = src.read_points(spark, d)
    return p.select("seed", "method", "profile", "load", S.exact_ratio("checks", "offered", 6).cast("double").alias("ratio"), S.at_most_ratio("dropped", "offered", 4, 10).alias("within"))


@query(
    "b19_check_row",
    "SELECT event_id, concat_ws(',', CASE WHEN NOT value BETWEEN 0 AND 80 THEN 'range' END, CASE WHEN NOT event_type IN ('signup', 'click', 'view', 'purchase') THEN 'enum' END, CASE WHEN NOT regexp_matches(props, '\"k\": [0-9]$|\"k\": [0-9]}') THEN 'shape' END) AS broken FROM events",
)
def _(spark, d):
    e = src.table(spark, d, "events")
    rules = {"range": F.col("value").between(0, 80), "enum": F.col("event_type").isin("signup", "click", "view", "purchase"), "shape": F.col("props").rlike(r'"k": [0-9]$|"k": [0-9]}')}
    return e.select("event_id", F.array_join(S.violations(rules), ",").alias("broken"))


@query(
    "b20_is_exact_mismatch",
    f"""{A}, e AS (SELECT account, list_sort(list(DISTINCT event_type)) AS ids FROM attempts GROUP BY 1), c AS (SELECT account, list_sort(list(DISTINCT event_type)) AS ids FROM attempts WHERE event_index % 10 < 7 GROUP BY 1)
    SELECT event_index, coalesce(result = 'CREDENTIAL_MISMATCH' AND event_index % 5 > 0 AND version = version - (event_index % 4 = 0)::INT AND e.ids = c.ids, false) AS learnable FROM attempts JOIN e USING (account) LEFT JOIN c USING (account)""",
)
def _(spark, d):
    a = src.read_attempts(spark, d)
    e = a.groupBy("account").agg(F.collect_set("event_type").alias("expected_ids"))
    c = a.where("event_index % 10 < 7").groupBy("account").agg(F.collect_set("event_type").alias("checked_ids"))
    rows = a.join(e, "account").join(c, "account", "left").withColumns(
        {"status": F.when(F.col("event_index") % 5 > 0, "PRESENT").otherwise("STALE"), "checked": F.col("version") - F.when(F.col("event_index") % 4 == 0, 1).otherwise(0)}
    )
    return rows.select("event_index", S.is_exact_mismatch("version", "checked", "expected_ids", "checked_ids", "result").alias("learnable"))


TRAFFIC = f"""t AS (SELECT {REGION} AS region, account, generation, version, token, count(*) FILTER ({INVALID}) AS i, count(*) FILTER (label = 'VALID') AS v, count(*) FILTER ({INVALID} AND event_index % 3 = 0) AS m,
    count(*) FILTER ({INVALID} AND event_index % 3 = 0 AND {h32('token')} % 10 < 4) AS pm FROM attempts GROUP BY ALL),
    traffic AS (SELECT region, count(DISTINCT account) AS accounts, count(*) FILTER (i > 0) AS distinct_invalid, sum(i)::BIGINT AS invalid_requests, sum(v)::BIGINT AS valid_requests, sum(m)::BIGINT AS misses, sum(pm)::BIGINT AS positive_misses FROM t GROUP BY region)"""


def _traffic(spark, d):
    a = src.read_attempts(spark, d).withColumn("region", S.hash_region(src.REGIONS, "account"))
    return M.region_traffic(a, "region", ["account", "generation", "version", "token"], S.is_existing_invalid("label"), F.col("label") == "VALID", F.col("event_index") % 3 == 0, S.hash32("token") % 10 < 4)


@query("e2_region_traffic", f"{A}, {TRAFFIC} SELECT * FROM traffic")
def _(spark, d):
    return _traffic(spark, d)


@query(
    "e3_predict_cost",
    f"""WITH RECURSIVE {ATTEMPTS}, {TRAFFIC}, s AS (SELECT sum(distinct_invalid * f) AS first_seen_checks, sum(invalid_requests * f) AS static_checks, sum(positive_misses)::BIGINT AS adaptive_checks, sum(valid_requests)::BIGINT AS valid_checks,
        sum(invalid_requests + valid_requests)::BIGINT AS requests FROM (SELECT *, 0.01::DOUBLE * (1 + region) AS f FROM traffic)),
    a AS (SELECT *, (valid_checks + adaptive_checks) / 100.0::DOUBLE AS arrival_rps FROM s), o AS (SELECT *, arrival_rps / (1000 / 150.0::DOUBLE) AS offered FROM a),
    b AS (SELECT 0 AS k, 1.0::DOUBLE AS e, (SELECT offered FROM o) AS x UNION ALL SELECT k + 1, x * e / (k + 1 + x * e), x FROM b WHERE k < 16),
    z AS (SELECT o.*, offered / 16 AS utilisation, (SELECT e FROM b WHERE k = 16) AS eb FROM o),
    q AS (SELECT *, CASE WHEN arrival_rps = 0 THEN 0 WHEN utilisation < 1 THEN eb / (1 - utilisation + utilisation * eb) / (16 * (1000 / 150.0::DOUBLE) - arrival_rps) * 1000 END AS queue_ms FROM z)
    SELECT round(first_seen_checks, 6) AS first_seen_checks, round(static_checks, 6) AS static_checks, adaptive_checks, valid_checks, requests, round(arrival_rps, 6) AS arrival_rps, round(utilisation, 6) AS utilisation, round(queue_ms, 6) AS queue_ms,
           queue_ms IS NOT NULL AS stable, round(150 + queue_ms, 6) AS forwarded_ms, round((valid_checks + adaptive_checks) / requests::DOUBLE * (150 + queue_ms), 6) AS mean_backend_ms FROM q""",
)
def _(spark, d):
    t = _traffic(spark, d).withColumn("ffr", 0.01 * (1 + F.col("region")))
    return rounded(M.predict_cost(t, "ffr", 100.0, 150.0, 16))


CASES = {"offered": "true", "accepted": "event_type <> 'error'", "immediate": "event_type = 'error'", "valid": "event_type = 'purchase'", "invalid": "event_type IN ('click', 'view')", "new": "event_type = 'signup'", "in_window": "value <= 80", "outside": "value > 80"}


@query("e4_outcome_counters", f"SELECT event_id // 2500 AS phase, {', '.join(f'count(*) FILTER ({c}) AS {n}' for n, c in CASES.items())} FROM events GROUP BY 1")
def _(spark, d):
    e = src.table(spark, d, "events").withColumn("phase", F.floor(F.col("event_id") / 2500).cast("long"))
    return M.outcome_counters(e, ["phase"], {n: F.expr(c) for n, c in CASES.items()})


@query(
    "e5_conservation_checks",
    f"""WITH c AS (SELECT event_id // 2500 AS phase, {', '.join(f'count(*) FILTER ({c}) AS {n}' for n, c in CASES.items())} FROM events GROUP BY 1)
    SELECT phase, offered = accepted + immediate AS terminal, offered = in_window + outside AS ingress, offered = valid + invalid AS classes, offered = accepted + immediate AND offered = in_window + outside AND offered = valid + invalid AS all_hold FROM c""",
)
def _(spark, d):
    e = src.table(spark, d, "events").withColumn("phase", F.floor(F.col("event_id") / 2500).cast("long"))
    c = M.outcome_counters(e, ["phase"], {n: F.expr(x) for n, x in CASES.items()})
    out = M.conservation_checks(c, {"terminal": (["offered"], ["accepted", "immediate"]), "ingress": (["offered"], ["in_window", "outside"]), "classes": (["offered"], ["valid", "invalid"])})
    return out.select("phase", "terminal", "ingress", "classes", "all_hold")


@query("e6_rates", f"{P} SELECT seed, method, round(sum(dropped) / nullif(sum(offered), 0)::DOUBLE, 6) AS drop_rate, round(sum(timed_out) / nullif(sum(offered), 0)::DOUBLE, 6) AS timeout_rate, round(sum(checks) / nullif(sum(CASE WHEN load > 9 THEN 1 ELSE 0 END), 0)::DOUBLE, 6) AS no_rate FROM points GROUP BY ALL")
def _(spark, d):
    p = src.read_points(spark, d).groupBy("seed", "method").agg(*[F.sum(c).alias(c) for c in ("offered", "dropped", "timed_out", "checks")], F.count_if(F.col("load") > 9).alias("none"))
    return rounded(p.select("seed", "method", M.rate(F.col("dropped"), F.col("offered")).alias("drop_rate"), M.rate(F.col("timed_out"), F.col("offered")).alias("timeout_rate"), M.rate(F.col("checks"), F.col("none")).alias("no_rate")))


@query("e7_busy_overlap", "SELECT worker, sum(greatest(0, least(s + d, 400000) - greatest(s, 100000)))::BIGINT AS busy, round(sum(greatest(0, least(s + d, 400000) - greatest(s, 100000))) / (4 * 300000.0::DOUBLE), 6) AS utilisation FROM (SELECT user_id % 10 AS worker, event_id * 50 AS s, (value * 100)::BIGINT AS d FROM events) GROUP BY 1")
def _(spark, d):
    e = src.table(spark, d, "events").select((F.col("user_id") % 10).alias("worker"), (F.col("event_id") * 50).alias("start"), (F.col("event_id") * 50 + F.round(F.col("value") * 100).cast("long")).alias("stop"))
    return rounded(M.busy_overlap(e, ["worker"], "start", "stop", F.lit(100000), F.lit(400000), 4))


@query(
    "e8_log_histogram",
    """WITH h AS (SELECT event_type, CASE WHEN v <= 1 THEN 0 ELSE ceil(ln(v) / ln(1.01::DOUBLE)) END::BIGINT AS b, count(*) AS n, max(v) AS m FROM (SELECT event_type, round(value * 1000)::BIGINT AS v FROM events) GROUP BY ALL),
    c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY b) AS below, sum(n) OVER (PARTITION BY event_type) AS t FROM h)
    SELECT event_type, round(min(pow(1.01::DOUBLE, b)) FILTER (0.5 * (t - 1) < below), 6) AS p50, round(min(pow(1.01::DOUBLE, b)) FILTER (0.99 * (t - 1) < below), 6) AS p99, max(m) AS maximum, sum(n)::BIGINT AS n FROM c GROUP BY 1""",
)
def _(spark, d):
    e = src.table(spark, d, "events").withColumn("v", F.round(F.col("value") * 1000).cast("long"))
    return rounded(M.log_histogram(e, ["event_type"], "v", 1.01, {"p50": 0.5, "p99": 0.99}))


@query("e9_distribution", "SELECT event_type, count(value) AS n, min(value) AS least, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS greatest, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def _(spark, d):
    return rounded(M.distribution(src.table(spark, d, "events"), ["event_type"], "value"))


@query("e10_nearest_rank_p99", "SELECT event_type, value AS nearest_rank FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r = (99 * n + 99) // 100")
def _(spark, d):
    return M.nearest_rank(src.table(spark, d, "events"), ["event_type"], "value", 99, 100)


@query("e11_value_histogram", "SELECT l_returnflag, string_agg(q || ':' || n, ',' ORDER BY q) AS histogram FROM (SELECT l_returnflag, l_quantity::BIGINT AS q, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1")
def _(spark, d):
    h = M.value_histogram(src.table(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("long")), ["l_returnflag"], "q")
    return h.withColumn("histogram", F.array_join(F.transform("histogram", lambda x: F.concat_ws(":", x["value"], x["count"])), ","))


@query("e11_histogram_percentile", "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.95), 6) AS percentile FROM lineitem GROUP BY 1")
def _(spark, d):
    return rounded(M.histogram_percentile(M.value_histogram(src.table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity"), ["l_returnflag"], 0.95))


@query("e12_resource_summary", "SELECT user_id % 6 AS worker, min(event_id) AS rss_min, max(event_id) AS rss_peak, round(avg(q), 6) AS queue_mean, max(q) AS queue_peak, count(*) AS samples, count(q) = count(*) AS complete FROM (SELECT *, CASE WHEN user_id % 6 < 4 OR value < 50 THEN value END AS q FROM events) GROUP BY 1")
def _(spark, d):
    e = src.table(spark, d, "events").withColumns({"worker": F.col("user_id") % 6, "q": F.when((F.col("user_id") % 6 < 4) | (F.col("value") < 50), F.col("value"))})
    return rounded(M.resource_summary(e, ["worker"], "event_id", "q"))


@query(
    "e13_first_last_decile_growth",
    """WITH r AS (SELECT user_id % 200 AS w, value, row_number() OVER (PARTITION BY user_id % 200 ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id % 200) AS n FROM events)
    SELECT w AS worker, max(n) AS n, CASE WHEN max(n) >= 70 THEN round(avg(value) FILTER (r <= n // 10), 6) END AS first_mean, CASE WHEN max(n) >= 70 THEN round(avg(value) FILTER (r > n - n // 10), 6) END AS last_mean,
           CASE WHEN max(n) >= 70 THEN round(avg(value) FILTER (r > n - n // 10) - avg(value) FILTER (r <= n // 10), 6) END AS growth FROM r GROUP BY w""".replace(">= 70", ">= 100"),
)
def _(spark, d):
    e = src.table(spark, d, "events").withColumn("worker", F.col("user_id") % 200)
    return rounded(M.first_last_decile_growth(e, ["worker"], "event_id", "value"))


@query(
    "e14_multiplicity_profile",
    """WITH m AS (SELECT user_id % 5 AS run, user_id, event_type, count(*) AS m FROM events GROUP BY ALL), c AS (SELECT run, m, count(*) AS n FROM m GROUP BY ALL)
    SELECT run, sum(n)::BIGINT AS tuples, min(m) AS least, max(m) AS greatest, sha256(string_agg(lpad(m::VARCHAR, 20, '0') || ':' || n, ',' ORDER BY lpad(m::VARCHAR, 20, '0') || ':' || n)) AS profile FROM c GROUP BY run""",
)
def _(spark, d):
    e = src.table(spark, d, "events").withColumn("run", F.col("user_id") % 5)
    return M.multiplicity_profile(e, ["run"], ["user_id", "event_type"])


@query("e15_pooled_and_stratified", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, grouping(event_type)::INT AS pooled FROM events GROUP BY ROLLUP (event_type)")
def _(spark, d):
    return rounded(M.pooled_and_stratified(src.table(spark, d, "events"), "event_type", [F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")]))


@query(
    "e16_delivery_shapes",
    "WITH s AS (SELECT l_orderkey % 8 AS g, l_orderkey % 50 AS port, list(l_linenumber ORDER BY l_linenumber) AS q FROM lineitem GROUP BY l_orderkey) SELECT g, count(DISTINCT q) AS shapes, count(DISTINCT port) AS ports, min(len(q))::BIGINT AS fewest_calls, max(len(q))::BIGINT AS most_calls, round(avg(len(q)), 6) AS mean_calls, quantile_cont(len(q)::DOUBLE, 0.5) AS p50_calls, quantile_cont(len(q)::DOUBLE, 0.95) AS p95_calls, quantile_cont(len(q)::DOUBLE, 0.99) AS p99_calls FROM s GROUP BY g",
)
def _(spark, d):
    out = rounded(M.delivery_shapes(deliveries(spark, d), ["g"], F.col("q"), "port"))
    return out.withColumns({c: F.col(c).cast("long") for c in ("fewest_calls", "most_calls")})


def deliveries(spark, d):
    s = src.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("q"))
    return s.withColumns({"g": F.col("l_orderkey") % 8, "port": F.col("l_orderkey") % 50})


@query(
    "e16_shape_counts",
    "WITH s AS (SELECT l_orderkey % 8 AS g, list(l_linenumber ORDER BY l_linenumber) AS q FROM lineitem GROUP BY l_orderkey) SELECT g, array_to_string(q, ',') AS shape, count(*) AS n FROM s GROUP BY g, q",
)
def _(spark, d):
    out = M.shape_counts(deliveries(spark, d), ["g"], F.col("q"))
    return out.select("g", F.array_join(F.col("shape").cast("array<string>"), ",").alias("shape"), "n")


@query("e17_response_signatures", "SELECT l_linenumber, count(DISTINCT l_returnflag || '|' || l_linestatus) AS signatures, count(DISTINCT l_returnflag || '|' || l_linestatus) = 1 AS uniform FROM lineitem GROUP BY 1")
def _(spark, d):
    return M.response_signature_count(src.table(spark, d, "lineitem"), ["l_linenumber"], S.semantic_id("l_returnflag", "l_linestatus"))


@query("e18_replay_ratios", f"{P} SELECT seed, method, profile, load, round(checks / offered::DOUBLE, 6) AS amplification, round(checks / nullif(dropped, 0)::DOUBLE, 6) AS work_fraction, round(dropped / checks::DOUBLE, 6) AS reduction_factor FROM points")
def _(spark, d):
    return rounded(M.replay_ratios(src.read_points(spark, d), "checks", "dropped", "offered").select("seed", "method", "profile", "load", "amplification", "work_fraction", "reduction_factor"))


@query("e19_matched_totals", f"{P} SELECT method, sum(dropped)::BIGINT AS mismatches, sum(checks)::BIGINT AS checks, round(avg(p99), 4) AS mean_p99, 300 - count(*) AS missing_points FROM points GROUP BY 1")
def _(spark, d):
    return rounded(M.matched_system_totals(src.read_points(spark, d), "method", "dropped", "checks", "p99", 300), 4)


@query("e20_order_digest", """WITH h AS (SELECT event_id // 500 AS shard, list(sha256(concat_ws(chr(31), event_id, user_id, event_type, event_id % 97)) ORDER BY event_id) AS rows, count(*) AS n FROM events GROUP BY 1)
    SELECT shard, n, list_reduce(list_prepend('', rows), lambda s, r: sha256(s || r)) AS digest FROM h""")
def _(spark, d):
    e = src.table(spark, d, "events").withColumn("shard", F.floor(F.col("event_id") / 500).cast("long"))
    return M.order_digest(e.withColumn("rest", F.col("event_id") % 97), ["shard"], "event_id", "event_id", "user_id", "event_type", "rest")


@query("e20_digest_tree", """WITH h AS (SELECT user_id % 3 AS shard, sha256(concat_ws(chr(31), event_id, user_id, event_type)) AS h, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) - 1 AS k FROM events),
    l AS (SELECT shard, k // 64 AS k, count(*) AS n, sha256(string_agg(h, '' ORDER BY k)) AS h FROM h GROUP BY shard, h.k // 64),
    m AS (SELECT shard, k // 64 AS k, sum(n) AS n, count(*) AS c, sha256(string_agg(h, '' ORDER BY k)) AS h, min(h) AS one FROM l GROUP BY shard, l.k // 64),
    t AS (SELECT shard, sum(n)::BIGINT AS n, count(*) AS c, sum(c) AS leaves, sha256(string_agg(h, '' ORDER BY k)) AS h, min(h) AS two, min(one) AS one FROM m GROUP BY shard)
    SELECT shard, n, CASE WHEN leaves = 1 THEN one WHEN c = 1 THEN two ELSE h END AS digest FROM t""")
def _(spark, d):
    """Shards of a third of all rows each; up to 64 ^ 3 rows a shard are three levels."""
    return M.digest_tree(src.table(spark, d, "events").withColumn("shard", F.col("user_id") % 3), ["shard"], "event_id", "event_id", "user_id", "event_type", leaf=64)


BINS = "bins AS (SELECT least(19, floor(u * 20))::BIGINT AS bin, count(*) FILTER (event_type = 'purchase') AS members, count(*) FILTER (event_type <> 'purchase') AS others FROM (SELECT event_type, value / 200.0 AS u FROM events) GROUP BY 1)"


def _bins(spark, d):
    return M.bin_counts(src.table(spark, d, "events").withColumn("u", F.col("value") / 200.0), "u", 20, F.col("event_type") == "purchase")


@query("e21_bin_counts", f"WITH {BINS} SELECT * FROM bins")
def _(spark, d):
    return _bins(spark, d)


@query("e22_total_variation", f"WITH {BINS} SELECT round(sum(abs(p - q)) / 2, 9) AS total_variation, round(min(CASE WHEN p > 0 THEN q / p END), 9) AS density_ratio FROM (SELECT members / (SELECT sum(members) FROM bins)::DOUBLE AS p, others / (SELECT sum(others) FROM bins)::DOUBLE AS q FROM bins)")
def _(spark, d):
    return rounded(M.compare_masses(_bins(spark, d), "members", "others"), 9)


@query("e22_predicate_mass", f"WITH {BINS} SELECT round(sum(members) FILTER (bin < 7) / sum(members)::DOUBLE, 9) AS predicate_mass FROM bins")
def _(spark, d):
    return rounded(M.predicate_mass(_bins(spark, d), "members", F.col("bin") < 7), 9)
