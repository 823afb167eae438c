"""Queries of joins, grids, fronts and screens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import joins as J
from ..operators import screens as C
from ..sources import tables as src
from .registry import ATTEMPTS, MEMBERS, POINTS, SPECS, VERSIONS, encoded, h32, query, rounded

A = f"WITH {ATTEMPTS}"
AM = f"WITH {ATTEMPTS}, {MEMBERS}"
P = f"WITH {POINTS}"
REGION = f"{h32(encoded('account'))} % 8"
M, K, BLOCKS = 4096, 5, 8


@query(
    "c1_pair_with_baseline",
    f"""{P} SELECT c.seed, c.method, c.profile, c.load, round(c.p99, 6) AS p99, round(b.p99, 6) AS base_p99, c.offered <> b.offered AS offered_differs
    FROM points c JOIN points b ON b.method = 'A' AND c.method <> 'A' AND c.seed = b.seed AND c.profile = b.profile AND c.load = b.load""",
)
def _(spark, d):
    out = J.pair_with_baseline(src.read_points(spark, d), "A", "method", ["seed", "profile", "load"], ["p99"], ["offered"])
    return rounded(out.select("seed", "method", "profile", "load", "p99", "base_p99", (F.size("mismatched") > 0).alias("offered_differs")))


@query("c2_exact_screen", f"{AM} SELECT event_index, m.account IS NOT NULL AS represented FROM attempts a LEFT JOIN members m ON a.account = m.account AND a.token = m.token")
def _(spark, d):
    a = src.read_attempts(spark, d)
    return C.exact_screen(a, src.read_members(a), ["account", "token"]).select("event_index", "represented")


@query(
    "c3_directory_asof",
    f"""{A}, v AS (SELECT account, version, min(event_index) AS valid_from FROM attempts WHERE account % 11 <> 0 GROUP BY ALL),
    rep AS (SELECT account % 3 AS edge, account, version, valid_from + 400 AS valid_from FROM v WHERE account % 7 <> 0),
    q AS (SELECT event_index, CASE WHEN account % 13 = 0 THEN account + 1 ELSE account END AS account FROM attempts),
    x AS (SELECT q.event_index, q.account, q.account % 3 AS edge, (SELECT arg_max(v.version, (v.valid_from, v.version)) FROM v WHERE v.account = q.account AND v.valid_from <= q.event_index) AS current,
          (SELECT arg_max(r.version, (r.valid_from, r.version)) FROM rep r WHERE r.account = q.account AND r.edge = q.account % 3 AND r.valid_from <= q.event_index) AS seen FROM q)
    SELECT event_index, account, current, seen, CASE WHEN current IS NULL THEN 'MISSING' WHEN seen IS NULL THEN 'UNCERTAIN' WHEN seen <> current THEN 'STALE' ELSE 'PRESENT' END AS status FROM x""",
)
def _(spark, d):
    a = src.read_attempts(spark, d)
    v = a.where("account % 11 <> 0").groupBy("account", "version").agg(F.min("event_index").alias("valid_from"))
    rep = v.where("account % 7 <> 0").select((F.col("account") % 3).alias("edge"), "account", "version", (F.col("valid_from") + 400).alias("valid_from"))
    alias = a.where("account % 13 = 0").select(F.col("account").alias("alias"), (F.col("account") + 1).alias("canonical")).distinct()
    q = a.select("event_index", "account").withColumn("edge", F.when(F.col("account") % 13 == 0, F.col("account") + 1).otherwise(F.col("account")) % 3)
    return J.directory_asof(q, v, rep, alias).select("event_index", "account", "current", "seen", "status")


@query(
    "c4_certificate_cover",
    f"""{A}, views AS (SELECT event_index, account % 4 AS edge, account, generation, version, event_index // 50 AS directory_epoch FROM attempts),
    cur AS (SELECT account, generation, version, count(*) % 3 AS current_epoch FROM attempts GROUP BY ALL),
    cert AS (SELECT account % 4 AS edge, account, generation, version, max(event_index) // 60 AS watermark, count(*) % 2 AS representation_epoch FROM attempts GROUP BY ALL)
    SELECT event_index, EXISTS (SELECT 1 FROM cert c JOIN cur u USING (account, generation, version) WHERE c.edge = v.edge AND c.account = v.account AND c.generation = v.generation AND c.version = v.version
        AND c.representation_epoch = u.current_epoch AND c.watermark >= v.directory_epoch) AS covered FROM views v""",
)
def _(spark, d):
    a = src.read_attempts(spark, d)
    scope = ["account", "generation", "version"]
    edge = (F.col("account") % 4).alias("edge")
    views = a.select("event_index", edge, *scope, F.floor(F.col("event_index") / 50).cast("long").alias("directory_epoch"))
    cur = a.groupBy(*scope).agg((F.count(F.lit(1)) % 3).alias("current_epoch"))
    cert = a.groupBy(edge, *scope).agg(F.floor(F.max("event_index") / 60).cast("long").alias("watermark"), (F.count(F.lit(1)) % 2).alias("representation_epoch"))
    return J.certificate_cover(views, cert, scope, cur).select("event_index", "covered")


@query(
    "c5_coverage_diff",
    f"""{P}, e AS (SELECT s AS seed, m AS method, l AS load FROM range(0, 22) a(s), (VALUES ('A'), ('N'), ('R')) b(m), range(1, 8) c(l)), o AS (SELECT DISTINCT seed, method, load FROM points WHERE seed < 19)
    (SELECT seed, method, load, 'missing' AS problem FROM (SELECT * FROM e EXCEPT SELECT * FROM o)) UNION ALL (SELECT seed, method, load, 'extra' FROM (SELECT * FROM o EXCEPT SELECT * FROM e))""",
)
def _(spark, d):
    e = J.expand_grid(spark, {"seed": list(range(22)), "method": ["A", "N", "R"], "load": list(range(1, 8))})
    e = e.select(F.col("seed").cast("long").alias("seed"), "method", F.col("load").cast("long").alias("load"))
    return J.coverage_diff(e, src.read_points(spark, d).where("seed < 19"), ["seed", "method", "load"])


@query("c6_case_pairs", f"""{P}, c AS (SELECT seed, profile || method AS case_, sum(checks)::BIGINT AS v FROM points GROUP BY ALL)
    SELECT a.seed, a.case_ AS case_a, b.case_ AS case_b, a.v AS value_a, b.v AS value_b FROM c a JOIN c b ON a.seed = b.seed AND a.case_ < b.case_""")
def _(spark, d):
    c = src.read_points(spark, d).groupBy("seed", F.concat("profile", "method").alias("case")).agg(F.sum("checks").alias("v"))
    return J.case_pairs(c, ["seed"], "case", "v")


PARETO2 = f"WITH {SPECS} SELECT spec, family FROM specs a WHERE NOT EXISTS (SELECT 1 FROM specs b WHERE b.family = a.family AND b.memory <= a.memory AND b.ffr <= a.ffr AND (b.memory < a.memory OR b.ffr < a.ffr))"


@query("c7_pareto_front", PARETO2)
def _(spark, d):
    return J.pareto_front(src.read_specs(spark, d), ["memory", "ffr"], ["family"]).select("spec", "family")


@query(
    "c7_pareto_front3",
    f"""WITH {SPECS}, t AS (SELECT *, {h32('spec::VARCHAR')} % 50 AS latency FROM specs) SELECT spec, family FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.family = a.family AND b.memory <= a.memory AND b.ffr <= a.ffr AND b.latency <= a.latency
    AND (b.memory < a.memory OR b.ffr < a.ffr OR b.latency < a.latency))""",
)
def _(spark, d):
    t = src.read_specs(spark, d).withColumn("latency", S.hash32("spec") % 50)
    return J.pareto_front(t, ["memory", "latency", "ffr"], ["family"]).select("spec", "family")


@query(
    "c8_certified_front",
    f"WITH {SPECS}, t AS (SELECT *, ffr * 0.95 AS low, ffr * 1.05 AS high FROM specs) SELECT spec, family FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.family = a.family AND b.memory <= a.memory AND b.high < a.low)",
)
def _(spark, d):
    t = src.read_specs(spark, d).withColumns({"low": F.col("ffr") * 0.95, "high": F.col("ffr") * 1.05})
    return J.certified_front(t, ["family"], "memory", "low", "high").select("spec", "family")


@query(
    "c9_expand_grid",
    f"WITH {SPECS} SELECT family, bits, hashes, n FROM (SELECT family, count(*) AS n FROM specs GROUP BY 1), (VALUES (8), (12), (16)) b(bits), range(1, 5) h(hashes) WHERE bits > 8 UNION ALL SELECT family, 8, NULL, count(*) FROM specs GROUP BY 1",
)
def _(spark, d):
    n = src.read_specs(spark, d).groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    grid = J.expand_grid(spark, {"bits": [8, 12, 16], "hashes": [1, 2, 3, 4]}, n, {"hashes": F.col("bits") > 8})
    return grid.select("family", "bits", F.col("hashes").cast("long").alias("hashes"), "n")


@query("c10_replicate_trace", "SELECT s_suppkey AS key, copy, copy * (SELECT count(*) FROM supplier) + s_suppkey AS pos, (copy * (SELECT count(*) FROM supplier) + s_suppkey) * 25 AS ts_ms FROM supplier, range(0, 10) c(copy)")
def _(spark, d):
    s = src.table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"))
    return J.replicate_trace(s.withColumn("rank", F.col("key")), "key", "rank", 10, "round_robin", 25, s.count()).withColumn("copy", F.col("copy").cast("long"))


@query(
    "c11_reference_integrity",
    """WITH reg AS (SELECT c_custkey AS session, CASE WHEN c_custkey % 2 = 0 THEN 'edge' ELSE 'backend' END AS role, c_nationkey AS endpoint FROM customer WHERE c_custkey % 17 <> 0),
    calls AS (SELECT o_orderkey AS id, o_custkey AS caller, (o_custkey + 1) % (SELECT max(c_custkey) + 1 FROM customer) AS callee, o_orderkey // 2 * (1 + o_orderkey % 5) AS connection FROM orders),
    n AS (SELECT connection FROM calls GROUP BY 1 HAVING count(*) > 1)
    SELECT id, CASE WHEN a.session IS NULL THEN 'unregistered' WHEN a.role <> 'edge' THEN 'role' WHEN a.endpoint <> id % 25 THEN 'endpoint' END AS caller_problem,
           CASE WHEN b.session IS NULL THEN 'unregistered' WHEN b.role <> 'backend' THEN 'role' WHEN b.endpoint <> id % 24 THEN 'endpoint' END AS callee_problem, connection IN (SELECT connection FROM n) AS repeated
    FROM calls LEFT JOIN reg a ON caller = a.session LEFT JOIN reg b ON callee = b.session
    WHERE a.session IS NULL OR a.role <> 'edge' OR a.endpoint <> id % 25 OR b.session IS NULL OR b.role <> 'backend' OR b.endpoint <> id % 24 OR connection IN (SELECT connection FROM n)""",
)
def _(spark, d):
    c = src.table(spark, d, "customer")
    top = c.agg(F.max("c_custkey") + 1).first()[0]
    reg = c.where("c_custkey % 17 <> 0").select(F.col("c_custkey").alias("session"), F.when(F.col("c_custkey") % 2 == 0, "edge").otherwise("backend").alias("role"), F.col("c_nationkey").cast("long").alias("endpoint"))
    o = src.table(spark, d, "orders")
    calls = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("caller"), ((F.col("o_custkey") + 1) % top).alias("callee"),
        (F.floor(F.col("o_orderkey") / 2).cast("long") * (1 + F.col("o_orderkey") % 5)).alias("connection"),
        F.lit("edge").alias("caller_is"), F.lit("backend").alias("callee_is"), (F.col("o_orderkey") % 25).alias("caller_at"), (F.col("o_orderkey") % 24).alias("callee_at"),
    )
    return J.reference_integrity(calls, reg).select("id", "caller_problem", "callee_problem", "repeated")


@query("c12_within_budget", f"WITH {SPECS} SELECT spec, bits, ceil(20 * bits / 8.0)::BIGINT + 4 AS limit_bytes FROM specs JOIN (VALUES (4), (8), (12), (16)) b(bits) ON memory <= ceil(20 * bits / 8.0) + 4")
def _(spark, d):
    b = spark.sql("SELECT * FROM VALUES (4), (8), (12), (16) AS b(bits)")
    return J.within_budget(src.read_specs(spark, d), b, 20, 4).select("spec", "bits", "limit_bytes")


TOKEN = "substr(sha256('k|' || " + encoded("account", "token") + "), 1, 32)"
AMT = f"{AM}, mt AS (SELECT account, token, {TOKEN} AS t FROM members), aq AS (SELECT *, {TOKEN} AS t FROM attempts)"


def _tokens(df):
    return df.withColumn("t", S.stable_token("k", "account", "token"))


@query("b5_stable_token", f"{AMT} SELECT account, token, t FROM mt")
def _(spark, d):
    return _tokens(src.read_members(src.read_attempts(spark, d))).select("account", "token", "t")


@query("d1_tag_screen", f"{AMT} SELECT event_index, EXISTS (SELECT 1 FROM mt WHERE mt.account = aq.account AND substr(mt.t, 1, 2) = substr(aq.t, 1, 2)) AS represented FROM aq")
def _(spark, d):
    a = src.read_attempts(spark, d)
    return C.tag_screen(_tokens(a), _tokens(src.read_members(a)), "account", "t", 8).select("event_index", "represented")


POS = f"({h32('t')} + i * ({h32('t', 1)} | 1)) % {M}"
BPOS = f"({h32('t')} % {BLOCKS}) * 512 + ((({h32('t', 1)} & 511) + i * (({h32('t', 2)} | 1) & 511)) & 511)"
BITS = f"bits AS (SELECT DISTINCT {POS} AS position FROM mt, range(0, {K}) r(i))"
BBITS = BITS.replace(POS, BPOS)
PROBE = f"probe AS (SELECT account, token, count(b.position) = {K} AS represented, coalesce(min(CASE WHEN b.position IS NULL THEN i + 1 END), {K})::BIGINT AS probes FROM (SELECT account, token, i, {POS} AS p FROM (SELECT DISTINCT account, token, t FROM aq), range(0, {K}) r(i)) LEFT JOIN bits b ON p = b.position GROUP BY ALL)"


def _positions():
    return S.probe_positions("t", K, M)


@query("d2_bloom_build", f"{AMT}, {BITS} SELECT position // 32 AS word, bit_or(1::BIGINT << (position % 32)::INT) AS bits FROM bits GROUP BY 1")
def _(spark, d):
    return C.bloom_pack(C.bloom_build(_tokens(src.read_members(src.read_attempts(spark, d))), _positions()))


@query("d3_bloom_screen", f"{AMT}, {BITS}, {PROBE} SELECT account, token, represented FROM probe")
def _(spark, d):
    a = src.read_attempts(spark, d)
    bits = C.bloom_build(_tokens(src.read_members(a)), _positions())
    return C.bloom_probe(_tokens(a.select("account", "token").distinct()), ["account", "token"], _positions(), bits, K, M).drop("probes")


@query("d4_blocked_bloom_screen", f"{AMT}, {BBITS}, {PROBE.replace(POS, BPOS)} SELECT account, token, represented, probes FROM probe")
def _(spark, d):
    a = src.read_attempts(spark, d)
    at = S.blocked_positions("t", K, BLOCKS)
    return C.blocked_bloom_probe(_tokens(a.select("account", "token").distinct()), ["account", "token"], at, C.blocked_bloom_build(_tokens(src.read_members(a)), at, K), K)


@query("d5_probe_count", f"{AMT}, {BITS}, {PROBE} SELECT probes, represented, count(*) AS n FROM probe GROUP BY ALL")
def _(spark, d):
    a = src.read_attempts(spark, d)
    out = C.bloom_probe(_tokens(a.select("account", "token").distinct()), ["account", "token"], _positions(), C.bloom_build(_tokens(src.read_members(a)), _positions()), K, M)
    return out.groupBy("probes", "represented").agg(F.count(F.lit(1)).alias("n"))


@query(
    "d6_bit_density",
    f"""{AMT}, {BITS}, bb AS (SELECT DISTINCT {BPOS} AS position FROM mt, range(0, {K}) r(i)) SELECT (SELECT count(*) FROM bits) AS set_bits, round((SELECT count(*) FROM bits) / {M}.0::DOUBLE, 6) AS density,
    round((SELECT sum(pow(n / 512.0, {K})) / {BLOCKS} FROM (SELECT position // 512 AS b, count(*) AS n FROM bb GROUP BY 1)), 6) AS realised_fpr""",
)
def _(spark, d):
    m = _tokens(src.read_members(src.read_attempts(spark, d)))
    blocked = C.blocked_realised_fpr(C.bloom_build(m, S.blocked_positions("t", K, BLOCKS)), BLOCKS, K)
    return rounded(C.bit_density(C.bloom_build(m, _positions()), M).join(blocked, F.lit(True)))


SCREENED = f"sc AS (SELECT a.*, {h32(encoded('a.account'))} % 8 AS region, p.represented, label IN ('INVALID_DISTINCT', 'INVALID_REPEATED') AS invalid FROM aq a JOIN probe p ON a.account = p.account AND a.token = p.token)"


def _screened(spark, d):
    a = src.read_attempts(spark, d).withColumn("region", S.hash_region(src.REGIONS, "account"))
    bits = C.bloom_build(_tokens(src.read_members(a)), _positions())
    probe = C.bloom_probe(_tokens(a.select("account", "token").distinct()), ["account", "token"], _positions(), bits, K, M)
    return a.join(probe, ["account", "token"]).withColumn("invalid", S.is_existing_invalid("label"))


@query(
    "d7_false_forward_rates",
    f"""{AMT}, {BITS}, {PROBE}, {SCREENED}, t AS (SELECT region, account, token, count(*) AS n, bool_or(represented) AS p FROM sc WHERE invalid GROUP BY ALL),
    g AS (SELECT region, count(*) AS t, count(*) FILTER (p) AS tp, sum(n) AS r, coalesce(sum(n) FILTER (p), 0) AS rp FROM t GROUP BY 1)
    SELECT round(sum(tp) / sum(t), 6) AS first_seen_ffr, round(sum(rp) / sum(r), 6) AS request_ffr, round(max(tp / t), 6) AS worst_region_ffr FROM g""",
)
def _(spark, d):
    return rounded(C.false_forward_rates(_screened(spark, d), ["account", "token"], "region"))


DISCOVER = f"""{AMT}, {BITS}, {PROBE}, {SCREENED}, w AS (SELECT region, account, event_index, (represented AND invalid)::INT AS pos FROM sc),
    x AS (SELECT *, sum(pos) OVER (PARTITION BY region ORDER BY event_index) AS n, sum(pos) OVER (PARTITION BY region, account ORDER BY event_index) AS s FROM w)"""


def _positives(spark, d):
    return _screened(spark, d).select("region", "account", "event_index", (F.col("represented") & F.col("invalid")).alias("positive"))


@query(
    "d8_false_positive_discovery",
    f"""{DISCOVER} SELECT region, min(event_index) FILTER (n >= 20) AS overall_at, min(event_index) FILTER (s >= 4) AS same_at,
    CASE WHEN min(event_index) FILTER (n >= 20) IS NOT NULL AND min(event_index) FILTER (s >= 4) IS NOT NULL THEN greatest(min(event_index) FILTER (n >= 20), min(event_index) FILTER (s >= 4)) END AS scanned FROM x GROUP BY region""",
)
def _(spark, d):
    return C.false_positive_discovery(_positives(spark, d), "region", "event_index", 20, 4)


@query("d9_select_conditioned", f"{DISCOVER}, f AS (SELECT region, arg_min(account, event_index) AS account FROM x WHERE pos = 1 AND s = 4 GROUP BY 1) SELECT region, account, event_index FROM x JOIN f USING (region, account) WHERE pos = 1 AND s <= 4")
def _(spark, d):
    return C.select_conditioned(_positives(spark, d).where("positive"), "region", "event_index", 4, True).select("region", "account", "event_index")


@query("d10_member_false_negatives", f"{AMT}, {BITS}, {PROBE} SELECT count(*) AS false_negatives FROM members m WHERE NOT EXISTS (SELECT 1 FROM probe p WHERE p.represented AND p.account = m.account AND p.token = m.token)")
def _(spark, d):
    a = src.read_attempts(spark, d)
    return C.member_false_negatives(src.read_members(a), _screened(spark, d).select("account", "token", "represented").distinct(), ["account", "token"])


@query(
    "d11_snapshot_intersection",
    f"""{A}, s AS (SELECT account, day, {h32("account || '/' || day")} % 100 AS h, max(weight) AS w FROM (SELECT *, event_index // 2500 AS day FROM attempts) GROUP BY ALL),
    g AS (SELECT account, bool_and(h < 60) AS ok, max(w) AS w, min(h / 100.0::DOUBLE) AS low, sum(CASE WHEN h > 0 THEN ln(h / 100.0::DOUBLE) END) AS lp FROM s GROUP BY 1)
    SELECT round(sum(CASE WHEN ok THEN w ELSE 0 END), 6) AS survived_mass, round(sum(w * CASE WHEN low = 0 THEN 0 ELSE exp(lp) END), 6) AS expected_mass FROM g""",
)
def _(spark, d):
    a = src.read_attempts(spark, d).withColumn("day", F.floor(F.col("event_index") / 2500).cast("long"))
    h = S.hash32(F.concat_ws("/", "account", "day")) % 100
    s = a.groupBy("account", "day").agg(F.max("weight").alias("w")).withColumns({"p": h / 100.0, "passed": h < 60})
    return rounded(C.snapshot_intersection(s, "account", "p", "w"))


@query(
    "d12_member_snapshot",
    f"""WITH m AS (SELECT c_custkey AS account, 1 + (7000 + c_custkey * 15485863) // 50000 AS generation, 1 + (7000 + c_custkey * 32452843) // 5000 AS version FROM customer)
    SELECT account, generation, version, substr(sha256('m|' || {encoded('account', 'generation', 'version')}), 1, 32) AS token FROM m""",
)
def _(spark, d):
    return C.member_snapshot(src.table(spark, d, "customer").select(F.col("c_custkey").alias("account")), 7000, src.CHURN_PERIOD, src.ROTATION_PERIOD, "m")


@query(
    "d13_prescreen",
    f"""{A}, dir AS (SELECT account, max(generation) AS g, max(version) AS v FROM attempts WHERE account % 9 <> 0 GROUP BY 1),
    mem AS (SELECT DISTINCT sha256('p|' || {encoded('account', 'g', 'v', 'token')}) AS x FROM dir JOIN (SELECT account, token FROM attempts WHERE label = 'VALID') USING (account))
    SELECT decision, count(*) AS n FROM (SELECT CASE WHEN v IS NULL THEN 'FAIL_OPEN' WHEN sha256('p|' || {encoded('account', 'g', 'v', 'token')}) IN (SELECT x FROM mem) THEN 'POSITIVE' ELSE 'NEGATIVE' END AS decision
    FROM attempts LEFT JOIN dir USING (account)) GROUP BY 1""",
)
def _(spark, d):
    a = src.read_attempts(spark, d)
    directory = a.where("account % 9 <> 0").groupBy("account").agg(F.max("generation").alias("current_generation"), F.max("version").alias("current_version"))
    valid = a.where("label = 'VALID'").select("account", F.col("token").alias("secret")).join(directory, "account")
    members = valid.select(S.stable_token("p", "account", "current_generation", "current_version", "secret").alias("token"))
    out = C.prescreen(a.select("event_index", "account", F.col("token").alias("secret")), directory, members, "p")
    return out.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query(
    "d14_compact_members",
    f"{A}, b AS (SELECT DISTINCT {REGION} AS region, account, token FROM attempts WHERE event_index % 3 < 2), x AS (SELECT DISTINCT {REGION} AS region, account, token FROM attempts WHERE event_index % 5 = 0) SELECT region, account, token, 8::BIGINT AS epoch FROM (SELECT * FROM b UNION SELECT * FROM x)",
)
def _(spark, d):
    a = src.read_attempts(spark, d).withColumn("region", S.hash_region(src.REGIONS, "account"))
    return C.compact_members(a.where("event_index % 3 < 2"), a.where("event_index % 5 = 0"), ["region", "account", "token"], 8)


@query(
    "d14_delta_retirable",
    f"""{A}, b AS (SELECT DISTINCT {REGION} AS region, account, token FROM attempts WHERE event_index % 3 < 2 OR account % 8 > 2), x AS (SELECT DISTINCT {REGION} AS region, account, token FROM attempts WHERE event_index % 5 = 0),
    m AS (SELECT * FROM x EXCEPT SELECT * FROM b) SELECT r.region, count(m.account) AS missing, count(m.account) = 0 AS retirable FROM (SELECT DISTINCT region FROM x) r LEFT JOIN m USING (region) GROUP BY 1""",
)
def _(spark, d):
    a = src.read_attempts(spark, d).withColumn("region", S.hash_region(src.REGIONS, "account"))
    return C.delta_retirable(a.where("event_index % 3 < 2 or account % 8 > 2"), a.where("event_index % 5 = 0"), ["region", "account", "token"], ["region"])
