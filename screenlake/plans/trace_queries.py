"""Queries over the attempt trace."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import trace as T
from ..sources import tables as src
from .registry import ATTEMPTS, VERSIONS, encoded, h32, query, rounded

A = f"WITH {ATTEMPTS}"
KEY = "account, generation, version, token"
INVALID = "label IN ('INVALID_DISTINCT', 'INVALID_REPEATED')"


@query("a2_read_attempts", f"{A} SELECT event_index, ts_ms, account, generation, version, token, label, result, value, weight FROM attempts")
def _(spark, d):
    return src.read_attempts(spark, d).select("event_index", "ts_ms", "account", "generation", "version", "token", "label", "result", "value", "weight")


@query("a3_json_props", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, len(json_keys(props))::BIGINT AS n_fields FROM events")
def _(spark, d):
    return src.from_json_props(src.table(spark, d, "events"), "props", "k long").select("event_id", "k", F.size("props_map").cast("long").alias("n_fields"))


@query(
    "f1_prefix_features",
    f"""{A}, w AS (SELECT *, CASE WHEN {INVALID} THEN 1 ELSE 0 END AS inv FROM attempts),
    x AS (SELECT *, coalesce(sum(inv) OVER t, 0) AS same_count, max(CASE WHEN inv = 1 THEN ts_ms END) OVER t AS last_ms FROM w
          WINDOW t AS (PARTITION BY {KEY} ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    y AS (SELECT *, coalesce(sum(inv) OVER s, 0) AS scope_invalid, coalesce(sum(CASE WHEN inv = 1 AND same_count = 0 THEN 1 ELSE 0 END) OVER s, 0) AS scope_distinct FROM x
          WINDOW s AS (PARTITION BY account, generation, version ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    z AS (SELECT *, CASE WHEN last_ms IS NULL THEN 1e12 ELSE greatest(0, ts_ms - last_ms) END::DOUBLE AS since_ms FROM y)
    SELECT event_index, same_count::BIGINT AS same_count, since_ms, scope_invalid::BIGINT AS scope_invalid, scope_distinct::BIGINT AS scope_distinct,
           round(ln(1 + same_count), 6) AS log_same, round(ln(1 + since_ms), 6) AS log_since, round(ln(1 + scope_invalid), 6) AS log_invalid,
           round(ln(1 + scope_distinct), 6) AS log_distinct, round(same_count / greatest(1, scope_distinct), 6) AS repeat_ratio, round(age_fraction, 6) AS age_fraction, rotation_recent, weight
    FROM z""",
)
def _(spark, d):
    return rounded(T.prefix_features(src.read_attempts(spark, d)))


@query(
    "f2_horizon_labels",
    f"""{A} SELECT a.event_index, count(b.event_index) AS future_repeat_count, count(b.event_index) > 0 AS repeats_within_horizon
    FROM (SELECT * FROM attempts WHERE {INVALID}) a LEFT JOIN (SELECT * FROM attempts WHERE {INVALID}) b
      ON a.account = b.account AND a.generation = b.generation AND a.version = b.version AND a.token = b.token
     AND (b.ts_ms > a.ts_ms OR (b.ts_ms = a.ts_ms AND b.event_index > a.event_index)) AND b.ts_ms <= a.ts_ms + 86400000
    GROUP BY a.event_index""",
)
def _(spark, d):
    return T.horizon_labels(src.read_attempts(spark, d), 86_400_000)


@query(
    "f3_first_seen",
    f"""{A} SELECT event_index, is_first, is_first AND (cutoff IS NULL OR event_index < cutoff) AS survives FROM (
        SELECT event_index, row_number() OVER (PARTITION BY {KEY} ORDER BY event_index) = 1 AS is_first,
               min(CASE WHEN label = 'VALID' THEN event_index END) OVER (PARTITION BY account, generation, version) AS cutoff FROM attempts)""",
)
def _(spark, d):
    return T.first_seen(src.read_attempts(spark, d))


REGION = f"{h32(encoded('account'))} % 8"


@query("f4_suppress_unbounded", f"{A} SELECT {REGION} AS region, count(*) AS static_checks, count(DISTINCT ({KEY})) AS adaptive_checks FROM attempts GROUP BY 1")
def _(spark, d):
    return T.suppress_unbounded(src.read_attempts(spark, d).withColumn("region", S.hash_region(src.REGIONS, "account")))


def _lru_sql(capacity: int, shard: str) -> str:
    return f"""{A}, u AS (SELECT {shard} AS shard, account, token, event_index AS i, lag(event_index) OVER w AS p, coalesce(lead(event_index) OVER w, 4611686018427387904) AS n
        FROM attempts WINDOW w AS (PARTITION BY {shard}, account, token ORDER BY event_index)),
    r AS (SELECT a.shard, a.i, a.p, count(b.i) AS between_ FROM u a LEFT JOIN u b ON a.shard = b.shard AND b.i > a.p AND b.i < a.i AND b.n > a.i GROUP BY ALL)
    SELECT shard, count(*) FILTER (p IS NOT NULL AND between_ < {capacity}) AS hits, count(*) FILTER (p IS NULL OR between_ >= {capacity}) AS misses,
           greatest(0, count(*) FILTER (p IS NULL OR between_ >= {capacity}) - {capacity}) AS evictions FROM r GROUP BY shard"""


@query("f5_suppress_lru", _lru_sql(6, "account"))
def _(spark, d):
    a = src.read_attempts(spark, d).withColumn("shard", F.col("account"))
    return T.suppress_lru(a, 6, ["shard"], ["account", "token"])


@query("f5_suppress_lru_scan", _lru_sql(40, REGION))
def _(spark, d):
    a = src.read_attempts(spark, d).withColumn("shard", S.hash_region(src.REGIONS, "account"))
    return T.suppress_lru(a, 40, ["shard"], ["account", "token"])


def _ttl_sql(op: str) -> str:
    return f"""WITH RECURSIVE {ATTEMPTS}, k AS (SELECT account, token, ts_ms FROM attempts),
    e AS (SELECT account, token, min(ts_ms) AS t FROM k GROUP BY ALL
          UNION ALL SELECT e.account, e.token, min(k.ts_ms) AS t FROM e JOIN k ON e.account = k.account AND e.token = k.token AND k.ts_ms - e.t {op} 172800000 GROUP BY ALL)
    SELECT account, token, n, checks, checks - 1 AS expirations FROM (SELECT account, token, count(*) AS n FROM k GROUP BY ALL) JOIN (SELECT account, token, count(*) AS checks FROM e GROUP BY ALL) USING (account, token)"""


@query("f6_suppress_ttl", _ttl_sql(">="))
def _(spark, d):
    return T.suppress_ttl(src.read_attempts(spark, d), 172_800_000, "inclusive", ["account", "token"])


@query("f6_suppress_ttl_scan", _ttl_sql(">"))
def _(spark, d):
    return T.suppress_ttl(src.read_attempts(spark, d), 172_800_000, "exclusive", ["account", "token"])


@query(
    "f7_suppress_second_hit",
    f"{A} SELECT {REGION} AS region, sum(least(n, 2))::BIGINT AS second_hit_checks, count(*) AS always_checks, sum(n)::BIGINT AS none_checks FROM (SELECT account, token, count(*) AS n FROM attempts GROUP BY ALL) GROUP BY 1",
)
def _(spark, d):
    a = src.read_attempts(spark, d).withColumn("region", S.hash_region(src.REGIONS, "account"))
    return T.suppress_second_hit(a, ["account", "token"], ["region"])


@query("f8_suppress_account_quota", _lru_sql(3, "account").replace("account, token, event_index", "account, token || generation || '/' || version AS token, event_index").replace("PARTITION BY account, account, token", "PARTITION BY account, generation, version, token").replace("SELECT shard, count(*)", "SELECT shard AS account, count(*)"))
def _(spark, d):
    return T.suppress_account_quota(src.read_attempts(spark, d), 3)


@query(
    "f9_coalesce_batches",
    f"""{A} SELECT batch, count(*) AS leaders, sum(n - 1)::BIGINT AS suppressed, max(n - 1) AS peak_waiters, count(*) FILTER (n - 1 > 2) AS cap_breaches
    FROM (SELECT event_index // 512 AS batch, token, count(*) AS n FROM attempts GROUP BY ALL) GROUP BY batch""",
)
def _(spark, d):
    return T.coalesce_batches(src.read_attempts(spark, d), 512, ["token"], "event_index", 2)


@query(
    "f10_replay_interval",
    _lru_sql(25, REGION).replace("FROM attempts WINDOW", f"FROM attempts WHERE {h32('token')} % 16 BETWEEN 2 AND 10 WINDOW").replace("AS hits", "AS cache_hits").replace("AS misses", "AS backend_checks").replace("FROM r GROUP BY shard", f", count(*) FILTER (p IS NULL OR between_ >= 25) AS base_confirmations, 0::BIGINT AS race_extras, count(*) FILTER (p IS NULL OR between_ >= 25) AS admitted, 0::BIGINT AS expirations FROM r GROUP BY shard"),
)
def _(spark, d):
    a = src.read_attempts(spark, d).withColumns({"shard": S.hash_region(src.REGIONS, "account"), "bin": S.hash32("token") % 16})
    return T.replay_interval(a, 2, 11, 25, "always", None, ["shard"], ["account", "token"])


@query(
    "f11_option_table",
    f"""{A}, ids AS (SELECT s AS start_bin, e AS end_bin, k, count(*) AS n FROM (SELECT {h32('token')} % 16 AS bin, account || '/' || token AS k FROM attempts)
            JOIN (VALUES (0, 8), (8, 16), (0, 16)) AS v(s, e) ON bin >= s AND bin < e GROUP BY ALL),
    sized AS (SELECT *, count(*) OVER (PARTITION BY start_bin, end_bin) AS identities FROM ids),
    passed AS (SELECT start_bin, end_bin, memory, seed, sum(n) AS c_none, count(*) AS c_always, sum(least(n, 2)) AS c_second FROM sized, (VALUES (0), (2000), (8000)) AS m(memory), (VALUES (1), (2), (3), (4)) AS z(seed)
        WHERE {h32("seed || ':' || start_bin || ':' || end_bin || '|' || k")} / 4294967296.0::DOUBLE < exp(-0.5 * memory / identities) GROUP BY ALL),
    every AS (SELECT * FROM (SELECT DISTINCT start_bin, end_bin FROM ids), (VALUES (0), (2000), (8000)) AS m(memory), (VALUES (1), (2), (3), (4)) AS z(seed)),
    o AS (SELECT start_bin, end_bin, memory, quota, policy, coalesce(CASE WHEN quota > 0 AND policy = 'always' THEN c_always WHEN quota > 0 AND policy = 'second_hit' THEN c_second ELSE c_none END, 0)::BIGINT AS cost
        FROM every LEFT JOIN passed USING (start_bin, end_bin, memory, seed), (VALUES (0), (100000000)) AS q(quota), (VALUES ('always'), ('second_hit'), ('none')) AS p(policy))
    SELECT start_bin, end_bin, memory, quota, policy, round(avg(cost), 6) AS mean_cost, round(stddev_samp(cost) / sqrt(count(*)), 6) AS stderr, list_sort(list(cost))::VARCHAR AS seed_costs FROM o GROUP BY ALL""",
)
def _(spark, d):
    """Caches that never fill: the closed forms."""
    out = _options(spark, d, [0, 100_000_000], None).drop("epsilon", "memory_quanta", "compromise_mass", "compromise_quanta")
    return rounded(out).withColumn("seed_costs", F.col("seed_costs").cast("string"))


def _options(spark, d, quotas, ttl):
    a = src.read_attempts(spark, d).select("event_index", "ts_ms", (S.hash32("token") % 16).alias("bin"), F.concat_ws("/", "account", "token").alias("token_key"))
    grid = spark.sql("SELECT * FROM VALUES (0, 8), (8, 16), (0, 16) AS v(start_bin, end_bin)")
    return T.option_table(a, grid, [0, 2000, 8000], quotas, ["always", "second_hit", "none"], [1, 2, 3, 4], 0.5, ttl=ttl)


@query("f11_option_table_bounded")
def _(spark, d):
    """Caches of 50 entries that last a day, replayed; held against a plain replay in the tests."""
    return rounded(_options(spark, d, [0, 50], 86_400_000.0))


@query(
    "f12_chronological_split",
    f"""{A} SELECT event_index, round(f, 6) AS fraction, CASE WHEN f < 0.5 THEN 'train' WHEN f < 0.7 THEN 'validation' ELSE 'test' END AS role
    FROM (SELECT event_index, (row_number() OVER (ORDER BY event_index) - 1) / (count(*) OVER ())::DOUBLE AS f FROM attempts)""",
)
def _(spark, d):
    return rounded(T.chronological_split(src.read_attempts(spark, d)))


@query(
    "f13_epoch_regression",
    """SELECT account, event_id, epoch FROM (SELECT *, max(epoch) OVER (PARTITION BY account ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
    FROM (SELECT user_id AS account, event_id, event_id // 100 - CASE WHEN value > 60 THEN 30 ELSE 0 END AS epoch FROM events)) WHERE epoch < m""",
)
def _(spark, d):
    e = src.table(spark, d, "events")
    acks = e.select(F.col("user_id").alias("account"), "event_id", (F.floor(F.col("event_id") / 100) - F.when(F.col("value") > 60, 30).otherwise(0)).cast("long").alias("epoch"))
    return T.epoch_regression(acks, ["account"], "event_id", ["epoch"])


@query(
    "f14_lifecycle_audit",
    """SELECT user_id AS account, event_id, status, place = coalesce(lag(place) OVER (PARTITION BY user_id ORDER BY event_id), 0) + 1 AS legal
    FROM (SELECT *, list_position(['PREPARED', 'EDGE_DELTA_READY', 'ACTIVE', 'COMPACTED', 'RETIRED'], status) AS place FROM (
        SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'PREPARED' WHEN 'view' THEN 'EDGE_DELTA_READY' WHEN 'click' THEN 'ACTIVE' WHEN 'purchase' THEN 'COMPACTED' ELSE 'RETIRED' END AS status FROM events))""",
)
def _(spark, d):
    e = src.table(spark, d, "events")
    names = F.create_map(*[F.lit(x) for p in (("signup", "PREPARED"), ("view", "EDGE_DELTA_READY"), ("click", "ACTIVE"), ("purchase", "COMPACTED"), ("error", "RETIRED")) for x in p])
    log = e.select(F.col("user_id").alias("account"), "event_id", F.element_at(names, F.col("event_type")).alias("status"))
    return T.lifecycle_audit(log, ["account"], "event_id")


@query(
    "f14_acknowledged",
    """WITH r AS (SELECT user_id, list(DISTINCT event_type) AS required FROM events WHERE event_id % 2 = 0 GROUP BY 1),
    a AS (SELECT user_id, list(DISTINCT event_type) AS acked FROM events WHERE event_id % 3 = 0 GROUP BY 1),
    m AS (SELECT user_id AS account, list_sort(list_filter(required, lambda x: NOT list_contains(coalesce(acked, []), x))) AS missing FROM r LEFT JOIN a USING (user_id))
    SELECT account, array_to_string(missing, ',') AS missing, len(missing) = 0 AS complete FROM m""",
)
def _(spark, d):
    e = src.table(spark, d, "events").select("event_id", F.col("user_id").alias("account"), F.col("event_type").alias("edge"))
    return T.acknowledged(e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0"), ["account"]).withColumn("missing", F.array_join("missing", ","))


@query(
    "f15_version_monotonicity",
    f"""{A} SELECT account, event_index, coalesce(generation < max(generation) OVER w, false) AS generation_falls, coalesce(version <= max(version) OVER (PARTITION BY account, generation ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS version_falls
    FROM attempts WINDOW w AS (PARTITION BY account ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def _(spark, d):
    a = src.read_attempts(spark, d).select("account", "event_index", "generation", "version")
    return T.version_monotonicity(a, ["account"], "event_index").select("account", "event_index", "generation_falls", "version_falls")


@query(
    "e1_sticky_accounting",
    f"""{A}, t AS (SELECT account, token, event_index AS pos, {h32('token')} % 3 > 0 AS positive, event_index // 2000 AS episode FROM attempts),
    s AS (SELECT *, positive AND row_number() OVER (PARTITION BY account, token, episode, positive ORDER BY pos) = 1 AS starts FROM t),
    u AS (SELECT *, CASE WHEN starts AND pos % 7 = 0 THEN 1 ELSE 0 END AS x FROM s),
    g AS (SELECT account, token, count(*) AS multiplicity, bool_or(positive) AS positive, count(*) FILTER (starts) AS episodes, sum(x)::BIGINT AS race_extras FROM u GROUP BY ALL)
    SELECT account, token, multiplicity, positive, episodes, race_extras, greatest(0, episodes - 1) AS evictions, multiplicity * positive::INT AS static_checks, (episodes + race_extras) * positive::INT AS adaptive_checks,
           (1 + greatest(0, episodes - 1) + race_extras) * positive::INT AS upper_bound, false AS not_sticky, false AS recurring_episode, false AS misplaced_extras FROM g""",
)
def _(spark, d):
    from pyspark.sql import Window

    a = src.read_attempts(spark, d)
    t = a.select("account", "token", F.col("event_index").alias("pos"), (S.hash32("token") % 3 > 0).alias("positive"), F.floor(F.col("event_index") / 2000).cast("long").alias("episode"))
    first = F.row_number().over(Window.partitionBy("account", "token", "episode").orderBy("pos")) == 1
    t = t.withColumn("race_extras", F.when(F.col("positive") & first & (F.col("pos") % 7 == 0), 1).otherwise(0))
    return T.sticky_accounting(t, ["account", "token"])


@query(
    "flagship_region_report",
    f"""{A}, k AS (SELECT {REGION} AS region, {KEY}, count(*) AS n, bool_or({INVALID}) AS inv, {h32("account || '|' || token")} % 10 < 3 AS positive FROM attempts GROUP BY ALL)
    SELECT region, sum(n)::BIGINT AS requests, count(*) AS tuples, round(count(*) FILTER (inv AND positive) / nullif(count(*) FILTER (inv), 0), 6) AS ffr,
           coalesce(sum(n) FILTER (positive), 0)::BIGINT AS static_checks, count(*) FILTER (positive) AS suppressed_checks FROM k GROUP BY region""",
)
def flagship(spark, d):
    """Per region: requests, distinct tuples, false-forward rate, checks with and without a cache.
    Requests are aggregated per tuple before anything else."""
    a = src.read_attempts(spark, d).withColumn("region", S.hash_region(src.REGIONS, "account"))
    tuples = a.groupBy("region", *T.TUPLE).agg(F.count(F.lit(1)).alias("n"), F.max(S.is_existing_invalid("label")).alias("invalid"))
    positive = S.hash32(F.concat_ws("|", "account", "token")) % 10 < 3
    tuples = tuples.withColumn("positive", positive)
    return rounded(
        tuples.groupBy("region").agg(
            F.sum("n").alias("requests"), F.count(F.lit(1)).alias("tuples"),
            F.try_divide(F.count_if(F.col("invalid") & F.col("positive")), F.count_if("invalid")).alias("ffr"),
            F.coalesce(F.sum(F.when(F.col("positive"), F.col("n"))), F.lit(0)).alias("static_checks"), F.count_if("positive").alias("suppressed_checks"),
        )
    )
