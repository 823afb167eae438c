"""Queries of routing, scoring models, sources and streams."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import audit as K
from ..operators import models as L
from ..operators import stats as I
from ..operators import trace as T
from ..sources import tables as src
from ..sources.scratch import arrivals, scratch
from ..streaming import attempts as M
from .registry import ATTEMPTS, h32, query, rounded
from .trace_queries import _lru_sql, _ttl_sql

A = f"WITH {ATTEMPTS}"
KEY = "account, generation, version, token"
INVALID = "label IN ('INVALID_DISTINCT', 'INVALID_REPEATED')"


@query(
    "f17_route_attempts",
    f"""{A}, s AS (SELECT *, CASE WHEN account % 17 = 0 THEN 'STALE' ELSE 'PRESENT' END AS status, account % 5 > 0 AS covered, {h32("account || '|' || token")} % 10 < 6 AS represented FROM attempts),
    k AS (SELECT *, coalesce(max((status = 'PRESENT' AND NOT (covered AND NOT represented) AND result = 'CREDENTIAL_MISMATCH')::INT) OVER (PARTITION BY {KEY} ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS known FROM s)
    SELECT event_index, CASE WHEN status <> 'PRESENT' THEN 'FAIL_OPEN_BACKEND' WHEN known THEN 'NEGATIVE_CACHE_REJECT' WHEN covered AND NOT represented THEN 'SCREEN_REJECT' WHEN NOT covered THEN 'FAIL_OPEN_BACKEND'
           WHEN result = 'MATCH' THEN 'BACKEND_MATCH' ELSE 'BACKEND_DENY' END AS route FROM k""",
)
def _(spark, d):
    a = src.read_attempts(spark, d).withColumns({"status": F.when(F.col("account") % 17 == 0, "STALE").otherwise("PRESENT"), "covered": F.col("account") % 5 > 0, "represented": S.hash32(F.concat_ws("|", "account", "token")) % 10 < 6})
    return T.route_attempts(a).select("event_index", "route")


@query("a1_read_evidence", "SELECT event_id % 4 AS shard, count(*) AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY 1")
def _(spark, d):
    """The events as JSON-lines shards, written and read back with their provenance."""
    path = scratch(spark, "evidence")
    e = src.table(spark, d, "events").select("event_id", "user_id", "event_type")
    for k in range(4):
        src.write_no_replace(e.where(F.col("event_id") % 4 == k), f"{path}/shard={k}")
    rows = src.read_evidence(spark, path, "event_id long, user_id long, event_type string")
    shard = F.regexp_extract("source_file", r"shard=(\d+)", 1).cast("long")
    return rows.groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"))


@query("a4_write_no_replace", "SELECT count(*) AS n, sum(event_id)::BIGINT AS ids, true AS refused FROM events WHERE event_type = 'purchase'")
def _(spark, d):
    """Results written once: a second, different write to the place is refused and leaves what is there."""
    path, e = scratch(spark, "results"), src.table(spark, d, "events").select("event_id", "event_type")
    src.write_no_replace(e.where("event_type = 'purchase'"), path, "parquet")
    try:
        src.write_no_replace(e.where("event_type <> 'purchase'"), path, "parquet")
        refused = False
    except AnalysisException as error:
        refused = "ALREADY_EXISTS" in (error.getCondition() or "")
    held = spark.read.schema(e.schema).parquet(path)
    return held.agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.lit(refused).alias("refused"))


def examples(spark, d):
    a = src.read_attempts(spark, d)
    labels = T.horizon_labels(a, 86_400_000)
    return L.recurrence_weighting(T.prefix_features(a).join(labels, "event_index"))


FEATURES = ["log_same", "log_since", "log_invalid", "log_distinct", "repeat_ratio", "age_fraction"]


@query("l1_fit_logistic")
def _(spark, d):
    """Coefficients of the recurrence model, fitted on the whole trace."""
    rows = examples(spark, d).select("target", "model_weight", *FEATURES).persist()
    m = L.fit_logistic(rows, FEATURES, "target", "model_weight")
    rows.unpersist()
    return rounded(spark.createDataFrame(list(zip(["intercept", *FEATURES], m.coefficients)), "term string, coefficient double"), 4)


LABELLED = "ls AS (SELECT doc_id, quality, n_chars::DOUBLE AS x, length(source)::DOUBLE AS s, (doc_id % 20)::BIGINT AS seed, lang FROM labels JOIN documents USING (doc_id))"


def labelled(spark, d):
    return src.table(spark, d, "labels").join(src.table(spark, d, "documents"), "doc_id").select("doc_id", "quality", F.col("n_chars").cast("double").alias("x"), F.length("source").cast("double").alias("s"), (F.col("doc_id") % 20).alias("seed"), "lang")


@query("l2_score_logistic", f"WITH {LABELLED} SELECT doc_id, round(1 / (1 + exp(-greatest(-40, least(40, 0.3 + 0.8 * ((x - 2000) / 1500) - 0.2 * ((s - 5) / 1))))), 6) AS score FROM ls")
def _(spark, d):
    m = L.Logistic(["x", "s"], [2000.0, 5.0], [1500.0, 1.0], [0.3, 0.8, -0.2])
    return rounded(labelled(spark, d).select("doc_id", m.score().alias("score")))


@query("l3_ridge_pairwise")
def _(spark, d):
    """A classifier per language, trained on half of the seeds; AUC per language on the others."""
    rows = labelled(spark, d).select("doc_id", "lang", "seed", F.log1p("x").alias("lx"), "s", F.col("quality").cast("double").alias("quality"))
    model = L.fit_ridge_pairwise(rows.where("seed % 2 = 0"), ["lang"], ["lx", "s"], "quality", 0.01)
    scored = L.score_pairwise(rows.where("seed % 2 = 1"), model, ["lang"], ["lx", "s"])
    return rounded(I.auc(scored.withColumn("good", F.col("quality") == 1), ["lang"], "good", "score"), 4)


@query(
    "l4_fit_stump",
    f"""WITH {LABELLED}, w AS (SELECT x, s, quality::DOUBLE AS y, 1.0::DOUBLE + doc_id % 2 AS w FROM ls), t AS (SELECT DISTINCT 0 AS feature, unnest(quantile_cont(x, [{', '.join(repr((i + 1) / 65) for i in range(64))}])) AS t FROM w
        UNION SELECT DISTINCT 1, unnest(quantile_cont(s, [{', '.join(repr((i + 1) / 65) for i in range(64))}])) FROM w),
    v AS (SELECT feature, t, sum(w) FILTER (CASE feature WHEN 0 THEN x ELSE s END <= t) AS lw, sum(w * y) FILTER (CASE feature WHEN 0 THEN x ELSE s END <= t) AS ly, sum(w) AS tw, sum(w * y) AS ty, sum(w * y * y) AS tyy FROM w, t GROUP BY ALL),
    l AS (SELECT *, (tyy - ly * ly / lw - (ty - ly) * (ty - ly) / (tw - lw)) / tw AS loss FROM v WHERE lw > 0 AND lw < tw)
    SELECT round(loss, 6) AS loss, feature, round(t, 4) AS threshold, round(ly / lw, 6) AS "left", round((ty - ly) / (tw - lw), 6) AS "right" FROM l ORDER BY l.loss, feature, t LIMIT 1""",
)
def _(spark, d):
    rows = labelled(spark, d).withColumn("w", 1.0 + F.col("doc_id") % 2)
    return rounded(L.fit_stump(rows, ["x", "s"], "quality", "w")).withColumn("threshold", F.round("threshold", 4))


@query(
    "l5_calibrate_route",
    f"WITH {LABELLED}, q AS (SELECT quantile_cont(x, [0.25, 0.5, 0.75]) AS t FROM ls WHERE seed < 10) SELECT len(list_filter(t, lambda v: v <= x))::INT AS region, count(*) AS n FROM ls, q WHERE seed >= 10 GROUP BY 1",
)
def _(spark, d):
    rows = labelled(spark, d)
    cuts = L.calibrate_regions(rows.where("seed < 10"), "x", 4)
    return rows.where("seed >= 10").groupBy(L.route_regions(F.col("x"), cuts).alias("region")).agg(F.count(F.lit(1)).alias("n"))


@query("l6_hash_score", f"WITH {LABELLED} SELECT doc_id, round({h32("'|' || lpad(length(doc_id::VARCHAR)::VARCHAR, 8, '0') || doc_id || lpad(length(lang)::VARCHAR, 8, '0') || lang")} / 4294967296.0::DOUBLE, 9) AS score FROM ls")
def _(spark, d):
    return rounded(labelled(spark, d).select("doc_id", L.hash_score("doc_id", "lang").alias("score")), 9)


@query(
    "l7_recurrence_weighting",
    f"""{A}, i AS (SELECT * FROM attempts WHERE {INVALID}) SELECT a.event_index, (count(b.event_index) > 0)::INT::DOUBLE AS target, (1 + count(b.event_index))::DOUBLE AS model_weight FROM i a LEFT JOIN i b
      ON a.account = b.account AND a.generation = b.generation AND a.version = b.version AND a.token = b.token AND (b.ts_ms > a.ts_ms OR (b.ts_ms = a.ts_ms AND b.event_index > a.event_index)) AND b.ts_ms <= a.ts_ms + 86400000 GROUP BY a.event_index""",
)
def _(spark, d):
    return L.recurrence_weighting(T.horizon_labels(src.read_attempts(spark, d), 86_400_000)).select("event_index", "target", "model_weight")


# -- streams: each answer equals the batch operator's --------------------------------------------
def _stream(spark, d, name, *extra, key=None):
    a = src.read_attempts(spark, d).withColumns({"ts": F.timestamp_millis("ts_ms"), "exact_mismatch": F.lit(True), "invalid": S.is_existing_invalid("label")})
    return arrivals(a.select("event_index", "account", "generation", "version", "token", "ts_ms", "ts", "exact_mismatch", "invalid", "value", *extra), "event_index", 4, name, key)


def _to_the_end(spark, d, name):
    """The stream of attempts and a last row far ahead, which moves the watermark past all others and is never answered."""
    a = src.read_attempts(spark, d).withColumns({"exact_mismatch": F.lit(True), "invalid": S.is_existing_invalid("label")})
    a = a.select("event_index", "account", "generation", "version", "token", "ts_ms", "exact_mismatch", "invalid")
    far = [F.lit(-1).cast("long").alias(c) for c in ("account", "generation", "version")]
    last = a.agg((F.max("event_index") + 1).alias("event_index"), (F.max("ts_ms") + 3650 * 86_400_000).alias("ts_ms")).where("event_index is not null")
    last = last.select("event_index", *far, F.lit("").alias("token"), "ts_ms", F.lit(False).alias("exact_mismatch"), F.lit(False).alias("invalid"))
    # Dealt by time, so that no attempt is late however its number and its time go together.
    dealt = a.withColumn("arrives", F.col("ts_ms")).unionByName(last.withColumn("arrives", F.col("ts_ms") - 3650 * 86_400_000))
    return arrivals(dealt, "arrives", 4, name)


def _end(spark, stream, mode="append"):
    return M.run_to_end(stream, scratch(spark, "stream-out"), scratch(spark, "stream-progress"), mode)


@query("m1_stream_suppress", _ttl_sql(">=").replace("SELECT account, token, n, checks, checks - 1 AS expirations FROM", "SELECT account, token, n, checks FROM"))
def _(spark, d):
    out = _end(spark, M.stream_suppress(_to_the_end(spark, d, "m1"), 172_800_000, 1000, span_ms=86_400_000))
    return out.groupBy("account", "token").agg(F.count(F.lit(1)).alias("n"), F.count_if("forwarded").alias("checks"))


@query("m1_stream_suppress_quota", _lru_sql(2, "account").replace("SELECT shard, count(*)", "SELECT shard AS account, count(*)", 1).replace("greatest(0,", "-- ", 1).split("-- ")[0].rstrip(", \n ") + " FROM r GROUP BY shard")
def _(spark, d):
    """A quota that binds: two entries an account, which outlive the trace."""
    out = _end(spark, M.stream_suppress(_to_the_end(spark, d, "m1q"), 1 << 50, 2, span_ms=86_400_000))
    return out.groupBy("account").agg(F.count_if(~F.col("forwarded")).alias("hits"), F.count_if("forwarded").alias("misses"))


@query("m2_stream_coalesce", f"{A} SELECT account, token, min(event_index) AS event_index FROM attempts GROUP BY ALL")
def _(spark, d):
    out = _end(spark, M.stream_coalesce(_stream(spark, d, "m2", key="account"), "3650 days"))
    return out.select("account", "token", "event_index")


@query(
    "m3_stream_metrics",
    """SELECT count(*) AS windows, sum(n)::BIGINT AS offered, sum(dr)::BIGINT AS dropped, sum(t)::BIGINT AS timed_out, sum(rc)::BIGINT AS route_click, sum(rv)::BIGINT AS route_view, sum(n - rc - rv)::BIGINT AS route_other, round(sum(t / n::DOUBLE), 6) AS timeout_rate, round(sum(g), 4) AS greatest, round(sum(p50), 4) AS p50, round(sum(p99), 4) AS p99, round(sum(dr / n::DOUBLE), 6) AS drop_rate FROM (SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99, time_bucket(INTERVAL '6 hours', ts) AS w, count(*) AS n, count(*) FILTER (value > 80) AS dr, count(*) FILTER (value > 60 AND event_id % 3 = 0) AS t, count(*) FILTER (event_type = 'click') AS rc, count(*) FILTER (event_type = 'view') AS rv, max(value) AS g FROM events GROUP BY w)
    WHERE w + INTERVAL '6 hours' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)""",
)
def _(spark, d):
    e = _stream(spark, d, "m3", F.col("event_type").alias("route")).withColumns({"dropped": F.col("value") > 80, "timed_out": (F.col("value") > 60) & (F.col("event_index") % 3 == 0)})
    out = _end(spark, M.stream_metrics(e, "6 hours", "10 minutes", routes=("click", "view")))
    whole = ["offered", "dropped", "timed_out", "route_click", "route_view", "route_other", "drop_rate", "timeout_rate"]
    return rounded(out.agg(F.count(F.lit(1)).alias("windows"), *[F.sum(c).alias(c) for c in whole], *[F.round(F.sum(c), 4).alias(c) for c in ("greatest", "p50", "p99")]), 6)


@query(
    "m4_stream_prefix_features",
    f"""{A}, w AS (SELECT *, CASE WHEN {INVALID} THEN 1 ELSE 0 END AS inv FROM attempts),
    x AS (SELECT *, coalesce(sum(inv) OVER (PARTITION BY {KEY} ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS same_count FROM w)
    SELECT event_index, same_count::BIGINT AS same_count, coalesce(sum(inv) OVER s, 0)::BIGINT AS scope_invalid, coalesce(sum(CASE WHEN inv = 1 AND same_count = 0 THEN 1 ELSE 0 END) OVER s, 0)::BIGINT AS scope_distinct
    FROM x WINDOW s AS (PARTITION BY account, generation, version ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def _(spark, d):
    return _end(spark, M.stream_prefix_features(_to_the_end(spark, d, "m4"), span_ms=86_400_000)).drop("late")


# The acknowledgements of an account at an edge, folded in order: those behind in either epoch change nothing.
ACKS = """k AS (SELECT user_id % 40 AS edge, user_id AS account, event_id, event_id // 100 - CASE WHEN value > 60 THEN 30 ELSE 0 END AS epoch, event_id // 150 - CASE WHEN event_id % 7 = 0 THEN 20 ELSE 0 END AS representation FROM events),
    l AS (SELECT edge, account, list({'i': event_id, 'd': epoch, 'r': representation, 'n': 0} ORDER BY event_id) AS acks FROM k GROUP BY ALL),
    f AS (SELECT edge, account, len(acks) AS n, list_reduce(acks, lambda a, x: CASE WHEN x.d >= a.d AND x.r >= a.r THEN {'i': x.i, 'd': x.d, 'r': x.r, 'n': a.n} ELSE {'i': a.i, 'd': a.d, 'r': a.r, 'n': a.n + 1} END) AS top FROM l)"""


def acks(spark, d, name):
    e = F.col("event_index")
    epoch, representation = F.floor(e / 100) - F.when(F.col("value") > 60, 30).otherwise(0), F.floor(e / 150) - F.when(e % 7 == 0, 20).otherwise(0)
    return _stream(spark, d, name).withColumns({"edge": F.col("account") % 40, "epoch": epoch.cast("long"), "representation": representation.cast("long")})


def epochs(spark, d, name):
    return M.split_to_end(M.stream_epoch_watermark(acks(spark, d, name)), F.col("regressed"), scratch(spark, "epochs"), scratch(spark, "regressions"), scratch(spark, "epochs-progress"))


@query("m5_stream_epoch_watermark", f"WITH {ACKS} SELECT edge, account, n, top.n AS regressions, top.i AS event_index, top.d AS watermark, top.r AS representation_watermark FROM f")
def _(spark, d):
    kept, back = epochs(spark, d, "m5")
    keys, last = ["edge", "account"], F.max(F.struct("event_index", "watermark", "representation_watermark")).alias("t")
    out = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("kept"), last).join(back.groupBy(*keys).agg(F.count(F.lit(1)).alias("b")), keys, "left").withColumn("regressions", F.coalesce("b", F.lit(0)))
    return out.select(*keys, (F.col("kept") + F.col("regressions")).alias("n"), "regressions", "t.*")


@query("m5_edge_certainty", f"""WITH {ACKS}, a AS (SELECT edge, max(top.i) AS last_ack FROM f GROUP BY 1), c AS (SELECT user_id % 40 AS edge, max(event_id) AS last_crash FROM events WHERE event_type = 'error' GROUP BY 1)
    SELECT edge, last_ack, last_crash, last_ack IS NOT NULL AND coalesce(last_ack > last_crash, true) AS certain FROM a FULL JOIN c USING (edge)""")
def _(spark, d):
    kept, _ = epochs(spark, d, "m5-edges")
    crashes = src.table(spark, d, "events").where("event_type = 'error'").selectExpr("event_id AS event_index", "user_id % 40 AS edge")
    return M.edge_certainty(kept, crashes)


@query(
    "m6_stream_late_audit",
    """WITH r AS (SELECT event_id, ts, ts + INTERVAL '1 second' * (value / 2)::INT AS done FROM events) SELECT done > ts + INTERVAL '20 seconds' OR event_id % 10 = 0 AS timed_out, count(*) AS n FROM r GROUP BY 1""",
)
def _(spark, d):
    """Requests and their completions as two streams.  A last row far ahead moves both watermarks past all others."""
    a = src.table(spark, d, "events").select(F.col("event_id").alias("request"), F.col("ts").cast("timestamp").alias("ts"), "value")
    last = a.agg((F.max("request") + 1).alias("request"), (F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"), F.lit(0.0).alias("value"))
    a = a.unionByName(last.where("request is not null"))
    done = a.join(last.select(F.col("request").alias("_last")), F.col("request") == F.col("_last"), "left").where("request % 10 > 0 or _last is not null").select("request", (F.col("ts") + F.make_dt_interval(secs=F.rint(F.col("value") / 2))).alias("done_at"))
    r = arrivals(a.select("request", "ts"), "request", 4, "m6-requests")
    out = _end(spark, M.stream_late_audit(r, arrivals(done, "request", 4, "m6-done"), "20 seconds", "1 hour"))
    return out.join(last.select("request"), "request", "left_anti").groupBy("timed_out").agg(F.count(F.lit(1)).alias("n"))


@query("h3_single_commit", """SELECT "column", "values", "values" = 1 AS single FROM (SELECT 'event_type' AS "column", count(DISTINCT event_type) AS "values" FROM events UNION ALL SELECT 'year', count(DISTINCT year(ts)) FROM events)""")
def _(spark, d):
    return K.single_provenance(src.table(spark, d, "events").withColumn("year", F.year("ts")), ["event_type", "year"])
