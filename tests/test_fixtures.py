"""Hand answers, invariants and tampered evidence."""

import math

import pytest
from pyspark.sql import functions as F

from screenlake.functions import quantiles as Q
from screenlake.operators import audit, curves, joins, metrics, screens, stats, trace
from screenlake.sources import tables


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_sticky_accounting_meets_its_bound(spark):
    t = spark.createDataFrame(
        [("a", 0, True, 1, 1), ("a", 1, True, 1, 0), ("a", 2, True, 2, 0), ("b", 3, False, 0, 0), ("b", 4, False, 0, 0)],
        "identity string, pos int, positive boolean, episode int, race_extras int",
    )
    out = {r["identity"]: r for r in trace.sticky_accounting(t, ["identity"]).collect()}
    assert (out["a"]["static_checks"], out["a"]["adaptive_checks"], out["a"]["upper_bound"]) == (3, 3, 3)
    assert out["a"]["evictions"] == 1 and out["b"]["adaptive_checks"] == 0
    assert not out["a"]["recurring_episode"] and not out["a"]["misplaced_extras"]


def test_sticky_accounting_flags_tampering(spark):
    t = spark.createDataFrame(
        [("a", 0, True, 1, 0), ("a", 1, True, 2, 0), ("a", 2, True, 1, 0), ("b", 3, True, 1, 0), ("b", 4, False, 1, 0), ("c", 5, True, 1, 0), ("c", 6, True, 1, 2)],
        "identity string, pos int, positive boolean, episode int, race_extras int",
    )
    out = {r["identity"]: r for r in trace.sticky_accounting(t, ["identity"]).collect()}
    assert out["a"]["recurring_episode"] and out["b"]["not_sticky"] and out["c"]["misplaced_extras"]


@pytest.mark.parametrize("keys,capacity,hits", [(4, 4, 36), (128, 32, 0), (128, 96, 0), (8, 4, 0)])
def test_round_robin_caches(spark, keys, capacity, hits):
    t = spark.range(keys * 10).select(F.lit(1).alias("shard"), (F.col("id") % keys).alias("k"), F.col("id").alias("event_index"))
    r = trace.suppress_lru(t, capacity, ["shard"], ["k"]).first()
    assert (r["hits"], r["misses"], r["evictions"]) == (hits, keys * 10 - hits, keys * 10 - hits - min(keys, capacity))


@pytest.mark.parametrize("boundary,checks", [("inclusive", 2), ("exclusive", 2)])
def test_ttl_edges(spark, boundary, checks):
    t = spark.createDataFrame([("k", x) for x in (0, 9, 10, 11)], "k string, ts_ms long")
    first = trace.suppress_ttl(t, 10, boundary, ["k"]).first()
    assert (first["n"], first["checks"], first["expirations"]) == (4, checks, checks - 1)
    at_ttl = trace.suppress_ttl(t.where("ts_ms <= 10"), 10, boundary, ["k"]).first()["checks"]
    assert at_ttl == (2 if boundary == "inclusive" else 1)


def test_horizon_counts_later_ties_only(spark):
    t = spark.createDataFrame([(i, 5, 1, 1, 1, "t", "INVALID_REPEATED") for i in range(3)], "event_index long, ts_ms long, account long, generation long, version long, token string, label string")
    assert rows(trace.horizon_labels(t, 1), "event_index", "future_repeat_count") == [(0, 2), (1, 1), (2, 0)]


def test_replay_interval_policies(spark):
    t = spark.range(40).select(F.lit(0).alias("shard"), (F.col("id") % 4).alias("k"), F.col("id").alias("event_index"), F.col("id").alias("ts_ms"), F.lit(1).alias("bin"))
    got = {p: trace.replay_interval(t, 0, 2, 4, p, None, ["shard"], ["k"]).first()["backend_checks"] for p in ("always", "second_hit", "none")}
    assert got == {"always": 4, "second_hit": 8, "none": 40}


def test_lifecycle(spark):
    log = spark.createDataFrame([("a", 1, "PREPARED"), ("a", 2, "EDGE_DELTA_READY"), ("a", 3, "COMPACTED"), ("b", 1, "ACTIVE")], "k string, at int, status string")
    assert rows(trace.lifecycle_audit(log, ["k"], "at"), "k", "at", "legal") == [("a", 1, True), ("a", 2, True), ("a", 3, False), ("b", 1, False)]


def test_epoch_regression(spark):
    acks = spark.createDataFrame([("e", 1, 5), ("e", 2, 4), ("e", 3, 6)], "k string, at int, epoch int")
    assert rows(trace.epoch_regression(acks, ["k"], "at", ["epoch"]), "at") == [(2,)]


def test_route_precedence(spark):
    a = spark.createDataFrame(
        [(0, "PRESENT", True, True, "CREDENTIAL_MISMATCH"), (1, "PRESENT", True, True, "CREDENTIAL_MISMATCH"), (2, "STALE", True, True, "MATCH"), (3, "PRESENT", True, False, "CREDENTIAL_MISMATCH")],
        "event_index long, status string, covered boolean, represented boolean, result string",
    ).withColumns({"account": F.when(F.col("event_index") == 3, 2).otherwise(1), "generation": F.lit(1), "version": F.lit(1), "token": F.lit("t")})
    assert [r[1] for r in rows(trace.route_attempts(a), "event_index", "route")] == ["BACKEND_DENY", "NEGATIVE_CACHE_REJECT", "FAIL_OPEN_BACKEND", "SCREEN_REJECT"]


def test_allocation_closed_form(spark):
    # One region: w = 3, d = 2, floor 0.6: the least rate is 0.3 and the objective 0.9.
    p = spark.createDataFrame([(1, 10.0, 3.0, 2.0, 0.01, 0.9, 10 * math.log(5), 0.6)], "instance int, a double, weight double, compromise double, low double, high double, budget double, floor double")
    best = curves.grid_allocation(p, 90).first()
    assert best["objective"] == pytest.approx(0.9, abs=0.03) and best["eps"] >= 0.3
    sweep = curves.allocation_sweep(p, [0.0, 0.5, 1.0], [0.0, 1.5, 3.0]).first()
    assert sweep["bound"] <= 0.9 + 1e-9


def test_histogram_percentile_equals_values(spark):
    v = spark.createDataFrame([(1, x) for x in (1, 1, 2, 5, 9, 9, 9, 30)], "g int, v long")
    h = metrics.histogram_percentile(metrics.value_histogram(v, ["g"], "v"), ["g"], 0.9).first()["percentile"]
    assert h == pytest.approx(v.agg(F.expr("percentile(v, 0.9)")).first()[0])


def test_growth_needs_a_hundred_samples(spark):
    s = spark.range(99).select(F.lit(1).alias("g"), "id")
    assert metrics.first_last_decile_growth(s, ["g"], "id", "id").first()["growth"] is None
    s = spark.range(100).select(F.lit(1).alias("g"), "id")
    assert metrics.first_last_decile_growth(s, ["g"], "id", "id").first()["growth"] == 90.0


def test_saturation_statuses(spark):
    grid = [0, 32, 64, 96]
    cases = {"bracket": [1, 1, 0, 0], "censored": [1, 1, 1, 1], "below": [0, 0, 0, 0], "nonmonotone": [1, 0, 1, 0]}
    t = spark.createDataFrame([(c, load, bool(p), True, True) for c, ps in cases.items() for load, p in zip(grid, ps)], "curve string, load int, passed boolean, valid boolean, base_valid boolean")
    out = {r["curve"]: r for r in curves.bracket_saturation(t, ["curve"], "load").collect()}
    assert [out[c]["status"] for c in cases] == ["BRACKETED", "LOWER_BOUND_CENSORED", "BELOW_TESTED_GRID", "BRACKETED"]
    assert (out["bracket"]["lower"], out["bracket"]["upper"]) == (32, 64) and out["nonmonotone"]["nonmonotone"]
    assert out["censored"]["upper"] is None and out["below"]["lower"] is None


def test_quantiles_against_published_values():
    assert Q.t_quantile(0.975, 19) == pytest.approx(2.093024, abs=1e-6)
    assert Q.t_quantile(0.95, 1) == pytest.approx(6.313752, abs=1e-5)
    low, high = Q.clopper_pearson(0, 10, 0.05)
    assert low == 0 and high == pytest.approx(1 - 0.025**0.1, abs=1e-9)
    assert Q.clopper_pearson(10, 10, 0.05)[1] == 1.0 and Q.clopper_pearson(0, 0, 0.05) == (None, None)


def test_bloom_screen_loses_no_member(spark):
    from screenlake.functions import scalars as S

    members = spark.range(500).select(F.col("id").cast("string").alias("t"))
    for at in (S.probe_positions("t", 4, 4096), S.blocked_positions("t", 4, 8)):
        bits = screens.bloom_build(members, at)
        asked = screens.bloom_probe(members, ["t"], at, bits, 4, 4096)
        assert asked.where("not represented").isEmpty() and asked.count() == 500


def test_bloom_probes_agree(spark, monkeypatch):
    """The carried filter, the filter asked in turn, the packed blocks and plain Python say the same, probes included."""
    from screenlake.functions import scalars as S

    members = spark.range(300).select(F.col("id").cast("string").alias("t"))
    queries = spark.range(200, 900).select(F.col("id").cast("string").alias("t"), (F.col("id") % 2).alias("account"))
    for at, blocked in ((S.probe_positions("t", 5, 4096), False), (S.blocked_positions("t", 5, 8), True)):
        held = {p for r in members.select(at.alias("p")).collect() for p in r["p"]}
        want = {}
        for r in queries.select("t", "account", at.alias("p")).collect():
            miss = next((i for i, p in enumerate(r["p"]) if p not in held), None)
            want[r["t"], r["account"]] = (miss is None, 5 if miss is None else miss + 1)
        told = lambda df: {(r["t"], r["account"]): (r["represented"], r["probes"]) for r in df.collect()}
        bits = screens.bloom_build(members, at)
        assert told(screens.bloom_probe(queries, ["t", "account"], at, bits, 5, 4096)) == want
        if blocked:
            probe = screens.blocked_bloom_probe(queries, ["t", "account"], at, screens.blocked_bloom_build(members, at, 5), 5)
            assert told(probe) == want
            assert "Generate" not in probe._jdf.queryExecution().toString()  # nothing is exploded
        else:
            monkeypatch.setattr(screens, "CARRIED_BITS", 0)
            assert told(screens.bloom_probe(queries, ["t", "account"], at, bits, 5, 4096)) == want
            monkeypatch.undo()
    none = members.where("false")
    at = S.blocked_positions("t", 5, 8)
    assert screens.blocked_bloom_probe(queries, ["t"], at, screens.blocked_bloom_build(none, at, 5), 5).where("represented or probes <> 1").isEmpty()


def test_pareto_front_brute_force(spark):
    import random

    r = random.Random(3)
    pts = [(i, r.randint(0, 8), r.randint(0, 8), r.randint(0, 8)) for i in range(150)]
    df = spark.createDataFrame(pts, "i int, x int, y int, z int").withColumn("g", F.lit(1))
    for mins in (["x", "y"], ["x", "y", "z"]):
        k = [" ixyz".index(c) - 1 for c in mins]
        front = {p[0] for p in pts if not any(all(q[j] <= p[j] for j in k) and any(q[j] < p[j] for j in k) for q in pts)}
        for how in ({}, {"hot_rows": 0, "block": 9}):
            found = joins.pareto_front(df, mins, ["g"], **how)
            assert {t[0] for t in rows(found, "i")} == front
            assert how or "NestedLoop" not in found._jdf.queryExecution().toString()


def test_tampered_replay_counters_are_found(spark):
    good = {"positives": 10, "hits": 6, "misses": 4, "confirmations": 4, "races": 1, "checks": 5, "admitted": 4, "evictions": 2, "expirations": 1}
    bad = [good, good | {"hits": 7}, good | {"checks": 4}, good | {"evictions": 4}]
    df = spark.createDataFrame([(i, *b.values()) for i, b in enumerate(bad)], ["i", *good])
    assert rows(audit.replay_identities(df), "i") == [(1,), (2,), (3,)]


def test_write_refuses_to_overwrite(spark, tmp_path):
    df = spark.range(3)
    tables.write_no_replace(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exist"):
        tables.write_no_replace(df, str(tmp_path / "out"))
    back = tables.read_evidence(spark, str(tmp_path / "out"), "id long")
    assert back.count() == 3 and back.where("source_file is null").isEmpty()


def test_malformed_evidence_is_an_error(spark, tmp_path):
    (tmp_path / "e-001.jsonl").write_text('{"id": 1}\n{"id": \n')
    with pytest.raises(Exception):
        tables.read_evidence(spark, str(tmp_path), "id long").collect()


def test_auc_brute_force(spark):
    pos, neg = [3, 5, 5, 9], [1, 5, 2]
    df = spark.createDataFrame([(1, True, float(x)) for x in pos] + [(1, False, float(x)) for x in neg], "g int, p boolean, x double")
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert stats.auc(df, ["g"], "p", "x").first()["auc"] == pytest.approx(want)


def test_chronological_split_without_global_window(spark):
    out = trace.chronological_split(spark.range(1000).select(F.col("id").alias("event_index")))
    assert dict(out.groupBy("role").count().collect()) == {"train": 500, "validation": 200, "test": 300}
