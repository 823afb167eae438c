"""Statistics, models and replays against outside values and plain Python."""

import math
import random
from collections import Counter, OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenlake.functions import quantiles as Q
from screenlake.functions import scalars as S
from screenlake.operators import audit, curves, joins, models, stats, trace
from screenlake.sources import scratch
from screenlake.streaming import attempts as M


def test_t_quantiles_of_any_size(spark):
    # Outside values: tables of Student's t at 0.975.
    want = {1: 12.7062047, 10: 2.2281389, 200: 1.9718962, 201: 1.9718365, 500: 1.9647198, 10_000: 1.9602012, 1_000_000: 1.9599664}
    rows = spark.createDataFrame([(k,) for k in [*want, 0, -3]], "df long").withColumn("t", Q.t_critical(F.col("df"), 0.975)).collect()
    got = {r["df"]: r["t"] for r in rows}
    assert got[0] is None and got[-3] is None
    for k, t in want.items():
        assert got[k] == pytest.approx(t, abs=2e-6) and got[k] == pytest.approx(Q.t_quantile(0.975, k), rel=1e-8)
    for p in (0.9, 0.995, 0.9999):
        x = spark.range(1).select(Q.t_critical(F.lit(201), p).alias("t")).first()["t"]
        assert x == pytest.approx(Q.t_quantile(p, 201), rel=1e-7)


def test_token_prefixes_of_all_widths(spark):
    token = "f7" * 32
    widths = (1, 8, 18, 60, 61, 62, 64, 100, 128)
    got = spark.createDataFrame([(token,)], "t string").select(*[S.token_prefix("t", b).alias(str(b)) for b in widths]).first()
    for b in widths:
        digits = -(-b // 4)
        want = int(token[:digits], 16) >> (4 * digits - b)
        assert (int(got[str(b)], 16) >> (4 * digits - b) if b > 60 else got[str(b)]) == want


def test_fronts_leave_nulls_out(spark):
    rows = spark.createDataFrame([(1, 1, 0, 0), (1, 1, 0, 1), (None, 0, 0, 2), (2, 0, 0, 3), (2, 2, 0, 4)], "x long, y long, z long, id long").withColumn("g", F.lit(1))
    for mins in (["x", "y"], ["x", "y", "z"]):
        assert {r["id"] for r in joins.pareto_front(rows, mins, ["g"]).collect()} == {0, 1, 3}


def test_stump_without_a_split_and_its_scores(spark):
    flat = spark.createDataFrame([(1.0, 0.0, 1.0), (1.0, 1.0, 3.0)], "x double, y double, w double")
    m = models.fit_stump(flat, ["x"], "y", "w")
    r = m.first()
    assert (r["feature"], r["left"], r["right"], round(r["loss"], 9)) == (None, 0.75, 0.75, 0.1875)
    assert {x["score"] for x in models.score_stump(flat, m, ["x"]).collect()} == {0.75}
    rows = spark.createDataFrame([(float(k), float(k > 6), 1.0) for k in range(12)], "x double, y double, w double")
    scored = models.score_stump(rows, models.fit_stump(rows, ["x"], "y", "w"), ["x"]).collect()
    assert all(x["score"] == x["y"] for x in scored)


def plain_replay(rows, quota, policy, ttl):
    """rows: (key, time, extras) in order."""
    held, missed, out = OrderedDict(), Counter(), Counter()
    for key, t, extra in rows:
        if key in held and ttl is not None and t - held[key] > ttl:
            held.pop(key)
            out["expirations"] += 1
        if key in held:
            held.move_to_end(key)
            out["cache_hits"] += 1
        else:
            out["base_confirmations"] += 1
            out["race_extras"] += extra
            missed[key] += 1
            if quota and (policy == "always" or (policy == "second_hit" and missed[key] > 1)):
                if len(held) == quota:
                    held.popitem(last=False)
                    out["evictions"] += 1
                held[key] = t
                out["admitted"] += 1
    out["backend_checks"] = out["base_confirmations"] + out["race_extras"]
    return out


@pytest.mark.parametrize("policy", ["always", "second_hit", "none"])
@pytest.mark.parametrize("quota, ttl", [(0, None), (3, None), (3, 40), (100, 25)])
def test_replays(spark, policy, quota, ttl):
    r = random.Random(quota)
    rows = [(i, r.randrange(2), f"k{min(r.randrange(9), r.randrange(9))}", 5 * i + r.randrange(5), r.randrange(3) // 2, r.randrange(4)) for i in range(400)]
    t = spark.createDataFrame(rows, "event_index long, shard long, k string, ts_ms long, races long, bin long")
    got = {x["shard"]: x.asDict() for x in trace.replay_interval(t, 1, 3, quota, policy, ttl, ["shard"], ["k"], extras="races").collect()}
    for s in (0, 1):
        want = plain_replay([(k, at, x) for _, shard, k, at, x, b in rows if shard == s and 1 <= b < 3], quota, policy, ttl)
        assert {c: v for c, v in got[s].items() if c != "shard"} == {c: want[c] for c in got[s] if c != "shard"}


@pytest.mark.parametrize("ttl", [None, 60])
def test_option_table_replays_each_option(spark, ttl):
    r = random.Random(3)
    rows = [(i, f"k{min(r.randrange(30), r.randrange(30))}", 3 * i, r.randrange(2), r.randrange(4)) for i in range(600)]
    t = spark.createDataFrame(rows, "event_index long, token_key string, ts_ms long, races long, bin long")
    grid = spark.createDataFrame([(0, 2, 40.0, 8.0), (1, 4, 60.0, 9.0)], "start_bin long, end_bin long, occupancy double, compromise double")
    got = trace.option_table(t, grid, [0, 30, 4000], [0, 2, 5, 1000], ["always", "second_hit", "none"], [1, 2], 0.5, ttl=ttl, extras="races", memory_bytes=2, entry_bytes=10, resource_quantum=16, compromise_quantum=2.0).collect()
    assert len(got) == 2 * 3 * 4 * 3
    import hashlib

    for x in got:
        a, b, m, q, p = (x[c] for c in ("start_bin", "end_bin", "memory", "quota", "policy"))
        occupancy, compromise = {0: (40.0, 8.0), 1: (60.0, 9.0)}[a]
        eps = math.exp(-0.5 * 2 * m / occupancy)
        costs = []
        for seed in (1, 2):
            passes = lambda k: int(hashlib.md5(f"{seed}:{a}:{b}|{k}".encode()).hexdigest()[:8], 16) / 2**32 < eps
            costs.append(plain_replay([(k, at, e) for _, k, at, e, bin_ in rows if a <= bin_ < b and passes(k)], q, p, ttl)["backend_checks"])
        assert x["seed_costs"] == sorted(costs) and x["mean_cost"] == pytest.approx(sum(costs) / 2)
        assert x["memory_quanta"] == math.ceil((2 * m + 10 * q) / 16) and x["compromise_quanta"] == math.floor(compromise * eps / 2 + 1e-12)
    assert {x["quota"] for x in got if x["mean_cost"] > 0 and x["memory"] == 0 and x["policy"] == "always" and x["start_bin"] == 0 and x["seed_costs"]} == {0, 2, 5, 1000}


def test_screens_that_let_all_through_share_one_cache(spark, monkeypatch):
    rows = [(i, f"k{i * i % 7}", 3 * i, i % 2) for i in range(40)]
    t, met = spark.createDataFrame(rows, "event_index long, token_key string, ts_ms long, bin long"), []
    counters = trace.cache_counters
    monkeypatch.setattr(trace, "cache_counters", lambda df, *a: met.append(df.select("start_bin", "memory", "seed").distinct().count()) or counters(df, *a))
    grid = spark.createDataFrame([(0, 1), (0, 2)], "start_bin long, end_bin long")
    got = trace.option_table(t, grid, [0, 1], [2], ["always"], [1, 2, 3], 0.0, ttl=20).collect()
    assert met == [1] and len(got) == 4 and all(len(x["seed_costs"]) == 3 and len(set(x["seed_costs"])) == 1 for x in got)
    want = {end: plain_replay([(k, at, 0) for _, k, at, b in rows if b < end], 2, "always", 20)["backend_checks"] for end in (1, 2)}
    assert {(x["end_bin"], x["mean_cost"]) for x in got} == set(want.items())


@pytest.mark.parametrize("stretch", [13, 1 << 16])
@pytest.mark.parametrize("ttl", [None, 50])
def test_options_over_stretches_and_times_that_run_back(spark, monkeypatch, stretch, ttl):
    r = random.Random(stretch)
    rows = [(i, f"k{min(r.randrange(60), r.randrange(60), i // 4)}", 3 * i - r.randrange(40) if i % 11 else None, r.randrange(2), r.randrange(4)) for i in range(500)]
    t = spark.createDataFrame(rows, "event_index long, token_key string, ts_ms long, races long, bin long")
    monkeypatch.setattr(trace, "STRETCH", stretch)
    grid = spark.createDataFrame([(0, 3, 40.0, 8.0), (1, 4, 60.0, 9.0)], "start_bin long, end_bin long, occupancy double, compromise double")
    got = trace.option_table(t, grid, [0, 30], [0, 1, 6, 25], ["always", "second_hit", "none"], [1, 2], 0.5, ttl=ttl, extras="races").collect()
    assert len(got) == 2 * 2 * 4 * 3
    import hashlib

    for x in got:
        a, b, m = (x[c] for c in ("start_bin", "end_bin", "memory"))
        eps, costs = math.exp(-0.5 * m / {0: 40.0, 1: 60.0}[a]), []
        for seed in (1, 2):
            met, latest = [], {p: -(1 << 60) for p in (False, True)}
            known = set()
            for _, k, at, e, bin_ in rows:
                if a <= bin_ < b and int(hashlib.md5(f"{seed}:{a}:{b}|{k}".encode()).hexdigest()[:8], 16) / 2**32 < eps:
                    # The clock of a cache is that of the requests it is asked for: with 'second_hit' not a key's first.
                    if x["policy"] != "second_hit" or k in known:
                        latest[True] = max(latest[True], -(1 << 60) if at is None else at)
                    known.add(k)
                    met.append((k, latest[True], e))
            costs.append(plain_replay(met, x["quota"], x["policy"], ttl)["backend_checks"])
        assert x["seed_costs"] == sorted(costs), x


def test_requests_no_cache_can_answer_are_not_multiplied_by_options(spark, monkeypatch):
    r = random.Random(7)
    rows = [(i, f"k{r.randrange(4000)}", 3 * i, 0) for i in range(8000)]
    t, met, counters = spark.createDataFrame(rows, "event_index long, token_key string, ts_ms long, bin long"), [], trace.cache_counters
    monkeypatch.setattr(trace, "cache_counters", lambda df, *a: met.append(df.count()) or counters(df, *a))
    got = trace.option_table(t, spark.createDataFrame([(0, 1)], "start_bin long, end_bin long"), [0, 100, 900], [8], ["always", "second_hit"], [1, 2, 3], 0.5, ttl=600).collect()
    assert {x["mean_cost"] for x in got if x["memory"] == 0} == {plain_replay([(k, at, 0) for _, k, at, _ in rows], 8, p, 600)["backend_checks"] for p in ("always", "second_hit")}
    assert len(met) == 1 and met[0] < len(rows) / 4


def test_grid_allocation_makes_no_row_per_rate(spark):
    columns = "instance long, a double, weight double, compromise double, low double, high double, budget double, floor double"
    df = spark.createDataFrame([(1, 2.0, 3.0, 2.0, 0.01, 0.9, 2 * math.log(5), 0.0), (2, 1.0, 3.0, 2.0, 0.01, 0.9, 9.0, 0.6), (3, 1.0, 1.0, 1.0, 0.01, 0.9, 9.0, 0.95), (4, None, 1.0, 1.0, 0.01, 0.9, 9.0, 0.1)], columns)
    out = curves.grid_allocation(df, 90)
    assert {r["instance"]: (round(r["objective"], 9), round(r["eps"], 9)) for r in out.collect()} == {1: (0.6, 0.2), 2: (0.9, 0.3)}
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()


def test_exact_binomial_bounds(spark):
    # Outside values: 95 % Clopper-Pearson intervals of 1 in 20, 5 in 10 and 0 in 50.
    rows = spark.createDataFrame([("a", k < 1) for k in range(20)] + [("b", k < 5) for k in range(10)] + [("c", False)] * 50, "g string, hit boolean")
    got = {r["g"]: (round(r["ci_low"], 4), round(r["ci_high"], 4)) for r in stats.binomial_ci(rows, ["g"], F.col("hit"), 0.05).collect()}
    assert got == {"a": (0.0013, 0.2487), "b": (0.1871, 0.8129), "c": (0.0, 0.0711)}
    # One-sided bounds of gates: 1 - alpha ** (1 / n) where nothing fails.
    sure = rows.where("g = 'c'")
    r = stats.planning_bound(sure, "g", F.col("hit"), 0.01).first()
    assert r["failure_bound"] == pytest.approx(1 - 0.01 ** (1 / 50)) and r["joint_lower_bound"] == pytest.approx(0.01 ** (1 / 50)) and r["gates"] == 1


def test_envelope_and_filter_summary(spark):
    rows = [("a", s, k < (2 + s % 2), 10.0, 1.0 + k) for s in range(4) for k in range(10)] + [("b", s, k < 5, 20.0, 2.0) for s in range(4) for k in range(10)]
    df = spark.createDataFrame(rows, "spec string, seed long, hit boolean, memory double, latency double")
    e = {r["spec"]: r for r in stats.ffr_envelope(df, ["spec"], "seed", F.col("hit"), 0.05).collect()}
    low, high = Q.clopper_pearson(10, 40, 0.05)
    half = Q.t_quantile(0.975, 3) * np.std([0.2, 0.3, 0.2, 0.3], ddof=1) / 2
    assert e["a"]["ci_low"] == pytest.approx(max(0, min(low, 0.25 - half))) and e["a"]["ci_high"] == pytest.approx(min(1, max(high, 0.25 + half)))
    s = {r["spec"]: r for r in stats.filter_summary(df, ["spec"], "seed", F.col("hit"), "memory", "latency", 0.05).collect()}
    assert s["a"]["on_front"] and not s["b"]["on_front"] and s["a"]["latency"] == 5.5 and (s["b"]["x"], s["b"]["n"]) == (20, 40)


def test_logistic_fits_reach_the_gradient_s_zero(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 2)) * [1, 5] + [0, 3]
    y = (r.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 0.3 * x[:, 1])))).astype(float)
    w = 1.0 + r.integers(0, 2, 400)
    df = spark.createDataFrame([(int(k % 2), *map(float, row), float(a), float(b)) for k, (row, a, b) in enumerate(zip(x, y, w))], "g long, a double, b double, y double, w double")
    m = models.fit_logistic(df, ["a", "b"], "y", "w", l2=1e-3)
    mean, scale = np.average(x, axis=0, weights=w), np.sqrt(np.average((x - np.average(x, axis=0, weights=w)) ** 2, axis=0, weights=w))
    z = np.column_stack((np.ones(400), (x - mean) / scale))
    beta = np.array(m.coefficients)
    p = 1 / (1 + np.exp(-z @ beta))
    assert np.allclose(m.mean, mean) and np.allclose(m.scale, scale)
    assert np.abs(z.T @ (w * (p - y)) / w.sum() + 1e-3 * np.array([0, 1, 1]) * beta).max() < 1e-8
    pair = models.fit_ridge_pairwise(df, ["g"], ["a", "b"], "y", 0.5)
    for row in pair.collect():
        k = np.arange(400) % 2 == row["g"]
        q = np.quantile(x[k], [0.25, 0.5, 0.75], axis=0)
        u = np.column_stack((np.ones(k.sum()), (x[k] - q[1]) / (q[2] - q[0])))
        b = np.array(row["beta"])
        p = 1 / (1 + np.exp(-u @ b))
        assert np.abs(u.T @ (p - y[k]) / k.sum() + 0.5 * np.array([0, 1, 1]) * b).max() < 1e-7


def test_slices_arrive_as_batches_and_late_rows_are_told(spark):
    r = random.Random(5)
    rows = [(i, i % 7, f"t{min(r.randrange(5), r.randrange(5))}", 100 * i, True) for i in range(700)]
    df = spark.createDataFrame(rows + [(1007, 99, "far", 10_000_000, False), (1500, 99, "far", 20_000_000, False)], "event_index long, account long, token string, ts_ms long, exact_mismatch boolean")
    late = df.where("event_index < 7").withColumn("event_index", F.col("event_index") + 1000)
    stream, progress = scratch.arrivals(df.unionByName(late), "event_index", 4, "test-late"), []
    stream = M.stream_suppress(stream, 5_000, 2, delay="0 seconds", span_ms=1_000)
    out = M.run_to_end(stream, scratch.scratch(spark, "test-out"), scratch.scratch(spark, "test-progress"), progress=progress).collect()
    out = [x for x in out if x["account"] < 99]
    assert len(out) == 707 and {x["event_index"] for x in out if x["late"]} == set(range(1000, 1007)) and all(x["forwarded"] for x in out if x["late"])
    # Rows far ahead have moved the watermark past every expiry: the last alone (and its timer) is left in state.
    state = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert max(state) > 60 and state[-1] <= 3
    got = {x["event_index"]: x["forwarded"] for x in out}
    for account in range(7):
        held = OrderedDict()
        for i, a, token, t, _ in rows:
            if a != account:
                continue
            if token in held and t - held[token] >= 5_000:
                held.pop(token)
            assert got[i] == (token not in held)
            if token in held:
                held.move_to_end(token)
            else:
                if len(held) == 2:
                    held.popitem(last=False)
                held[token] = t


def test_prefix_features_forget_a_scope(spark):
    """Rows out of order within a batch are answered in event order; a scope unseen for the retirement time starts anew."""
    at = {0: 0, 1: 1_000, 2: 1_000, 3: 2_500, 4: 9_000, 5: 60_000, 6: 61_000, 9: 10_000_000}
    rows = [(i, 1, 1, 1, f"t{i % 2}", t, i != 3) for i, t in at.items()]
    df = spark.createDataFrame(rows[:4][::-1] + rows[4:], "event_index long, account long, generation long, version long, token string, ts_ms long, invalid boolean")
    stream, progress = scratch.arrivals(df, "event_index", 3, "test-prefix"), []
    stream = M.stream_prefix_features(stream, delay="0 seconds", span_ms=2_000, retire_ms=20_000)
    out = M.run_to_end(stream, scratch.scratch(spark, "test-out"), scratch.scratch(spark, "test-progress"), progress=progress)
    got = {r["event_index"]: (r["same_count"], r["scope_invalid"], r["scope_distinct"]) for r in out.collect()}
    assert got == {0: (0, 0, 0), 1: (0, 1, 1), 2: (1, 2, 2), 3: (1, 3, 2), 4: (2, 3, 2), 5: (0, 0, 0), 6: (0, 1, 1)}
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 3


@pytest.mark.parametrize("form", ["suppress", "prefix"])
def test_streams_of_many_keys_share_few_buckets(spark, form):
    """State accesses and timers don't grow with the keys; null is a key as any other, and large keys keep their digits."""
    rows = [(i, None if i % 1_500 == 7 else 2**60 + i % 1_500, 1, 1, f"t{i % 3}", 10 * i, True, True) for i in range(6_000)]
    rows.append((9_000, -1, -1, -1, "", 10**9, False, False))
    df = spark.createDataFrame(rows, "event_index long, account long, generation long, version long, token string, ts_ms long, exact_mismatch boolean, invalid boolean")
    stream, progress = scratch.arrivals(df, "event_index", 3, f"test-{form}"), []
    stream = M.stream_suppress(stream, 1 << 40, 2, span_ms=20_000) if form == "suppress" else M.stream_prefix_features(stream, span_ms=20_000)
    out = M.run_to_end(stream, scratch.scratch(spark, "test-out"), scratch.scratch(spark, "test-progress"), progress=progress).collect()
    got = {r["event_index"]: r for r in out}
    assert len(out) == len(got) == 6_000
    for i, account, _, _, _, _, _, _ in rows[:6_000]:
        if form == "suppress":  # tokens of an account: t(i), t(i), t(i), t(i), since 3 divides 1,500
            assert got[i]["account"] == account and got[i]["forwarded"] == (i < 1_500)
        else:
            assert (got[i]["same_count"], got[i]["scope_invalid"], got[i]["scope_distinct"]) == (i // 1_500, i // 1_500, min(1, i // 1_500))
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) <= 256 * 13  # a state, and a span and a timer's two rows for each of four spans


def test_epochs_of_many_pairs_share_few_buckets(spark):
    rows = [(i, i % 7, None if i % 1_500 == 7 else 2**60 + i % 1_500, i // 1_500 - 2 * (i // 1_500 == 2), 5, i) for i in range(6_000)]
    df = spark.createDataFrame(rows, "event_index long, edge long, account long, epoch long, representation long, ts_ms long")
    df = df.withColumn("edge", F.coalesce("account", F.lit(7)) % 7)
    stream, progress = scratch.arrivals(df, "event_index", 3, "test-epochs"), []
    out = M.run_to_end(M.stream_epoch_watermark(stream), scratch.scratch(spark, "test-out"), scratch.scratch(spark, "test-progress"), progress=progress).collect()
    got = {r["event_index"]: r for r in out}
    assert len(out) == len(got) == 6_000
    for i, _, account, epoch, _, _ in rows:
        r = got[i]
        assert (r["account"], r["epoch"], r["regressed"], r["watermark"]) == (account, epoch, i // 1_500 == 2, (0, 1, 1, 3)[i // 1_500])
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) <= 256


@pytest.mark.parametrize(
    "rows, want",
    [
        ([("a", 0.01, 200.0), ("a", 0.04, 100.0)], "STOP_PRECISE"),
        ([("a", 0.01, 200.0), ("a", 0.06, 100.0)], "EXTEND"),
        ([("a", 0.01, 200.0), ("a", None, 100.0)], "EXTEND"),
        ([("a", 0.01, 200.0), ("a", 0.04, 99.0)], "STOP_TIMER"),
        ([("a", 0.01, None)], "STOP_TIMER"),
        ([("a", 0.01, 200.0), ("b", 0.01, 1.0)], "STOP_STRATA"),
    ],
)
def test_first_look(spark, rows, want):
    df = spark.createDataFrame(rows, "host string, half double, timer double")
    assert audit.look_decision(df, "half", 0.05, "host", "timer", 100).first()["decision"] == want


def test_missing_answers_are_failures(spark):
    columns = "g string, expected_valid boolean, accepted boolean, rejected boolean, require_fail_open boolean, fail_open boolean, require_backend boolean, backend_calls int, recovery_check boolean, directory_present boolean, backend_match boolean"
    good = ("x", True, True, False, True, True, True, 1, True, True, True)
    events = spark.createDataFrame([good, ("x", True, None, None, True, None, True, None, True, None, None), ("x", False, None, None, False, None, False, None, False, None, None)], columns)
    guards = spark.createDataFrame([("x", True), ("x", None), ("y", False)], "g string, passed boolean")
    got = {r["g"]: r.asDict() for r in audit.safety_summary(events, ["g"], guards).collect()}
    assert got["x"] == {
        "g": "x", "attempts": 3, "valid_attempts": 2, "false_rejects": 0, "acceptance_failures": 1, "invalid_acceptance_failures": 1, "fail_open_expectations": 2, "fail_open_violations": 1,
        "forward_violations": 1, "recovery_checks": 2, "recovery_failures": 1, "guard_expectations": 2, "guard_failures": 1,
    }
    assert got["y"]["attempts"] == 0 and got["y"]["guard_failures"] == 1
