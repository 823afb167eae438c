"""Running values, positions, reuse distances and episodes against plain loops, with one group of most rows."""

import random
from collections import OrderedDict, defaultdict

import numpy as np
import pytest

from screenlake.operators import ordered, trace


def rows_of(seed, n, keys=6):
    """(event_index, shard, key, ts_ms, value): one shard and one key hold most rows."""
    r = random.Random(seed)
    at = sorted(r.randrange(4 * n) for _ in range(n))
    return [(i, r.choice([0, 0, 0, 0, 1, None]), f"k{min(r.randrange(keys), r.randrange(keys), r.randrange(keys))}", t, r.choice([None, *range(9)])) for i, t in enumerate(at)]


SCHEMA = "event_index long, shard long, k string, ts_ms long, v long"


@pytest.mark.parametrize("before", [False, True])
@pytest.mark.parametrize("group", [["shard"], ["shard", "k"], []])
def test_running_values_of_cut_groups(spark, before, group):
    rows = rows_of(1, 500)
    values = {"s": ("sum", "v"), "least": ("min", "v"), "most": ("max", "v"), "latest": ("last", "v")}
    want, seen = {}, defaultdict(list)
    for row in rows:
        key = tuple(row[{"shard": 1, "k": 2}[g]] for g in group)
        if not before:
            seen[key].append(row[4])
        known = [v for v in seen[key] if v is not None]
        want[row[0]] = (sum(known), min(known), max(known), known[-1]) if known else (None,) * 4
        if before:
            seen[key].append(row[4])
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for hot_rows in (3, 10_000):
        out = ordered.running(df, group, ["ts_ms", "event_index"], values, before, hot_rows)
        assert out.columns == [*df.columns, *values]
        assert {r["event_index"]: (r["s"], r["least"], r["most"], r["latest"]) for r in out.collect()} == want


def test_positions(spark):
    rows = rows_of(2, 300)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [r["event_index"] for r in ordered.numbered(df, ["v", "event_index"]).orderBy("position").collect()]
    assert got == [r[0] for r in sorted(rows, key=lambda r: (r[4] is not None, r[4] or 0, r[0]))]
    assert ordered.numbered(df.where("false"), ["v"]).count() == 0


def test_smaller_before():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 64, 333):
        for values in (r.integers(-1, 5, n), r.permutation(n)):
            assert ordered.smaller_before(values).tolist() == [int((values[:i] < values[i]).sum()) for i in range(n)]


@pytest.mark.parametrize("block", [7, 1 << 18])
def test_reuse_distances(spark, block):
    rows = rows_of(4, 400, keys=25)
    want, used = {}, defaultdict(OrderedDict)
    for i, shard, k, _, _ in rows:
        keys = used[shard]
        want[i] = list(reversed(keys)).index(k) if k in keys else None
        keys.pop(k, None)
        keys[k] = True
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = trace.reuse_distance(df, ["shard"], ["k"], carry=["v"], block=block)
    assert {r["event_index"]: r["distance"] for r in got.collect()} == want
    assert trace.reuse_distance(df.where("false"), ["shard"], ["k"]).count() == 0
    if block == 7:
        capacity = 6
        held, counts = defaultdict(OrderedDict), defaultdict(lambda: [0, 0, 0])
        for _, shard, k, _, _ in rows:
            cache, c = held[shard], counts[shard]
            if k in cache:
                c[0] += 1
                cache.move_to_end(k)
                continue
            c[1] += 1
            if len(cache) == capacity:
                cache.popitem(last=False)
                c[2] += 1
            cache[k] = True
        told = trace.suppress_lru(df, capacity, ["shard"], ["k"]).collect()
        assert {r["shard"]: [r["hits"], r["misses"], r["evictions"]] for r in told} == dict(counts)


@pytest.mark.parametrize("boundary", ["inclusive", "exclusive"])
@pytest.mark.parametrize("ttl", [1, 13, 5000])
def test_episodes_of_hot_keys(spark, boundary, ttl, monkeypatch):
    monkeypatch.setattr(ordered.running, "__defaults__", (False, 5))  # cut groups of more than five rows
    rows = [(i, s, "hot" if i % 3 else k, t, v) for i, s, k, t, v in rows_of(5, 300)]
    n, checks, since = defaultdict(int), defaultdict(int), {}
    for _, shard, k, t, _ in rows:
        key = (shard, k)
        n[key] += 1
        if key not in since or (t - since[key] >= ttl if boundary == "inclusive" else t - since[key] > ttl):
            since[key] = t
            checks[key] += 1
    got = trace.suppress_ttl(spark.createDataFrame(rows, SCHEMA).repartition(3), ttl, boundary, ["shard", "k"]).collect()
    assert {(r["shard"], r["k"]): (r["n"], r["checks"], r["expirations"]) for r in got} == {k: (n[k], checks[k], checks[k] - 1) for k in n}


def test_plans_have_no_row_loops(spark):
    df = spark.createDataFrame(rows_of(6, 50), SCHEMA)
    plan = trace.suppress_ttl(df, 5, "inclusive", ["shard", "k"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "collect_list" not in plan


def test_fronts_of_groups_and_nulls(spark):
    from screenlake.operators import joins

    r = random.Random(8)
    pts = [(i, r.choice(["a", "a", "a", "b", None]), *(r.choice([None, *range(12)]) if r.random() < 0.1 else r.randrange(12) for _ in range(3))) for i in range(400)]
    df = spark.createDataFrame(pts, "i int, g string, x int, y int, z int").repartition(3)
    for k in (2, 3):
        whole = [p for p in pts if None not in p[2 : 2 + k]]
        beats = lambda q, p: q[1] == p[1] and all(a <= b for a, b in zip(q[2 : 2 + k], p[2 : 2 + k])) and q[2 : 2 + k] != p[2 : 2 + k]  # noqa: B023, E731
        front = {p[0] for p in whole if not any(beats(q, p) for q in whole)}
        for hot_rows, block in ((0, 20), (10_000, 1 << 17)):
            assert {row["i"] for row in joins.pareto_front(df, ["x", "y", "z"][:k], ["g"], hot_rows, block).collect()} == front


def test_percentiles_by_selection(spark):
    from screenlake.operators import metrics

    rows = rows_of(9, 400)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["shard"]: r for r in metrics.distribution(df, ["shard"], "v").collect()}
    for shard in (0, 1, None):
        v = [r[4] for r in rows if r[1] == shard and r[4] is not None]
        want = (len(v), min(v), *(float(x) for x in np.percentile(v, [50, 95, 99])), max(v))
        assert tuple(got[shard][c] for c in ("n", "least", "p50", "p95", "p99", "greatest")) == pytest.approx(want)
    alone = metrics.percentiles(df, [], "v", {"p": 0.3}).first()["p"]
    assert alone == pytest.approx(np.percentile([r[4] for r in rows if r[4] is not None], 30))
    assert metrics.distribution(df.withColumn("v", df.v * None), ["shard"], "v").where("p50 is not null").isEmpty()


def test_digest_tree_tells_order_and_content(spark):
    import hashlib

    from screenlake.operators import metrics

    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def tree(values, leaf):
        level = [sha(str(v)) for v in values]
        while True:
            level = [sha("".join(level[i : i + leaf])) for i in range(0, len(level), leaf)]
            if len(level) == 1:
                return level[0]

    rows = [(s, i, (i * 7) % 31) for s, n in (("a", 1), ("b", 4), ("c", 5), ("d", 70)) for i in range(n)]
    told = lambda rows: {r["s"]: (r["n"], r["digest"]) for r in metrics.digest_tree(spark.createDataFrame(rows, "s string, i long, v long").repartition(3), ["s"], "i", "v", leaf=4).collect()}
    first = told(rows)
    assert first == {s: (len(v), tree(v, 4)) for s in "abcd" for v in [[r[2] for r in rows if r[0] == s]]}
    moved = [(s, {20: 21, 21: 20}.get(i, i) if s == "d" else i, v) for s, i, v in rows]
    assert {s for s in "abcd" if told(moved)[s] != first[s]} == {"d"}


def test_split_of_a_skewed_trace(spark):
    """Nine tenths of the rows within one hour of a year."""
    r = random.Random(10)
    at = sorted(r.sample(range(3600), 900)) + [10**7 * (k + 1) for k in range(100)]
    df = spark.createDataFrame([(t,) for t in at], "event_index long").repartition(5)
    got = {x["event_index"]: (x["fraction"], x["role"]) for x in trace.chronological_split(df).collect()}
    assert got == {t: (i / 1000, "train" if i < 500 else "validation" if i < 700 else "test") for i, t in enumerate(at)}
