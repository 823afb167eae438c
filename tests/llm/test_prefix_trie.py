"""The prefix trie against brute force, its list ranking and running sums against plain loops."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from screenlake.llm import prefix_trie, scan

SCHEMA = "conv_id long, turn long, role string, text string, depth long, k long"


def test_running_sums(spark):
    r = random.Random(0)
    for n in (0, 1, 1500):
        rows = [(None if r.random() < 0.05 else (7 if r.random() < 0.5 else r.randrange(1 + n // 20)), r.random(), r.randrange(-5, 9), r.randrange(3)) for _ in range(n)]
        df = spark.createDataFrame(rows, "g long, o double, x long, y long").repartition(3)
        want, all_, so_far, total = [], [], defaultdict(lambda: [0, 0]), 0
        for g, o, x, y in sorted(rows, key=lambda t: t[1]):
            so_far[g][0] += x
            so_far[g][1] += y
            total += x
            want.append((o, *so_far[g]))
            all_.append((o, total))
        assert sorted(map(tuple, scan.running_sums(df, ["g"], ["o"], {"sx": "x", "sy": "y"}, "t").select("o", "sx", "sy").collect())) == sorted(want)
        assert sorted(map(tuple, scan.running_sums(df, [], ["o"], {"sx": "x"}, "t").select("o", "sx").collect())) == all_


@pytest.mark.parametrize("n,short", [(0, 4), (2, 1), (90, 20)])
def test_list_rank(spark, n, short):
    order = list(range(n))
    random.Random(1).shuffle(order)
    arcs = spark.createDataFrame([(order[i], order[i + 1] if i + 1 < n else None) for i in range(n)], "arc long, next long").repartition(3)
    got = {r["arc"]: r["position"] for r in prefix_trie.list_rank(arcs, short).collect()}
    assert got == {a: i for i, a in enumerate(order)}


def rebuilt(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[conv].append(((turn is not None, turn or 0), role, digest, text))
    turns = {c: [(t[1], t[3]) for t in sorted(ts)] for c, ts in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = tuple(turns.get(base, [])[:h] + own[h:])
    return out


def brute(rows):
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    out = []
    for p, ms in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(1 for q in below if not any(len(x) == len(q) + 1 and x[:-1] == q for x in below))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in ms if len(convs[c]) == len(p))))
        out.append((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def told(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA).repartition(3)
    convs, turns = prefix_trie.with_shared_heads(prefix_trie.ordered_turns(df))
    found = prefix_trie.prefix_trie(convs, turns, **kw)
    assert found.columns == COLUMNS
    return sorted(map(tuple, found.collect()))


def test_query_equals_brute_force(spark):
    r = random.Random(5)
    say = lambda: r.choice(["hi", "ho", "", None, "é" * 3])
    rows = []
    for c in [*range(-7, 20), 10**15, None]:
        for t in range(r.choice([0, 1, 3, 8, 12])):
            rows.append((c, r.choice([t, t, None, 0]), r.choice(["user", "assistant", None]), say()))
    rows += rows[:20]
    want = brute(rows)
    assert len(want) > 60
    assert told(spark, rows, short=60, chunk=2) == want


def test_hot_parent_end_and_long_conversation(spark):
    """Half the conversations are alike, one has a fifth of all turns, many share the first turn."""
    rows = [(5 * c, t, "user", f"{t}") for c in range(30) for t in range(3)] + [(5 * c, t, "user", f"{t and c}") for c in range(30, 60) for t in range(2)]
    rows += [(1000, t, "user", "x") for t in range(40)]
    assert told(spark, rows, short=80, chunk=7) == brute(rows)


def test_small_tables(spark):
    assert told(spark, []) == []
    rows = [(3, None, None, None), (None, 1, "user", "x"), (105, 1, "a", "bc"), (106, 1, "ab", "c")]
    assert told(spark, rows) == brute(rows)


def test_extra_columns_and_whole_query(spark):
    rows = [(c, t, "user", f"{(c + t) % 3}") for c in range(5) for t in range(4)]
    df = spark.createDataFrame([(*r, 9, 9) for r in rows], SCHEMA)
    assert sorted(map(tuple, prefix_trie.conversation_trie(df.withColumn("parent", F.lit("clash"))).collect())) == brute(rows)
