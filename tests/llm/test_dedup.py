"""Exact copies, SimHash components and repeated passages against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from screenlake.llm import exact_dedup, simhash, substring_dedup
from screenlake.llm.components import components

SCHEMA = "doc_id long, text string, source string, keep_id string, n_chars long"


def docs(spark, rows):
    """Documents with further columns, one of which clashes with a result's name."""
    return spark.createDataFrame([(i, t, "s", "clash", len(t or "")) for i, t in rows], SCHEMA)


ROWS = [(5, "a  b\n"), (3, "a b "), (9, "a\tb "), (4, None), (6, ""), (7, "x"), (7, "x"), (None, "y"), (None, "y"), (8, "ä" * 5000)]


def test_exact_dedup(spark):
    got = exact_dedup.exact_dedup(docs(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r["text_sha256"], []).append(r)
    assert {g[0]["group_size"] for g in by.values()} == {3, 2, 1}
    for h, g in by.items():
        assert sum(r["kept"] for r in g) == 1 and len(g) == g[0]["group_size"]
    ab = by[hashlib.sha256(b"a b ").hexdigest()]
    assert {r["keep_id"] for r in ab} == {3} and [r["doc_id"] for r in ab if r["kept"]] == [3]
    assert {r["keep_id"] for r in by[hashlib.sha256(b"").hexdigest()]} == {4}
    assert {r["keep_id"] for r in by[hashlib.sha256(b"y").hexdigest()]} == {None}


def test_exact_dedup_over_several_batches(spark):
    rows = [(i, f"t{i % 7}") for i in range(60)]
    one = exact_dedup.exact_dedup(docs(spark, rows).repartition(5)).collect()
    many = exact_dedup.exact_dedup(docs(spark, rows).repartition(5), files_per_batch=1).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))
    assert {r["keep_id"] for r in many} == set(range(7))


@pytest.fixture
def flagged(monkeypatch):
    """How many texts each byte check found to differ."""
    found, check = [], exact_dedup.differing

    def counting(*a):
        out = check(*a)
        found.append(out.distinct().count())
        return out

    monkeypatch.setattr(exact_dedup, "differing", counting)
    return found


def plain(rows):
    """(doc_id, keep_id, group_size, kept) of rows without nulls or repeats."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    return sorted((i, min(groups[t]), len(groups[t]), i == min(groups[t])) for i, t in rows)


def decided(df):
    return sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect())


def test_smaller_ids_in_later_batches_are_no_collisions(spark, flagged):
    rows = [(99 - i, f"t{i % 7}") for i in range(70)]
    df = docs(spark, rows).repartitionByRange(5, F.col("doc_id").desc())
    assert decided(exact_dedup.exact_dedup(df, files_per_batch=1)) == plain(rows)
    assert decided(exact_dedup.exact_dedup(df, batches=3)) == plain(rows)
    assert flagged == [0, 0]


def test_deliveries_meet_the_state_of_earlier_ones(spark, flagged, tmp_path):
    home = f"file://{tmp_path}/home"
    first, second = [(i, f"t{i % 5}") for i in range(10, 40)], [(i, f"t{i % 7}") for i in range(10)]
    assert decided(exact_dedup.exact_dedup(docs(spark, first), home=home, delivery="a", files_per_batch=1)) == plain(first)
    both = exact_dedup.exact_dedup(docs(spark, second).repartition(3), home=home, delivery="b", files_per_batch=1)
    assert decided(both) == plain(first + second)
    # The same delivery again changes nothing: its rows are there, its stream has no new file.
    assert decided(exact_dedup.exact_dedup(docs(spark, second), home=home, delivery="b")) == plain(first + second)
    assert flagged == [0, 0, 0]


def test_a_stopped_stream_goes_on(spark, flagged, tmp_path, monkeypatch):
    home, rows = f"file://{tmp_path}/home", [(i, f"t{i % 6}") for i in range(60)]
    df = docs(spark, rows).repartition(4)
    made, stateful = [], exact_dedup.keyed_state

    def stops(arrivals):
        out = stateful(arrivals)
        broken = F.when(F.col("n_rows") > 7, F.raise_error("stopped")).otherwise(F.col("n_rows"))
        return out.withColumn("n_rows", broken.cast("long")) if arrivals.isStreaming and not made else out

    monkeypatch.setattr(exact_dedup, "keyed_state", stops)
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")  # a task and so an arrival file for each file
    try:
        with pytest.raises(Exception, match="stopped"):
            exact_dedup.exact_dedup(df, home=home, files_per_batch=1)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    made.append(True)
    done = sum(1 for _ in (tmp_path / "home" / "state").glob("batch=*/_SUCCESS"))
    assert 0 < done < 4
    times = {p: p.stat().st_mtime_ns for p in (tmp_path / "home" / "state" / "batch=0").glob("part*")}
    assert decided(exact_dedup.exact_dedup(df, home=home, files_per_batch=1)) == plain(rows)
    assert times and {p: p.stat().st_mtime_ns for p in (tmp_path / "home" / "state" / "batch=0").glob("part*")} == times  # not done again
    assert flagged == [0]


def test_hits_that_differ_are_seen_in_any_batch(spark, flagged):
    rows = [(20 - i, f"t{i % 3}") for i in range(12)]
    weak = exact_dedup.exact_dedup(docs(spark, rows).repartition(4), digest=lambda t: F.lit("same").cast("string"), files_per_batch=1)
    assert decided(weak) == plain(rows) and flagged == [2]


def test_colliding_digests_are_told_apart_by_bytes(spark):
    rows = [(1, "aa"), (2, "bb"), (3, "aa"), (4, "bb"), (5, "c")]
    weak = exact_dedup.exact_dedup(docs(spark, rows), digest=lambda t: F.lit("same").cast("string"))
    strong = exact_dedup.exact_dedup(docs(spark, rows))
    assert sorted(map(tuple, weak.collect())) == sorted(map(tuple, strong.collect()))


def test_drop_exact_copies_keeps_columns(spark):
    out = exact_dedup.drop_exact_copies(docs(spark, ROWS))
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted((r["doc_id"] or -1, r["text"]) for r in out.collect() if r["text"] is not None) == [(-1, "y"), (3, "a b "), (7, "x"), (8, "ä" * 5000)]
    assert out.where("doc_id = 4").count() == 1


@pytest.mark.parametrize("op", [exact_dedup.exact_dedup, exact_dedup.drop_exact_copies, simhash.simhash_components, simhash.drop_near_copies, substring_dedup.repeated_passages])
def test_empty_tables(spark, op):
    assert op(docs(spark, [])).count() == 0


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", None, "One", "one two three", "A b\tC d\ne f", "é ü ñ ß x", "w " * 40, " ".join(f"w{i}" for i in range(300))])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text)


def test_fingerprint_over_blocks(monkeypatch):
    text = " ".join(f"word{i}" for i in range(500))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "_BLOCK", 64)
    assert simhash.fingerprint(text.encode()) == whole


def brute_components(fps):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if label[j] < label[i] and bin(int(fps[i]) ^ int(fps[j])).count("1") <= 4:
                    label[i], changed = label[j], True
    return label


def test_every_pair_within_reach_shares_a_key():
    code, rng = simhash.Golay(), np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.int64)
    b = a.view(np.uint64).copy()
    for i in range(len(b)):
        for bit in rng.choice(64, i % 5, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    (ra, ka), (rb, kb) = (simhash.fuzzy_keys(x.view(np.int64), code) for x in (a, b))
    shared = {r for r, _ in set(zip(ra.tolist(), ka.tolist())) & set(zip(rb.tolist(), kb.tolist()))}
    assert len(shared) == len(a)


def test_forest_of_a_dense_bucket():
    r = random.Random(5)
    centre = r.getrandbits(63)
    fps = sorted({centre ^ sum(1 << r.randrange(14) for _ in range(1)) ^ (1 << r.randrange(64)) for _ in range(300)} | {r.getrandbits(63) for _ in range(20)})
    f = np.array(fps, np.uint64).view(np.int64)
    got, want = simhash.forest(f, block=16), brute_components(np.array(fps, np.uint64))
    same = lambda labels: {frozenset(np.nonzero(np.array(labels) == v)[0].tolist()) for v in set(labels)}
    assert same(got.tolist()) == same(want)


def test_simhash_components(spark):
    r = random.Random(2)
    base = [" ".join(r.choice("abcdefghij") * 3 + str(r.randrange(50)) for _ in range(120)) for _ in range(12)]
    texts = [(None, base[0]), (99, None), (98, ""), (97, "  ")]
    for k, t in enumerate(base):
        w = t.split()
        texts += [(10 * k, t), (10 * k + 1, t.upper()), (10 * k + 2, " ".join(w[:-1])), (10 * k + 3, " ".join(w[: 60 + k * 4]))]
    texts = [(i, t) for i, t in texts if i is None or t is not None or i == 99]
    got = {(row["doc_id"], row["fingerprint"]): row["component_id"] for row in simhash.simhash_components(docs(spark, texts)).collect()}
    fps = [plain_fingerprint(t) for _, t in texts]
    labels = brute_components(np.array(fps, np.uint64))
    for (i, _), fp, label in zip(texts, fps, labels):
        members = [j for (j, _), other in zip(texts, labels) if other == label and j is not None]
        assert got[i, f"{fp:016x}"] == min(members)
    kept = {row["doc_id"] for row in simhash.drop_near_copies(docs(spark, [t for t in texts if t[0] is not None])).collect()}
    assert kept == {v for (i, _), v in got.items() if i is not None}


def test_near_copies_go_row_by_row(spark):
    r = random.Random(21)
    one, two, three, four = (" ".join(f"w{r.randrange(10_000)}" for _ in range(200)) for _ in range(4))
    rows = [(3, one), (5, one.upper()), (5, two), (None, one), (None, three), (None, four), (None, four), (None, four.upper()), (8, None), (8, ""), (9, " ")]
    kept = simhash.drop_near_copies(docs(spark, rows))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    got = sorted((x["doc_id"] or 0, (x["text"] or "").lower()) for x in kept.collect())
    assert got == sorted([(3, one), (5, two), (0, three), (0, four), (8, "")])


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def words_of(r, n):
    return [f"{r.choice('bcdfgh')}{r.randrange(10_000)}" for _ in range(n)]


def test_repeated_passages(spark):
    r = random.Random(8)
    passage, short = words_of(r, 80), words_of(r, 30)
    fuzzy = passage[:25] + ["changed"] + passage[26:55] + passage[56:]
    rows = [
        (1, words_of(r, 60) + passage + words_of(r, 60)), (2, words_of(r, 20) + passage), (3, fuzzy + words_of(r, 50)), (4, short + words_of(r, 100)), (5, words_of(r, 90) + short), (6, words_of(r, 200)),
        (8, passage), (8, passage), (10, words_of(r, 10) + passage + words_of(r, 100) + passage),
    ]
    rows = [(i, " ".join(w)) for i, w in rows] + [(7, None), (9, "few words"), (None, " ".join(passage))]
    got = substring_dedup.repeated_passages(docs(spark, rows)).collect()
    assert {row["doc_id"] for row in got} == {row["match_id"] for row in got} == {1, 2, 3, 8, 10}
    place = {1: (60, 140), 2: (20, 100), 8: (0, 80), 10: (10, 90)}
    for row in got:
        if row["doc_id"] in place and row["match_id"] in place and 10 not in (row["doc_id"], row["match_id"]):
            assert (row["start"], row["stop"], row["match_start"], row["match_stop"], row["matched"]) == (*place[row["doc_id"]], *place[row["match_id"]], 80)
    three = [row for row in got if row["doc_id"] == 3]
    assert min(row["start"] for row in three) == 0 and 78 <= max(row["stop"] for row in three) <= 80
    # Each side is told, and what a document repeats of itself only if asked for.
    assert {(row["doc_id"], row["match_id"]) for row in got} == {(row["match_id"], row["doc_id"]) for row in got}
    assert (10, 10) in {(row["doc_id"], row["match_id"]) for row in got}
    other = substring_dedup.repeated_passages(docs(spark, rows), within=False).collect()
    assert all(row["doc_id"] != row["match_id"] for row in other) and {row["doc_id"] for row in other} == {1, 2, 3, 8, 10}


def test_parts_in_other_documents_hide_no_passage(spark):
    """Documents 100 and 101 share 80 words; documents with smaller ids hold 14 words of them each."""
    r = random.Random(17)
    passage = words_of(r, 80)
    rows = [(k, " ".join(words_of(r, 50) + passage[7 * k : 7 * k + 14] + words_of(r, 50))) for k in range(10)]
    rows += [(i, " ".join(words_of(r, 70) + passage + words_of(r, 70))) for i in (100, 101)]
    got = substring_dedup.repeated_passages(docs(spark, rows)).collect()
    assert {(x["doc_id"], x["start"], x["stop"]) for x in got} == {(100, 70, 150), (101, 70, 150)}


def windows_found(texts, got, size=60):
    """(documents with repeated windows, those found, windows, those found): brute force over all windows."""
    at = {}
    for i, w in texts.items():
        for k in range(len(w) - size + 1):
            at.setdefault(tuple(w[k : k + size]), set()).add(i)
    spans = {}
    for x in got:
        spans.setdefault(x["doc_id"], []).append((x["start"], x["stop"]))
    counts = [0] * 4
    for i, w in texts.items():
        repeated = [k for k in range(len(w) - size + 1) if len(at[tuple(w[k : k + size])]) > 1]
        inside = [k for k in repeated if any(s - 2 <= k and k + size <= e + 2 for s, e in spans.get(i, []))]
        counts = [c + n for c, n in zip(counts, (bool(repeated), bool(inside), len(repeated), len(inside)))]
    return counts


@pytest.mark.parametrize("many", [60, 240])
def test_recall_of_repeated_passages(spark, many):
    """Planted, nested and partly overlapping passages, frequent ones too: recall does not fall with documents."""
    r = random.Random(many)
    pool = [words_of(r, r.randrange(60, 220)) for _ in range(many // 6)]
    pool += [p[r.randrange(20) : len(p) - r.randrange(20)] for p in pool]  # nested
    pool += [a[-50:] + b[:50] for a, b in zip(pool, pool[1:])]  # overlapping two
    texts = {}
    for i in range(many):
        w = words_of(r, r.randrange(10, 80))
        for _ in range(r.randrange(4)):
            w += pool[r.randrange(len(pool)) if r.random() < 0.7 else 0] + words_of(r, r.randrange(60))
        texts[i] = w
    got = substring_dedup.repeated_passages(docs(spark, [(i, " ".join(w)) for i, w in texts.items()]).repartition(5), within=False).collect()
    documents, found, windows, inside = windows_found(texts, got)
    assert documents > many / 3 and found == documents and inside >= 0.98 * windows
    for x in got:  # what is reported is there
        a, b = texts[x["doc_id"]][x["start"] : x["stop"]], texts[x["match_id"]][x["match_start"] : x["match_stop"]]
        assert len(set(a) & set(b)) >= 0.75 * len(set(a))


def test_one_repeated_word_hides_no_passage(spark):
    r = random.Random(4)
    passage = words_of(r, 70)
    rows = [(1, ["so"] * 400 + passage + ["so"] * 300), (2, ["so"] * 90 + words_of(r, 30) + passage), (3, passage + ["no"] * 100), (4, ["so"] * 3000)]
    got = substring_dedup.repeated_passages(docs(spark, [(i, " ".join(w)) for i, w in rows]), within=False).collect()
    texts = dict(rows)
    documents, found, windows, inside = windows_found(texts, got)
    assert found == documents == 4 and inside >= 0.9 * windows
    assert len(got) < 1000


def links_missed(texts, got, size=50):
    """Pairs of documents that hold the same ``size`` words and are neither linked nor linked to the same words of a third."""
    at, spans = {}, {}
    for i, w in texts.items():
        for k in range(len(w) - size + 1):
            at.setdefault(tuple(w[k : k + size]), {}).setdefault(i, k)
    for x in got:
        spans.setdefault((x["doc_id"], x["match_id"]), []).append((x["start"], x["stop"], x["match_start"], x["match_stop"]))
    missed = set()
    for holders in at.values():
        if len(holders) > 1:
            least = min(holders)
            within = lambda i: any(s <= holders[i] and holders[i] + size <= e and a <= holders[least] and holders[least] + size <= b for s, e, a, b in spans.get((i, least), []))
            missed |= {(least, i) for i in holders if i != least and not within(i)}
    return missed


@pytest.mark.parametrize("partitions", ["1", "4", "40"])
def test_every_link_of_fifty_equal_words_is_told(spark, partitions):
    """49 words of a passage in other documents, and any number of copies, hide no link between two holders of 50."""
    r = random.Random(23)
    passage, frequent = words_of(r, 140), words_of(r, 55)
    texts = {k: words_of(r, 20) + passage[3 * k : 3 * k + 49] + words_of(r, 20) for k in range(30)}
    texts |= {100 + k: words_of(r, 10 + k) + passage[10 * k : 10 * k + 50 + k] + words_of(r, 30) for k in range(9)}
    texts |= {200 + k: words_of(r, 20) + passage + words_of(r, 20) for k in range(2)}
    texts |= {300 + k: words_of(r, r.randrange(30)) + frequent + words_of(r, r.randrange(30)) for k in range(30)}
    texts |= {400: ["so"] * 900 + frequent, 401: ["so"] * 2500, 402: ["so", "no"] * 300 + ["so"] * 70, 403: words_of(r, 30) + ["no", "so"] * 30, 404: ["so"] * 30 + passage[:30], 405: ["so"] * 130 + passage[:20]}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = substring_dedup.repeated_passages(docs(spark, [(i, " ".join(w)) for i, w in texts.items()]), within=False).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert links_missed(texts, got) == set()
    classes = {x["doc_id"]: (x["class_id"], x["class_size"]) for x in got}
    assert all(x["class_id"] == classes[x["match_id"]][0] for x in got) and classes[200] == classes[201]
    for c, n in set(classes.values()):
        members = [i for i, x in classes.items() if x[0] == c]
        assert c == min(members) and n == len(members)
    for x in got:
        a, b = texts[x["doc_id"]][x["start"] : x["stop"]], texts[x["match_id"]][x["match_start"] : x["match_stop"]]
        assert x["similarity"] < 1 or a == b
    assert len({(x["doc_id"], x["start"], x["stop"], x["match_id"], x["match_start"], x["match_stop"]) for x in got}) == len(got) < 2000


def with_changes(r, words, every):
    """``words`` with each ``every``-th one changed."""
    return [f"other{r.randrange(10**6)}" if k % every == every - 1 else w for k, w in enumerate(words)]


@pytest.mark.parametrize("tile", [7, 1024])
def test_parts_in_other_documents_hide_no_changed_passage(spark, monkeypatch, tile):
    """Two holders of a passage, one with changes, and many documents with the words between two changes."""
    r = random.Random(29)
    texts = {}
    for group in range(5):
        passage, base = words_of(r, 120), 1000 * group
        # Three words more in the one make the other end of a shift.
        changed = with_changes(r, passage, 30) if group < 4 else passage[:30] + words_of(r, 3) + passage[30:60] + words_of(r, 2) + passage[60:90]
        texts[base], texts[base + 999] = words_of(r, 40) + passage + words_of(r, 30), words_of(r, 10) + changed + words_of(r, 90)
        for k in range(160):
            begin = 30 * (k % 4)
            texts[base + 1 + k] = words_of(r, r.randrange(40)) + passage[begin : begin + 29] + words_of(r, r.randrange(60))
    monkeypatch.setattr(substring_dedup, "TILE", tile)
    got = substring_dedup.repeated_passages(docs(spark, [(i, " ".join(w)) for i, w in texts.items()]), within=False).collect()
    assert {(x["doc_id"], x["match_id"]) for x in got} == {p for b in range(0, 5000, 1000) for p in ((b, b + 999), (b + 999, b))}
    assert all((x["class_id"], x["class_size"]) == (x["doc_id"] // 1000 * 1000, 2) for x in got)
    for x in got:
        a, b = texts[x["doc_id"]][x["start"] : x["stop"]], texts[x["match_id"]][x["match_start"] : x["match_stop"]]
        assert x["matched"] >= 50 and x["similarity"] >= 0.8 and x["matched"] <= lcs(a, b)


def lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        best = [0, *itertools.accumulate(((best[k] + 1 if x == y else best[k + 1]) for k, y in enumerate(b)), max)]
    return best[-1]


def test_tiles_tell_the_links_of_each_place():
    """Of places of three classes the pairs that grow to a passage, in one bucket and across two."""
    r = np.random.default_rng(31)
    text = r.integers(0, 60_000, (40, 140), dtype=np.uint16)
    text[:, 60:85] = text[0, 60:85]
    for k in range(0, 40, 4):
        text[k, 20:110] = text[0, 20:110]
        text[k, [50, 90 + k // 4]] = 60_000 + k
    text[4, 58:] = np.concatenate(([61_000, 61_001], text[0, 58:138]))
    text[4, :60] = text[0, :60]
    rows = {"pos": [1000 * k + 64 for k in range(40)], "before": [64] * 40, "class_id": [k % 12 for k in range(40)], "doc_id": list(range(40)), "bucket": [k % 2 for k in range(40)], "words": [x[:133].tobytes() for x in text]}
    x = text[:, :133]
    longest = lambda p, q: 5 + sum(substring_dedup.grow(a, b)[2] for a, b in ((x[p, :64][::-1], x[q, :64][::-1]), (x[p, 69:], x[q, 69:])))
    want = {(p, q) for p in range(40) for q in range(p + 1, 40) if p % 12 != q % 12 and longest(p, q) >= 50}
    places = {y for p, q in want for y in ((p, q % 12), (q, p % 12))}
    told = substring_dedup._tile(rows, False)
    assert len(want) > 20 and {(t[0], t[3]) for t in told} <= want
    assert {y for t in told for y in ((t[0], t[3] % 12), (t[3], t[0] % 12))} == places
    mixed = {(t[0], t[3]) for t in substring_dedup._tile({**rows, "bucket": [k // 4 % 2 for k in range(40)]}, True)}
    assert mixed <= {(p, q) for p, q in want if p // 4 % 2 != q // 4 % 2} and mixed


def test_chain_prefers_collinear_matches():
    p, q = [0, 5, 10, 12, 15], [100, 105, 110, 3, 115]
    best = substring_dedup.chain(p, q)[0]
    assert [p[m] for m in best] == [0, 5, 10, 15]


def test_chain_is_the_best_of_all():
    r = random.Random(3)
    cost = substring_dedup.GAP_COST
    for _ in range(40):
        p, q = map(list, zip(*sorted({(r.randrange(60), r.randrange(60)) for _ in range(60)} | {(x, x) for x in range(0, 60, 5) if r.random() < 0.7})))
        score = [0.0] * len(p)
        for i in range(len(p)):
            gains = [score[j] - cost * (p[i] - p[j] + q[i] - q[j]) for j in range(i) if p[j] < p[i] and q[j] < q[i]]
            score[i] = substring_dedup.K + max(0, max(gains, default=0))
        found = substring_dedup.chain(p, q)
        value = lambda c: substring_dedup.K * len(c) - cost * (p[c[-1]] - p[c[0]] + q[c[-1]] - q[c[0]])
        assert max(map(value, found)) > max(score) - 1e-6 or any(b - a > substring_dedup.FARTHEST for a, b in zip(p, p[1:]))
        assert sorted(m for c in found for m in c) == list(range(len(p)))
    far = list(range(0, 90, 5)) + list(range(160, 260, 5))  # a long passage, then another 75 words on
    assert [len(c) for c in substring_dedup.chain(far, [x + 7 for x in far])] == [18, 20]


def test_later_passages_of_one_pair_are_found(spark):
    r = random.Random(12)
    one, two, three = words_of(r, 100), words_of(r, 100), words_of(r, 60)
    rows = [(i, " ".join(words_of(r, 10 * i) + one + words_of(r, 60) + two + words_of(r, 60) + three)) for i in (1, 2)]
    got = sorted((x["start"], x["stop"], x["matched"]) for x in substring_dedup.repeated_passages(docs(spark, rows)).collect() if x["doc_id"] == 2)
    assert got == [(20, 120, 100), (180, 280, 100), (340, 400, 60)]


def test_pieces_cover_a_chain():
    p = list(range(0, 1000, 7))
    parts = substring_dedup._pieces(p, [x + 50 for x in p])
    assert parts[0][0] == 0 and parts[-1][1] == p[-1] + substring_dedup.K
    assert all(a[1] == b[0] and a[3] == b[2] for a, b in zip(parts, parts[1:]))
    assert all(e - s <= substring_dedup.PIECE + substring_dedup.K for s, e, _, _ in parts)
