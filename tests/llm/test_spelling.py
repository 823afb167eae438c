"""Spelling variants against brute force: machines over small alphabets, and whole queries over made texts."""

import random
import re
import zlib
from collections import Counter

import pytest

from screenlake.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_composition_finds_each_pair_once():
    r = random.Random(1)
    for _ in range(500):
        words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(6))) for _ in range(r.randrange(1, 40))})
        machine = spelling.Acceptor(iter(words))
        assert sorted(machine.words(machine.start)) == words
        found = Counter(frozenset(p) for p in spelling.one_edit_pairs(machine))
        assert found == Counter(frozenset((a, b)) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b))


def test_acceptor_is_minimal():
    """All words over two letters of one length need one state per remaining length."""
    words = sorted(f"{i:010b}" for i in range(1024))
    assert len(spelling.Acceptor(iter(words)).arcs) == 11


def test_long_words_are_halved():
    r = random.Random(2)
    for size in (63, 64, 65, 200, 1000):
        base = ["".join(r.choice("ab") for _ in range(size)) for _ in range(3)]
        words = set(base)
        for w in base * 4:
            i, c = r.randrange(size), r.choice("abc")
            words |= {w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], c + w, w + c}
        words = sorted(words)
        found = Counter(frozenset(p) for p in spelling.near_rests(words))
        assert found == Counter(frozenset((a, b)) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b))


def brute(rows, length=6, count=5, ratio=5, slip=199):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= length and k >= count}
    out, form = {}, {}
    for w in n:
        others = [x for x in n if x != w and near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = len(others)
    rows = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None))
    return sorted(rows, key=repr)


SCHEMA = "doc_id long, text string, word string, n long"


def told(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in spelling.spelling_variants(df, **kw).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


@pytest.mark.parametrize("alphabet", ["ab", "abÀé", "aBc×"])
def test_query_equals_brute_force(spark, alphabet):
    r = random.Random(3)
    words = ["".join(r.choice(alphabet) for _ in range(r.randrange(4, 10))) for _ in range(150)]
    rows = [(i if i % 9 else None, r.choice([" ", ", ", "1", "_", "\n"]).join(r.choices(words, [1 / (k + 1) for k in range(150)], k=120))) for i in range(40)]
    rows += [(1, None), (2, ""), rows[3], rows[3]]
    for slip in (199, 3):
        got = told(spark, rows, slip=slip)
        assert got == brute(rows, slip=slip) and len(got) > 50


def test_chains_and_ties(spark):
    """abcdef <- abcdeg <- abcdgg is a chain of forms; equal counts go by code points; one letter may be repeated."""
    counts = {"abcdef": 500, "abcdeg": 100, "abcdgg": 20, "zzzzzz": 25, "zzzzzzz": 5, "mmmmmx": 30, "mmmmmy": 30, "mmmmmm": 6, "alonealone": 9, "short": 99}
    rows = [(None, " ".join([w] * n)) for w, n in counts.items()]
    got = told(spark, rows, slip=None)
    assert got == brute(rows, slip=1 << 40)
    by = {r[0]: r for r in got}
    assert by["abcdgg"][2] == "abcdef" and by["mmmmmm"][1] == "mmmmmx" and by["zzzzzzz"][1] == "zzzzzz" and by["alonealone"][4] == 0 and "short" not in by


def test_long_chain_and_long_word(spark):
    word = "x" * 300_000
    rows = [(1, " ".join([word] * 5 + [word[:-1] + "y"] * 25)), (2, " ".join(w for k in range(4) for w in ["a" * (9 - k)] * 5 ** (k + 1)))]
    got = told(spark, rows, slip=None)
    assert {r[0]: r[2] for r in got} == {word: word[:-1] + "y", word[:-1] + "y": word[:-1] + "y", **{"a" * k: "a" * 6 for k in range(6, 10)}}


def test_empty(spark):
    assert told(spark, []) == [] and told(spark, [(1, None), (2, "x y z")]) == []
