"""The terms of ``pii`` against the docstring's formula in plain Python."""

import math
import random
import re
from collections import defaultdict

from screenlake.llm import pii

WORD = re.compile(r"[^\W\d_]+")


def brute(texts):
    """Per text the terms' spans: texts that hold an entity and a term which discloses it."""
    key = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t.lower()).strip(" ")
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[key(t)].append(i)
    n = len(groups)
    ents, terms, n_t = {}, {}, defaultdict(set)
    contexts = defaultdict(set)
    for g, members in groups.items():
        ents[g], terms[g] = set(), set()
        for i in members:
            t = texts[i]
            found = pii.base_spans(t)
            words = [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(t)]
            outside = [w for w in words if not any(w[1] < e and s < w[2] for _, s, e in found)]
            for w, _, _ in words:
                n_t[w].add(g)
            if found:
                terms[g] |= {w for w, _, _ in outside}
            for kind, s, e in found:
                name = pii.entity(kind, t[s:e])
                ents[g].add(name)
                before, after = [w for w in words if w[2] <= s][-pii.WINDOW :], [w for w in words if w[1] >= e][: pii.WINDOW]
                near = [w[0] for w in before + after if w in outside]
                for w in near:
                    contexts[name, w].add((g, " ".join(near)))
    holders = defaultdict(set)
    for g, es in ents.items():
        for e in es:
            holders[e].add(g)
    out = []
    for i, t in enumerate(texts):
        g = key(t)
        telling = set()
        for c in ents[g]:
            for w in terms[g]:
                both = sum(1 for h in holders[c] if w in terms[h])
                seen = contexts[c, w]
                if both < 2 and not (len({h for h, _ in seen}) == 1 and len(seen) > 1):
                    continue
                information = math.log2(n / len(holders[c]))
                if information and math.log2(both * n / (len(holders[c]) * len(n_t[w]))) / information >= pii.GENERALISE - 1e-12:
                    telling.add(w)
        found = pii.base_spans(t)  # a copy whose line breaks hide the entity shows nothing of it
        out.append([] if not found else [(m.start(), m.end()) for m in WORD.finditer(t) if m[0].lower() in telling and not any(m.start() < e and s < m.end() for _, s, e in found)])
    return out


def told(spark, texts):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, term string, counted int").repartition(3)
    got = {r["doc_id"]: r["spans"] for r in pii.pii_spans(df).collect()}
    return [[(int(s), int(e)) for k, s, e in (x.split(":") for x in (got[i] or "").split(",") if x) if k == "term"] for i in range(len(texts))]


FILLER = [f"Plain words number {i} about nothing much: {' '.join(chr(97 + (i * k) % 26) * 3 for k in range(1, 9))}." for i in range(60)]


def test_short_names_and_other_scripts(spark):
    texts = [*FILLER]
    texts += [f"Kim from İstanbul, Zanzibar: kim.x@a.example today {w}" for w in ("one", "two", "three")]
    texts += [f"李明 +44 20 7946 0958 {w}, area² Ǆ" for w in ("four", "five")]
    texts += [texts[-1], texts[-1].upper().lower(), "  " + texts[-1].replace(" ", "\n")]
    want = brute(texts)
    got = told(spark, texts)
    assert got == want
    words = lambda i: {texts[i][s:e] for s, e in got[i]}
    assert {"Kim", "İstanbul", "Zanzibar"} <= words(60) and "李明" in words(63) and "area²" in words(63)


def test_equals_the_formula(spark):
    r = random.Random(7)
    people = [f"p{i}@mail.example" for i in range(8)]
    names = ["Al", "Béa", "Chloé", "Dan", "Эрик", "花子", "Gus", "Hy"]
    texts = [*FILLER[:30]]
    for _ in range(150):
        k = r.sample(range(8), r.choice([1, 1, 2]))
        said = [r.choice([f"{names[i]} wrote {people[i]}", f"{people[i]} ({names[i]})", f"{names[i] if r.random() < 0.8 else r.choice(names)} to {people[i]}"]) for i in k]
        texts.append(f"{r.choice(['Dear', 'Hello', 'On', 'By'])} {' and '.join(said)} {''.join(r.choice('abc') for _ in range(2))} 10.0.0.{r.randrange(3)}")
    texts += texts[40:45] + [None and "", ""]
    texts = [t or "" for t in texts]
    want = brute(texts)
    assert told(spark, texts) == want and sum(map(bool, want)) > 20


def test_a_long_list_is_one_class(spark):
    """Three hundred addresses and as many words in two texts: 90,000 pairs, of one class each."""
    names = ["".join(chr(97 + (i // 26**k) % 26) for k in range(3)) + "q" for i in range(300)]
    entries = [f"{n} {n}@list.example" for n in names]
    texts = [*FILLER, " ".join(entries) + " v one", " ".join(entries[::-1]) + " v two"]
    got = told(spark, texts)
    assert {texts[60][s:e] for s, e in got[60]} >= set(names) and not any(got[:60])
