"""Personal data: patterns, and information-theoretic sanitisation of what reveals them.

The base finds emails, IP addresses, card numbers and phone numbers.  Their values are the protected
entities.  The method then asks of every word of a text with an entity how much of the entity's
information the word discloses, from counts over the whole corpus.  A word (term) is a maximal run of
characters that are alphanumeric but no decimal digits, of any length and script, in lower case:

    IC(c) = -log2 p(c),   PMI(c, t) = log2 ( p(c, t) / (p(c) p(t)) ),   disclosure = PMI / IC

p(c), p(t) and p(c, t) are the shares of different texts that hold entity c, term t, and both.
Disclosure is 1 when the term occurs only with the entity.  A term seen with the entity in at least
``SUPPORT`` different texts, or in as many different contexts (``WINDOW`` words on each side of the
entity) of one text, whose disclosure reaches ``GENERALISE`` is reported (kind ``term``) wherever it
stands in texts that hold both.  Sanitised text shows nothing for it from ``REMOVE`` up.  Below, it shows
something more general: the longest beginning of the term, of ``STEM`` letters, that is itself a term of the corpus
in so many texts that it discloses no such entity, or a placeholder where there is none.

Texts that are equal but for case and white space count once, so copies are no evidence.  One pass reads
the texts, finds entities and counts terms, each task adding up its own; what copies counted too often is taken
off again.  Pairs are counted between classes: entities held by the same texts are one class, terms held by
the same texts with entities another, so a list of thousands of addresses in two texts is one class and not
thousands of times its words.  A term in more than n_c (n / n_c) ^ (1 - GENERALISE) texts cannot reach the
bound, so it is left out before pairs are counted.  Only texts with copies are shuffled, once.

Defined results: null text counts as empty; offsets are code points, ends exclusive; repeated or
null ids give a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, in_batches, key_filter, may_hold, saved, spread

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "term")
WINDOW = 8
SUPPORT, GENERALISE, REMOVE = 2, 0.8, 0.95
#: Least and greatest length of what may be shown for a term.
STEM = (4, 32)
#: Different terms that a task counts before it passes its counts on.
_COUNTED = 100_000

# The email pattern from its sign on, to which the letters before it belong.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# Runs of digits are taken whole: a match can neither start nor end inside one.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_TERM = re.compile(r"[^\W\d_]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The four base kinds, by start and then kind."""
    out: list[Span] = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > last and _LOCAL.match(text[start - 1]):
                start -= 1
            if start < m.start():
                last = m.end()
                out.append(("email", start, last))
    if text.count(".") >= 3:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0]) if m.end() - m.start() >= 14 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.sub("", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def entity(kind: str, value: str) -> str:
    """One name for the ways a value is written."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else _DIGITS.sub('', value)}"


def words_of(text: str, found: list[Span]) -> tuple[list[tuple[str, int, int]], list[bool]]:
    """(term, start, stop) of all words, and whether each touches a span."""
    words = [(m[0].lower(), *m.span()) for m in _TERM.finditer(text)]
    inside, stops = [False] * len(words), [e for _, _, e in words]
    for _, s, e in found:
        k = bisect_right(stops, s)
        while k < len(words) and words[k][1] < e:
            inside[k] = True
            k += 1
    return words, inside


def contexts(text: str, found: list[Span]) -> tuple[list[tuple[str, str, list[str]]], list[str]]:
    """((entity, context digest, its terms) for each base span, the different terms outside the spans)."""
    if not found:
        return [], []
    words, inside = words_of(text, found)
    starts, stops = [s for _, s, _ in words], [e for _, _, e in words]
    out = []
    for kind, start, end in found:
        low, high = bisect_right(stops, start), bisect_left(starts, end)
        near = [words[k][0] for k in (*range(max(0, low - WINDOW), low), *range(high, min(len(words), high + WINDOW))) if not inside[k]]
        out.append((entity(kind, text[start:end]), hashlib.md5(" ".join(near).encode()).hexdigest()[:16], near))
    return out, sorted({w for (w, _, _), skip in zip(words, inside) if not skip})


_CONTEXT = pa.struct([("entity", pa.string()), ("context", pa.string()), ("terms", pa.list_(pa.string()))])
_TOLD = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_terms long"
_SCHEMA = f"{_TOLD}, contexts array<struct<entity:string,context:string,terms:array<string>>>, words array<string>, digest binary, counted string, n_rows long"
_NAMES = [f.split()[0] for f in _TOLD.split(", ")] + ["contexts", "words", "digest", "counted", "n_rows"]
_TOLD_ARROW = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64()]
_ARROW = [*_TOLD_ARROW, pa.list_(_CONTEXT), pa.list_(pa.string()), pa.binary(), pa.string(), pa.int64()]


def terms_of(text: str) -> set[str]:
    """The different terms of a text."""
    return {w.lower() for w in set(_TERM.findall(text))}


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def _digest():
    """One digest for texts that are equal but for case and white space."""
    return F.unhex(F.md5(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), SPACE_RUN, " "))))


def _base_columns(found: list[Span]) -> list:
    said = joined(found)
    return [*(sum(k == kind for k, _, _ in found) for kind in BASE_KINDS), hashlib.sha256(said.encode()).hexdigest(), said, 0]


def _rows(docs: DataFrame) -> DataFrame:
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).withColumn("digest", _digest())


def _scan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One pass over the texts: (rows, counts).  Rows have what the base finds and, where it finds anything, contexts of
    entities and different terms; counts (counted, n_rows) are the rows that hold a term."""

    def run(batches):
        counter = Counter()

        def counts():
            told = [pa.array(list(c), t) for c, t in zip((counter.keys(), counter.values()), (pa.string(), pa.int64()))]
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(counter), t) for t in _ARROW[:-2]), *told], _NAMES)

        for b in batches:
            columns: list[list] = [[] for _ in range(9)]
            for text in b.column(1):
                text = text.as_py() or ""
                counter.update(terms_of(text))
                found = base_spans(text)
                for column, value in zip(columns, (*_base_columns(found), *contexts(text, found))):
                    column.append(value)
                if len(counter) >= _COUNTED:
                    yield counts()
                    counter.clear()
            near = pa.array([[{"entity": e, "context": c, "terms": ts} for e, c, ts in v] for v in columns[7]], _ARROW[8])
            told = [pa.array(c, t) for c, t in zip(columns[:7], _ARROW[1:8])]
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), *told, near, pa.array(columns[8], _ARROW[9]), b.column(2), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], _NAMES)
        if counter:
            yield counts()

    both = saved(in_batches(_rows(docs)).mapInArrow(run, _SCHEMA), "pii-scan")
    return both.where("counted is null").drop("counted", "n_rows"), both.where("counted is not null").select("counted", "n_rows")


def _term_counts(docs: DataFrame, counts: DataFrame, digests: DataFrame) -> DataFrame:
    """(term, n_t): in how many different texts a term stands: the rows that hold it, less the copies of one text beyond
    the first (``digests``: digest, copies)."""

    def run(batches):
        counter = Counter()
        for b in batches:
            for text, copies in zip(b.column(0), b.column(1).to_pylist()):
                for term in terms_of(text.as_py()):
                    counter[term] -= copies - 1
                if len(counter) >= _COUNTED:
                    yield pa.RecordBatch.from_pydict({"counted": list(counter.keys()), "n_rows": list(counter.values())})
                    counter.clear()
        if counter:
            yield pa.RecordBatch.from_pydict({"counted": list(counter.keys()), "n_rows": list(counter.values())})

    repeated = saved(digests.where("copies > 1"), "pii-copies")
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), _digest().alias("digest"))
    texts = may_hold(texts, "digest", key_filter(repeated, "digest", "pii-filter")).where("maybe").dropDuplicates(["digest"])
    often = in_batches(texts.join(repeated, "digest").select("text", "copies")).mapInArrow(run, "counted string, n_rows long")
    return saved(counts.unionByName(often).groupBy(F.col("counted").alias("term")).agg(F.sum("n_rows").alias("n_t")), "pii-words")


def _classes(held: DataFrame, column: str) -> DataFrame:
    """``column``'s values with how many of the texts hold them and a name for that set of texts: the sums of four
    32-bit hashes of its digests, so that values held by the same texts share it."""
    h = [F.xxhash64(F.lit(k), "digest") for k in (1, 2)]
    sums = [F.sum(x) for y in h for x in (y.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(y, 32))]
    return held.groupBy(column).agg(F.count(F.lit(1)).alias("n_held"), F.concat_ws(".", F.count(F.lit(1)), *sums).alias("texts"))


def disclosure(docs: DataFrame, scan: DataFrame, counts: DataFrame) -> DataFrame:
    """(digest, term, disclosure, general) of the terms of each text that disclose an entity it holds; ``general`` is
    the more general term that may stand for it, if any."""
    digests = saved(scan.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")), "pii-digests")
    n = F.lit(float(digests.count()))
    counts = _term_counts(docs, counts, digests)
    share = 1 - F.log2(F.greatest(F.col("n_t") / F.col("n_ct"), F.lit(1.0))) / F.nullif(F.log2(n / F.col("n_c")), F.lit(0.0))
    # One row for each different text with entities: its terms travel as one list.
    held = scan.where(F.size("contexts") > 0).select("digest", "contexts", "words")
    entities = held.select("digest", F.explode(F.array_distinct("contexts.entity")).alias("entity")).distinct()
    sizes = saved(_classes(entities, "entity").select("entity", F.col("n_held").alias("n_c"), F.col("texts").alias("holders")), "pii-entities")
    # The most texts a term may stand in: disclosure is 1 - log(n_t / n_ct) / log(n / n_c), and n_ct <= n_c.
    reach = F.col("n_c") * F.pow(n / F.col("n_c"), F.lit(1 - GENERALISE)) * (1 + 1e-9)
    several = entities.join(sizes.where(F.col("n_c") >= SUPPORT), "entity").select("digest", "holders", "n_c", reach.alias("reach")).distinct()
    several = saved(several, "pii-held")
    furthest = several.groupBy("digest").agg(F.max("reach").alias("furthest"))
    shared = counts.where(F.col("n_t") >= SUPPORT)
    # Texts that are equal but for white space may differ in what the base finds in them: their terms add up.
    lists = held.join(furthest, "digest").groupBy("digest", "furthest").agg(F.array_distinct(F.flatten(F.collect_set("words"))).alias("words"))
    terms = may_hold(lists.select("digest", "furthest", F.explode("words").alias("term")), "term", key_filter(shared.select("term"), "term", "pii-shared")).where("maybe")
    terms = saved(terms.join(shared, "term").where("n_t <= furthest").select("digest", "term", "n_t"), "pii-held-terms")
    kinds = _classes(terms, "term").where(F.col("n_held") >= SUPPORT)
    terms = saved(terms.join(kinds, "term").select("digest", "term", F.concat_ws(".", "n_t", "texts").alias("word"), "n_t"), "pii-term-classes")
    words = terms.select("digest", "word", "n_t").distinct()
    together = saved(words.join(several, "digest").where("n_t <= reach").select("digest", "holders", "word", "n_c", "n_t"), "pii-together")
    pairs = together.groupBy("holders", "word").agg(F.count(F.lit(1)).alias("n_ct"), F.first("n_c").alias("n_c"), F.first("n_t").alias("n_t")).where(F.col("n_ct") >= SUPPORT)
    pairs = pairs.select("holders", "word", "n_c", share.alias("disclosure")).where(F.col("disclosure") >= GENERALISE)
    told = together.select("digest", "holders", "word").join(pairs, ["holders", "word"]).groupBy("digest", "word").agg(F.max("disclosure").alias("disclosure"), F.max("n_c").alias("n_c"))
    told = terms.join(told, ["digest", "word"]).select("digest", "term", "disclosure", "n_c")
    # Different contexts in one text: the term and the entity meet in that text, so n_ct is 1 there.
    near = held.select("digest", F.explode("contexts").alias("c")).select("digest", "c.entity", "c.context", F.explode("c.terms").alias("term"))
    near = near.groupBy("entity", "term").agg(F.min("digest").alias("digest"), F.max("digest").alias("last"), F.min("context").alias("a"), F.max("context").alias("b"))
    near = near.where("digest = last and a <> b").select("digest", "entity", "term", F.lit(1).alias("n_ct")).join(sizes, "entity").join(counts, "term")
    near = near.select("digest", "term", share.alias("disclosure"), "n_c").where(F.col("disclosure") >= GENERALISE)
    telling = saved(told.unionByName(near).groupBy("digest", "term").agg(F.max("disclosure").alias("disclosure"), F.max("n_c").alias("n_c")), "pii-telling")
    # A shorter term in n_t texts discloses at most log(n / n_t) / log(n / n_c) of an entity in n_c; most for the largest n_c.
    shorter = F.explode(F.transform(F.sequence(F.lit(STEM[0]), F.least(F.lit(STEM[1]), F.length("term") - 1)), lambda k: F.substring(F.col("term"), F.lit(1), k)))
    wider = telling.where(F.length("term") > STEM[0]).groupBy("term").agg(F.max("n_c").alias("n_c")).select("term", "n_c", shorter.alias("general"))
    wider = wider.join(counts.select(F.col("term").alias("general"), "n_t"), "general").where((F.col("n_t") >= F.col("n_c")) & (F.log2(n / F.col("n_t")) < GENERALISE * F.log2(n / F.col("n_c"))))
    wider = wider.groupBy("term").agg(F.max_by("general", F.length("general")).alias("general"))
    return saved(telling.drop("n_c").join(wider, "term", "left"), "pii-terms")


def _telling(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the scan, telling): ``telling`` has for each text that holds a telling term (digest) the list of them
    with what stands for each: nothing, a more general term, or null for the placeholder."""
    scan, counts = _scan(docs)
    shown = F.when(F.col("disclosure") >= REMOVE, F.lit("")).otherwise(F.col("general"))
    found = disclosure(docs, scan, counts).groupBy("digest").agg(F.collect_list(F.struct("term", shown.alias("shown"))).alias("telling"))
    return scan, saved(found, "pii-lists")


def _all_spans(text: str, telling: dict) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans by start and kind) of a text with its telling terms."""
    found = base_spans(text)
    if not found or not telling:
        return found, found
    words, inside = words_of(text, found)
    terms = [("term", s, e) for (w, s, e), skip in zip(words, inside) if not skip and w in telling]
    return found, sorted(found + terms, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def pii_spans(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms."""
    scan, telling = _telling(docs)
    told = [f.split()[0] for f in _TOLD.split(", ")]

    def run(batches):
        for b in batches:
            columns: list[list] = [b.column(0).to_pylist(), *([] for _ in told[1:])]
            for text, terms in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                found, every = _all_spans(text or "", {t["term"] for t in terms})
                for column, value in zip(columns[1:], (*_base_columns(found)[:-2], joined(every), len(every) - len(found))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TOLD_ARROW)], told)

    # Few texts hold a telling term: they alone are read again, the rows of all others stand as the scan wrote them.
    known = key_filter(telling, "digest", "pii-filter")
    scan = may_hold(scan.select(*told, "digest"), "digest", known)
    plain = scan.where("not maybe").select(*told).unionByName(scan.where("maybe").join(telling.select("digest"), "digest", "left_anti").select(*told))
    again = may_hold(_rows(docs), "digest", known).where("maybe").join(telling, "digest").select("doc_id", "text", "telling")
    return plain.unionByName(in_batches(again).mapInArrow(run, _TOLD))


def sanitised(text: str, found: list[Span], instead: dict[int, str]) -> str:
    """The text with base spans and terms replaced; the longest of overlapping spans counts.

    ``instead`` has what a term that starts at a place shows, where that is not the placeholder of its kind.
    """
    out, at = [], 0
    for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], instead[s] if kind == "term" and s in instead else f"[{kind.upper()}]"]
            at = e
        elif e > at:
            at = e
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the sanitised texts."""
    _, telling = _telling(docs)

    def run(batches):
        for b in batches:
            texts = []
            for text, terms in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                shown = {t["term"]: t["shown"] for t in terms or ()}
                if text is not None:
                    _, every = _all_spans(text, shown)
                    instead = {s: shown[w] for k, s, e in every if k == "term" and shown[w := text[s:e].lower()] is not None}
                    text = sanitised(text, every, instead)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = may_hold(_rows(docs), "digest", key_filter(telling, "digest", "pii-filter"))
    none = F.lit(None).cast(telling.schema["telling"].dataType)
    plain = rows.where("not maybe").select("doc_id", "text", none.alias("telling"))
    return in_batches(plain.unionByName(rows.where("maybe").join(telling, "digest", "left").select("doc_id", "text", "telling"))).mapInArrow(run, "doc_id long, text string")
