"""Spelling variants by composing finite-state machines: vocabulary, one edit, vocabulary again.

The vocabulary is the words of the corpus with their counts.  Two words are near if exactly one code
point is put in, left out or replaced.  One edit leaves the first or the last half of the shorter word
whole, so the composed machine falls apart into independent parts by the state that its initial walk
ends in: words with the same first half are the part below one state of the acceptor, words with the
same last half the part below one state of the acceptor of the reversed words.  A word belongs to at
most two parts of either kind (as the shorter or the longer of a pair), so the vocabulary is shuffled
four times as narrow rows and no task holds more than the part at hand.

In a part the rests of the words make a minimal acceptor, built in sorted order.  The composition walks
pairs of its states: both words together while no edit has been made; then every single edit (two
different arcs, or one arc on one side only); then both together again.  Pairs of states that accept no
common rest are remembered and not entered again; equal states accept everything in common, which is
what minimising is for.  A pair whose first halves differ comes from the reversed part, so each pair is
found once.

A part is bounded by the alphabet, not by the corpus: its words differ only in the other half, and
repeated words are counted before anything is grouped.

Defined results: null and empty texts hold no words; a null doc_id counts as the empty string in the
spelling hash; repeated rows count again; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, saved

#: Words have at least LEAST_LENGTH code points and LEAST_COUNT occurrences; a word's form is RATIO times as frequent.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: One in SLIP distinct (document, word) pairs loses a code point: the slips that the operator is to find again.
SLIP = 199


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slip: int | None = SLIP) -> DataFrame:
    """Words of all whole texts of ``docs`` (doc_id, text) with their occurrences: word, n.

    Words are maximal runs of letters, A-Z lower-cased; with ``slip`` every run whose hash with its document
    is divisible by it has lost one code point.  Slips only shorten, so shorter runs never matter."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"[A-Za-zÀ-ÿ]{{{least_length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.col("text").cast("string").alias("text")).select("doc", F.explode(runs).alias("run"))
    # Plain ASCII has a fast way; elsewhere only A-Z may change.
    ascii_only = F.octet_length("run") == F.char_length("run")
    rows = rows.withColumn("run", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", upper, lower)))
    if slip:
        h = F.crc32(F.concat_ws(":", "doc", "run"))
        at = (h % F.char_length("run")).cast("int")
        shorter = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
        rows = rows.withColumn("run", F.when(h % slip == 0, shorter).otherwise(F.col("run")))
    counts = rows.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.char_length("word") >= least_length) & (F.col("n") >= least_count))


class Acceptor:
    """A minimal deterministic acceptor of words given in sorted order.

    A state is a number: ``arcs`` maps a code point to the next state, ``final`` says whether it accepts.  States
    with the same arcs and the same finality are one."""

    def __init__(self, words: Iterator[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}
        # The unfinished path of the last word: (arcs, accepts) of each of its prefixes.
        path: list[tuple[dict[str, int], bool]] = [({}, False)]
        last = ""

        def fold(depth: int) -> None:
            while len(path) > depth + 1:
                arcs, final = path.pop()
                key = (final, *arcs.items())
                state = known.get(key)
                if state is None:
                    state = known[key] = len(self.arcs)
                    self.arcs.append(arcs)
                    self.final.append(final)
                path[-1][0][last[len(path) - 1]] = state

        for word in words:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            fold(same)
            path += [({}, False) for _ in word[same:]]
            path[-1] = (path[-1][0], True)
            last = word
        fold(0)
        self.start = len(self.arcs)
        self.arcs.append(path[0][0])
        self.final.append(path[0][1])

    def words(self, state: int) -> Iterator[str]:
        if self.final[state]:
            yield ""
        for a, after in self.arcs[state].items():
            for rest in self.words(after):
                yield a + rest


def one_edit_pairs(machine: Acceptor) -> Iterator[tuple[str, str]]:
    """Pairs of accepted words that one edit takes from the first to the second: the composition of the acceptor, the
    transducer of one edit and the acceptor.  A replacement is given in one direction, the longer word always second.

    Where an edit can be placed at several points (a repeated code point put in) the first difference decides."""
    arcs, final = machine.arcs, machine.final
    common: dict[tuple[int, int], list[str]] = {}

    def shared(p: int, q: int) -> list[str]:
        """Rests that both states accept."""
        key = (p, q) if p <= q else (q, p)
        found = common.get(key)
        if found is None:
            if p == q:
                found = list(machine.words(p))
            else:
                found = [""] if final[p] and final[q] else []
                small, large = (arcs[p], arcs[q]) if len(arcs[p]) <= len(arcs[q]) else (arcs[q], arcs[p])
                for a, after in small.items():
                    if a in large:
                        found += [a + rest for rest in shared(after, large[a])]
            common[key] = found
        return found

    stack = [(machine.start, "")]
    while stack:
        state, prefix = stack.pop()
        out = list(arcs[state].items())
        for k, (a, after) in enumerate(out):
            stack.append((after, prefix + a))
            for b, other in out[k + 1 :]:
                for rest in shared(after, other):
                    yield f"{prefix}{a}{rest}", f"{prefix}{b}{rest}"
            # a is read on the longer side only: what follows it there must equal what follows here.
            for rest in shared(after, state):
                if not rest.startswith(a):
                    yield prefix + rest, f"{prefix}{a}{rest}"


#: Longest rests that make one machine.
_DEEP = 64


def near_rests(rests: list[str]) -> Iterator[tuple[str, str]]:
    """``one_edit_pairs`` of distinct words whose lengths differ by one at most, each pair once.

    Long ones are cut in halves again, as whole words were: what shares a half is a part of its own."""
    if len(rests) < 2:
        return
    least = min(map(len, rests))
    if least < _DEEP:
        yield from one_edit_pairs(Acceptor(iter(sorted(rests))))
        return
    half = least // 2
    front, back = defaultdict(list), defaultdict(list)
    for rest in rests:
        front[rest[:half]].append(rest[half:])
        back[rest[half - least :]].append(rest[: half - least])
    for kept, ends in front.items():
        yield from ((kept + a, kept + b) for a, b in near_rests(ends))
    for kept, starts in back.items():
        yield from ((a + kept, b + kept) for a, b in near_rests(starts) if (a + kept)[:half] != (b + kept)[:half])


def parts(words: DataFrame) -> DataFrame:
    """``words`` (word, n) dealt to the parts of the composed machine: part, reversed, rest, word, n.

    The length of a pair's shorter word sets where both are cut; a word enters as one of its own length and as the
    longer of a pair."""
    rows = words.withColumn("shorter", F.explode(F.array(F.char_length("word"), F.char_length("word") - 1)))
    half = F.floor(F.col("shorter") / 2).cast("int")
    rows = rows.withColumns({"half": half, "back": F.explode(F.array(F.lit(False), F.lit(True)))})
    letters = F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))
    kept = F.when(F.col("back"), F.col("shorter") - F.col("half")).otherwise(F.col("half"))
    return rows.select(
        F.concat_ws(" ", "shorter", F.substring(letters, F.lit(1), kept)).alias("part"), F.col("back").alias("reversed"),
        F.substring(letters, kept + 1, F.char_length("word")).alias("rest"), "word", "n", "half", (F.char_length("word") > F.col("shorter")).alias("longer"),
    )


_NEAR = "word string, near string, near_n long"


def near_words(words: DataFrame) -> DataFrame:
    """All ordered pairs of near words of ``words`` (word, n): word, near, near_n (of the near word)."""

    def pairs(members: list[tuple[str, str, int, int, bool]], back: bool) -> Iterator[tuple[str, str, int]]:
        by_rest = {rest: (word, n, half, longer) for rest, word, n, half, longer in members}
        for a, b in near_rests(list(by_rest)):
            (one, one_n, half, one_longer), (two, two_n, _, two_longer) = by_rest[a], by_rest[b]
            # Two longer words are met again in the part of their own length, and reversed parts tell only pairs
            # whose first halves differ.
            if one_longer and two_longer or back and one[:half] == two[:half]:
                continue
            yield one, two, two_n
            yield two, one, one_n

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], ["word", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, out = None, [], []
        for b in batches:
            for part, back, *member in zip(*(c.to_pylist() for c in b.columns)):
                if (part, back) != now:
                    if len(members) > 1:
                        out += pairs(members, now[1])
                    now, members = (part, back), []
                    if len(out) > 20_000:
                        yield batch(out)
                        out = []
                members.append(member)
        if len(members) > 1:
            out += pairs(members, now[1])
        if out:
            yield batch(out)

    dealt = parts(words).repartition("part", "reversed").sortWithinPartitions("part", "reversed")
    return in_batches(dealt).select("part", "reversed", "rest", "word", "n", "half", "longer").mapInArrow(run, _NEAR)


def variant_forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``words`` (word, n) with form, root, n_near and form_n.

    A word's form is its most frequent near word (ties: the first in code-point order) if that is ``ratio`` times
    as frequent; its root ends the chain of forms.  Counts rise ``ratio``-fold along a chain, so doubling the
    links ends after a few rounds whatever the vocabulary."""
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("near")))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    rows = words.join(near, "word", "left").withColumn("chosen", F.coalesce(-F.col("best.order") >= ratio * F.col("n"), F.lit(False)))
    rows = saved(
        rows.select("word", F.when(F.col("chosen"), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("chosen"), -F.col("best.order")).alias("form_n")),
        "spelling-forms",
    )
    links = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        # Twice as far each round: where the end of a link has a link itself, take that one's end.
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = saved(links.join(on, "root", "left"), "spelling-links")
        links = further.select("word", F.coalesce("further", "root").alias("root"))
        if further.where("further is not null").isEmpty():
            break
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, slip: int | None = SLIP) -> DataFrame:
    """Words of ``docs`` (doc_id, text) grouped by spelling: word, form, root, n, n_near, form_n."""
    return variant_forms(saved(vocabulary(docs, least_length, least_count, slip), "spelling-words"), ratio)
