"""Best-fit packing by exact-complement hashing.

Documents are encoded with a public tokenizer and one end id each; pieces longer than a sequence
are cut.  Packing works on the *counts of lengths*, at most ``capacity`` numbers whatever the
input: the plan is a list of patterns (lengths that share a sequence, how many sequences).

Method.  The gap a length leaves is looked up in an index of the single, pair and triple sums of the
lengths still available (``SumIndex``); a combination that fills the gap exactly is consumed as often as
the counts allow, and the index follows.  What has no exact complement is packed best fit, largest first,
again many equal sequences at a time.

The pieces then take their places by rank within their length.  Ranks come from counts per
(length, salt) and a row number inside each salted group, so a length that a third of all rows
share is spread over many groups.

Defined results: null text counts as empty (one piece that holds the end id); an empty table gives
no rows; rows that repeat an id or have none are packed each, under the id they have; pieces of one
length take their places in the order in which they were written; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, saved, spread, to_shuffle_width

CAPACITY = 4096
END_ID = 1

#: Texts made of these need no normalisation but lower case, and the pattern below cuts them as the
#: tokenizer does: ASCII and the Latin-1 letters with precomposed accents.
_PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
_CACHED = 174_000  # entries of a generation of the table: some 25 MB; one more doubles what its dict allocates
#: What the library must say as the tables do before they are used with a vocabulary.
_PROBES = ("It's WE'LL don't 'S", "naïve Über-cool x_1 23.5%", "(a)b [c] #d !? ...--", "ÀÉÎÕÜ ßþÿ", "e-mail: a.b@c.de")


def _byte_letters() -> dict[int, int]:
    """Byte -> the letter that byte-level vocabularies write for it."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class WordEncoder:
    """Ids of whole texts as the tokenizers library gives them.

    Where the vocabulary drops white space and cuts words by the rules above, a text's ids are those of
    its words in a row.  A batch of texts is cut, and its different words are told apart, by Arrow; each
    of those is looked up once or encoded by the library, and the ids are laid out by numpy.  One table holds
    words and the parts they are cut into (a part is a word that is cut into itself); it is bounded and has two
    generations, so frequent words outlive rare ones.  Words with other characters, texts with the strings of
    added tokens, and all texts under a vocabulary with other rules (which probes tell) go whole to the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.by_word = all(b"".join(map(self._word, p.split())) == self._whole(p) for p in _PROBES)

    def _whole(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is not None:
            return found
        found = self.old_words.get(word)
        if found is None:
            if word.isascii() and word.isalpha():
                low = word.lower()
                found = self._part(word) if low == word else self._word(low)
            elif _PLAIN.fullmatch(word):
                parts = _CUT.findall(word.lower())
                found = self._part(word) if parts == [word] else b"".join(map(self._word, parts))
            else:
                found = self._whole(word)
        if len(word) <= 64:
            if len(self.words) >= _CACHED:
                self.old_words, self.words = self.words, {}
            self.words[word] = found
        return found

    def encode(self, texts: pa.Array) -> list[memoryview]:
        """Unsigned 32-bit ids of each text (null: none), in the machine's (little-endian) order."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            return [memoryview(self._whole(t.as_py())) for t in texts]
        # At ASCII's white space only: a word that holds other white space goes to the library.
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        found = list(map(self._word, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
        # A text has no more ids than bytes once normalised (NFC, lower case), and that makes them less than eight times as many.
        kind = np.int32 if texts.nbytes < 1 << 28 else np.int64
        sizes, at = np.fromiter(map(len, found), kind, len(found)) // 4, coded.indices.to_numpy()
        counts = sizes[at]
        ends = np.zeros(len(at) + 1, kind)
        np.cumsum(counts, out=ends[1:])
        places = np.repeat((np.cumsum(sizes, dtype=kind) - sizes)[at] - ends[:-1], counts)
        places += np.arange(ends[-1], dtype=kind)
        ids = memoryview(np.frombuffer(b"".join(found), np.uint32)[places].view(np.uint8))
        bounds = (4 * ends[words.offsets.to_numpy()].astype(np.int64)).tolist()
        out = [ids[a:b] for a, b in pairwise(bounds)]
        for string in self.added:
            for k in np.flatnonzero(pc.match_substring(texts, string).to_numpy(zero_copy_only=False)).tolist():
                out[k] = memoryview(self._whole(texts[k].as_py()))
        return out

    def ids(self, text: str) -> bytes:
        return bytes(self.encode(pa.array([text], pa.string()))[0])


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    """One for all tasks of a worker, so that its tables stay filled."""
    return WordEncoder(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces: doc_id, piece, start, length, ids_crc32."""
    assert sys.byteorder == "little"

    def run(batches):
        encoder = _encoder(tokenizer)
        end = array("I", [END_ID]).tobytes()
        for batch in batches:
            out = [[] for _ in range(5)]
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                n = len(ids) // 4 + 1
                for k, start in enumerate(range(0, n, capacity)):
                    stop = min(n, start + capacity)
                    crc = zlib.crc32(ids[4 * start : 4 * stop])
                    for column, value in zip(out, (doc, k, start, stop - start, zlib.crc32(end, crc) if stop == n else crc)):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return in_batches(spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


Pattern = tuple[tuple[int, ...], int]  # the lengths of a sequence, the number of such sequences


class SumIndex:
    """Which single, pair and triple sums the lengths still available have, as arrays over sums.

    ``pairs[s]`` counts the ordered pairs of available lengths that sum to s; a triple of sum s is a single beside a
    pair of the rest, so its index is read off both.  A length that is used up leaves with one shift per array.
    Lengths that a combination repeats are told apart by the exact counts."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for n, c in counts.items():
            self.left[n] = c
        self.single = (self.left > 0).astype(np.int64)
        size = 2 * capacity + 1
        spectrum = np.fft.rfft(self.single, 2 * size)
        self.pairs = np.rint(np.fft.irfft(spectrum * spectrum, 2 * size)).astype(np.int64)[: capacity + 1]

    def fits(self, combination: tuple[int, ...]) -> int:
        """How many such combinations the counts allow."""
        return min(int(self.left[n]) // k for n, k in Counter(combination).items())

    def use(self, combination: tuple[int, ...], times: int) -> None:
        for n in combination:
            self.left[n] -= times
        for n in set(combination):
            if not self.left[n]:
                # Pairs (n, m) and (m, n) go, (n, n) once.
                self.pairs[n:] -= 2 * self.single[: self.capacity + 1 - n]
                if 2 * n <= self.capacity:
                    self.pairs[2 * n] += 1
                self.single[n] = 0

    def _by_middle(self, places: np.ndarray, share: float):
        """The places in the order of their distance from ``share``: even parts first, so that short ones are kept."""
        return places[np.argsort(np.abs(places - share), kind="stable")]

    def pair(self, gap: int, taken: tuple[int, ...]) -> tuple[int, ...] | None:
        if gap < 2 or not self.pairs[gap]:
            return None
        low = np.flatnonzero(self.single[: gap // 2 + 1] & self.single[gap : gap - gap // 2 - 1 : -1])
        return next(((gap - int(a), int(a)) for a in self._by_middle(low, gap / 2) if self.fits((*taken, gap - int(a), int(a)))), None)

    def triple(self, gap: int, taken: tuple[int, ...]) -> tuple[int, ...] | None:
        if gap < 3:
            return None
        third = np.flatnonzero(self.single[1 : gap - 1] * self.pairs[gap - 1 : 1 : -1]) + 1
        for c in self._by_middle(third, gap / 3):
            if self.left[c] > taken.count(int(c)) and (two := self.pair(gap - int(c), (*taken, int(c)))):
                return (int(c), *two)
        return None

    def complement(self, n: int, parts: int) -> tuple[int, ...] | None:
        """Available lengths, ``parts`` of them, that exactly fill what ``n`` leaves."""
        gap = self.capacity - n
        if parts == 1:
            return (gap,) if self.single[gap] and self.fits((n, gap)) else None
        return self.pair(gap, (n,)) if parts == 2 else self.triple(gap, (n,))


def exact_complements(counts: dict[int, int], capacity: int, parts: int) -> tuple[list[Pattern], dict[int, int]]:
    """Sequences filled exactly by a length and up to ``parts`` others, and what is left: singles for all lengths first,
    then pairs, then triples, each from the longest length down."""
    index = SumIndex(counts, capacity)
    out: list[Pattern] = []
    if index.left[capacity]:
        out.append(((capacity,), int(index.left[capacity])))
        index.use((capacity,), int(index.left[capacity]))
    for k in range(1, parts + 1):
        for n in range(capacity - 1, 0, -1):
            while index.left[n] and (found := index.complement(n, k)):
                times = index.fits((n, *found))
                index.use((n, *found), times)
                out.append(((n, *found), times))
    return out, {int(n): int(index.left[n]) for n in np.flatnonzero(index.left)}


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit decreasing on counts: equal sequences are filled together."""
    out: list[Pattern] = []
    open_: dict[int, list[Pattern]] = {}  # gap -> patterns with that gap
    gaps: list[int] = []

    def leave(gap: int, pattern: tuple[int, ...], times: int) -> None:
        if not gap:
            out.append((pattern, times))
            return
        if gap not in open_:
            open_[gap] = []
            insort(gaps, gap)
        open_[gap].append((pattern, times))

    for n in sorted(counts, reverse=True):
        many = counts[n]
        while many:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                each = capacity // n
                full, odd = divmod(many, each)
                for k, times in ((each, full), (odd, 1)):
                    if k and times:
                        leave(capacity - k * n, (n,) * k, times)
                break
            gap = gaps[at]
            pattern, times = open_[gap].pop()
            # A gap takes as many as fit; the last ones may be fewer.
            each = min(gap // n, many)
            now = min(times, many // each)
            many -= now * each
            if times > now:
                open_[gap].append((pattern, times - now))
            if not open_[gap]:
                del open_[gap]
                gaps.pop(at)
            leave(gap - each * n, pattern + (n,) * each, now)
    for patterns in open_.values():
        out.extend(patterns)
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that use each length exactly as often as ``counts`` says, in as few sequences as the ways tried give.

    Exact combinations that spend the short lengths can leave long ones that nothing fills, so complements of up to
    three, two, one and no parts are each followed by best fit, and the fewest sequences win: never more than best
    fit alone.  Work depends on the number of different lengths (at most ``capacity``), not on the counts."""
    counts = {n: c for n, c in counts.items() if c > 0}
    ways = []
    for parts in (3, 2, 1, 0):
        exact, rest = exact_complements(counts, capacity, parts) if parts else ([], counts)
        ways.append(exact + best_fit(rest, capacity))
    return min(ways, key=lambda patterns: sum(times for _, times in patterns))


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """Ranks of a length -> places: (length, first rank, ranks, first sequence, offset)."""
    seen: Counter = Counter()
    sequence, out = 0, []
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            out.append((n, seen[n], times, sequence, offset))
            seen[n] += times
            offset += n
        sequence += times
    return out


def best_fit_pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, salts: int | None = None) -> DataFrame:
    """Pieces with their sequence and offset: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    # The number of a row spreads rows that repeat an id, or have none, over the salts like any others.
    cut = saved(pieces(docs, tokenizer, capacity).withColumn("row", F.monotonically_increasing_id()), "packing-pieces")
    salts = salts or 16 * to_shuffle_width(cut)
    step = max(1, math.isqrt(salts))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    counts = saved(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.floor(F.col("salt") / step).cast("int")), "packing-counts")
    # At most `capacity` rows come to the driver, whatever the input.
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    spark = docs.sparkSession
    slots = np.array(_slots(plan(by_length, capacity)), np.int64).reshape(-1, 5)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    # One row per length (at most `capacity`): its places as arrays, ordered by first rank.
    firsts = np.nonzero(np.concatenate(([True], slots[1:, 0] != slots[:-1, 0])))[0] if len(slots) else []
    table = [(int(s[0, 0]), *([int(x) for x in s[:, k]] for k in (1, 3, 4))) for s in np.split(slots, firsts[1:]) if len(s)]
    places = spark.createDataFrame(table, "length long, ranks array<long>, sequences array<long>, offsets array<long>")
    # Rows of a length before a salt, in two steps: before its part, and before it in its part, so that no
    # window has more than about the square root of ``salts`` rows.
    earlier = lambda keys, by: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.groupBy("length", "part").agg(F.sum("n").alias("n")).select("length", "part", earlier(["length"], "part").alias("parts_before"))
    starts = counts.withColumn("before", earlier(["length", "part"], "salt")).join(parts, ["length", "part"]).select("length", "salt", (F.col("before") + F.col("parts_before")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")) - 1
    ranked = salted.withColumn("inside", inside).join(starts, ["length", "salt"]).withColumn("rank", F.col("inside") + F.col("before"))
    placed = ranked.join(F.broadcast(places), "length")

    # The last place whose first rank is not above this one.
    at = F.size(F.filter("ranks", lambda r: r <= F.col("rank")))
    return placed.withColumn("at", at).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.element_at("sequences", F.col("at")) + F.col("rank") - F.element_at("ranks", F.col("at"))).alias("sequence_id"),
        F.element_at("offsets", F.col("at")).alias("offset"),
    )
