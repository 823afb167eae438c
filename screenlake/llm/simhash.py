"""SimHash near-duplicates by Golay-code fuzzy hashing.

A text's fingerprint takes, for each of 64 bits, the majority over the XXH64 values of its word
shingles.  Texts link when fingerprints differ in at most four bits; a component is what links
connect.

Method.  A fingerprint is cut into three segments of 23, 23 and 18 bits, and a segment is decoded
with the perfect (23,12) Golay code.  Decoding the word and each of its one-bit neighbours gives
one codeword index, or six; two words that differ in at most two bits share one of them, because
the word between them is a neighbour of both.  Four differing bits fall on three segments in one
of two ways (pigeonhole):

* none has more than two of them: the fingerprints share a triple of indices;
* one has three or four: of the other two segments one is equal and the other differs in at most
  one bit, so they share the equal segment's bits together with an index of the other.

Keys of both kinds carry 35 or 36 bits, so few unlike fingerprints meet, and their number is fixed
(at most 252 for a fingerprint), so keys grow in proportion to the fingerprints.  What meets
under a key is verified bit by bit.

Hot groups.  Equal fingerprints are one row before keys are made.  Under a key, fingerprints in
the ball of one bit around any word are within two bits of each other and are linked as a star;
only what those stars do not connect is compared, block by block, and a key gives a spanning
forest, never all pairs.

Defined results: null text counts as empty; texts without words have fingerprint zero and link
like others; a repeated ``doc_id`` gives a row per row; null ``doc_id`` sorts last in the choice of
the smallest; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, saved, to_shuffle_width
from .components import components

BITS, REACH = 64, 4
SEGMENTS = ((0, 23), (23, 23), (46, 18))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLOCK = 1 << 20


def _word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in blocks of about a megabyte cut at white space."""
    at, n = 0, len(text)
    cut = re.compile(rb"[ \t-\r]")
    while at < n:
        end = at + _BLOCK
        if end < n:
            found = cut.search(text, end)
            end = found.start() if found else n
        words = text[at:end].translate(_LOWER).split()
        if words:
            yield words
        at = end


def shingle_hashes(text: bytes, width: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of ``width`` words, in blocks; fewer words: the whole sequence."""
    from xxhash import xxh64_intdigest

    before: list[bytes] = []
    seen = False
    for words in _word_blocks(text):
        words = before + words
        if len(words) < width:
            before = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
        yield np.array([xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts, ends[width - 1 :].tolist())], np.uint64)
        before, seen = words[len(words) - width + 1 :] if width > 1 else [], True
    if not seen and before:
        yield np.array([xxh64_intdigest(b" ".join(before), seed)], np.uint64)


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    total, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text, width, seed):
        for part in range(0, len(h), 1 << 16):
            total += np.unpackbits(h[part : part + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0]) if n else 0


def _digest():
    """What tells the texts of rows apart."""
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, digests: bool = False) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long; with ``digests`` also the text's digest."""

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fp = np.array([fingerprint(t.as_py() or b"", width, seed) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *b.schema.names[2:]])

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[_digest().alias("digest")] * digests]
    return in_batches(docs.select(*columns)).mapInArrow(run, "doc_id long, fp long" + ", digest string" * digests)


class Golay:
    """The perfect binary (23,12) code: syndromes, decoding, and the indices near a word."""

    POLYNOMIAL = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1

    def __init__(self):
        one = np.empty(23, np.int32)
        s = 1
        for i in range(23):
            one[i] = s
            s <<= 1
            if s >> 11:
                s ^= self.POLYNOMIAL
        bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
        self.by_byte = [np.bitwise_xor.reduce(np.where(bits, np.resize(one[8 * k : 8 * k + 8], 8) * (np.arange(8) < 23 - 8 * k), 0), axis=1).astype(np.int32) for k in range(3)]
        self.error = np.full(2048, -1, np.int32)
        places = [1 << i for i in range(23)]
        patterns = [0, *places]
        patterns += [a | b for i, a in enumerate(places) for b in places[i + 1 :]]
        patterns += [a | b | c for i, a in enumerate(places) for j, b in enumerate(places[i + 1 :], i + 1) for c in places[j + 1 :]]
        p = np.array(patterns, np.int32)
        self.error[self.syndrome(p)] = p
        assert (self.error >= 0).all(), "the code is not perfect"

    def syndrome(self, w: np.ndarray) -> np.ndarray:
        return self.by_byte[0][w & 255] ^ self.by_byte[1][(w >> 8) & 255] ^ self.by_byte[2][(w >> 16) & 255]

    def index(self, w: np.ndarray) -> np.ndarray:
        """The message part of the codeword next to each word."""
        return (w ^ self.error[self.syndrome(w)]) >> 11

    def near(self, w: np.ndarray, width: int) -> np.ndarray:
        """Indices of each word and its one-bit neighbours, -1 where one repeats: (n, 6)."""
        flips = np.concatenate(([0], 1 << np.arange(width))).astype(np.int32)
        found = np.sort(self.index(w[:, None] ^ flips[None, :]), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        found = -np.sort(-found, axis=1)
        assert (found[:, 6:] == -1).all()
        return found[:, :6]


def fuzzy_keys(fp: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """All keys of the fingerprints: (row number, key), the key's kind in its top bits."""
    u = fp.view(np.uint64)
    words = [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int32) for at, n in SEGMENTS]
    near = [code.near(w, n).astype(np.int64) for w, (_, n) in zip(words, SEGMENTS)]
    rows, keys = [], []

    def put(key, good):
        at = np.nonzero(good)
        rows.append(at[0])
        keys.append(key[at])

    a, b, c = near[0][:, :, None, None], near[1][:, None, :, None], near[2][:, None, None, :]
    put((a << 24) | (b << 12) | c, (a >= 0) & (b >= 0) & (c >= 0))
    kind = 1
    for i in range(3):
        for j in range(3):
            if i != j:
                put((kind << 40) | (words[i].astype(np.int64)[:, None] << 12) | near[j], near[j] >= 0)
                kind += 1
    return np.concatenate(rows), np.concatenate(keys)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :])


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Connect a[i] with b[i]: minimum labels until nothing changes."""
    while True:
        ra, rb = parent[a], parent[b]
        low = np.minimum(ra, rb)
        if (ra == rb).all():
            return parent
        np.minimum.at(parent, ra, low)
        np.minimum.at(parent, rb, low)
        parent = _roots(parent)


def forest(fp: np.ndarray, block: int = 512) -> np.ndarray:
    """Labels of the components (links of at most REACH bits) among distinct fingerprints.

    Few are compared at once.  For many, stars over one-bit balls come first, which takes time
    in proportion; then only rows outside a component are compared with that component.
    """
    u = fp.view(np.uint64)
    n = len(u)
    parent = np.arange(n)
    if n > 64:
        flips = np.concatenate((np.zeros(1, np.uint64), np.uint64(1) << np.arange(BITS, dtype=np.uint64)))
        for part in range(4):  # a quarter of the middle words at a time, by their two low bits
            mids = (u[:, None] ^ flips[None, :]).ravel()
            own = np.repeat(np.arange(n), len(flips))
            pick = (mids & np.uint64(3)) == np.uint64(part)
            mids, own = mids[pick], own[pick]
            order = np.argsort(mids, kind="stable")
            mids, own = mids[order], own[order]
            same = mids[1:] == mids[:-1]
            parent = _join(parent, own[1:][same], own[:-1][same])
    labels = np.unique(parent)
    if len(labels) == 1:
        return parent
    # The largest part need not be compared with itself.
    top = np.bincount(parent).argmax()
    rest = np.nonzero(parent != top)[0]
    for at in range(0, len(rest), block):
        left = rest[at : at + block]
        for to in range(0, n, 8 * block):
            right = np.arange(to, min(n, to + 8 * block))
            x, y = np.nonzero((_distance(u[left], u[right]) <= REACH) & (parent[left][:, None] != parent[right][None, :]))
            if len(x):
                parent = _join(parent, left[x], right[y])
    return parent


def _bucket_edges(batches):
    """Edges of the buckets of a partition sorted by (key, fp)."""
    left_k = left_f = np.empty(0, np.int64)

    def edges(k, f):
        keep = np.concatenate(([True], (k[1:] != k[:-1]) | (f[1:] != f[:-1])))
        k, f = k[keep], f[keep]
        at = np.nonzero(np.concatenate(([True], k[1:] != k[:-1])))[0]
        n = np.diff(np.concatenate((at, [len(k)])))
        pairs = at[n == 2]
        a, b = [f[pairs]], [f[pairs + 1]]
        good = np.bitwise_count(a[0].view(np.uint64) ^ b[0].view(np.uint64)) <= REACH
        a, b = [a[0][good]], [b[0][good]]
        for s, m in zip(at[n > 2], n[n > 2]):
            g = f[s : s + m]
            p = forest(g)
            linked = p != np.arange(m)
            a.append(g[linked])
            b.append(g[p[linked]])
        out = np.unique(np.stack((np.concatenate(a), np.concatenate(b)), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

    for batch in batches:
        k, f = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        k, f = np.concatenate((left_k, k)), np.concatenate((left_f, f))
        if not len(k):
            continue
        cut = np.searchsorted(k, k[-1])  # the last key may go on in the next batch
        if cut:
            yield edges(k[:cut], f[:cut])
        left_k, left_f = k[cut:], f[cut:]
    if len(left_k):
        yield edges(left_k, left_f)


def near_edges(distinct: DataFrame) -> DataFrame:
    """Spanning edges (a, b) of the components among the fingerprints of ``distinct`` (fp)."""

    def keyed(batches):
        code = Golay()
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 4096):
                part = fp[at : at + 4096]
                rows, keys = fuzzy_keys(part, code)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], ["key", "fp"])

    # Fingerprints are few bytes in few files, their keys many: they are spread before keys are made.
    spread = distinct.select("fp").repartition(to_shuffle_width(distinct), "fp")
    keys = spread.mapInArrow(keyed, "key long, fp long")
    return keys.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_bucket_edges, "a long, b long").distinct()


def _classes(prints: DataFrame) -> DataFrame:
    """(fp, component, component_id, component_size) of saved fingerprints; a null id counts as the last."""
    order = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    distinct = saved(prints.groupBy("fp").agg(F.min(order).alias("first_id"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    edges = saved(near_edges(distinct), "simhash-edges")
    member = components(edges)  # (node, component) of linked fingerprints
    labelled = distinct.join(member, distinct.fp == member.node, "left").select("fp", "first_id", "n", F.coalesce("component", "fp").alias("component"))
    named = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"), F.sum("n").alias("component_size"))
    return saved(labelled.select("fp", "component").join(named, "component").select("fp", "component", "component_id", "component_size"), "simhash-classes")


def simhash_components(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (hex), component_id, component_size."""
    prints = saved(fingerprints(docs, width, seed), "simhash-prints")
    classes = _classes(prints)
    return prints.join(classes, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("component_id") != (1 << 63) - 1, F.col("component_id")).alias("component_id"),
        "component_size",
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row (the smallest ``doc_id``) of each component, all columns kept.

    Rows are told apart by id and text: of a component's rows with the smallest id the least digest
    stays, and one of the rows that repeat both.  A component of null ids keeps one row like any other.
    """
    prints = saved(fingerprints(docs, digests=True), "simhash-prints")
    several = _classes(prints).where("component_size > 1").select("fp", "component")
    rows = saved(prints.join(several, "fp").groupBy("component", "doc_id", "digest").agg(F.count(F.lit(1)).alias("n")), "simhash-rows")
    least = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("least"))
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("digest") == F.col("least.digest"))
    decided = rows.join(least, "component").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), kept.alias("_kept"), "n")
    decided = saved(decided.where("not _kept or n > 1").drop("n"), "simhash-decided")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_own"), _digest().alias("_key"))
    met = keyed.join(decided, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_digest")), "left").where("coalesce(_kept, true)")
    if decided.where("_kept").isEmpty():
        return met.select("_row.*")
    # Some kept rows repeat both id and text: one of each stays.
    return met.where("_kept is null").select("_row").unionByName(met.where("_kept").dropDuplicates(["_own", "_key"]).select("_row")).select("_row.*")
