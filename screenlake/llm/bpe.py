"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A word starts as its bytes.  The leaves of a segment tree hold the merge ranks of adjacent pairs; its
root gives the lowest rank, leftmost among equals.  A merge changes three leaves, each a
logarithmic update, and merging goes on until the root holds no pair.

New words of a batch are encoded together: words of like length share one array of trees, and each
step merges one pair in every word that still has one.  Long words take the same tree alone.  Words
come back often, so ids are looked up after the first time, in bounded tables.

Defined results: null text is empty (no ids); strings of added tokens inside a text get their ids,
as the tokenizers library does by default; repeated or null ids of documents give a row each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, spread

from .packing import _byte_letters

_NONE = np.int64(1) << 62
_CACHED = 200_000
_WIDEST = 64  # words of more bytes take a tree alone
_CROWDED = re.compile(r"\s\s|^\s|\s$|[\x1c-\x1f]")  # space next to space, or at an end


class Recent:
    """A bounded table in two generations: what the younger lacks and the older has comes back, so
    frequent keys stay when the older is dropped."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def turn(self) -> dict[str, bytes]:
        """The table to use until the next turn."""
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        return self.young

    def missing(self, keys: set[str]) -> set[str]:
        """Keys in neither generation; those of the older one move to the younger."""
        keys = keys.difference(self.young)
        back = {k for k in keys if k in self.old}
        self.young.update((k, self.old[k]) for k in back)
        return keys - back


class ByteBpe:
    """Encoder and decoder of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        byte_of = {chr(c): b for b, c in letters.items()}
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: id -> bytes.  Letters outside the byte alphabet stand for themselves.
        self.bytes_of = [b""] * (1 + max((vocab | self.added).values()))
        for t, i in (vocab | self.added).items():
            self.bytes_of[i] = b"".join(bytes([byte_of[c]]) if c in byte_of else c.encode() for c in t)
        self.first = np.array([vocab[chr(letters[b])] for b in range(256)], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        a, b = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        keys, made = (a << 20) | b, np.array([vocab["".join(m)] for m in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order, made  # rank r makes token made[r]
        self.rank_of = {int(k): r for r, k in enumerate(keys.tolist())}
        # The pattern of byte-level vocabularies.
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.parts, self.words = Recent(_CACHED), Recent(_CACHED)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge ranks of the pairs (a, b), _NONE where they don't merge."""
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words of at most _WIDEST bytes, one tree per word and all trees in step."""
        out: list = [None] * len(words)
        sizes = np.array([len(w) for w in words])
        width = 2
        while width <= _WIDEST:
            pick = np.nonzero((sizes <= width) & (sizes > width // 2 if width > 2 else sizes <= 2))[0]
            for at in range(0, len(pick), 1 << 15):
                part = pick[at : at + (1 << 15)]
                for i, ids in zip(part.tolist(), self._in_step([words[i] for i in part], width)):
                    out[i] = ids
            width *= 2
        return out

    def _in_step(self, words: list[bytes], width: int) -> list[bytes]:
        n = len(words)
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        size = np.array([len(w) for w in words])
        ids = self.first[flat]
        inside = np.arange(width)[None, :] < size[:, None]
        ids[~inside] = -1
        right = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()  # next symbol's place
        left = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()
        tree = np.full((n, 2 * width), _NONE, np.int64)
        pairs = inside[:, 1:]
        rank = np.where(pairs, self.ranks(np.maximum(ids[:, :-1], 0), np.maximum(ids[:, 1:], 0)), _NONE)
        place = np.arange(width - 1)
        tree[:, width : 2 * width - 1] = np.where(rank < _NONE, (rank << 16) | place, _NONE)
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        live = np.nonzero(tree[:, 1] < _NONE)[0]

        def put(row, leaf, value):
            node = leaf + width
            tree[row, node] = value
            node = node >> 1
            while node[0]:
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
                node = node >> 1

        while len(live):
            root = tree[live, 1]
            i = root & 0xFFFF
            j = right[live, i]
            k = right[live, j]
            ids[live, i] = self.made[root >> 16]
            ids[live, j] = -1
            right[live, i] = k
            put(live, j, _NONE)
            some = k < size[live]
            rows, a, b = live[some], i[some], k[some]
            left[rows, b] = a
            value = np.full(len(live), _NONE)
            r = self.ranks(ids[rows, a], ids[rows, b])
            value[some] = np.where(r < _NONE, (r << 16) | a, _NONE)
            put(live, i, value)
            before = left[live, i]
            some = before >= 0
            rows, a, b = live[some], before[some], i[some]
            if len(rows):
                r = self.ranks(ids[rows, a], ids[rows, b])
                put(rows, a, np.where(r < _NONE, (r << 16) | a, _NONE))
            live = live[tree[live, 1] < _NONE]
        kept = ids >= 0
        packed = ids[kept].astype(np.uint32).tobytes()
        ends = (4 * np.cumsum(kept.sum(axis=1))).tolist()
        return [packed[s:e] for s, e in zip([0, *ends[:-1]], ends)]

    def merge_one(self, word: bytes) -> list[int]:
        """The same tree for one word of any length."""
        ids = self.first[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        width = 1 << max(1, (n - 1).bit_length())
        none, get, made = 1 << 62, self.rank_of.get, self.made
        tree = [none] * (2 * width)

        def value(a, b):
            r = get((ids[a] << 20) | ids[b])
            return none if r is None else (r << 32) | a

        for p in range(n - 1):
            tree[width + p] = value(p, p + 1)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(leaf, v):
            node = width + leaf
            tree[node] = v
            node >>= 1
            while node:
                tree[node] = min(tree[2 * node], tree[2 * node + 1])
                node >>= 1

        while tree[1] < none:
            i = tree[1] & 0xFFFFFFFF
            j = right[i]
            k = right[j]
            ids[i], ids[j], right[i] = int(made[tree[1] >> 32]), -1, k
            put(j, none)
            if k < n:
                left[k] = i
            put(i, value(i, k) if k < n else none)
            if left[i] >= 0:
                put(left[i], value(left[i], i))
        return [x for x in ids if x >= 0]

    def _segments(self, text: str) -> list:
        """The text as ids of added tokens and plain stretches between them."""
        if not self.split_added or not any(a in text for a in self.added):
            return [text] if text else []
        return [self.added.get(x, x) for x in self.split_added.split(text) if x]

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed unsigned 32-bit numbers.

        Where single spaces stand between other characters, a space and what follows it are cut
        alone by the pattern, so ``words`` can hold the ids of ' ' + word; other stretches are cut
        whole, and ``parts`` holds the ids of their pieces.
        """
        words, parts = self.words.turn(), self.parts.turn()
        # Per text: ids of added tokens, or lists of pieces (first) and spaced words (rest).
        plan: list[list] = []
        new_words: set[str] = set()
        for text in texts:
            steps: list = []
            for x in self._segments(text):
                if x.__class__ is int:
                    steps.append((array("I", [x]).tobytes(), (), ()))
                elif _CROWDED.search(x):
                    steps.append((b"", self.cut.findall(x), ()))
                else:
                    first, *rest = x.split(" ")
                    new_words.update(rest)
                    steps.append((b"", self.cut.findall(first), rest))
            plan.append(steps)
        cut = {w: self.cut.findall(f" {w}") for w in self.words.missing(new_words)}
        wanted = {p for pieces in cut.values() for p in pieces}
        for steps in plan:
            for _, pieces, _ in steps:
                wanted.update(pieces)
        new = list(self.parts.missing(wanted))
        coded = [p.encode() for p in new]
        short = [i for i, c in enumerate(coded) if len(c) <= _WIDEST]
        parts.update(zip([new[i] for i in short], self.merge_many([coded[i] for i in short])))
        alone = [i for i, c in enumerate(coded) if len(c) > _WIDEST]
        parts.update((new[i], array("I", self.merge_one(coded[i])).tobytes()) for i in alone)
        ids_of = parts.__getitem__
        words.update((w, b"".join(map(ids_of, pieces))) for w, pieces in cut.items())
        out = [b"".join(chain.from_iterable(chain((token,), map(ids_of, pieces), map(words.__getitem__, rest)) for token, pieces, rest in steps)) for steps in plan]
        for i in alone:  # long pieces don't stay in the table
            parts.pop(new[i], None)
        for w in [w for w in cut if len(w) > _WIDEST]:
            words.pop(w, None)
        return out

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(b, np.uint32).tolist() for b in self.encode_packed(texts)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that aren't UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(1)
def coder_of(path: str) -> ByteBpe:
    """One coder for all tasks of a Python worker."""
    return ByteBpe(path)


def bpe_encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text."""

    def run(batches):
        coder = coder_of(tokenizer)
        for b in batches:
            ids = [np.frombuffer(x, np.int32) for x in _in_blocks(coder, b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return in_batches(spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give null."""

    def run(batches):
        coder = coder_of(tokenizer)
        for b in batches:
            texts = [None if ids is None else coder.decode(ids) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return in_batches(encoded.select("doc_id", "ids")).mapInArrow(run, "doc_id long, text string")


def _in_blocks(coder: ByteBpe, column, size: int = 1 << 22) -> Iterable[bytes]:
    """Packed ids of a column, about ``size`` characters at a time."""
    block, n = [], 0
    for t in column:
        text = t.as_py() or ""
        block.append(text)
        n += len(text)
        if n >= size:
            yield from coder.encode_packed(block)
            block, n = [], 0
    yield from coder.encode_packed(block)


def bpe_round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; ids stay inside the task."""

    def run(batches):
        coder = coder_of(tokenizer)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        said = [str(i) for i in range(len(coder.bytes_of))]
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for packed in _in_blocks(coder, b.column(1)):
                ids = np.frombuffer(packed, np.uint32).tolist()
                n.append(len(ids))
                ids_sha.append(sha(",".join(map(said.__getitem__, ids))))
                text_sha.append(sha(coder.decode(ids)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return in_batches(spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
