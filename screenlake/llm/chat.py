"""Chat formatting by columnar byte assembly.

Each turn becomes opening mark, escaped text, closing mark.  A batch of turns is assembled as
columns: segment lengths give offsets by a cumulative sum, offsets give scatter indices, and marks
and texts are copied by them into one preallocated buffer, which becomes the Arrow column.

Turns arrive range-partitioned and sorted by (conversation, turn), so a long conversation spreads
over tasks.  The output is *parts*: consecutive turns of one conversation as one formatted text with
its loss spans.  Nearly every conversation is one part; a part that reached the edge of its batch
says so, and only such conversations are brought together again where a result needs whole
conversations, streamed in order and never held whole.

Escaping: a control string inside a text (or a role's name) gets a backslash after its first
character, after any backslashes already there; reading takes one away.  No text can then show a
control string, and every text comes back as it was.

Defined results: null text counts as empty, null role as the empty name; rows with equal (conv_id,
turn) go by role, then text; null ids form one conversation, null turns come first; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Marks of the roles; any other role is named between ROLE and BODY.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
ROLE, BODY, END = "<|role|>", "<|body|>", "<|end|>"
LEARNED = "assistant"
CONTROL = [m for pair in MARKS.values() for m in pair] + [ROLE, BODY, END]
_REST = "|".join(sorted((re.escape(c[1:]) for c in CONTROL), key=len, reverse=True))
_ESCAPE = rf"([<\[])(\\*)({_REST})"
_UNESCAPE = re.compile(rf"([<\[])(\\*)\\({_REST})")
_OPEN = {pair[0]: (role, pair[1]) for role, pair in MARKS.items()}
_MARK = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_SLICE = 1 << 20  # bytes copied by one set of indices
_BATCH = 64 << 20  # bytes of texts assembled at once, but for a longer single text
PARTS = "conv_id long, task int, place long, n_turns long, formatted string, loss array<struct<start:long,stop:long>>, edge boolean"


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, pattern=_ESCAPE, replacement=r"\1\2\\\3")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text) if "\\" in text else text


def _copy(out: np.ndarray, to: np.ndarray, source: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Scatter source[start : start + length] to out[to : to + length], all rows at once."""
    ends = np.cumsum(length)
    # Indices take several words a byte, so they are made for _SLICE bytes at a time; a row of more is one range.
    first = 0
    while first < len(ends):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + _SLICE, "right")))
        if last == first + 1:
            out[to[first] : to[first] + length[first]] = source[start[first] : start[first] + length[first]]
        else:
            n = length[first:last]
            inside = np.arange(ends[last - 1] - done) - np.repeat(ends[first:last] - n - done, n)
            out[np.repeat(to[first:last], n) + inside] = source[np.repeat(start[first:last], n) + inside]
        first = last


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, lengths) of a string column."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at[:-1], np.diff(at)


def assemble(role: pa.Array, text: pa.Array, part: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted parts of a batch of turns; ``part`` numbers the rows' parts from 0, rising.

    Returns the formatted column, and per row the first and last code point of its text in its part.
    """
    n = len(role)
    roles = role.dictionary_encode()
    names = roles.dictionary.to_pylist()
    safe = escape(pa.array(names, pa.string())).to_pylist()
    opening = [MARKS[r][0] if r in MARKS else f"{ROLE}{s}{BODY}" for r, s in zip(names, safe)]
    closing = [MARKS[r][1] if r in MARKS else END for r in names]
    code = roles.indices.to_numpy()
    body = escape(text)
    head_bytes, head_at, head_n = _bytes_of(pa.array(opening, pa.string()))
    tail_bytes, tail_at, tail_n = _bytes_of(pa.array(closing, pa.string()))
    body_bytes, body_at, body_n = _bytes_of(body)
    # Segment lengths, three a row, and their places by a cumulative sum.
    length = np.stack((head_n[code], body_n, tail_n[code]), axis=1)
    place = (np.cumsum(length.ravel()) - length.ravel()).reshape(n, 3)
    out = np.empty(int(length.sum()), np.uint8)
    _copy(out, place[:, 0], head_bytes, head_at[code], length[:, 0])
    _copy(out, place[:, 1], body_bytes, body_at, length[:, 1])
    _copy(out, place[:, 2], tail_bytes, tail_at[code], length[:, 2])
    firsts = np.nonzero(np.concatenate(([True], part[1:] != part[:-1])))[0]
    offsets = np.append(place[firsts, 0], len(out)).astype(np.int32)
    formatted = pa.StringArray.from_buffers(len(firsts), pa.py_buffer(offsets), pa.py_buffer(out))
    # The same sums over code points place the texts for the loss mask.
    head_c = np.array([len(x) for x in opening], np.int64)[code]
    tail_c = np.array([len(x) for x in closing], np.int64)[code]
    body_c = pc.utf8_length(body).to_numpy().astype(np.int64)
    row = head_c + body_c + tail_c
    start = np.cumsum(row) - row
    start = start - start[firsts][part - part[0]] + head_c
    return formatted, start, start + body_c


def _bounded(batch: pa.RecordBatch):
    """A batch of turns in runs of rows whose texts have at most _BATCH bytes; one longer text goes alone.

    Offsets of the formatted column are 32-bit numbers, which one run can then not exceed.
    """
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(3)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _BATCH, "right")))
        yield batch.slice(at, end - at)
        at = end


def format_parts(turns: DataFrame) -> DataFrame:
    """Parts of conversations: see the module's text.  (task, place) orders a conversation's parts."""

    def run(batches):
        task, place = TaskContext.get().partitionId(), 0
        for b in (x for whole in batches for x in _bounded(whole)):
            n = b.num_rows
            if not n:
                continue
            ids = b.column(0)
            key = ids.fill_null(0).to_numpy()
            null = ids.is_null().to_numpy(zero_copy_only=False)
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (null[1:] != null[:-1])))
            part = np.cumsum(new) - 1
            role, text = (pc.fill_null(b.column(k), "") for k in (2, 3))
            formatted, start, stop = assemble(role, text, part)
            firsts = np.nonzero(new)[0]
            ends = np.append(firsts[1:], n)
            learned = pc.equal(role, LEARNED).to_numpy(zero_copy_only=False)
            many = np.add.reduceat(learned.astype(np.int64), firsts)
            spans = pa.StructArray.from_arrays([pa.array(start[learned]), pa.array(stop[learned])], ["start", "stop"])
            loss = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))).astype(np.int32)), spans)
            edge = np.zeros(len(firsts), bool)
            edge[[0, -1]] = True
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(firsts)), pa.array(np.full(len(firsts), task, np.int32)), pa.array(place + np.arange(len(firsts))), pa.array(ends - firsts), formatted, loss, pa.array(edge)],
                ["conv_id", "task", "place", "n_turns", "formatted", "loss", "edge"],
            )
            place += len(firsts)

    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    return rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, PARTS)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a part."""
    out, at = [], 0
    while at < len(formatted):
        m = _MARK.match(formatted, at)
        if m[0] == ROLE:
            name = formatted.index(BODY, m.end())
            role, end, at = unescape(formatted[m.end() : name]), END, name + len(BODY)
        else:
            (role, end), at = _OPEN[m[0]], m.end()
        stop = formatted.index(end, at)
        out.append((role, unescape(formatted[at:stop])))
        at = stop + len(end)
    return out


class _Digest:
    """What a conversation's parts say, taken in order."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, formatted: str, loss) -> None:
        for role, text in read_turns(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for span in loss:
            text = unescape(formatted[span["start"] : span["stop"]])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(formatted)

    def row(self):
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digests(batches):
    """One row per conversation from parts in order; only the current conversation's sums are held."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    now, sums = None, None
    for b in batches:
        rows = []
        for conv, formatted, loss in zip(*(b.column(k) for k in range(3))):
            conv = conv.as_py()
            if sums is None or conv != now:
                if sums is not None:
                    rows.append((now, *sums.row()))
                now, sums = conv, _Digest()
            sums.add(formatted.as_py(), loss.as_py())
        if rows:
            yield pack(rows)
    if sums is not None:
        yield pack([(now, *sums.row())])


def read_back(parts: DataFrame) -> DataFrame:
    """Per conversation, from its formatted parts: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    whole = parts.where("not edge").select("conv_id", "formatted", "loss").mapInArrow(_digests, schema)
    # Conversations that touch the edge of a batch may go on in another part.
    cut = parts.where("edge").repartition("conv_id").sortWithinPartitions("conv_id", "task", "place").select("conv_id", "formatted", "loss").mapInArrow(_digests, schema)
    return whole.unionByName(cut)


def format_chats(turns: DataFrame) -> DataFrame:
    """The formatted parts, written once to the shared folder."""
    return saved(format_parts(turns), "chat-parts")
