"""Keyed state that answers rows in event order and ends by timers.

Keys share buckets by hash, since a call into Python and a state access cost far more than a row.  Rows of a
bucket wait in state, one entry per span of event time, until the watermark has passed the span; then a timer
answers all spans passed, one after another in order, with the bucket's state read and written once.  So answers
don't depend on how rows were dealt to batches, and a bucket never holds more at once than one span's rows and
what its subclass keeps.  A row whose span the watermark had passed when it arrived is late, and told so at once.

The state store is RocksDB (``rocksdb`` sets it for the queries started inside), since only it has timers.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class InOrder(StatefulProcessor):
    """Rows (ts_ms, event_index, the key as a string and the ``kept`` columns) of a bucket, span by span in event order.

    A subclass gives ``kept`` (name: type), ``outputs`` (names), ``holds`` (schema of a bucket's state, arrays),
    ``load`` (what it works on, of that state or of None), ``answer`` (output rows of one span's rows), ``late`` (the
    output row of a late row) and ``store`` (the state to keep once every row before ``now`` has been answered, and
    when the first of it can go; None: nothing, or never)."""

    kept: dict[str, str] = {}
    outputs: list[str] = []
    holds = ""

    def __init__(self, span_ms: int):
        self.span = span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        types = {"ts_ms": "long", "event_index": "long", "owner": "string"} | self.kept
        self.names = list(types)
        self.waiting = handle.getMapState("waiting", "span long", ", ".join(f"{n} array<{t}>" for n, t in types.items()))
        self.state = handle.getValueState("state", self.holds)
        self.answered: dict[tuple, int] = {}  # bucket: last span that a timer of this batch has answered

    def load(self, state: tuple | None) -> Any:
        raise NotImplementedError

    def answer(self, held: Any, span: int, rows: list[tuple]) -> list[tuple]:
        raise NotImplementedError

    def late(self, row: tuple) -> tuple:
        raise NotImplementedError

    def store(self, held: Any, now: int) -> tuple[tuple | None, int | None]:
        raise NotImplementedError

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.outputs, dtype=object)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        self.answered.pop(key, None)
        spans: dict[int, list[tuple]] = {}
        for frame in rows:
            late = []
            for row in zip(*(frame[n].tolist() for n in self.names)):
                span = row[0] // self.span
                if (span + 1) * self.span < passed:
                    late.append(self.late(row))
                else:
                    spans.setdefault(span, []).append(row)
            if late:
                yield self._frame(late)
        for span, more in spans.items():
            held = self.waiting.getValue((span,))
            columns = [list(c) for c in zip(*more)]
            self.waiting.updateValue((span,), tuple([*h, *c] for h, c in zip(held, columns)) if held else tuple(columns))
            self.handle.registerTimer((span + 1) * self.span)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # The spans before the watermark, as those of late rows are told, and the timer's own.
        end = max(-(-timerValues.getCurrentWatermarkInMs() // self.span) - 1, expiredTimerInfo.getExpiryTimeInMs() // self.span)
        if self.answered.get(key, -1) >= end:
            return
        self.answered[key] = end
        held = self.load(tuple(self.state.get()) if self.state.exists() else None)
        for span in sorted(s for (s,) in list(self.waiting.keys()) if s < end):
            rows = sorted(zip(*self.waiting.getValue((span,))), key=lambda r: r[:2])
            self.waiting.removeKey((span,))
            yield self._frame(self.answer(held, span, rows))
        state, gone = self.store(held, end * self.span)
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
        if gone is not None:
            self.handle.registerTimer((gone // self.span + 1) * self.span)


def in_order(rows: DataFrame, keys: list[str], processor: InOrder, schema: str, delay: str, buckets: int) -> DataFrame:
    """``rows`` (keys, which are whole numbers or null, event_index, ts_ms, the processor's columns) through ``processor``,
    ``ts_ms`` being the event time.  ``buckets`` bounds the tasks at work; like all state it belongs to a stream's checkpoint."""
    # One string a key: pandas makes whole numbers with nulls among them floats.
    key = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    # Without its column past this point the watermark drops no row: late ones are answered as such.
    rows = rows.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", delay)
    rows = rows.select(bucket_of(keys, buckets), "ts_ms", "event_index", key.alias("owner"), *processor.kept)
    return rows.groupBy("_bucket").transformWithStateInPandas(processor, schema, "append", "eventTime")


def bucket_of(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket")
