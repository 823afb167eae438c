"""The online forms of the trace operators as Structured Streaming queries.

Each takes a streaming DataFrame and returns one, so source and sink stay the caller's.  State is
bounded where the semantics bound it: a cache by its quota, duplicates and windows by the watermark.
Within a micro-batch, rows of a key are put in event order before they touch state.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .ordered import InOrder, bucket_of, in_order, rocksdb


def _ordered(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(["ts_ms", "event_index"], kind="stable")


#: Keys share so many buckets of state.
BUCKETS = 256


class _Suppress(InOrder):
    """Accounts' caches: token -> when it was inserted, in order of use, the oldest first."""

    kept = {"token": "string", "exact_mismatch": "boolean"}
    outputs = ["event_index", "account", "token", "forwarded", "late"]
    holds = "accounts array<string>, sizes array<long>, tokens array<string>, inserted array<long>"

    def __init__(self, span_ms: int, ttl_ms: int, quota: int):
        super().__init__(span_ms)
        self.ttl, self.quota = ttl_ms, quota

    def load(self, state):
        if state is None:
            return {}
        accounts, sizes, tokens, inserted = state
        entries = zip(tokens, inserted)
        return {a: dict(islice(entries, n)) for a, n in zip(accounts, sizes)}

    def late(self, row):
        return row[1], int(row[2]) if row[2] else None, row[3], True, True

    def answer(self, held, span, rows):
        out = []
        for ts, number, account, token, mismatch in rows:
            cache = held.setdefault(account, {})
            since = cache.pop(token, None)
            if since is not None and ts - since >= self.ttl:
                since = None
            if since is not None:
                cache[token] = since
            elif mismatch and self.quota:
                if len(cache) >= self.quota:
                    del cache[next(iter(cache))]
                cache[token] = ts
            out.append((number, int(account) if account else None, token, since is None, False))
        return out

    def store(self, held, now):
        """A cache leaves state when the last of its entries has expired."""
        ends = {a: max(c.values()) + self.ttl for a, c in held.items() if c}
        live = [a for a, end in ends.items() if end > now]
        if not live:
            return None, None
        entries = [e for a in live for e in held[a].items()]
        return (live, [len(held[a]) for a in live], *map(list, zip(*entries))), min(ends[a] for a in live)


def stream_suppress(attempts: DataFrame, ttl_ms: int, quota: int, delay: str = "1 hour", span_ms: int = 3_600_000, buckets: int = BUCKETS) -> DataFrame:
    """Attempts with ``forwarded``: whether no live entry of the account's cache covers them.

    Columns: event_index, account, token, ts_ms, exact_mismatch.  Entries live ``ttl_ms`` from
    insertion, are inserted for exact mismatches only, and an account holds at most ``quota``, the
    least recently used leaving first.  Attempts are answered in event order when the watermark (``delay``
    behind) passes their span; a late one is forwarded and changes nothing.  State is a cache of at most
    ``quota`` entries per account until the last has expired, then none.
    """
    schema = "event_index long, account long, token string, forwarded boolean, late boolean"
    return in_order(attempts, ["account"], _Suppress(span_ms, ttl_ms, quota), schema, delay, buckets)


def stream_coalesce(attempts: DataFrame, span: str) -> DataFrame:
    """Leaders: the first attempt of each (account, token) within the span."""
    return attempts.withWatermark("ts", span).dropDuplicatesWithinWatermark(["account", "token"])


def stream_waiters(attempts: DataFrame, span: str, delay: str) -> DataFrame:
    """Attempts per key and span beyond the leader."""
    counts = attempts.withWatermark("ts", delay).groupBy(F.window("ts", span).alias("w"), "account", "token").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), "account", "token", (F.col("n") - 1).alias("waiters"))


def stream_metrics(events: DataFrame, span: str, delay: str, slide: str | None = None, routes: tuple[str, ...] = ()) -> DataFrame:
    """Offered, dropped, timed out, rates and percentiles per event-time window, and the rows of each named
    ``route`` and of all others; late rows beyond the delay are left out."""
    w = F.window("ts", span, slide) if slide else F.window("ts", span)
    taken = {r: F.col("route") == r for r in routes}
    if routes:
        taken["other"] = ~F.coalesce(F.col("route").isin(list(routes)), F.lit(False))
    out = events.withWatermark("ts", delay).groupBy(w.alias("w")).agg(
        F.count(F.lit(1)).alias("offered"), F.count_if("dropped").alias("dropped"), F.count_if("timed_out").alias("timed_out"), *[F.count_if(c).alias(f"route_{r}") for r, c in taken.items()],
        F.percentile_approx("value", [0.5, 0.99], 10_000).alias("p"), F.max("value").alias("greatest")
    )
    rates = [F.try_divide(c, "offered").alias(r) for c, r in (("dropped", "drop_rate"), ("timed_out", "timeout_rate"))]
    return out.select(F.col("w.start").alias("start"), "offered", "dropped", "timed_out", *[f"route_{r}" for r in taken], *rates, F.col("p")[0].alias("p50"), F.col("p")[1].alias("p99"), "greatest")


class _Prefix(InOrder):
    """Scopes' counts: of invalid attempts per token, in all, and the time of the last attempt."""

    kept = {"token": "string", "invalid": "boolean"}
    outputs = ["event_index", "same_count", "scope_invalid", "scope_distinct", "late"]
    holds = "scopes array<string>, last array<long>, sizes array<long>, tokens array<string>, counts array<long>"

    def __init__(self, span_ms: int, retire_ms: int):
        super().__init__(span_ms)
        self.retire = retire_ms

    def load(self, state):
        if state is None:
            return {}
        scopes, last, sizes, tokens, counts = state
        entries, held = zip(tokens, counts), {}
        for scope, at, n in zip(scopes, last, sizes):
            own = dict(islice(entries, n))
            held[scope] = [at, sum(own.values()), own]
        return held

    def late(self, row):
        return row[1], None, None, None, True

    def answer(self, held, span, rows):
        out = []
        for ts, number, key, token, bad in rows:
            scope = held.get(key)
            if scope is None or scope[0] + self.retire < span * self.span:
                scope = held[key] = [ts, 0, {}]
            _, invalid, counts = scope
            out.append((number, counts.get(token, 0), invalid, len(counts), False))
            scope[0] = ts
            if bad:
                scope[1] += 1
                counts[token] = counts.get(token, 0) + 1
        return out

    def store(self, held, now):
        """A scope without attempts for the retirement time leaves state."""
        live = {k: s for k, s in held.items() if s[0] + self.retire >= now}
        if not live:
            return None, None
        counts = [s[2] for s in live.values()]
        last = [s[0] for s in live.values()]
        state = list(live), last, [len(c) for c in counts], [t for c in counts for t in c], [n for c in counts for n in c.values()]
        return state, min(last) + self.retire


def stream_prefix_features(attempts: DataFrame, delay: str = "1 hour", span_ms: int = 3_600_000, retire_ms: int = 90 * 86_400_000, buckets: int = BUCKETS) -> DataFrame:
    """Prior counts per tuple and per scope, each row seen after it is answered; a late row has none.

    Columns: event_index, account, generation, version, token, ts_ms, invalid.  A scope (a retired version above all) is forgotten ``retire_ms`` after
    its last attempt.
    """
    schema = "event_index long, same_count long, scope_invalid long, scope_distinct long, late boolean"
    return in_order(attempts, ["account", "generation", "version"], _Prefix(span_ms, retire_ms), schema, delay, buckets)


def stream_epoch_watermark(acks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Acknowledgements with ``regressed`` and the (edge, account)'s watermark after each.

    Columns: event_index, edge, account, epoch (of the directory), representation, ts_ms.  An acknowledgement
    behind the watermark in either epoch regresses and changes nothing; any other becomes the watermark.
    Pairs share ``buckets`` of state, since a call into Python costs far more than a row.
    """
    outputs = ["event_index", "edge", "account", "epoch", "representation", "regressed", "watermark", "representation_watermark"]

    def step(key, batches, state: GroupState):
        tops = {}
        if state.exists:
            pairs, epochs, representations = state.get
            tops = dict(zip(pairs, zip(epochs, representations)))
        frame, out = _ordered(batches), []
        for number, pair, *now in zip(*(frame[c].tolist() for c in ("event_index", "pair", "epoch", "representation"))):
            top = tops.get(pair)
            back = top is not None and (now[0] < top[0] or now[1] < top[1])
            if not back:
                top = tops[pair] = tuple(now)
            edge, account = (int(x) if x else None for x in pair.split("/"))
            out.append((number, edge, account, *now, back, *top))
        state.update((list(tops), *map(list, zip(*tops.values()))))
        yield pd.DataFrame(out, columns=outputs, dtype=object)

    # One string a pair: pandas makes whole numbers with nulls among them floats.
    pair = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("edge", "account")])
    return acks.select(bucket_of(["edge", "account"], buckets), "event_index", pair.alias("pair"), "epoch", "representation", "ts_ms").groupBy("_bucket").applyInPandasWithState(
        step, "event_index long, edge long, account long, epoch long, representation long, regressed boolean, watermark long, representation_watermark long",
        "pairs array<string>, epochs array<long>, representations array<long>", "append", GroupStateTimeout.NoTimeout
    )


def edge_certainty(answered: DataFrame, crashes: DataFrame) -> DataFrame:
    """Per edge whether it is certain: its last crash (event_index, edge) lies before its last accepted
    acknowledgement in any scope (``answered``: event_index, edge, regressed).  An edge that crashed and has
    acknowledged nothing since screens nothing.

    One aggregation without a window, so it also runs over streams (update or complete mode), a row of state an edge.
    """
    kept = answered.where(~F.col("regressed")).select("edge", F.col("event_index").alias("ack"), F.lit(None).cast("long").alias("crash"))
    every = kept.unionByName(crashes.select("edge", F.lit(None).cast("long").alias("ack"), F.col("event_index").alias("crash")))
    out = every.groupBy("edge").agg(F.max("ack").alias("last_ack"), F.max("crash").alias("last_crash"))
    return out.withColumn("certain", F.col("last_ack").isNotNull() & F.coalesce(F.col("last_ack") > F.col("last_crash"), F.lit(True)))


def split_to_end(stream: DataFrame, side, main_path: str, side_path: str, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """Run a stream over what its source holds now into two outputs: rows for which ``side`` holds go to the
    second.  A batch has a folder of its own in each, so one that is run again replaces its rows."""

    def write(batch: DataFrame, number: int):
        batch = batch.persist()
        for path, rows in ((main_path, batch.where(~side)), (side_path, batch.where(side))):
            rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    read = stream.sparkSession.read.schema(stream.schema)
    return tuple(read.option("recursiveFileLookup", True).parquet(path) for path in (main_path, side_path))


def stream_late_audit(requests: DataFrame, completions: DataFrame, deadline: str, delay: str) -> DataFrame:
    """Requests with the time of their completion within the deadline, null when it timed out; once per request."""
    r = requests.withWatermark("ts", delay)
    c = completions.select(F.col("request").alias("_request"), F.col("done_at")).withWatermark("done_at", delay)
    met = r.join(c, F.expr(f"request = _request AND done_at >= ts AND done_at <= ts + INTERVAL {deadline}"), "leftOuter")
    return met.select("request", "ts", "done_at", F.col("done_at").isNull().alias("timed_out"))


def run_to_end(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", progress: list | None = None) -> DataFrame:
    """Run a stream over what its source holds now and return the files it wrote; ``progress`` collects its batches."""
    with rocksdb(stream.sparkSession):
        query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    if progress is not None:
        progress += query.recentProgress
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
