"""Operators over ordered attempt traces: prefix features, labels of future reuse, and how many backend
checks remain under caches.

Windows are per key or shard; caches are told from reuse distances and chains of episodes, which spread a
shard or key of any size over all tasks.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.scratch import saved
from .ordered import numbered, running, same_keys, smaller_before, width_of

TUPLE = ["account", "generation", "version", "token"]
SCOPE = ["account", "generation", "version"]
# Fixed values: "time since" where there is no earlier event; the routes of an attempt.
NEVER_MS = 1e12
FAIL_OPEN, CACHE_REJECT, SCREEN_REJECT, MATCHED, DENIED = "FAIL_OPEN_BACKEND", "NEGATIVE_CACHE_REJECT", "SCREEN_REJECT", "BACKEND_MATCH", "BACKEND_DENY"


def prefix_features(attempts: DataFrame) -> DataFrame:
    """Features of each attempt from the rows before it: of its tuple and of its account scope."""
    before = lambda keys: Window.partitionBy(*keys).orderBy("event_index").rowsBetween(Window.unboundedPreceding, -1)
    invalid = F.when(S.is_existing_invalid("label"), 1).otherwise(0)
    of_tuple, of_scope = before(TUPLE), before(SCOPE)
    rows = attempts.withColumn("invalid", invalid)
    rows = rows.withColumns(
        {
            "same_count": F.coalesce(F.sum("invalid").over(of_tuple), F.lit(0)),
            "last_ms": F.max(F.when(F.col("invalid") == 1, F.col("ts_ms"))).over(of_tuple),
        }
    ).withColumn("new_tuple", F.when((F.col("invalid") == 1) & (F.col("same_count") == 0), 1).otherwise(0))
    rows = rows.withColumns(
        {"scope_invalid": F.coalesce(F.sum("invalid").over(of_scope), F.lit(0)), "scope_distinct": F.coalesce(F.sum("new_tuple").over(of_scope), F.lit(0))}
    )
    since = F.when(F.col("last_ms").isNull(), NEVER_MS).otherwise(F.greatest(F.lit(0), F.col("ts_ms") - F.col("last_ms")).cast("double"))
    return rows.select(
        "event_index", "same_count", since.alias("since_ms"), "scope_invalid", "scope_distinct",
        F.log1p("same_count").alias("log_same"), F.log1p(since).alias("log_since"), F.log1p("scope_invalid").alias("log_invalid"), F.log1p("scope_distinct").alias("log_distinct"),
        (F.col("same_count") / F.greatest(F.lit(1), F.col("scope_distinct"))).alias("repeat_ratio"), "age_fraction", "rotation_recent", "weight",
    )


def horizon_labels(attempts: DataFrame, horizon_ms: int) -> DataFrame:
    """Later events of the same tuple within the horizon: their number, and whether there is one."""
    rows = attempts.where(S.is_existing_invalid("label"))
    ranged = Window.partitionBy(*TUPLE).orderBy("ts_ms").rangeBetween(0, horizon_ms)
    # The range holds all rows at the row's own time; those not after it are taken off again.
    tied = Window.partitionBy(*TUPLE, "ts_ms").orderBy("event_index")
    future = F.count(F.lit(1)).over(ranged) - F.row_number().over(tied)
    return rows.select("event_index", future.alias("future_repeat_count"), (future > 0).alias("repeats_within_horizon"))


def first_seen(attempts: DataFrame) -> DataFrame:
    """First occurrence of each tuple, and whether it comes before the account's first success."""
    rows = attempts.withColumns(
        {
            "is_first": F.row_number().over(Window.partitionBy(*TUPLE).orderBy("event_index")) == 1,
            "cutoff": F.min(F.when(F.col("label") == "VALID", F.col("event_index"))).over(Window.partitionBy(*SCOPE)),
        }
    )
    return rows.select("event_index", "is_first", (F.col("is_first") & (F.col("cutoff").isNull() | (F.col("event_index") < F.col("cutoff")))).alias("survives"))


def suppress_unbounded(attempts: DataFrame, by: str = "region") -> DataFrame:
    """Backend checks when nothing is ever evicted: distinct tuples.  Pre-aggregated per tuple."""
    return attempts.groupBy(by, *TUPLE).agg(F.count(F.lit(1)).alias("n")).groupBy(by).agg(F.sum("n").alias("static_checks"), F.count(F.lit(1)).alias("adaptive_checks"))


#: Most rows of a block of positions or of a range of previous uses, each one task's work in ``reuse_distance``.
BLOCK = 1 << 18


def reuse_distance(trace: DataFrame, shard: list[str], key: list[str], at: str = "event_index", carry: list[str] = (), block: int = BLOCK) -> DataFrame:
    """Distinct other keys of the shard since the key's last use: ``trace``'s shard, key, ``at`` and ``carry`` with
    ``distance``, null at first use.  It decides every capacity of a least-recently-used cache at once.

    All shards are one line of positions.  The keys used between p, the previous use, and i, this one, are the rows
    before i that are first uses or whose own previous use is before p, less the rows up to p.  Positions and
    previous uses are both dense, so equal blocks of either hold equally many rows however skewed shards and keys
    are: rows in earlier blocks with previous uses in earlier ranges come from a table of counts per cell, those in
    the row's own block or its own range from one task each.
    """
    columns = list(dict.fromkeys([*shard, *key, at, *carry]))
    rows = numbered(trace.select(*columns), [*dict.fromkeys([*shard, at])], "_i")
    rows = saved(running(rows, list(dict.fromkeys([*shard, *key])), ["_i"], {"_p": ("last", "_i")}, before=True), "reuse-rows")
    n = rows.count()
    blocks = max(1, min(n, width_of(rows)), -(-n // block))
    size = max(1, -(-n // blocks))
    rows = rows.withColumns({"_b": F.floor(F.col("_i") / size).cast("long"), "_r": F.floor(F.col("_p") / size).cast("long")})

    def inside(table: pa.Table) -> pa.Table:
        """A block: rows before this one in it that are first uses or have an earlier previous use."""
        table = table.sort_by("_i")
        p = table.column("_p").fill_null(-1).to_numpy()
        return table.append_column("_in", pa.array(smaller_before(p)))

    def across(table: pa.Table) -> pa.Table:
        """A range of previous uses: rows with an earlier one there, in earlier blocks."""
        table = table.sort_by("_p")
        return pa.table({"_i": table.column("_i"), "_across": pa.array(smaller_before(table.column("_b").to_numpy()))})

    types = dict(rows.dtypes)
    own = rows.groupBy("_b").applyInArrow(inside, ", ".join([f"`{c}` {types[c]}" for c in rows.columns] + ["_in long"]))
    again = rows.where("_p is not null")
    other = again.select("_i", "_p", "_b", "_r").groupBy("_r").applyInArrow(across, "_i long, _across long")
    # Counts of whole cells: over blocks, then over ranges.  First uses count for every later block.
    cells = rows.groupBy("_b", F.coalesce("_r", F.lit(-1)).alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    grid = rows.sparkSession.range(blocks * (blocks + 1)).select(F.floor(F.col("id") / (blocks + 1)).cast("long").alias("_b"), (F.col("id") % (blocks + 1) - 1).alias("_r"))
    earlier = lambda by, then: Window.partitionBy(by).orderBy(then).rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.join(cells, ["_b", "_r"], "left").withColumn("_n", F.sum("_n").over(earlier("_r", "_b")))
    grid = grid.withColumn("_cells", F.coalesce(F.sum("_n").over(earlier("_b", "_r")), F.lit(0))).select("_b", "_r", "_cells")
    met = own.where("_p is not null").join(grid, ["_b", "_r"]).join(other, "_i")
    first = own.where("_p is null").select(*columns, F.lit(None).cast("long").alias("distance"))
    return met.select(*columns, (F.col("_in") + F.col("_across") + F.col("_cells") - F.col("_p") - 1).alias("distance")).unionByName(first)


def suppress_lru(trace: DataFrame, capacity: int, shard: list[str], key: list[str], at: str = "event_index") -> DataFrame:
    """Hits, misses and evictions of a least-recently-used cache per shard."""
    hit = F.coalesce(F.col("distance") < capacity, F.lit(False))
    counts = reuse_distance(trace, shard, key, at).groupBy(*shard).agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.count_if(F.col("distance").isNull()).alias("_keys"))
    # What was put in and is not there at the end has been evicted.
    kept = F.least(F.lit(capacity), F.col("_keys"))
    return counts.select(*shard, "hits", "misses", F.when(F.lit(capacity > 0), F.col("misses") - kept).otherwise(0).alias("evictions"))


def chain_sums(nodes: DataFrame, key: list[str], at: str, link: str, sums: list[str]) -> DataFrame:
    """Per key the sums of ``sums`` over the nodes met from its first on, following ``link`` (the ``at`` of the next).

    Pointer doubling: each round a link reaches twice as far and has added up what it passes, so a chain takes as
    many rounds as its length has bits, and every round is one join on (key, at)."""
    found = saved(nodes.select(*key, at, F.col(link).alias("_link"), *sums), "chain")
    while not found.where("_link is not null").isEmpty():
        there = found.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col(at).alias("_at"), F.col("_link").alias("_next"), *[F.col(s).alias(f"_and_{s}") for s in sums])
        on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)], F.col("_link") == F.col("_at"))
        ended = found.where("_link is null")
        further = found.where("_link is not null").join(there, on, "left").select(*key, at, F.col("_next").alias("_link"), *[(F.col(s) + F.col(f"_and_{s}")).alias(s) for s in sums])
        found = saved(further.unionByName(ended), "chain")
    least = found.groupBy(*key).agg(F.min_by(F.struct(*sums), at).alias("_sums"))
    return least.select(*key, "_sums.*")


def _next_episode(times: DataFrame, key: list[str], at: str, after) -> DataFrame:
    """``times`` (key, at, distinct) with ``_next``: the key's least time from ``after`` on."""
    probes = times.withColumns({"_x": -after, "_probe": F.lit(1), "_seen": F.lit(None).cast("long")})
    events = times.withColumns({"_x": -F.col(at), "_probe": F.lit(0), "_seen": F.col(at)})
    both = running(events.unionByName(probes), key, ["_x", "_probe"], {"_next": ("last", "_seen")})
    return both.where("_probe = 1").drop("_x", "_probe", "_seen")


def suppress_ttl(trace: DataFrame, ttl: int, boundary: str, key: list[str], at: str = "ts_ms") -> DataFrame:
    """Episodes of a cache whose entries live ``ttl`` from insertion: (key, n, checks, expirations).

    ``boundary``: 'inclusive' ends an entry at age ttl, 'exclusive' after it.  Each time points at the first that its
    entry would no longer cover; the episodes are the chain of pointers from the key's first time.
    """
    times = trace.groupBy(*key, F.col(at).cast("long").alias("_t")).agg(F.count(F.lit(1)).alias("n"))
    linked = _next_episode(times, key, "_t", F.col("_t") + ttl + int(boundary != "inclusive"))
    checks = chain_sums(linked.withColumn("checks", F.lit(1).cast("long")), key, "_t", "_next", ["checks"])
    every = times.groupBy(*key).agg(F.sum("n").alias("n"))
    return every.join(checks, same_keys(every, checks, key)).select(*[every[k] for k in key], "n", "checks", (F.col("checks") - 1).alias("expirations"))


def suppress_second_hit(trace: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """Checks when a key is admitted at its second miss, at its first, and never (unbounded cache)."""
    counts = trace.groupBy(*dict.fromkeys([*by, *key])).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.sum(F.least(F.col("n"), F.lit(2))).alias("second_hit_checks"), F.count(F.lit(1)).alias("always_checks"), F.sum("n").alias("none_checks"))


def suppress_account_quota(trace: DataFrame, quota: int) -> DataFrame:
    """A least-recently-used cache of ``quota`` entries per account (exact while no global limit binds)."""
    return suppress_lru(trace, quota, ["account"], TUPLE)


def coalesce_batches(trace: DataFrame, width: int, key: list[str], position: str, waiters_cap: int) -> DataFrame:
    """Batches of ``width`` positions: one leader per key, the others wait."""
    groups = trace.groupBy(F.floor(F.col(position) / width).cast("long").alias("batch"), *key).agg(F.count(F.lit(1)).alias("n"))
    return groups.groupBy("batch").agg(
        F.count(F.lit(1)).alias("leaders"), F.sum(F.col("n") - 1).alias("suppressed"), F.max(F.col("n") - 1).alias("peak_waiters"), F.count_if(F.col("n") - 1 > waiters_cap).alias("cap_breaches")
    )


_COUNTERS = ["backend_checks", "base_confirmations", "race_extras", "cache_hits", "evictions", "expirations", "admitted"]


def cache_counters(rows: DataFrame, shard: list[str], key: list[str], at: str, time: str, quotas: list[int], policies: list[str], ttl: float | None = None) -> DataFrame:
    """Per shard, quota and policy what a negative cache of the shard does to ``rows`` (shard, key, at, time, extras).

    Nothing is replayed.  A cache always holds the keys used last, so an entry is there if fewer than ``quota`` other
    keys were used since; 'second_hit' is the same cache without the first requests of keys.  From one such insertion to
    the next, entries that expire follow the chain of episodes, a first time past ``ttl`` after another.
    What was inserted and is not among the last ``quota`` keys has been evicted.  ``time`` (whole numbers) counts as not
    running backwards in a shard: a null or an earlier time is the latest before it.  Rows that come with ``policy`` and
    ``distance`` (``near_requests``) are a policy's uses, and no first request of a key that it passes over is among them.
    """
    each = lambda name, values: F.explode(F.array(*map(F.lit, values))).alias(name)
    known = "distance" in rows.columns
    totals = rows.groupBy(*shard, *(["policy"] if known else [])).agg(F.count(F.lit(1)).alias("_n"), F.sum("extras").alias("_x"))
    grid = totals.select("*", each("quota", quotas)).select("*", *([] if known else [each("policy", policies)]))
    per, live, admitting = [*shard, "policy", "quota"], [q for q in quotas if q > 0], [p for p in policies if p != "none"]
    no_cache = (F.col("quota") <= 0) | (F.col("policy") == "none")
    if not live or not admitting:
        zero = F.lit(0).cast("long")
        return grid.select(*per, (F.col("_n") + F.col("_x")).alias("backend_checks"), F.col("_n").alias("base_confirmations"), F.col("_x").alias("race_extras"), *[zero.alias(c) for c in _COUNTERS[3:]])
    if known:
        used, first = rows, totals.select(*shard, F.lit(0).cast("long").alias("_first"), F.lit(0).cast("long").alias("_first_x")).distinct()
    else:
        columns = list(dict.fromkeys([*shard, *key, at, time, "extras"]))
        marked = running(rows.select(*columns).withColumn("_one", F.lit(1).cast("long")), list(dict.fromkeys([*shard, *key])), [at], {"_seen": ("sum", "_one")})
        marked = saved(marked, "cache-requests")
        first = marked.where("_seen = 1").groupBy(*shard).agg(F.count(F.lit(1)).alias("_first"), F.sum("extras").alias("_first_x"))
        used = marked.select("*", each("policy", admitting)).where("policy = 'always' or _seen > 1").drop("_one", "_seen")
    if ttl is not None:
        used = running(used, [*shard, "policy"], [at], {"_t": ("max", time)}).withColumn("_t", F.coalesce(F.col("_t").cast("long"), F.lit(-(1 << 60))))
    met = used if known else reuse_distance(used, [*shard, "policy"], key, at, [*(["_t"] if ttl is not None else []), "extras"])
    met = met.select("*", each("quota", live)).withColumn("_enters", F.coalesce(F.col("distance") >= F.col("quota"), F.lit(True)).cast("long"))
    counted = F.sum("_enters").alias("_entries"), F.count_if(F.col("distance").isNull()).alias("_keys"), F.sum(F.col("_enters") * F.col("extras")).alias("_missed_x")
    if ttl is None:
        found = met.groupBy(*per).agg(*counted).withColumn("_misses", F.col("_entries"))
    else:
        one = list(dict.fromkeys([*per, *key]))
        life, stay = int(math.floor(ttl)), [*one, "_stay"]
        met = saved(met, "cache-rows")
        entered = met.groupBy(*per).agg(*counted)
        stays = running(met, one, [at], {"_stay": ("sum", "_enters")})
        # A stay that is over within the life of its entry misses once, at its start; the others are followed.
        whole = saved(stays.groupBy(*stay).agg(F.min("_t").alias("_from"), F.max("_t").alias("_to"), F.min_by("extras", F.col(at)).alias("_missed_x")), "cache-stays")
        one_life = F.col("_to") - F.col("_from") <= life
        chains = whole.where(one_life).select(*per, F.lit(1).cast("long").alias("_misses"), "_missed_x")
        longer = whole.where(~one_life).select(*stay)
        if not longer.isEmpty():
            rows_ = stays.select(*stay, at, "_t", "extras")
            on = same_keys(rows_, longer, stay)
            times = rows_.join(longer, on, "left_semi").groupBy(*stay, "_t").agg(F.min_by("extras", at).alias("_missed_x")).withColumn("_misses", F.lit(1).cast("long"))
            followed = chain_sums(_next_episode(times, stay, "_t", F.col("_t") + life + 1), stay, "_t", "_next", ["_misses", "_missed_x"])
            chains = chains.unionByName(followed.select(*per, "_misses", "_missed_x"))
        found = entered.drop("_missed_x").join(chains.groupBy(*per).agg(F.sum("_misses").alias("_misses"), F.sum("_missed_x").alias("_missed_x")), per)
    out = grid.join(found, per, "left").join(first, shard, "left")
    second = F.when(F.col("policy") == "second_hit", 1).otherwise(0)
    held = lambda c: F.when(no_cache, 0).otherwise(F.coalesce(c, F.lit(0))).cast("long")
    misses = F.when(no_cache, F.col("_n")).otherwise(F.coalesce("_misses", F.lit(0)) + second * F.col("_first"))
    extras = F.when(no_cache, F.col("_x")).otherwise(F.coalesce("_missed_x", F.lit(0)) + second * F.col("_first_x"))
    return out.select(
        *per, (misses + extras).alias("backend_checks"), misses.alias("base_confirmations"), extras.alias("race_extras"), (F.col("_n") - misses).alias("cache_hits"),
        held(F.col("_entries") - F.least("quota", "_keys")).alias("evictions"), held(F.col("_misses") - F.col("_entries")).alias("expirations"), held(F.col("_misses")).alias("admitted"),
    )


def replay_interval(trace: DataFrame, start: int, stop: int, quota: int, policy: str, ttl: float | None, shard: list[str], key: list[str], bin_column: str = "bin", at: str = "event_index", time: str = "ts_ms", extras: str | None = None) -> DataFrame:
    """Counters of an exact negative cache per shard over the bins [start, stop), in trace order.

    Policies: 'always', 'second_hit' (admit from the second miss on) and 'none'.  A request that misses costs one
    confirmation and its ``extras`` (a column of checks that raced with it).
    """
    rows = trace.where((F.col(bin_column) >= start) & (F.col(bin_column) < stop))
    rows = rows.withColumn("extras", F.col(extras).cast("long") if extras else F.lit(0).cast("long"))
    return cache_counters(rows, shard, key, at, time, [quota], [policy], ttl).drop("quota", "policy")


#: Rows of a stretch of a trace, which ``near_requests`` looks at as one.
STRETCH = 1 << 16


def _near(previous: np.ndarray, quota: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of uses in a row, by the places of their keys' previous uses (-1: none), those that matter to a cache of up to
    ``quota`` entries: (place, distance or -1, no use before it, edge).

    They are the uses fewer than ``quota`` other keys after the previous one, with that one, and the edges: the first uses of
    the first ``quota`` keys and the last ones of the last."""
    place, piece = np.arange(len(previous)), max(64, min(2 * quota, len(previous)))
    # A gap over a whole piece of so many different keys is out.
    home = place // piece
    full = np.bincount(home, previous < home * piece) >= quota
    last = np.maximum.accumulate(np.where(full, np.arange(len(full)), -1))
    may = np.flatnonzero((previous >= 0) & (previous // piece >= np.append(-1, last)[home]))
    inside = np.bincount(previous[may], minlength=len(place) + 1) - np.bincount(may + 1, minlength=len(place) + 1)
    inside = inside[:-1].cumsum() > 0
    rank = inside.cumsum() - 1
    between = smaller_before(previous[inside])[rank[may]] - rank[previous[may]] - 1
    hit, distance = may[between < quota], np.full(len(place), -1)
    distance[hit] = between[between < quota]
    final = np.ones(len(place), bool)
    final[previous[previous >= 0]] = False
    edge = np.zeros(len(place), bool)
    edge[np.flatnonzero(previous < 0)[:quota]] = edge[np.flatnonzero(final)[-quota:]] = True
    chosen = edge.copy()
    chosen[hit] = chosen[previous[hit]] = True
    chosen = np.flatnonzero(chosen)
    return chosen, distance[chosen], previous[chosen] < 0, edge[chosen]


def _previous(codes: np.ndarray) -> np.ndarray:
    """The place of the last equal code before each, -1 if there is none."""
    order, found = np.argsort(codes, kind="stable"), np.full(len(codes), -1)
    same = codes[order[1:]] == codes[order[:-1]]
    found[order[1:][same]] = order[:-1][same]
    return found


def near_requests(rows: DataFrame, screens: DataFrame, unit, key: str, at: str, time: str, quota: int, policies: list[str], stretch: int = STRETCH) -> DataFrame:
    """Per screen and policy the requests that a cache of up to ``quota`` entries may answer and those they follow
    (screen, policy, key, at, time, extras, distance), ``at`` as positions, ``time`` as the latest so far.

    Requests left out miss, and so does each one after them.  ``screens`` (start_bin, end_bin, memory, seed, epsilon) is the
    caller's small grid; ``unit(seed)`` is what a screen holds against its epsilon, a function of the interval and ``key``.
    The requests (start_bin, end_bin, key, at, time, extras) are not multiplied by screens and policies: they lie in order,
    in stretches, and a stretch tells for each screen which of its uses have a previous one there with fewer than ``quota``
    other keys since.  Over its ends reach only uses among the first ``quota`` keys of a stretch, back to such among the
    last of an earlier one.  These edges of all stretches give the same distances below ``quota`` as the whole: of a
    stretch within the gap they hold all keys or ``quota`` of them."""
    span, screen = ["start_bin", "end_bin"], ["start_bin", "end_bin", "memory", "seed"]
    admitting, types = [p for p in policies if p != "none"], dict(rows.dtypes)
    rows = rows.select(*span, key, at, F.col(time).cast("long").alias(time), "extras").join(F.broadcast(screens.select(*span).distinct()), span, "left_semi")
    if "second_hit" in admitting:
        rows = running(rows.withColumn("_one", F.lit(1).cast("long")), [*span, key], [at], {"_seen": ("sum", "_one")}).drop("_one")
    else:
        rows = rows.withColumn("_seen", F.lit(1).cast("long"))
    lines = [tuple(r) for r in screens.select(*screen, "epsilon").collect()]
    seeds = sorted({line[3] for line in lines})
    laid = rows.repartitionByRange(width_of(rows), *span, at).sortWithinPartitions(*span, at)
    laid = laid.select(*span, key, time, "extras", "_seen", F.array(*map(unit, seeds)).alias("_unit"))
    kinds = {**types, **dict(screens.dtypes), time: "bigint"}
    names, whole = [*screen, "policy", key, at, time, "extras", "distance", "_open", "_edge"], {"int": np.int32, "bigint": np.int64}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in screen), "policy string", f"`{key}` {kinds[key]}", f"`{at}` bigint", f"`{time}` bigint", "extras bigint", "distance bigint", "_open boolean", "_edge boolean"])

    def told(table: pa.Table, base: int):
        table = table.combine_chunks()
        first, last = (table.column(c).to_numpy() for c in span)
        begins = np.flatnonzero(np.append(True, (np.diff(first) != 0) | (np.diff(last) != 0)))
        for begin, end in zip(begins, np.append(begins[1:], len(table))):
            part = table.slice(begin, end - begin)
            codes = part.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            times = part.column(time).fill_null(-(1 << 60)).to_numpy()
            units = part.column("_unit").combine_chunks().flatten().to_numpy().reshape(-1, len(seeds))
            seen = part.column("_seen").to_numpy()
            for policy in admitting:
                uses = np.flatnonzero(seen > 1) if policy == "second_hit" else np.arange(len(part))
                before = _previous(codes[uses])
                for *bins, memory, seed, epsilon in lines:
                    if bins != [first[begin], last[begin]]:
                        continue
                    through = units[uses, seeds.index(seed)] < epsilon
                    if not through.any():
                        continue
                    # A key passes at all its uses or at none.
                    own, passed = before[through], uses[through]
                    place, distance, new, edge = _near(np.where(own >= 0, (through.cumsum() - 1)[own], -1), quota)
                    picked, n = passed[place], len(place)
                    taken = part.take(pa.array(picked))
                    lists = [*(taken.column(c) for c in span), np.full(n, memory, whole[kinds["memory"]]), np.full(n, seed, whole[kinds["seed"]]), [policy] * n, taken.column(key)]
                    lists += [base + begin + picked, np.maximum.accumulate(times[passed])[place], taken.column("extras"), pa.array(distance, mask=distance < 0), new, edge]
                    yield from pa.table(dict(zip(names, lists))).combine_chunks().to_batches()

    def run(batches):
        held, size, base = [], 0, TaskContext.get().partitionId() << 40
        for b in (b.slice(k, stretch) for b in batches for k in range(0, b.num_rows, stretch)):
            held.append(b)
            size += b.num_rows
            if size >= stretch:
                yield from told(pa.Table.from_batches(held), base)
                held, size, base = [], 0, base + size
        if held:
            yield from told(pa.Table.from_batches(held), base)

    found = saved(laid.mapInArrow(run, schema), "near-requests")
    over = reuse_distance(found.where("_edge"), [*screen, "policy"], [key], at, ["_open"])
    over = over.where(F.col("_open") & (F.col("distance") < quota)).select(*screen, "policy", at, F.col("distance").alias("_over"))
    return found.join(over, [*screen, "policy", at], "left").withColumn("distance", F.coalesce("distance", "_over")).drop("_open", "_edge", "_over")


def option_table(
    trace: DataFrame, intervals: DataFrame, memories: list[int], quotas: list[int], policies: list[str], seeds: list[int], beta: float, key: str = "token_key", bin_column: str = "bin",
    ttl: float | None = None, at: str = "event_index", time: str = "ts_ms", extras: str | None = None, memory_bytes: int = 1, entry_bytes: int = 64, resource_quantum: int = 1024, compromise_quantum: float = 1.0,
) -> DataFrame:
    """Costs of screening options per interval of bins, memory, quota and policy, over seeds.

    ``intervals`` (start_bin, end_bin and, if the caller has them, occupancy and compromise) is the caller's small grid;
    occupancy defaults to the interval's identities, compromise to 1.  A screen of memory m lets an identity
    through when its sticky hash lies under epsilon = exp(-beta m / occupancy).  What passes meets a
    cache of the option's quota, policy and ``ttl`` (``cache_counters``), which is shown what it may answer (``near_requests``)
    and saves that much of the cost without a cache.  Caches that can't fill and whose entries don't
    expire need none of that: an identity then costs its requests, one or at most two of them.
    """
    extra = F.coalesce(F.col(extras).cast("long"), F.lit(0).cast("long")) if extras else F.lit(0).cast("long")
    i = intervals
    rows = trace.withColumn("extras", extra).join(i, (F.col(bin_column) >= i.start_bin) & (F.col(bin_column) < i.end_bin))
    span = ["start_bin", "end_bin"]
    size = rows.groupBy(*span).agg(F.count_distinct(key).alias("identities"))
    size = size.join(i, span)
    size = size.withColumns({c: F.col(c) if c in i.columns else d for c, d in (("occupancy", F.col("identities").cast("double")), ("compromise", F.lit(1.0)))}).select(*span, "identities", "occupancy", "compromise")
    options = lambda df: df.withColumns({"seed": F.explode(F.array(*map(F.lit, seeds)))}).withColumn("memory", F.explode(F.array(*map(F.lit, memories))))
    epsilon = F.exp(-F.lit(float(beta)) * F.col("memory") * memory_bytes / F.col("occupancy"))
    unit = S.hash32(F.concat_ws("|", F.concat_ws(":", "seed", "start_bin", "end_bin"), F.col(key))) / float(1 << 32)
    screen = [*span, "memory", "seed"]
    # Requests are aggregated per identity before options multiply them.
    ids = options(rows.groupBy(*span, key).agg(F.count(F.lit(1)).alias("n"), F.sum("extras").alias("x")).join(size, span)).where(unit < epsilon)
    sums = ids.groupBy(*screen).agg(F.sum(F.col("n") + F.col("x")).alias("none"), F.count(F.lit(1)).alias("always"), F.sum(F.least("n", F.lit(2))).alias("second_hit"), F.sum("x").alias("x"))
    # A screen that lets nothing through costs nothing; its row must not be missing.
    every = options(size).select(*screen, "identities", "occupancy", "compromise")
    grid = every.join(sums, screen, "left").withColumn("quota", F.explode(F.array(*map(F.lit, quotas)))).withColumn("policy", F.explode(F.array(*map(F.lit, policies))))
    uncached = (F.col("quota") == 0) | (F.col("policy") == "none") | F.col("none").isNull()
    closed = F.coalesce(F.col("x"), F.lit(0)) == 0
    closed = closed & (F.col("quota") >= F.col("always")) if ttl is None else F.lit(False)
    cost = F.when(F.col("none").isNull(), 0).when(uncached, F.col("none")).when(F.col("policy") == "always", F.col("always")).otherwise(F.col("second_hit"))
    grid = grid.withColumn("cost", F.when(uncached | closed, cost))
    option = [*screen, "quota", "policy"]
    grid = saved(grid, "options")
    open_ = grid.where("cost is null").select(*screen, "occupancy", (F.col("always") == F.col("identities")).alias("_all")).distinct()
    if not open_.isEmpty():
        # What passes a screen is the same for all quotas and policies, and for all screens of an interval that let everything through.
        alike = Window.partitionBy(*span, "_all").orderBy("memory", "seed").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        open_ = open_.withColumn("_as", F.when(F.col("_all"), F.first(F.struct("memory", "seed")).over(alike)).otherwise(F.struct("memory", "seed")))
        own = (F.col("_as.memory") == F.col("memory")) & (F.col("_as.seed") == F.col("seed"))
        screens = open_.where(own).select(*screen, epsilon.alias("epsilon"))
        sticky = lambda seed: S.hash32(F.concat_ws("|", F.concat_ws(":", F.lit(seed), "start_bin", "end_bin"), F.col(key))) / float(1 << 32)
        through = near_requests(rows, screens, sticky, key, at, time, max(1, *quotas), policies, STRETCH)
        shown = through.groupBy(*screen, "policy").agg(F.sum(1 + F.col("extras")).alias("_shown"))
        found = cache_counters(through, screen, [key], at, time, quotas, policies, ttl).join(shown, [*screen, "policy"])
        found = found.select(*option, (F.col("_shown") - F.col("backend_checks")).alias("_saved"))
        found = found.withColumnsRenamed({"memory": "_m", "seed": "_s"}).join(open_.select(*screen, "_as"), span)
        found = found.where((F.col("_as.memory") == F.col("_m")) & (F.col("_as.seed") == F.col("_s"))).drop("_m", "_s", "_as")
        grid = grid.join(found, option, "left").withColumn("cost", F.coalesce("cost", F.col("none") - F.coalesce("_saved", F.lit(0)))).drop("_saved")
    total = F.col("memory") * memory_bytes + F.col("quota") * entry_bytes
    out = grid.groupBy(*span, "memory", "quota", "policy").agg(
        F.avg("cost").alias("mean_cost"), (F.stddev_samp("cost") / F.sqrt(F.count(F.lit(1)))).alias("stderr"), F.sort_array(F.collect_list("cost")).alias("seed_costs"), F.max(epsilon).alias("epsilon"), F.max("compromise").alias("_c")
    )
    return out.withColumns(
        {"memory_quanta": F.ceil(total / resource_quantum), "compromise_mass": F.col("_c") * F.col("epsilon"), "compromise_quanta": F.floor(F.col("_c") * F.col("epsilon") / compromise_quantum + 1e-12)}
    ).drop("_c")


def chronological_split(trace: DataFrame, at: str = "event_index", train: float = 0.5, validation: float = 0.7) -> DataFrame:
    """Roles by the share of the trace before a row.  Positions come from ranges of equally many rows, so neither a
    window spans the table nor does it matter how the ordering column is spread."""
    rows = numbered(trace.select(at), [at], "_i")
    fraction = F.col("_i") / F.lit(max(1, rows.count()))
    return rows.select(at, fraction.alias("fraction")).withColumn("role", F.when(F.col("fraction") < train, "train").when(F.col("fraction") < validation, "validation").otherwise("test"))


def epoch_regression(acks: DataFrame, keys: list[str], at: str, epochs: list[str]) -> DataFrame:
    """Acknowledgements that fall behind an earlier one of the same key in any epoch."""
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    back = F.lit(False)
    for e in epochs:
        back = back | F.coalesce(F.col(e) < F.max(e).over(w), F.lit(False))
    return acks.withColumn("regressed", back).where("regressed").drop("regressed")


# The order of a delta's states.
LIFECYCLE = ("PREPARED", "EDGE_DELTA_READY", "ACTIVE", "COMPACTED", "RETIRED")


def lifecycle_audit(log: DataFrame, key: list[str], at: str, status: str = "status") -> DataFrame:
    """Transitions of each key with whether the step is legal: one state on, from the first."""
    order = F.array(*map(F.lit, LIFECYCLE))
    place = F.array_position(order, F.col(status))
    before = F.coalesce(F.lag(place).over(Window.partitionBy(*key).orderBy(at)), F.lit(0))
    return log.withColumn("legal", (place > 0) & (place == before + 1))


def acknowledged(required: DataFrame, acked: DataFrame, key: list[str]) -> DataFrame:
    """Keys with the required edges that have not acknowledged."""
    r = required.groupBy(*key).agg(F.collect_set("edge").alias("required"))
    a = acked.groupBy(*key).agg(F.collect_set("edge").alias("acked"))
    missing = F.array_except("required", F.coalesce("acked", F.array().cast("array<string>")))
    return r.join(a, key, "left").select(*key, F.array_sort(missing).alias("missing"), (F.size(missing) == 0).alias("complete"))


def version_monotonicity(log: DataFrame, key: list[str], at: str) -> DataFrame:
    """Rows of a directory log whose generation falls, or whose version falls within a generation."""
    w = Window.partitionBy(*key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    g, v = F.max("generation").over(w), F.max("version").over(Window.partitionBy(*key, "generation").orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    return log.withColumns({"generation_falls": F.coalesce(F.col("generation") < g, F.lit(False)), "version_falls": F.coalesce(F.col("version") <= v, F.lit(False))})


def nonmonotone_curve(points: DataFrame, curve: list[str], load: str, passed: str) -> DataFrame:
    """Points that pass above a load that failed."""
    failed_before = F.max(F.when(F.col(passed), 0).otherwise(1)).over(Window.partitionBy(*curve).orderBy(load).rowsBetween(Window.unboundedPreceding, -1))
    return points.withColumn("_failed", failed_before).where(F.col(passed) & (F.col("_failed") == 1)).drop("_failed")


def sticky_accounting(trace: DataFrame, identity: list[str]) -> DataFrame:
    """Per identity: multiplicity, episodes, evictions, races, checks and their bound, and faults.

    Columns of ``trace``: the identity, ``pos``, ``positive``, ``episode``, ``race_extras``.
    """
    w = Window.partitionBy(*identity).orderBy("pos")
    rows = trace.withColumns(
        {
            "starts": F.col("positive") & (F.row_number().over(Window.partitionBy(*identity, "episode", "positive").orderBy("pos")) == 1),
            "changes": F.col("positive") & ~F.col("episode").eqNullSafe(F.lag(F.when(F.col("positive"), F.col("episode")), 1).over(w)),
        }
    )
    positive = F.max(F.col("positive"))
    episodes = F.count_if("starts")
    races = F.sum(F.when(F.col("starts"), F.col("race_extras")).otherwise(0))
    out = rows.groupBy(*identity).agg(
        F.count(F.lit(1)).alias("multiplicity"), positive.alias("positive"), episodes.alias("episodes"), races.alias("race_extras"),
        (F.min("positive") != F.max("positive")).alias("not_sticky"),
        (F.count_if("changes") > episodes).alias("recurring_episode"),
        (F.count_if((F.col("race_extras") > 0) & ~F.col("starts")) > 0).alias("misplaced_extras"),
    )
    on = F.col("positive").cast("long")
    return out.withColumns(
        {
            "evictions": F.greatest(F.lit(0), F.col("episodes") - 1),
            "static_checks": F.col("multiplicity") * on,
            "adaptive_checks": (F.col("episodes") + F.col("race_extras")) * on,
            "upper_bound": on * (1 + F.greatest(F.lit(0), F.col("episodes") - 1) + F.col("race_extras")),
        }
    )


def route_attempts(attempts: DataFrame) -> DataFrame:
    """The route of each attempt through the checks, in order of precedence.

    Columns: event_index, the tuple, status, covered, represented, result.  An uncertain directory or
    certificate fails open; a tuple the backend has denied before (under a certain directory) is
    rejected by the cache; a certified screen without the token rejects; the rest goes to the backend.
    """
    present = F.col("status") == "PRESENT"
    learns = present & ~(F.col("covered") & ~F.col("represented")) & (F.col("result") == "CREDENTIAL_MISMATCH")
    before = Window.partitionBy(*TUPLE).orderBy("event_index").rowsBetween(Window.unboundedPreceding, -1)
    known = F.coalesce(F.max(learns).over(before), F.lit(False))
    route = (
        F.when(~present, FAIL_OPEN).when(F.col("known"), CACHE_REJECT).when(F.col("covered") & ~F.col("represented"), SCREEN_REJECT)
        .when(~F.col("covered"), FAIL_OPEN).when(F.col("result") == "MATCH", MATCHED).otherwise(DENIED)
    )
    return attempts.withColumn("known", known).withColumn("route", route)
