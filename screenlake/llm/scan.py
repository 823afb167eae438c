"""Running sums over a whole ordering, whose groups may be of any size.

A window keeps a group in one task.  Here rows are sorted by ranges, each task sums its own range, and one
line per range (how its first and last groups stand) carries the sums on: a group of a third of all rows
spreads over a third of the ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, to_shuffle_width


def running_sums(rows: DataFrame, group: list[str], order: list[str], sums: dict[str, str], name: str) -> DataFrame:
    """``rows`` with ``sums`` (new column: column of longs without nulls), each summed from its group's first row in
    ``order`` up to the row itself, and ``_range``, the range that held it.

    What the ranges tell each other is one line each, so it is bounded by the session's shuffle width.  Rows that are
    equal in group and order may come either way, so they should be equal in the summed columns too."""
    columns, new = rows.columns, list(sums)
    fields = [f"`{c}` {t}" for c, t in rows.dtypes] + [f"`{c}` long" for c in new] + ["_range int", "_opens boolean", "_closes boolean"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: pa.RecordBatch | None = None  # the last batch is known to be last only at the end
        before, so_far, opens = None, np.zeros(len(new), np.int64), True

        def finish(batch: pa.RecordBatch, last: bool) -> pa.RecordBatch:
            closes = np.zeros(batch.num_rows, bool)
            closes[-1] = last
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(closes)], [*batch.schema.names, "_closes"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts = np.zeros(n, bool)
            for g in group:
                c = batch.column(columns.index(g))
                if n > 1:
                    a, b = c.slice(1), c.slice(0, n - 1)
                    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
                    starts[1:] |= ~same.to_numpy(zero_copy_only=False)
            head = tuple(batch.column(columns.index(g))[0].as_py() for g in group)
            starts[0] = before is None or head != before
            before = tuple(batch.column(columns.index(g))[n - 1].as_py() for g in group)
            at = np.maximum.accumulate(np.where(starts, np.arange(n), -1))  # the row's group starts here, -1: earlier
            totals = []
            for k, c in enumerate(sums.values()):
                run_ = np.cumsum(batch.column(columns.index(c)).to_numpy(zero_copy_only=False).astype(np.int64))
                base = np.where(at > 0, run_[np.maximum(at - 1, 0)], 0)
                totals.append(run_ - base + np.where(at < 0, so_far[k], 0))
            # The first row of a range starts a group but may belong to one that began in the range before.
            first = opens & (np.cumsum(starts) - (1 if starts[0] and held is None else 0) == 0)
            opens = bool(first[-1])
            so_far = np.array([t[-1] for t in totals], np.int64)
            told = pa.RecordBatch.from_arrays(
                [*batch.columns, *map(pa.array, totals), pa.array(np.full(n, task, np.int32)), pa.array(first)], [*columns, *new, "_range", "_opens"]
            )
            if held is not None:
                yield finish(held, False)
            held = told
        if held is not None:
            yield finish(held, True)

    keys = [F.col(f"`{c}`") for c in [*group, *order]]
    sorted_ = rows.repartitionByRange(to_shuffle_width(rows), *keys).sortWithinPartitions(*keys)
    found = saved(sorted_.mapInArrow(run, ", ".join(fields)), name)
    ends = sorted(found.where("_closes").select("_range", "_opens", *group, *new).collect(), key=lambda r: r["_range"])
    heads = {r["_range"]: tuple(r[g] for g in group) for r in found.where("_opens").groupBy("_range").agg(*[F.first(g).alias(g) for g in group]).collect()} if group else {r["_range"]: () for r in ends}
    carried, key, standing = [], None, [0] * len(new)
    for end in ends:
        if heads[end["_range"]] != key:
            standing = [0] * len(new)
        if any(standing):
            carried.append((end["_range"], *standing))
        # Whole range one group: what was carried in goes on; else only what the last group has here.
        standing = [(s if end["_opens"] else 0) + end[c] for s, c in zip(standing, new)]
        key = tuple(end[g] for g in group)
    spark = rows.sparkSession
    lines = spark.createDataFrame(carried, "_range int, " + ", ".join(f"`_carried_{c}` long" for c in new))
    met = found.join(F.broadcast(lines), "_range", "left")
    add = {c: F.col(f"`{c}`") + F.when(F.col("_opens"), F.coalesce(F.col(f"`_carried_{c}`"), F.lit(0))).otherwise(F.lit(0)) for c in new}
    return met.withColumns(add).select(*[f"`{c}`" for c in columns], *[f"`{c}`" for c in new], "_range")
