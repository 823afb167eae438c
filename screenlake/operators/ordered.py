"""Running values over orderings of any size and skew.

A window keeps a group in one task.  Here only groups of ordinary size are left to one: a group of more than
1/256 of all rows (there are at most 256 such) is cut into slices of its ordering, each slice is a window of
its own, and one line per slice carries the values on.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import saved

#: A group is cut if it has more than this share of all rows and so many at least.
HOT_SHARE, HOT_ROWS = 256, 100_000


def width_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]):
    """Equality of the keys of two tables, null equal to null."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def numbered(rows: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """``rows`` with their positions from 0 in ``order``, without gaps.

    Sorted by ranges and written once; what the ranges tell each other is a count each."""
    laid = rows.repartitionByRange(width_of(rows), *[F.col(c) for c in order]).sortWithinPartitions(*order)
    laid = saved(laid.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33)
    sizes = sorted(tuple(r) for r in laid.groupBy(part.alias("p")).agg(F.count(F.lit(1))).collect())
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    lines = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "_part long, _before long")
    return laid.withColumn("_part", part).join(F.broadcast(lines), "_part").withColumn(name, F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_part", "_before", "_id")


_LOCAL = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}


def running(rows: DataFrame, group: list[str], order: list[str], values: dict[str, tuple[str, str]], before: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` with running ``values`` (new column: ('sum' | 'min' | 'max' | 'last', column)) of their group in
    ``order``, up to the row, or with ``before`` up to the row before it; 'last' is the last value that is not null.

    ``order`` starts with a number or a time, by whose quantiles large groups are cut.  Without ``group`` the whole
    table is one."""
    reach = lambda w: w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    local = {name: _LOCAL[kind](column) for name, (kind, column) in values.items()}
    counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    large = counts.where((F.col("_n") > hot_rows) & (F.col("_n") * HOT_SHARE > total)).collect() if total > hot_rows else []
    if not large:
        return rows.withColumns({name: v.over(reach(Window.partitionBy(*group))) for name, v in local.items()})
    spark, types = rows.sparkSession, dict(rows.dtypes)
    schema = ", ".join([f"`_g{i}` {types[g]}" for i, g in enumerate(group)] + ["_hot boolean"])
    keys = spark.createDataFrame([(*(r[g] for g in group), True) for r in large], schema)
    on = reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)], F.lit(True))
    marks = [k / HOT_SHARE for k in range(1, HOT_SHARE)]
    hot = rows.join(F.broadcast(keys), on)
    cuts = hot.groupBy(*[f"_g{i}" for i in range(len(group))]).agg(F.percentile_approx(order[0], marks, 10_000).alias("_cuts"))
    # At most 256 lines of 255 numbers.
    lines = spark.createDataFrame(cuts.collect(), cuts.schema)
    slice_ = F.size(F.filter("_cuts", lambda c: c < F.col(order[0])))
    rows = rows.join(F.broadcast(lines), on, "left").withColumn("_slice", F.when(F.col("_cuts").isNotNull(), slice_).otherwise(-1)).drop("_cuts", *[f"_g{i}" for i in range(len(group))])
    rows = rows.withColumns({name: v.over(reach(Window.partitionBy(*group, "_slice"))) for name, v in local.items()})
    place = F.struct(*order)
    whole = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), place))}
    ends = rows.where("_slice >= 0").groupBy(*group, "_slice").agg(*[whole[kind](column).alias(f"_to_{name}") for name, (kind, column) in values.items()])
    w = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_slice").alias("_s"), *[_LOCAL[kind](f"_to_{name}").over(w).alias(f"_to_{name}") for name, (kind, _) in values.items()])
    # At most 256 groups of 256 slices.
    met = rows.join(F.broadcast(ends), on & (F.col("_slice") == F.col("_s")), "left")

    def joined(name: str, kind: str):
        here, so_far = F.col(name), F.col(f"_to_{name}")
        if kind == "last":
            return F.coalesce(here, so_far)
        if kind == "sum":
            return F.when(here.isNull(), so_far).when(so_far.isNull(), here).otherwise(here + so_far)
        return (F.least if kind == "min" else F.greatest)(here, so_far)

    return met.withColumns({name: joined(name, kind) for name, (kind, _) in values.items()}).drop("_slice", "_s", *[f"_g{i}" for i in range(len(group))], *[f"_to_{n}" for n in values])


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each element how many earlier ones are smaller: one stable split per bit of the ranks, each a cumulative sum."""
    n = len(values)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((-np.arange(n), values))] = np.arange(n)  # of equal ones the later is the smaller, so none counts
    found, order = np.zeros(n, np.int64), np.arange(n)
    for bit in range(max(n - 1, 1).bit_length() - 1, -1, -1):
        group, high = rank[order] >> (bit + 1), (rank[order] >> bit) & 1
        zeros = np.cumsum(1 - high)
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        base = np.repeat(zeros[starts] - (1 - high[starts]), np.diff(starts, append=n)) if n else zeros
        found[order[high == 1]] += (zeros - base)[high == 1]
        order = order[np.argsort(rank[order] >> bit, kind="stable")]
    return found
