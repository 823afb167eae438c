"""Exact top-k inner products by norm-bucketed retrieval.

Vectors become integers, floor(256 x) of each component.  The vectors of an Arrow batch are sorted by
length and cut into buckets.  For a query whose k-th best score so far is t, a bucket with greatest length L
can only hold better vectors if |q| L >= t, and then only those whose cosine with the query
reaches the bucket's local threshold t / (|q| L):

* buckets that cannot reach t are skipped (length pruning);
* a high local threshold bounds the coordinate where the query is largest to an interval, found by
  halving in the bucket's sorted coordinate; only vectors inside are taken (coordinate pruning);
* a low one would keep most of the bucket, so all of its vectors are taken.

Products of what is left are verified in exact integers.  Starting thresholds come from a bounded
set of the longest vectors, so the first bucket already prunes.

Queries go in rounds of a bounded number, the only thing broadcast; the vectors are scanned in
parallel without a shuffle, and a task returns at most k rows per query.

Defined results: vectors that are null or hold a null or non-finite component take no part; only
vectors of one dimension meet; rows with the query's own id are no candidates; an id that repeats
among the queries is one query (its smallest vector), among candidates each row counts; fewer
candidates give fewer rows; an empty table gives no rows; other columns are ignored.  Products are exact at
every size; past a long's range they count as its ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, saved

QUERIES_PER_ROUND = 8192
LONGEST = 2048
BUCKET = 1024
SCALE = 256
#: Coordinate pruning pays while its interval holds at most this share of a bucket: a row taken by itself
#: costs some thirty times what it costs in a product of matrices.
WORTH = 1 / 32


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): the vectors that take part, as doubles."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(~odd)


#: Below this size sums of products held as doubles are exact.
EXACT = 2.0**52
_MOST = (1 << 63) - 1


def _whole(flat: np.ndarray) -> np.ndarray:
    return np.floor(flat * SCALE)


def _by_dimension(ids: np.ndarray, column: pa.Array):
    """(dimension, ids, matrix of whole numbers held as doubles) for each dimension of a batch."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    for d in np.unique(size).tolist():
        pick = np.nonzero(size == d)[0]
        yield d, ids[pick], _whole(flat[(ends[pick] - d)[:, None] + np.arange(d)])


class Best:
    """The k best of each query so far, and the score a candidate must reach."""

    def __init__(self, ids: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.k, self.least = ids, k, floor.copy()
        self.query = self.score = self.vec = np.empty(0, np.int64)

    def take(self, query: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        """Offers of a whole bucket.  Only the lists of queries with an offer are sorted again."""
        good = (score >= self.least[query]) & (vec != self.ids[query])
        if not good.any():
            return
        asked = np.zeros(len(self.ids), bool)
        asked[query[good]] = True
        again = asked[self.query]
        rest = [x[~again] for x in (self.query, self.score, self.vec)]
        query, score, vec = (np.concatenate((a[again], b[good])) for a, b in ((self.query, query), (self.score, score), (self.vec, vec)))
        order = np.lexsort((vec, -score, query))
        query, score, vec = query[order], score[order], vec[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        self.query, self.score, self.vec = (np.concatenate((a, b[keep])) for a, b in zip(rest, (query, score, vec)))
        last = rank == self.k - 1
        self.least[query[last]] = np.maximum(self.least[query[last]], score[last])


def _products(x: np.ndarray, q: np.ndarray, bound: float) -> np.ndarray:
    """Row by row inner products as longs; past what doubles hold exactly, by whole numbers of any size."""
    if bound < EXACT:
        return np.einsum("ij,ij->i", x, q).astype(np.int64)
    return np.array([max(-_MOST, min(_MOST, sum(int(a) * int(b) for a, b in zip(u, v)))) for u, v in zip(x.tolist(), q.tolist())], np.int64)


def _intervals(bucket, norm, at_focus, focus, local, live):
    """Coordinate pruning: (query, first, last, rows in order) of the queries whose focus coordinate leaves few rows."""
    # Feasible interval of the focus coordinate of unit vectors with cosine >= local.
    wide = np.sqrt(np.maximum(0.0, (1 - local**2) * (1 - at_focus**2))) + 1e-9
    low, high = local * at_focus - wide, local * at_focus + wide
    # Cosines above the threshold shift the centre outwards: to the far end where it can be reached.
    low = np.where((at_focus < 0) & (-at_focus >= local), -1.0, low)
    high = np.where((at_focus > 0) & (at_focus >= local), 1.0, high)
    for f in np.unique(focus[local > 0]).tolist():
        mine = np.nonzero((focus == f) & (local > 0))[0]
        line = bucket[:, f] / np.maximum(norm, 1e-12)
        by = np.argsort(line, kind="stable")
        a, b = (np.searchsorted(line[by], edge[mine], side) for edge, side in ((low, "left"), (high, "right")))
        few = (b - a) <= WORTH * len(by)
        yield live[mine[few]], a[few], np.maximum(a, b)[few], by


def scan(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, best: Best) -> None:
    """Offer the vectors of one block to every query, bucket by bucket."""
    norm, qnorm = np.sqrt((x * x).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
    order = np.argsort(-norm, kind="stable")
    unit_q = queries / np.maximum(qnorm, 1e-12)[:, None]
    focus = np.abs(unit_q).argmax(axis=1) if queries.shape[1] else np.zeros(len(queries), int)
    at_focus = unit_q[np.arange(len(queries)), focus] if queries.shape[1] else np.zeros(len(queries))
    for start in range(0, len(order), BUCKET):
        rows = order[start : start + BUCKET]
        bucket, longest = x[rows], norm[rows[0]]
        # Length pruning; the slack covers rounding of the lengths.
        live = np.nonzero(qnorm * longest * (1 + 1e-9) + 1e-6 >= best.least)[0]
        if not len(live):
            continue
        bound = float(longest * qnorm[live].max())
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(qnorm[live] * longest > 0, best.least[live] / (qnorm[live] * longest), -1.0)
        local = np.clip(local - 1e-9, -1.0, 1.0)
        near, offers = np.zeros(len(queries), bool), []
        if queries.shape[1]:
            for who, first, last, by in _intervals(bucket, norm[rows], at_focus[live], focus[live], local, live):
                near[who] = True
                n = last - first
                for part in np.array_split(np.arange(len(who)), max(1, int(n.sum()) >> 15)):
                    q = np.repeat(who[part], n[part])
                    inside = np.arange(len(q)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
                    r = by[np.repeat(first[part], n[part]) + inside]
                    offers.append((q, _products(bucket[r], queries[q], bound), ids[rows[r]]))
        full = live[~near[live]]
        for part in range(0, len(full), 2048):
            q = full[part : part + 2048]
            score = bucket @ queries[q].T
            r, c = np.nonzero(score >= best.least[q][None, :] - (0 if bound < EXACT else bound * 1e-12))
            if len(r):
                exact = score[r, c].astype(np.int64) if bound < EXACT else _products(bucket[r], queries[q[c]], bound)
                offers.append((q[c], exact, ids[rows[r]]))
        if offers:
            best.take(*map(np.concatenate, zip(*offers)))


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, queries_per_round: int = QUERIES_PER_ROUND) -> DataFrame:
    """The k best candidates of each row whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    asked = saved(
        rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x")).withColumn("lot", F.monotonically_increasing_id()), "topk-queries"
    )
    rounds = max(1, -(-asked.count() // queries_per_round))
    # At most LONGEST rows come to the driver.
    length = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    longest = rows.orderBy(F.desc(length), "vec_id").limit(LONGEST).toArrow().combine_chunks()
    start = {d: (ids, x) for d, ids, x in _by_dimension(longest["vec_id"].to_numpy(), _one(longest["x"]))} if longest.num_rows else {}
    found = []
    for turn in range(rounds):
        # At most about queries_per_round rows: the bound of what is broadcast.
        lot = asked.where(F.pmod(F.xxhash64("lot"), F.lit(rounds)) == turn).select("vec_id", "x").toArrow().combine_chunks()
        if not lot.num_rows:
            continue
        groups = {}
        for d, ids, q in _by_dimension(lot["vec_id"].to_numpy(), _one(lot["x"])):
            best = Best(ids, np.full(len(ids), -np.inf), k)
            if d in start:
                scan(start[d][1], start[d][0], q, best)
            groups[d] = (ids, q, best.least)
        found.append(saved(_round(spark, rows, groups, k), "topk-round"))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    every_round = found[0]
    for other in found[1:]:
        every_round = every_round.unionByName(other)
    return every_round


def _one(column) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column if not isinstance(column, pa.ChunkedArray) else column.chunk(0)


def _round(spark, rows: DataFrame, groups: dict, k: int) -> DataFrame:
    sent = spark.sparkContext.broadcast(groups)

    def run(batches):
        groups = sent.value
        best = {d: Best(ids, least, k) for d, (ids, _, least) in groups.items()}
        for b in batches:
            for d, ids, x in _by_dimension(b.column(0).to_numpy(), b.column(1)):
                if d in groups:
                    scan(x, ids, groups[d][1], best[d])
        for d, one in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(one.ids[one.query], pa.int64()), pa.array(one.vec, pa.int64()), pa.array(one.score, pa.int64())], ["query_id", "vec_id", "score"])

    hits = in_batches(rows).mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
