"""The trie of conversation prefixes, summed over subtrees by the Euler-tour technique.

A node is a distinct sequence of first turns; its members are the conversations that start with it.  The
tour enters a node, goes through its children in turn and leaves it: two arcs a node, whose successors
follow from the node's own line.  The tour is one linked list of any length.  It is ranked by contraction:
each round takes out the arcs whose hash is greater than both neighbours' (a third of them, never two in a
row), each of which tells its neighbours; what is left when a few thousand arcs remain is walked, and the
rounds are undone in reverse.  With each arc's position, a subtree's sums are the difference of two prefix
sums over the tour.

Nothing is grouped whole: a prefix's identity is a running sum of four 32-bit hashes of its turns' digests
and depths (128 bits), a parent passes its line on to its children by a running sum too, and running sums run
over sorted ranges (``scan``), so a conversation, a parent or an end of a third of all rows spreads over tasks.
The members that end at a node are digested from chunks of their sorted ids.

Defined results: rows without conv_id take no part; turns go by turn (null first), rows of one turn by role,
then by the SHA-256 of role and text; null role and text count as empty; repeated rows are turns of
their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, saved
from .scan import running_sums

#: A list of at most so many arcs is ranked at once.
SHORT_LIST = 4096
#: Ids of members in one chunk, which bounds what a task holds of a node's members.
CHUNK = 8192
KEY = ["s1", "s2", "s3", "s4"]
_EMPTY = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """Turns without their texts: conv_id, place (from 1), digest, bytes (of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"), F.lit(1).cast("long").alias("one")
    )
    return running_sums(rows.where("conv_id is not null"), ["conv_id"], ["turn", "role", "digest"], {"place": "one"}, "trie-turns").select("conv_id", "place", "digest", "bytes")


def with_shared_heads(turns: DataFrame, block: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that start alike, as regenerated answers do: (conversations, turns).

    Of ``ordered_turns``, conversation c keeps what follows its first h turns and gets in their stead the first h turns
    of conversation c - c % block, or as many as that has; h = crc32(decimal c) % most."""
    h = F.crc32(F.col("conv_id").cast("string")) % most
    ids = saved(turns.groupBy("conv_id").agg(F.lit(0).cast("long").alias("zero")), "trie-ids")
    asked = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % block).alias("_base"), h.alias("_h")).where("_h > 0")
    heads = turns.where(F.col("place") < most).withColumnRenamed("conv_id", "_base")
    head = asked.join(heads, "_base").where("place <= _h").select("conv_id", F.lit(0).alias("own"), "place", "digest", "bytes")
    rest = turns.where(F.col("place") > h).select("conv_id", F.lit(1).alias("own"), "place", "digest", "bytes")
    rows = head.unionByName(rest).withColumn("one", F.lit(1).cast("long"))
    return ids.select("conv_id"), running_sums(rows, ["conv_id"], ["own", "place"], {"depth": "one"}, "trie-rebuilt").select("conv_id", F.col("depth").alias("place"), "digest", "bytes")


def trie_nodes(conversations: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of ``turns`` (conv_id, place, digest, bytes) of ``conversations`` (conv_id).

    A node: depth, its key, its parent's key (p1 to p4), conv_id (its smallest member), n_convs, bytes (of its last
    text), n_children.  An end: conv_id with the depth and key of its last node."""
    two = [F.xxhash64(F.lit(k), "place", "digest") for k in (1, 2)]
    parts = [x for h in two for x in (h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32))]
    rows = turns.select("conv_id", F.col("place").alias("depth"), "bytes", *[p.cast("long").alias(f"f{k}") for k, p in enumerate(parts, 1)])
    rows = running_sums(rows, ["conv_id"], ["depth"], {k: f"f{k[1]}" for k in KEY}, "trie-prefixes")
    least = F.min("conv_id").alias("conv_id")
    nodes = rows.groupBy("depth", *KEY).agg(least, F.count(F.lit(1)).alias("n_convs"), F.first("bytes").alias("bytes"), *[F.first(F.col(k) - F.col(f"f{k[1]}")).alias(f"p{k[1]}") for k in KEY])
    zeros = [F.lit(0).cast("long").alias(c) for c in ("depth", *KEY)]
    root = conversations.agg(least, F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    nodes = nodes.unionByName(root.select(*zeros, "conv_id", "n_convs", F.lit(0).cast("long").alias("bytes"), *[F.lit(-1).cast("long").alias(f"p{k[1]}") for k in KEY]))
    nodes = saved(nodes, "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *[F.col(f"p{k[1]}").alias(k) for k in KEY]).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = saved(nodes.join(children, ["depth", *KEY], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-parents")
    last = rows.groupBy("conv_id").agg(F.max(F.struct("depth", *KEY)).alias("last")).select("conv_id", "last.*")
    turnless = conversations.join(last, "conv_id", "left_anti").select("conv_id", *zeros)
    return nodes, last.unionByName(turnless)


def families(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Every node beside its parent's line, and every end beside its node's: a parent's line leads its children and its
    ends, and running sums carry it on.

    ``kind`` 1 is a child (depth, conv_id, its own line, ``parent``, ``n_brothers`` and ``k``, its place among them),
    2 an end (conv_id) at the node ``parent`` of depth ``depth`` - 1, with ``k`` rising by one from end to end."""
    none, zero, one = F.lit(None).cast("long"), F.lit(0).cast("long"), F.lit(1).cast("long")
    own = ["n_convs", "bytes", "n_children"]
    line = nodes.select("depth", *KEY, F.lit(0).alias("kind"), zero.alias("conv_id"), F.col("conv_id").alias("_up"), F.col("n_children").alias("_of"), zero.alias("_k"), *[none.alias(c) for c in own])
    parent_key = [F.col(f"p{k[1]}").alias(k) for k in KEY]
    child = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), *parent_key, F.lit(1).alias("kind"), "conv_id", zero.alias("_up"), zero.alias("_of"), one.alias("_k"), *own)
    end = ends.select("depth", *KEY, F.lit(2).alias("kind"), "conv_id", zero.alias("_up"), zero.alias("_of"), one.alias("_k"), *[none.alias(c) for c in own])
    rows = running_sums(line.unionByName(child).unionByName(end), ["depth", *KEY], ["kind", "conv_id"], {"parent": "_up", "n_brothers": "_of", "k": "_k"}, "trie-families")
    return rows.where("kind > 0").select("kind", "conv_id", (F.col("depth") + 1).alias("depth"), "parent", "n_brothers", "k", *own)


def tour(nodes: DataFrame) -> DataFrame:
    """The arcs of the Euler tour of ``nodes`` (conv_id, depth, parent, k, n_brothers, n_convs, bytes, n_children; the
    root alone has depth 0): arc, next (null at the end), conv_id, depth, enters, and what the arc weighs: leaf, cost.

    Entering a node is named by depth, parent and place among its siblings, leaving it by depth and conv_id, so
    that a node's own line tells what follows both."""

    def named(a, b, c):
        return F.struct(*[F.lit(x).cast("long").alias(n) if isinstance(x, int) else x.alias(n) for x, n in zip((a, b, c), "abc")])

    d, conv, parent, k, brothers, children = (F.col(c) for c in ("depth", "conv_id", "parent", "k", "n_brothers", "n_children"))
    enter, leave = named(d * 2, parent, k), named(d * 2 + 1, conv, 0)
    after_enter = F.when(children > 0, named(d * 2 + 2, conv, 1)).otherwise(leave)
    after_leave = F.when(k < brothers, named(d * 2, parent, k + 1)).when(d > 0, named(d * 2 - 1, parent, 0))
    leaf, cost, zero = (children == 0).cast("long"), (F.col("n_convs") - 1) * F.col("bytes"), F.lit(0).cast("long")
    into = nodes.select(enter.alias("arc"), after_enter.alias("next"), "conv_id", "depth", F.lit(True).alias("enters"), leaf.alias("leaf"), cost.alias("cost"))
    return into.unionByName(nodes.select(leave.alias("arc"), after_leave.alias("next"), "conv_id", "depth", F.lit(False).alias("enters"), zero.alias("leaf"), zero.alias("cost")))


def list_rank(arcs: DataFrame, short: int = SHORT_LIST) -> DataFrame:
    """Positions (arc, position from 0) in one linked list of any length, given as (arc, next), next null at the end.

    Each round shuffles the arcs that are left, a third of which leave: all rounds together move some three times
    the list, and undoing them as much again.  At most ``short`` arcs are walked on the driver."""
    kind, short = dict(arcs.dtypes)["arc"], max(2, short)  # the first and the last arc never leave
    null = F.lit(None).cast(kind)

    def sent(rows: DataFrame, to: str, next_=null, prev=null, w=None) -> DataFrame:
        """Messages: your next, or the one before you, is now another; you are ``w`` farther from the one before."""
        return rows.select(F.col(to).alias("arc"), null.alias("next"), null.alias("prev"), next_.alias("new_next"), prev.alias("new_prev"), (F.lit(0) if w is None else F.col(w)).cast("long").alias("w"))

    def meet(lines: DataFrame, step: int, *messages: DataFrame) -> DataFrame:
        """Lines (arc, next, prev, w: the distance from prev) after their messages, and whether each leaves now."""
        rows = lines.select("arc", "next", "prev", null.alias("new_next"), null.alias("new_prev"), "w")
        for m in messages:
            rows = rows.unionByName(m)
        told = [F.first(c, ignorenulls=True).alias(c) for c in ("next", "prev", "new_next", "new_prev")]
        rows = rows.groupBy("arc").agg(*told, F.sum("w").alias("w")).select("arc", F.coalesce("new_next", "next").alias("next"), F.coalesce("new_prev", "prev").alias("prev"), "w")
        own, before, after = (F.xxhash64(F.lit(step), c) for c in ("arc", "prev", "next"))
        leaves = F.col("prev").isNotNull() & F.col("next").isNotNull() & (own > before) & (own > after)
        return saved(rows.withColumn("leaves", leaves), "trie-list")

    lines = arcs.select("arc", "next", null.alias("prev"), F.lit(1).cast("long").alias("w"))
    rounds = [meet(lines, 0, sent(arcs.where("next is not null"), "next", prev=F.col("arc")))]
    while (left := rounds[-1].where("not leaves")).count() > short:
        gone = rounds[-1].where("leaves")
        rounds.append(meet(left, len(rounds), sent(gone, "prev", next_=F.col("next")), sent(gone, "next", prev=F.col("prev"), w="w")))
    gone = rounds[-1].where("leaves")
    rest = meet(left, len(rounds), sent(gone, "prev", next_=F.col("next")), sent(gone, "next", prev=F.col("prev"), w="w"))
    after = {r["arc"]: r for r in rest.collect()}
    placed, position, here = [], 0, next((r for r in after.values() if r["prev"] is None), None)
    while here is not None:
        placed.append((here["arc"], position))
        here = after[here["next"]] if here["next"] is not None else None
        position += here["w"] if here is not None else 0
    found = saved(arcs.sparkSession.createDataFrame(placed, f"arc {kind}, position long"), "trie-positions")
    for one in reversed(rounds):
        known = found.select(F.col("arc").alias("prev"), F.col("position").alias("_from"))
        found = found.unionByName(saved(one.where("leaves").join(known, "prev").select("arc", (F.col("_from") + F.col("w")).alias("position")), "trie-positions"))
    return found


def subtree_sums(arcs: DataFrame, short: int = SHORT_LIST) -> DataFrame:
    """Per node of a ``tour`` (conv_id, depth) its subtree's leaves and cost: what the tour passes between entering and
    leaving it."""
    arcs = saved(arcs, "trie-arcs")
    rows = arcs.join(list_rank(arcs.select("arc", "next"), short), "arc").select("position", "conv_id", "depth", "enters", "leaf", "cost")
    rows = running_sums(rows, [], ["position"], {"leaves": "leaf", "costs": "cost"}, "trie-tour")
    between = lambda total, own: F.max(F.when(~F.col("enters"), F.col(total))) - F.max(F.when(F.col("enters"), F.col(total) - F.col(own)))
    return rows.groupBy("conv_id", "depth").agg(between("leaves", "leaf").alias("n_leaves"), between("costs", "cost").alias("saved_tokens"))


def end_digests(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per node (conv_id, depth) the SHA-256 of its ends' ids, ascending and joined by commas.

    ``ends``: conv_id, parent, depth (one more than the node's), k, as ``families`` leaves them in its files.  Ids
    whose k follow on each other become chunks where they are; only chunks are brought together, and a
    node's chunks pass through its digest one by one."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, last, ids, out = None, None, None, [], []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["conv_id", "depth", "k", "ids"])

        for b in batches:
            for conv, parent, depth, k in zip(*(c.to_pylist() for c in b.columns)):
                if (parent, depth) != node or k != last + 1 or len(ids) == chunk:
                    if ids:
                        out.append((*node, first, ",".join(ids)))
                    node, first, ids = (parent, depth), k, []
                ids.append(str(conv))
                last = k
                if len(out) == 1024:
                    yield made()
                    out = []
        if ids:
            out.append((*node, first, ",".join(ids)))
        if out:
            yield made()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for b in batches:
            out = []
            for conv, depth, ids in zip(*(c.to_pylist() for c in b.columns)):
                if (conv, depth) == node:
                    digest.update(b",")
                else:
                    if node is not None:
                        out.append((*node, digest.hexdigest()))
                    node, digest = (conv, depth), hashlib.sha256()
                digest.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["conv_id", "depth", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_pydict({"conv_id": [node[0]], "depth": [node[1]], "ends_sha256": [digest.hexdigest()]})

    rows = ends.select("conv_id", "parent", (F.col("depth") - 1).alias("depth"), "k").mapInArrow(chunks, "conv_id long, depth long, k long, ids string")
    rows = in_batches(rows).repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "k").select("conv_id", "depth", "ids")
    return rows.mapInArrow(digests, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, turns: DataFrame, short: int = SHORT_LIST, chunk: int = CHUNK) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, place from 1, digest, bytes) of ``conversations`` (conv_id):
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    nodes, ends = trie_nodes(conversations, turns)
    every = families(nodes, ends)
    zero = F.lit(0).cast("long")
    root = nodes.where("depth = 0").select("conv_id", "depth", zero.alias("parent"), zero.alias("n_brothers"), zero.alias("k"), "n_convs", "bytes", "n_children")
    lines = every.where("kind = 1").select(*root.columns).unionByName(root)
    digests = end_digests(every.where("kind = 2"), chunk)
    parent = F.when(F.col("depth") > 0, F.col("parent")).alias("parent_conv_id")
    out = lines.join(subtree_sums(tour(lines), short), ["conv_id", "depth"]).join(digests, ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", parent, "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, block: int = 5, most: int = 9) -> DataFrame:
    """``prefix_trie`` of ``conversations`` (conv_id, turn, role, text) after ``with_shared_heads``."""
    return prefix_trie(*with_shared_heads(ordered_turns(conversations), block, most))
