"""Prefix trie of conversations by time-forward processing.

1. Turns are sorted by ranges of (conversation, turn); a turn's place and the fingerprint of the prefix that ends with
   it are running values, which go on over the bounds of ranges by one carried state per range. A long conversation is
   dealt to as many tasks as its rows fill.
2. Equal prefixes are a node: its members are counted before the shuffle. A node whose only child has all its members is
   contracted with it; such a run is known by (smallest member, number of members), so that no chain has to be walked,
   and every contracted node is a leaf, ends a conversation, or branches.
3. Contracted nodes with at most 1 in HOT_PARTS of the conversations hang in subtrees of bounded size below the others.
   Subtrees are dealt to shards and each shard's nodes are sorted by reverse level order (Spark's external sort). A node
   takes its children's totals from a priority queue that spills to disk, adds its own and sends the sum forward to its
   parent. What leaves a shard, one sum per shard and parent, goes in the same way through the tree of the others: at
   most 2 * HOT_PARTS contracted nodes, and those along which a conversation of the shards leaves the path.
4. Nodes of a run get their totals from the run's and the running bytes of their prefix.

The members that end at a node are joined in blocks by ranges, and the blocks hashed in order: a node where a third of
all conversations end costs its task one row per block.

Defined cases: a null turn comes first, equal turns are ordered by role, the text's first ORDER_CHARS characters and the
turn's fingerprint (role and text), so equal rows are equal turns and all count; null roles and texts are empty; rows
with a null conv_id belong to no conversation and take no part; a rebuilt conversation without turns is a member of
the root; further columns are not read; an empty table has no node, not even the root. Prefixes are told apart by two
fingerprints modulo 2**61 - 1.
"""

from __future__ import annotations

import hashlib
import heapq
import marshal
import tempfile
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BROADCAST_KEYS, HOT_PARTS, attach_groups, materialize, shuffle_parts

ORDER_CHARS = 128
#: Modulus and bases of the prefixes' fingerprints.
MOD, BASES = (1 << 61) - 1, (1_000_003_919_191, 1_777_777_777_777_777)
#: Conversations that share their first turns lie in such a range of ids; the shared head has this many turns at most.
FAMILY, HEADS = 5, 9
#: Ids in a block of the members that end at a node; messages that a priority queue holds in memory.
BLOCK_IDS, QUEUE_ROWS = 8192, 200_000
LEAST_HOT = 64

NODE = ["n1", "n2"]
RUN = ["conv_id", "n_convs"]


class SpillingQueue:
    """A priority queue of tuples; beyond ``limit`` of them, what it holds is written to a file in sorted order and
    merged in while it is taken."""

    def __init__(self, limit: int = QUEUE_ROWS):
        self.limit, self.held, self.heads, self.spills = limit, [], [], 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.held, item)
        if len(self.held) > self.limit:
            self._spill()

    def _spill(self) -> None:
        f = tempfile.TemporaryFile()  # has no name, so it goes with the task  # noqa: SIM115
        self.held.sort()
        for at in range(0, len(self.held), 4096):
            marshal.dump(self.held[at : at + 4096], f)
        f.seek(0)
        self.held, self.spills = [], self.spills + 1
        rest = self._read(f)
        heapq.heappush(self.heads, (next(rest), self.spills, rest))

    @staticmethod
    def _read(f) -> Iterator[tuple]:
        with f:
            while True:
                try:
                    block = marshal.load(f)  # noqa: S302  this task wrote it
                except EOFError:
                    return
                yield from block

    def peek(self) -> tuple | None:
        if self.heads and (not self.held or self.heads[0][0] < self.held[0]):
            return self.heads[0][0]
        return self.held[0] if self.held else None

    def pop(self) -> tuple:
        if self.heads and (not self.held or self.heads[0][0] < self.held[0]):
            item, n, rest = self.heads[0]
            after = next(rest, None)
            if after is None:
                heapq.heappop(self.heads)
            else:
                heapq.heapreplace(self.heads, (after, n, rest))
            return item
        return heapq.heappop(self.held)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, ...) sorted by conv -> with the partition's number and the place in the conversation within it."""
    part, before, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0).to_numpy()
        start = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        at = np.arange(len(conv)) - np.repeat(start, np.diff([*start, len(conv)]))
        if conv[0] == before:
            at[: start[1] if len(start) > 1 else len(conv)] += n
        before, n = conv[-1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), part), pa.int32()), pa.array(at, pa.int64()), *batch.columns], ["part", "at", *batch.schema.names])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, f1, f2, bytes) sorted by conversation and turn -> part, conv, depth, the prefix's fingerprints and bytes
    as if every conversation of the partition began in it."""
    part, before, depth, a, b, cum = TaskContext.get().partitionId(), None, 0, 1, 1, 0
    (r1, r2) = BASES
    for batch in batches:
        out: list[tuple] = []
        for conv, f1, f2, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv != before:
                before, depth, a, b, cum = conv, 0, 1, 1, 0
            p, q = a, b
            a, b, depth, cum = (a * r1 + f1) % MOD, (b * r2 + f2) % MOD, depth + 1, cum + size
            out.append((part, conv, depth, a, b, p, q, size, cum))
        if out:
            kinds = [pa.int32(), *[pa.int64()] * 8]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["part", "conv", "depth", "n1", "n2", "p1", "p2", "bytes", "cum"])


def _moved(state: int, begin: int, base: int, turns: int) -> int:
    """The fingerprint after ``turns`` turns from ``begin``, given the one from 1."""
    return (state + (begin - 1) * pow(base, turns, MOD)) % MOD


def _carry_on(batches: Iterator[pa.RecordBatch], carried: dict[int, tuple[int, int, int, int, int]]) -> Iterator[pa.RecordBatch]:
    """Rows of a conversation that goes on from the partition before, by the state it had there."""
    for batch in batches:
        part, conv = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        going = np.zeros(len(part), bool)
        for p in set(part.tolist()) & carried.keys():
            going |= (part == p) & (conv == carried[p][0])
        if going.any():
            cols = [c.to_pylist() for c in batch.columns]
            for i in np.flatnonzero(going).tolist():
                _, depth, c1, c2, cum = carried[cols[0][i]]
                k = cols[2][i]
                for to, turns in ((3, k), (5, k - 1)):
                    cols[to][i], cols[to + 1][i] = _moved(cols[to][i], c1, BASES[0], turns), _moved(cols[to + 1][i], c2, BASES[1], turns)
                cols[2][i], cols[8][i] = k + depth, cols[8][i] + cum
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, batch.schema.types, strict=True)], schema=batch.schema)
        yield batch


def _sorted_turns(conversations: DataFrame, id_col: str) -> DataFrame:
    """(conv, pos, f1, f2, bytes): the turns in order; texts stay where they are read."""
    spark = conversations.sparkSession
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    print_ = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    lane = lambda at: F.conv(F.substring(print_, at, 15), 16, 10).cast("long")
    key = F.substring(F.concat(role, F.lit("\x00"), text), 1, ORDER_CHARS)
    turns = conversations.select(F.col(id_col).cast("long").alias("conv"), F.col("turn").alias("turn"), key.alias("k"), lane(1).alias("f1"), lane(16).alias("f2"), F.octet_length(text).cast("long").alias("bytes")).filter("conv is not null")
    order = [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("k"), F.asc("f1")]
    dealt = turns.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order).select("conv", "f1", "f2", "bytes")
    numbered = materialize(dealt.mapInArrow(_number, "part int, at long, conv long, f1 long, f2 long, bytes long"), "trie-turns")
    carried, conv, n = [], None, 0
    for r in numbered.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "at")).alias("last")).orderBy("part").collect():  # a row per range
        if r["first"] == conv:
            carried.append((r["part"], conv, n))
        n = r["last"]["at"] + 1 + (n if r["last"]["conv"] == conv else 0)
        conv = r["last"]["conv"]
    if not carried:
        return numbered.withColumn("pos", F.col("at"))
    more = spark.createDataFrame(carried, "part int, conv long, more long")
    return numbered.join(F.broadcast(more), ["part", "conv"], "left").withColumn("pos", F.col("at") + F.coalesce("more", F.lit(0)))


def _prefixes(rebuilt: DataFrame) -> DataFrame:
    """(conv, seg, pos, f1, f2, bytes) -> conv, depth, n1, n2, p1, p2, bytes, cum of every turn's prefix."""
    spark, order = rebuilt.sparkSession, ["conv", "seg", "pos"]
    dealt = rebuilt.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order).select("conv", "f1", "f2", "bytes")
    kinds = "part int, conv long, depth long, n1 long, n2 long, p1 long, p2 long, bytes long, cum long"
    rows = materialize(dealt.mapInArrow(_chain, kinds), "trie-prefixes")
    carried, now = {}, None
    for r in rows.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "depth", "n1", "n2", "cum")).alias("last")).orderBy("part").collect():  # a row per range
        last = tuple(r["last"])
        if now and r["first"] == now[0]:
            carried[r["part"]] = now
            if last[0] == now[0]:
                last = (now[0], last[1] + now[1], _moved(last[2], now[2], BASES[0], last[1]), _moved(last[3], now[3], BASES[1], last[1]), last[4] + now[4])
        now = last
    return (rows.mapInArrow(partial(_carry_on, carried=carried), kinds) if carried else rows).drop("part")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations' turns (conv, seg, pos, ...) and the table of conversations. h and the family's first
    conversation come from the id alone; a family's head is read at most FAMILY times."""
    h = lambda conv: F.crc32(conv.cast("string")) % HEADS
    convs = turns.filter("pos = 0").select("conv")
    heads = turns.filter((F.col("pos") < HEADS - 1) & (F.col("conv") % FAMILY == 0)).select(F.col("conv").alias("base"), "pos", "f1", "f2", "bytes")
    shared = convs.withColumn("base", F.col("conv") - F.col("conv") % FAMILY).join(heads, "base").filter(F.col("pos") < h(F.col("conv")))
    cols = ["conv", "seg", "pos", "f1", "f2", "bytes"]
    own = turns.filter(F.col("pos") >= h(F.col("conv"))).withColumn("seg", F.lit(1)).select(cols)
    return shared.withColumn("seg", F.lit(0)).select(cols).unionByName(own), convs


def _forward(batches: Iterable[pa.RecordBatch], least: int | None, queue_rows: int = QUEUE_ROWS) -> Iterator[pa.RecordBatch]:
    """Time-forward processing of nodes in reverse level order: (depth, conv_id, n_convs, kind, leaves, saved, up_depth,
    up_conv, up_n), kind 0 for a total that comes from elsewhere, 1 for a node (leaves: 1 for a childless one).

    Gives rows of the same form: kind 1 with the totals of a node's subtree, kind 0 with the sum that goes to a parent
    of more than ``least`` members, which is not in this shard.
    """
    queue, leaving = SpillingQueue(queue_rows), {}
    kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 2
    names = ["depth", "conv_id", "n_convs", "kind", "leaves", "saved"]
    pack = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
    for batch in batches:
        out: list[tuple] = []
        for depth, conv, n, kind, leaves, saved, up_depth, up_conv, up_n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == 0:
                queue.push((-depth, conv, n, leaves, saved))
                continue
            mine = (-depth, conv, n)
            while (head := queue.peek()) is not None and head[:3] == mine:
                _, _, _, more, add = queue.pop()
                leaves, saved = leaves + more, saved + add
            out.append((depth, conv, n, 1, leaves, saved))
            if up_conv is None:
                continue
            if least is not None and up_n > least:
                up = leaving.get((up_depth, up_conv, up_n), (0, 0))
                leaving[up_depth, up_conv, up_n] = up[0] + leaves, up[1] + saved
            else:
                queue.push((-up_depth, up_conv, up_n, leaves, saved))
        if out:
            yield pack(out)
    if leaving:
        yield pack([(*up, 0, *sums) for up, sums in leaving.items()])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n1, n2, conv) in order -> blocks of ids: n1, n2, first, ids."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, conv = (c.to_numpy() for c in batch.columns)
        cut = {0, len(a), *(np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist(), *range(0, len(a), BLOCK_IDS)}
        cut = sorted(cut)
        ids = [",".join(map(str, conv[i:j].tolist())) for i, j in zip(cut, cut[1:], strict=False)]
        at = cut[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(conv[at]), pa.array(ids)], ["n1", "n2", "first", "ids"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n1, n2, ids) in order of node and first id -> the digest of each node's ids; one block is held at a time."""
    node, sha, done = None, None, []
    pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["n1", "n2", "ends_sha256"])
    for batch in batches:
        for a, b, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (a, b) != node:
                if node:
                    done.append((*node, sha.hexdigest()))
                node, sha = (a, b), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if done:
            yield pack()
            done.clear()
    if node:
        done.append((*node, sha.hexdigest()))
        yield pack()


def _ends(last: DataFrame, spark: SparkSession) -> DataFrame:
    parts, order = shuffle_parts(spark), ["n1", "n2", "conv"]
    blocks = last.select(order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_blocks, "n1 long, n2 long, first long, ids string")
    blocks = blocks.repartition(parts, *NODE).sortWithinPartitions("n1", "n2", "first").select("n1", "n2", "ids")
    return blocks.mapInArrow(_digest, "n1 long, n2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", least_hot: int = LEAST_HOT, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    rebuilt, convs = rebuild(_sorted_turns(conversations, id_col))
    root = convs.select("conv", *[F.lit(v).cast("long").alias(c) for c, v in (("depth", 0), ("n1", 1), ("n2", 1), ("p1", None), ("p2", None), ("bytes", 0), ("cum", 0))])
    rows = materialize(_prefixes(rebuilt).unionByName(root), "trie-rows")
    same = [F.min(c).alias(c) for c in ("depth", "p1", "p2", "bytes", "cum")]
    nodes = materialize(rows.groupBy(*NODE).agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *same), "trie-nodes")
    total = nodes.filter("depth = 0").select("n_convs").first()
    least = max(least_hot, (total["n_convs"] if total else 0) // HOT_PARTS)

    kids = nodes.filter("depth > 0").groupBy(F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(nodes.join(kids, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-kids")
    parents = nodes.filter("n_children > 0").select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("up_conv"), F.col("n_convs").alias("up_n"), F.col("n_children").alias("_size"))
    linked = attach_groups(nodes.filter("depth > 0"), parents, ["p1", "p2"], "_size", nodes.count()).drop("_size")
    top = nodes.filter("depth = 0").withColumns({"up_conv": F.lit(None).cast("long"), "up_n": F.lit(None).cast("long")})
    linked = materialize(linked.unionByName(top), "trie-linked")

    # the run of a node and of its parent differ where members leave: the parent's run ends one level above this one's top
    runs = linked.groupBy(*RUN).agg(
        F.min("depth").alias("top"), F.max("depth").alias("depth"), F.sum((F.col("n_convs") - 1) * F.col("bytes")).alias("own"), F.max_by("n_children", "depth").alias("kids"),
        F.min_by(F.struct("up_conv", "up_n"), "depth").alias("up"), F.min(F.col("cum") - F.col("bytes")).alias("above"), F.count(F.lit(1)).alias("_size"),
    )
    runs = materialize(runs, "trie-runs")
    hot = materialize(nodes.filter(F.col("n_convs") > least).select(*NODE, F.lit(True).alias("hot")), "trie-hot")
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot
    place = F.struct("depth", "n1", "n2")
    paths = materialize(rows.join(hot, NODE, "left").groupBy("conv").agg(F.max(place).alias("last"), F.min(F.when(F.col("hot").isNull(), place)).alias("root")), "trie-paths")

    form = ["depth", *RUN, "kind", "leaves", "saved", "up_depth", "up_conv", "up_n"]
    sent = runs.select(
        "depth", *RUN, F.lit(1).alias("kind"), F.when(F.col("kids") == 0, 1).otherwise(0).cast("long").alias("leaves"), F.col("own").alias("saved"), (F.col("top") - 1).alias("up_depth"), F.col("up.up_conv").alias("up_conv"), F.col("up.up_n").alias("up_n")
    )
    order = [F.desc("depth"), F.asc("conv_id"), F.asc("n_convs"), F.asc("kind")]
    found = "depth long, conv_id long, n_convs long, kind int, leaves long, saved long"
    roots = paths.filter("root is not null").select(F.col("conv").alias("conv_id"), F.col("root.n1").alias("r1"), F.col("root.n2").alias("r2"))
    cold = sent.filter(F.col("n_convs") <= least).join(roots, "conv_id").repartition(shuffle_parts(spark), "r1", "r2").sortWithinPartitions(*order).select(form)
    shards = materialize(cold.mapInArrow(partial(_forward, least=least, queue_rows=queue_rows), found), "trie-shards")
    arrived = shards.filter("kind = 0").groupBy("depth", *RUN, "kind").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    arrived = arrived.withColumns({c: F.lit(None).cast("long") for c in form[-3:]})
    over = sent.filter(F.col("n_convs") > least).select(form).unionByName(arrived.select(form)).repartition(1).sortWithinPartitions(*order)
    totals = shards.filter("kind = 1").unionByName(over.mapInArrow(partial(_forward, least=None, queue_rows=queue_rows), found))
    totals = materialize(totals.select(*RUN, "leaves", "saved").join(runs.select(*RUN, "above", "_size"), RUN), "trie-totals")

    out = attach_groups(linked, totals, RUN, "_size", nodes.count())
    saved = F.col("saved") - (F.col("n_convs") - 1) * (F.col("cum") - F.col("bytes") - F.col("above"))
    ends = _ends(paths.select("last.n1", "last.n2", "conv"), spark)
    none = hashlib.sha256(b"").hexdigest()
    return out.select(*NODE, "conv_id", "depth", F.col("up_conv").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens")).join(ends, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")
    )
