"""Exact nearest neighbours among all rows of a few numeric columns, by boxes and distance bounds.

Equal rows are one point with a count. Points are dealt to the leaves of a tree of median cuts that a bounded sample
gives, and a leaf's points to shards of bounded size. A point is compared with its own shard first; what it finds there
bounds the distance, and only shards whose box lies within it are asked again. A comparison's group is one shard and a
block of the points that ask it, both bounded: a shard is copied once per block of askers, so copies grow with what has
to be compared and not with the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.steps import written
from .ranks import places

#: Points of a shard, and askers of a block, at most; leaves of the tree, and sampled points for each.
SHARD_ROWS, LEAVES, LEAF_SAMPLE = 2048, 1024, 32
FORM = "id long, n long, x array<double>, need int, core double, comp long"
COLUMNS = ["id", "n", "x", "need", "core", "comp"]


@dataclass
class Boxes:
    """The tree's leaves: bounds of their points, and the shards of each."""

    tree: tuple
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    several: np.ndarray

    def leaf(self, x: np.ndarray) -> np.ndarray:
        out, pending = np.zeros(len(x), np.int64), [(self.tree, np.arange(len(x)))]
        while pending:
            node, rows = pending.pop()
            if len(node) == 1:
                out[rows] = node[0]
                continue
            left = x[rows, node[0]] < node[1]
            pending += [(node[2], rows[left]), (node[3], rows[~left])]
        return out

    def far(self, x: np.ndarray) -> np.ndarray:
        """No point of a leaf is nearer than this; rows by leaves."""
        total = np.zeros((len(x), len(self.low)))
        for i in range(x.shape[1]):
            gap = np.maximum(np.maximum(self.low[:, i] - x[:, i : i + 1], x[:, i : i + 1] - self.high[:, i]), 0)
            total += gap * gap
        return np.sqrt(total) * (1 - 1e-12)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same in either direction to the last bit."""
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        gap = a[:, i : i + 1] - b[:, i]
        total += gap * gap
    return np.sqrt(total)


def vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def distinct_points(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(id, n, x, key): equal rows as one point, numbered by the smallest key. Columns are finite."""
    x = F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in columns])
    points = written(df.groupBy(x.alias("x")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("key")), "points")
    return written(places(points, [F.asc("key")], "id"), "points-numbered")


def _cut(sample: np.ndarray, leaves: int, count: list[int]) -> tuple:
    spread = sample.max(axis=0) - sample.min(axis=0) if len(sample) else np.zeros(1)
    if leaves < 2 or len(sample) < 2 or not spread.max() > 0:
        count[0] += 1
        return (count[0] - 1,)
    i = int(spread.argmax())
    at = float(np.median(sample[:, i]))
    at = at if (sample[:, i] < at).any() else float(sample[sample[:, i] > at, i].min())
    left = sample[:, i] < at
    return i, at, _cut(sample[left], leaves // 2, count), _cut(sample[~left], leaves - leaves // 2, count)


def _to_leaf(batches: Iterator[pa.RecordBatch], boxes: Boxes) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = vectors(b.column(b.schema.get_field_index("x")))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(boxes.leaf(x), pa.int64())], [*b.schema.names, "leaf"])


def deal(points: DataFrame, width: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, Boxes]:
    """points with shard and leaf, and the boxes."""
    n = points.count()
    leaves = max(1, min(LEAVES, -(-n // shard_rows)))
    sample = points.orderBy(F.xxhash64("id"), "id").limit(leaves * LEAF_SAMPLE).select("x").collect()  # bounded by LEAVES
    count = [0]
    boxes = Boxes(_cut(np.array([r["x"] for r in sample]).reshape(-1, width), leaves, count), *[np.zeros((0, width))] * 2, *[np.zeros(0, np.int64)] * 2)
    kinds = ", ".join(f"{c} {t}" for c, t in points.dtypes)
    dealt = written(points.mapInArrow(partial(_to_leaf, boxes=boxes), f"{kinds}, leaf long"), "points-leaves")
    at = dealt.groupBy("leaf").agg(F.count(F.lit(1)).alias("_n"), *[f(F.col("x")[i]).alias(f"{s}{i}") for i in range(width) for f, s in ((F.min, "l"), (F.max, "h"))])
    found = {r["leaf"]: r for r in at.collect()}  # a row per leaf
    side = lambda s, none: np.array([[found[k][f"{s}{i}"] if k in found else none for i in range(width)] for k in range(count[0])], float).reshape(-1, width)
    boxes.low, boxes.high = side("l", np.inf), side("h", -np.inf)
    boxes.several = np.array([-(-found[k]["_n"] // shard_rows) if k in found else 0 for k in range(count[0])], np.int64)
    boxes.first = np.cumsum(boxes.several) - boxes.several
    of = lambda v: F.get(F.array(*[F.lit(int(i)) for i in v]), F.col("leaf").cast("int"))
    return dealt.withColumn("shard", (of(boxes.first) + F.pmod(F.col("id"), of(np.maximum(boxes.several, 1)))).cast("long")), boxes


def _groups(batches: Iterator[pa.RecordBatch], solve: Callable, names: list[str]) -> Iterator[pa.RecordBatch]:
    """(cell, asks, FORM) sorted by cell -> what solve makes of a cell's points and askers, both sorted by id."""
    held: list[pa.RecordBatch] = []

    def solved() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks().sort_by("id")
        asks = t.column("asks").to_numpy()
        side = lambda mask: {c: t.column(c).to_numpy()[mask] for c in ("id", "n", "need", "core", "comp")} | {"x": vectors(t.column("x").combine_chunks())[mask]}
        return pa.RecordBatch.from_arrays([pa.array(c) for c in solve(side(~asks), side(asks))], names)

    cell = None
    for b in batches:
        cells = b.column(0).to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
        for i, j in zip(cut, cut[1:], strict=False):
            if i == j:
                continue
            if held and cells[i] != cell:
                yield solved()
                held.clear()
            cell = cells[i]
            held.append(b.slice(i, j - i))
    if held:
        yield solved()


def compared(points: DataFrame, askers: DataFrame, solve: Callable, form: str, block: int = SHARD_ROWS) -> DataFrame:
    """points (shard, COLUMNS) against askers (shards they ask, COLUMNS), shard by shard and block by block."""
    asked = written(askers.select(*COLUMNS, F.explode("shards").alias("shard")), "asked")
    blocks = written(asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks")), "asked-blocks")  # a row per shard
    cell = lambda b: (F.col("shard") * (1 << 24) + b).alias("cell")
    a = asked.join(blocks, "shard").select(cell(F.pmod(F.xxhash64("id"), F.col("blocks"))), F.lit(True).alias("asks"), *COLUMNS)
    p = points.join(blocks, "shard").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(cell(F.col("b")), F.lit(False).alias("asks"), *COLUMNS)
    names = [c.split()[0] for c in form.split(", ")]
    return p.unionByName(a).repartition("cell").sortWithinPartitions("cell").mapInArrow(partial(_groups, solve=solve, names=names), form)


def _nearest(points: dict, askers: dict, k: int) -> list[np.ndarray]:
    """Of each asker: other points in order of (distance, id) until their counts reach what it needs."""
    d = distances(askers["x"], points["x"])
    d[askers["comp"][:, None] == points["comp"]] = np.inf
    kth = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.inf)
    row, at = np.nonzero((d <= kth[:, None]) & np.isfinite(d))
    order = np.lexsort((points["id"][at], d[row, at], row))
    row, at = row[order], at[order]
    n = points["n"][at]
    total = np.cumsum(n) - n
    begin = np.searchsorted(row, np.arange(len(d)))
    before = total - total[np.minimum(begin, max(len(total) - 1, 0))][row] if len(row) else total
    keep = before < askers["need"][row]
    row, at = row[keep], at[keep]
    return [askers["id"][row], points["id"][at], d[row, at], points["n"][at]]


def _open(batches: Iterator[pa.RecordBatch], boxes: Boxes) -> Iterator[pa.RecordBatch]:
    """(most, shard, COLUMNS) -> COLUMNS and the other shards that have something within ``most``."""
    for b in batches:
        x, most, own = vectors(b.column(b.schema.get_field_index("x"))), b.column(0).to_numpy(), b.column(1).to_numpy()
        near = (boxes.far(x) <= most[:, None]) & (boxes.several > 0)
        out = [[s for leaf in np.flatnonzero(r).tolist() for s in range(int(boxes.first[leaf]), int(boxes.first[leaf] + boxes.several[leaf])) if s != o] for r, o in zip(near, own.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(out, pa.list_(pa.int64()))], [*b.schema.names[2:], "shards"])


def asking(dealt: DataFrame, most: str, boxes: Boxes) -> DataFrame:
    """dealt (COLUMNS, shard and a bound) as askers of the other shards within the bound."""
    return dealt.select(F.col(most).cast("double").alias("most"), "shard", *COLUMNS).mapInArrow(partial(_open, boxes=boxes), FORM + ", shards array<long>")


def nearest(dealt: DataFrame, boxes: Boxes, k: int) -> DataFrame:
    """(id, other, distance, n): each point's nearest others in order of (distance, id), with as many of their rows as
    count among the k nearest rows of the point's rows; equal rows come first and are not listed."""
    pts = dealt.withColumns({"need": (F.lit(k) - F.least(F.col("n") - 1, F.lit(k))).cast("int"), "core": F.lit(0.0), "comp": F.col("id")})
    pts = written(pts.select("shard", *COLUMNS), "near-points")
    form = "id long, other long, distance double, n long"
    first = written(compared(pts, pts.filter("need > 0").withColumn("shards", F.array("shard")), partial(_nearest, k=k), form), "near-own")
    found = first
    if boxes.several.sum() > 1:  # else there is no other shard to ask
        bound = first.groupBy("id").agg(F.sum("n").alias("_s"), F.max("distance").alias("_d"))
        wide = pts.filter("need > 0").join(bound, "id", "left").withColumn("most", F.when(F.col("_s") >= F.col("need"), F.col("_d")).otherwise(F.lit(float("inf"))))
        found = first.unionByName(compared(pts, asking(wide, "most", boxes), partial(_nearest, k=k), form))
    # at most k rows per point and shard it asked
    rows = found.join(pts.select("id", "need"), "id").groupBy("id", "need").agg(F.sort_array(F.collect_list(F.struct("distance", "other", "n"))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("got"), F.array().cast("array<struct<distance:double,other:long,n:long>>").alias("kept"))
    step = lambda a, r: F.when(a["got"] >= F.col("need"), a).otherwise(
        F.struct((a["got"] + r["n"]).alias("got"), F.concat(a["kept"], F.array(F.struct(r["distance"].alias("distance"), r["other"].alias("other"), F.least(r["n"], F.col("need") - a["got"]).alias("n")))).alias("kept"))
    )
    return rows.select("id", F.explode(F.aggregate("all", start, step)["kept"]).alias("r")).select("id", "r.other", "r.distance", "r.n")


def local_outlier_factor(df: DataFrame, columns: list[str], key: str, k: int = 20, name: str = "lof", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """df with the local outlier factor among all its rows: mean density of the k nearest rows over a row's own. Equal
    rows are each other's neighbours at distance 0; of rows at the same distance those of the smaller point come first;
    k is lowered to the other rows there are. Columns are finite."""
    points = distinct_points(df, columns, key)
    total = points.agg(F.sum("n")).first()[0] or 0
    k = min(k, total - 1)
    if k < 1:
        return df.withColumn(name, F.lit(None).cast("double"))
    dealt, boxes = deal(points.select("id", "n", "x"), len(columns), shard_rows)
    near = written(nearest(dealt, boxes, k), "lof-near")
    own = F.least(F.col("n") - 1, F.lit(k))
    reach = dealt.select("id", own.alias("own")).join(near.groupBy("id").agg(F.max("distance").alias("reach")), "id", "left").select("id", "own", F.coalesce("reach", F.lit(0.0)).alias("reach"))
    reach = written(reach, "lof-reach")
    by_other = near.join(reach.select(F.col("id").alias("other"), "reach"), "other")
    sums = by_other.groupBy("id").agg(F.sum(F.greatest("reach", "distance") * F.col("n")).alias("s"))
    mean = (F.coalesce("s", F.lit(0.0)) + F.col("own") * F.col("reach")) / k
    density = written(reach.join(sums, "id", "left").select("id", "own", (1 / F.greatest(mean, F.lit(1e-10))).alias("density")), "lof-density")
    others = near.join(density.select(F.col("id").alias("other"), F.col("density").alias("o")), "other").groupBy("id").agg(F.sum(F.col("o") * F.col("n")).alias("s"))
    lof = (F.coalesce("s", F.lit(0.0)) + F.col("own") * F.col("density")) / k / F.col("density")
    scores = points.select("id", F.col("x").alias("_x")).join(density.join(others, "id", "left").select("id", lof.alias(name)), "id").drop("id")
    x = F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in columns])
    return df.withColumn("_y", x).join(scores, F.col("_y") == F.col("_x")).select(*df.columns, name)
