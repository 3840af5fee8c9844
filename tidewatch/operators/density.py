"""Density clusters (HDBSCAN) of rows of numeric columns, as Spark jobs over points, edges and merges.

1. Core distances come from the exact neighbours of all rows; equal rows are one point with a count.
2. Boruvka rounds give the minimum spanning tree of mutual reachability in the total order (weight, smaller id, larger
   id). Inside a shard of points, components take their shortest outgoing edge while nothing outside the shard can be
   as near; what is left goes on in rounds over all shards, which bounds cut to the boxes within a component's best.
3. The tree's edges in order are cut into segments of bounded length. A segment is a tree over the components that the
   edges before it make: halving again and again, each half's components are found by contraction, so that segments
   need nothing of each other. Each is merged by union-find in one bounded group.
4. Merges with two sides of at least the least size start clusters; everything else is a row's link upwards, followed by
   doubling. Stabilities are sums over merges; clusters are chosen from the leaves of their tree up, a level per round.
   Where links or clusters are no more than a segment, one bounded group follows or chooses them, without rounds.

Defined cases: columns are finite; equal weights go by ids, so a result doesn't depend on partitions; fewer rows than the
least size are all noise; the root is never chosen, as is usual; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.steps import written
from .models import silhouette
from .neighbours import COLUMNS, SHARD_ROWS, Boxes, asking, compared, deal, distances, distinct_points, nearest
from .ranks import places

#: Edges that one group merges, and links and clusters that it follows, at most.
SEGMENT = 200_000
#: The density of what lies nearer than this counts as infinite no more than this distance's.
LEAST_DISTANCE = 1e-10


def dealt_points(points: DataFrame, width: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, Boxes]:
    dealt, boxes = deal(points.select("id", "n", "x"), width, shard_rows)
    return written(dealt, "density-dealt"), boxes


def core_distances(dealt: DataFrame, boxes: Boxes, min_samples: int) -> DataFrame:
    """Adds core: the distance of the min_samples-th nearest row, the row itself included."""
    far = nearest(dealt, boxes, min_samples - 1).groupBy("id").agg(F.max("distance").alias("core"), F.sum("n").alias("got"))
    # fewer rows than asked for: the farthest of them
    return written(dealt.join(far.select("id", "core"), "id", "left").withColumn("core", F.coalesce("core", F.lit(0.0))), "density-core")


def reachability(a: dict, b: dict) -> np.ndarray:
    return np.maximum(np.maximum(distances(a["x"], b["x"]), a["core"][:, None]), b["core"])


def _inside(batches: Iterator[pa.RecordBatch], boxes: Boxes) -> Iterator[pa.RecordBatch]:
    """(shard, leaf, COLUMNS) sorted by shard and id -> edges (id, other, w) that are surely in the tree, and each
    point's component as (id, component, null)."""
    held: list[pa.RecordBatch] = []

    def solved() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        ids, core = t.column("id").to_numpy(), t.column("core").to_numpy()
        x = np.stack(t.column("x").to_numpy().tolist())
        me = {"x": x, "core": core}
        w = reachability(me, me)
        outside = boxes.far(x)
        leaf = int(t.column("leaf")[0].as_py())
        outside[:, leaf] = np.inf if boxes.several[leaf] == 1 else 0
        outside = np.maximum(outside.min(axis=1), core)
        comp, edges, m = np.arange(len(ids)), [], len(ids)
        while True:
            masked = np.where(comp[:, None] == comp, np.inf, w)
            best = masked.argmin(axis=1)  # of equal weights the smaller id, which is the smaller edge as well
            weight = masked[np.arange(m), best]
            low, high = np.minimum(np.arange(m), best), np.maximum(np.arange(m), best)
            order = np.lexsort((high, low, weight, comp))
            first = order[np.flatnonzero(np.diff(comp[order], prepend=-1))]
            limit = np.full(m, np.inf)
            np.minimum.at(limit, comp, outside)
            first = first[np.isfinite(weight[first]) & (weight[first] < limit[comp[first]])]
            if not len(first):
                break
            parent = np.arange(m)

            def root(i: int, parent=parent) -> int:
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            for i in first.tolist():
                a, b = root(comp[low[i]]), root(comp[high[i]])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    edges.append((int(ids[low[i]]), int(ids[high[i]]), float(weight[i])))
            comp = np.array([root(c) for c in comp.tolist()])
        rows = [*edges, *zip(ids.tolist(), ids[comp].tolist(), [None] * m, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["id", "other", "w"])

    shard = None
    for b in batches:
        shards = b.column(0).to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for i, j in zip(cut, cut[1:], strict=False):
            if i == j:
                continue
            if held and shards[i] != shard:
                yield solved()
                held.clear()
            shard = shards[i]
            held.append(b.slice(i, j - i))
    if held:
        yield solved()


def _outward(points: dict, askers: dict) -> list[np.ndarray]:
    """Each asker's first edge to another component: comp, lo, hi, w, to."""
    w = reachability(askers, points)
    w[askers["comp"][:, None] == points["comp"]] = np.inf
    best = w.argmin(axis=1)
    weight = w[np.arange(len(w)), best]
    ok = np.flatnonzero(np.isfinite(weight))
    a, b = askers["id"][ok], points["id"][best[ok]]
    return [askers["comp"][ok], np.minimum(a, b), np.maximum(a, b), weight[ok], points["comp"][best[ok]]]


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, up) of one bounded group -> each node and the one at the end of its links; none where a link leads to no
    node."""
    t = pa.Table.from_batches(list(batches), pa.schema([("node", pa.int64()), ("up", pa.int64())]))
    node, up = (t.column(c).to_numpy() for c in ("node", "up"))
    order = np.argsort(node, kind="stable")
    node, up = node[order], up[order]
    at = np.searchsorted(node, up)
    known = at < len(node)
    known[known] = node[at[known]] == up[known]
    at = np.append(np.where(known, at, len(node)), len(node))  # the last place stands for no node
    while not np.array_equal(at, at[at]):
        at = at[at]
    at = at[:-1]
    yield pa.RecordBatch.from_arrays([pa.array(node[at < len(node)]), pa.array(node[at[at < len(node)]])], ["node", "up"])


def doubled(links: DataFrame, node: str, up: str, tag: str, segment: int = SEGMENT) -> DataFrame:
    """Follows up to the node that links to itself, a row per node: at most ``segment`` links in one bounded group, more
    by doubling."""
    if links.count() <= segment:
        one = links.select(F.col(node).alias("node"), F.col(up).alias("up")).coalesce(1)
        return one.mapInArrow(_followed, "node long, up long").select(F.col("node").alias(node), F.col("up").alias(up))
    while True:
        at = links.select(F.col(node).alias("_n"), F.col(up).alias("_u"))
        after = written(links.join(at, F.col(up) == F.col("_n")).select(node, F.col("_u").alias("_next"), up), tag)
        moved = after.filter(F.col("_next") != F.col(up)).limit(1).count()
        links = after.select(node, F.col("_next").alias(up))
        if not moved:
            return links


def spanning_tree(dealt: DataFrame, boxes: Boxes, segment: int = SEGMENT) -> DataFrame:
    """(lo, hi, w): the minimum spanning tree of mutual reachability. dealt: id, n, x, core, shard, leaf."""
    form = "comp long, lo long, hi long, w double, to long"
    rows = dealt.withColumns({"need": F.lit(0), "comp": F.col("id")}).select("shard", "leaf", *COLUMNS)
    inside = written(rows.repartition("shard").sortWithinPartitions("shard", "id").mapInArrow(partial(_inside, boxes=boxes), "id long, other long, w double"), "tree-inside")
    edges = [inside.filter("w is not null").select(F.least("id", "other").alias("lo"), F.greatest("id", "other").alias("hi"), "w")]
    comp = inside.filter("w is null").select("id", F.col("other").alias("comp"))
    while comp.select("comp").distinct().limit(2).count() > 1:
        points = written(rows.drop("comp").join(comp, "id"), "tree-points")
        first = F.min(F.struct("w", "lo", "hi", "to")).alias("e")
        own = written(compared(points, points.withColumn("shards", F.array("shard")), _outward, form).groupBy("comp").agg(first), "tree-own")
        wide = points.join(own.select("comp", F.col("e.w").alias("most")), "comp", "left").withColumn("most", F.coalesce("most", F.lit(float("inf"))))
        wide = wide.filter("core <= most")
        other = compared(points, asking(wide, "most", boxes), _outward, form).groupBy("comp").agg(first)
        chosen = written(own.unionByName(other).groupBy("comp").agg(F.min("e").alias("e")).select("comp", "e.*"), "tree-chosen")
        edges.append(chosen.select("lo", "hi", "w").distinct())
        # of two components that choose each other the smaller is the root
        back = chosen.select(F.col("comp").alias("to"), F.col("to").alias("_back"))
        links = chosen.join(back, "to").select("comp", F.when((F.col("_back") == F.col("comp")) & (F.col("comp") < F.col("to")), F.col("comp")).otherwise(F.col("to")).alias("up"))
        roots = doubled(written(links, "tree-links"), "comp", "up", "tree-roots", segment)
        comp = written(comp.join(roots, "comp").select("id", F.col("up").alias("comp")), "tree-comp")
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


def components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, root): the smallest node that edges (keys, a, b) lead to, by contraction in stars; no node's
    neighbours are collected."""
    now = written(edges.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    while True:
        both = now.unionByName(now.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(*keys, "a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.filter("b > a").join(least, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.distinct(), "stars-large")
        least = large.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        small = large.join(least, [*keys, "a"]).select(*keys, F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select(*keys, "e.*").filter("a <> b")
        after = written(small.distinct(), "stars-small")
        if now.count() == after.count() and not after.join(now, [*keys, "a", "b"], "left_anti").limit(1).count():
            roots = after.groupBy(*keys, F.col("a").alias("node")).agg(F.min("b").alias("root"))
            return roots.unionByName(after.select(*keys, F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        now = after


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seg, rank, a, b, sa, sb, w) sorted by segment and rank -> each edge's merge: rank, w, its sides and sizes."""
    seg, top, up, size = None, {}, {}, {}

    def root(v: int) -> int:
        while up.get(v, v) != v:
            up[v] = up.get(up[v], up[v])
            v = up[v]
        return v

    for batch in batches:
        out = []
        for s, rank, a, b, sa, sb, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if s != seg:
                seg, top, up, size = s, {}, {}, {}
            for v, n in ((a, sa), (b, sb)):
                size.setdefault(v, n)
            x, y = root(a), root(b)
            out.append((rank, w, top.get(x, x), top.get(y, y), size[x], size[y]))
            up[y], size[x], top[x] = x, size[x] + size[y], rank
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["rank", "w", "l", "r", "sl", "sr"])


def merges(points: DataFrame, edges: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(rank, w, l, r, sl, sr): the dendrogram. A side is an earlier merge's rank, or -id of a point; a size counts rows."""
    n = points.select("id", "n")
    e = places(edges, [F.asc("w"), F.asc("lo"), F.asc("hi")], "rank")
    e = e.join(n.select(F.col("id").alias("lo"), F.col("n").alias("sa")), "lo").join(n.select(F.col("id").alias("hi"), F.col("n").alias("sb")), "hi")
    e = written(e.select(F.lit(0).cast("long").alias("seg"), "rank", (-F.col("lo")).alias("a"), (-F.col("hi")).alias("b"), "sa", "sb", "w"), "merge-edges")
    length = e.count()
    while length > segment:
        length = -(-length // 2)
        # a segment's first half keeps its nodes, the second sees what the first makes of them
        half = e.withColumn("_h", F.floor((F.col("rank") - 1 - F.col("seg") * 2 * length) / length))
        low = half.filter("_h = 0")
        roots = written(components(low, ["seg"]), "merge-roots")
        nodes = low.select("seg", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("sa").alias("s")), F.struct(F.col("b").alias("node"), F.col("sb").alias("s")))).alias("v")).select("seg", "v.*").distinct()
        tops = low.join(roots, (low["seg"] == roots["seg"]) & (F.col("a") == F.col("node"))).groupBy(low["seg"], "root").agg(F.max("rank").alias("top"))
        sizes = nodes.join(roots, ["seg", "node"]).groupBy("seg", "root").agg(F.sum("s").alias("size"))
        new = written(roots.join(tops, ["seg", "root"]).join(sizes, ["seg", "root"]).select("seg", "node", "top", "size"), "merge-new")
        high = half.filter("_h = 1")
        for v, s in (("a", "sa"), ("b", "sb")):
            to = new.select("seg", F.col("node").alias(v), F.col("top").alias("_t"), F.col("size").alias("_s"))
            high = high.join(to, ["seg", v], "left").withColumns({s: F.coalesce("_s", s), v: F.coalesce("_t", v)}).drop("_t", "_s")
        cols = [(F.col("seg") * 2 + F.col("_h")).cast("long").alias("seg"), "rank", "a", "b", "sa", "sb", "w"]
        e = written(low.select(cols).unionByName(high.select(cols)), "merge-edges")
    return written(e.repartition("seg").sortWithinPartitions("seg", "rank").mapInArrow(_merge, "rank long, w double, l long, r long, sl long, sr long"), "merges")


def _density(w: str) -> Column:
    return 1 / F.greatest(F.col(w), F.lit(LEAST_DISTANCE))


def condensed(points: DataFrame, tree: DataFrame, least: int, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(point id, cluster it leaves from) and (cluster, parent, stability). A cluster is the node it begins with; the
    root's parent is null. points: id, n, core."""
    leaf = points.select((-F.col("id")).alias("node"), F.col("n").alias("size"), "core")
    side = lambda v, s: F.struct(F.col(v).alias("node"), F.col(s).alias("size"))
    split = (F.col("sl") >= least) & (F.col("sr") >= least)
    child = tree.select(F.explode(F.array(side("l", "sl"), side("r", "sr"))).alias("c"), F.col("rank").alias("up"), F.col("w").alias("up_w"), split.alias("begins")).select("c.*", "up", "up_w", "begins")
    top = tree.agg(F.max("rank").alias("node")).filter("node is not null")
    child = written(child, "condense-child")
    whole = points.agg(F.sum("n").alias("size")).first()["size"] or 0
    if whole < least:
        none = points.select("id", F.lit(None).cast("long").alias("cluster"))
        return none, none.limit(0).select("cluster", F.lit(None).cast("long").alias("parent"), F.lit(0.0).alias("stability"))
    root = top.select("node") if top.limit(1).count() else leaf.select("node")
    starts = child.filter("begins").select("node", F.col("up"), F.col("up_w")).unionByName(root.select("node", F.lit(None).cast("long").alias("up"), F.lit(None).cast("double").alias("up_w")))
    big = child.filter((F.col("size") >= least) & ~F.col("begins")).select("node", "up").unionByName(starts.select("node", F.col("node").alias("up")))
    cluster_of = doubled(written(big, "condense-big"), "node", "up", "condense-cluster", segment).withColumnRenamed("up", "cluster")
    cluster_of = written(cluster_of, "condense-of")
    small = (F.col("sl") < least) & (F.col("sr") < least)
    leaves = F.when(split | small, F.col("sl") + F.col("sr")).otherwise(F.least("sl", "sr"))
    falls = tree.filter(F.col("sl") + F.col("sr") >= least).select(F.col("rank").alias("node"), _density("w").alias("at"), leaves.alias("n"))
    falls = falls.unionByName(leaf.filter(F.col("size") >= least).select("node", _density("core").alias("at"), F.col("size").alias("n")))
    born = starts.select(F.col("node").alias("cluster"), F.when(F.col("up").isNull(), F.lit(0.0)).otherwise(_density("up_w")).alias("birth"), F.col("up").alias("_up"))
    stable = falls.join(cluster_of, "node").join(born, "cluster").groupBy("cluster").agg(F.sum((F.col("at") - F.col("birth")) * F.col("n")).alias("stability"))
    over = born.join(cluster_of.select(F.col("node").alias("_up"), F.col("cluster").alias("parent")), "_up", "left").select("cluster", "parent")
    clusters = written(over.join(stable, "cluster", "left").withColumn("stability", F.coalesce("stability", F.lit(0.0))), "condense-clusters")
    # small nodes climb to the first merge that is large; at most ``least`` of them lie on a way
    lift = child.filter(F.col("size") < least).select("node", "up").unionByName(cluster_of.select("node", F.col("node").alias("up")))
    lift = doubled(written(lift, "condense-lift"), "node", "up", "condense-climb", segment).withColumnRenamed("up", "_big")
    left = points.select("id", (-F.col("id")).alias("node")).join(lift, "node").join(cluster_of.select(F.col("node").alias("_big"), "cluster"), "_big").select("id", "cluster")
    return left, clusters


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cluster, parent, stability) of one bounded group -> (cluster, chosen). A cluster begins below its parent, so that
    its number is smaller."""
    rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[0])
    below: dict[int, float] = {}
    own: set[int] = set()
    for cluster, parent, stability in rows:
        under = below.get(cluster)
        if parent is not None and (under is None or stability >= under):
            own.add(cluster)
        below[parent] = below.get(parent, 0.0) + (stability if cluster in own else under or 0.0)
    best: dict[int, int | None] = {}
    for cluster, parent, _ in reversed(rows):
        best[cluster] = best.get(parent) if best.get(parent) is not None else cluster if cluster in own else None
    yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(list(best.values()), pa.int64())], ["cluster", "chosen"])


def chosen(clusters: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(cluster, chosen): for every cluster the one it belongs to, null outside all. From the leaves up, a cluster is
    worth its stability or what the clusters below are worth, whichever is more; the root isn't chosen. At most
    ``segment`` clusters are chosen in one bounded group, more a level per round."""
    if clusters.count() <= segment:
        return clusters.select("cluster", "parent", "stability").coalesce(1).mapInArrow(_chosen, "cluster long, chosen long")
    open_ = clusters
    done = None
    while open_.limit(1).count():
        parents = open_.select(F.col("parent").alias("cluster")).filter("cluster is not null").distinct()
        ready = open_.join(parents, "cluster", "left_anti")
        if done is not None:
            below = done.groupBy(F.col("parent").alias("cluster")).agg(F.sum("worth").alias("below"))
            ready = ready.join(below, "cluster", "left")
        else:
            ready = ready.withColumn("below", F.lit(None).cast("double"))
        own = F.col("parent").isNotNull() & (F.col("below").isNull() | (F.col("stability") >= F.col("below")))
        level = ready.select("cluster", "parent", F.when(own, F.col("stability")).otherwise(F.coalesce("below", F.lit(0.0))).alias("worth"), own.alias("own"))
        done = written(level if done is None else done.unionByName(level), "chosen-done")
        open_ = written(open_.join(done.select("cluster"), "cluster", "left_anti"), "chosen-open")
    if done is None:
        return clusters.select("cluster", F.col("cluster").alias("chosen"))
    # the topmost cluster that is worth its own stability, on the way up
    ways = done.select("cluster", F.coalesce("parent", "cluster").alias("up"), F.when(F.col("own"), F.col("cluster")).alias("best"))
    while True:
        at = ways.select(F.col("cluster").alias("_c"), F.col("up").alias("_u"), F.col("best").alias("_b"))
        after = written(ways.join(at, F.col("up") == F.col("_c")).select("cluster", F.col("_u").alias("_next"), "up", F.coalesce("_b", "best").alias("best")), "chosen-ways")
        moved = after.filter("_next <> up").limit(1).count()
        ways = after.select("cluster", F.col("_next").alias("up"), "best")
        if not moved:
            return ways.select("cluster", F.col("best").alias("chosen"))


def hdbscan(df: DataFrame, columns: list[str], key: str, least: int = 5, min_samples: int | None = None, name: str = "hdbscan", shard_rows: int = SHARD_ROWS, segment: int = SEGMENT, points: DataFrame | None = None, dealt: tuple[DataFrame, Boxes] | None = None) -> DataFrame:
    """df with a cluster's number, from 0 in the order of the clusters' smallest keys, or -1 for noise. points, dealt:
    df's distinct_points and dealt_points, where they are known."""
    points = distinct_points(df, columns, key) if points is None else points
    if not points.limit(1).count():
        return df.withColumn(name, F.lit(-1))
    dealt, boxes = dealt_points(points, len(columns), shard_rows) if dealt is None else dealt
    dealt = core_distances(dealt, boxes, min_samples or max(2, least // 2))
    weighed = written(dealt.select("id", "n", "core"), "density-points")
    tree = merges(weighed, spanning_tree(dealt, boxes, segment), segment)
    left, clusters = condensed(weighed, tree, least, segment)
    label = written(left.join(chosen(clusters, segment), "cluster", "left").select("id", "chosen"), "density-labels")
    names = places(label.filter("chosen is not null").groupBy("chosen").agg(F.min("id").alias("_first")), [F.asc("_first")], "_place")
    label = label.join(names, "chosen", "left").select("id", (F.coalesce("_place", F.lit(0)) - 1).cast("int").alias(name))
    x = F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in columns])
    found = points.select("id", F.col("x").alias("_x")).join(label, "id").drop("id")
    return df.withColumn("_y", x).join(found, F.col("_y") == F.col("_x")).select(*df.columns, name)


def hdbscan_sizes(df: DataFrame, columns: list[str], key: str, sizes: tuple[int, ...] = (5, 8, 10)) -> DataFrame:
    """df once per least size of a cluster: adds min_cluster_size and hdbscan."""
    out, points = None, distinct_points(df, columns, key)
    dealt = dealt_points(points, len(columns)) if points.limit(1).count() else None
    for least in sizes:
        part = written(hdbscan(df, columns, key, least, points=points, dealt=dealt), "hdbscan").withColumn("min_cluster_size", F.lit(least))
        out = part if out is None else out.unionByName(part)
    return out


def size_selection(labelled: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Of ``hdbscan_sizes``, a row per size: clusters, noise, coverage, silhouette without noise, the product of both,
    and selected. Of sizes with two clusters the largest product wins; where there is none, the least noise."""
    rows = []
    for r in labelled.groupBy("min_cluster_size").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hdbscan") == -1).alias("noise"), F.count_distinct(F.when(F.col("hdbscan") >= 0, F.col("hdbscan"))).alias("found")).collect():  # a row per size
        least, share = r["min_cluster_size"], r["noise"] / r["n"]
        sil = silhouette(labelled.filter((F.col("min_cluster_size") == least) & (F.col("hdbscan") >= 0)), "hdbscan", columns, key) if r["found"] >= 2 else None
        rows.append((least, max(2, least // 2), r["found"], r["noise"], share, 1 - share, sil, None if sil is None else sil * (1 - share)))
    best = min(rows, key=lambda r: (r[7] is None, -(r[7] or 0), -(r[6] or 0), -r[5] if r[7] is not None else r[4], r[0]), default=(None,))[0]
    form = "min_cluster_size int, min_samples int, n_clusters long, n_noise long, noise_ratio double, coverage double, silhouette double, balanced_score double, selected boolean"
    return labelled.sparkSession.createDataFrame([(*r, r[0] == best) for r in rows], form)
