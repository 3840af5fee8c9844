"""Exact top-k inner-product search with dual cover trees.

1. A bounded sample of vectors gives pivots and every query's starting score: the k-th best among the sample, which
   no answer of that query can fall below. Vectors are dealt to shards by their nearest pivot, so that a shard has a
   small radius; pivots with many vectors have several shards of bounded size.
2. A query is sent only to shards that its starting score, the pivot and the shard's radius leave open. A shard and a
   block of queries make one group of bounded size.
3. In a group both sides get a cover tree, and both are descended together, a whole level of node pairs at a time. A
   pair of nodes, inner ones included, is pruned when the largest inner product that its centres and covering radii
   allow is below the worst k-th score of the query node's group. Pairs of leaves that are left are scored best bound
   first, many leaves in one product, and scores are compared with the k-th before anything is sorted.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, and every other vector
does; scores are exact, and those beyond +-(2**63 - 1) count as these; shorter vectors count as ending in zeros; equal
scores rank by smaller id; repeated rows of an id count once per row, and a query is never matched with its own id;
null ids take no part; further columns are not read; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import BROADCAST_KEYS, materialize, shuffle_parts, small_batches

SHARD_ROWS, BLOCK_ROWS = 4096, 4096
#: Vectors in the sample that gives starting scores, and how many of them are pivots at most.
SAMPLE, PIVOTS = 1024, 256
LEAF, FANOUT = 64, 12
#: Points whose scores are taken in one product.
CHUNK = 2048
SCALE, GIANT = 256, 2.0**63
LOW, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The usable rows (not null, all components finite) as float64, padded with zeros, and their places."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become nan
    row, start = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
    ok = ~np.asarray(column.is_null())
    ok[row[~np.isfinite(flat)]] = False
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[row, np.arange(len(flat)) - start[row]] = flat
    return out[ok], np.flatnonzero(ok)


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """floor(SCALE * x), and which rows are giants: some component leaves a long."""
    with np.errstate(over="ignore"):
        q = np.floor(SCALE * x)
    return q, (np.abs(q) >= GIANT).any(axis=1)


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) in Python integers, of any size."""
    one = lambda v: int(v) * SCALE if abs(v) >= 2.0**53 else int(np.floor(SCALE * v))
    return np.array([[one(v) for v in r] for r in x.tolist()], object).reshape(x.shape)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x**2).sum(axis=1))


def inner(x: np.ndarray, y: np.ndarray, xn: np.ndarray, yn: np.ndarray) -> np.ndarray:
    """Exact inner products of scaled rows: in float64 while norms keep them in its integers, else in long, else in
    Python's integers."""
    s, most = x @ y.T, xn[:, None] * yn
    if not most.size or most.max() < 2**52:
        return s.astype(np.int64)
    out = np.where(most < 2**52, s, 0).astype(np.int64)
    for at, form in (((most >= 2**52) & (most < 2**62), np.int64), (most >= 2**62, object)):
        i, j = np.flatnonzero(at.any(axis=1)), np.flatnonzero(at.any(axis=0))
        if len(i):
            exact = x[i].astype(np.int64).astype(form) @ y[j].astype(np.int64).astype(form).T
            mine = at[np.ix_(i, j)]
            out[np.ix_(i, j)] = np.where(mine, np.clip(exact, -MOST, MOST), out[np.ix_(i, j)]).astype(np.int64)
    return out


def limit(dot: np.ndarray, qn: np.ndarray, qr: np.ndarray, pn: np.ndarray, pr: np.ndarray) -> np.ndarray:
    """The largest inner product of a point within qr of one centre and one within pr of the other, rounding
    included (sums are off by a share of the norms). Nan where a radius has no bound."""
    with np.errstate(invalid="ignore"):
        return dot + qr * pn + pr * qn + qr * pr + (qn + qr) * (pn + pr) * 1e-9 + 1


class CoverTree:
    """Nodes breadth first. Covering: a node's points are within ``radius``, at most 2 ** ``level``, of its centre.
    Separation: the centres of a node's children are at least their largest radius apart. Nesting: a node's centre is
    also its first child's."""

    def __init__(self, points: np.ndarray):
        self.points = points
        centre, radius, first, count, self.members, self.parent = [], [], [], [], [], []
        every = np.arange(len(points))
        pending = [(every, 0, self._distance(every, 0), -1)] if len(points) else []
        for rows, c, distance, parent in pending:  # grows while it is walked
            centre.append(c)
            radius.append(float(distance.max()) * (1 + 1e-9))
            self.parent.append(parent)
            parts = self._split(rows, c, distance) if len(rows) > LEAF and radius[-1] > 0 else []
            first.append(len(pending))
            count.append(len(parts))
            self.members.append(rows if not parts else None)
            pending += [(*p, len(centre) - 1) for p in parts]
        self.radius, self.first, self.count = np.array(radius), np.array(first, np.int64), np.array(count, np.int64)
        self.level = np.ceil(np.log2(np.maximum(self.radius, 1e-300)))
        self.centre = np.array(centre, np.int64)
        self.at = points[self.centre]
        self.norm, self.leaf = norms(self.at), self.count == 0

    def _distance(self, rows: np.ndarray, centre: int) -> np.ndarray:
        return norms(self.points[rows] - self.points[centre])

    def _split(self, rows: np.ndarray, centre: int, distance: np.ndarray) -> list[tuple[np.ndarray, int, np.ndarray]]:
        """Farthest-first centres until the children are two levels down or FANOUT is reached."""
        nearest, owner, centres, enough = distance.copy(), np.zeros(len(rows), np.int64), [centre], distance.max() / 4
        while len(centres) < FANOUT and nearest.max() > enough:
            far = int(rows[nearest.argmax()])
            d = self._distance(rows, far)
            closer = d < nearest
            owner[closer], nearest = len(centres), np.where(closer, d, nearest)
            centres.append(far)
        return [(rows[owner == k], c, nearest[owner == k]) for k, c in enumerate(centres)]

    def below(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child and number of children; a leaf stands for itself."""
        return np.where(self.leaf[nodes], nodes, self.first[nodes]), np.maximum(self.count[nodes], 1)


class DualSearch:
    """queries and points: scaled rows without giants. start: scores that a query's answers don't fall below."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, start: np.ndarray | None = None):
        width = max(queries.shape[1], points.shape[1])
        pad = lambda x: np.pad(x, ((0, 0), (0, width - x.shape[1])))
        self.q, self.p, self.k = CoverTree(pad(queries)), CoverTree(pad(points)), k
        self.qid, self.pid = query_ids, ids
        self.score = np.full((len(query_ids), k), LOW)
        self.found = np.full((len(query_ids), k), MOST)
        self.least = np.full(len(query_ids), LOW) if start is None else start.copy()
        self.qn, self.pn = norms(self.q.points), norms(self.p.points)
        self.pairs = self.pruned = self.pruned_inner = 0

    def bound(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        q, p = self.q, self.p
        return limit(np.einsum("ij,ij->i", q.at[a], p.at[b]), q.norm[a], q.radius[a], p.norm[b], p.radius[b])

    def add(self, rows: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        """Takes scores (rows x ids) into the rows' k best."""
        take = (s >= self.least[rows][:, None]) & (ids != self.qid[rows][:, None])
        if s.shape[1] > self.k and take.sum() > 2 * self.k * len(rows):
            kth = np.partition(np.where(take, s, LOW), -self.k, axis=1)[:, -self.k]
            take &= s >= kth[:, None]
        i, j = np.nonzero(take)
        if not len(i):
            return
        own, n = np.unique(i), len(rows)
        row = np.concatenate([np.repeat(own, self.k), i])
        score, found = np.concatenate([self.score[rows[own]].ravel(), s[i, j]]), np.concatenate([self.found[rows[own]].ravel(), ids[j]])
        order = np.lexsort((found, ~score, row))
        begin = np.cumsum(np.bincount(row, minlength=n)) - np.bincount(row, minlength=n)
        order = order[(begin[own][:, None] + np.arange(self.k)).ravel()]
        self.score[rows[own]], self.found[rows[own]] = score[order].reshape(-1, self.k), found[order].reshape(-1, self.k)
        self.least[rows] = np.maximum(self.least[rows], self.score[rows, -1])

    def _base(self, a: int, leaves: list[int]) -> None:
        rows, at = self.q.members[a], np.concatenate([self.p.members[b] for b in leaves])
        self.add(rows, self.pid[at], inner(self.q.points[rows], self.p.points[at], self.qn[rows], self.pn[at]))

    def _worst(self) -> np.ndarray:
        """The worst k-th score below each query node."""
        out = np.full(len(self.q.parent), np.inf)
        for a in range(len(out) - 1, -1, -1):
            if self.q.leaf[a]:
                out[a] = self.least[self.q.members[a]].min()
            if a:
                out[self.q.parent[a]] = min(out[self.q.parent[a]], out[a])
        return out

    def _descend(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of leaves that no bound prunes, with their bounds."""
        worst, a, b, out = self._worst(), np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(a):
            most = self.bound(a, b)
            keep, deep = ~(most < worst[a]), ~(self.q.leaf[a] & self.p.leaf[b])
            self.pairs, self.pruned, self.pruned_inner = self.pairs + len(a), self.pruned + int((~keep).sum()), self.pruned_inner + int((~keep & deep).sum())
            end = keep & ~deep
            out.append((a[end], b[end], most[end]))
            a, b = a[keep & deep], b[keep & deep]
            (fa, na), (fb, nb) = self.q.below(a), self.p.below(b)
            each = np.repeat(np.arange(len(a)), na * nb)
            at = np.arange(len(each)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
            a, b = fa[each] + at // nb[each], fb[each] + at % nb[each]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def search(self) -> None:
        if not len(self.qid) or not len(self.pid):
            return
        leaves, primed = np.flatnonzero(self.p.leaf), {}
        for a in np.flatnonzero(self.q.leaf).tolist():  # the leaf of the best centre first, so that bounds have scores to beat
            primed[a] = int(leaves[(self.p.at[leaves] @ self.q.at[a]).argmax()])
            self._base(a, [primed[a]])
        a, b, most = self._descend()
        order = np.lexsort((b, -most, a))
        a, b, most = a[order], b[order], most[order]
        cut = np.flatnonzero(np.diff(a, prepend=-1, append=-1))
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            rows, size, batch = self.q.members[a[i]], 0, []
            for at in range(i, j):
                if most[at] < self.least[rows].min():
                    self.pruned += j - at
                    break
                if b[at] != primed[int(a[at])]:
                    batch.append(int(b[at]))
                    size += len(self.p.members[b[at]])
                if size >= CHUNK:
                    self._base(int(a[i]), batch)
                    size, batch = 0, []
            if batch:
                self._base(int(a[i]), batch)

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ok = self.found != MOST
        row = np.repeat(np.arange(len(self.qid)), ok.sum(axis=1))
        return self.qid[row], self.found[ok], self.score[ok]


def search(queries: np.ndarray, query_ids: np.ndarray, start: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k best points (unscaled, as the queries) of each query: query id, id, score. Giants are scored beside the trees,
    in Python's integers."""
    width = max(queries.shape[1], points.shape[1])
    queries, points = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (queries, points))
    (q, qg), (p, pg) = scaled(queries), scaled(points)
    dual = DualSearch(q[~qg], query_ids[~qg], p[~pg], ids[~pg], k, start[~qg])
    if pg.any() and len(dual.qid):
        dual.add(np.arange(len(dual.qid)), ids[pg], np.clip(whole(queries[~qg]) @ whole(points[pg]).T, -MOST, MOST).astype(np.int64))
    dual.search()
    out = [dual.results()]
    if qg.any():
        every = DualSearch(np.zeros((int(qg.sum()), 0)), query_ids[qg], np.zeros((0, 0)), np.zeros(0, np.int64), k)
        for at in range(0, len(ids), CHUNK):
            every.add(np.arange(len(every.qid)), ids[at : at + CHUNK], np.clip(whole(queries[qg]) @ whole(points[at : at + CHUNK]).T, -MOST, MOST).astype(np.int64))
        out.append(every.results())
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Sample:
    """The sampled vectors; the first ``pivots`` of them are pivots."""

    def __init__(self, ids: list[int], vectors: list[list], pivots: int):
        x, ok = matrix(pa.array(vectors, pa.list_(pa.float64())))
        self.x, giant = scaled(x)
        self.x, self.ids = self.x[~giant], np.array(ids, np.int64)[ok][~giant]
        self.n, self.norm = min(pivots, len(self.x)), norms(self.x)

    def fit(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x and the sample's vectors, both of the wider width."""
        width = max(x.shape[1], self.x.shape[1])
        return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, self.x))

    def nearest(self, x: np.ndarray, giant: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot of each scaled row and the distance; giants have no bound."""
        if not self.n:
            return np.zeros(len(x), np.int32), np.full(len(x), np.inf)
        x, p = self.fit(np.where(giant[:, None], 0, x))
        far = (p[: self.n] ** 2).sum(axis=1) - 2 * x @ p[: self.n].T
        at = far.argmin(axis=1).astype(np.int32)
        return at, np.where(giant, np.inf, norms(x - p[at]) * (1 + 1e-9))

    def start(self, x: np.ndarray, giant: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """Each query's k-th best score among the sample's other ids."""
        if len(self.x) <= k or not len(x):
            return np.full(len(x), LOW)
        x, p = self.fit(np.where(giant[:, None], 0, x))
        s = np.where(self.ids == ids[:, None], LOW, inner(x, p, norms(x), self.norm))
        return np.where(giant, LOW, np.partition(s, -k, axis=1)[:, -k])


def _deal(batches: Iterator[pa.RecordBatch], sample: Sample, k: int) -> Iterator[pa.RecordBatch]:
    """(id, vec, q) -> the usable rows with nearest pivot, distance from it, and the starting score of queries."""
    for batch in batches:
        x, ok = matrix(batch.column(1))
        x, giant = scaled(x)
        batch = batch.take(pa.array(ok))
        pivot, far = sample.nearest(x, giant)
        asks, start = np.asarray(batch.column(2)), np.full(len(ok), LOW)
        start[asks] = sample.start(x[asks], giant[asks], batch.column(0).to_numpy()[asks], k)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(far), pa.array(start)], ["id", "vec", "q", "pivot", "far", "start"])


def _open(batches: Iterator[pa.RecordBatch], sample: Sample, radius: dict[int, float], shards: dict[int, list[int]]) -> Iterator[pa.RecordBatch]:
    """(id, vec, start, pivot) of queries -> with the shards that bounds leave open."""
    for batch in batches:
        x, _ = matrix(batch.column(1))
        x, giant = scaled(x)
        start = batch.column(2).to_numpy()
        out: list[list[int]] = [[] for _ in range(len(x))]
        x, p = sample.fit(np.where(giant[:, None], 0, x))
        xn = norms(x)
        for pivot, far in radius.items():
            left = np.ones(len(x), bool)
            if sample.n and np.isfinite(far):
                left = giant | ~(limit(x @ p[pivot], xn, 0, sample.norm[pivot], far) < start)
            for i in np.flatnonzero(left).tolist():
                out[i] += shards[pivot]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], ["id", "vec", "start", "pivot", "shards"])


def _groups(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (cell, id, vec, start) sorted by cell, a bounded group of points (start null) and queries -> answers."""
    held: list[pa.RecordBatch] = []

    def solve() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        x, ok = matrix(t.column("vec"))
        point = np.asarray(t.column("start").combine_chunks().is_null())[ok]
        ids, start = t.column("id").to_numpy()[ok], pc.fill_null(t.column("start"), 0).to_numpy()[ok]
        a, b, s = search(x[~point], ids[~point], start[~point], x[point], ids[point], k)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.int64())], ["query_id", "vec_id", "score"])

    cell = None
    for batch in batches:
        cells = batch.column(0).to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
        for i, j in zip(cut, cut[1:], strict=False):
            if i == j:
                continue
            if held and cells[i] != cell:
                yield solve()
                held.clear()
            cell = cells[i]
            held.append(batch.slice(i, j - i))
    if held:
        yield solve()


def _small(table: DataFrame) -> DataFrame:
    """A written table with a row per shard, or per shard and pivot: broadcast up to BROADCAST_KEYS rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_KEYS else table


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of the other rows."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("q")).filter("id is not null and vec is not null")
    picked = rows.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()  # bounded by SAMPLE
    sample = Sample([r["id"] for r in picked], [r["vec"] for r in picked], max(1, min(PIVOTS, -(-vectors.count() // shard_rows))))
    kind = rows.schema["vec"].dataType.simpleString()
    dealt = materialize(small_batches(rows).mapInArrow(partial(_deal, sample=sample, k=k), f"id long, vec {kind}, q boolean, pivot int, far double, start long"), "top-dealt")
    stats = dealt.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("asked"), F.max("far").alias("far")).orderBy("pivot").collect()  # bounded by PIVOTS
    if not stats:
        return dealt.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.col("start").alias("score")).limit(0)
    shards, radius, n = {}, {}, 0
    for r in stats:
        shards[r["pivot"]] = list(range(n, n + -(-r["n"] // shard_rows)))
        radius[r["pivot"]], n = r["far"], n + len(shards[r["pivot"]])
    # a pivot's rows go to its shards in turn, whatever ids they have
    first = F.create_map(*[F.lit(x) for p, s in shards.items() for x in (p, s[0])])[F.col("pivot")]
    several = F.create_map(*[F.lit(x) for p, s in shards.items() for x in (p, len(s))])[F.col("pivot")]
    shard = (first + F.pmod(F.monotonically_increasing_id(), several)).cast("int")
    opened = small_batches(dealt.filter("q").select("id", "vec", "start", "pivot")).mapInArrow(partial(_open, sample=sample, radius=radius, shards=shards), f"id long, vec {kind}, start long, pivot int, shards array<int>")
    asked = materialize(opened, "top-asked").withColumn("shard", F.explode("shards")).drop("shards")
    # a shard's askers go to blocks of block_rows in the order of their pivots, and the shard to as many blocks
    near = asked.groupBy("shard", "pivot").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("shard").orderBy("pivot")  # PIVOTS rows at most
    near = near.withColumns({"before": F.sum("n").over(order) - F.col("n"), "every": F.sum("n").over(Window.partitionBy("shard"))})
    near = materialize(near.withColumn("blocks", F.ceil(F.col("every") / block_rows).cast("long")), "top-blocks")
    blocks = near.select("shard", "blocks").distinct()
    cell = lambda block: (F.col("shard").cast("long") * (1 << 24) + block).alias("cell")
    copies = dealt.select("id", "vec", shard.alias("shard")).join(_small(blocks), "shard").select("id", "vec", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    points = copies.select(cell(F.col("block")), "id", "vec", F.lit(None).cast("long").alias("start"))
    at = F.floor((F.col("before") + F.pmod(F.xxhash64("id"), F.col("n"))) * F.col("blocks") / F.col("every")).cast("long")
    queries = asked.join(_small(near), ["shard", "pivot"]).select(cell(at), "id", "vec", "start")
    parts = max(1, min(blocks.agg(F.sum("blocks")).first()[0] or 1, shuffle_parts(vectors.sparkSession)))
    part = F.pmod(F.shiftright("cell", 24) + F.col("cell").bitwiseAND((1 << 24) - 1), F.lit(parts)).cast("int")
    groups = points.unionByName(queries).repartitionById(parts, part).sortWithinPartitions("cell")
    found = small_batches(groups).mapInArrow(partial(_groups, k=k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
