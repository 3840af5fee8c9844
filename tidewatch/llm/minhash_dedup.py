"""Near-duplicate linking: MinHash bands, sequential Bayesian verification, exact verification, components.

1. Every text becomes its set of word-shingle hashes, a 128-value MinHash signature and its band keys (25 bands of
   5 values; 32 of 4 for thresholds under 0.85). Equal sets are one class, represented by its smallest id; only
   representatives go on.
2. Representatives that share a band key are candidates. Signatures are compared 32 values at a time; a pair is
   pruned once the posterior probability (uniform prior) that its similarity reaches the threshold falls below
   ``miss``. Survivors are confirmed on their full sets.
3. A bucket's members are not paired with each other. Star rounds compare each with one member drawn by hash and
   contract what is linked; only pairs of different components are still open, and a last pass compares those in
   blocks of bounded size inside the tasks: signatures first, which tell the rows that have a partner to look at, then
   the sets of these rows alone, where each link merges two labels. So no link between components is lost, no task
   emits more rows or links than it reads, and sets are copied for rows with open partners only.
4. Components come from repeated contraction over the links, on Spark, each step in a written table.

Defined cases: null or blank text has an empty set, which links with nothing; texts of fewer words than a shingle
are one shingle of all their words; rows that share an id are decided each by its own text, and ``near_dedup`` drops
such a row only if its own text's component has a smaller id; a null id links with nothing and has component null;
empty tables give empty results; no bucket, group or partner count is capped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bytes as tb
from ._common import attach_groups, drop_rows, materialize, release, shuffle_parts, small_batches

PERMS, ROWS, BANDS, STEP = 128, 5, 25, 32
#: Where the star rounds' bands begin; later rounds pair only what earlier ones left unlinked.
ROUNDS = (0, 2, 8)
#: A block of a bucket holds about this many signatures, or this many rows with their sets and set members, at most.
SIGNATURE_ROWS, BLOCK_ROWS, BLOCK_HASHES = 4096, 1024, 1 << 20
PIVOT_ROWS = 4096

_rng = np.random.Generator(np.random.PCG64(8))
_XOR = _rng.integers(0, 1 << 32, PERMS, dtype=np.uint64).astype(np.uint32)
_MUL = _rng.integers(0, 1 << 31, PERMS, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_WORD = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes."""
    data, off = tb.text_buffer(column)
    for i, j in tb.slices(off):
        buf, own = tb.LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i]
        starts, ends, first = tb.words(buf, own)
        h = tb.segment_hash(buf, starts, ends)
        n = max(0, len(h) - k + 1)
        s = np.zeros(n, np.uint64)
        for at in range(k if n else 0):
            s += h[at : at + n] * _WORD[at]
        s = tb.mix64(s)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(s[a : b - k + 1])
            elif b > a:
                yield tb.mix64((h[a:b] * _WORD[: b - a]).sum(keepdims=True) + _WORD[63 - (b - a) : 64 - (b - a)])
            else:
                yield np.zeros(0, np.uint64)


def signature(u: np.ndarray) -> np.ndarray:
    x, out = (u >> np.uint64(32)).astype(np.uint32), np.full(PERMS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(out, ((x[i : i + 4096, None] ^ _XOR) * _MUL).min(axis=0), out=out)
    return out


def band_shape(percent: int) -> tuple[int, int]:
    """(values in a band, bands) that miss a pair at the threshold with a chance of 5e-7 at most, from 80 on."""
    return (ROWS, BANDS) if percent >= 85 else (4, 32)


def band_keys(sigs: np.ndarray, width: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """rows x bands keys; the band's number is part of its key."""
    x = sigs[:, : bands * width].reshape(-1, bands, width).astype(np.uint64)
    h = np.repeat(np.arange(bands, dtype=np.uint64)[None, :], len(x), axis=0)
    for r in range(width):
        h = tb.mix64((h ^ x[:, :, r]) + np.uint64(0x9E3779B97F4A7C15))
    return h.view(np.int64)


@lru_cache
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """For each step: the fewest matches among the values so far that keep a pair. Signature values are bytes,
    so unlike values match with 1 in 256; the posterior of the match rate is Beta(matches + 1, misses + 1)."""
    t, out = threshold + (1 - threshold) / 256, []
    for n in range(STEP, PERMS + 1, STEP):
        tail = lambda m, n=n: math.fsum(math.comb(n + 1, j) * t**j * (1 - t) ** (n + 1 - j) for j in range(m + 1))  # noqa: E731  P(rate >= t)
        out.append(next((m for m in range(n + 1) if tail(m) >= miss), n))
    return tuple(out)


def _alive(x: np.ndarray, y: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Rows of x and y (signature bytes) that no step prunes."""
    at, seen = np.arange(len(x)), np.zeros(len(x), np.int64)
    for i, m in enumerate(least):
        part = slice(i * STEP, (i + 1) * STEP)
        seen = seen + (x[at, part] == y[at, part]).sum(axis=1)
        keep = seen >= m
        at, seen = at[keep], seen[keep]
    return at


def _fingerprint(u: np.ndarray) -> bytes:
    return hashlib.blake2b(u.tobytes(), digest_size=16).digest()


def _binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def _sketch(batches: Iterator[pa.RecordBatch], k: int, width: int, bands: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, fp, sigs = [], [], []
        for u in shingle_sets(batch.column(1), k):
            n.append(len(u))
            fp.append(_fingerprint(u))
            sigs.append(signature(u))
        m = np.array(sigs, np.uint32).reshape(-1, PERMS)
        keys = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(m, width, bands).ravel()), bands).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), _binary(fp), _binary([r.tobytes() for r in m.astype(np.uint8)]), keys], ["id", "th", "n", "fp", "sig", "bands"])
    release()


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(node, text, fp) -> the sets of the nodes; another text of the node's id has another fingerprint."""
    for batch in batches:
        sets = list(shingle_sets(batch.column(1), k))
        own = [i for i, (u, fp) in enumerate(zip(sets, batch.column(2).to_pylist(), strict=True)) if _fingerprint(u) == fp]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), _binary([sets[i].tobytes() for i in own])], ["id", "payload"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(x.as_buffer(), np.uint8) for x in column], np.uint8).reshape(-1, PERMS)


def _stream_bayes(batches: Iterator[pa.RecordBatch], least: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Rows (a, salt, b, payload) sorted with each pivot's own row (b null) first -> pairs not pruned."""
    last_a, last = None, None
    for batch in batches:
        a, b = batch.column("a").to_numpy(zero_copy_only=False), batch.column("b")
        own = np.asarray(b.is_null())
        m = _matrix(batch.column("payload"))
        if last is not None:
            a, own, m = np.concatenate([[last_a], a]), np.concatenate([[True], own]), np.concatenate([last[None], m])
        at = np.maximum.accumulate(np.where(own, np.arange(len(a)), -1))
        rows = np.flatnonzero(~own)
        rows = rows[_alive(m[at[rows]], m[rows], least)]
        if len(a):
            last_a, last = a[at[-1]], m[at[-1]].copy()
        yield pa.RecordBatch.from_arrays([pa.array(a[rows], pa.int64()), b.take(pa.array(rows - (len(a) - len(b)), pa.int64()))], ["a", "b"])


def _stream_exact(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """As _stream_bayes with full sets as payload: pairs with den * intersection >= num * union."""
    pivot = np.zeros(0, np.uint64)
    for batch in batches:
        out: list[tuple[int, int]] = []
        for a, b, x in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("payload"), strict=True):
            u = np.frombuffer(x.as_buffer(), np.uint64)
            if b is None:
                pivot = u.copy()
                continue
            both = len(u) + len(pivot) - len(np.union1d(u, pivot))
            if den * both >= num * (len(u) + len(pivot) - both):
                out.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])


def _both(u: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted set with others."""
    every = np.concatenate(sets)
    at = np.searchsorted(u, every)
    hit = np.append(u, 0)[at] == every
    hit &= at < len(u)
    return np.add.reduceat(hit, np.cumsum([0, *map(len, sets[:-1])]), dtype=np.int64)


def _candidates(t: pa.Table, label: np.ndarray, least: tuple[int, ...], num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a block pair the later rows whose label is another, now, and which neither sizes nor signatures rule out."""
    i, j, band, own, n = (t.column(c).to_numpy() for c in ("i", "j", "band", "own", "n"))
    m = _matrix(t.column("sig").combine_chunks())
    keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(len(t), -1)[:, : band[0]]
    for r in range(len(t) - 1):
        q = np.arange(r + 1, len(t))
        q = q[(label[q] != label[r]) & (den * np.minimum(n[q], n[r]) >= num * np.maximum(n[q], n[r]))]
        if i[0] != j[0]:
            q = q[own[q] != own[r]]
        if len(q):
            q = q[_alive(np.broadcast_to(m[r], (len(q), PERMS)), m[q], least)]
        if len(q):
            q = q[~(keys[q] == keys[r]).any(axis=1)]  # a pair is compared in the first band that it shares
        if len(q):
            yield r, q


def _open_rows(t: pa.Table, least: tuple[int, ...], num: int, den: int) -> pa.Table:
    """Rows of a block pair that have a partner whose set is worth a look."""
    label, found = t.column("label").to_numpy(), np.zeros(len(t), bool)
    if not (label == label[0]).all():
        for r, q in _candidates(t, label, least, num, den):
            found[r] = True
            found[q] = True
    return t.select(["h", "band", "id", "label", "n"]).filter(pa.array(found))


def _link_block(t: pa.Table, least: tuple[int, ...], num: int, den: int) -> pa.Table:
    """A spanning forest of the links that one block pair adds to the labels its rows come with."""
    ids, n, label, out = t.column("id").to_numpy(), t.column("n").to_numpy(), t.column("label").to_numpy().copy(), []
    if not (label == label[0]).all():
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("payload")]
        for r, q in _candidates(t, label, least, num, den):
            both = _both(sets[r], [sets[k] for k in q.tolist()])
            for k in q[den * both >= num * (n[q] + n[r] - both)].tolist():
                if label[k] != label[r]:
                    label[label == label[k]] = label[r]
                    out.append((min(ids[r], ids[k]), max(ids[r], ids[k])))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _blocks(batches: Iterator[pa.RecordBatch], fn: Callable[[pa.Table], pa.Table]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, i, j), a block pair of bounded size each -> what fn makes of each."""
    carry: pa.Table | None = None
    for last in (False, True):
        for batch in batches if not last else [None]:
            t = carry if last else pa.Table.from_batches([batch])
            if t is None or not len(t):
                continue
            if carry is not None and not last:
                t = pa.concat_tables([carry, t])
            h, i, j = (t.column(c).to_numpy() for c in ("h", "i", "j"))
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])).tolist()
            ends = [*new[1:], len(t)]
            for s, e in list(zip(new, ends, strict=True))[: None if last else -1]:
                yield from fn(t.slice(s, e - s)).to_batches()
            carry = t.slice(new[-1])


def _in_blocks(rows: DataFrame, blocks: Column, payload: Callable[[DataFrame], DataFrame], fn: Callable, schema: str, total: int) -> DataFrame:
    """Runs fn over all pairs of blocks of each bucket of rows (h, band, id, label, n) that has two labels or more;
    payload adds columns by id."""
    span = rows.groupBy("h").agg(F.min("label").alias("fewest"), F.max("label").alias("most"), F.count(F.lit(1)).alias("size"), blocks.cast("int").alias("blocks"))
    span = materialize(span.filter("most <> fewest").select("h", "size", "blocks"), "near-span")
    rows = attach_groups(rows, span, "h", "size", total).withColumn("own", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("h", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "label", "n")
    rows = payload(rows).repartition(shuffle_parts(rows.sparkSession), "h", "i", "j").sortWithinPartitions("h", "i", "j", "id")
    return small_batches(rows).mapInArrow(partial(_blocks, fn=fn), schema)


def _with_pivot(pairs: DataFrame, payload: DataFrame, fn: Callable) -> DataFrame:
    """Runs fn over each pivot's row and its partners' rows. A pivot with many partners is dealt to many tasks.
    pairs must be cheap to read twice (materialised)."""
    parts = shuffle_parts(pairs.sparkSession)
    salts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("partners")).withColumn("salts", F.ceil(F.col("partners") / PIVOT_ROWS).cast("int"))
    salts = materialize(salts, "near-salts")
    rows = attach_groups(pairs, salts, "a", "partners", pairs.count()).join(payload.withColumnRenamed("id", "b"), "b").select("a", F.expr("pmod(xxhash64(b), salts)").cast("int").alias("salt"), "b", "payload")
    own = salts.join(payload.withColumnRenamed("id", "a"), "a").select("a", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), F.lit(None).cast("long").alias("b"), "payload")
    both = own.unionByName(rows).repartition(parts, "a", "salt").sortWithinPartitions(F.col("a"), F.col("salt"), F.col("b").asc_nulls_first())
    return small_batches(both).mapInArrow(fn, "a long, b long")


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, label) of every node of links (a, b): equal labels are connected; with rounds None, and connected
    nodes have equal labels. Each round moves every node to its neighbour that comes first in a random order, so
    that at least half of the nodes that still have edges go."""
    first = lambda c: F.struct(F.xxhash64(c), F.col(c))
    edges = links.select("a", "b").filter("a <> b").distinct()
    labels = None
    step = 0
    while rounds is None or step < rounds:
        step += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min_by("b", first("b")).alias("m"))
        to = materialize(to.select(F.col("a").alias("id"), F.when(first("m") < first("a"), F.col("m")).otherwise(F.col("a")).alias("to")), "near-step")
        for _ in range(2):
            to = to.join(to.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to"))
        to = materialize(to, "near-to")
        labels = to.select("id", F.col("to").alias("label")) if labels is None else labels.join(to.select(F.col("id").alias("label"), "to"), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
        labels = materialize(labels, "near-labels")
        if step == rounds:
            break
        edges = edges.join(to.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        edges = materialize(edges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct(), "near-edges")
        if edges.isEmpty():
            break
    return labels


def _decisions(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, miss: float) -> DataFrame:
    """Per row of docs: id, th (hash of the text), n, component, kept."""
    width, bands = band_shape(percent)
    least = least_matches(percent / 100, miss)
    fields = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    sketch = materialize(small_batches(fields).mapInArrow(partial(_sketch, k=words, width=width, bands=bands), "id long, th long, n long, fp binary, sig binary, bands array<long>").withColumn("r", F.monotonically_increasing_id()), "near-sketch")
    total = sketch.count()
    full = sketch.filter("n > 0 and id is not null")
    # a class of equal sets is a node of its own, under its first row's number as written: an id may have several texts
    classes = full.groupBy("fp").agg(F.min(F.struct("id", "r")).alias("m"), F.count(F.lit(1)).alias("members"))
    classes = materialize(classes.select("fp", F.col("m.id").alias("rep"), F.col("m.r").alias("node"), "members"), "near-classes")
    reps = sketch.withColumnRenamed("id", "rep").join(classes.select(F.col("node").alias("r")), "r", "left_semi").withColumnRenamed("r", "id")

    keys = reps.select("id", "n", F.posexplode("bands").alias("band", "h"))
    shared = materialize(keys.groupBy("h").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "near-shared")
    buckets = materialize(attach_groups(keys, shared, "h", "size", total * bands).drop("size"), "near-buckets")
    wanted = buckets.select("id").distinct()
    sigs = materialize(reps.join(wanted, "id", "left_semi").select("id", F.col("sig").alias("payload"), "bands", "rep", "th", "fp"), "near-sigs")
    of = sigs.select(F.col("id").alias("node"), F.col("rep").alias("id"), "th", "fp")
    texts = fields.join(of, ["id", "th"]).select("node", "text", "fp")
    sets = materialize(small_batches(texts).mapInArrow(partial(_sets, k=words), "id long, payload binary").dropDuplicates(["id"]), "near-sets")
    sigs = sigs.drop("rep", "th", "fp")

    exact = partial(_stream_exact, num=percent, den=100)
    fits = F.expr(f"100 * least(n, pn) >= {percent} * greatest(n, pn)")
    labels, links = None, None

    def labelled(rows: DataFrame) -> DataFrame:
        if labels is None:
            return rows.withColumn("label", F.col("id"))
        return rows.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))

    for low, high in zip(ROUNDS, (*ROUNDS[1:], bands), strict=True):
        rows = labelled(buckets.filter((F.col("band") >= low) & (F.col("band") < high)))
        pivots = rows.groupBy("h").agg(F.min_by(F.struct("id", "label", "n"), F.xxhash64("id", "h")).alias("p"), F.max("label").alias("most"), F.min("label").alias("fewest"), F.count(F.lit(1)).alias("size"))
        pivots = materialize(pivots.filter("most <> fewest").select("h", "size", F.col("p.id").alias("a"), F.col("p.label").alias("pl"), F.col("p.n").alias("pn")), "near-pivots")
        pairs = attach_groups(rows, pivots, "h", "size", total * bands).filter(fits & (F.col("label") != F.col("pl"))).select("a", F.col("id").alias("b")).distinct()
        pairs = _with_pivot(materialize(pairs, "near-pairs"), sigs.drop("bands"), partial(_stream_bayes, least=least))
        found = materialize(_with_pivot(materialize(pairs, "near-pairs"), sets, exact), "near-links")
        links = found if links is None else links.unionByName(found)
        if not links.isEmpty():
            labels = components(links, rounds=2)

    # what is still open: pairs of different labels in a bucket. Signatures go to all blocks and say which rows have a
    # partner to look at; sets go to those rows' blocks only, which are bounded in rows and set members
    told = sigs.select("id", F.col("payload").alias("sig"), F.col("bands").alias("keys"))
    bayes = {"least": least, "num": percent, "den": 100}
    rows = _in_blocks(labelled(buckets), F.ceil(F.count(F.lit(1)) / SIGNATURE_ROWS), lambda r: r.join(told, "id"), partial(_open_rows, **bayes), "h long, band int, id long, label long, n long", total * bands)
    rows = materialize(rows.distinct(), "near-open")
    sized = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_HASHES))
    found = _in_blocks(rows, sized, lambda r: r.join(told, "id").join(sets, "id"), partial(_link_block, **bayes), "a long, b long", total * bands)
    links = links.unionByName(materialize(found.distinct(), "near-links"))

    out = classes.withColumn("component", F.col("rep"))
    if not links.isEmpty():
        labels = components(links).withColumnRenamed("id", "node")
        named = classes.select("node", "rep").join(labels, "node")
        smallest = named.groupBy("label").agg(F.min("rep").alias("smallest"))
        named = named.join(smallest, "label").select("node", "smallest")
        out = classes.join(named, "node", "left").withColumn("component", F.coalesce("smallest", "rep")).drop("smallest")
    out = materialize(out.select("fp", "members", "component"), "near-components")
    mine = attach_groups(full.select("id", "th", "n", "fp"), out, "fp", "members", total).select("id", "th", "n", "component")
    rest = sketch.filter("n = 0 or id is null").select("id", "th", "n", F.col("id").alias("component"))
    return mine.unionByName(rest).withColumn("kept", F.col("id").eqNullSafe(F.col("component")))


def near_dedup_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 85, miss: float = 1e-7) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (smallest id reachable over links), kept.

    Two documents are linked if 100 * intersection >= percent * union of their sets. percent should be at least
    80: the bands find a pair at 0.85 but for 4 in 10 million, and one at 0.8, if percent is under 85, but for 5 in
    100 million.
    """
    out = _decisions(docs, id_col, text_col, words, percent, miss)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, miss: float = 1e-7) -> DataFrame:
    """The rows of docs that stay, one document of each component, with the columns of docs."""
    gone = _decisions(docs, id_col, text_col, words, percent, miss).filter("not kept").select(F.col("id").alias("_id"), F.col("th").alias("_th"))
    boxed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_th"))
    return drop_rows(boxed, gone).select("_row.*")
