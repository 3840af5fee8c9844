"""Product codes of vectors: codebooks by exact integer means, nearest entries by equal-average search.

A vector's integer components are cut into equal parts; each part is coded by the nearest entry of its position's
codebook. Entries are sorted by component sum once per round. The search begins at a part's own sum and expands to both
sides: as (difference of sums)**2 / dimension never exceeds the squared distance, a side is done when that bound strictly
exceeds the best distance, so ties are still seen and go to the lower index. Parts with neighbouring sums are searched
together, a block of entries at a time.

Rounds add up each entry's parts inside tasks (a table of the codebook's size) and then by entry, so that what reaches
the driver is one codebook. Sums are kept in limbs of LIMB bits: they are exact for components and counts of any size.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; null ids come last; rows that
repeat an id count each and are ordered by their vectors; shorter vectors, and a width that the parts don't divide, count
as ending in zeros; with fewer vectors than entries a codebook has as many entries; errors beyond 2**63 - 1 count as
that; further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import attach_groups, materialize, shuffle_parts, small_batches
from .dual_tree import matrix

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Parts searched together, and entries that one step to a side visits.
TOGETHER, STEP = 64, 16
LIMB = 24
MOST = np.iinfo(np.int64).max


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), as float64 while these hold it, else in Python's integers."""
    with np.errstate(over="ignore"):
        q = np.floor(SCALE * x)
    if np.isfinite(q).all():
        return q
    one = lambda v: int(v) * SCALE if abs(v) >= 2.0**53 else int(np.floor(SCALE * v))
    return np.array([[one(v) for v in r] for r in x.tolist()], object).reshape(x.shape)


def largest(x: np.ndarray) -> int:
    return int(abs(x).max()) if x.size else 0


def as_kind(x: np.ndarray, most: int, width: int) -> np.ndarray:
    """x in the quickest kind in which squares of sums of ``width`` differences are exact."""
    bound = (2 * most * width) ** 2
    if bound < 2**53:
        return x.astype(np.float64)
    if bound < 2**62:
        return x.astype(np.int64)
    return np.array([[int(v) for v in r] for r in x.tolist()], object).reshape(x.shape)


class EqualAverage:
    """One position's codebook, sorted by component sum (then index)."""

    def __init__(self, entries: np.ndarray):
        sums = entries.sum(axis=1)
        self.index = np.argsort(sums, kind="stable")
        self.entries, self.sums = entries[self.index], sums[self.index]
        self.squares = (self.entries * self.entries).sum(axis=1)
        self.visited = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row, and the squared distance."""
        sums, squares = x.sum(axis=1), (x * x).sum(axis=1)
        order = np.argsort(sums, kind="stable")
        at, best = np.zeros(len(x), np.int64), squares.copy()
        for i in range(0, len(x), TOGETHER):
            rows = order[i : i + TOGETHER]
            at[rows], best[rows] = self._group(x[rows], sums[rows], squares[rows])
        return at, best

    def _group(self, x: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ascending sums: first the entries whose sums lie among theirs, then to both sides while open."""
        n, width = self.index.size, x.shape[1]
        low, high = int(np.searchsorted(self.sums, sums[0])), int(np.searchsorted(self.sums, sums[-1], side="right"))
        if low == high:  # none among them: the nearer neighbour begins
            low, high = (low - 1, low) if low == n or (low and sums[0] - self.sums[low - 1] < self.sums[low] - sums[0]) else (low, low + 1)
        at, best = self._visit(x, squares, low, high)
        while True:
            more = False
            for left in (True, False):
                if low == 0 if left else high == n:
                    continue
                gap = sums - self.sums[low - 1] if left else self.sums[high] - sums
                rows = np.flatnonzero(~((gap > 0) & (gap * gap > width * best)).astype(bool))  # rows beyond the sum have no gap yet
                if not len(rows):
                    continue
                more = True
                span = (max(0, low - STEP), low) if left else (high, min(n, high + STEP))
                near, distance = self._visit(x[rows], squares[rows], *span)
                better = ((distance < best[rows]) | ((distance == best[rows]) & (near < at[rows]))).astype(bool)
                at[rows[better]], best[rows[better]] = near[better], distance[better]
                low, high = (span[0], high) if left else (low, span[1])
            if not more:
                return at, best

    def _visit(self, x: np.ndarray, squares: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        self.visited += len(x) * (high - low)
        d = squares[:, None] - 2 * (x @ self.entries[low:high].T) + self.squares[low:high]
        best = d.min(axis=1)
        return np.where((d == best[:, None]).astype(bool), self.index[low:high], self.index.size).min(axis=1), best


class Coder:
    """codebooks: integers by part, entry and position."""

    def __init__(self, codebooks: np.ndarray):
        self.books, self.most, self._made = codebooks, largest(codebooks), {}

    def rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The usable rows' integers, as wide as the codebooks, and their places."""
        x, ok = matrix(column)
        width = self.books.shape[0] * self.books.shape[2]
        return integers(np.pad(x, ((0, 0), (0, width - x.shape[1])))), ok

    def code(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Entry of each row and part, and the squared distances by part."""
        parts, _, width = self.books.shape
        most = max(self.most, largest(x))
        x = as_kind(x, most, width)
        if x.dtype not in self._made:
            self._made[x.dtype] = [EqualAverage(as_kind(b, most, width).astype(x.dtype)) for b in self.books]
        found = [book.nearest(x[:, p * width : (p + 1) * width]) for p, book in enumerate(self._made[x.dtype])]
        return np.stack([f[0] for f in found], axis=1), [f[1] for f in found]


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """x as whole numbers of LIMB bits with x's sign, lowest first."""
    most = largest(x)
    if most < 1 << LIMB:
        return [x.astype(np.int64)]
    x = as_kind(x, most, 1) if most >= 2**62 else x.astype(np.int64)
    sign, x, out = np.where((x < 0).astype(bool), -1, 1), abs(x), []
    while most:
        out.append((sign * (x & ((1 << LIMB) - 1))).astype(np.int64))
        x, most = x >> LIMB, most >> LIMB
    return out


def _add_up(batches: Iterator[pa.RecordBatch], coder: Coder) -> Iterator[pa.RecordBatch]:
    """(vec) -> for each part, entry and limb that this task met: rows and sums."""
    parts, entries, width = coder.books.shape
    count, sums = np.zeros((parts, entries), np.int64), []
    for batch in batches:
        x, _ = coder.rows(batch.column(0))
        at, _ = coder.code(x)
        for k, limb in enumerate(limbs(x)):
            if k == len(sums):
                sums.append(np.zeros((parts, entries, width), np.int64))
            for p in range(parts):
                np.add.at(sums[k][p], at[:, p], limb[:, p * width : (p + 1) * width])
        for p in range(parts):
            count[p] += np.bincount(at[:, p], minlength=entries)
    for k, s in enumerate(sums):
        p, e = np.nonzero(count if k == 0 else np.any(s, axis=2))
        yield _sums_batch(p, e, np.full(len(p), k), count[p, e] if k == 0 else np.zeros(len(p), np.int64), s[p, e])


def _sums_batch(part, entry, limb, n, sums: np.ndarray) -> pa.RecordBatch:
    offsets = np.arange(len(sums) + 1, dtype=np.int32) * sums.shape[1]
    return pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(limb, pa.int32()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(sums.ravel(), pa.int64()))], ["part", "entry", "limb", "n", "sums"]
    )


def _merge(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Sums of the same part, entry and limb; there are as many as the codebook has entries and limbs."""
    held: dict[tuple[int, int, int], list] = {}
    for batch in batches:
        sums = batch.column(4).flatten().to_numpy().reshape(-1, width)
        for i, (p, e, k, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
            mine = held.setdefault((p, e, k), [0, np.zeros(width, np.int64)])
            mine[0] += n
            mine[1] += sums[i]
    if held:
        p, e, k = zip(*held, strict=True)
        yield _sums_batch(p, e, k, [m[0] for m in held.values()], np.stack([m[1] for m in held.values()]))


def _encode(batches: Iterator[pa.RecordBatch], coder: Coder) -> Iterator[pa.RecordBatch]:
    """(id, label, vec) -> id, label, code, error."""
    for batch in batches:
        x, ok = coder.rows(batch.column(2))
        at, distances = coder.code(x)
        error = [min(int(sum(d)), MOST) for d in zip(*(d.tolist() for d in distances), strict=True)]
        code = ["".join(f"{e:02x}" for e in r) for r in at.tolist()]
        rows = batch.take(pa.array(ok))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])


def whole_numbers(x: np.ndarray) -> np.ndarray:
    return np.array([[[int(v) for v in e] for e in b] for b in x.tolist()], object).reshape(x.shape)


def fit(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width / parts) of rows (id, vec)."""
    first = rows.select("id", "vec").orderBy(F.asc_nulls_last("id"), "vec").limit(entries).collect()  # one codebook
    x, _ = matrix(pa.array([r["vec"] for r in first], pa.list_(pa.float64())))
    x = integers(np.pad(x, ((0, 0), (0, width - x.shape[1]))))
    books = whole_numbers(x.reshape(len(x), parts, width // parts).transpose(1, 0, 2))
    kinds = "part int, entry int, limb int, n long, sums array<long>"
    for _ in range(rounds):
        sums = small_batches(rows.select("vec")).mapInArrow(partial(_add_up, coder=Coder(books)), kinds)
        merged = sums.repartition(shuffle_parts(rows.sparkSession), "part", "entry").mapInArrow(partial(_merge, width=width // parts), kinds)
        total: dict[tuple[int, int], list] = {}
        for r in merged.collect():  # one codebook
            mine = total.setdefault((r["part"], r["entry"]), [0, [0] * (width // parts)])
            mine[0] += r["n"]
            mine[1] = [a + (b << (LIMB * r["limb"])) for a, b in zip(mine[1], r["sums"], strict=True)]
        for (p, e), (n, s) in total.items():
            books[p, e] = [v // n for v in s]
    return books


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """id, code, error, label_error (over equal labels), codebooks_sha256; and the label."""
    if entries > 256:
        raise ValueError("an index has two hex digits")
    finite = F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(vector_col).isNotNull() & finite).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vec"))
    rows = materialize(rows, "codes-rows")
    size = rows.agg(F.max(F.size("vec")).alias("width"), F.count(F.lit(1)).alias("n")).first()
    width = -(-max(size["width"] or 0, 1) // parts) * parts
    kinds = f"id {rows.schema['id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    if not size["n"]:
        return rows.select(F.col("id").alias(id_col), F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256"), F.col("label").alias(label_col)).limit(0)
    books = fit(rows, width, parts, entries, rounds)
    digest = hashlib.sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()
    coded = materialize(small_batches(rows.select("id", "label", "vec")).mapInArrow(partial(_encode, coder=Coder(books)), kinds), "codes-coded")
    key = [F.col("label").isNull().alias("_none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("_label")]
    groups = coded.select(*key, "error").groupBy("_none", "_label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"), F.count(F.lit(1)).alias("_size"))
    groups = materialize(groups.select("_none", "_label", "_size", F.least("_sum", F.lit(MOST)).cast("long").alias("label_error")), "codes-labels")
    out = attach_groups(coded.select("*", *key), groups, ["_none", "_label"], "_size", size["n"])
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), F.col("label").alias(label_col))
