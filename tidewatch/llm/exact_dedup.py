"""Exact deduplication by two-pass Bloom filtering, in DataFrame operations only.

Pass 1 hashes every normalised text, counts the filter positions that two hash functions give, and keeps the
positions hit at least twice as bitmaps. The bitmaps are sized by the number of rows, so that at any size about one
unique row in 250 is flagged by chance. Pass 2 tests each row against both bitmaps: only rows whose two positions are
both taken are shuffled and grouped by their full digest; all others can have no equal and pass straight through.
False positives cost a shuffled row and change no result.

Defined cases: a null text counts as empty; texts are equal when identical after lower-casing A-Z; of equal
texts the largest doc_id stays (null ids rank lowest); rows that share doc_id and text stay or go together, rows that
share a doc_id alone are decided each by its own text; an empty table gives an empty result; further columns of any
name are carried by ``exact_dedup`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_KEYS, attach_groups, drop_rows, lower_ascii, materialize

#: Bits of each bitmap for a row; up to BROADCAST_BITS (32 MB a bitmap) they are broadcast, larger ones are joined by
#: shuffling keys (id and digest), never documents or bitmaps beside rows.
BITS_PER_ROW, LEAST_BITS, BROADCAST_BITS = 16, 1 << 16, 1 << 28
_BUCKET_BITS = 15  # a bitmap aggregate holds 32768 bits


def filter_bits_for(rows: int) -> int:
    return max(LEAST_BITS, 1 << (BITS_PER_ROW * max(rows, 1) - 1).bit_length())


def _positions(sha: Column, bits: int) -> tuple[Column, Column]:
    """The two positions; the second bitmap lies behind the whole buckets of the first."""
    behind = max(bits, 1 << _BUCKET_BITS)
    return F.pmod(F.xxhash64(sha), F.lit(bits)), F.pmod(F.xxhash64(sha, F.lit(1)), F.lit(bits)) + F.lit(behind)


def _bitmaps(keys: DataFrame, bits: int, least: int = 2) -> DataFrame:
    """(bucket, bits): the positions that ``least`` rows or more fall on."""
    at = keys.select(F.explode(F.array(*_positions(F.col("_sha"), bits))).alias("at"))
    taken = at.groupBy("at").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return taken.groupBy(F.expr(f"shiftright(at, {_BUCKET_BITS})").alias("bucket")).agg(
        F.expr(f"bitmap_construct_agg(at & {(1 << _BUCKET_BITS) - 1})").alias("bits")
    )


def _flagged(rows: DataFrame, bitmaps: DataFrame, bits: int) -> DataFrame:
    """Adds _maybe: whether both positions of _sha are taken. The bitmaps' size is bounded by bits. Each bit is tested
    where its bitmap was joined, so that only a boolean goes on."""
    out, tested = rows, F.lit(True)
    for k, at in enumerate(_positions(F.col("_sha"), bits)):
        side = bitmaps.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
        out = out.withColumn("_at", at)
        out = out.join(F.broadcast(side) if bits <= BROADCAST_BITS else side, F.expr(f"shiftright(_at, {_BUCKET_BITS}) = _bucket"), "left")
        byte = "cast(conv(hex(substring(_bits, cast((_at & 32767) div 8 as int) + 1, 1)), 16, 10) as int)"
        out = out.withColumn(f"_hit{k}", F.expr(f"coalesce(shiftright({byte}, cast(_at & 7 as int)) & 1, 0) = 1")).drop("_at", "_bucket", "_bits")
        tested = tested & F.col(f"_hit{k}")
    return out.select(*rows.columns, tested.alias("_maybe"))


def _sha(text_col: str) -> Column:
    return F.unhex(F.sha2(lower_ascii(F.col(text_col)), 256)).alias("_sha")


def _decide(docs: DataFrame, id_col: str, text_col: str, bits: int | None) -> DataFrame:
    keys = materialize(docs.select(F.col(id_col).alias("_id"), _sha(text_col)), "dedup-keys")
    total = keys.count()
    bits = bits or filter_bits_for(total)
    bitmaps = materialize(_bitmaps(keys, bits), "dedup-bloom")
    seen = _flagged(keys, bitmaps, bits)
    if bits > BROADCAST_BITS:
        seen = materialize(seen, "dedup-seen")
    maybe = seen.filter("_maybe").select("_id", "_sha")
    groups = materialize(maybe.groupBy("_sha").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "dedup-groups")
    alone = seen.filter("not _maybe").select("_sha", "_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return attach_groups(maybe, groups, "_sha", "group_size", total).unionByName(alone)


def exact_dedup_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int | None = None) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    decided = _decide(docs, id_col, text_col, filter_bits)
    return decided.select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int | None = None) -> DataFrame:
    """The rows of docs that stay, with the columns of docs.

    Documents are held against the rows that go only. Few of these are broadcast, and no document is shuffled; with
    more, a bitmap of their positions is broadcast, which has BROADCAST_BITS bits at most, and only documents that fall
    on it are shuffled to them.
    """
    decided = _decide(docs, id_col, text_col, filter_bits)
    gone = materialize(decided.filter(~F.col("_id").eqNullSafe(F.col("keep_id"))).select("_id", "_sha"), "dedup-gone")
    # the columns of docs stand as one struct beside the filter's own, so that no name can clash
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), _sha(text_col))
    n = gone.count()
    if n <= BROADCAST_KEYS:
        return drop_rows(rows, gone).select("_row.*")
    bits = min(BROADCAST_BITS, filter_bits_for(n))
    seen = _flagged(rows, materialize(_bitmaps(gone, bits, 1), "dedup-gone-bloom"), bits)
    stay = drop_rows(seen.filter("_maybe").drop("_maybe"), gone)
    return seen.filter("not _maybe").select("_row.*").unionByName(stay.select("_row.*"))
