"""URL rules by a sort-merge range join over reversed-host canonical keys.

A host's labels are written in reverse, each followed by a dot (``www.example.com`` -> ``com.example.www.``), so a
rule's host with all its subdomains is one interval of keys, and intervals are nested or apart. Pages and rules are
dealt to ranges of keys, sorted together and swept once: a stack holds the rules whose interval the sweep is in,
and a page looks up its path's prefixes among them. A rule is copied to each range its interval touches; a key
that fills several ranges is dealt over them.

Defined cases: a url that is null or lacks ``://`` has empty host and path, and the default verdict; no rules give
the default verdict everywhere; of the rules that fit, the longest (host and path together) wins, then the longer
host; a rule given twice takes the first of its verdicts in string order; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import UPPER, shuffle_parts

#: Keys per range in the driver's sample that cuts the ranges.
SAMPLE = 24
TYPES = "kind int, id long, key string, host string, path string, rule string, verdict string"


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.locate("://", url), F.lit(0)) if isinstance(url, str) else F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, UPPER.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _count(value: Column, bounds: list[str], equal: bool) -> Column:
    """How many bounds are below the value (or at most the value), as a binary search in nested conditions."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        b = F.lit(bounds[mid])
        return F.when((b <= value) if equal else (b < value), search(mid + 1, high)).otherwise(search(low, mid))

    return search(0, len(bounds))


@dataclass
class _Active:
    """One host interval on the stack: its end, and its rules by path."""

    key: str
    end: str
    size: int
    paths: dict[str, tuple[str, str]]
    lengths: list[int]


def _sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, kind, id, key, host, path, rule, verdict) sorted by bucket, key, kind -> judged pages."""
    bucket, stack = None, []
    for batch in batches:
        out = []
        for b, kind, i, key, host, path, rule, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != bucket:
                bucket, stack = b, []
            while stack and stack[-1].end <= key:
                stack.pop()
            if kind == 0:
                if not stack or stack[-1].key != key:
                    stack.append(_Active(key, key[:-1] + "/", len(host), {}, []))
                top = stack[-1]
                if path not in top.paths:
                    top.paths[path] = (rule, verdict)
                    top.lengths = sorted({*top.lengths, len(path)}, reverse=True)
                continue
            best, most = (None, default), -1
            for a in reversed(stack):  # the deepest first, so that equal lengths keep the longer host
                for n in a.lengths:
                    if a.size + n <= most:
                        break
                    if n <= len(path) and (found := a.paths.get(path[:n])):
                        best, most = found, a.size + n
                        break
            out.append((i, host, path, *best))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k else pa.int64()) for k, c in enumerate(columns)], ["id", "host", "path", "rule", "verdict"])


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, rule (host and path of the rule, or null), verdict.

    rules: host, path, verdict.
    """
    spark = pages.sparkSession
    parts = shuffle_parts(spark)
    host, path = host_path(F.col(url_col))
    points = pages.select(F.lit(1).alias("kind"), F.col(id_col).cast("long").alias("id"), reversed_host(host).alias("key"), host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    # a sample of fixed size cuts the ranges; a key that stands at several cuts spreads over the ranges between them
    sample = sorted(r["key"] for r in points.select("key", F.xxhash64("id").alias("h")).orderBy("h").limit(SAMPLE * parts).collect())
    bounds = [sample[len(sample) * k // parts] for k in range(1, parts)] if sample else []
    low, high = _count(F.col("key"), bounds, False), _count(F.col("key"), bounds, True)
    points = points.withColumn("low", low).withColumn("span", high - F.col("low") + 1).withColumn("bucket", (F.col("low") + F.pmod(F.xxhash64("id"), F.col("span"))).cast("int"))
    starts = rules.select(F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), reversed_host(F.col("host")).alias("key"), "host", "path", F.concat("host", "path").alias("rule"), "verdict")
    end = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/"))
    starts = starts.withColumn("bucket", F.explode(F.sequence(_count(F.col("key"), bounds, False), _count(end, bounds, True)))).withColumn("bucket", F.col("bucket").cast("int"))
    columns = ["bucket", "kind", "id", "key", "host", "path", "rule", "verdict"]
    both = points.select(columns).unionByName(starts.select(columns)).repartitionById(len(bounds) + 1, F.col("bucket"))
    both = both.sortWithinPartitions("bucket", "key", "kind", "path", "verdict")
    return both.mapInArrow(partial(_sweep, default=default), "id long, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
