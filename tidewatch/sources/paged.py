"""Pages of items behind cursors: written from a table, walked as a data source of Spark.

A page holds its cursor, the next page's cursor (null at the end) and a few items. Pages lie as JSON lines in files of
consecutive pages, and an index says per file its first cursor, its pages and the cursor after it.
"""

from __future__ import annotations

import io
import itertools
import json
import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..operators.ranks import places

INDEX = "_index.json"
#: Targets up to this many are pushed into the reader; more are a semi-join.
PUSHED_TARGETS = 1000
#: Rows of a batch that the reader gives at least, but for the last.
BATCH_ROWS = 2000
_ARROW = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.DoubleType(): pa.float64()}


def _write_files(batches: Iterator[pa.RecordBatch], root: str, last: int) -> Iterator[pa.RecordBatch]:
    """Rows (page, item) in order -> one file of the task's pages; file, first page, pages."""
    fs, base = pafs.FileSystem.from_uri(root)
    rows = ((p, x) for b in batches for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    first, pages, name, out = None, 0, f"pages-{uuid.uuid4().hex}.jsonl", None
    for page, items in itertools.groupby(rows, key=lambda r: r[0]):
        if out is None:
            fs.create_dir(base, recursive=True)
            first, out = page, fs.open_output_stream(f"{base}/{name}")
        after = "null" if page == last else f'"{page + 1}"'
        out.write(f'{{"cursor": "{page}", "next": {after}, "data": [{", ".join(x for _, x in items)}]}}\n'.encode())
        pages += 1
    if out is not None:
        out.close()
        yield pa.RecordBatch.from_pydict({"file": [name], "first": [first], "pages": [pages]})


def write_pages(df: DataFrame, order: list[Column], root: str, size: int = 20) -> int:
    """Writes df's rows in a total order as pages of ``size`` items; the number of pages. Null fields are left out of
    their item. The index, written last, names the files of whole tasks only; the driver gets one line per file."""
    items = places(df.select(*df.columns, F.to_json(F.struct(*df.columns)).alias("_item")), order, "_place")
    items = items.select(F.floor((F.col("_place") - 1) / size).cast("long").alias("page"), "_place", F.col("_item").alias("item"))
    total = math.ceil(df.count() / size)
    sorted_ = items.repartitionByRange("page").sortWithinPartitions("page", "_place").select("page", "item")
    found = sorted(sorted_.mapInArrow(partial(_write_files, root=root, last=total - 1), "file string, first long, pages long").collect(), key=lambda r: r["first"])
    files = [{"file": r["file"], "cursor": str(r["first"]), "pages": r["pages"], "next": str(r["first"] + r["pages"]) if r["first"] + r["pages"] < total else None} for r in found]
    fs, base = pafs.FileSystem.from_uri(root)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/{INDEX}.tmp") as out:
        out.write(json.dumps({"start": files[0]["cursor"] if files else None, "files": files}).encode())
    fs.move(f"{base}/{INDEX}.tmp", f"{base}/{INDEX}")
    return total


@dataclass
class PageRange(InputPartition):
    """The first pages of a file."""

    file: str
    pages: int


def _value(x: object, kind: T.DataType) -> object:
    """An item's field as the column's type: a missing text is empty, a missing number 0, what can't be cast null."""
    if isinstance(kind, T.StringType):
        return "" if x is None else x if isinstance(x, str) else json.dumps(x)
    try:
        return (float if isinstance(kind, T.DoubleType) else int)(x or 0)
    except (TypeError, ValueError, OverflowError):
        return None


class PagedReader(DataSourceReader):
    """Walks from the first cursor on, over ``maxPages`` pages at most if given; one task per file of pages. Equality
    and IN filters on the ``key`` field are decided as a page is read; the other rows never reach Spark."""

    def __init__(self, schema: T.StructType, root: str, key: str | None, most: int | None):
        self.schema, self.root, self.key, self.most = schema, root.rstrip("/"), key, most
        self.wanted: set | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == (self.key,):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self) -> list[PageRange]:
        fs, base = pafs.FileSystem.from_uri(self.root)
        with fs.open_input_stream(f"{base}/{INDEX}") as f:
            index = json.loads(f.read())
        at, cursor, left, out = {x["cursor"]: x for x in index["files"]}, index["start"], self.most, []
        while cursor is not None and left != 0:
            x = at[cursor]
            pages = x["pages"] if left is None else min(left, x["pages"])
            out.append(PageRange(f"{base}/{x['file']}", pages))
            cursor, left = x["next"], None if left is None else left - pages
        return out or [PageRange("", 0)]

    def read(self, partition: PageRange) -> Iterator[pa.RecordBatch]:
        if not partition.pages:
            return
        fs, _ = pafs.FileSystem.from_uri(self.root)
        arrow = pa.schema([(f.name, _ARROW[f.dataType]) for f in self.schema])
        at = self.schema.names.index(self.key) if self.wanted is not None else None
        rows: list[list] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

        with io.TextIOWrapper(fs.open_input_stream(partition.file), encoding="utf-8", newline="\n") as lines:
            for line in itertools.islice(lines, partition.pages):
                for item in json.loads(line)["data"]:
                    row = [_value(item.get(f.name), f.dataType) for f in self.schema]
                    if at is None or row[at] in self.wanted:
                        rows.append(row)
                if len(rows) >= BATCH_ROWS:
                    yield batch()
                    rows.clear()
        if rows:
            yield batch()


class PagedSource(DataSource):
    """Format "pages"; options path, key (the field whose filters are pushed) and maxPages."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def reader(self, schema: T.StructType) -> PagedReader:
        if other := [f.name for f in schema if f.dataType not in _ARROW]:
            raise ValueError(f"fields of pages are string, long or double: {other}")
        most = self.options.get("maxpages")
        return PagedReader(schema, self.options["path"], self.options.get("key"), None if most is None else max(0, int(most)))


def read_pages(spark: SparkSession, root: str, schema: str, key: str, max_pages: int | None = None) -> DataFrame:
    """The pages' items as rows. Turns the session's filter push-down for Python sources on, as the reader needs it;
    it changes no other result."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
    df = spark.read.format("pages").schema(schema).option("path", root).option("key", key)
    return (df if max_pages is None else df.option("maxPages", max_pages)).load()


def of_targets(items: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Items whose key is a target's. A few targets become a filter that reaches the reader; without any, nothing is left."""
    targets = targets.select(F.col(key).alias("_target")).filter("_target is not null").distinct()
    few = [r["_target"] for r in targets.limit(PUSHED_TARGETS + 1).collect()]
    if len(few) <= PUSHED_TARGETS:
        return items.filter(F.col(key).isin(few) if few else F.lit(False))
    return items.join(targets, F.col(key) == F.col("_target"), "left_semi")
