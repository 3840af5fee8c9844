"""Main text of web pages: nearest-URL page differencing over the lines of a page's markup.

1. A page is cut into lines, one per block of its markup, each with its kind. CONTENT lies in the page's article or main
   element, CHROME in an element that names itself a menu, header, footer, sidebar, notice, advert, form or reader
   comment (by tag, role, class or id); the rest is OPEN. Scripts, styles and comments have no lines.
2. Pages are sorted by ranges of (host, path, id). Neighbours are a pair; pages with the same lines in a row count as
   one, so that a copy is not taken for a template. Pairs are joined by place, so a host with any share of the pages
   is spread like the others, and only fingerprints of lines are shuffled, not texts.
3. A pair's lines are aligned by their longest common subsequence. Each page is held against the neighbour with the
   longer common path whose lines are not nearly all shared (COPY), and its shared OPEN lines are deleted.
4. Where a page marks its content, its OPEN lines outside go too; where it doesn't, what is left of them is the text.

Shared lines inside an article stay: articles repeat passages of each other, and the text is to be whole. Markup
alone decides where it marks the article; the differencing decides on the pages that don't.

Defined cases: null html is empty and gives an empty text; a null url has an empty host and path; rows that repeat an id
are pages of their own; broken markup is read as far as it goes (an unclosed element lasts until an outer one is
closed); further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_KEYS, UPPER, materialize, release, shuffle_parts, small_batches

CHROME, OPEN, CONTENT = 0, 1, 2
#: A page whose lines are shared with a neighbour to this part is a copy of it, not another page of its template.
COPY = 0.8
#: Cells of a bit matrix that one alignment holds; larger ones are halved.
CELLS = 1 << 28

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without text of the page.
SILENT = frozenset("script style noscript template textarea title head svg math iframe object audio video canvas map select datalist button noframes noembed xmp".split())
CHROME_TAGS = frozenset("nav footer aside form menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar alert alertdialog dialog".split())
#: Words by which classes and ids name what isn't the article.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promoted promotion banner nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs "
    "sidebar sidebars sidenav rail footer foot masthead topbar toolbar cookie cookies consent gdpr notice notices notification notifications disclaimer popup modal overlay newsletter subscribe "
    "subscription signup signin login register search share sharing sharebar social follow related recommended recommendations trending popular widget widgets comment comments commentlist "
    "disqus respond replies reply pagination pager paging skip outbrain taboola".split()
)
#: Of these, what an article's own header or heading may be called is chrome outside an article only.
OUTER_TAGS, OUTER_WORDS = frozenset(["header"]), frozenset(["header", "head", "top"])

_MARK = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^'">])*+)>|/?[a-zA-Z][^>]*+(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _names(attributes: str) -> tuple[set[str], str, bool]:
    """Words of class and id, role, and whether the element marks the article's body."""
    words, role, body = set(), "", False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id"):
            words |= {w.lower() for w in _WORD.findall(value)} | {w.lower() for w in re.split(r"[^A-Za-z0-9]+", value)}
        elif name == "role":
            role = value.strip().lower()
        elif name == "itemprop":
            body = body or value.strip().lower() == "articlebody"
    return words, role, body


def _kind(tag: str, attributes: str, outer: int) -> int:
    """Kind of the lines in an element below one of kind ``outer``."""
    if outer == CHROME:
        return CHROME
    words, role, body = _names(attributes) if "=" in attributes else (set(), "", False)
    if tag in ("html", "body"):
        return outer
    if tag in CHROME_TAGS or role in ROLES or words & WORDS:
        return CHROME
    if outer == OPEN and (tag in OUTER_TAGS or words & OUTER_WORDS):
        return CHROME
    return CONTENT if tag in ("article", "main") or role in ("main", "article") or body else outer


def page_lines(page: str) -> tuple[list[str], list[int]]:
    """The lines of a page and their kinds."""
    lines, kinds, text = [], [], []
    stack: list[tuple[str, int]] = []
    opened: dict[str, int] = {}
    kind = OPEN

    def end_line() -> None:
        line = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if line:
            lines.append(line)
            kinds.append(kind)

    def close(tag: str) -> None:
        nonlocal kind
        while True:
            name, outer = stack.pop()
            opened[name] -= 1
            if name in BLOCKS or outer != kind:
                end_line()
            kind = outer
            if name == tag:
                return

    pos, size = 0, len(page)
    while pos < size:
        m = _MARK.search(page, pos)
        if m is None:
            text.append(page[pos:])
            break
        text.append(page[pos : m.start()])
        pos = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened.get(tag):
                close(tag)
            elif tag in BLOCKS:
                end_line()
            continue
        if tag in SILENT:
            if not (m[3].endswith("/") and tag in ("svg", "math")):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, pos)
                pos = stop.end() if stop else (size if tag in ("script", "style", "textarea", "title", "iframe", "xmp") else pos)
            if tag in BLOCKS:
                end_line()
            continue
        if tag in BLOCKS:
            if opened.get("p") and _in_scope(stack):  # a block ends an open paragraph
                close("p")
            end_line()
        elif tag == "br":
            text.append(" ")
        if tag in VOID:
            continue
        inner = _kind(tag, m[3], kind)
        if inner != kind:
            end_line()
        stack.append((tag, kind))
        opened[tag] = opened.get(tag, 0) + 1
        kind = inner
    end_line()
    return lines, kinds


#: Elements that a paragraph doesn't reach out of.
_HOLDERS = BLOCKS - {"p"}


def _in_scope(stack: list[tuple[str, int]]) -> bool:
    """Whether an open paragraph is nearer than any other open block."""
    for name, _ in reversed(stack):
        if name == "p":
            return True
        if name in _HOLDERS:
            return False
    return False


def _shared_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of a and each prefix of b (bit-parallel over b)."""
    v = _rows(a, b)[-1] if len(a) else (1 << len(b)) - 1
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _rows(a: np.ndarray, b: np.ndarray, every: bool = False) -> list[int]:
    """After each element of a: a bit per element of b, 0 where the common subsequence grows."""
    where: dict[int, int] = {}
    for j, x in enumerate(b.tolist()):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, out = full, []
    for x in a.tolist():
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        if every:
            out.append(v)
    return out if every else [v]


def common_lines(a: np.ndarray, b: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of one longest common subsequence."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a_, b_ = a[head:], b[head:]
    n = min(len(a_), len(b_))
    differ = np.flatnonzero(a_[len(a_) - n :][::-1] != b_[len(b_) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    a_, b_ = a_[: len(a_) - tail], b_[: len(b_) - tail]
    ia, ib = np.flatnonzero(np.isin(a_, b_)), np.flatnonzero(np.isin(b_, a_))  # lines of one side only never match
    pa_, pb_ = _align(a_[ia], b_[ib], cells)
    ends = np.arange(tail)
    return np.concatenate([np.arange(head), ia[pa_] + head, len(a) - tail + ends]), np.concatenate([np.arange(head), ib[pb_] + head, len(b) - tail + ends])


def _align(a: np.ndarray, b: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(a) * len(b) > cells and len(a) > 1:  # the best cut of b for the two halves of a
        mid = len(a) // 2
        whole = _shared_row(a[:mid], b) + _shared_row(a[mid:][::-1], b[::-1])[::-1]
        cut = int(whole.argmax())
        (p, q), (r, s) = _align(a[:mid], b[:cut], cells), _align(a[mid:], b[cut:], cells)
        return np.concatenate([p, r + mid]), np.concatenate([q, s + cut])
    rows, i, j, out = _rows(a, b, every=True), len(a) - 1, len(b) - 1, []
    while i >= 0 and j >= 0:  # zeros up to a place are the length there
        if rows[i] >> j & 1:  # the last line of b adds nothing
            j -= 1
        elif i and not rows[i - 1] >> j & 1:  # nor does the last of a
            i -= 1
        else:
            out.append((i, j))
            i, j = i - 1, j - 1
    got = np.array(out[::-1], np.int64).reshape(-1, 2)
    return got[:, 0], got[:, 1]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, page) -> row, lines, kinds, prints (fingerprints of the lines)."""
    for batch in batches:
        out = [page_lines(p or "") for p in batch.column(1).to_pylist()]
        prints = [[xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in lines] for lines, _ in out]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[2:], batch.column(0), pa.array([x for x, _ in out], pa.list_(pa.string())), pa.array([k for _, k in out], pa.list_(pa.int8())), pa.array(prints, pa.list_(pa.int64()))],
            [*batch.schema.names[2:], "row", "lines", "kinds", "prints"],
        )
    release()


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, sum, ...) in order -> part, run (of rows equal in both, from 0), first (of its run) and the columns."""
    part, run, before = TaskContext.get().partitionId(), -1, None
    for batch in batches:
        runs, firsts = [], []
        for now in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            firsts.append(now != before)
            run, before = run + (now != before), now
            runs.append(run)
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(runs), pa.int32()), pa.array(runs, pa.int64()), pa.array(firsts, pa.bool_()), *batch.columns], ["part", "run", "first", *batch.schema.names])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, path, prints, path2, prints2): pages at place and place + 1 -> for each of both: the common path's length,
    the share of its lines that both have, and the places of these."""
    for batch in batches:
        out: list[tuple] = []
        for place, path, a, path2, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            near = next((k for k, (x, y) in enumerate(zip(path, path2, strict=False)) if x != y), min(len(path), len(path2)))
            found = common_lines(np.array(a, np.int64), np.array(b, np.int64))
            for where, mine, side in ((place, a, 0), (place + 1, b, 1)):
                out.append((where, side, near, len(found[side]) / len(mine) if mine else 0.0, found[side].tolist()))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int32()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["place", "side", "near", "share", "shared"])


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_behind_scheme(url), r"^([^/?#]*)", 1), UPPER, UPPER.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_behind_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _behind_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise("")


def _placed(pages: DataFrame) -> DataFrame:
    """(row, host, path, prints): adds place, the run's number over all ranges, and whether the row is its run's first."""
    spark, order = pages.sparkSession, ["host", "path", "row"]
    total = F.xxhash64("prints")
    rows = pages.select("host", total.alias("sum"), "path", "row", "prints")
    dealt = rows.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order)
    kinds = "part int, run long, first boolean, host string, sum long, path string, row long, prints array<long>"
    runs = materialize(dealt.mapInArrow(_number, kinds), "html-runs")
    at = F.struct("run", "host", "sum")
    offsets, base, before = [], 0, None
    for r in runs.groupBy("part").agg(F.min(at).alias("a"), F.max(at).alias("z")).orderBy("part").collect():  # a row per range
        goes_on = before == (r["a"]["host"], r["a"]["sum"])
        base -= goes_on
        offsets.append((r["part"], base, goes_on))
        base, before = base + r["z"]["run"] + 1, (r["z"]["host"], r["z"]["sum"])
    known = F.broadcast(spark.createDataFrame(offsets, "part int, base long, goes_on boolean"))
    return runs.join(known, "part").select("row", "host", "path", "prints", (F.col("run") + F.col("base")).alias("place"), (F.col("first") & ~(F.col("goes_on") & (F.col("run") == 0))).alias("first"))


def shared_lines(pages: DataFrame) -> DataFrame:
    """(row, host, path, prints) -> row, shared: places of the lines that the page has in common with its partner."""
    placed = materialize(_placed(pages), "html-placed")
    one = placed.filter("first").select("place", "host", "path", "prints")
    other = one.select((F.col("place") - 1).alias("place"), F.col("host").alias("host2"), F.col("path").alias("path2"), F.col("prints").alias("prints2"))
    pairs = small_batches(one.join(other, "place").filter("host = host2").select("place", "path", "prints", "path2", "prints2"))
    found = pairs.mapInArrow(_compare, "place long, side int, near int, share double, shared array<int>").filter(f"share < {COPY} and size(shared) > 0")
    best = found.groupBy("place").agg(F.max_by("shared", F.struct("near", "side")).alias("shared"))
    return placed.select("row", "place").join(best, "place").select("row", "shared")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id, url, text, n_chars."""
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(html_col).alias("page"), F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    id_kind = rows.schema["id"].dataType.simpleString()
    parsed = small_batches(rows).mapInArrow(_parse, f"id {id_kind}, url string, row long, lines array<string>, kinds array<tinyint>, prints array<long>")
    parsed = materialize(parsed, "html-lines")
    shared = shared_lines(parsed.select("row", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), "prints"))
    # only pages that don't mark their content wait for the comparison
    marked = F.exists("kinds", lambda k: k == CONTENT)
    needed = materialize(parsed.filter(~marked & F.exists("kinds", lambda k: k == OPEN)).select("row").join(shared, "row"), "html-shared")
    needed = F.broadcast(needed) if needed.count() <= BROADCAST_KEYS // 8 else needed
    known = parsed.drop("prints").join(needed, "row", "left")
    keep = lambda line, i: F.when(
        marked, F.get("kinds", i) == CONTENT
    ).otherwise((F.get("kinds", i) == OPEN) & ~F.coalesce(F.array_contains("shared", i), F.lit(False)))
    text = F.array_join(F.filter("lines", keep), "\n")
    return known.select(F.col("id").alias(id_col), F.col("url").alias(url_col), text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
