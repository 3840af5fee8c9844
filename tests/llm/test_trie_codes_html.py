"""The prefix trie, vector codes and page texts against brute force, with nulls, ties, repeats, long inputs and odd columns."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

CONVERSATIONS = "conv_id long, turn long, role string, text string"


def clashing(df):
    return df.withColumns({c: F.lit(1) for c in ("row", "conv", "part", "n1", "hot", "_size", "kinds", "lines", "pos", "shared", "place", "first", "vec", "id", "code") if c not in df.columns})


def trie_by_force(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(turns.get(c - int(math.fmod(c, 5)), [])[:h] + turns[c][h:])
    node, up, last, members, ends = {}, {0: None}, {0: ""}, defaultdict(list), defaultdict(list)
    for c, seq in built.items():
        at = 0
        members[at].append(c)
        for turn in seq:
            at = node.setdefault((at, turn), len(node) + 1)
            members[at].append(c)
        ends[at].append(c)
    children, leaves, saved, depth = defaultdict(int), defaultdict(int), defaultdict(int), {0: 0}
    for (parent, turn), k in node.items():  # parents come before their children
        up[k], last[k], depth[k] = parent, turn[1], depth[parent] + 1
        children[parent] += 1
    for k in sorted(up, reverse=True):
        leaves[k] += k not in children
        saved[k] += (len(members[k]) - 1) * len(last[k].encode())
        if k:
            leaves[up[k]] += leaves[k]
            saved[up[k]] += saved[k]
    sha = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return ((min(members[k]), depth[k], min(members[up[k]]) if k else None, len(members[k]), children[k], leaves[k], saved[k], sha(k)) for k in up)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_trie(spark):
    from tidewatch.llm.prefix_trie import prefix_trie

    r = random.Random(3)
    rows = []
    for c in range(230):
        seed = r.choice([c, c % 7, 1000])  # copies, shared heads
        q = random.Random(seed)
        n = q.choice([1, 2, 5, 9, 14])
        rows += [(c, t, q.choice(["user", "assistant", None, ""]), q.choice(["a", "b é", None, "", f"x{seed % 3}"])) for t in range(n)]
    rows += [(300, None, "user", "null turn"), (300, None, None, "second"), (300, 2, "user", "x"), (300, 2, "user", "x"), (300, 2, "assistant", "tie")]
    rows += [(-3, 0, "user", "below zero"), (-5, 0, "user", "below zero"), (None, 0, "user", "nobody"), (2**62, 1, "user", "a" * 50_000), (2**62, 2, "user", "b")]
    rows += [(400, t, "user", f"{t % 11}") for t in range(3000)] + [(405, t, "user", f"{t % 11}") for t in range(2500)] + [(401, t, "user", f"{t % 11}") for t in range(3000)]
    r.shuffle(rows)
    want = sorted(trie_by_force(rows), key=str)
    df = clashing(spark.createDataFrame(rows, CONVERSATIONS))
    assert rows_of(prefix_trie(df)) == want
    # few members make a node hot, and queues hold next to nothing
    assert rows_of(prefix_trie(df.repartition(7), least_hot=2, queue_rows=3)) == want
    assert prefix_trie(df.limit(0)).count() == 0


def test_trie_over_more_ranges(spark):
    """One conversation holds most rows and goes over several ranges; its copy ends with it."""
    from tidewatch.llm.prefix_trie import prefix_trie

    rows = [(c, t, "user", f"{t * t % 101}") for c in (10, 15) for t in range(4000)] + [(c, t, "user", f"{t}") for c in range(40) if c not in (10, 15) for t in range(3)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert rows_of(prefix_trie(spark.createDataFrame(rows, CONVERSATIONS), least_hot=1)) == sorted(trie_by_force(rows), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_spilling_queue():
    from tidewatch.llm.prefix_trie import SpillingQueue

    r, q, want = random.Random(1), SpillingQueue(50), []
    for _ in range(3000):
        x = (r.randrange(400), r.randrange(3), 2**70)
        q.push(x)
        want.append(x)
        if r.random() < 0.3:
            want.sort()
            assert q.pop() == want.pop(0)
    want.sort()
    assert q.spills > 10 and [q.pop() for _ in want] == want and q.peek() is None


def codes_by_force(rows, parts=4, entries=256, rounds=4):
    kept = [(i, lab, [math.floor(1024 * x) if abs(x) < 1e300 else int(x) * 1024 for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, _, v in kept) // parts)
    kept = [(i, lab, v + [0] * (parts * width - len(v))) for i, lab, v in kept]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda k: (k[0] is None, k[0] or 0, k[2]))[:entries]
    books = [[cut(v, p) for _, _, v in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, _, v in kept:
                groups[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])]
    out = [(i, lab, [near(cut(v, p), books[p]) for p in range(parts)]) for i, lab, v in kept]
    by = defaultdict(int)
    for _, lab, n in out:
        by[lab] += min(sum(d for d, _ in n), 2**63 - 1)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{k:02x}" for _, k in n), min(sum(d for d, _ in n), 2**63 - 1), min(by[lab], 2**63 - 1), digest, str(lab)) for i, lab, n in out)


def coded(spark, rows, kind="double", **more):
    from tidewatch.llm.vector_codes import vector_codes

    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    return sorted((str(r[0]), *r[1:5], str(r[5])) for r in vector_codes(clashing(df).repartition(3), **more).collect())


def test_vector_codes(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)], r.choice([1, 1, 1, 2, None])) for i in range(300)]
    rows += [(i, [round(x) for x in v], lab) for i, v, lab in rows[:60]]  # repeated ids, ties
    rows += [(900, None, 1), (901, [1.0, None], 1), (902, [float("nan")] * 8, 2), (903, [float("inf")] + [0.0] * 7, 2), (904, [], 3), (905, [0.5] * 3, None), (None, [0.25] * 8, 3)]
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], lab) for i, v, lab in rows]
    assert coded(spark, rows) == codes_by_force(rows)
    assert coded(spark, rows, entries=5, rounds=2) == codes_by_force(rows, entries=5, rounds=2)
    few = rows[:3]
    assert coded(spark, few) == codes_by_force(few)
    odd = [(i, v and v[:7], lab) for i, v, lab in rows[:40]]  # a width that four doesn't divide
    assert coded(spark, odd, entries=6) == codes_by_force(odd, entries=6)
    assert coded(spark, rows[360:364]) == [] == coded(spark, [])


def test_vector_codes_of_large_components(spark):
    r = random.Random(6)
    for scale in (3e5, 1e9, 1e15, 1e200, 1e306):
        rows = [(i, [r.gauss(0, 1) * scale for _ in range(4)], 1) for i in range(24)]
        assert coded(spark, rows, entries=6) == codes_by_force(rows, entries=6), scale


def test_equal_average_search_skips_entries():
    from tidewatch.llm.vector_codes import EqualAverage

    g = np.random.default_rng(0)
    entries, x = np.floor(g.normal(size=(256, 16)) * 100 + g.normal(size=(256, 1)) * 400), np.floor(g.normal(size=(3000, 16)) * 100 + g.normal(size=(3000, 1)) * 400)
    book = EqualAverage(entries)
    at, best = book.nearest(x)
    d = ((x[:, None] - entries) ** 2).sum(axis=2)
    assert (at == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all() and book.visited < 0.5 * d.size


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_lines():
    from tidewatch.llm.html_text import common_lines

    r = random.Random(2)
    for n in range(300):
        a, b = (np.array([r.randrange(r.choice([2, 5, 30])) for _ in range(r.randrange(40))], np.int64) for _ in range(2))
        i, j = common_lines(a, b, cells=r.choice([4, 30, 1 << 20]))
        assert (a[i] == b[j]).all() and (np.diff(i) > 0).all() and (np.diff(j) > 0).all() and len(i) == lcs_length(a, b), n
    a = np.arange(20_000)
    assert len(common_lines(a, np.concatenate([a[10_000:], a[:10_000]]))[0]) == 10_000


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="sidebar-left"><header><h2>Site</h2></header>
<nav><ul><li>Menu</ul></nav><div class="ad-slot adBanner">Buy</div><!-- <p>no --><main><article><header><h1>A &amp;  B&nbsp;&lt;b&gt;</h1></header><p>One <b>two<br>three
<p>Four <script>no()</script>five <a href="x>y">link</a> &copy; a < b</p><div>outer<p>inner</p>after</div><aside>Side</aside><form>Form <input> x</form>
<div class="share">Tweet</div><table><tr><td>c1<td>c2</table><pre> a
 b</pre></article><section id="comments"><p>First!</p></section></main><footer>Foot</footer></body></html>"""


def test_page_lines():
    from tidewatch.llm.html_text import CONTENT, OPEN, page_lines

    lines, kinds = page_lines(PAGE)
    kept = [x for x, k in zip(lines, kinds, strict=True) if k == CONTENT]
    assert kept == ["A & B <b>", "One two three", "Four five link © a < b", "outer", "inner", "after", "c1", "c2", "a b"]
    assert page_lines("") == ([], []) and page_lines("plain &amp; simple") == (["plain & simple"], [OPEN])
    assert page_lines("a<p>b<p")[0] == ["a", "b"] and page_lines("<script>x")[0] == [] and page_lines("</div></p>x<!-- y")[0] == ["x"]
    assert page_lines("<div>" * 20_000 + "deep")[0] == ["deep"] and len(page_lines("<p>x</p>" * 20_000)[0]) == 20_000


def test_main_text(spark):
    from tidewatch.llm.html_text import COPY, main_text, page_lines

    def page(k, body, name="div"):
        return f"<html><body><div>Welcome to the shop</div><{name}>{body}</{name}><div>All rights reserved</div><div>Since {k // 4}</div></body></html>"

    r = random.Random(4)
    rows = [(k, f"http://Host{k % 3}.example.com/d{k % 2}/{k}?q", page(k, "".join(f"<p>text {r.randrange(10**6)}</p>" for _ in range(4)))) for k in range(60)]
    rows += [(100 + k, f"http://host1.example.com/copy/{k}", page(7, "<p>the same body</p><p>again</p>")) for k in range(9)]  # copies aren't a template
    rows += [(200, "http://host1.example.com/d1/marked", PAGE), (201, None, "<p>alone</p>"), (202, "no host", None), (203, "http://x.y", ""), (200, "http://z.z/", "<article>" + "<p>w</p>" * 5000 + "</article>")]
    rows += [(None, "http://z.z/a", page(1, "<p>repeated passage</p><p>repeated passage</p>", "article")), (None, "http://z.z/b", page(2, "<p>repeated passage</p><p>b</p>", "article"))]
    parsed = []
    for n, (i, url, text) in enumerate(rows):
        rest = (url or "").partition("://")[2].split("?")[0].split("#")[0]
        host, slash, path = rest.partition("/")
        parsed.append([host.lower(), slash + path, n, *page_lines(text or ""), set()])
    order = sorted(parsed, key=lambda x: x[:3])
    runs = []
    for x in order:
        if runs and runs[-1][0][0] == x[0] and runs[-1][0][3] == x[3]:
            runs[-1].append(x)
        else:
            runs.append([x])
    best = {}
    for a, b in zip(runs, runs[1:], strict=False):
        x, y = a[0], b[0]
        if x[0] != y[0]:
            continue
        near = next((k for k, (p, q) in enumerate(zip(x[1], y[1], strict=False)) if p != q), min(len(x[1]), len(y[1])))
        n = lcs_length(x[3], y[3])
        for side, (run, mine, other) in enumerate(((a, x, y), (b, y, x))):
            if mine[3] and 0 < n / len(mine[3]) < COPY and (near, side) > best.get(id(run), ((-1, -1), None))[0]:
                best[id(run)] = (near, side), set(mine[3]) & set(other[3])  # lines of a fixture page come in the template's order
    want = []
    for run in runs:
        gone = best.get(id(run), (None, set()))[1]
        for _, _, n, lines, kinds, _ in run:
            marked = 2 in kinds
            kept = [x for x, k in zip(lines, kinds, strict=True) if (k == 2 if marked else k == 1 and x not in gone)]
            want.append((str(rows[n][0]), rows[n][1] or "", "\n".join(kept)))
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = main_text(df.repartition(5)).collect()
    # rows that repeat an id keep their own url
    assert sorted((str(g["page_id"]), g["url"] or "", g["text"]) for g in got) == sorted(want)
    assert all(g["n_chars"] == len(g["text"]) for g in got)
    texts = {g["page_id"]: g["text"] for g in got}
    assert "Welcome" not in texts[9] and "text " in texts[9] and all("the same body\nagain" in texts[100 + k] for k in range(9)) and texts[201] == "alone"
    assert sum(g["text"] == "repeated passage\nrepeated passage" for g in got) == 1
    assert main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("bad", ["<", "<a", "<a href='x", "<" * 500, "<a \"" * 300, "&#x110000; &#0; &bogus;", "<svg/>x<svg><p>y</svg>z", "<title>never closed"])
def test_broken_markup(bad):
    from tidewatch.llm.html_text import page_lines

    lines, kinds = page_lines(bad)
    assert len(lines) == len(kinds)
