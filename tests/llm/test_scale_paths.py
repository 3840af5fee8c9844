"""Paths that only large tables take, and the network against plain loops."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def exchanged(df):
    """Inputs of the plan's shuffles, by their columns' names."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    blocks = re.findall(r"\(\d+\) Exchange\b.*?(?=\n\n)", text, re.S)
    return [re.search(r"Input \[\d+\]: \[(.*?)\]", b)[1] for b in blocks if "Input" in b]


def test_exact_dedup_beyond_the_broadcast_bounds(spark, monkeypatch):
    """The same rows stay with bitmaps joined by shuffle and with rows that go told by a bitmap; no document or bitmap
    goes through a shuffle but those that fall on the rows that go."""
    from tidewatch.llm import exact_dedup as ed

    r = random.Random(3)
    rows = [(i if i % 11 else None, f"text {r.randrange(150)} {'A' if i % 2 else 'a'}", None, "s", 1) for i in range(600)] + [(5, "twice", None, None, None), (5, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("_at", "_bits", "_bucket", "_hit0", "_id", "_row")})
    order = lambda df: sorted(map(str, df.collect()))
    stay, decisions = order(ed.exact_dedup(docs)), order(ed.exact_dedup_decisions(docs))
    plain = ed.exact_dedup(docs)
    assert not any("_row" in x or "text" in x for x in exchanged(plain))
    monkeypatch.setattr(ed, "BROADCAST_BITS", 256)
    for bits in (256, 4096):
        assert order(ed.exact_dedup(docs, filter_bits=bits)) == stay and order(ed.exact_dedup_decisions(docs, filter_bits=bits)) == decisions
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = docs.select("doc_id", ed._sha("text"))
        bitmaps = ed.materialize(ed._bitmaps(keys, 4096), "t")
        seen = exchanged(ed._flagged(docs.select(F.col("doc_id").alias("_id"), ed._sha("text")), bitmaps, 4096))
        assert seen and not any("_bits" in x and "_sha" in x for x in seen)
        monkeypatch.setattr(ed, "BROADCAST_KEYS", 3)
        assert order(ed.exact_dedup(docs)) == stay
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cover_tree_blocks(spark):
    """Every query meets every shard that bounds leave open, whatever blocks it comes in; shards are copied for these only."""
    from tidewatch.llm.dual_tree import top_k

    g = np.random.default_rng(2)
    rows = [(i, [float(v) for v in g.normal(size=4) + 9 * (i % 5)]) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.floor(256 * np.array([v for _, v in rows]))
    want = []
    for q in range(0, 700, 3):
        s = x @ x[q]
        want += [(q, k + 1, int(i), int(s[i])) for k, i in enumerate([i for i in np.lexsort((np.arange(700), -s)) if i != q][:5])]
    for shard_rows, block_rows in ((60, 7), (60, 4096), (4096, 50)):
        got = top_k(df, F.col("vec_id") % 3 == 0, shard_rows=shard_rows, block_rows=block_rows)
        assert sorted(tuple(r) for r in got.collect()) == want


def test_byte_network_against_plain_loops():
    from tidewatch.llm.language_id import EMBED, FILTERS, WIDTHS, WINDOW, ByteNet, windows

    net, g = ByteNet(["a", "b", "c"], seed=8), np.random.default_rng(1)
    x = g.integers(0, 256, (5, WINDOW)).astype(np.uint8)
    got = net.probabilities(x)
    for row, p in zip(x.tolist(), got, strict=True):
        hidden = []
        for w in WIDTHS:
            for f in range(FILTERS):
                best = max(sum(float(net.p["e"][row[i + k], e]) * float(net.p[f"w{w}"][k, e, f]) for k in range(w) for e in range(EMBED)) for i in range(WINDOW - w + 1))
                hidden.append(max(best + float(net.p[f"b{w}"][f]), 0.0))
        z = np.array(hidden) @ net.p["v"].astype(float) + net.p["c"]
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert np.abs(p - want).max() < 1e-4
    texts = [b"", b"x" * 10, b"y" * WINDOW, b"z" * 5000, b"w" * (WINDOW + 1)]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    start, end, row = windows(np.frombuffer(b"".join(texts), np.uint8), off)
    for i, t in enumerate(texts):
        mine = [(int(s - off[i]), int(e - off[i])) for s, e, r in zip(start, end, row, strict=True) if r == i]
        assert mine[0][0] == 0 and mine[-1][1] == len(t) and all(e - s <= WINDOW for s, e in mine)
        # every run of WIDTHS bytes lies in some window
        assert all(any(s <= k and k + max(WIDTHS) <= e for s, e in mine) for k in range(len(t) - max(WIDTHS) + 1))


def test_no_label_is_left_out(spark):
    """More languages than the sample has rows for: each is learned from a few rows."""
    from tidewatch.llm.language_id import _loaded, predict_languages, train

    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i % 26)} " * 20, f"l{i % 26:02}", "s", 1) for i in range(780)]
    docs = spark.createDataFrame(rows, DOCS)
    assert len(_loaded(train(docs, sample_rows=20))[0].langs) == 26
    got = {r["lang_pred"] for r in predict_languages(docs, sample_rows=20).collect()}
    assert got <= {f"l{i:02}" for i in range(26)} and len({r["lang_pred"] for r in predict_languages(docs, sample_rows=2400).collect()}) > 20, got


def test_near_links_of_one_large_bucket(spark):
    """A bucket of mostly unlike rows, in blocks of any size: signatures tell the few rows with a partner, and the links
    among these connect what all pairs connect."""
    from functools import partial

    from tidewatch.llm import minhash_dedup as m

    r = random.Random(8)
    texts = []
    for g in range(330):
        words = [f"w{r.randrange(4000)}" for _ in range(80)]
        for k in range(6 if g < 12 else 1):
            texts.append(" ".join(words[:40] + [f"x{r.randrange(4000)}" for _ in range(k and 1)] + words[40 + (k and 1) :]))
    sets = list(m.shingle_sets(pa.array(texts), 5))
    link = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y))
    label = list(range(len(sets)))
    for j in range(72):  # later texts are unlike all others
        for i in range(j):
            if link(sets[i], sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert len(set(label[:72])) < 40
    sigs = [m.signature(u) for u in sets]
    bands = (m.band_keys(np.array(sigs)) | 1).tolist()
    rows = spark.createDataFrame([(7, 0, i, i, len(u)) for i, u in enumerate(sets)], "h long, band int, id long, label long, n long")
    told = spark.createDataFrame([(i, bytearray(s.astype(np.uint8).tobytes()), b) for i, (s, b) in enumerate(zip(sigs, bands, strict=True))], "id long, sig binary, keys array<long>")
    whole = spark.createDataFrame([(i, bytearray(u.tobytes())) for i, u in enumerate(sets)], "id long, payload binary")
    bayes = {"least": m.least_matches(0.85, 1e-7), "num": 85, "den": 100}
    for signatures, block in ((4096, 1024), (64, 16)):
        at = lambda k: F.ceil(F.count(F.lit(1)) / k)
        some = m.materialize(m._in_blocks(rows, at(signatures), lambda x: x.join(told, "id"), partial(m._open_rows, **bayes), rows.schema.simpleString()[7:-1].replace(":", " "), len(sets)).distinct(), "t")
        assert {x["id"] for x in some.collect()} == set(range(72))
        links = m._in_blocks(some, at(block), lambda x: x.join(told, "id").join(whole, "id"), partial(m._link_block, **bayes), "a long, b long", len(sets)).distinct()
        got = list(range(len(sets)))
        for x in links.collect():
            assert link(sets[x["a"]], sets[x["b"]])
            low, high = sorted((got[x["a"]], got[x["b"]]))
            got = [low if y == high else y for y in got]
        assert got == label
