"""Each operator against brute force, with nulls, empty and long texts, ties, repeats, empty tables and odd columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " ", "a", " a ", "\n", "a\n\nb  c", "A b\tC d\u00a0e f", "<|endoftext|> x <|im_end|>", "日本語 テスト。 x", "▁ a▁b", "x " * 3000, "é,è. 5.5 it's", "\x00\x01 z"]


def docs_of(spark, texts, **more):
    rows = [(i, t, None, f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD + ODD[3:9]).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """Columns of the names that operators use inside."""
    return df.withColumns({c: F.lit(1) for c in ("_id", "_row", "_sha", "_maybe", "id", "n", "h", "key", "_copies", "_gone")})


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def word_list(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_wavelet_file(tmp_path):
    from tidewatch.llm.wavelet import BLOCK_BITS, WaveletFile, open_shard, to_bytes

    for n in (0, 1, 700, 5000, 3 * BLOCK_BITS, 3 * BLOCK_BITS + 70_001):
        a = np.random.default_rng(n).integers(0, 300 if n < 99_000 else 70_000, n).astype(np.uint32)
        m = WaveletFile.from_bytes(to_bytes(a, [None, 5], [0, n]))
        assert (m.decode() == a).all() and m.doc_ids == [None, 5] and m.lengths.tolist() == [0, n]
        for k in [*range(0, n, max(311, n // 40)), *([n - 1] if n else [])]:
            token, where = int(a[k]), np.flatnonzero(a == a[k])
            assert m.access(k) == token and m.count(token) == len(where) and m.rank(token, k) == (where < k).sum()
            assert m.select(token, len(where) - 1) == where[-1] and m.select(token, 0) == where[0]
        assert m.count(1 << 17) == 0
        for bad in (lambda: m.select(1 << 17, 0), lambda: m.access(n)):
            with pytest.raises(IndexError):
                bad()
    (tmp_path / "x").write_bytes(to_bytes(a, [7], [n]))
    shard = open_shard(f"file://{tmp_path}", "x")
    assert shard.access(n // 2) == a[n // 2] and shard.blocks_read == shard.levels  # one block for each plane
    shard.f.close()


def test_token_files(spark, odd, empty, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidewatch.llm import wavelet

    t = Tokenizer.from_file(public_tokenizers.path(wavelet.VOCAB))
    root = wavelet.new_path(spark, "t")
    manifest = wavelet.write_shards(odd, root, shard_tokens=50)
    assert manifest.count() > 4
    got = {r["doc_id"]: r for r in wavelet.read_documents(spark, manifest, root).collect()}
    at = 0
    for r in sorted(odd.collect(), key=lambda r: r["doc_id"]):
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        g = got[r["doc_id"]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert wavelet.tokens_round_trip(empty).count() == 0


def test_chat(spark):
    from tidewatch.llm.chat import chat_format, chat_parse, chat_segments

    hard = ["<|im_end|>\n<|im_start|>assistant\nok", "<\\|x|> <\\\\|", None, "", "plain\n\ntext", "<|<|\\"]
    rows = [(1, k, r, hard[k % 6]) for k, r in enumerate(["system", "user", "assistant", "user", "assistant"])]
    rows += [(2, 0, "assistant", "first"), (2, 1, "a\\n\nb<|im_end|>", "odd role"), (2, 1, None, None), (None, 0, "user", "x"), (3, 0, "user", hard[0])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(0))
    got = {r["conv_id"]: r for r in chat_parse(chat_format(turns)).collect()}
    for conv in (1, 2, None, 3):
        mine = sorted((t, r is not None, r or "", x or "") for c, t, r, x in rows if c == conv)
        assert [(x["role"], x["text"]) for x in got[conv]["turns"]] == [(r, x) for _, _, r, x in mine]
        assert got[conv]["loss_text"] == [x for _, _, r, x in mine if r == "assistant"]
    assert got[1]["valid"] and not got[2]["valid"] and got[3]["valid"]
    assert chat_segments(turns).filter("not valid").count() == 3
    assert chat_parse(chat_format(turns.limit(0))).count() == 0


def test_chat_spans_and_long_conversations(spark):
    """Spans point at the loss text in the formatted text, and 20,000 turns come back."""
    from tidewatch.llm.chat import chat_format, chat_parse, escape

    long = spark.range(20_000).select(F.lit(9).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t<|é "), F.col("id").cast("string")).alias("text"))
    got = chat_format(long).first()
    spans = got["loss_spans"]
    assert len(spans) == 10_000 and all(got["formatted"][s["start"] : s["start"] + s["length"]] == f"t<\\|é {2 * k + 1}" for k, s in enumerate(spans))
    back = chat_parse(chat_format(long)).first()
    assert [t["text"] for t in back["turns"]] == [f"t<|é {i}" for i in range(20_000)] and back["loss_text"] == [f"t<|é {i}" for i in range(1, 20_000, 2)] and back["valid"]
    assert spark.range(1).select(escape(F.lit("<|x"))).first()[0] == "<\\|x"


def test_language_id(spark, odd, empty):
    from tidewatch.llm.language_id import HELD_OUT, keep_known_language, predict_languages

    r = random.Random(1)
    words = {"aa": ["thin", "wher", "ould", "ness"], "bb": ["zeit", "schk", "ungü", "erß"], "cc": ["ción", "ñasa", "lleg", "arro"]}
    rows = [(i, " ".join(r.choice(words[k]) + r.choice(words[k]) for _ in range(r.choice([8, 40, 400]))), k, "s", 1) for i in range(400) for k in [r.choice(list(words))]]
    rows += [(1000, None, "aa", "s", 1), (1001, "123 ... 4", "aa", "s", 1), (1002, "", None, None, 1), (None, "thinwher ould", None, "s", 1)]
    d = spark.createDataFrame(rows, DOCS)
    got = predict_languages(clashing(d).drop("id")).collect()
    assert len(got) == len(rows)
    lang = {i: k for i, _, k, _, _ in rows}
    held = [g for g in got if g["held_out"] and g["doc_id"] is not None and g["doc_id"] < 1000]
    assert len(held) > 50 and sum(g["lang_pred"] == lang[g["doc_id"]] for g in held) / len(held) > 0.97
    assert all(g["held_out"] == (zlib.crc32(str(g["doc_id"]).encode()) % 4 == HELD_OUT) for g in got if g["doc_id"] is not None)
    assert {g["doc_id"]: (g["lang_pred"], g["score"]) for g in got if g["doc_id"] in (1000, 1001, 1002)} == {i: ("und", 0.0) for i in (1000, 1001, 1002)}
    assert all(0 <= g["score"] <= 1 for g in got)
    kept = keep_known_language(clashing(d))
    assert kept.columns == clashing(d).columns and kept.count() == 401
    assert {x["lang_pred"] for x in predict_languages(odd).collect()} == {"und"} and predict_languages(empty).count() == 0 and keep_known_language(empty).count() == 0


def test_url_rules(spark):
    from tidewatch.llm.url_rules import judge_urls

    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/es/a", "allow"), ("example.com", "", "block"), ("com", "/en/abc/defg/hi", "allow")]
    r = random.Random(2)
    hosts = ["example.com", "www.example.com", "a.www.example.com", "xexample.com", "b.net", "net", "NET", "com", "example.org", "", "com.", "example.com:80"]
    paths = ["", "/", "/en/", "/en/1?x=/es/", "/es/ab#q", "/es", "/EN/", "/en/abc/defg/hij", "?q", "#/en/"]
    urls = [f"{r.choice(['http', ''])}://{r.choice(hosts)}{r.choice(paths)}" for _ in range(400)] + ["http://hot.example.com/en/x"] * 300 + [None, "", "no scheme", "a://b://c/en/", "http://a.com/en\n/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("key", F.lit(1))
    table = spark.createDataFrame(rules, "host string, path string, verdict string")

    def judge(url):
        at = (url or "").find("://")
        if at < 0:
            return "", "", None, "allow"
        rest = url[at + 3 :]
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest)[0]) :])[0]
        fit = [x for x in rules if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fit, key=lambda x: (len(x[0] + x[1]), len(x[0])), default=None)
        return host, path, best and best[0] + best[1], best[2] if best else "allow"

    got = {g["page_id"]: tuple(g)[1:] for g in judge_urls(pages, table).collect()}
    assert got == {i: judge(u) for i, u in enumerate(urls)}
    assert {g["verdict"] for g in judge_urls(pages, table.limit(0), default="block").collect()} == {"block"}
    assert judge_urls(pages.limit(0), table).count() == 0


def test_exact_dedup(spark, odd, empty):
    from tidewatch.llm.exact_dedup import exact_dedup, exact_dedup_decisions

    rows = [(i, t, None, None, 0) for i, t in enumerate((ODD + [x.upper() if x else x for x in ODD]) * 2)] + [(None, "A", None, None, 0), (None, "only null", None, None, 0), (7000, "ÉA", None, None, 0), (7001, "éa", None, None, 0)] + [(9000 + i, "hot", None, None, 0) for i in range(300)]
    d = spark.createDataFrame(rows, DOCS)
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(lower(t), []).append(i)
    keep = {k: max((x for x in v if x is not None), default=None) for k, v in groups.items()}
    for bits in (1 << 8, 1 << 16, 1 << 26, None):  # a full filter only sends more rows on
        got = exact_dedup_decisions(d, filter_bits=bits).collect()
        assert len(got) == len(rows)
        want = sorted((i is None, i or 0, keep[lower(t)], len(groups[lower(t)]), i == keep[lower(t)], hashlib.sha256(lower(t).encode()).hexdigest()) for i, t, *_ in rows if i is not None)
        assert sorted((g[0] is None, g[0] or 0, *tuple(g)[1:]) for g in got if g[0] is not None) == want
    stay = exact_dedup(clashing(d))
    assert stay.columns == clashing(d).columns
    assert sorted(x[0] is not None and x[0] or -1 for x in stay.select("doc_id").collect()) == sorted(-1 if v is None else v or -1 for v in keep.values())
    assert exact_dedup(empty).count() == 0 and exact_dedup_decisions(empty).count() == 0
    # rows that share an id are decided each by its own text: no text is lost, whatever the filter's size
    for rows in ([(1, "A"), (2, "A"), (1, "B"), (0, "B")], [(1, "A"), (2, "A"), (1, "B")], [(None, "A"), (2, "a"), (None, "B"), (None, "b")]):
        again = spark.createDataFrame(rows, "doc_id long, text string")
        for bits in (1 << 8, 1 << 26):
            left = [tuple(x) for x in exact_dedup(again, filter_bits=bits).collect()]
            assert {lower(t) for _, t in left} == {lower(t) for _, t in rows} and (2, "A") in left or (2, "a") in left
            best = {lower(t): max((-1 if i is None else i for i, u in rows if lower(u) == lower(t))) for _, t in rows}
            assert all((-1 if i is None else i) == best[lower(t)] for i, t in left)


def test_sentencepiece(spark, odd, empty):
    import public_tokenizers
    import sentencepiece

    from tidewatch.llm.sentencepiece_codec import MODEL, sp_decode, sp_digests, sp_encode

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    got = {r["doc_id"]: r for r in sp_digests(clashing(odd).drop("id")).collect()}
    plain = {r["doc_id"]: r["ids"] for r in sp_encode(odd).collect()}
    back = {r["doc_id"]: r["text"] for r in sp_decode(sp_encode(odd)).collect()}
    for r in odd.collect():
        ids = sp.encode(r["text"] or "", add_eos=True)
        g, text = got[r["doc_id"]], sp.decode(ids)
        assert plain[r["doc_id"]] == ids and back[r["doc_id"]] == text
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert sp_digests(empty).count() == 0


def test_sentencepiece_words():
    """Rows of agendas, heaps and the library agree, on words of all lengths, unknown characters and marks inside."""
    import public_tokenizers

    from tidewatch.llm.sentencepiece_codec import LONG, MARK, MODEL, Agenda

    agenda, r = Agenda(public_tokenizers.path(MODEL)), random.Random(9)
    texts = [MARK + "".join(r.choice("etaoinshrdlu éßñ日本ह🙂\u0301.,'0129" + MARK if n > 3 else "ab").replace(" ", MARK) for _ in range(n)) for n in [*range(12), 63, 64, 65, 300, 3000] for _ in range(30)]
    texts += [MARK, MARK * 5, MARK + "x" * 5000, MARK + "ab" * 2000]
    flat, lens = agenda.symbols(texts)
    for t, ours in zip(texts, np.split(flat, np.cumsum(lens)[:-1]), strict=True):
        assert ours.tolist() == agenda._word(t) == agenda.word(t)
    assert max(map(len, texts)) > LONG
    pieces = list(dict.fromkeys(t.replace(MARK, " ").encode() for t in texts if MARK not in t[1:]))
    ids, lens = agenda.words(pieces)  # raises where the library differs
    assert len(lens) == len(pieces) and lens.sum() == len(ids)


def test_warc(spark):
    from tidewatch.llm import warc

    big = "<p>" + "é" * 600 + "</p>"
    rows = [(0, "http://a", big), (1, None, "small"), (2, "http://b\r\nX: y", big), (3, "http://c", None), (4, "d", "small"), (None, "e", "x"), (5, "f", big + "!"), (6, "g", "WARC/1.1\r\n\r\n\r\n\r\n")] + [(10 + i, "h", "z" * 2000) for i in range(150)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("bucket", F.lit("b"))
    root = warc.new_path(spark, "w")
    first = warc.write_archives(pages, root, roll_bytes=600)
    assert first.count() > 4
    again = warc.write_archives(pages.orderBy(F.rand(3)), warc.new_path(spark, "w"), roll_bytes=600)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
    got = {g["page_id"]: g for g in warc.read_archives(spark, first, root).collect()}
    assert len(got) == len(rows)
    last = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 1000:
            last[h] = max(last.get(h, -1), i)
    for i, _, h in rows:
        g, body = got[i], (h or "").encode()
        refers = last[h] if h in last and last[h] != i else None
        assert (g["payload_bytes"], g["payload_digest"], g["record_type"], g["refers_to"]) == (len(body), hashlib.sha1(body).hexdigest(), "revisit" if refers is not None else "response", refers)
        assert g["html"] == (None if refers is not None else h or "")
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def near_texts():
    """A text and edited copies of it at many distances, two of whose ends only meet over others, and odd cases."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(150)]
    out = []
    for _ in range(160):
        t = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8])):
            t[r.randrange(len(t))] = word()
        out.append(" ".join(t).capitalize())
    out += [" ".join(base[:75] + [word() for _ in range(75)]) for _ in range(40)]
    return out + ["one two three", "ONE two  three", "one two", None, "", " \t", "one two three four five", "x " * 4000, "x " * 4001] + [" ".join(base)] * 30


def test_minhash_dedup(spark, empty):
    from tidewatch.llm import minhash_dedup as m

    texts = near_texts()
    sets = []
    for t in texts:
        w = word_list(lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    d = clashing(docs_of(spark, texts))
    got = {g["doc_id"]: tuple(g)[1:] for g in m.near_dedup_decisions(d).collect()}
    assert got == {i: (len(sets[i]), label[i], label[i] == i) for i in range(len(texts))}
    assert 20 < len(set(label)) < len(texts) - 60
    stay = m.near_dedup(d, percent=85)
    assert stay.columns == d.columns and sorted(x[0] for x in stay.select("doc_id").collect()) == sorted(set(label))
    assert m.near_dedup_decisions(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f", None, None, 0), (1, "a b c d e f", None, None, 0), (1, "a b c d e f", None, None, 0)], DOCS)
    assert sorted((g["doc_id"] is None, g["component_id"], g["kept"]) for g in m.near_dedup_decisions(odd).collect() if g["doc_id"]) == [(False, 1, True)] * 2


def test_near_dedup_keeps_every_text_of_a_repeated_id(spark):
    from tidewatch.llm import minhash_dedup as m

    t, u, v = (" ".join(f"{x}{i}" for i in range(60)) for x in "tuv")
    edited = u.replace("u59", "end")
    rows = [(1, t), (2, t), (2, u), (3, edited), (3, v), (None, v), (None, None), (3, v)] + [(50, " ".join(f"z{i}" for i in range(60)) + f" {k}") for k in range(30)]
    got = m.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(g["doc_id"]), g["text"] or "") for g in got if g["doc_id"] != 50) == sorted([("1", t), ("2", u), ("3", v), ("3", v), ("None", v), ("None", "")])
    assert sorted(g["text"] for g in got if g["doc_id"] == 50) == sorted(x for i, x in rows if i == 50)
    decided = m.near_dedup_decisions(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).filter("doc_id < 50").collect()
    assert sorted((g["doc_id"], g["component_id"]) for g in decided) == [(1, 1), (2, 1), (2, 2), (3, 2), (3, 3), (3, 3)]


def test_link_blocks_lose_nothing(monkeypatch):
    """Blocks of four rows find the components that all pairs have."""
    import pyarrow as pa

    from tidewatch.llm import minhash_dedup as m

    sets = list(m.shingle_sets(pa.array(near_texts()[:60]), 5))
    sigs = np.array([m.signature(u) for u in sets])
    keys, rows = m.band_keys(sigs), []
    for band in range(m.BANDS):
        for h in set(keys[:, band].tolist()):
            mine = np.flatnonzero(keys[:, band] == h).tolist()
            n = math.ceil(len(mine) / 4)
            for k in mine if len(mine) > 1 else []:
                rows += [{"h": h, "band": band, "i": min(k % n, o), "j": max(k % n, o), "own": k % n, "id": k, "label": k, "n": len(sets[k]), "sig": sigs[k].astype(np.uint8).tobytes(), "keys": keys[k].tolist(), "payload": sets[k].tobytes()} for o in range(n)]
    rows.sort(key=lambda r: (r["h"], r["i"], r["j"], r["id"]))
    t = pa.Table.from_pylist(rows)
    links = {(a, b) for out in m._blocks(iter(t.to_batches(max_chunksize=7)), m.least_matches(0.85, 1e-7), 85, 100) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)}

    def parts(pairs):
        label = list(range(len(sets)))
        for a, b in pairs:
            label = [label[a] if x == label[b] else x for x in label]
        return [label.index(x) for x in label]

    every = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))]
    assert links and parts(links) == parts(every)


def test_pipeline_links_from_080(spark):
    """Pairs and a chain at Jaccard 131/161 = 0.81, which the pipeline's stage links and op 8's threshold doesn't."""
    import corpus_pipeline
    from tidewatch.llm import minhash_dedup as m

    texts = []
    for k in range(40):
        base = [f"w{k}x{i}" for i in range(150)]
        edited = [w + "y" if i in (30, 60, 90) else w for i, w in enumerate(base)]
        texts += [" ".join(base), " ".join(edited)]
    texts.append(" ".join(w + "y" if i in (45, 75, 105) else w for i, w in enumerate(edited)))
    d = docs_of(spark, texts)
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, d, "").collect()} == set(range(0, 80, 2))
    assert m.near_dedup_decisions(d).filter("kept").count() == 81
    assert all((1 - (p / 100) ** w) ** b < 5e-7 and w * b <= m.PERMS for p in (80, 85) for w, b in [m.band_shape(p)])


def best_of(vec, k=5):
    """(query, rank, id, score) of the ids divisible by 50, in Python's integers; scores end at +-(2**63 - 1)."""
    most, out = 2**63 - 1, []
    for q in (i for i in vec if i % 50 == 0):
        score = lambda i, q=q: max(-most, min(most, sum(a * b for a, b in zip(vec[q], vec[i], strict=False))))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted((-score(i), i) for i in vec if i != q)[:k])]
    return sorted(out)


def scaled_vector(v):
    return [int(x) * 256 if abs(x) > 2**53 else math.floor(256 * x) for x in v]


def test_dual_tree(spark):
    from tidewatch.llm.dual_tree import top_k

    r = np.random.default_rng(5)
    centres = r.normal(0, 1, (12, 8))
    rows = [(i, (centres[i % 12] + r.normal(0, 0.1, 8)).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[50][1]) for i in range(60)] + [(2000, None), (2001, [None] * 8), (2050, [float("nan")] * 8), (2100, [float("inf")] * 8), (2150, [1.0, 2.0]), (2200, [1e30] * 8), (2201, [-1e30] + [0.0] * 7), (None, [1.0] * 8), (2250, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("start", F.lit("x"))
    want = best_of({i: scaled_vector([float(np.float32(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    assert {2200} < {q for q, *_ in want} and any(i == 2200 and q != 2200 for q, _, i, _ in want)
    for shard, block in ((4096, 2048), (100, 7)):
        got = top_k(df, F.col("vec_id") % 50 == 0, shard_rows=shard, block_rows=block).collect()
        assert sorted(map(tuple, got)) == want
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert top_k(df.filter("vec_id = 2050"), F.col("vec_id") % 50 == 0).count() == 0
    few = {i: scaled_vector([float(np.float32(x)) for x in v]) for i, v in rows[:2]}
    assert [tuple(g) for g in top_k(df.filter("vec_id in (0, 1)"), F.col("vec_id") % 50 == 0).collect()] == best_of(few)


def test_repeated_vector_ids(spark):
    """Rows that share an id count once per row, and a hot vector spreads over the shards of its pivot."""
    from tidewatch.llm.dual_tree import top_k

    rows = [(i, [float(i % 7), 1.0]) for i in range(40)] + [(50, [1.0, 1.0])] + [(7, [9.0, 9.0])] * 3
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 50, shard_rows=8, block_rows=1).collect()
    assert [(g["vec_id"], g["score"]) for g in sorted(got, key=lambda g: g["rank"])][:3] == [(7, 18 * 256 * 256)] * 3


def test_cover_tree_invariants_and_pruning():
    from tidewatch.llm.dual_tree import CoverTree, DualSearch

    r = np.random.default_rng(7)
    centres = r.normal(0, 1, (40, 16))
    x = np.floor(256 * (centres[r.integers(0, 40, 8000)] + r.normal(0, 0.01, (8000, 16))))
    t = CoverTree(x)
    below = {a: t.members[a] for a in range(len(t.parent)) if t.leaf[a]}
    for a in range(len(t.parent) - 1, -1, -1):
        if not t.leaf[a]:
            kids = np.arange(t.first[a], t.first[a] + t.count[a])
            below[a] = np.concatenate([below[c] for c in kids.tolist()])
            apart = np.sqrt(((t.at[kids][:, None] - t.at[kids]) ** 2).sum(axis=2)) + 1e18 * np.eye(len(kids))
            assert apart.min() >= t.radius[kids].max() * (1 - 1e-6) and t.centre[kids[0]] == t.centre[a]  # separation, nesting
        assert np.sqrt(((x[below[a]] - t.at[a]) ** 2).sum(axis=1)).max() <= t.radius[a] <= 2.0 ** t.level[a]  # covering
    assert sorted(below[0].tolist()) == list(range(8000))
    s = DualSearch(x[::10], np.arange(0, 8000, 10), x, np.arange(8000), 5)
    s.search()
    assert s.pruned > 0.5 * s.pairs and s.pruned_inner > 0
    q, found, score = s.results()
    exact = x[::10] @ x.T
    exact[np.arange(800), np.arange(0, 8000, 10)] = -np.inf
    assert (np.sort(score.reshape(-1, 5), axis=1)[:, ::-1] == -np.sort(-exact, axis=1)[:, :5]).all()
    big = DualSearch(np.full((1, 8), 2.0**26), np.array([-1]), np.full((2, 8), 2.0**26), np.array([1, 2]), 5)
    big.search()
    assert big.results()[2].tolist() == [2**55, 2**55]


def test_dual_tree_large_vectors(spark):
    """Unnormalised vectors take part with exact scores; scores that leave a long count as its ends."""
    from tidewatch.llm.dual_tree import top_k

    r = np.random.default_rng(6)
    rows = [(i, (r.normal(0, 1, 8) * 10.0 ** int(r.integers(0, 8) if i % 3 == 0 else 0)).tolist()) for i in range(400)]
    rows += [(1000 + i, [s * 10.0**e] * 8) for i, (s, e) in enumerate([(1, 6), (-1, 6), (1, 12), (-1, 12), (1, 15), (-1, 15), (-1, 15)])] + [(2000, [1e6] + [0.0] * 7), (2050, [-1e15] * 8), (2100, [2.0**55] * 8), (2150, [1e307] * 8), (2151, [0.001, -1e200] + [3.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    most, want = 2**63 - 1, best_of({i: scaled_vector(v) for i, v in rows})
    assert any(s == most for *_, s in want) and any(1000 <= i for _, _, i, _ in want) and any(q == 2000 for q, *_ in want)
    for shard, block in ((4096, 2048), (50, 3)):
        assert sorted(map(tuple, top_k(df, F.col("vec_id") % 50 == 0, shard_rows=shard, block_rows=block).collect())) == want
    only = df.filter("vec_id in (1005, 1006, 1004) or vec_id = 1000")
    assert sorted(tuple(g) for g in top_k(only, F.col("vec_id") == 1004).collect())[-2:] == [(1004, 2, 1005, -most), (1004, 3, 1006, -most)]


def test_mixing(spark, odd, empty):
    from tidewatch.llm.mixing import mix, mix_decisions

    r = random.Random(6)
    rows = [(i, "w " * r.choice([0, 1, 20, 300]), None, r.choice(["a", "b", "b", "b", "c", "d", None]), 0) for i in range(600)] + [(i, "", None, "zero", 0) for i in range(700, 705)] + [(5, "w w", None, "a", 0)]
    d = spark.createDataFrame(rows, DOCS)
    got = mix_decisions(clashing(d)).collect()
    assert len(got) == len(rows) and sorted((str(x) for x in got)) == sorted(str(x) for x in mix_decisions(clashing(d).repartition(7)).collect())
    size, total = {}, 0
    for _, t, _, s, _ in rows:
        size[s] = size.get(s, 0) + len(word_list(t))
        total += len(word_list(t))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        rest = total - sum(3 * size[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        target = {s: 3.0 * size[s] if s in capped else weight[s] * rest / w for s in order}
        more = {s for s in order if s not in capped and target[s] > 3 * size[s]}
        if not more:
            break
        capped |= more
    taken = {}
    for g in got:
        assert g["source_size"] == size[g["source"]] and math.isclose(g["target"], target[g["source"]], rel_tol=1e-12)
        assert g["taken"] == g["copies"] * g["size"] and 0 <= g["copies"] <= 3
        taken[g["source"]] = taken.get(g["source"], 0) + g["taken"]
    assert all(abs(taken[s] - target[s]) <= 300 for s in order)
    key = lambda x: sorted((g["doc_id"], g["taken"]) for g in x)
    assert key(got) == key(mix_decisions(d.orderBy(F.rand(1))).collect())
    m = mix(clashing(d))
    assert m.columns == clashing(d).columns and m.count() == sum(g["copies"] for g in got)
    assert mix(empty).count() == 0 and mix_decisions(empty).count() == 0 and mix_decisions(odd).count() == odd.count()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(8)
    langs = {"xx": ["thin", "wher", "ould"], "yy": ["zeit", "schk", "ungü"]}
    rows, texts = [], []
    for i in range(120):
        k = r.choice(list(langs))
        texts.append(" ".join(r.choice(langs[k]) + r.choice(langs[k]) + r.choice(langs[k]) for _ in range(200)))
        rows.append((i, texts[-1], k, f"s{i % 4}", 0))
    rows += [(200, texts[3].upper(), "xx", "s1", 0), (201, texts[4] + " end", "xx", "s1", 0), (202, None, "xx", "s1", 0), (203, "12 !", "xx", "s1", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [docs.count()]
    ids = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"{tmp_path}/{name}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        ids.append({x[0] for x in docs.select("doc_id").collect()})
        seen.append(docs.count())
    assert seen == [124, 122, 121, 120]
    assert ids[0] == {*range(120), 200, 201} and ids[1] == ids[0] - {3} and ids[2] == ids[1] - {201}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and {x[0] for x in out.select("doc_id").collect()} <= ids[2]
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
