"""Language ID by a byte convolutional network: multi-width filters, max pooling and softmax, trained in numpy.

A text is cut into overlapping windows of fixed length; each window's bytes are embedded, convolved with filters of
several widths, pooled by their maxima and classified; a text's probabilities are its windows' means weighted by
their bytes. Training takes a bounded sample of labelled rows, drawn by hash of the id in equal parts per language.

Defined cases: a text that is null or has no letter is ``und`` with score 0; labels that are null are not learned;
without any labelled row everything is ``und``; repeated rows are predicted alike; further columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bytes as tb
from ._common import release, small_batches

UND = "und"
WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
STRIDE = WINDOW - max(WIDTHS) + 1
#: Training takes about this many labelled rows, in equal parts per language, and WINDOWS windows of each.
SAMPLE_ROWS, WINDOWS = 2400, 3
#: Training rows of a language at least: with more languages than SAMPLE_ROWS / LEAST_ROWS the sample grows with them.
LEAST_ROWS = 4
HELD_OUT = 2


def fold(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4))


def has_letter(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


class ByteNet:
    """Weights of the network; ``fit`` trains them, ``probabilities`` applies them to windows of bytes."""

    def __init__(self, langs: list[str], seed: int = 3):
        r = np.random.Generator(np.random.PCG64(seed))
        self.langs = langs
        self.p = {"e": r.normal(0, 0.5, (256, EMBED)), "v": r.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))), "c": np.zeros(len(langs))}
        for w in WIDTHS:
            self.p |= {f"w{w}": r.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)), f"b{w}": np.zeros(FILTERS)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        pooled, where = [], []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            y = sum((self.p["e"] @ self.p[f"w{w}"][k])[x[:, k : k + n]] for k in range(w))
            at = y.argmax(axis=1)
            where.append(at)
            pooled.append(np.take_along_axis(y, at[:, None, :], 1)[:, 0] + self.p[f"b{w}"])
        h = np.concatenate(pooled, axis=1)
        a = np.maximum(h, 0)
        z = a @ self.p["v"] + self.p["c"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True), a, where

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 14, batch: int = 128, rate: float = 0.01, seed: int = 5) -> ByteNet:
        """Adam on the cross entropy; max pooling passes a gradient to one place per filter and window."""
        r, m, v, step = np.random.Generator(np.random.PCG64(seed)), {}, {}, 0
        for epoch in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                xb, step = x[rows], step + 1
                prob, a, where = self._forward(xb)
                d = prob.copy()
                d[np.arange(len(rows)), y[rows]] -= 1
                d /= len(rows)
                g = {"v": a.T @ d, "c": d.sum(axis=0), "e": np.zeros_like(self.p["e"])}
                dh = (d @ self.p["v"].T) * (a > 0)
                for k, w in enumerate(WIDTHS):
                    dw = dh[:, k * FILTERS : (k + 1) * FILTERS]
                    g[f"b{w}"], gw = dw.sum(axis=0), np.zeros_like(self.p[f"w{w}"])
                    for o in range(w):
                        seen = xb[np.arange(len(rows))[:, None], where[k] + o]  # the byte under each filter's offset
                        gw[o] = np.einsum("bfe,bf->ef", self.p["e"][seen], dw)
                        np.add.at(g["e"], seen.ravel(), (dw[:, :, None] * self.p[f"w{w}"][o].T[None]).reshape(-1, EMBED))
                    g[f"w{w}"] = gw
                for n in g:
                    m[n] = 0.9 * m.get(n, 0) + 0.1 * g[n]
                    v[n] = 0.999 * v.get(n, 0) + 0.001 * g[n] ** 2
                    self.p[n] = (self.p[n] - rate * (0.5 ** (epoch // 5)) * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def tables(self) -> list[tuple[np.ndarray, np.ndarray | None, int]]:
        """Embedding and filters folded into one row of filter values per pair of neighbouring bytes."""
        out = []
        for w in WIDTHS:
            t = [(self.p["e"] @ self.p[f"w{w}"][k]).astype(np.float32) for k in range(w)]
            pair = lambda a, b: (a[:, None] + b[None]).reshape(-1, FILTERS)
            out.append((pair(t[0], t[1]), None if w == 2 else t[2] if w == 3 else pair(t[2], t[3]), w))
        return out

    def probabilities(self, x: np.ndarray, tables: list | None = None) -> np.ndarray:
        two = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        pooled = []
        for head, tail, w in tables or self.tables():
            n = x.shape[1] - w + 1
            y = head[two[:, :n]]
            if w == 3:
                y += tail[x[:, 2 : 2 + n]]
            elif w == 4:
                y += tail[two[:, 2 : 2 + n]]
            pooled.append(y.max(axis=1) + self.p[f"b{w}"])
        z = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.p["v"] + self.p["c"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every row's windows over its whole text, zeros after its end: starts, ends, and the row of each."""
    size = np.diff(off)
    count = np.maximum(1, -(-(size - (WINDOW - STRIDE)) // STRIDE))
    row = np.repeat(np.arange(len(size)), count)
    start = off[:-1][row] + STRIDE * tb.ragged(np.zeros(len(size), np.int64), count)
    return start, np.minimum(start + WINDOW, off[1:][row]), row


def window_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    at = start[:, None] + np.arange(WINDOW)
    return np.where(at < end[:, None], data[np.minimum(at, max(0, len(data) - 1))], 0).astype(np.uint8) if len(data) else np.zeros((len(start), WINDOW), np.uint8)


@lru_cache(4)
def _loaded(model: bytes) -> tuple[ByteNet, list]:
    net = pickle.loads(model)
    return net, net.tables()


def predict_column(column: pa.Array, model: bytes) -> tuple[list[str], np.ndarray]:
    net, tables = _loaded(model)
    data, off = tb.text_buffer(column)
    pred, score = [], []
    for i, j in tb.slices(off):
        own = off[i : j + 1] - off[i]
        buf = tb.LOWER[data[off[i] : off[j]]]
        start, end, row = windows(buf, own)
        total, weight = np.zeros((j - i, len(net.langs))), np.zeros(j - i)
        for k in range(0, len(start), 128):
            part = slice(k, k + 128)
            w = np.maximum(end[part] - start[part], 1).astype(float)
            np.add.at(total, row[part], net.probabilities(window_bytes(buf, start[part], end[part]), tables) * w[:, None])
            np.add.at(weight, row[part], w)
        total /= weight[:, None]
        best = total.argmax(axis=1)
        pred += [net.langs[b] for b in best]
        score.append(np.clip(total[np.arange(j - i), best], 0, 1))
    return pred, np.concatenate([np.zeros(0), *score])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> bytes | None:
    """The trained network, pickled; None without labelled rows. Reads the text and label of rows not held out."""
    rows = docs.filter((fold(id_col) != HELD_OUT) & F.col(lang_col).isNotNull() & has_letter(text_col))
    per = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    counts = {r["lang"]: r["n"] for r in per.collect()}  # a row per language, as the network's last layer has
    if not counts:
        return None
    langs, scale, each = sorted(counts), 1_000_000, max(LEAST_ROWS, sample_rows / len(counts))
    share = docs.sparkSession.createDataFrame([(lang, min(scale, int(scale * each / n) + 1)) for lang, n in counts.items()], "_lang string, _share long")
    chosen = rows.join(F.broadcast(share), F.col(lang_col) == F.col("_lang")).filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(scale)) < F.col("_share"))
    # windows at places drawn by hash over the whole text, at most WINDOW characters each
    cut = F.array(*[F.substr(F.col(text_col), (F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), F.greatest(F.length(text_col) - WINDOW + 1, F.lit(1))) + 1).cast("int"), F.lit(WINDOW)) for k in range(WINDOWS)])
    sample = chosen.select(F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"), F.array_distinct(cut).alias("cut")).orderBy("h", "lang").limit(3 * max(sample_rows, LEAST_ROWS * len(langs))).collect()
    r, x, y = np.random.Generator(np.random.PCG64(2)), [], []
    for row in sorted(sample, key=lambda s: (s["h"], s["lang"], s["cut"])):
        for k, text in enumerate(row["cut"]):
            b = np.frombuffer(text.encode()[:WINDOW], np.uint8)
            b = b[: int(r.integers(12, WINDOW + 1))] if k % 2 else b  # some windows are short, as the ends of texts
            if len(b):
                x.append(np.pad(tb.LOWER[b], (0, WINDOW - len(b))))
                y.append(langs.index(row["lang"]))
    return pickle.dumps(ByteNet(langs).fit(np.array(x, np.uint8), np.array(y)))


def _predict(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pred, score = predict_column(batch.column(1), model)
        letter = np.asarray(batch.column(2))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array([p if k else UND for p, k in zip(pred, letter, strict=True)], pa.string()), pa.array(np.where(letter, score, 0.0))], ["id", "held_out", "lang_pred", "score"])
    release()


def _keep(batches: Iterator[pa.RecordBatch], model: bytes, at: int, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(predict_column(batch.column(at), model)[1] >= least))
    release()


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score."""
    model = train(docs, id_col, text_col, lang_col, sample_rows)
    held = (fold(id_col) == HELD_OUT).alias("held_out")
    if model is None:
        return docs.select(id_col, held, F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), has_letter(text_col).alias("letter"), held)
    out = small_batches(rows).mapInArrow(partial(_predict, model=model), "id long, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def keep_known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_score: float | None = None) -> DataFrame:
    """The rows of docs whose text has a letter and a language predicted with at least least_score: if not given,
    1.2 times what chance gives with the learned languages, 0.3 at most, so that clean texts stay however many
    languages there are. With three languages or fewer no text with a letter falls below it."""
    model = train(docs, id_col, text_col, lang_col)
    if model is None:
        return docs.limit(0)
    least_score = min(0.3, 1.2 / len(_loaded(model)[0].langs)) if least_score is None else least_score
    rows = docs.filter(has_letter(text_col))
    return small_batches(rows).mapInArrow(partial(_keep, model=model, at=docs.columns.index(text_col), least=least_score), docs.schema)
