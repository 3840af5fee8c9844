"""SentencePiece encoding and decoding for merge-type vocabularies, by a score-ordered agenda of adjacent pairs.

The agenda holds every adjacent pair of symbols whose joined piece is in the vocabulary, best score first and
leftmost first among equals; the best valid pair is joined and its new neighbours enter. Words of equal length keep
their agendas as the rows of one array, and all of them take their best pair at once; long words have a heap each.
Characters that remain outside the vocabulary become byte pieces. No piece crosses from another character to a space
mark, so a text is encoded by its space-led words, each distinct word once; every word that enters the cache is
checked against the sentencepiece library, and a difference raises an error.

Defined cases: null and empty texts have the end id alone and decode to the empty text; leading, trailing and
repeated spaces are kept, as the vocabulary's normaliser keeps them; a literal U+2581 decodes to a space; further
columns are ignored by the decisions.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as tb
from ._common import release, small_batches
from ._pieces import PieceCache, cuts_at_spaces, joined

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: Words longer than this have a heap, and are first split between characters that stand side by side in no piece.
LONG = 64
#: Distinct words that a worker keeps: some 20 MB.
CACHE = 100_000
NEVER = np.iinfo(np.int32).max


def _table(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte strings as one array, their offsets and lengths."""
    lens = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.frombuffer(b"".join(rows), np.uint8), np.cumsum(lens) - lens, lens


class Agenda:
    """The vocabulary, and the agendas over words. A symbol is a piece's id, or UNKNOWN plus the code point of a
    character that is no piece itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end = sp.eos_id()
        every = range(sp.get_piece_size())
        self.pieces = [sp.id_to_piece(i) for i in every]
        self.byte = {int(self.pieces[i][3:5], 16): i for i in every if sp.is_byte(i)}
        of_byte = {i: b for b, i in self.byte.items()}
        plain = [i for i in every if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.id = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.joined = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        #: What an id stands for in the decoded text, space marks as spaces, and how it is written.
        self.text = _table([bytes([of_byte[i]]) if i in of_byte else b"" if i == self.end else self.pieces[i].replace(MARK, " ").encode() for i in every])
        self.written = _table([b" %d" % i for i in every])

        self.unknown = len(self.pieces)
        self.symbol = np.arange(0x110000, dtype=np.int64) + self.unknown
        for p, i in self.id.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        rank = {s: k for k, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        place = lambda p: self.id.get(p, int(self.symbol[ord(p)]) if len(p) == 1 else -1)
        pairs = {}
        for p, i in self.id.items():
            for k in range(1, len(p)):
                if (a := place(p[:k])) >= 0 and (b := place(p[k:])) >= 0:
                    pairs[a << 32 | b] = (rank[self.score[p]], i)
        self.pair = np.array(sorted(pairs), np.int64)
        self.pair_rank, self.pair_id = (np.array([pairs[k][n] for k in self.pair.tolist()], np.int32) for n in (0, 1))

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the piece that each pair of symbols makes; NEVER if none."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = self.pair[at] == key
        return np.where(hit, self.pair_rank[at], NEVER), self.pair_id[at]

    def _rows(self, m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of one length as rows of symbols -> (rows, their last symbols), as the rows' agendas run dry."""
        at = np.arange(len(m))
        rank, made = self._look(m[:, :-1], m[:, 1:])
        while m.shape[1] > 1:
            k, own = rank.argmin(axis=1), np.arange(len(m))
            dry = rank[own, k] == NEVER
            if dry.any():
                yield at[dry], m[dry]
                live = ~dry
                at, m, rank, made, k = at[live], m[live], rank[live], made[live], k[live]
                own = np.arange(len(m))
            if not len(m):
                return
            new, width = made[own, k], m.shape[1] - 1
            col = np.arange(width)
            m = np.take_along_axis(m, col + (col > k[:, None]), 1)
            m[own, k] = new
            src = col[:-1] + (col[:-1] >= k[:, None])
            rank, made = np.take_along_axis(rank, src, 1), np.take_along_axis(made, src, 1)
            for rows, pair in ((np.flatnonzero(k > 0), k - 1), (np.flatnonzero(k < width - 1), k)):  # the new neighbours
                p = pair[rows]
                rank[rows, p], made[rows, p] = self._look(m[rows, p], m[rows, p + 1])
        yield at, m

    def word(self, text: str) -> list[int]:
        """The symbols of one word by a heap."""
        if len(text) > LONG:
            cut = [0, *(k for k in range(1, len(text)) if text[k - 1 : k + 1] not in self.joined), len(text)]
            return [i for a, b in zip(cut, cut[1:], strict=False) for i in self._word(text[a:b])]
        return self._word(text)

    def _word(self, text: str) -> list[int]:
        score, symbol = self.score, list(text)
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for k in range(n - 1):
            s = score.get(symbol[k] + symbol[k + 1])
            if s is not None:
                agenda.append((-s, k, k + 1, symbol[k] + symbol[k + 1]))
        heapq.heapify(agenda)
        while agenda:
            _, a, b, piece = heapq.heappop(agenda)
            if not symbol[a] or not symbol[b] or symbol[a] + symbol[b] != piece:
                continue  # one of the two has been joined since
            symbol[a], symbol[b] = piece, ""
            c = after[a] = after[b]
            if c < n:
                before[c] = a
                s = score.get(piece + symbol[c])
                if s is not None:
                    heapq.heappush(agenda, (-s, a, c, piece + symbol[c]))
            z = before[a]
            if z >= 0:
                s = score.get(symbol[z] + piece)
                if s is not None:
                    heapq.heappush(agenda, (-s, z, a, symbol[z] + piece))
        return [self.id[p] if p in self.id else int(self.symbol[ord(p)]) for p in symbol if p]

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All symbols of the words, and how many each has."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = self.symbol[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
        start, parts = np.cumsum(size) - size, []
        for n in np.unique(size).tolist():
            rows = np.flatnonzero(size == n)
            if n > LONG:
                parts += [(np.array([r]), np.array([self.word(texts[r])])) for r in rows.tolist()]
            else:
                parts += [(rows[at], m) for at, m in self._rows(flat[start[rows][:, None] + np.arange(n)])]
        lens = np.zeros(len(texts), np.int64)
        for rows, m in parts:
            lens[rows] = m.shape[1]
        out, start = np.zeros(int(lens.sum()), np.int64), np.cumsum(lens) - lens
        for rows, m in parts:
            out[start[rows][:, None] + np.arange(m.shape[1])] = m
        return out, lens

    def words(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of space-led words, checked against the library (which puts the leading mark itself)."""
        texts = b"\0".join(pieces).decode().split("\0") if not any(b"\0" in p for p in pieces) else [p.decode() for p in pieces]
        flat, lens = self.symbols([t.replace(" ", MARK) for t in texts])
        if (odd := flat >= self.unknown).any():  # characters without a piece, byte by byte
            code, which = np.unique(flat[odd], return_inverse=True)
            ids, n = joined([[self.byte[x] for x in chr(c - self.unknown).encode()] for c in code.tolist()])
            each = np.ones(len(flat), np.int64)
            each[odd] = n[which]
            lens = np.add.reduceat(each, np.cumsum(lens) - lens)
            wide = np.repeat(flat, each)
            wide[np.repeat(odd, each)] = ids[tb.ragged((np.cumsum(n) - n)[which], n[which])]
            flat = wide
        theirs = self.library.encode([t[1:] for t in texts], num_threads=1)
        if " " in texts:
            theirs[texts.index(" ")] = [self.id[MARK]]
        if not (np.array_equal(np.fromiter(map(len, theirs), np.int64, len(theirs)), lens) and np.array_equal(np.fromiter(chain.from_iterable(theirs), np.int64), flat)):
            cut = np.split(flat, np.cumsum(lens)[:-1])
            raise ValueError(f"the agenda and the library differ on {next(t for t, a, b in zip(texts, cut, theirs, strict=True) if a.tolist() != b)[:80]!r}")
        return flat.astype(np.uint32), lens

    def spell(self, table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The ids' entries in a table, put together, and the end of each."""
        data, off, lens = table
        own = lens[ids]
        return data[tb.ragged(off[ids], own)].tobytes(), np.cumsum(own)

    def decode(self, ids: list[int]) -> str:
        """What ids stand for, without the leading space."""
        return self.spell(self.text, np.array(ids, np.int64))[0][1:].decode("utf-8", "replace") if ids else ""


@lru_cache(1)
def _codec(path: str) -> tuple[Agenda, PieceCache]:
    agenda = Agenda(path)
    return agenda, PieceCache(agenda.words, cuts_at_spaces, b" ", limit=CACHE)


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    agenda, cache = _codec(path)
    end, mark = b"%d" % agenda.end, agenda.id[MARK]
    for batch in batches:
        n, ids, text = [], [], []
        for flat, rows in cache.slices(batch.column(1)):
            (written, w), (decoded, d) = agenda.spell(agenda.written, flat), agenda.spell(agenda.text, flat)
            w, d = (np.concatenate([[0], x])[rows].tolist() for x in (w, d))
            for k, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
                if b - a == 1 and flat[a] == mark:  # nothing but the leading space: no text
                    b = a
                n.append(b - a + 1)
                ids.append(hashlib.sha256(written[w[k] + 1 : w[k + 1]] + b" " + end if b > a else end).hexdigest())
                text.append(hashlib.sha256(decoded[d[k] + 1 : d[k + 1]].decode("utf-8", "replace").encode() if b > a else b"").hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
    cache.clear()
    release()


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    agenda, cache = _codec(path)
    for batch in batches:
        out = [[] if len(x) == 1 and agenda.pieces[int(x[0])] == MARK else x.tolist() for x in cache.ids(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[*x, agenda.end] for x in out], pa.list_(pa.int32()))], ["id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    agenda, _ = _codec(path)
    for batch in batches:
        out = [agenda.decode(ids or []) for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "text"])


def sp_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>) of every row, the end id last."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return small_batches(rows).mapInArrow(partial(_encode, path=path or public_tokenizers.path(MODEL)), "id long, ids array<int>").withColumnRenamed("id", id_col)


def sp_decode(encoded: DataFrame, id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """(id, text) of ``sp_encode``'s rows."""
    rows = encoded.select(F.col(id_col).cast("long").alias("id"), "ids")
    return small_batches(rows).mapInArrow(partial(_decode, path=path or public_tokenizers.path(MODEL)), "id long, text string").withColumnRenamed("id", id_col)


def sp_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row, encoded and decoded in one pass."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return small_batches(rows).mapInArrow(partial(_digests, path=path or public_tokenizers.path(MODEL)), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
