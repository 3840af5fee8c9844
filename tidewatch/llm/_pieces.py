"""Encoding whole texts by independent pieces: a vocabulary that never joins across some places is applied once to
each distinct piece between them, and the pieces' results are put together by array indexing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from . import _bytes as tb

#: Distinct pieces kept between batches; when there are more, the cache starts anew.
CACHE = 400_000
#: Bytes of text whose distinct pieces are looked up at once.
SLICE = 1 << 20
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True


def _before(buf: np.ndarray, back: int) -> np.ndarray:
    out = np.zeros(len(buf), np.uint8)
    out[back:] = buf[:-back] if back else buf
    return out


def cuts_at_white_space(buf: np.ndarray) -> np.ndarray:
    """Where a token begins whatever stands before and after: where ASCII white space begins a run (the byte before is ASCII other than white space and controls, or ends
    a character that is surely no white space), at a mark after a letter, and after a lone line feed."""
    p1, p2, p3 = (_before(buf, k) for k in (1, 2, 3))
    unsure = ((p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))) | ((p3 >= 0xE1) & (p3 <= 0xE3) & (p1 >= 0x80))
    cut = tb.WS[buf] & (p1 > 0x20) & ~unsure
    # a mark after a letter (ASCII or U+00C0 to U+00FF), and a character after a lone line feed, begin a token too
    letter = ((p1 | 0x20) >= 0x61) & ((p1 | 0x20) <= 0x7A) | (p2 == 0xC3) & (p1 >= 0x80) & (p1 != 0x97) & (p1 != 0xB7)
    lone = np.zeros(len(buf), bool)
    lone[1:] = cut[:-1] & (p1[1:] == 0x0A) & (buf[1:] > 0x20) & (buf[1:] < 0x7F)
    return cut | (_MARK[buf] & letter) | lone


def cuts_at_spaces(buf: np.ndarray) -> np.ndarray:
    """Where a space begins a run of spaces and of the visible space mark U+2581."""
    p1, p3 = _before(buf, 1), _before(buf, 3)
    return (buf == 0x20) & (p1 != 0x20) & (p3 != 0xE2)


def joined(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.uint32, int(lens.sum())), lens


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct value, and the number of each row's value."""
    order = h.argsort()
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    inverse = np.empty(len(h), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return np.compress(new, order), inverse


class PieceCache:
    """encode: distinct pieces -> all their ids, and how many each has."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], cuts: Callable[[np.ndarray], np.ndarray], lead: bytes = b"", limit: int = CACHE):
        self.encode, self.cuts, self.lead, self.limit = encode, cuts, lead, limit
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.offs, self.lens = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _add(self, pieces: list[bytes]) -> None:
        ids, lens = self.encode(pieces)
        k, n, total = len(self.at), len(pieces), len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while k + n > len(self.offs):
            self.offs, self.lens = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offs, self.lens))
        self.flat[self.used : self.used + total] = ids
        self.lens[k : k + n] = lens
        self.offs[k : k + n] = self.used + np.cumsum(lens) - lens
        self.used += total
        self.at.update(zip(pieces, range(k, k + n), strict=True))

    def batches(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each slice of rows: the numbers of their pieces, and where each row's pieces begin (and the end)."""
        data, off = tb.text_buffer(column)
        for i, j in tb.slices(off, SLICE):
            buf, own = data[off[i] : off[j]], off[i : j + 1] - off[i]
            if self.lead:
                n = len(self.lead)
                buf = np.insert(buf, np.repeat(own[:-1], n), np.tile(np.frombuffer(self.lead, np.uint8), j - i))
                own = own + n * np.arange(j - i + 1)
            if len(self.at) > self.limit:
                self.clear()
            if not len(buf):
                yield np.zeros(0, np.int64), np.zeros(j - i + 1, np.int64)
                continue
            cut = self.cuts(buf)
            cut[own[:-1][own[:-1] < len(buf)]] = True
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], len(buf))
            first, inverse = distinct(tb.segment_hash(buf, starts, ends))
            raw = buf.tobytes()
            pieces = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            number = np.fromiter((self.at.get(p, -1) for p in pieces), np.int64, len(pieces))
            if len(new := np.flatnonzero(number < 0)):
                missing = [pieces[k] for k in new.tolist()]
                self._add(list(dict.fromkeys(missing)))
                number[new] = [self.at[p] for p in missing]
            yield number[inverse], np.searchsorted(starts, own)

    def slices(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each slice of rows: all their ids, and where each row's ids begin (and the end)."""
        for number, rows in self.batches(column):
            lens = self.lens[number]
            yield self.flat[tb.ragged(self.offs[number], lens)], np.concatenate([[0], np.cumsum(lens)])[rows]

    def ids(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each row."""
        for flat, ends in self.slices(column):
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                yield flat[a:b]
