"""Text columns of Arrow batches as byte arrays: slices, hashes of segments, pieces at white space."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer document makes a slice of its own.
SLICE = 2 << 20
BLOCK = 1 << 19
WS = np.zeros(256, bool)
WS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_state: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    if not _state:
        _state["byte"] = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for name, base in (("pow", _BASE), ("inv", _INVERSE)):
            a = np.full(BLOCK, base, np.uint64)
            a[0] = 1
            _state[name] = np.multiply.accumulate(a)
    return _state


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty, and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    column = pc.fill_null(column, "") if column.null_count else column
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)), off - off[0]


def slices(off: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or of one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def segment_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each segment's bytes; segments are ascending and don't overlap."""
    t, out, i, n = _tables(), np.empty(len(starts), np.uint64), 0, len(starts)
    while i < n:
        lo = int(starts[i])
        j = int(np.searchsorted(ends, lo + BLOCK, "right"))
        if j <= i:  # one segment longer than a block
            out[i] = int.from_bytes(hashlib.blake2b(buf[lo : int(ends[i])].tobytes(), digest_size=8).digest(), "little")
            i += 1
            continue
        hi = int(ends[j - 1])
        run = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(t["byte"][buf[lo:hi]] * t["pow"][: hi - lo], out=run[1:])
        s = starts[i:j] - lo
        out[i:j] = (run[ends[i:j] - lo] - run[s]) * t["inv"][s]
        i = j
    return mix64(out ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of other than ASCII white space), and each row's first word."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = ~WS[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    starts = w.copy()
    starts[1:] &= ~w[:-1] | edge[1:-1]
    ends = w.copy()
    ends[:-1] &= ~w[1:] | edge[1:-1]
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(s, off)


def ragged(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [offset, offset + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(offsets - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
