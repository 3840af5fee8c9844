"""Token-ID output as wavelet matrices: one compressed file per shard, with access, rank, select and counting.

``write_shards`` encodes documents, sorts them by id into ranges and writes each range as one or more files of a
bounded number of tokens; ``read_documents`` reads the files back. A file holds the bit-planes of its tokens'
wavelet matrix in blocks that are compressed each on its own, the directory of ranks before every block and every 512
bits inside it, and its documents' ids and lengths. ``WaveletFile`` answers access, rank, count and select from the
open file: it reads the directory once, and then one block for each plane that a step touches. A file is written under
a temporary name, then renamed; names and contents depend on the rows alone, so a repeated task writes the same file
again.

Defined cases: null and empty texts have the end id alone; null ids come first; rows that share an id follow each
other in the order of their text; an empty table writes no file and reads back no row.
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import id_bounds, id_bucket, materialize, new_path, shuffle_parts, small_batches
from ._pieces import PieceCache, cuts_at_white_space, joined

VOCAB = "byte_bpe_50k.json"
END_ID = 0
#: A file is closed once it has this many tokens (its last document is kept whole).
SHARD_TOKENS = 1 << 21
#: Bits of a block, and of a step of the directory inside it.
BLOCK_BITS, RANK_STEP = 1 << 15, 512
#: Distinct pieces of text whose ids a worker keeps: some 200 MB.
CACHE = 1_000_000
#: A word of ASCII letters and letters of U+00C0 to U+00FF, perhaps after a space.
WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
MAGIC = b"WVM2"
#: Blocks that an open file keeps.
BLOCKS_KEPT = 256


def planes_of(ids: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """Bit-planes from the highest bit down, and the zeros of each: at each plane, the tokens with a 0 come before
    those with a 1."""
    levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    seq, planes, zeros = ids.astype(np.uint16 if levels <= 16 else np.uint32), [], []
    for level in range(levels - 1, -1, -1):
        bit = (seq & seq.dtype.type(1 << level)) != 0
        planes.append(np.packbits(bit, bitorder="little"))
        low = np.compress(~bit, seq)  # far faster than indexing by bit
        zeros.append(len(low))
        seq = np.concatenate([low, np.compress(bit, seq)])
    return planes, zeros


def to_bytes(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """A file: magic, the lengths of head and directory, head (JSON), directory, blocks. The directory has the
    documents, the end of every compressed block, the ones before every block in its plane, and the ones of the block
    before each of its steps."""
    planes, zeros = planes_of(ids)
    step, block = RANK_STEP // 8, BLOCK_BITS // 8
    pack, bodies, before, steps = zstandard.ZstdCompressor(level=1), [], [], []
    for plane in planes:
        blocks = -(-len(plane) // block)
        padded = np.zeros(blocks * block, np.uint8)
        padded[: len(plane)] = plane
        ones = np.bitwise_count(padded.reshape(blocks, BLOCK_BITS // RANK_STEP, step)).sum(axis=2, dtype=np.int64)
        inside = np.cumsum(ones, axis=1)
        total = inside[:, -1]
        before.append(np.cumsum(total) - total)
        steps.append((inside - ones).astype("<u2"))
        bodies += [pack.compress(padded[i * block : (i + 1) * block].tobytes()) for i in range(blocks)]
    docs = [np.array([x is not None for x in doc_ids], np.uint8), np.array([x or 0 for x in doc_ids], "<i8"), np.array(lengths, "<i8")]
    ends = np.cumsum([len(b) for b in bodies], dtype=np.int64)
    directory = zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in [*docs, ends.astype("<i8"), *[b.astype("<i8") for b in before], *steps]))
    head = json.dumps({"length": len(ids), "zeros": zeros, "docs": len(lengths)}).encode()
    return MAGIC + struct.pack("<QQ", len(head), len(directory)) + head + directory + b"".join(bodies)


class WaveletFile:
    """An open file of ``to_bytes``; f: anything with seek and read. blocks_read counts the blocks decompressed."""

    def __init__(self, f):
        self.f = f
        f.seek(0)
        start = f.read(20)
        if start[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        n_head, n_directory = struct.unpack("<QQ", start[4:])
        head = json.loads(f.read(n_head))
        self.length, self.zeros, docs = head["length"], head["zeros"], head["docs"]
        self.levels, self.body = len(self.zeros), 20 + n_head + n_directory
        self.blocks = -(-self.length // BLOCK_BITS)
        raw, at = zstandard.ZstdDecompressor().decompress(f.read(n_directory)), 0

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        known, ids, self.lengths = take("u1", docs), take("<i8", docs), take("<i8", docs)
        self.doc_ids = [x if k else None for x, k in zip(ids.tolist(), known.tolist(), strict=True)]
        self.ends = take("<i8", self.levels * self.blocks)
        self.before = take("<i8", self.levels * self.blocks).reshape(self.levels, self.blocks)
        self.steps = take("<u2", self.levels * self.blocks * (BLOCK_BITS // RANK_STEP)).reshape(self.levels, self.blocks, BLOCK_BITS // RANK_STEP)
        self.kept: OrderedDict[int, np.ndarray] = OrderedDict()
        self.unpack, self.blocks_read = zstandard.ZstdDecompressor(), 0

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletFile:
        return cls(io.BytesIO(data))

    def _block(self, level: int, block: int) -> np.ndarray:
        n = level * self.blocks + block
        if n in self.kept:
            self.kept.move_to_end(n)
            return self.kept[n]
        start = int(self.ends[n - 1]) if n else 0
        self.f.seek(self.body + start)
        out = np.frombuffer(self.unpack.decompress(self.f.read(int(self.ends[n]) - start)), np.uint8)
        self.blocks_read += 1
        self.kept[n] = out
        if len(self.kept) > BLOCKS_KEPT:
            self.kept.popitem(last=False)
        return out

    def decode(self) -> np.ndarray:
        """All tokens, from the lowest plane up: each plane puts its zeros and ones back in place."""
        seq = np.zeros(self.length, np.uint16 if self.levels <= 16 else np.uint32)
        self.f.seek(self.body)
        body, starts = self.f.read(int(self.ends[-1]) if len(self.ends) else 0), [0, *self.ends.tolist()]
        for n in range(self.levels - 1, -1, -1):
            own = range(n * self.blocks, (n + 1) * self.blocks)
            plane = b"".join(self.unpack.decompress(body[starts[i] : starts[i + 1]]) for i in own)
            bit = np.unpackbits(np.frombuffer(plane, np.uint8), count=self.length, bitorder="little").view(bool)
            up, z = np.empty_like(seq), self.zeros[n]
            up[np.flatnonzero(~bit)] = seq[:z]
            up[np.flatnonzero(bit)] = seq[z:] | seq.dtype.type(1 << (self.levels - 1 - n))
            seq = up
        return seq

    def _bit_and_rank(self, level: int, at: int) -> tuple[int, int]:
        """The bit at a position of a plane and the ones before it: block, step, then at most 64 bytes."""
        block, inside = divmod(at, BLOCK_BITS)
        bits, step = self._block(level, block), inside // RANK_STEP
        first, last = step * (RANK_STEP // 8), inside // 8
        rank = int(self.before[level, block]) + int(self.steps[level, block, step]) + int(np.bitwise_count(bits[first:last]).sum())
        own = int(bits[last])
        return own >> (inside & 7) & 1, rank + (own & ((1 << (inside & 7)) - 1)).bit_count()

    def _rank1(self, level: int, at: int) -> int:
        return self.length - self.zeros[level] if at == self.length else self._bit_and_rank(level, at)[1]

    def access(self, at: int) -> int:
        if not 0 <= at < self.length:
            raise IndexError(f"no token {at}")
        out = 0
        for level in range(self.levels):
            one, rank = self._bit_and_rank(level, at)
            out = out << 1 | one
            at = self.zeros[level] + rank if one else at - rank
        return out

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """The places of a token's occurrences before end, in the order below the last plane."""
        a, b = 0, end
        if token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            ra, rb = self._rank1(level, a), self._rank1(level, b)
            a, b = (self.zeros[level] + ra, self.zeros[level] + rb) if token >> self.levels - 1 - level & 1 else (a - ra, b - rb)
        return a, b

    def rank(self, token: int, end: int) -> int:
        a, b = self._range(token, end)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.length)

    def _select(self, level: int, one: int, k: int) -> int:
        """The position of the k-th (from 0) bit of a kind in a plane: block, then step, then the bits of one step."""
        seen = self.before[level] if one else np.arange(self.blocks) * BLOCK_BITS - self.before[level]
        block = int(np.searchsorted(seen, k, "right")) - 1
        k -= int(seen[block])
        seen = self.steps[level, block].astype(np.int64)
        seen = seen if one else np.arange(len(seen)) * RANK_STEP - seen
        step = int(np.searchsorted(seen, k, "right")) - 1
        first = step * (RANK_STEP // 8)
        bits = np.unpackbits(self._block(level, block)[first : first + RANK_STEP // 8], bitorder="little")
        return block * BLOCK_BITS + step * RANK_STEP + int(np.flatnonzero(bits == one)[k - int(seen[step])])

    def select(self, token: int, k: int) -> int:
        """The position of occurrence k (from 0): down to the token's place below the last plane, and up again."""
        a, b = self._range(token, self.length)
        if not 0 <= k < b - a:
            raise IndexError(f"token {token} has no occurrence {k}")
        at = a + k
        for level in range(self.levels - 1, -1, -1):
            one = token >> self.levels - 1 - level & 1
            at = self._select(level, one, at - self.zeros[level] if one else at)
        return at


def byte_marks() -> dict[int, str]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, the others as U+0100 and on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + other.index(b)) for b in range(256)}


@lru_cache(1)
def _cache(path: str) -> PieceCache:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, mark = tokenizer.model, byte_marks()

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A piece of letters, with a space before them or without, is one pre-token whatever stands around it: it
        goes to the library's model at once, all others through the whole tokenizer."""
        rest = [p.decode() for p in pieces if not WORD.fullmatch(p)]
        others = iter(tokenizer.encode_batch_fast(rest, add_special_tokens=False))
        return joined([[t.id for t in model.tokenize(p.decode("latin-1").translate(mark))] if WORD.fullmatch(p) else next(others).ids for p in pieces])

    return PieceCache(encode, cuts_at_white_space, limit=CACHE)


def _save(root: str, name: str, data: bytes) -> str:
    """Writes under a temporary name in the shared folder, then renames: readers see whole files only."""
    fs, base = pafs.FileSystem.from_uri(root)
    fs.create_dir(base, recursive=True)
    temporary = f"{base}/_{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as out:
        out.write(data)
    fs.move(temporary, f"{base}/{name}")
    return name


def _write(batches: Iterator[pa.RecordBatch], root: str, path: str, end_id: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, id, text) in order -> one row per file."""
    cache, bucket, seq = _cache(path), None, 0
    ids: list[int | None] = []
    tokens: list[np.ndarray] = []
    end, size = np.array([end_id], np.uint32), 0

    def close() -> pa.RecordBatch:
        nonlocal ids, tokens, size, seq
        name = f"ids-{bucket:06d}-{seq:06d}.wvm"
        data = to_bytes(np.concatenate(tokens), ids, [len(x) for x in tokens])
        row = [[bucket], [seq], [_save(root, name, data)], [len(ids)], [size], [len(data)]]
        ids, tokens, size, seq = [], [], 0, seq + 1
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 2 else pa.int64()) for k, c in enumerate(row)], ["bucket", "seq", "name", "docs", "tokens", "bytes"])

    for batch in batches:
        for b, i, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), cache.ids(batch.column(2)), strict=True):
            if ids and (b != bucket or size >= most):
                yield close()
            if b != bucket:
                bucket, seq = b, 0
            ids.append(i)
            tokens.append(np.concatenate([found, end]))
            size += len(tokens[-1])
    if ids:
        yield close()


def write_shards(docs: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the files under root and returns their manifest: bucket, seq, name, docs, tokens, bytes."""
    parts = shuffle_parts(docs.sparkSession)
    bounds = id_bounds(docs, id_col, parts)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("bucket", id_bucket(F.col("id"), bounds).cast("long"))
    rows = rows.repartitionById(len(bounds) + 1, F.col("bucket").cast("int")).sortWithinPartitions("bucket", F.col("id").asc_nulls_first(), "text")
    job = partial(_write, root=root, path=path or public_tokenizers.path(VOCAB), end_id=end_id, most=shard_tokens)
    return materialize(small_batches(rows.select("bucket", "id", "text")).mapInArrow(job, "bucket long, seq long, name string, docs long, tokens long, bytes long"), "wavelet-manifest")


def open_shard(root: str, name: str) -> WaveletFile:
    """A file to be read in place; close it by its f."""
    fs, base = pafs.FileSystem.from_uri(root)
    return WaveletFile(fs.open_input_file(f"{base}/{name}"))


def _read(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shard = open_shard(root, name)
            tokens = shard.decode().astype("<u4")
            shard.f.close()
            ids, lengths = shard.doc_ids, shard.lengths
            at = np.concatenate([[0], np.cumsum(lengths)])
            crc = [zlib.crc32(tokens[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at[:-1] + start, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, manifest: DataFrame, root: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files that the manifest names."""
    order = Window.orderBy("bucket", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.select("name", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("start"))
    spread = files.repartition(shuffle_parts(spark), "name")
    return spread.mapInArrow(partial(_read, root=root), "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def tokens_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    root = new_path(docs.sparkSession, "wavelet")
    return read_documents(docs.sparkSession, write_shards(docs, root, id_col, text_col), root, id_col)
