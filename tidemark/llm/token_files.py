"""Token-id files: one wavelet matrix for each shard.

A file holds the ids of consecutive documents (ascending doc_id) as bit-planes, highest bit first.  Each plane is stored
in blocks of 2**16 bits (lowest bit of a byte first), each with a small directory (ones before each 512 bits, u16) and
compressed one by one, with the number of ones before each block in the header, so that access, rank and select touch a
block or two of a plane and count the bits of one 512-bit word.  Layout, little-endian:

    8 bytes "TMWAVE02" | u64 tokens | u64 documents | u64 planes | u64 header length | header | blocks

The header (zstd) has doc_id i64[documents], end u64[documents], zeros u64[planes], ones before each block
u64[planes x blocks], block offsets u64[planes x blocks + 1] and null u8[documents] (1: the document has no id).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, ship, shuffle_partitions, slices, stored, table
from .units import encoder

MAGIC, BLOCK, WORD = b"TMWAVE02", 1 << 16, 512


def _bits(raw: bytes, n: int) -> pa.Array:
    return pa.Array.from_buffers(pa.bool_(), n, [None, pa.py_buffer(raw)])


def _directory(part: np.ndarray) -> np.ndarray:
    """Ones before each word of a block (whole words), and all of them."""
    return np.concatenate([[0], np.cumsum(np.bitwise_count(part).reshape(-1, WORD // 8).sum(axis=1, dtype=np.int64))])


def write_file(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, planes: int | None = None, null: np.ndarray | None = None) -> bytes:
    """One file; ids of all documents one after another.  As many planes as the largest id needs, unless given."""
    n = len(ids)
    need = max(1, int(ids.max()).bit_length()) if n else 1
    planes = need if planes is None else planes
    if planes < need:
        raise ValueError(f"token ids need {need} bits")
    a = pa.array(ids.astype(np.uint16 if planes <= 16 else np.uint32))
    blocks, zeros, before = [], [], []
    pack = zstandard.ZstdCompressor(level=1)
    for k in range(planes - 1, -1, -1):
        values = a.to_numpy()
        raw = np.packbits((values & values.dtype.type(1 << k)) != 0, bitorder="little")
        whole = np.zeros(-(-len(raw) // (WORD // 8)) * (WORD // 8), np.uint8)
        whole[: len(raw)] = raw
        count = 0
        for i in range(0, len(raw), BLOCK // 8):
            part = whole[i : i + BLOCK // 8]
            small = _directory(part)
            before.append(count)
            count += int(small[-1])
            blocks.append(pack.compress(part.tobytes() + small[:-1].astype("<u2").tobytes()))
        zeros.append(n - count)
        if k:
            one = _bits(raw.tobytes(), n)
            a = pa.concat_arrays([a.filter(pc.invert(one)), a.filter(one)])
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    null = np.zeros(len(doc_ids), np.uint8) if null is None else null
    header = pack.compress(b"".join(np.asarray(x, dtype=t).tobytes() for x, t in ((doc_ids, "<i8"), (np.cumsum(lengths), "<u8"), (zeros, "<u8"), (before, "<u8"), (offsets, "<u8"), (null, "u1"))))
    return b"".join([MAGIC, struct.pack("<4Q", n, len(doc_ids), planes, len(header)), header, *blocks])


class WaveletFile:
    """Reads a file from bytes: access, rank, select, occurrences of an id, and whole documents."""

    def __init__(self, blob: bytes):
        if blob[:8] != MAGIC:
            raise ValueError("not a token-id file")
        self.n, docs, planes, size = struct.unpack("<4Q", blob[8:40])
        head = zstandard.ZstdDecompressor().decompress(blob[40 : 40 + size])
        self.per_plane = -(-self.n // BLOCK)
        at = 0

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            first = at
            at += np.dtype(kind).itemsize * count
            return np.frombuffer(head, kind, count, first)

        self.doc_ids, self.ends, self.zeros = take("<i8", docs), take("<u8", docs), take("<u8", planes)
        self.before = take("<u8", planes * self.per_plane).reshape(planes, self.per_plane)
        self.offsets = take("<u8", planes * self.per_plane + 1)
        self.null = take("u1", docs)
        self.base, self.blob, self.planes = 40 + size, blob, planes
        self._open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _block(self, plane: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and directory of one block, with a few blocks kept open."""
        k = plane * self.per_plane + block
        if k not in self._open:
            if len(self._open) > 64:
                self._open.clear()
            raw = zstandard.ZstdDecompressor().decompress(self.blob[self.base + int(self.offsets[k]) : self.base + int(self.offsets[k + 1])])
            words = len(raw) // (WORD // 8 + 2)
            self._open[k] = np.frombuffer(raw, np.uint8, words * (WORD // 8)), np.frombuffer(raw, "<u2", words, words * (WORD // 8))
        return self._open[k]

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, rest = divmod(i, BLOCK)
        if block == self.per_plane:
            return self.n - int(self.zeros[plane])
        if not rest:
            return int(self.before[plane, block])
        data, small = self._block(plane, block)
        word = (rest - 1) // WORD
        full, odd = divmod(rest, 8)
        ones = int(np.bitwise_count(data[word * (WORD // 8) : full]).sum()) + (int(data[full] & ((1 << odd) - 1)).bit_count() if odd else 0)
        return int(self.before[plane, block]) + int(small[word]) + ones

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.planes):
            bit, ones = int(self._block(p, i // BLOCK)[0][i % BLOCK // 8]) >> (i % 8) & 1, self._rank1(p, i)
            value = value << 1 | bit
            i = int(self.zeros[p]) + ones if bit else i - ones
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Start of the token's run in the last order, and its rank among the first i ids plus that start."""
        lo, hi = 0, i
        for p in range(self.planes):
            a, b = self._rank1(p, lo), self._rank1(p, hi)
            lo, hi = (int(self.zeros[p]) + a, int(self.zeros[p]) + b) if token >> (self.planes - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """How often token stands among the first i ids."""
        if not 0 <= token < 1 << self.planes:
            return 0
        lo, hi = self._range(token, min(max(i, 0), self.n))
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane."""
        ones = self.before[plane].astype(np.int64)
        before = ones if bit else np.arange(self.per_plane, dtype=np.int64) * BLOCK - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        data, small = self._block(plane, block)
        k -= int(before[block])
        small = small.astype(np.int64) if bit else np.arange(len(small), dtype=np.int64) * WORD - small
        word = int(np.searchsorted(small, k, side="right")) - 1
        bits = np.unpackbits(data[word * (WORD // 8) : (word + 1) * (WORD // 8)], bitorder="little")
        return block * BLOCK + word * WORD + int(np.flatnonzero(bits == bit)[k - int(small[word])])

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, self.n)[0] + k
        for p in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - p) & 1
            i = self._select_bit(p, bit, i - int(self.zeros[p]) if bit else i)
        return i

    def occurrences(self, token: int) -> Iterator[int]:
        return (self.select(token, k) for k in range(self.count(token)))

    def ids(self) -> np.ndarray:
        """All ids: the partition of each plane is undone, last plane first."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        value = np.zeros(self.n, kind)
        unpack, data = zstandard.ZstdDecompressor(), memoryview(self.blob)
        for p in range(self.planes - 1, -1, -1):
            parts = []
            for k in range(p * self.per_plane, (p + 1) * self.per_plane):
                raw = unpack.decompress(data[self.base + int(self.offsets[k]) : self.base + int(self.offsets[k + 1])])
                parts.append(memoryview(raw)[: len(raw) // (WORD // 8 + 2) * (WORD // 8)])
            one = np.unpackbits(np.frombuffer(b"".join(parts), np.uint8), count=self.n, bitorder="little").view(bool)
            z, back = int(self.zeros[p]), np.empty(self.n, kind)
            back[np.flatnonzero(~one)], back[np.flatnonzero(one)] = value[:z], value[z:] | kind(1 << (self.planes - 1 - p))
            value = back
        return value


SLICE = 12_000_000  # bytes of text that are encoded at once
FILES = "part int, shard int, first long, n_tokens long, n_documents long, file binary"
READ = "part int, doc_id long, start_in_part long, n_tokens long, ids_crc32 long"


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, shard_tokens: int = 1 << 22, drops_space: bool = False) -> DataFrame:
    """Rows (part, shard, first, n_tokens, n_documents, file) of files over documents in ascending doc_id order.

    Files are made of one range partition each, in order (part, shard); `first` counts the part's ids before the file.
    Null texts count as empty; a document is never cut, so a file has under shard_tokens ids plus one document's.
    Rows of equal doc_id are all written, one after another; a null doc_id stands first and stays null.  An empty table
    gives no file.  Other columns of docs are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = rows.repartitionByRange(max(1, shuffle_partitions(docs.sparkSession)), "doc_id").sortWithinPartitions("doc_id")

    def write(batches):
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(tokenizer_path, drops_space)
        planes = max(1, (max(enc.tokenizer.get_vocab_size(), int(end_id) + 1) - 1).bit_length())
        schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("n_documents", pa.int64()), ("file", pa.binary())])
        last, shard, first = np.array([end_id], np.uint32), 0, 0
        held: list[np.ndarray] = []
        sizes: list[int] = []
        names: list[int | None] = []

        def out():
            data = np.concatenate(held)
            ids = np.array([0 if x is None else x for x in names], np.int64)
            blob = write_file(ids, np.array(sizes, np.uint64), data, planes, np.array([x is None for x in names], np.uint8))
            return pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "first": [first], "n_tokens": [len(data)], "n_documents": [len(names)], "file": [blob]}, schema=schema)

        size = 0
        for batch in batches:
            for i, j in slices(batch, SLICE):
                piece = batch.slice(i, j - i)
                ids, ends = enc.encode(piece.column("text"))
                for name, a, b in zip(piece.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    held += [ids[a:b], last]
                    sizes.append(b - a + 1)
                    names.append(name)
                    size += b - a + 1
                    if size >= shard_tokens:
                        yield out()
                        shard, first, size, held, sizes, names = shard + 1, first + size, 0, [], [], []
        if names:
            yield out()

    return placed.mapInArrow(lean(write), FILES)


def read_token_files(files: DataFrame) -> DataFrame:
    """A row for each document in the files, with its global start, length and the crc32 of its ids."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                f = WaveletFile(row["file"])
                data = f.ids().astype("<u4")
                ends = f.ends.astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                raw = memoryview(data).cast("B")
                yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(ends), row["part"], np.int32)), "doc_id": pa.array(f.doc_ids, mask=f.null.astype(bool)), "start_in_part": pa.array(starts + row["first"]), "n_tokens": pa.array(ends - starts), "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64())})

    docs = files.select("part", "shard", "first", "n_tokens", "n_documents", "file").mapInArrow(lean(read), READ)
    # a row for each part, at most as many as shuffle partitions
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return docs.join(F.broadcast(before), "part").select("doc_id", (F.col("start_in_part") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract op2: every document's ids written to wavelet files and read back."""
    import public_tokenizers

    files = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(stored(files, "token-files", compression="none"))
