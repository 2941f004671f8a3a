"""Token ids in wavelet-matrix files, one per shard.

A file holds the ids of a run of documents as a wavelet matrix: one bit-plane
per bit of the ids, highest first, each plane in the order left by a stable
partition on the plane above it.  Planes are cut into blocks that are packed
by zstd one by one; a rank directory counts the ones before each block.  So one
file gives access to a token, counts and finds the places of an id, and reads
back whole -- a lookup unpacks one block per plane and step.

Layout: magic, length of the JSON head, head, blocks.  The head has the number
of ids, the zeros and blocks of each plane, and where the document index (an
Arrow stream of doc_id and length) lies.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibra.llm.common import col, materialise, release, scratch_path, slices, table
from calibra.llm.sharedfs import open_fs, write_file
from calibra.llm.wordcode import word_encoder

MAGIC = b"CWM1"
#: Bits of a plane packed together.
BLOCK_BITS = 1 << 18
#: Ids after which a writer begins the next file.
SHARD_IDS = 1 << 23
#: Ids that a reading task takes at most, as long as all cores have tasks.
READ_IDS = 1 << 26
#: Rows of a batch and bytes of text encoded at once: the more, the fewer words come again.
BATCH_ROWS = 4000
SLICE = 16 << 20
_ZSTD = pa.Codec("zstd", compression_level=1)


def build(ids: np.ndarray, index: pa.RecordBatch) -> list[bytes]:
    """The parts of a file holding ``ids`` and the document index."""
    seq = np.asarray(ids)
    width = max(1, int(seq.max()).bit_length()) if len(seq) else 1
    seq = seq.astype(np.uint16 if width <= 16 else np.uint32)
    parts: list[bytes] = []
    at, planes = 0, []
    for b in range(width - 1, -1, -1):
        one = (seq & seq.dtype.type(1 << b)).astype(bool)
        blocks, ones = [], 0
        for i in range(0, len(seq), BLOCK_BITS):
            bits = one[i:i + BLOCK_BITS]
            data = _ZSTD.compress(np.packbits(bits).tobytes(), asbytes=True)
            blocks.append([at, len(data), ones])
            ones += int(np.count_nonzero(bits))
            at += len(data)
            parts.append(data)
        planes.append({"zeros": len(seq) - ones, "blocks": blocks})
        # places first: several times faster than picking by a mask
        down = np.empty_like(seq)
        np.take(seq, np.flatnonzero(~one), out=down[:len(seq) - ones], mode="clip")
        np.take(seq, np.flatnonzero(one), out=down[len(seq) - ones:], mode="clip")
        seq = down
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, index.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(index)
    docs = sink.getvalue().to_pybytes()
    head = json.dumps({"n": len(seq), "width": width, "block_bits": BLOCK_BITS, "planes": planes,
                       "docs": [at, len(docs)], "crc": zlib.crc32(docs)}).encode()
    return [MAGIC + struct.pack("<I", len(head)) + head, *parts, docs]


class WaveletFile:
    """Reads a file through ``read(offset, size)``; nothing but the head is
    kept unpacked besides the last block used of each plane."""

    def __init__(self, read):
        self.read = read
        magic, size = struct.unpack("<4sI", read(0, 8))
        if magic != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        head = json.loads(read(8, size))
        self.base = 8 + size
        self.n, self.width, self.block_bits = head["n"], head["width"], head["block_bits"]
        self.planes, self._docs, self._crc = head["planes"], head["docs"], head["crc"]
        self._held: dict[int, tuple[int, np.ndarray]] = {}

    @classmethod
    def open(cls, uri: str) -> WaveletFile:
        fs, path = open_fs(uri)
        file = fs.open_input_file(path)

        def read(offset: int, size: int) -> bytes:
            file.seek(offset)
            return file.read(size)

        return cls(read)

    def index(self) -> pa.RecordBatch:
        raw = self.read(self.base + self._docs[0], self._docs[1])
        if zlib.crc32(raw) != self._crc:
            raise ValueError("damaged document index")
        with pa.ipc.open_stream(raw) as r:
            return r.read_next_batch()

    def _bits(self, plane: int, block: int) -> np.ndarray:
        held = self._held.get(plane)
        if held is None or held[0] != block:
            at, size, _ = self.planes[plane]["blocks"][block]
            many = min(self.block_bits, self.n - block * self.block_bits)
            raw = _ZSTD.decompress(self.read(self.base + at, size), (many + 7) // 8, asbytes=True)
            held = (block, np.unpackbits(np.frombuffer(raw, np.uint8), count=many).view(bool))
            self._held[plane] = held
        return held[1]

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block, rest = divmod(i, self.block_bits)
        if block == len(self.planes[plane]["blocks"]):
            return self.n - self.planes[plane]["zeros"]
        before = self.planes[plane]["blocks"][block][2]
        return before + (int(np.count_nonzero(self._bits(plane, block)[:rest])) if rest else 0)

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Place of the ``k``-th (from 0) bit of this value in a plane."""
        blocks = self.planes[plane]["blocks"]
        lo, hi = 0, len(blocks) - 1
        before = lambda j: blocks[j][2] if bit else j * self.block_bits - blocks[j][2]
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if before(mid) <= k else (lo, mid - 1)
        bits = self._bits(plane, lo)
        return lo * self.block_bits + int(np.flatnonzero(bits if bit else ~bits)[k - before(lo)])

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p, plane in enumerate(self.planes):
            block, rest = divmod(i, self.block_bits)
            bit = int(self._bits(p, block)[rest])
            ones = self._rank1(p, i)
            i = plane["zeros"] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, begin: int, end: int) -> tuple[int, int]:
        if token >> self.width:
            return 0, 0
        for p, plane in enumerate(self.planes):
            a, b = self._rank1(p, begin), self._rank1(p, end)
            bit = token >> (self.width - 1 - p) & 1
            begin, end = (plane["zeros"] + a, plane["zeros"] + b) if bit else (begin - a, end - b)
        return begin, end

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """How often an id comes among places ``begin`` to ``end``."""
        a, b = self._range(token, begin, self.n if end is None else end)
        return b - a

    def find(self, token: int, k: int) -> int:
        """Place of the ``k``-th (from 0) occurrence of an id."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for p in range(self.width - 1, -1, -1):
            bit = token >> (self.width - 1 - p) & 1
            i = self._select(p, bit, i - self.planes[p]["zeros"] * bit)
        return i

    def ids(self) -> np.ndarray:
        """All ids in order (uint32)."""
        seq = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for p in range(self.width - 1, -1, -1):
            one = np.empty(self.n, bool)
            for b in range(len(self.planes[p]["blocks"])):
                bits = self._bits(p, b)
                one[b * self.block_bits:b * self.block_bits + len(bits)] = bits
            self._held.pop(p, None)
            zeros = self.planes[p]["zeros"]
            up = np.empty_like(seq)
            up[np.flatnonzero(~one)] = seq[:zeros]
            up[np.flatnonzero(one)] = seq[zeros:] | (1 << (self.width - 1 - p))
            seq = up
        return seq.astype(np.uint32)


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, text: str = "text", key: str = "doc_id",
                 end_id: int = 1, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode ``docs`` in ascending order of ``key`` (null first; equal keys by
    text) and write wavelet-matrix files to ``folder``.

    Returns the manifest: ``part``, ``seq`` (order of files), ``path``,
    ``n_docs``, ``n_ids``.  A writer holds one shard at most (or one document,
    if that is longer); a task run twice writes the same files again.
    """
    sorted_docs = docs.select(col(key).alias("k"), col(text).alias("t"))
    order = [F.col("k").asc_nulls_first(), F.col("t").asc_nulls_first()]
    sorted_docs = (sorted_docs.repartitionByRange(F.col("k").asc_nulls_first(), F.xxhash64("t"))
                   .sortWithinPartitions(*order).withColumn("p", F.spark_partition_id()))

    piece_bytes = SLICE

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path)
        held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        part = seq = size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, seq, size
            index = pa.RecordBatch.from_arrays(
                [pa.concat_arrays([h[1] for h in held]), pa.array(np.concatenate([h[2] for h in held]), pa.int64())],
                names=["doc_id", "length"])
            ids = np.concatenate([h[0] for h in held])
            held = []
            path = f"{folder}/shard-{part:06d}-{seq:05d}.cwm"
            write_file(path, build(ids, index))
            row = pa.RecordBatch.from_pylist(
                [{"part": part, "seq": seq, "path": path, "n_docs": index.num_rows, "n_ids": len(ids)}], schema)
            seq, size = seq + 1, 0
            return row

        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()),
                            ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        for batch in batches:
            for piece in slices(batch, piece_bytes):
                part = piece.column(2)[0].as_py()
                ids, bounds = encoder.encode(piece.column(1), end_id)
                held.append((ids.astype(np.uint32), piece.column(0), np.diff(bounds)))
                size += len(ids)
                if size >= shard_ids:
                    yield flush()
        if held:
            yield flush()
        release()

    return sorted_docs.mapInArrow(write, "part int, seq int, path string, n_docs long, n_ids long")


def read_shards(manifest: DataFrame, key_type: str = "long") -> DataFrame:
    """Read the files of a manifest back: ``doc_id``, ``start``, ``n_tokens``,
    ``ids_crc32`` per document.  A manifest has a row per file, so the running
    sum of their sizes is over few rows."""
    order = Window.orderBy("part", "seq")
    files = manifest.withColumn("base", F.sum("n_ids").over(order) - F.col("n_ids"))
    files = files.select("path", "base", "part", "seq")
    n_files, n_ids = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_ids"), F.lit(0))).first()
    cores = manifest.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(n_files, max(3 * cores, n_ids // READ_IDS)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = WaveletFile.open(path)
                index, ids = file.index(), file.ids()
                lengths = index.column(1).to_numpy()
                ends = np.cumsum(lengths)
                if file.n != (ends[-1] if len(ends) else 0):
                    raise ValueError(f"{path}: the index does not fit the ids")
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(raw[4 * (b - n):4 * b]) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [index.column(0), pa.array(base + ends - lengths, pa.int64()),
                     pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])
        release()

    return files.repartitionByRange(tasks, "part", "seq").mapInArrow(
        read, f"doc_id {key_type}, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, text: str = "text",
                key: str = "doc_id", end_id: int = 1, shard_ids: int = SHARD_IDS) -> tuple[DataFrame, DataFrame]:
    """Write ``docs`` and read the files back: (manifest, documents read).

    Null and empty texts are the end id alone; rows with equal keys follow each
    other; an empty table gives no files and no rows; columns other than key
    and text are not read.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "shards")
    manifest = materialise(write_shards(docs, tokenizer_path, folder, text, key, end_id, shard_ids), "manifest", BATCH_ROWS)
    return manifest, read_shards(manifest, docs.select(col(key)).schema[0].dataType.simpleString())


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as read back from the files written of them."""
    import public_tokenizers

    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))[1]
