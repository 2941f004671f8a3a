"""Benchmark decontamination by spaced seeds.

Texts are read as lower-case words (runs of letters and digits), words as 64-bit
hashes.  A mask picks some of the words in a span and ignores the others; the
hash of the picked words is the same in a benchmark item and in a document
although ignored words differ.  Where seeds meet, item and document are laid
side by side without gaps, and the overlap is verified word by word: a window
of ``window`` words (or the whole item, if shorter) must agree in at least
``agree`` of them.

The benchmark's seeds are written as blocks of bounded size to the shared
folder; tasks join each slice of documents with one block after the other.  So
a benchmark of any size works, and no task holds more than a few blocks.
Documents are not shuffled.
"""

from __future__ import annotations

import io
import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm.common import col, ddl, map_arrow, others, scratch_path, slices, table, with_text
from calibra.llm.sharedfs import open_fs, write_file

#: Fixed values.
WINDOW = 13
AGREE = 0.8
#: The masks (1: the word counts, 0: it is ignored) for items of each length
#: and, last, for those of a window or more: whichever words of an overlap of
#: ``WINDOW`` words (or the whole item) are replaced, if ``AGREE`` of them are
#: left, one of the masks lies on equal words at some place of the overlap.
MASKS = {
    5: ("1111", "11011", "10111", "11101"),
    6: ("11111", "111011", "101111", "110111", "111101"),
    7: ("110111", "1111001", "11111"),
    8: ("1011111", "1111011", "11101101"),
    9: ("10111111", "111101101", "111010111", "11111101"),
    10: ("1101111", "11110011", "110011011", "110101011", "111111"),
    11: ("1110111", "111001011", "1001011101", "10110000111"),
    12: ("11101111", "1111010011", "11010011011", "100111111", "1111100101"),
    13: ("111110111", "1101011111", "111011000111", "11111001011", "1100111111"),
}
#: Items of fewer words are not sought (none; an item of under five words must
#: be met whole).
MIN_WORDS = 1
#: Words of the benchmark in a block, and blocks a worker keeps.
BLOCK_WORDS = 500_000
HELD_BLOCKS = 4
_MIX = np.array([xxhash.xxh64_intdigest(f"place {k}") | 1 for k in range(WINDOW)], np.uint64)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' words and where each text begins."""
    texts = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    lists = pc.split_pattern_regex(texts, r"[^\pL\pN]+")
    coded = pc.dictionary_encode(lists.flatten())
    of = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    empty = pc.index_in(pa.scalar("", pa.large_string()), coded.dictionary).as_py()
    hashes = of[codes] if len(of) else np.zeros(0, np.uint64)
    if empty is None:
        return hashes, offsets
    real = codes != empty
    upto = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(real, out=upto[1:])
    return hashes[real], upto[offsets]


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The seed beginning at each place that has ``len(mask)`` words left."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, one in enumerate(mask):
        if one == "1":
            out += hashes[k:k + n] * _MIX[k]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out ^ np.uint64(len(mask) * 1_000_003 + int(mask, 2))


def masks_of(words: int) -> tuple[str, ...]:
    """The masks for items of so many words.  Those of fewer than five words
    are sought whole, as no word of them may differ."""
    return MASKS.get(min(words, WINDOW), ("1" * words,))


def _fits(bounds: np.ndarray, n: int, span: int) -> np.ndarray:
    """Whether the span at each of the first ``n`` places stays in its text."""
    sizes = np.diff(bounds)
    last = np.repeat(bounds[1:], sizes)[:n]
    return np.arange(n) + span <= last


class Block:
    """The seeds of some benchmark items, ready to be looked up."""

    def __init__(self, ids: list, hashes: np.ndarray, bounds: np.ndarray, min_words: int = MIN_WORDS):
        self.ids, self.hashes, self.bounds = ids, hashes, bounds
        sizes = np.diff(bounds)
        item = np.repeat(np.arange(len(sizes)), sizes)
        self.masks: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        lengths: dict[str, list[int]] = {}
        for k in sorted({min(int(s), WINDOW) for s in sizes if s >= max(1, min_words)}):
            for mask in masks_of(k):
                lengths.setdefault(mask, []).append(k)
        for mask, of in lengths.items():
            found = seeds(hashes, mask)
            ok = _fits(bounds, len(found), len(mask))
            ok &= np.isin(np.minimum(sizes, WINDOW)[item[:len(found)]], of)
            places = np.flatnonzero(ok)
            order = places[np.argsort(found[places], kind="stable")]
            if len(order):
                self.masks[mask] = (found[order], order)
        self.item = item
        bits = max(16, int(math.log2(16 * max(1, len(hashes)))))
        self.shift = np.uint64(64 - bits)
        self.filters = {m: self._filter(s, bits) for m, (s, _) in self.masks.items()}

    def _filter(self, found: np.ndarray, bits: int) -> np.ndarray:
        out = np.zeros(1 << bits, bool)
        out[found >> self.shift] = True
        return out

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, hashes=self.hashes, bounds=self.bounds, ids=np.array([-1 if i is None else i for i in self.ids], np.int64),
                 null=np.array([i is None for i in self.ids], bool))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes, min_words: int) -> Block:
        with np.load(io.BytesIO(raw)) as z:
            ids = [None if null else int(i) for i, null in zip(z["ids"], z["null"], strict=True)]
            return cls(ids, z["hashes"], z["bounds"], min_words)

    def hits(self, hashes: np.ndarray, bounds: np.ndarray, chunk: int = 1 << 20) -> np.ndarray:
        """Where seeds meet: rows (document, item, shift), each once; the item's
        word j lies at word j + shift of the document."""
        sizes = np.diff(bounds)
        doc_of = None
        out = [np.zeros((0, 3), np.int64)]
        for mask, (known, places) in self.masks.items():
            found = seeds(hashes, mask)
            at = np.flatnonzero(self.filters[mask][found >> self.shift])
            if not len(at):
                continue
            lo = np.searchsorted(known, found[at], "left")
            many = np.searchsorted(known, found[at], "right") - lo
            at, lo, many = at[many > 0], lo[many > 0], many[many > 0]
            if doc_of is None:
                doc_of = np.repeat(np.arange(len(sizes)), sizes)
            inside = at + len(mask) <= bounds[doc_of[at] + 1]
            at, lo, many = at[inside], lo[inside], many[inside]
            # a chunk of pairs at a time; what they have in common is a shift
            upto = np.cumsum(many)
            begins = np.searchsorted(upto, np.arange(0, int(many.sum()), chunk), "right")
            steps = np.unique(np.append(begins, len(at)))
            for a, b in zip(steps[:-1], steps[1:], strict=True):
                m = many[a:b]
                pair = np.repeat(lo[a:b] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                place = places[pair]
                item = self.item[place]
                where = np.repeat(at[a:b], m)
                doc = doc_of[where]
                out.append(np.unique(np.stack(
                    [doc, item, (where - bounds[doc]) - (place - self.bounds[item])], 1), axis=0))
        return np.unique(np.concatenate(out), axis=0)

    def overlaps(self, hashes: np.ndarray, bounds: np.ndarray, window: int, agree: float) -> Iterator[tuple[int, int, int]]:
        """Verified overlaps: (document, item, words that agree in the best window)."""
        for doc, item, shift in self.hits(hashes, bounds).tolist():
            own = self.hashes[self.bounds[item]:self.bounds[item + 1]]
            text = hashes[bounds[doc]:bounds[doc + 1]]
            lo, hi = max(0, -shift), min(len(own), len(text) - shift)
            width = min(window, len(own))
            if hi - lo < width:
                continue
            same = np.zeros(hi - lo + 1, np.int64)
            np.cumsum(own[lo:hi] == text[lo + shift:hi + shift], out=same[1:])
            best = int((same[width:] - same[:-width]).max())
            if best >= math.ceil(agree * width - 1e-9):
                yield doc, item, best


_HELD: OrderedDict[tuple[str, int], Block] = OrderedDict()


def _load(path: str, min_words: int) -> Block:
    """A block, from this worker's memory or the shared folder."""
    key = (path, min_words)
    if key not in _HELD:
        fs, p = open_fs(path)
        with fs.open_input_stream(p, compression=None) as f:
            block = Block.from_bytes(f.read(), min_words)
        while len(_HELD) >= HELD_BLOCKS:
            _HELD.popitem(last=False)
        _HELD[key] = block
    _HELD.move_to_end(key)
    return _HELD[key]


def write_blocks(benchmark: DataFrame, folder: str, text: str = "text", key: str = "item_id",
                 block_words: int = BLOCK_WORDS, min_words: int = MIN_WORDS) -> list[str]:
    """Write the benchmark's words as blocks; their paths (a few, by size)."""
    src = benchmark.select(col(key).cast("long").alias("id"), col(text).alias("text"), F.spark_partition_id().alias("part"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seq = [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, seq
            bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, _, b in held]))])
            block = Block([i for ids, _, _ in held for i in ids], np.concatenate([h for _, h, _ in held]), bounds, min_words)
            path = f"{folder}/items-{part:06d}-{seq:05d}.npz"
            write_file(path, [block.to_bytes()])
            held, size, seq = [], 0, seq + 1
            return pa.RecordBatch.from_pydict({"path": [path]})

        for batch in batches:
            for piece in slices(batch, 1 << 20):
                part = piece.column(2)[0].as_py()
                hashes, bounds = word_hashes(piece.column(1))
                held.append((piece.column(0).to_pylist(), hashes, bounds))
                size += len(hashes)
                if size >= block_words:
                    yield flush()
        if held:
            yield flush()

    return sorted(r["path"] for r in src.mapInArrow(write, "path string").collect())


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text",
                  item_key: str = "item_id", window: int = WINDOW, agree: float = AGREE, min_words: int = MIN_WORDS,
                  block_words: int = BLOCK_WORDS, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns if None) of ``docs`` with ``contaminated``,
    ``item_ids`` (of all items found, ascending, each once) and ``agreeing``
    (most words that agree in one window; 0 if none).

    The masks are made for the fixed window and share; with a longer window or
    a smaller share some overlaps have no seed.

    Null and word-less texts are clean, as are all documents if the benchmark
    is empty or has no item of ``min_words`` words.  Items without id are found
    too and listed as null.  Rows are judged alone, so repeated rows agree.
    Columns of these names are replaced.
    """
    spark = docs.sparkSession
    paths = write_blocks(benchmark, scratch_path(spark, "blocks"), item_text, item_key, block_words, min_words)
    rest = others(docs.columns if keep is None else keep, "contaminated", "item_ids", "agreeing")
    src, at = with_text(docs, rest, text)

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, bounds = word_hashes(batch.column(at))
        items: list[set] = [set() for _ in range(batch.num_rows)]
        best = [0] * batch.num_rows
        for path in paths:
            block = _load(path, min_words)
            for doc, item, same in block.overlaps(hashes, bounds, window, agree):
                items[doc].add(block.ids[item])
                best[doc] = max(best[doc], same)
        lists = [sorted(x, key=lambda i: (i is None, i or 0)) for x in items]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:len(rest)], pa.array([bool(x) for x in items]), pa.array(lists, pa.list_(pa.int64())), pa.array(best, pa.int32())],
            names=[*batch.schema.names[:len(rest)], "contaminated", "item_ids", "agreeing"])

    return map_arrow(src, scan, ddl(src, len(rest)) + "contaminated boolean, item_ids array<bigint>, agreeing int",
                     max_bytes=(2 if len(paths) <= HELD_BLOCKS else 32) << 20)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
