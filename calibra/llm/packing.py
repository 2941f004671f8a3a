"""Best-fit packing of token sequences, bulk-synchronous.

1. Executors encode the documents and cut those longer than a sequence.
2. Pieces are range-sorted by length and go in classes, the longest first.
3. A superstep places a whole class.  Its pieces and the open gaps are
   range-sorted together, longest first; a sweep adds up the places that gaps
   offer and pieces take, so that each has a level, as brackets have.  A
   piece's successor, the smallest gap that holds it and that no piece before
   it takes, is the gap that comes last before it on its level: where several
   pieces would take one gap, their rank decides.  Levels are swept side by
   side.  A piece without a gap opens a sequence.
4. Gaps are updated, and the next class follows.

A gap offers as many places as it has room for pieces of the greatest length in
the class, one at least.  The number of supersteps depends on the capacity alone
(31 for 4096).  Within a class each level has at most two rows per length, so no
level is long, however many pieces have one length.  The driver holds a
histogram of at most ``capacity`` gap sizes and one total per partition.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibra.llm.common import col, fresh, map_arrow, materialise, others, running_sum, table
from calibra.llm.wordcode import word_encoder

CAPACITY = 4096


def cut_pieces(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id",
               capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """``key``, ``piece``, ``start``, ``length``, ``ids_crc32`` of the pieces of
    every document.  A null or empty text is the end id alone; repeated rows
    give repeated pieces."""
    src = docs.select(col(key).alias("doc_id"), col(text).alias("text"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, bounds = word_encoder(tokenizer_path).encode(batch.column(1), end_id)
        sizes = np.diff(bounds)
        n = -(-sizes // capacity)
        doc = np.repeat(np.arange(len(sizes)), n)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        start = piece * capacity
        length = np.minimum(sizes[doc] - start, capacity)
        raw = memoryview(ids.astype("<u4").tobytes())
        at = 4 * (bounds[:-1][doc] + start)
        crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
             pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return map_arrow(src, cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long", max_bytes=4 << 20)


def classes(capacity: int) -> list[tuple[int, int]]:
    """(above, up to) of the lengths that are placed together, longest first:
    cut where one more piece goes into a sequence, and at steps of a quarter."""
    cuts = {0, capacity, *(capacity // k for k in range(2, 9)), *(n for n in (8, 16, 32, 64) if n < capacity)}
    step = capacity / 1.25
    while step > 64:
        cuts.add(int(step))
        step /= 1.25
    down = sorted(cuts, reverse=True)
    return list(zip(down[1:], down[:-1], strict=True))


def _superstep(pieces: DataFrame, gaps: DataFrame, many: int, sizes: dict[int, int], above: int, upto: int,
               capacity: int, opened: int) -> tuple[DataFrame, DataFrame]:
    """Place ``pieces`` (``pid``, ``length``; ``many`` rows) of one class into
    ``gaps`` (``seq``, ``gap``; ``sizes`` is their histogram) or into sequences
    from ``opened`` on.  Returns (``pid``, ``seq``, ``offset``, ``length``,
    ``gap`` of each piece, the gaps after it)."""
    # the smallest gaps that offer a place to every piece: larger ones are not reached
    offered, top = 0, above
    for gap in sorted(g for g in sizes if g > above):
        if offered >= many:
            break
        top = gap
        offered += sizes[gap] * (gap // upto)
    takes_part = (F.col("gap") > above) & (F.col("gap") <= top)
    rows = (gaps.where(takes_part).select(F.col("gap").alias("size"), F.lit(0).alias("kind"), F.col("seq").alias("id"),
                                          F.greatest(F.floor(F.col("gap") / upto), F.lit(1)).cast("long").alias("step"))
            .unionByName(pieces.select(F.col("length").alias("size"), F.lit(1).alias("kind"), F.col("pid").alias("id"), F.lit(-1).cast("long").alias("step"))))
    swept = running_sum(rows, [F.desc("size"), F.asc("kind"), F.asc("id")], "step", "depth")
    # under all gaps lie as many places in sequences not yet open, so every piece has a level
    levels = F.when(F.col("kind") == 0, F.sequence(F.col("depth") - F.col("step") + 1, F.col("depth"))).otherwise(F.array(F.col("depth") + 1))
    on_level = Window.partitionBy("level").orderBy(F.desc("size"), "kind", "id")
    before = lambda c: F.lag(c).over(on_level)
    taken = (swept.withColumn("level", F.explode(levels))
             .withColumns({"seq": before("id"), "gap": before("size")}).where("kind = 1"))
    place = F.floor(-F.col("level") / F.lit(capacity // upto)).cast("long")  # levels 0, -1, ... lie in new sequences
    taken = taken.select(F.col("id").alias("pid"), F.coalesce("seq", opened + place).alias("seq"),
                         F.coalesce("gap", F.lit(capacity).cast("long")).alias("gap"), F.col("size").alias("length"))
    inside = Window.partitionBy("seq").orderBy(F.desc("length"), "pid").rowsBetween(Window.unboundedPreceding, 0)
    placed = materialise(taken.withColumn("offset", capacity - F.col("gap") + F.sum("length").over(inside) - F.col("length")), "placed")
    # a gap that nothing took has no piece: one sum by sequence, no join
    taken = placed.select("seq", "gap", "length").unionByName(gaps.where(takes_part).select("seq", "gap", F.lit(0).cast("long").alias("length")))
    after = (taken.groupBy("seq").agg((F.max("gap") - F.sum("length")).alias("gap"))
             .unionByName(gaps.where(~takes_part)).where("gap > 0"))
    return placed, materialise(after, "gaps")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns, ``length`` from 1 to ``capacity`` among them)
    with ``sequence_id`` and ``offset`` (columns called so are replaced).
    Pieces of equal length are ranked by their other columns, so that repeated
    rows take places side by side; an empty table gives no rows."""
    spark = pieces.sparkSession
    pieces = pieces.select(*map(col, others(pieces.columns, "sequence_id", "offset")))
    ties = [c for c in pieces.columns if c != "length"]
    pid = fresh("pid", pieces.columns)
    ranked = materialise(
        pieces.repartitionByRange(F.col("length").desc(), *map(col, ties))
        .sortWithinPartitions(F.col("length").desc(), *map(col, ties))
        .withColumn(pid, F.monotonically_increasing_id()), "ranked")
    # bounded: one row per length
    lengths = {r[0]: r[1] for r in ranked.groupBy("length").count().collect()}
    short = ranked.select(F.col(pid).alias("pid"), F.col("length").cast("long").alias("length"))
    gaps = spark.createDataFrame([], "seq long, gap long")
    done, opened = [], 0
    for above, upto in classes(capacity):
        here = [length for length in lengths if above < length <= upto]
        if not here:
            continue
        many, upto = sum(lengths[length] for length in here), max(here)
        sizes = {r[0]: r[1] for r in gaps.groupBy("gap").count().collect()} if done else {}
        placed, gaps = _superstep(short.where((F.col("length") > above) & (F.col("length") <= upto)), gaps, many, sizes, above, upto, capacity, opened)
        opened = max(opened, placed.agg(F.max("seq")).first()[0] + 1)
        done.append(placed.select(F.col("pid").alias("_pid"), F.col("seq").alias("sequence_id"), "offset"))
    if not done:
        return ranked.drop(pid).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    places = done[0]
    for more in done[1:]:
        places = places.unionByName(more)
    free = fresh("_pid", ranked.columns)
    return ranked.join(places.withColumnRenamed("_pid", free), F.col(pid) == F.col(free)).drop(pid, free)


def pack_documents(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id",
                   capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Encode, cut and pack ``docs``; a row per piece.  An empty table gives
    no rows; columns other than key and text are not read."""
    # written once: the range-sort reads its input twice
    return pack(materialise(cut_pieces(docs, tokenizer_path, text, key, capacity, end_id), "pieces"), capacity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
