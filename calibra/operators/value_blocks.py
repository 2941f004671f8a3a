"""Exact order statistics over data that grows by appends (I1, E1 refits).

A store keeps, for each appended batch, the counts of its values sorted by
(feature, value) and cut into blocks of ``BLOCK`` values, and an index with the
bounds and size of each block.  Neither is changed by later appends.  A rank is
found from the indexes of all batches:

1. Blocks in order of their lower bounds give a value that the one at rank k is
   not below: the bound of the block that brings the running size to k.  Blocks
   in order of their upper bounds give one that it is not above.
2. Blocks that end below are counted by their sizes alone; only those that meet
   the bracket are read, by their numbers.  These are a few of each batch.
3. Running sums over the values read find the one at the rank.

The result is exact, and a refit after an append reads the new batch, the
indexes (a row per 65,536 values) and the blocks at the ranks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.operators.cumulative import dist_cumsum
from calibra.operators.order_stats import RankFn, unpivot_numeric
from calibra.session import staged

#: log2 of the values of a block.
BLOCK_BITS = 16
#: Blocks up to which their numbers are pushed to the scan; more are joined.
PUSHED_BLOCKS = 1000

_ROWS = "feature string, x double, n long, block long, part string"
_INDEX = "feature string, block long, lo double, hi double, n long, part string"


class ValueBlocks:
    """The store under ``base``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, base: str, block_bits: int = BLOCK_BITS):
        self.spark, self.base, self.block_bits = spark, base.rstrip("/"), block_bits
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/index")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)

    def append(self, df: DataFrame, cols: list[str]) -> str:
        """Add the values of ``cols`` (NULL and NaN skipped).  The index is
        written last: an append that dies leaves rows that nothing refers to.
        Returns the batch's name."""
        part = f"p{uuid.uuid4().hex}"
        long = unpivot_numeric(df, [], cols).where("x IS NOT NULL AND NOT isnan(x)")
        # a value that many rows share is one row from here on
        counts = staged(long.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n")), "counts")
        rows = counts.repartitionByRange("feature", "x").sortWithinPartitions("feature", "x")
        # ids go up by one inside a partition, so blocks are runs of sorted rows
        rows = rows.withColumn("block", F.shiftright(F.monotonically_increasing_id(), self.block_bits))
        rows.write.parquet(f"{self.base}/rows/part={part}")
        written = self.spark.read.schema(_ROWS.replace(", part string", "")).parquet(f"{self.base}/rows/part={part}")
        index = written.groupBy("feature", "block").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("n").alias("n"))
        index.write.parquet(f"{self.base}/index/part={part}")
        return part

    def index(self) -> DataFrame:
        return self.spark.read.schema(_INDEX).parquet(f"{self.base}/index")

    def _rows(self, chosen: DataFrame) -> DataFrame:
        """The stored values of the ``chosen`` blocks (``part``, ``block``)."""
        blocks = chosen.select("part", "block").distinct()
        found = blocks.limit(PUSHED_BLOCKS + 1).collect()
        if not found:
            return self.spark.createDataFrame([], _ROWS)
        rows = self.spark.read.schema(_ROWS).parquet(f"{self.base}/rows")
        if len(found) > PUSHED_BLOCKS:
            return rows.join(blocks, ["part", "block"], "left_semi")
        by_part: dict[str, list[int]] = {}
        for part, block in found:
            by_part.setdefault(part, []).append(block)
        met: Column = F.lit(False)
        for part, numbers in by_part.items():
            met = met | ((F.col("part") == part) & F.col("block").isin(numbers))
        return rows.where(met)

    def ranks(self, ranks: dict[str, RankFn]) -> DataFrame:
        """The values at 1-based ranks of each feature: ``ranks`` maps a tag to
        a function of the feature's size.  Returns (feature, tag, group_n, rank,
        value); ranks outside 1..n give no row, nor does an empty store."""
        index = staged(self.index(), "index")
        sizes = index.groupBy("feature").agg(F.sum("n").alias("_n"))
        tags = F.array(*[F.struct(F.lit(t).alias("tag"), fn(F.col("_n")).cast("long").alias("k")) for t, fn in ranks.items()])
        # a row per feature and tag
        targets = (sizes.select("feature", "_n", F.explode(tags).alias("t")).select("feature", "_n", "t.tag", "t.k")
                   .where((F.col("k") >= 1) & (F.col("k") <= F.col("_n"))))
        targets = staged(targets, "targets")
        for bound in ("lo", "hi"):
            upto = dist_cumsum(index, ["feature"], [(bound, True), ("part", True), ("block", True)], {"_upto": "n"})
            at = (targets.select("feature", "tag", "k").join(upto.select("feature", bound, "_upto"), "feature")
                  .where(F.col("_upto") >= F.col("k")).groupBy("feature", "tag").agg(F.min(bound).alias(f"_{bound}")))
            targets = targets.join(at, ["feature", "tag"])
        targets = staged(targets, "brackets")
        blocks = index.join(targets, "feature").where(F.col("lo") <= F.col("_hi"))
        below = blocks.where(F.col("hi") < F.col("_lo")).groupBy("feature", "tag").agg(F.sum("n").alias("_below"))
        chosen = staged(blocks.where(F.col("hi") >= F.col("_lo")).select("feature", "tag", "part", "block"), "chosen")
        read = self._rows(chosen).join(chosen, ["feature", "part", "block"]).groupBy("feature", "tag", "x").agg(F.sum("n").alias("n"))
        run = dist_cumsum(read, ["feature", "tag"], [("x", True)], {"_upto": "n"})
        k = F.col("k") - F.coalesce("_below", F.lit(0))
        return (run.join(targets, ["feature", "tag"]).join(below, ["feature", "tag"], "left")
                .where((F.col("_upto") >= k) & (F.col("_upto") - F.col("n") < k))
                .select("feature", "tag", F.col("_n").alias("group_n"), F.col("k").alias("rank"), F.col("x").alias("value")))

    def medians(self) -> DataFrame:
        """(feature, median) of all that was appended; an even count gives the
        mean of the two middle values."""
        return self.ranks({"lo": lambda n: F.floor((n + 1) / 2), "hi": lambda n: F.floor(n / 2) + 1}).groupBy(
            "feature").agg(F.avg("value").alias("median"))
