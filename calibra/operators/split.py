"""Reproducible splits and samples.

Every draw is a hash of (key, seed): results do not move under repartitioning,
retries or executor loss, and DuckDB computes the same md5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.functions.hashing import hash_hex
from calibra.operators.order_stats import select_ranks
from calibra.session import staged


def _hex_threshold(frac: float) -> str:
    return format(min(int(frac * 2 ** 32), 2 ** 32 - 1), "08x")


def split_hash(df: DataFrame, key: str, seed: int = 42, test: float = 0.2,
               val: float = 0.1, col: str = "split") -> DataFrame:
    """E1 (hash mode): narrow, no shuffle; shares ~= fractions, classes mixed evenly."""
    h = hash_hex(key, seed)
    return df.withColumn(col, F.when(h < F.lit(_hex_threshold(test)), F.lit("test"))
                         .when(h < F.lit(_hex_threshold(test + val)), F.lit("val"))
                         .otherwise(F.lit("train")))


def _hash_num(key: str, seed: int):
    """Numeric proxy of the md5 order (first 60 bits) for the quantile sketch."""
    return F.conv(F.substring(hash_hex(key, seed), 1, 15), 16, 10).cast("long").cast("double")


def split_exact(df: DataFrame, key: str, label: str, seed: int = 42, test: float = 0.2,
                val: float = 0.1, col: str = "split", **kw) -> DataFrame:
    """E1 (exact mode): per class, rank by (md5, key); the first ceil(test*n)
    rows are test, the next ceil(val*n) val, the rest train.

    The class cut points are found by ``select_ranks`` (sketch + bounded
    window), so no window ever spans a whole class.
    """
    h = hash_hex(key, seed)
    # the cut points need three passes: read key, label and hash once for them
    keyed = df.withColumn("_h", h)
    hashed = staged(keyed.select(label, key, "_h").withColumn("_hn", _hash_num(key, seed)), "hashed")
    cuts = select_ranks(hashed, [label], "_hn", {
        "test": lambda n: F.ceil(n * test),
        "val": lambda n: F.ceil(n * test) + F.ceil(n * val),
    }, order_col="_h", tiebreak=(key,), **kw)
    piv = cuts.groupBy(label).agg(
        F.max(F.when(F.col("tag") == "test", F.struct(F.col("_h"), F.col(key)))).alias("_ct"),
        F.max(F.when(F.col("tag") == "val", F.struct(F.col("_h"), F.col(key)))).alias("_cv"))
    # one row per class; the planner broadcasts it if its size allows
    j = keyed.join(piv, label, "left")
    me = F.struct(F.col("_h"), F.col(key))
    out = j.withColumn(col, F.when(F.col("_ct").isNotNull() & (me <= F.col("_ct")), F.lit("test"))
                       .when(F.col("_cv").isNotNull() & (me <= F.col("_cv")), F.lit("val"))
                       .otherwise(F.lit("train")))
    return out.drop("_h", "_ct", "_cv")


def class_counts(df: DataFrame, label: str) -> dict[int, int]:
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}


#: Rows up to which a sample is taken from per-partition top-n heaps.
HEAP_ROWS = 10_000


def _first_rows(keyed: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows by (md5, key).  Many rows are not gathered: the
    n-th one is found by ``select_ranks`` and cuts the others off."""
    if n <= HEAP_ROWS:
        return keyed.orderBy("_h", key).limit(n)
    cut = select_ranks(keyed, [], "_hn", {"cut": lambda _: F.lit(n)}, order_col="_h", tiebreak=(key,)).first()
    if cut is None:
        return keyed
    # a literal has the type of its value, which need not be the key's
    at = F.struct(F.lit(cut["_h"]).alias("_h"), F.lit(cut[key]).cast(keyed.schema[key].dataType).alias(key))
    me = F.struct("_h", key)
    before = keyed.where(me < at)
    # keys may repeat: of the rows at the cut only as many as are due
    return before.unionByName(keyed.where(me == at).limit(n - before.count()))


def subsample(df: DataFrame, key: str, label: str, n: int, seed: int = 42,
              balanced: bool = True) -> DataFrame:
    """Class-balanced (or uniform) sample of exactly ``n`` rows.

    Balanced: ``n // 2`` positives (all if fewer), negatives fill to ``n``.
    ``n >= rows`` returns every row.
    """
    counts = class_counts(df, label)
    total = sum(counts.values())
    if n >= total:
        return df
    keyed = df.withColumn("_h", hash_hex(key, seed)).withColumn("_hn", _hash_num(key, seed))
    if not balanced:
        return _first_rows(keyed, key, n).drop("_h", "_hn")
    n_pos = min(n // 2, counts.get(1, 0))
    n_neg = min(n - n_pos, counts.get(0, 0))
    pos = _first_rows(keyed.where(F.col(label) == 1), key, n_pos)
    neg = _first_rows(keyed.where(F.col(label) == 0), key, n_neg)
    return pos.unionByName(neg).drop("_h", "_hn")


def test_sample_size(n: int) -> int:
    """Size of the held-out sample for kernel models."""
    return max(200, n // 4)
