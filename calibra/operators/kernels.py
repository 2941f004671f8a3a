"""Kernels between rows.

* ``cos2``: the product over features of cos^2(a_i - b_i).  Since
  cos^2(a - b) = (1 + cos 2a cos 2b + sin 2a sin 2b) / 2, it is the dot product
  of explicit vectors (``cos2_features``), so models and sums need no pairs.
* ``kernel_sums``: sums of a dot-product kernel over all pairs of rows, class
  by class, from one sum of vectors per class: work linear in the rows.
* ``cross_gram``: K(X, Y) for two sets of rows.  A second side of a counted,
  small size travels as a broadcast variable; a larger one is read from the
  shared folder, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibra.session import scratch_path, shared_uri

#: Rows of a second side that are broadcast (counted first); beyond that, rows
#: of a block of it, and rows of the first side that meet it in one reading.
BROADCAST_ROWS = 5000
BLOCK_ROWS = 2000
LEFT_ROWS = 10_000


# ------------------------------------------------------------------ kernels
@dataclass(frozen=True)
class Kernel:
    """kind: 'rbf' | 'linear' | 'cos2'; params e.g. gamma."""

    kind: str
    params: dict = field(default_factory=dict)

    def matrix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.kind == "rbf":
            g = float(self.params.get("gamma", 1.0))
            d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
            return np.exp(-g * np.maximum(d2, 0.0))
        if self.kind == "linear":
            return a @ b.T
        if self.kind == "cos2":
            out = np.ones((a.shape[0], b.shape[0]))
            for i in range(a.shape[1]):
                out *= np.cos(a[:, i][:, None] - b[:, i][None, :]) ** 2
            return out
        raise ValueError(f"no kernel is called {self.kind!r}")


def make_kernel(kind: str, **params) -> Kernel:
    """K3: kernel record; unknown kinds raise."""
    k = Kernel(kind.lower(), params)
    k.matrix(np.zeros((1, 2)), np.zeros((1, 2)))  # validates the kind
    return k


def _products(factors):
    """Each entry times each of ``factors``."""
    return lambda a: F.transform(factors, lambda b: a * b)


def cos2_features(df: DataFrame, cols: list[str], out: str = "vec") -> DataFrame:
    """Add ``out``, the vector whose dot products are the cos2 kernel of
    ``cols``: the products over the features of (1, cos 2x, sin 2x) / sqrt 2,
    3^k numbers for k features.  Column expressions only, so it works on
    streams too; NULL in a feature gives a NULL vector."""
    acc = F.array(F.lit(1.0))
    for c in cols:
        x = F.col(c).cast("double") * 2.0
        three = F.array(F.lit(math.sqrt(0.5)), F.cos(x) * math.sqrt(0.5), F.sin(x) * math.sqrt(0.5))
        acc = F.flatten(F.transform(acc, _products(three)))
    known = None
    for c in cols:
        known = F.col(c).isNotNull() if known is None else known & F.col(c).isNotNull()
    return df.withColumn(out, acc if known is None else F.when(known, acc))


# ------------------------------------------------------------- linear sums
def kernel_sums(df: DataFrame, vec: str, label: str) -> DataFrame:
    """K8/K10 for K(a, b) = <a, b>: per (li, lj) the sum of K over ordered
    pairs of different rows and over rows with themselves, and how many.

    The sum over pairs of two classes is the dot product of the classes' vector
    sums, so what is shuffled is classes x dimensions, whatever the rows.
    """
    d = df.select(F.col(label).alias("l"), F.col(vec).alias("v")).where(F.col("v").isNotNull())
    size = d.groupBy("l").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("own"))
    sums = d.select("l", F.posexplode("v").alias("i", "x")).groupBy("l", "i").agg(F.sum("x").alias("s"))
    left = sums.select(F.col("l").alias("li"), "i", F.col("s").alias("si"))
    right = sums.select(F.col("l").alias("lj"), "i", F.col("s").alias("sj"))
    dots = left.join(right, "i").groupBy("li", "lj").agg(F.sum(F.col("si") * F.col("sj")).alias("s"))
    a = size.select(F.col("l").alias("li"), F.col("n").alias("ni"), "own")
    b = size.select(F.col("l").alias("lj"), F.col("n").alias("nj"))
    same = F.col("li") == F.col("lj")
    zero = F.lit(0).cast("long")
    return dots.join(a, "li").join(b, "lj").select(
        "li", "lj",
        (F.col("s") - F.when(same, F.col("own")).otherwise(0.0)).alias("s_off"),
        F.when(same, F.col("own")).otherwise(0.0).alias("s_diag"),
        (F.col("ni") * F.col("nj") - F.when(same, F.col("ni")).otherwise(zero)).alias("c_off"),
        F.when(same, F.col("ni")).otherwise(zero).alias("c_diag"))


def kernel_stats(sums: DataFrame) -> DataFrame:
    """K8: n, mean of off-diagonal K divided by N^2 (the reference's
    definition), mean diagonal."""
    t = sums.agg(F.sum("s_off").alias("so"), F.sum("s_diag").alias("sd"),
                 F.sum("c_off").alias("co"), F.sum("c_diag").alias("cd"))
    n2 = F.col("co") + F.col("cd")
    return t.select(F.col("cd").alias("n"), (F.col("so") / n2).alias("offdiag_mean"),
                    (F.col("sd") / F.col("cd")).alias("diag_mean"))


def kernel_blocks(sums: DataFrame) -> DataFrame:
    """Mean K per (class_i, class_j) over ordered pairs incl. diagonal."""
    return sums.select(
        F.col("li").alias("label_i"), F.col("lj").alias("label_j"),
        ((F.col("s_off") + F.col("s_diag")) / (F.col("c_off") + F.col("c_diag"))).alias("mean_k"))


# --------------------------------------------------------------- two sides
def _stack(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64)


def _long(ki: np.ndarray, kj: np.ndarray, k: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"i": np.repeat(ki, len(kj)), "j": np.tile(kj, len(ki)), "k": k.ravel()})


def _gathered(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The rows of ``batches`` in blocks of ``rows`` (the last may be smaller)."""
    held, n = [], 0
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            held.append(pdf.iloc[at:at + rows])
            n += len(held[-1])
            if n >= rows:
                both = pd.concat(held, ignore_index=True)
                yield both.iloc[:rows]
                held, n = [both.iloc[rows:]], n - rows
    if n:
        yield pd.concat(held, ignore_index=True)


def _stored(path: str, rows: int) -> Iterator[pa.RecordBatch]:
    """The rows written to a shared folder, in batches of at most ``rows``."""
    fs, folder = pafs.FileSystem.from_uri(path)
    for f in sorted(fs.get_file_info(pafs.FileSelector(folder)), key=lambda f: f.path):
        if f.path.endswith(".parquet"):
            with fs.open_input_file(f.path) as source:
                yield from pq.ParquetFile(source).iter_batches(rows, columns=["j", "y"])


def cross_gram(df: DataFrame, key: str, vec: str, other: DataFrame, okey: str, ovec: str,
               kernel: Kernel, broadcast_rows: int = BROADCAST_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """K4/K5: (i, j, k) for every row of ``df`` and every row of ``other``.

    A second side of at most ``broadcast_rows`` rows (counted) is broadcast and
    the first streams by.  A larger one is written once to the shared folder,
    from where each block of the first side reads it block by block: what is
    shuffled and written follows the rows, not the pairs, and a task holds one
    block of either side, however many there are.
    """
    spark = df.sparkSession
    right = other.select(F.col(okey).cast("long").alias("j"), F.col(ovec).alias("y"))
    left = df.select(F.col(key).alias("i"), F.col(vec).alias("x"))
    m = right.count()
    schema = "i long, j long, k double"
    if m <= broadcast_rows:
        rows = sorted(right.collect(), key=lambda r: r[0])
        bc = spark.sparkContext.broadcast((np.array([r[0] for r in rows], dtype="int64"),
                                           np.array([np.asarray(r[1], dtype=np.float64) for r in rows])))

        def stream(batches):
            keys, y = bc.value
            for pdf in batches:
                if len(pdf) and len(keys):
                    yield _long(pdf["i"].to_numpy(), keys, kernel.matrix(_stack(pdf["x"]), y))

        return left.mapInPandas(stream, schema)
    path = shared_uri(spark, scratch_path(spark, "second-side"))
    right.write.parquet(path)

    def blocks(batches):
        for pdf in _gathered(batches, LEFT_ROWS):
            keys, x = pdf["i"].to_numpy(), _stack(pdf["x"])
            for batch in _stored(path, block_rows):
                j, y = batch.column(0).to_pandas().to_numpy(), _stack(batch.column(1).to_pandas())
                for at in range(0, len(keys), block_rows):
                    part = slice(at, at + block_rows)
                    yield _long(keys[part], j, kernel.matrix(x[part], y))

    # the left is dealt out once, so that the pairs are spread however it lies
    return left.repartition(max(1, math.ceil(left.count() / LEFT_ROWS)), "i").mapInPandas(blocks, schema)


def sorted_positions(sample: DataFrame, key: str, label: str) -> DataFrame:
    """K9/L2: position of each row of a small sample ordered by (label, key).

    Only used on a ``limit``-bounded sample, so the single-partition window is
    bounded too."""
    w = Window.orderBy(label, key)
    return sample.withColumn("pos", F.row_number().over(w) - 1)


def heatmap(sample: DataFrame, key: str, vec: str, label: str, kernel: Kernel) -> DataFrame:
    """K9: the Gram of a small sample by class-sorted positions."""
    s = sorted_positions(sample, key, label)
    g = cross_gram(s, key, vec, s, key, vec, kernel)
    p = s.select(key, "pos")
    return (g.join(p.withColumnRenamed(key, "i").withColumnRenamed("pos", "pos_i"), "i")
            .join(p.withColumnRenamed(key, "j").withColumnRenamed("pos", "pos_j"), "j")
            .select("pos_i", "pos_j", "k"))


def rbf_gamma_scale(df: DataFrame, vec: str) -> float:
    """gamma='scale' = 1 / (p * var(X)) over all matrix entries."""
    dim = df.select(F.size(vec).alias("d")).first()["d"]
    v = df.select(F.explode(vec).alias("x")).agg(F.var_pop("x").alias("v")).first()["v"]
    return 1.0 / (dim * v) if v else 1.0
