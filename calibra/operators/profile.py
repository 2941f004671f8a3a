"""Profiling aggregations (G1-G8, R2, L4): single-pass, map-side combined."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T



def shape(df: DataFrame) -> tuple[int, int]:
    """(rows, columns)."""
    return df.count(), len(df.columns)


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """G1: (label, n, share); the share window runs over the 2-row result."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def positive_rate(df: DataFrame, label: str) -> DataFrame:
    """Mean of a 0/1 label."""
    return df.agg(F.avg(F.col(label).cast("double")).alias("positive_rate"))


def missing_fraction(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """NULL or NaN share per column, one aggregation, sorted descending."""
    cols = cols or df.columns
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}

    def missing(c: str):
        gone = F.col(c).isNull()
        return gone | F.isnan(c) if kinds[c] in ("double", "float") else gone

    row = df.agg(*[F.avg(F.coalesce(missing(c), F.lit(False)).cast("double")).alias(c) for c in cols])
    return row.unpivot([], cols, "feature", "missing_frac").orderBy(F.desc("missing_frac"), "feature")


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson r for every pair (a < b), pairwise-complete, one aggregation.

    NaN is normalised to NULL first (``corr`` skips NULL pairs, not NaN).
    """
    clean = df.select(*[F.when(F.isnan(F.col(c).cast("double")), None)
                        .otherwise(F.col(c).cast("double")).alias(c) for c in cols])
    pairs = list(itertools.combinations(cols, 2))
    row = clean.agg(*[F.corr(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    parts = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("corr"))
             for i, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


def class_kde(df: DataFrame, col: str, label: str, grid: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian density of ``col`` per class on a ``grid``-point line.

    Bandwidth by Scott's rule (n^-1/5 times the sample std), grid from
    min - cut*h to max + cut*h.  Each batch adds up its own rows' part of the
    ``grid`` numbers of a class; only those are shuffled, never a value.
    """
    x = F.col(col).cast("double")
    d = df.select(F.col(label).alias("label"), x.alias("x")).where(F.col("x").isNotNull())
    st = d.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sd"),
        F.min("x").alias("lo"), F.max("x").alias("hi"))
    st = st.withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    # each row gets the statistics of its class, so classes may be any number;
    # the planner broadcasts them if they are few
    key = lambda c: F.col(c).eqNullSafe(F.col("label"))
    d = d.join(st.withColumnRenamed("label", "_label"), key("_label")).drop("_label", "sd")
    out = T.StructType([T.StructField("label", df.schema[label].dataType), T.StructField("g", T.IntegerType()),
                        T.StructField("grid_x", T.DoubleType()), T.StructField("density", T.DoubleType())])

    def partial(batches):
        """Each batch's part of the density at every grid point of each class."""
        for pdf in batches:
            for lab, part in pdf.groupby("label", dropna=False):
                x, (n, h, lo, hi) = part["x"], part[["n", "h", "lo", "hi"]].iloc[0]
                known = h > 0
                at = np.linspace(lo - cut * h, hi + cut * h, grid) if known else np.full(grid, lo)
                dens = np.zeros(grid)
                for part in np.array_split(x.to_numpy(), len(x) // 20_000 + 1) if known else ():
                    dens += np.exp(-0.5 * ((at[:, None] - part[None, :]) / h) ** 2).sum(1)
                # a constant class has no density: NULL
                yield pd.DataFrame({"label": lab, "g": np.arange(grid, dtype="int32"), "grid_x": at,
                                    "density": dens / (n * h * np.sqrt(2 * np.pi)) if known else None})

    parts = d.mapInPandas(partial, out)
    return parts.groupBy("label", "g").agg(F.first("grid_x").alias("grid_x"), F.sum("density").alias("density"))


def confusion(scored: DataFrame, label: str = "label", pred: str = "prediction",
              by: tuple[str, ...] = ("model",), weight: str | None = None) -> DataFrame:
    """2x2 counts per model in one pass (``weight``: pre-counted rows)."""
    y, p = F.col(label), F.col(pred)
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")

    def cell(cond):
        return F.coalesce(F.sum(F.when(cond, w).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"))

    return scored.groupBy(*by).agg(
        cell((y == 0) & (p == 0)).alias("tn"),
        cell((y == 0) & (p == 1)).alias("fp"),
        cell((y == 1) & (p == 0)).alias("fn"),
        cell((y == 1) & (p == 1)).alias("tp"))


# Display names of the two classes in the confusion table.
CLASS_NAMES = ("Survived", "Died")


def confusion_long(scored: DataFrame, label: str = "label", pred: str = "prediction",
                   by: str = "model", names: tuple[str, str] = CLASS_NAMES) -> DataFrame:
    """V6: (model, actual, predicted, n) with all four cells present."""
    c = confusion(scored, label, pred, (by,))
    cells = F.array(*[F.struct(F.lit(names[a]).alias("actual"), F.lit(names[p]).alias("predicted"),
                               F.col(col).alias("n"))
                      for a, p, col in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))])
    return c.select(by, F.explode(cells).alias("c")).select(by, "c.actual", "c.predicted", "c.n")
