"""Standardisation and univariate feature scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibra.operators.order_stats import unpivot_numeric


def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """N1 fit: one aggregation -> (feature, mean, std) with population std."""
    aggs = []
    for c in cols:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"m{len(aggs)}"),
                 F.stddev_pop(F.col(c).cast("double")).alias(f"m{len(aggs) + 1}")]
    row = df.agg(*aggs)
    parts = [F.struct(F.lit(c).alias("feature"), F.col(f"m{2 * i}").alias("mean"),
                      F.col(f"m{2 * i + 1}").alias("std")) for i, c in enumerate(cols)]
    return row.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


def apply_scaler(df: DataFrame, params: DataFrame | dict) -> DataFrame:
    """N1 transform: (x - mean) / std, std 0 -> 1.  Params are one row per
    feature (bounded), applied as literals: a narrow projection."""
    if isinstance(params, DataFrame):
        params = {r["feature"]: (r["mean"], r["std"]) for r in params.collect()}
    out = []
    for c in df.columns:
        if c in params:
            m, s = params[c]
            s = 1.0 if (s is None or s == 0.0) else s
            out.append(((F.col(c).cast("double") - F.lit(m)) / F.lit(s)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def standardize(df: DataFrame, cols: list[str], fit_filter=None) -> DataFrame:
    """Fit on ``df.where(fit_filter)`` (e.g. the train split), apply to all rows."""
    fit_df = df.where(fit_filter) if fit_filter is not None else df
    return apply_scaler(df, fit_scaler(fit_df, cols))


def anova_f(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """One-way ANOVA F per feature against the class.

    Unpivot, then per (feature, class) count/mean/var partials -- one shuffle
    of features x classes rows -- then F = (SSB/(K-1)) / (SSW/(N-K)) with
    SSB = sum n (m - grand mean)^2, which keeps its digits on shifted data.
    NULL and NaN are skipped.  A feature without spread inside the classes but
    between them has F = infinity; one without any spread, one class, or as
    many classes as rows, has none (NULL).
    Returns (feature, idx, f_score); idx is the position in ``cols``.
    """
    long = unpivot_numeric(df, [label], cols).where(F.col("x").isNotNull() & ~F.isnan("x"))
    a = long.groupBy("feature", label).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    # one row per feature and class: a window over the classes of a feature
    w = Window.partitionBy("feature")
    a = a.withColumn("grand", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    dev = F.col("m") - F.col("grand")
    b = a.groupBy("feature").agg(
        F.sum("n").alias("nn"), F.sum(F.col("n") * dev * dev).alias("ssb"),
        F.sum(F.col("n") * F.col("v")).alias("ssw"), F.count(F.lit(1)).alias("k"))
    between = F.try_divide(F.col("ssb"), (F.col("k") - 1).cast("double"))
    within = F.try_divide(F.col("ssw"), (F.col("nn") - F.col("k")).cast("double"))
    f = (F.when(between.isNull() | within.isNull(), F.lit(None).cast("double"))
         .when(within > 0, F.try_divide(between, within))
         .when(between > 0, F.lit(float("inf"))))
    idx = F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("feature")) - 1
    return b.select("feature", idx.cast("int").alias("idx"), f.alias("f_score"))


def top_k_features(scores: DataFrame, k: int) -> DataFrame:
    """The k best F scores (ties -> later column), back in column order."""
    w = Window.orderBy(F.desc_nulls_last("f_score"), F.desc("idx"))
    # one row per feature: a bounded single-partition window
    ranked = scores.withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k).orderBy("idx")


def select_top_k(df: DataFrame, cols: list[str], label: str, k: int,
                 keep: list[str] | None = None, fit_filter=None) -> tuple[DataFrame, list[str]]:
    """P4 + N3: fit scores (optionally on a split), keep the chosen columns."""
    fit_df = df.where(fit_filter) if fit_filter is not None else df
    chosen = [r["feature"] for r in top_k_features(anova_f(fit_df, cols, label), k).collect()]
    return df.select(*(keep or []), *chosen), chosen
