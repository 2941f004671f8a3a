"""Projection, target cleaning, imputation and one-hot encoding.

Fitting runs as a few whole-table aggregations (one for medians, one for the
categorical value counts that give both modes and vocabularies); the fitted
parameters are tiny and are applied as literal expressions, so ``transform`` is
a narrow, codegen'd projection that also works on a streaming DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibra.functions.hashing import hash_uniform
from calibra.operators.order_stats import medians
from calibra.session import staged
from calibra.sources.files import nan_to_null
from calibra.spec import FeatureSpec

# Fill for a categorical whose values are all missing.
UNKNOWN = "Unknown"


def select_features(df: DataFrame, spec: FeatureSpec, keep_key: bool = True) -> DataFrame:
    """Curated columns in spec order; absent features skipped, absent target raises."""
    if spec.target not in df.columns:
        raise KeyError(f"no column {spec.target!r} to predict")
    cols = [c for c in spec.features if c in df.columns]
    return df.select(*([spec.key] if keep_key else []), *cols, spec.target)


def drop_null_target(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Rows with a target, target as int."""
    return (df.where(F.col(spec.target).isNotNull())
            .withColumn(spec.target, F.col(spec.target).cast("int")))


def inject_missing(df: DataFrame, cols: list[str], key: str, rate: float = 0.03,
                   seed: int = 42) -> DataFrame:
    """Blank each listed column independently with probability ``rate``."""
    out = df
    for c in cols:
        out = out.withColumn(c, F.when(hash_uniform(key, seed, c) < rate, F.lit(None))
                             .otherwise(F.col(c)))
    return out


def _is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


@dataclass
class CleanParams:
    """Fitted imputation + encoding parameters (bounded by the column count)."""

    fill: dict[str, object]               # column -> median (numeric) or mode (string)
    vocab: dict[str, list[str]]           # string categorical -> sorted values
    numeric: list[str]                    # columns imputed by median, in order
    strings: list[str]                    # string categoricals with dummies, in order

    @property
    def encoded_columns(self) -> list[str]:
        out = list(self.numeric)
        for c in self.strings:
            out += [f"{c}_{v}" for v in self.vocab[c][1:]]
        return out


def category_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, value, n) for every string categorical, one shuffle of partials."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], cols, "feature", "value")
    return long.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n"))


def modes_from_counts(counts: DataFrame) -> DataFrame:
    """Most frequent value per feature, smallest value on ties."""
    best = counts.groupBy("feature").agg(
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("value").alias("value"))).alias("b"))
    return best.select("feature", F.col("b.value").alias("mode"))


def fit_clean(df: DataFrame, spec: FeatureSpec) -> CleanParams:
    """Fit medians, modes and vocabularies on ``df``."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    feats = [c for c in spec.features if c in types]
    numeric = [c for c in feats if _is_numeric(types[c])]
    strings = [c for c in feats if c in spec.categorical and not _is_numeric(types[c])]
    other = [c for c in feats if c not in numeric and c not in strings]
    if other:
        raise TypeError(f"non-numeric, non-categorical features: {other}")
    fill: dict[str, object] = {}
    if numeric:
        for r in medians(df, numeric).collect():
            fill[r["feature"]] = r["median"]
    vocab: dict[str, list[str]] = {c: [] for c in strings}
    if strings:
        counts = staged(category_counts(df, strings), "categories")
        for r in modes_from_counts(counts).collect():
            fill[r["feature"]] = r["mode"]
        # a column per value is what is asked for; operators.sparse has rows whose
        # schema does not follow the vocabulary
        for r in counts.select("feature", "value").collect():
            vocab[r["feature"]].append(r["value"])
    for c in strings:
        fill.setdefault(c, UNKNOWN)
        # the fill value becomes a category when the column had NULLs
        vocab[c] = sorted(set(vocab[c]) | {fill[c]}) if vocab[c] else [fill[c]]
    return CleanParams(fill, {c: vocab[c] for c in strings}, numeric, strings)


def impute(df: DataFrame, params: CleanParams) -> DataFrame:
    """Fill NULLs with the fitted values (all-NULL numeric stays NULL)."""
    out = df
    for c, v in params.fill.items():
        if c in df.columns and v is not None:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out


def one_hot(df: DataFrame, params: CleanParams) -> DataFrame:
    """I4: dummies ``col_value`` for sorted categories, first dropped, int 0/1."""
    keep = [c for c in df.columns if c not in params.strings]
    dummies = []
    for c in params.strings:
        for v in params.vocab[c][1:]:
            dummies.append((F.col(c) == F.lit(v)).cast("int").alias(f"{c}_{v}"))
    return df.select(*keep, *dummies)


def clean(df: DataFrame, spec: FeatureSpec, fit_on: DataFrame | None = None,
          return_params: bool = False):
    """P2 -> impute -> one-hot.  ``fit_on`` defaults to all rows (the
    reference's behaviour); pass the train split for a leak-free fit."""
    df = nan_to_null(drop_null_target(df, spec))
    params = fit_clean(nan_to_null(fit_on) if fit_on is not None else df, spec)
    out = one_hot(impute(df, params), params)
    return (out, params) if return_params else out
