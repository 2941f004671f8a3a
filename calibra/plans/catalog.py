"""Registry of queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.plans import oracle
from calibra.plans import queries as Q

_NAMES = [
    "curated_projection", "drop_null_target", "head", "clip_columns", "inject_missing",
    "missing_fraction", "missing_fraction_nan", "impute_median", "impute_median_discrete", "impute_median_appended", "impute_binary",
    "impute_mode", "one_hot", "clean", "clean_nan",
    "split_hash", "split_exact", "split_exact_fractions", "split_balance", "scale_params", "standardize",
    "anova_f", "anova_f_lineitem", "anova_f_shifted", "top_k_features", "top_k_perfect", "select_top_k",
    "sparse_entries", "sparse_moments", "sparse_f_scores",
    "class_balance", "positive_rate", "corr_matrix", "class_kde", "confusion",
    "binary_metrics", "one_class_metrics", "roc_auc", "average_precision", "roc_curve", "pr_curve",
    "kernel_stats", "kernel_blocks", "cos2_features", "cos2_kernel_stats", "cos2_kernel_blocks",
    "cross_gram", "cross_gram_cos2", "kernel_sorted", "cos2_spectrum", "cos2_eigenvalues",
    "rbf_fourier_features", "cos2_fourier_features", "rbf_fourier_blocks",
    "logreg_scores", "logreg_gradient", "platt_gradient", "loss_history", "forest_scores", "svm_rbf_scores", "cos2_svm_scores",
    "benchmark_report",
    "upsert_results", "results_store", "flatten_results", "model_ranking", "metric_pivot", "metric_bars",
    "readme_table", "results_json",
    "synthetic_table", "synthetic_label", "csv_roundtrip", "prepared_roundtrip", "source_fallback",
    "gather_rows", "gather_rows_bucketed", "kernel_test_sample", "balanced_subsample", "uniform_subsample", "large_subsample", "table_shape",
    "confusion_table", "streaming_standardize", "synthetic_prepared", "synthetic_benchmark_report",
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: getattr(Q, n) for n in _NAMES}


def oracle_sql() -> dict[str, str]:
    sql = oracle.oracle_sql()
    return {n: sql[n] for n in _NAMES if n in sql}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    df = Q.standardize(spark, sf)
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 6).alias("positive_rate"),
        F.round(F.avg("acctbal"), 6).alias("mean_acctbal_z"),
        F.round(F.avg("price"), 6).alias("mean_price_z"))
