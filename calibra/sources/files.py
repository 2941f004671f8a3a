"""File sources and sinks.

CSV is read with an explicit schema (inference only on request), ``NA`` as
the missing marker and NaN normalised to NULL; prepared data is written as
parquet partitioned by split so that a later read prunes partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark NULL and NaN differ (median ranks NaN last, corr turns NaN):
    normalise floating NaN to NULL at the source."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.when(F.isnan(f.name), F.lit(None)).otherwise(F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             null_value: str = "NA") -> DataFrame:
    """Header CSV; ``schema=None`` is the explicit discovery mode."""
    r = spark.read.option("header", True).option("nullValue", null_value).option("nanValue", "NaN")
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return nan_to_null(r.csv(path))


def write_csv(df: DataFrame, path: str, null_value: str = "NA") -> None:
    """Header CSV, no index column (overwrite)."""
    df.write.mode("overwrite").option("header", True).option("nullValue", null_value).csv(path)


def write_prepared(df: DataFrame, path: str, split_col: str = "split") -> None:
    """S3: prepared rows as parquet, one directory per split."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def read_prepared(spark: SparkSession, path: str, split: str | None = None,
                  split_col: str = "split") -> DataFrame:
    """S3 read-back; a split filter prunes to one directory."""
    df = spark.read.parquet(path)
    return df.where(F.col(split_col) == split) if split else df


def _absent(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def resolve_source(spark: SparkSession, paths: list[str], fallback=None,
                   force_fallback: bool = False) -> DataFrame:
    """The first path that exists, else ``fallback(spark)`` (e.g. the
    synthetic generator).  Only absence is passed over: a path that exists but
    cannot be read raises.  Downloading is not part of this engine."""
    for p in [] if force_fallback else paths:
        if not _absent(spark, p):
            return read_csv(spark, p) if p.endswith(".csv") else nan_to_null(spark.read.parquet(p))
    if fallback is None:
        raise FileNotFoundError(f"none of these sources exists: {paths}")
    return fallback(spark)
