"""Prepared data bucketed by its key.

Two tables bucketed by their keys into the same number of buckets join without
a shuffle: the rows are shuffled once, when they are written, and every later
gather or alignment by key reads bucket against bucket.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from calibra.session import scratch_path


def bucketed(df: DataFrame, key: str, buckets: int, path: str | None = None, name: str | None = None) -> DataFrame:
    """Write ``df`` in ``buckets`` buckets of ``key``, sorted inside, as the
    table ``name`` under ``path`` (default: scratch tables of the shared
    folder), and read it back.  One task writes one bucket, so a bucket is one
    file and its order is kept."""
    spark = df.sparkSession
    name = name or f"bucketed_{uuid.uuid4().hex}"
    (df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
     .option("path", path or scratch_path(spark, name)).saveAsTable(name))
    return spark.table(name)
