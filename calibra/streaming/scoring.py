"""Apply fitted preparation parameters to a stream and drain it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from calibra.operators import prepare as P
from calibra.operators import scale as N
from calibra.operators import split as E
from calibra.session import scratch_path


def prepare_stream(stream: DataFrame, params: P.CleanParams, scaler: dict,
                   key: str, seed: int = 42) -> DataFrame:
    """Impute + one-hot + hash split + standardise with batch-fitted params.

    Every step is a per-row projection, so no state is kept between
    micro-batches."""
    out = P.one_hot(P.impute(stream, params), params)
    out = E.split_hash(out, key, seed)
    return N.apply_scaler(out, scaler)


def run_available_now(df: DataFrame, out_path: str | None = None) -> str:
    """Drain everything currently available into parquet in the shared
    checkpoint folder (exactly-once file sink + checkpoint); returns the path.
    Nothing is collected on the driver."""
    spark: SparkSession = df.sparkSession
    out_path = out_path or scratch_path(spark, "stream-out")
    q = (df.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", scratch_path(spark, "stream-log"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out_path
