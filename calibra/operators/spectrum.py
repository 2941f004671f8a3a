"""Eigenvalues of a kernel's Gram matrix without the Gram matrix (K8).

For an explicit map the N x N Gram matrix K = F F' and the d x d matrix F'F
have the same eigenvalues but for zeros.  F'F is a sum over rows: each task
adds up its rows, and partial sums are added by place.  Its size follows the
map (3^k for the cos2 kernel on k features), not the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Dimensions of an explicit map at most: the driver holds d x d numbers.
MAX_DIMENSIONS = 2187
#: A value below this share of the largest counts as zero.
ZERO = 1e-10


def gramian(rows: DataFrame, vec: str) -> tuple[np.ndarray, int]:
    """(F'F, rows).  Vectors of several lengths or with nulls raise."""
    first = rows.select(F.size(vec)).first()
    d = first[0] if first else 0
    if d > MAX_DIMENSIONS:
        raise ValueError(f"{d} dimensions exceed {MAX_DIMENSIONS}")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((d, d)), 0
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, d)
                total += x.T @ x
                n += len(x)
        # the upper half, row by row: a place holds the numbers of one row
        for i in range(d):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d - i, i * d) + np.arange(i, d)), pa.array(total[i, i:])], names=["place", "value"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([float(n)])], names=["place", "value"])

    sums = rows.select(F.col(vec)).mapInArrow(add, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    place, value = sums["place"].to_numpy(), sums["value"].to_numpy()
    out = np.zeros(d * d)
    real = place >= 0
    out[place[real]] = value[real]
    out = out.reshape(d, d)
    return out + np.triu(out, 1).T, int(value[~real].sum())


def eigenvalue_range(rows: DataFrame, vec: str) -> DataFrame:
    """One row: ``n``, ``trace``, ``frobenius2`` (the sum of the squares of all
    entries of the Gram matrix), ``largest``, ``smallest`` (its smallest value
    that is not zero), ``rank`` and ``smallest_of_all`` (0 where the rank is
    below the rows).  An empty table gives zeros."""
    g, n = gramian(rows, vec)
    values = np.linalg.eigvalsh(g) if n else np.zeros(0)
    real = values[values > ZERO * values.max(initial=0.0)] if len(values) else values
    row = (n, float(np.trace(g)), float((g * g).sum()), float(values.max(initial=0.0)), float(real.min()) if len(real) else 0.0,
           len(real), float(real.min()) if len(real) and len(real) >= n else 0.0)
    return rows.sparkSession.createDataFrame(
        [row], "n long, trace double, frobenius2 double, largest double, smallest double, rank int, smallest_of_all double")
