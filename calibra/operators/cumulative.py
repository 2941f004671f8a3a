"""Distributed running sums (the window frame ROWS UNBOUNDED PRECEDING).

A window ordered over a whole group sorts that group in one task; when one
group is the whole table (a single model's scores) that is one task for
everything.  ``dist_cumsum`` instead

1. range-partitions on (group, order) and sorts inside each partition,
2. adds per-partition running sums with an Arrow batch function (narrow),
3. aggregates per-(partition, group) totals -- at most partitions + groups
   rows -- and turns them into offsets with a small window,
4. adds the offsets back with a join that is broadcast only when the totals
   table is counted to be under ``BROADCAST_ROWS``.

A hot group simply spans many range partitions, so skew costs nothing extra.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibra.session import staged

BROADCAST_ROWS = 200_000


def _sort_cols(by: list[str], order: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(b).asc() for b in by] + [
        F.col(c).asc() if asc else F.col(c).desc() for c, asc in order]


def dist_cumsum(df: DataFrame, by: list[str], order: list[tuple[str, bool]],
                sums: dict[str, str], num_partitions: int | None = None) -> DataFrame:
    """Add inclusive running sums ``{out_name: source_col}`` within ``by``
    groups, in ``order`` (list of (column, ascending)).  Ties in the order are
    summed in an arbitrary but fixed sequence, so order by unique keys."""
    sort = _sort_cols(by, order)
    # without a count, the adaptive planner sizes the partitions by their bytes
    ranged = df.repartitionByRange(num_partitions, *sort) if num_partitions else df.repartitionByRange(*sort)
    ranged = ranged.sortWithinPartitions(*sort)
    src = list(sums.values())
    outs = list(sums.keys())
    schema = T.StructType(ranged.schema.fields
                          + [T.StructField("_pid", T.IntegerType(), False)]
                          + [T.StructField(f"_l_{o}", T.DoubleType(), True) for o in outs])

    def local(it):
        # rows arrive sorted by (by, order): groups are contiguous, so only the
        # first group of a batch can continue the previous batch's last group
        pid = TaskContext.get().partitionId()
        last_key, last_vals = None, None
        for pdf in it:
            if pdf.empty:
                continue
            pdf = pdf.reset_index(drop=True)
            gid = (pdf.groupby(by, sort=False, dropna=False).ngroup().values
                   if by else np.zeros(len(pdf), dtype=np.int64))
            first_key = tuple(pdf.loc[0, by]) if by else ()
            cont = last_key is not None and first_key == last_key
            for j, (o, s) in enumerate(zip(outs, src)):
                vals = pdf[s].astype("float64").fillna(0.0)
                cs = vals.groupby(gid).cumsum().values
                if cont:
                    cs = cs + np.where(gid == gid[0], last_vals[j], 0.0)
                pdf[f"_l_{o}"] = cs
            last_key = tuple(pdf.loc[len(pdf) - 1, by]) if by else ()
            last_vals = [pdf[f"_l_{o}"].iloc[-1] for o in outs]
            pdf["_pid"] = pid
            yield pdf[[f.name for f in schema.fields]]

    # used twice below; written, so that nothing is left in a cache
    loc = staged(ranged.mapInPandas(local, schema), "cumsum")
    tot = loc.groupBy("_pid", *by).agg(*[F.sum(F.col(s).cast("double")).alias(f"_t_{o}")
                                        for o, s in zip(outs, src)])
    w = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("_pid", *by, *[F.coalesce(F.sum(f"_t_{o}").over(w), F.lit(0.0)).alias(f"_o_{o}")
                                    for o in outs])
    # the offsets table has at most (partitions + groups) rows; it is counted
    # (a cheap job over the written partials) and broadcast only under the
    # bound, so the big side is never shuffled for this join
    keys = ["_pid", *by]
    small = off.count() <= BROADCAST_ROWS
    off = off.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], *[f"_o_{o}" for o in outs])
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    j = loc.join(F.broadcast(off) if small else off, on, "left")
    return j.select(*[F.col(c) for c in df.columns],
                    *[(F.col(f"_l_{o}") + F.col(f"_o_{o}")).alias(o) for o in outs])
