"""Exact order statistics without a one-task sort.

``select_ranks`` finds, per group, the row at given 1-based ranks of an
ordering.  Spark's exact ``percentile``/``median`` keep every distinct value of
a group in one aggregation buffer, and an unpartitioned window sorts the whole
table in one task; neither survives 100 TB.  Here:

1. a ``percentile_approx`` grid per group (a bounded sketch, map-side merged)
   brackets each target rank between two grid values;
2. one counting pass gives the exact number of rows below the bracket and in
   it, and checks that the rank lies inside;
3. the bracket's rows are counted by value (a value that a third of the rows
   share is one row from here on), and distributed running sums over those
   counts (``dist_cumsum``) find the value at the rank, whatever the size of
   the bracket.  Equal values are told apart by the tie-break columns.

The answer is exact: the sketch only chooses *where* to look.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.operators.cumulative import dist_cumsum
from calibra.session import cut_lineage

RankFn = Callable[[Column], Column]


def _bracket(q: Column, k: Column, n: Column, grid: int) -> tuple[Column, Column]:
    """Grid values that surely enclose rank ``k`` of ``n`` (1 grid step margin)."""
    idx = (k.cast("double") - 1.0) / F.greatest(n - 1, F.lit(1)).cast("double") * grid
    lo_i = F.greatest(F.floor(idx).cast("int") - 1, F.lit(0))
    hi_i = F.least(F.ceil(idx).cast("int") + 1, F.lit(grid))
    return F.element_at(q, lo_i + 1), F.element_at(q, hi_i + 1)


def select_ranks(df: DataFrame, group_cols: list[str], value_col: str,
                 ranks: dict[str, RankFn], tiebreak: tuple[str, ...] = (),
                 order_col: str | None = None, grid: int = 1000,
                 accuracy: int = 100_000) -> DataFrame:
    """Rows at given ranks, per group.

    ``value_col`` is numeric and defines the order (NULL and NaN skipped); rows
    equal in it are ordered by ``order_col`` (default: the value itself) then
    ``tiebreak``.  ``ranks`` maps a tag to a function of the group size ``n``
    giving a 1-based rank.  Returns ``group_cols + [tag, group_n, rank, value,
    order_col?, *tiebreak]``.
    """
    # without groups, a constant stands in: all joins below have a key
    g = list(group_cols) or ["_all"]
    extra = ([order_col] if order_col else []) + [c for c in tiebreak if c != order_col]
    base = df if group_cols else df.withColumn("_all", F.lit(0))
    base = (base.select(*[F.col(c) for c in g], F.col(value_col).cast("double").alias("_v"),
                        *[F.col(c) for c in extra])
            .where(F.col("_v").isNotNull() & ~F.isnan("_v")))
    percs = [i / grid for i in range(grid + 1)]
    sk = base.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"),
                              F.percentile_approx("_v", percs, accuracy).alias("_q"))
    tags = F.array(*[F.struct(F.lit(t).alias("tag"), fn(F.col("_n")).cast("long").alias("k"))
                     for t, fn in ranks.items()])
    tg = (sk.select(*g, "_n", "_q", F.explode(tags).alias("_t"))
          .select(*g, F.col("_t.tag").alias("tag"), "_n", F.col("_t.k").alias("_k"), "_q")
          .where((F.col("_k") >= 1) & (F.col("_k") <= F.col("_n"))))
    lo, hi = _bracket(F.col("_q"), F.col("_k"), F.col("_n"), grid)
    t, small = _targets(tg.select(*g, "tag", "_n", "_k", lo.alias("_lo"), hi.alias("_hi")))
    t, small = _targets(_recount(base, t, g, small))
    _check(t)

    cand = _join(base, t.select(*g, "tag", "_n", "_k", "_lo", "_hi", "_below"), g, small).where(
        (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    counts = cand.groupBy(*g, "tag", "_n", "_k", "_below", "_v", *extra).agg(F.count(F.lit(1)).alias("_c"))
    run = dist_cumsum(counts, [*g, "tag"], [("_v", True), *((c, True) for c in extra)], {"_upto": "_c"})
    at = F.col("_k") - F.col("_below")
    out = run.where((F.col("_upto") >= at) & (F.col("_upto") - F.col("_c") < at))
    return out.select(*group_cols, "tag", F.col("_n").alias("group_n"), F.col("_k").alias("rank"),
                      F.col("_v").alias("value"), *extra)


LOCAL_TARGETS = 100_000


def _targets(t: DataFrame) -> tuple[DataFrame, bool]:
    """Cut the lineage of the (group, tag) target table, and tell whether it is
    small enough (counted) to be broadcast.

    It has one row per group and tag, so it is normally tiny and is rebuilt
    from its rows (one job); a large one goes through a reliable checkpoint and
    is joined by a shuffle."""
    rows = t.limit(LOCAL_TARGETS + 1).collect()
    if len(rows) <= LOCAL_TARGETS:
        return t.sparkSession.createDataFrame(rows, t.schema), True
    return cut_lineage(t), False


def _check(t: DataFrame) -> None:
    """Raise if a rank lies outside its bracket: its row would be missing."""
    inside = (F.col("_below") < F.col("_k")) & (F.col("_k") <= F.col("_below") + F.col("_in"))
    if t.where(~inside).limit(1).count():
        raise ArithmeticError("a rank lies outside its bracket: raise the accuracy of the sketch")


def _join(base: DataFrame, t: DataFrame, g: list[str], small: bool) -> DataFrame:
    """Rows with their group's targets; NULL groups match each other."""
    right = t.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(g)], *[c for c in t.columns if c not in g])
    on = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(g)]
    return base.join(F.broadcast(right) if small else right, on).drop(*[f"_g{i}" for i in range(len(g))])


def _recount(base: DataFrame, t: DataFrame, g: list[str], small: bool) -> DataFrame:
    """Exact rows below and inside each bracket (one pass over the rows)."""
    j = _join(base, t, g, small)
    return j.groupBy(*g, "tag", "_n", "_k", "_lo", "_hi").agg(
        F.sum((F.col("_v") < F.col("_lo")).cast("long")).alias("_below"),
        F.sum(((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))).cast("long")).alias("_in"))


def unpivot_numeric(df: DataFrame, ids: list[str], cols: list[str],
                    name: str = "feature", value: str = "x") -> DataFrame:
    """Wide -> long with every value cast to double (R2)."""
    wide = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    return wide.unpivot(ids, cols, name, value)


def medians(df: DataFrame, cols: list[str], approx: bool = False,
            accuracy: int = 100_000, **kw) -> DataFrame:
    """Exact median per column, even count -> mean of the two middle values.

    ``approx=True`` returns ``percentile_approx`` instead: one pass, an element
    of the column within n/accuracy ranks of the middle (not a midpoint).
    Returns ``(feature, median)``; all-NULL columns give no row.
    """
    long = unpivot_numeric(df, [], cols)
    if approx:
        return (long.where(F.col("x").isNotNull()).groupBy("feature")
                .agg(F.percentile_approx("x", 0.5, accuracy).alias("median")))
    picked = select_ranks(long, ["feature"], "x", {
        "lo": lambda n: F.floor((n + 1) / 2),
        "hi": lambda n: F.floor(n / 2) + 1,
    }, accuracy=accuracy, **kw)
    return picked.groupBy("feature").agg(F.avg("value").alias("median"))
