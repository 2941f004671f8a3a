"""Scalar column functions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sigmoid(x: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b, 0.0 when b is 0 (the ``zero_division=0`` convention)."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def clip(x: Column | str, lo: float | None, hi: float | None) -> Column:
    """Clip to [lo, hi]; NULL stays NULL (``greatest``/``least`` skip NULLs)."""
    c = _c(x)
    out = c
    if hi is not None:
        out = F.least(out, F.lit(hi))
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    return F.when(c.isNull(), F.lit(None)).otherwise(out)


def fmt_num(x: Column | str, digits: int = 3) -> Column:
    """Fixed-point text, half-up at ``digits``; a missing value prints ``nan``.

    Built from integer arithmetic rather than a printf so that the text is the
    same in every engine (printf implementations round ties differently)."""
    c = _c(x).cast("double")
    p = 10 ** digits
    scaled = F.floor(F.abs(c) * p + F.lit(0.5)).cast("long")
    text = F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")),
                    (scaled / p).cast("long").cast("string"), F.lit("."),
                    F.lpad((scaled % p).cast("string"), digits, "0"))
    return F.when(c.isNull() | F.isnan(c), F.lit("nan")).otherwise(text)


def round6(x: Column | str) -> Column:
    return F.round(_c(x).cast("double"), 6)
