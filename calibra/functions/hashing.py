"""Deterministic per-row randomness.

``rand(seed)`` depends on how rows fall into partitions, so every random choice
here is a hash of (key, seed, purpose) instead: the same row gets the same
draw under any partitioning, after executor loss and in DuckDB (``md5`` and a
hex prefix decode exist in both engines).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_52 = float(2 ** 52)


def hash_hex(key: Column | str, seed: int, purpose: str | None = None) -> Column:
    """md5 hex of ``key:seed[:purpose]`` -- a uniform, portable order key."""
    k = F.col(key) if isinstance(key, str) else key
    parts = [k.cast("string"), F.lit(str(seed))]
    if purpose:
        parts.append(F.lit(purpose))
    return F.md5(F.concat_ws(":", *parts))


def hash_begin(key: Column | str, seed: int) -> Column:
    """What stands before the purpose in the text that ``hash_hex`` hashes."""
    k = F.col(key) if isinstance(key, str) else key
    return F.concat_ws(":", k.cast("string"), F.lit(str(seed)), F.lit(""))


def _number(hex_digits: Column) -> Column:
    return F.conv(F.substring(hex_digits, 1, 13), 16, 10).cast("long").cast("double") / F.lit(_TWO_52)


def uniform(text: Column) -> Column:
    """Uniform double in [0, 1) of the whole text that is hashed."""
    return _number(F.md5(text))


def hash_uniform(key: Column | str, seed: int, purpose: str | None = None) -> Column:
    """Uniform double in [0, 1) from the first 52 bits of ``hash_hex``."""
    return _number(hash_hex(key, seed, purpose))
