"""Seeded, partition-independent randomness from ``md5``.

``rand()`` depends on partitioning and task retries; a hash of
``seed:key:...`` does not, so every draw is repeatable anywhere in the plan
and in the DuckDB oracle (``md5`` and a hex cast give the same numbers).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hex digits = 52 bits, exactly representable in a double.
_HEX_DIGITS = 13
_SCALE = float(2**52)


def _str(c) -> Column:
    if isinstance(c, Column):
        return c.cast("string")
    if isinstance(c, str):
        return F.col(c).cast("string")
    return F.lit(str(c))


def md5_key(*parts) -> Column:
    """``md5(concat_ws(':', parts...))``; plain Python values are literals,
    strings name columns."""
    return F.md5(F.concat_ws(":", *[_str(p) for p in parts]))


def lit_key(value) -> Column:
    """A literal part for :func:`md5_key` (a string that is not a column)."""
    return F.lit(str(value))


def uniform(*parts) -> Column:
    """Uniform double in [0, 1) from the first 52 bits of ``md5_key``."""
    hexpart = F.substring(md5_key(*parts), 1, _HEX_DIGITS)
    return F.conv(hexpart, 16, 10).cast("bigint") / F.lit(_SCALE)


def uniform_sql(*parts_sql: str) -> str:
    """The DuckDB form of :func:`uniform` for oracle queries."""
    joined = ", ".join(parts_sql)
    return f"(('0x' || substr(md5(concat_ws(':', {joined})), 1, {_HEX_DIGITS}))::bigint / {_SCALE!r})"
