"""Which groups are too large for one task, found from the data.

A frequent-items sketch of the groups (Spark's ``approx_top_k``, merged from one
small sketch per task) names the groups that may hold more rows than a task
should sort. Their rows take the form of an operator that splits a group over
many tasks, all others the window form; both give the same answers, so a group
that the sketch judges wrongly costs time only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY_ROWS = 1_000_000  # rows of a group that one task sorts
NAMED = 1_000  # groups that the sketch names
TRACKED = 65_536  # groups that it counts at a time


def _hash(group: list[str]) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in group])


def heavy_groups(df: DataFrame, group: list[str], rows: int = HEAVY_ROWS) -> list[int] | None:
    """Hashes of the groups of more than ``rows`` rows; None if they are more than
    can be named, so that any group may be one.

    One pass over the group columns, of which one row comes back. A null group is
    a group. The sketch may miss a group of less than about a 10,000th of all
    rows, which a task of a table so large can still sort.
    """
    top = df.select(_hash(group).alias("h")).agg(F.expr(f"approx_top_k(h, {NAMED}, {TRACKED})")).first()[0]
    heavy = [x["item"] for x in top if x["count"] > rows]
    return None if len(heavy) == NAMED else heavy


def by_weight(
    df: DataFrame, group: list[str], window: Callable[[DataFrame], DataFrame], split: Callable[[DataFrame], DataFrame],
    hot_groups: bool | None, rows: int = HEAVY_ROWS,
) -> DataFrame:
    """``window(df)`` or ``split(df)`` as ``hot_groups`` says; with None, ``split`` for
    the rows of heavy groups and ``window`` for the rest. The column types are those
    of ``window`` in every case but an explicit ``hot_groups=True``."""
    if hot_groups is not None:
        return split(df) if hot_groups else window(df)
    heavy = heavy_groups(df, group, rows)
    if heavy == []:
        return window(df)
    is_heavy = F.lit(True) if heavy is None else _hash(group).isin(heavy)
    light = window(df.where(~is_heavy))
    parted = split(df.where(is_heavy))
    return light.unionByName(parted.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in light.schema]))
