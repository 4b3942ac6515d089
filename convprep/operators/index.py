"""Row order without a global window: P4 dense index, T4 shuffle order,
W6 epoch batches.

``dense_index`` is the two-level index: the table is range-partitioned on
the order key (Spark samples the key, so a hot leading value is split
across buckets as long as the full key is unique), each bucket is sorted
locally and numbered by ``monotonically_increasing_id``, and that stage is
written once to the shared checkpoint folder. The per-bucket sizes (one row
per bucket and group) give running offsets, and a join of those offsets makes
the numbers global; it is a broadcast join while their number allows one. No step funnels the table
through one task. Pass narrow frames (keys and what must travel with them):
the bucketed stage is written.

The order key must be unique: ties would be numbered in arbitrary order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convprep.functions.random import md5_key
from convprep.session import stored

_LOCAL_BITS = 33  # monotonically_increasing_id: partition index << 33 | row


def _sort_exprs(order: Sequence) -> list[Column]:
    out = []
    for o in order:
        out.append(F.col(o).asc() if isinstance(o, str) else o)
    return out


def dense_index(
    df: DataFrame,
    order: Sequence,
    out: str = "row_id",
    partition_by: Sequence[str] = (),
    num_buckets: int | None = None,
) -> DataFrame:
    """Number rows 0..n-1 in ``order`` (restarting per ``partition_by``).

    ``order`` holds column names (ascending) or sort expressions such as
    ``F.desc("n")``. The offset table has at most ``buckets + groups`` rows.
    Without ``partition_by`` that is the number of buckets, and it is
    broadcast; with it Spark joins the table as its size in bytes allows. Null groups are numbered like others.
    """
    parts = list(partition_by)
    sort = [F.col(p).asc() for p in parts] + _sort_exprs(order)
    # Without an explicit count, AQE may coalesce adjacent ranges to its
    # advisory size (still in key order), so small tables do not get one
    # task per configured shuffle partition.
    ranged = df.repartitionByRange(int(num_buckets), *sort) if num_buckets else df.repartitionByRange(*sort)
    local = (
        ranged
        .sortWithinPartitions(*sort)
        .withColumn("_cp_mid", F.monotonically_increasing_id())
        .withColumn("_cp_b", F.shiftright("_cp_mid", _LOCAL_BITS).cast("int"))
        .withColumn("_cp_local", F.col("_cp_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
        .drop("_cp_mid")
    )
    # Written once: the range bounds come from a sample whose seed depends on
    # the exchange instance, so the sizes and the numbering must read one
    # materialized stage, not two exchanges (column pruning can stop Spark
    # from reusing one). The written stage also cuts the lineage.
    local = stored(local, "index")
    keys = parts + ["_cp_b"]
    sizes = local.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_cp_n"), F.min("_cp_local").alias("_cp_first")
    )
    before = Window.partitionBy(*parts).orderBy("_cp_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_cp_first", F.coalesce(F.sum("_cp_n").over(before), F.lit(0)).alias("_cp_off"))
    if not parts:
        offsets = F.broadcast(offsets)  # a row per bucket
    on = reduce(and_, [F.col(f"l.`{k}`").eqNullSafe(F.col(f"o.`{k}`")) for k in keys])
    number = (F.col("o._cp_off") + F.col("l._cp_local") - F.col("o._cp_first")).cast("bigint")
    return local.alias("l").join(offsets.alias("o"), on).select(
        *[F.col(f"l.`{c}`") for c in df.columns if c != out], number.alias(out))


def shuffle_key(seed, epoch, row_id: str = "row_id") -> Column:
    """T4: the repeatable shuffle order key ``md5(seed:epoch:row_id)``."""
    return md5_key(seed, epoch, row_id)


def shuffle_rows(df: DataFrame, seed: int, epoch: int = 0, row_id: str = "row_id", out: str = "rn") -> DataFrame:
    """T4: a repeatable permutation: ``out`` is the position in the order of
    ``md5(seed:epoch:row_id)`` (ties broken by ``row_id``)."""
    keyed = df.withColumn("_cp_key", md5_key(seed, F.lit(epoch), row_id))
    return dense_index(keyed, ["_cp_key", row_id], out=out).drop("_cp_key")


ROW = "_cp_row"  # surrogate row id


def with_row_id(df: DataFrame) -> DataFrame:
    """``df`` with a surrogate id of each row in :data:`ROW`.

    The ids are given as the rows are written, once, to the shared folder: all
    that reads the result sees the same id for a row, and rows with null or
    repeated keys are rows of their own. An id says nothing about order, and
    another run may give other ids.
    """
    return stored(df.drop(ROW).withColumn(ROW, F.monotonically_increasing_id()), "rows")


def assign_batches(
    df: DataFrame,
    batch_size: int,
    epochs: int,
    seed: int,
    row_id: str = "row_id",
    num_buckets: int | None = None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """One shuffled pass over all rows per epoch, cut into batches.

    Adds ``epoch, batch_id, pos_in_batch`` (the last batch may be short).
    The order is ``md5(seed:epoch:row_id)``, so each epoch is a fresh,
    repeatable permutation. Rows that share ``row_id`` (or have none) go by the
    columns ``ties`` and at last by their surrogate id, if there is one. Only
    what ``df`` holds is range-shuffled; pass narrow frames and join
    wide columns back by the surrogate id (:func:`with_row_id`,
    :func:`convprep.operators.examples.batch_examples`).
    """
    if batch_size <= 0 or epochs <= 0:
        raise ValueError("batch_size and epochs must be positive")
    keyed = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn(
        "_cp_key", md5_key(seed, "epoch", row_id)
    )
    last = [ROW] if ROW in df.columns else []
    ranked = dense_index(
        keyed, ["_cp_key", row_id, *ties, *last], out="_cp_rn", partition_by=["epoch"], num_buckets=num_buckets
    )
    return (
        ranked.withColumn("batch_id", F.floor(F.col("_cp_rn") / batch_size).cast("bigint"))
        .withColumn("pos_in_batch", (F.col("_cp_rn") % batch_size).cast("bigint"))
        .drop("_cp_key", "_cp_rn")
    )
