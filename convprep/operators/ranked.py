"""Running sums and positions inside groups that may be huge.

A window ``partitionBy(group).orderBy(...)`` sorts each group in one task;
when one group can hold a third of all rows that task is the job. Here the
rows are range-partitioned on ``(group, score desc, candidate)`` (Spark
samples the key, so a hot group spreads over many partitions), each
partition is sorted and gets its local running sums in pandas without a
further exchange (``mapInPandas`` keeps the partitioning), the stage is
written once, and per-(group, bucket) offsets from a small aggregate make the
sums global. A group's rows span consecutive buckets, so the offset table
has at most ``buckets + groups`` rows; it is joined without a broadcast hint
(AQE broadcasts it at run time when small).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convprep.session import cut_lineage, ship_package


def _g(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def join_groups(rows: DataFrame, stats: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the further columns of ``stats``, one row per group; null
    groups join like any other."""
    on = None
    for c in cols:
        same = F.col(f"_l.`{c}`").eqNullSafe(F.col(f"_r.`{c}`"))
        on = same if on is None else on & same
    own = [F.col(f"_l.`{c}`") for c in rows.columns]
    return rows.alias("_l").join(stats.alias("_r"), on, how).select(
        *own, *[F.col(f"_r.`{c}`") for c in stats.columns if c not in cols])


def _segments(kdf: pd.DataFrame) -> pd.Series:
    """Running number of the groups of sorted rows; nulls and NaN are one group each."""
    before = kdf.shift()
    new = (kdf.ne(before) & ~(kdf.isna() & before.isna())).any(axis=1)
    new.iloc[0] = True
    return new.cumsum()


def _key(row: pd.Series) -> tuple:
    return tuple(None if pd.isna(x) else x for x in row)


def ranked_running_sum(
    df: DataFrame, group, cand, score: str, weight: str | None = None
) -> DataFrame:
    """Adds ``_rn`` (1-based position in descending ``score`` order, ties by
    ``cand``), ``_cum`` (running sum of ``weight`` up to the row) and
    ``_prev`` (the sum before it; 0 for the first row) within each group.
    Without ``weight`` the sums count rows. ``(group, cand)`` must be unique:
    the order, and so the written stage, is then the same on every run."""
    ship_package(df.sparkSession)  # the running sums run in executor Python workers
    gcols, ccols = _g(group), _g(cand)
    w = weight or "_cp_one"
    staged = df if weight else df.withColumn("_cp_one", F.lit(1.0))
    staged = staged.withColumn("_cp_w", F.col(w).cast("double"))
    sort = [F.col(c).asc() for c in gcols] + [F.col(score).desc()] + [F.col(c).asc() for c in ccols]
    ranged = staged.repartitionByRange(*sort).sortWithinPartitions(*sort)
    schema = T.StructType(ranged.schema.fields + [
        T.StructField("_cp_b", T.IntegerType()),
        T.StructField("_cp_lrn", T.LongType()),
        T.StructField("_cp_lcum", T.DoubleType()),
        T.StructField("_cp_lprev", T.DoubleType()),
    ])

    def local_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        # Batches arrive in partition order; a group may continue from the
        # previous batch, so its running state is carried over.
        last_key, carry_rn, carry_cum = None, 0, 0.0
        for pdf in batches:
            if pdf.empty:
                yield pdf.assign(_cp_b=part, _cp_lrn=pd.Series(dtype="int64"),
                                 _cp_lcum=pd.Series(dtype="float64"), _cp_lprev=pd.Series(dtype="float64"))
                continue
            kdf = pdf[gcols].reset_index(drop=True)
            w = pdf["_cp_w"].astype("float64").reset_index(drop=True).copy()
            seg = _segments(kdf)
            cont = last_key is not None and _key(kdf.iloc[0]) == last_key
            if cont:
                w.iloc[0] = carry_cum + w.iloc[0]  # keeps the sum sequential
            cum = w.groupby(seg).cumsum()
            prev = cum.groupby(seg).shift(1)
            rn = w.groupby(seg).cumcount() + 1
            first = seg == seg.iloc[0]
            if cont:
                rn = rn.where(~first, rn + carry_rn)
                prev = prev.where(~(first & prev.isna()), carry_cum)
            prev = prev.fillna(0.0)
            last_key = _key(kdf.iloc[-1])
            carry_rn, carry_cum = int(rn.iloc[-1]), float(cum.iloc[-1])
            yield pdf.assign(_cp_b=part, _cp_lrn=rn.to_numpy(), _cp_lcum=cum.to_numpy(),
                             _cp_lprev=prev.to_numpy())

    local = cut_lineage(ranged.mapInPandas(local_sums, schema))
    keys = gcols + ["_cp_b"]
    sizes = local.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cp_n"), F.sum("_cp_w").alias("_cp_s"))
    before = Window.partitionBy(*gcols).orderBy("_cp_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys,
        F.coalesce(F.sum("_cp_n").over(before), F.lit(0)).alias("_cp_on"),
        F.coalesce(F.sum("_cp_s").over(before), F.lit(0.0)).alias("_cp_os"),
    )
    out = join_groups(local, offsets, keys).select(
        *df.columns,
        (F.col("_cp_on") + F.col("_cp_lrn")).alias("_rn"),
        (F.col("_cp_os") + F.col("_cp_lcum")).alias("_cum"),
        (F.col("_cp_os") + F.col("_cp_lprev")).alias("_prev"),
    )
    return out


def group_totals(df: DataFrame, group, weight: str) -> DataFrame:
    """Per-group sum of ``weight`` with map-side partial aggregation (a hot
    group collapses before the shuffle)."""
    return df.groupBy(*_g(group)).agg(F.sum(F.col(weight).cast("double")).alias("_tot"))


__all__ = ["group_totals", "ranked_running_sum"]


def ranked_draws(
    cands: DataFrame, group, cand: str, start: str, total: DataFrame, seed: int, draws: int
) -> DataFrame:
    """Inverse-CDF draws for groups too large for one task.

    ``cands`` holds one row per candidate with its interval ``start`` (the
    running share before it; positive width assumed), ``total`` one row per
    group with ``_tot``. Draw ``d`` of a group sits at ``u(seed, group, d) *
    _tot`` and takes the last candidate whose start lies below it. Starts
    and draw points are range-partitioned together on (group, position);
    each sorted partition carries its last candidate forward in pandas, and
    a per-(group, bucket) table of last candidates covers draws whose
    candidate lies in an earlier bucket. Output ``(group..., draw, cand)``.
    """
    from convprep.functions.random import uniform

    ship_package(cands.sparkSession)
    gcols = _g(group)
    ctype = cands.schema[cand].dataType
    gkey = gcols[0] if len(gcols) == 1 else F.concat_ws("/", *[F.col(c).cast("string") for c in gcols])
    pts = total.select(*gcols, "_tot", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    pts = pts.select(
        *gcols, (uniform(seed, gkey, "draw") * F.col("_tot")).alias("_cp_x"), F.lit(0).alias("_cp_kind"),
        F.lit(None).cast(ctype).alias("_cp_c"), F.col("draw").cast("int").alias("_cp_d"),
    )
    starts = cands.select(
        *gcols, F.col(start).cast("double").alias("_cp_x"), F.lit(1).alias("_cp_kind"),
        F.col(cand).alias("_cp_c"), F.lit(None).cast("int").alias("_cp_d"),
    )
    sort = [F.col(c).asc() for c in gcols] + [F.col(c).asc() for c in ("_cp_x", "_cp_kind", "_cp_c", "_cp_d")]
    ranged = starts.unionByName(pts).repartitionByRange(*sort).sortWithinPartitions(*sort)
    schema = T.StructType(ranged.schema.fields + [
        T.StructField("_cp_b", T.IntegerType()), T.StructField("_cp_last", ctype),
    ])

    def carry_last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        carry_key, carry = None, None  # last candidate seen, and its group
        for pdf in batches:
            if pdf.empty:
                yield pdf.assign(_cp_b=part, _cp_last=pdf["_cp_c"])
                continue
            kdf = pdf[gcols].reset_index(drop=True)
            seg = _segments(kdf)
            seen = pdf["_cp_c"].reset_index(drop=True).astype(object)
            seen = seen.where(pdf["_cp_kind"].reset_index(drop=True) == 1, None)
            if carry is not None and _key(kdf.iloc[0]) == carry_key and seen.iloc[0] is None:
                seen.iloc[0] = carry  # the group continues from the previous batch
            last = seen.groupby(seg).ffill()
            tail = last[seg == seg.iloc[-1]].dropna()
            carry_key = _key(kdf.iloc[-1])
            carry = tail.iloc[-1] if len(tail) else None
            yield pdf.assign(_cp_b=part, _cp_last=last.to_numpy())

    stage = cut_lineage(ranged.mapInPandas(carry_last, schema))
    keys = gcols + ["_cp_b"]
    # Every (group, bucket) present, with its last candidate if it has one;
    # a bucket holding only draws takes the last candidate of earlier ones.
    # Starts strictly increase within a group (positive widths), so ordering
    # by the start alone is exact and keeps these hash aggregates.
    last_in_bucket = stage.where(F.col("_cp_kind") == 1).groupBy(*keys).agg(
        F.max_by("_cp_c", "_cp_x").alias("_cp_bl"))
    buckets = stage.select(*keys).distinct()
    buckets = join_groups(buckets, last_in_bucket, keys, "left")
    before = Window.partitionBy(*gcols).orderBy("_cp_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select(*keys, F.last("_cp_bl", ignorenulls=True).over(before).alias("_cp_carry"))
    first = cands.groupBy(*gcols).agg(F.min_by(F.col(cand), F.col(start)).alias("_cp_first"))
    picked = join_groups(stage.where(F.col("_cp_kind") == 0), carried, keys, "left")
    picked = join_groups(picked, first, gcols, "left")
    return picked.select(
        *gcols, F.col("_cp_d").alias("draw"),
        F.coalesce("_cp_last", "_cp_carry", "_cp_first").alias(cand),
    )
