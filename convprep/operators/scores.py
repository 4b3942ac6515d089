"""Group-wise score operators over a long ``(group, candidate, score)``
table (W1-W4, T1-T3, A8, A9, C12).

One sampling step runs for all groups at once. Every window is partitioned
by the group key, so a group is one task's work and groups spread over the
cluster; windows sharing a partitioning share one exchange. Ties are broken
by the candidate id, so results do not depend on partitioning.

A group too large for one task takes another form of the same operator, which
splits it (``hot_groups``): None, the default, finds such groups by a sketch of
the group columns (:mod:`convprep.operators.heavy`), a pass over the input when
the operator is called, with ``heavy_rows`` as the bound; True and False choose one
form for all groups. Candidates must be unique within a group that is split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convprep.functions.random import uniform
from convprep.operators.heavy import HEAVY_ROWS, by_weight
from convprep.operators.index import dense_index
from convprep.operators.ranked import join_groups


PARTS = 256  # parts that a split group is dealt into where its order does not matter


def _g(group) -> list[str]:
    return [group] if isinstance(group, str) else list(group)


def _desc_order(score: str, cand) -> list[Column]:
    """Descending score, ties by the candidate key (one or more columns)."""
    return [F.col(score).desc()] + [F.col(c).asc() for c in _g(cand)]


def softmax_by_group(
    df: DataFrame, group, score: str = "score", temperature: float = 1.0, out: str = "p",
    hot_groups: bool | None = None, heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """``exp(s - max s) / sum exp(s - max s)`` per group, ``s`` the score
    divided by ``temperature``.

    Split groups take their max and sum from partial aggregates joined back to
    the rows (a hot group collapses map-side; AQE splits its join partition or
    broadcasts small statistics) instead of windows."""
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    gcols = _g(group)
    s = F.col(score) / F.lit(float(temperature))

    def split(df: DataFrame) -> DataFrame:
        m = df.groupBy(*gcols).agg(F.max(s).alias("_cp_m"))
        staged = join_groups(df, m, gcols).withColumn("_cp_e", F.exp(s - F.col("_cp_m")))
        z = staged.groupBy(*gcols).agg(F.sum("_cp_e").alias("_cp_z"))
        return join_groups(staged, z, gcols).withColumn(out, F.col("_cp_e") / F.col("_cp_z")).select(*df.columns, out)

    def window(df: DataFrame) -> DataFrame:
        g = Window.partitionBy(*gcols)
        e = F.exp(s - F.max(s).over(g))
        return df.withColumn("_cp_e", e).withColumn(out, F.col("_cp_e") / F.sum("_cp_e").over(g)).drop("_cp_e")

    return by_weight(df, gcols, window, split, hot_groups, heavy_rows)


def sort_scores(
    df: DataFrame, group, cand="cand", score: str = "score", out: str = "rk", hot_groups: bool | None = None, heavy_rows: int = HEAVY_ROWS
) -> DataFrame:
    """Descending rank 1..n per group (ties: lower candidate first).

    Rows of split groups are range-partitioned on (group, score, candidate), each
    partition is sorted and numbered, and counts per partition and group make the
    ranks global (:func:`dense_index`).
    """
    gcols = _g(group)

    def split(df: DataFrame) -> DataFrame:
        ranked = dense_index(df, _desc_order(score, cand), out="_cp_rk", partition_by=gcols)
        return ranked.withColumn(out, F.col("_cp_rk") + 1).drop("_cp_rk")

    def window(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(*gcols).orderBy(*_desc_order(score, cand))
        return df.withColumn(out, F.row_number().over(w).cast("bigint"))

    return by_weight(df, gcols, window, split, hot_groups, heavy_rows)


def top_k_filter(
    df: DataFrame, group, score: str = "score", k: int | None = None, hot_groups: bool | None = None, heavy_rows: int = HEAVY_ROWS, cand=None
) -> DataFrame:
    """Keep scores not below the k-th largest (``rank``: ties with the
    k-th survive). ``k`` None or <= 0: no cut.

    A split group is dealt into parts: the k best scores of the parts hold the
    group's k-th, the threshold (``score >= kth`` is ``rank <= k``), so no order of
    the whole group is needed. ``cand`` is not read.
    """
    if k is None or k <= 0:
        return df
    gcols = _g(group)

    def split(df: DataFrame) -> DataFrame:
        narrow = df.select(*gcols, F.col(score).alias("_cp_s"), F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).alias("_cp_part"))
        for part in ([*gcols, "_cp_part"], gcols):
            best = F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("_cp_s")))
            narrow = narrow.withColumn("_cp_r", best).where(F.col("_cp_r") <= k)
        kth = narrow.where(F.col("_cp_r") == k).select(*gcols, F.col("_cp_s").alias("_cp_kth"))
        kept = join_groups(df, kth, gcols, "left").where(F.col("_cp_kth").isNull() | (F.col(score) >= F.col("_cp_kth")))
        return kept.select(*df.columns)

    def window(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(*gcols).orderBy(F.col(score).desc())
        return df.withColumn("_cp_r", F.rank().over(w)).where(F.col("_cp_r") <= k).drop("_cp_r")

    return by_weight(df, gcols, window, split, hot_groups, heavy_rows)


def cumulative_share(
    df: DataFrame, group, cand: str = "cand", score: str = "score", weight: str = "p", out: str = "cum",
    hot_groups: bool | None = None, heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Running sum of ``weight`` in descending score order.

    Split groups get it from :func:`ranked_running_sum` (range partitions)."""
    gcols = _g(group)

    def split(df: DataFrame) -> DataFrame:
        from convprep.operators.ranked import ranked_running_sum

        r = ranked_running_sum(df, gcols, cand, score, weight)
        return r.withColumnRenamed("_cum", out).drop("_rn", "_prev")

    def window(df: DataFrame) -> DataFrame:
        w = (
            Window.partitionBy(*gcols)
            .orderBy(*_desc_order(score, cand))
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        return df.withColumn(out, F.sum(weight).over(w))

    return by_weight(df, gcols, window, split, hot_groups, heavy_rows)


def top_p_filter(
    df: DataFrame,
    group,
    cand: str = "cand",
    score: str = "score",
    p: float | None = None,
    min_keep: int = 1,
    weight: str | None = None,
    hot_groups: bool | None = None, heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Nucleus cut. Candidates in descending order are kept while the
    share *before* them is at most ``p``; the first is always kept. With
    ``min_keep > 1`` the first ``min_keep + 1`` are kept (the flags are
    cleared before the shift). ``weight`` defaults to the softmax of
    ``score`` over the rows present (renormalised after a top-k cut); any
    non-negative weight column answers "smallest set covering p of the
    total". ``p`` None or <= 0: no cut.
    """
    if p is None or p <= 0:
        return df
    gcols = _g(group)
    return by_weight(df, gcols, lambda d: _top_p_window(d, gcols, cand, score, p, min_keep, weight),
                     lambda d: _top_p_hot(d, gcols, cand, score, p, min_keep, weight), hot_groups, heavy_rows)


def _top_p_window(df: DataFrame, gcols, cand, score: str, p: float, min_keep: int, weight: str | None) -> DataFrame:
    """W4 with one window per group."""
    staged = df
    wcol = weight
    if weight is None:
        staged = softmax_by_group(df, gcols, score, out="_cp_p", hot_groups=False)
        wcol = "_cp_p"
    else:
        tot = F.sum(weight).over(Window.partitionBy(*gcols))
        # try_divide: a group whose weights are all 0 keeps only its first row
        # instead of failing under ANSI division.
        staged = df.withColumn("_cp_p", F.try_divide(F.col(weight).cast("double"), tot.cast("double")))
        wcol = "_cp_p"
    order = Window.partitionBy(*gcols).orderBy(*_desc_order(score, cand))
    staged = cumulative_share(staged, gcols, cand, score, wcol, out="_cp_cum", hot_groups=False)
    staged = staged.withColumn("_cp_rk", F.row_number().over(order)).withColumn(
        "_cp_prev", F.lag("_cp_cum").over(order)
    )
    keep = (F.col("_cp_rk") == 1) | (F.col("_cp_prev") <= F.lit(float(p)))
    if min_keep > 1:
        keep = keep | (F.col("_cp_rk") <= min_keep + 1)
    return staged.where(keep).drop("_cp_p", "_cp_cum", "_cp_rk", "_cp_prev")


def _top_p_hot(df: DataFrame, gcols, cand, score: str, p: float, min_keep: int, weight: str | None) -> DataFrame:
    """W4 for groups too large for one task: group statistics come from
    partial aggregates, running shares from :func:`ranked_running_sum`."""
    from convprep.operators.ranked import ranked_running_sum

    if weight is None:
        m = df.groupBy(*gcols).agg(F.max(score).alias("_cp_m"))
        staged = join_groups(df, m, gcols).withColumn("_cp_wt", F.exp(F.col(score) - F.col("_cp_m"))).drop("_cp_m")
    else:
        staged = df.withColumn("_cp_wt", F.col(weight).cast("double"))
    tot = staged.groupBy(*gcols).agg(F.sum("_cp_wt").alias("_cp_tot"))
    r = ranked_running_sum(staged, gcols, cand, score, "_cp_wt")
    r = join_groups(r, tot, gcols)
    prev_share = F.try_divide(F.col("_prev"), F.col("_cp_tot"))
    keep = (F.col("_rn") == 1) | (prev_share <= F.lit(float(p)))
    if min_keep > 1:
        keep = keep | (F.col("_rn") <= min_keep + 1)
    return r.where(keep).select(*df.columns)


def argmax_by_group(df: DataFrame, group, cand: str = "cand", score: str = "score", out: str = "cand") -> DataFrame:
    """Greedy pick, the lowest candidate id among equal best scores.

    A hash aggregate (``max_by``) with map-side partial aggregation: no
    window, no sort.
    """
    gcols = _g(group)
    return df.groupBy(*gcols).agg(
        F.min_by(F.col(cand), F.struct(F.col(score).isNull().alias("n"), (-F.col(score)).alias("s"), F.col(cand))).alias(out)
    )


def sample_by_group(
    df: DataFrame,
    group,
    cand: str = "cand",
    score: str = "score",
    seed: int = 0,
    draws: int = 1,
    weight: str | None = None,
    out: str = "cand",
    hot_groups: bool | None = None, heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """``draws`` seeded draws per group from ``softmax(score)`` (or from
    ``weight``), by inverse CDF; from range partitions for split groups
    (:func:`ranked_draws`).

    Draw ``d`` of group ``g`` uses ``u = md5(seed:g:d)`` and picks the first
    candidate in descending order whose running share reaches ``u * total``.
    Draw rows and candidate interval starts are merged in one window per
    group (sorted by position on the unit interval), so no draw is paired
    with every candidate. Result ``(group..., draw, out)``.
    """
    gcols = _g(group)
    return by_weight(df, gcols, lambda d: _draws_window(d, gcols, cand, score, seed, draws, weight, out),
                     lambda d: _draws_hot(d, gcols, cand, score, seed, draws, weight, out), hot_groups, heavy_rows)


def _draws_hot(df: DataFrame, gcols, cand: str, score: str, seed: int, draws: int, weight: str | None, out: str) -> DataFrame:
    """T3 from range partitions."""
    from convprep.operators.ranked import ranked_draws, ranked_running_sum

    if weight is None:
        staged = softmax_by_group(df, gcols, score, out="_cp_w", hot_groups=True)
    else:
        staged = df.withColumn("_cp_w", F.col(weight).cast("double"))
    r = ranked_running_sum(staged, gcols, cand, score, "_cp_w")
    tot = r.groupBy(*gcols).agg(F.max("_cum").alias("_tot"))
    cands = r.where(F.col("_cp_w") > 0)
    picked = ranked_draws(cands, gcols, cand, "_prev", tot, seed, draws)
    return picked.withColumnRenamed(cand, out) if out != cand else picked


def _draws_window(df: DataFrame, gcols, cand: str, score: str, seed: int, draws: int, weight: str | None, out: str) -> DataFrame:
    """T3 with one window per group."""
    if weight is None:
        staged = softmax_by_group(df, gcols, score, out="_cp_w", hot_groups=False)
    else:
        staged = df.withColumn("_cp_w", F.col(weight).cast("double"))
    staged = staged.withColumn("_cp_sort", F.col(score))
    staged = cumulative_share(staged, gcols, cand, "_cp_sort", "_cp_w", out="_cp_cum", hot_groups=False)
    staged = staged.withColumn("_cp_tot", F.max("_cp_cum").over(Window.partitionBy(*gcols)))
    # Interval start = the running share before the candidate (exact, no
    # subtraction), so "last start below x" = "first cum reaching x".
    order = Window.partitionBy(*gcols).orderBy(*_desc_order("_cp_sort", cand))
    staged = staged.withColumn("_cp_start", F.coalesce(F.lag("_cp_cum").over(order), F.lit(0.0)))
    starts = staged.where(F.col("_cp_w") > 0).select(
        *gcols,
        F.col("_cp_start").alias("_cp_x"),
        F.lit(1).alias("_cp_kind"),
        F.col(cand).alias("_cp_c"),
        F.lit(None).cast("int").alias("draw"),
    )
    # One draw row per (group, draw): the group's total comes from a
    # partial + final aggregate, and draws are generated from it.
    totals = staged.groupBy(*gcols).agg(F.max("_cp_tot").alias("_cp_tot"))
    gkey = gcols[0] if len(gcols) == 1 else F.concat_ws("/", *[F.col(c).cast("string") for c in gcols])
    draw_rows = totals.select(*gcols, "_cp_tot", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    draw_rows = draw_rows.select(
        *gcols,
        (uniform(seed, gkey, "draw") * F.col("_cp_tot")).alias("_cp_x"),
        F.lit(0).alias("_cp_kind"),
        F.lit(None).cast(df.schema[cand].dataType).alias("_cp_c"),
        F.col("draw").cast("int").alias("draw"),
    )
    events = starts.unionByName(draw_rows)
    w = (
        Window.partitionBy(*gcols)
        .orderBy(F.col("_cp_x").asc(), F.col("_cp_kind").asc(), F.col("_cp_c").asc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # A draw at exactly 0 precedes every interval start: it takes the first.
    picked = events.withColumn("_cp_pick", F.last("_cp_c", ignorenulls=True).over(w)).withColumn(
        "_cp_first", F.first("_cp_c", ignorenulls=True).over(whole)
    )
    return picked.where(F.col("_cp_kind") == 0).select(
        *gcols, "draw", F.coalesce("_cp_pick", "_cp_first").alias(out)
    )


def cross_entropy(
    df: DataFrame,
    group,
    cand: str = "cand",
    score: str = "score",
    target: str = "target",
    mask_padding: bool = False,
    pad_id: int = 0,
    hot_groups: bool | None = None, heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Per group ``logsumexp(score) - score[target]`` (max subtracted
    for stability). With ``mask_padding`` groups whose target is ``pad_id``
    are left out (the reference counts them). Split groups take their max from
    a partial aggregate joined back instead of a window."""
    gcols = _g(group)

    def split(df: DataFrame) -> DataFrame:
        return join_groups(df, df.groupBy(*gcols).agg(F.max(score).alias("_cp_m")), gcols)

    def window(df: DataFrame) -> DataFrame:
        return df.withColumn("_cp_m", F.max(score).over(Window.partitionBy(*gcols)))

    staged = by_weight(df, gcols, window, split, hot_groups, heavy_rows)
    if mask_padding:
        staged = staged.where(F.col(target) != F.lit(pad_id))
    return staged.groupBy(*gcols).agg(
        (
            F.log(F.sum(F.exp(F.col(score) - F.col("_cp_m"))))
            + F.max("_cp_m")
            - F.max(F.when(F.col(cand) == F.col(target), F.col(score)))
        ).alias("loss")
    )


def mean_cross_entropy(losses: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The mean loss (one row, or per ``by``)."""
    return losses.groupBy(*by).agg(F.avg("loss").alias("mean_loss"), F.count(F.lit(1)).cast("bigint").alias("n"))


def epoch_rollup(metrics: DataFrame, value: str = "value", samples: str = "n_samples") -> DataFrame:
    """Per epoch, the sum of batch values divided by the number of
    samples (the reference's rule), and the plain mean per batch."""
    return metrics.groupBy("epoch").agg(
        (F.sum(value) / F.sum(samples)).alias("epoch_loss"),
        F.avg(value).alias("mean_batch_loss"),
        F.count(F.lit(1)).cast("bigint").alias("n_batches"),
        F.sum(samples).cast("bigint").alias("n_samples"),
    )


def sample_candidates(
    df: DataFrame,
    group,
    cand: str = "cand",
    score: str = "score",
    k: int | None = None,
    p: float | None = None,
    min_keep: int = 1,
    seed: int = 0,
    draws: int = 1,
    temperature: float = 1.0,
    hot_groups: bool | None = None, heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """One generation step for every group: top-k, then nucleus on the
    renormalised scores, then a seeded draw; greedy arg-max when neither cut
    is set. Result ``(group..., draw, cand)``. Heavy groups are found once, in
    the input, and take the split form of each step."""
    gcols = _g(group)
    scaled = df.withColumn("_cp_s", F.col(score) / F.lit(float(temperature)))
    if (k is None or k <= 0) and (p is None or p <= 0):
        best = argmax_by_group(scaled, gcols, cand, "_cp_s", out=cand)
        best = best.select(*gcols, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"), cand)
        return best.select(*gcols, F.col("draw").cast("int").alias("draw"), cand)

    def steps(hot: bool):
        def run(df: DataFrame) -> DataFrame:
            cut = top_k_filter(df, gcols, "_cp_s", k, hot_groups=hot)
            cut = top_p_filter(cut, gcols, cand, "_cp_s", p, min_keep, hot_groups=hot)
            return sample_by_group(cut, gcols, cand, "_cp_s", seed=seed, draws=draws, out=cand, hot_groups=hot)
        return run

    return by_weight(scaled, gcols, steps(False), steps(True), hot_groups, heavy_rows)
