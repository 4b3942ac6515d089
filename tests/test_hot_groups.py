"""Score operators in hot-group mode give the window results on a group
holding a third of all rows (integer weights keep sums exact)."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from convprep.operators.scores import cumulative_share, top_k_filter, top_p_filter
from convprep.plans import fixtures as fx

CAND = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@pytest.fixture(scope="module", autouse=True)
def spread(spark):
    """Many small range partitions and Arrow batches, so groups cross both
    partition and batch boundaries (the carried running state is exercised)."""
    confs = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false",
             "spark.sql.execution.arrow.maxRecordsPerBatch": "100"}
    old = {k: spark.conf.get(k, None) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.fixture(scope="module")
def hot(spark):
    li = fx.load(spark, SF_MID, "lineitem").select(*CAND, "l_quantity")
    # every third order joins group -1, which then holds a third of the rows
    return li.withColumn("g", F.when(F.col("l_orderkey") % 3 == 0, F.lit(-1)).otherwise(F.col("l_orderkey")))


def _rows(df):
    return sorted(tuple(r) for r in df.select("g", *CAND).collect())


def test_cumulative_share_hot(hot):
    a = cumulative_share(hot, "g", CAND, "l_quantity", "l_quantity", out="cum")
    b = cumulative_share(hot, "g", CAND, "l_quantity", "l_quantity", out="cum", hot_groups=True)
    ka = sorted((tuple(r[:5]), r["cum"]) for r in a.select("g", *CAND, "cum").collect())
    kb = sorted((tuple(r[:5]), r["cum"]) for r in b.select("g", *CAND, "cum").collect())
    assert ka == kb


@pytest.mark.parametrize("k", [1, 5, 50])
def test_top_k_hot(hot, k):
    assert _rows(top_k_filter(hot, "g", "l_quantity", k)) == \
        _rows(top_k_filter(hot, "g", "l_quantity", k, hot_groups=True, cand=CAND))


def _exact_top_p(rows, p, min_keep):
    """Brute force with exact fractions: sort each group by weight desc,
    candidate asc; keep while the share before the row is at most p."""
    from collections import defaultdict
    from fractions import Fraction

    groups = defaultdict(list)
    for r in rows:
        groups[r["g"]].append(r)
    kept = []
    for g, rs in groups.items():
        rs.sort(key=lambda r: (-r["l_quantity"], *[r[c] for c in CAND]))
        tot = sum(Fraction(r["l_quantity"]) for r in rs)
        before = Fraction(0)
        for i, r in enumerate(rs, start=1):
            if i == 1 or before / tot <= Fraction(str(p)) or (min_keep > 1 and i <= min_keep + 1):
                kept.append((g, *[r[c] for c in CAND]))
            before += Fraction(r["l_quantity"])
    return sorted(kept)


@pytest.mark.parametrize("p,min_keep", [(0.3, 1), (0.9, 1), (0.01, 3)])
def test_top_p_weights_hot(hot, p, min_keep):
    """Hot mode sums integer weights exactly before dividing once, so it is
    checked against exact fractions (the window form accumulates per-row
    shares and may differ where a share equals p exactly)."""
    got = _rows(top_p_filter(hot, "g", CAND, "l_quantity", p=p, min_keep=min_keep, weight="l_quantity",
                             hot_groups=True))
    assert got == _exact_top_p(hot.collect(), p, min_keep)


def test_top_p_softmax_hot(spark):
    logits = fx.logits_view(fx.load(spark, SF_MID, "embeddings"))
    # fold every vector into 4 large groups
    big = logits.withColumn("g", F.col("vec_id") % 4).withColumn("c", F.col("vec_id") * 100 + F.col("tok"))
    a = top_p_filter(big, "g", "c", "l", p=0.5)
    b = top_p_filter(big, "g", "c", "l", p=0.5, hot_groups=True)
    assert sorted(r["c"] for r in a.collect()) == sorted(r["c"] for r in b.collect())


def test_softmax_and_cross_entropy_hot(spark):
    from convprep.operators.scores import cross_entropy, softmax_by_group

    logits = fx.logits_view(fx.load(spark, SF_MID, "embeddings"))
    big = logits.withColumn("g", F.col("vec_id") % 4).withColumn("c", F.col("vec_id") * 100 + F.col("tok"))
    a = {r["c"]: round(r["p"], 12) for r in softmax_by_group(big, "g", "l").collect()}
    b = {r["c"]: round(r["p"], 12) for r in softmax_by_group(big, "g", "l", hot_groups=True).collect()}
    assert a == b
    ta = big.withColumn("target", F.col("vec_id") * 100 + F.col("label"))
    x = {r["g"]: round(r["loss"], 9) for r in cross_entropy(ta, "g", "c", "l", "target").collect()}
    y = {r["g"]: round(r["loss"], 9) for r in cross_entropy(ta, "g", "c", "l", "target", hot_groups=True).collect()}
    assert x == y


@pytest.mark.parametrize("weighted", [True, False])
def test_draws_hot(spark, hot, weighted):
    from convprep.operators.scores import sample_by_group

    if weighted:
        df = hot.withColumn("c", F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + F.col("l_partkey") % 10)
        df = df.dropDuplicates(["g", "c"])
        kw = dict(weight="l_quantity")
        score = "l_quantity"
    else:
        logits = fx.logits_view(fx.load(spark, SF_MID, "embeddings"))
        df = logits.withColumn("g", F.col("vec_id") % 4).withColumn("c", F.col("vec_id") * 100 + F.col("tok"))
        kw = {}
        score = "l"
    a = sample_by_group(df, "g", "c", score, seed=3, draws=25, out="c", **kw)
    b = sample_by_group(df, "g", "c", score, seed=3, draws=25, out="c", hot_groups=True, **kw)
    ra = sorted((r["g"], r["draw"], r["c"]) for r in a.collect())
    rb = sorted((r["g"], r["draw"], r["c"]) for r in b.collect())
    assert ra == rb


def test_sample_candidates_hot(spark):
    from convprep.operators.scores import sample_candidates

    logits = fx.logits_view(fx.load(spark, SF_MID, "embeddings"))
    df = logits.withColumn("g", F.col("vec_id") % 4).withColumn("c", F.col("vec_id") * 100 + F.col("tok"))
    a = sample_candidates(df, "g", "c", "l", k=400, p=0.8, seed=5, draws=10)
    b = sample_candidates(df, "g", "c", "l", k=400, p=0.8, seed=5, draws=10, hot_groups=True)
    assert sorted(tuple(r) for r in a.collect()) == sorted(tuple(r) for r in b.collect())


def test_heavy_groups_are_found_and_answers_do_not_depend_on_the_path(spark, hot):
    """A third of the rows in one group: it alone is split, with the answers of
    either form for all groups."""
    from convprep.operators.heavy import heavy_groups
    from convprep.operators.scores import cross_entropy, sample_by_group, sample_candidates, softmax_by_group, sort_scores

    whole = [r[0] for r in hot.where("g = -1").select(F.xxhash64("g")).distinct().collect()]
    assert heavy_groups(hot, ["g"], 1_000) == whole and heavy_groups(hot, ["g"]) == []
    df = hot.groupBy("g", "l_partkey").agg(F.sum("l_quantity").alias("w"))
    df = df.select(F.when(F.col("g") != 2, F.col("g")).alias("g"), F.col("l_partkey").alias("c"), "w",
                   (F.col("w") / 40.0).cast("double").alias("s"))

    def same(fn):
        a, b, c = (sorted(map(str, fn(**kw).collect()))
                   for kw in ({"hot_groups": False}, {"heavy_rows": 100}, {"hot_groups": True}))
        assert a == b == c and a

    def rounded(out, col):
        return out.withColumn(col, F.round(F.col(col).cast("double"), 9))

    same(lambda **kw: rounded(softmax_by_group(df, "g", "s", **kw), "p").select("g", "c", "p"))
    same(lambda **kw: sort_scores(df, "g", "c", "w", **kw).select("g", "c", "rk"))
    same(lambda **kw: top_k_filter(df, "g", "w", 7, **kw).select("g", "c"))
    same(lambda **kw: rounded(cumulative_share(df, "g", "c", "w", "w", **kw), "cum").select("g", "c", "cum"))
    same(lambda **kw: top_p_filter(df, "g", "c", "w", p=0.3, weight="w", **kw).select("g", "c"))
    same(lambda **kw: sample_by_group(df, "g", "c", "w", seed=3, draws=4, weight="w", **kw).select("g", "draw", "cand"))
    same(lambda **kw: sample_candidates(df, "g", "c", "s", k=30, p=0.8, seed=5, draws=3, **kw).select("g", "draw", "c"))
    same(lambda **kw: rounded(cross_entropy(df.withColumn("target", F.col("c")), "g", "c", "s", **kw), "loss").select("g", "loss"))
    types = [top_p_filter(df, "g", "c", "w", p=0.3, weight="w", heavy_rows=n).schema for n in (100, 10**9)]
    assert [[f.dataType for f in s] for s in types[:1]] == [[f.dataType for f in s] for s in types[1:]]


def test_more_heavy_groups_than_are_named(spark, hot, monkeypatch):
    from convprep.operators import heavy

    monkeypatch.setattr(heavy, "NAMED", 3)
    assert heavy.heavy_groups(hot, ["g"], 1) is None
    a, b = (_rows(top_k_filter(hot, "g", "l_quantity", 4, **kw)) for kw in ({"hot_groups": False}, {"heavy_rows": 1}))
    assert a == b
