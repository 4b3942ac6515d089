"""Per-group corpus and its sharded form."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from convprep.operators.corpus import concat_corpus, concat_corpus_shards
from convprep.plans import fixtures as fx


def test_shards_concatenate_to_the_corpus(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    # Tiny test data would be coalesced into one partition; at scale AQE's
    # advisory size keeps a hot group over many partitions.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        conv = fx.load(spark, SF_SMALL, "conversations")
        # one hot group: every message also copied into conversation -1
        hot = conv.unionByName(conv.withColumn("turn", F.col("conv_id") * 100 + F.col("turn"))
                               .withColumn("conv_id", F.lit(-1).cast("bigint")))
        full = {r["conv_id"]: r["corpus"] for r in concat_corpus(hot, "text", ["turn"], ["conv_id"]).collect()}
        shards = concat_corpus_shards(hot, "text", ["turn"], ["conv_id"]).collect()
        pieces = {}
        for r in sorted(shards, key=lambda r: (r["conv_id"], r["shard"])):
            pieces.setdefault(r["conv_id"], []).append(r["corpus"])
        assert {k: "".join(v) for k, v in pieces.items()} == full
        assert len(pieces[-1]) > 1  # the hot group was split
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_corpus_requires_groups(spark):
    import pytest

    df = spark.createDataFrame([(1, "a")], "turn long, text string")
    with pytest.raises(ValueError):
        concat_corpus(df, "text", ["turn"], [])


def test_shards_are_bounded_in_bytes(spark):
    rows = [(g, i, "é" * (i % 40)) for g in ("a", "b/c", None) for i in range(200)] + [("a", 1000, "x" * 500)]
    df = spark.createDataFrame(rows, "g string, turn long, text string").repartition(5)
    full = {r["g"]: r["corpus"] for r in concat_corpus(df, "text", ["turn"], ["g"]).collect()}
    shards = sorted(concat_corpus_shards(df, "text", ["turn"], ["g"], max_bytes=100).collect(), key=lambda r: r["shard"])
    joined = {}
    for r in shards:
        joined[r["g"]] = joined.get(r["g"], "") + r["corpus"]
    assert joined == full
    assert [len(r["corpus"]) for r in shards if len(r["corpus"].encode()) > 100] == [501]
    assert len(shards) < 2.2 * sum(len(t.encode()) + 1 for t in full.values()) / 100 + 20
