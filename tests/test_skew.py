"""Hot keys: one value holding a third of all rows must not change results,
also when joins are shuffle joins (the plan shape of large data)."""

import pytest
from pyspark.sql import functions as F

from convprep.operators.index import dense_index
from convprep.operators.tokens import decode, encode, fit_vocabulary


@pytest.fixture()
def no_broadcast(spark):
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_hot_token_encode_decode(spark, no_broadcast):
    # token "hot" is a third of all tokens; rows have 3..8 tokens
    rows = [(i, " ".join(["hot" if j % 3 == 0 else f"w{(i * 7 + j) % 97}" for j in range(3 + i % 6)]))
            for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("toks", F.split("text", " "))
    # plus a third as many rows without tokens (empty and null lists): their
    # join keys are salted instead of all hashing to one null partition
    blanks = spark.createDataFrame([(3000 + i, "" if i % 2 else None) for i in range(1000)], "id long, text string")
    blanks = blanks.withColumn("toks", F.when(F.col("text").isNotNull(), F.array().cast("array<string>")))
    df = df.unionByName(blanks)
    vocab = fit_vocabulary(df, ["toks"])
    assert vocab.where(F.col("id") == 0).first()["tok"] == "hot"
    enc = encode(df, ["id"], ["toks"], ["ids"], vocab)
    plan = enc._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan  # token join is a shuffle join here (AQE splits the hot partition)
    dec = decode(enc, ["id"], "ids", vocab)
    assert dec.where(F.col("decoded") != F.col("text")).count() == 0
    assert dec.count() == 4000
    blank_ids = {r["id"]: r["ids"] for r in enc.where(F.col("id") >= 3000).collect()}
    assert all(v == [] if k % 2 else v is None for k, v in blank_ids.items())


def test_hot_leading_order_value(spark):
    # a third of the rows share the leading order value; the full key is unique
    df = spark.range(0, 6000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("lead"))
    got = dense_index(df, ["lead", "k"], out="rn", num_buckets=16).toPandas().sort_values("rn")
    assert list(got["rn"]) == list(range(6000))
    assert list(zip(got["lead"], got["k"])) == sorted(zip(got["lead"], got["k"]))
