"""Properties that must hold whatever the data."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from convprep.operators.examples import format_examples, pad_batches
from convprep.operators.index import ROW, assign_batches, dense_index, with_row_id
from convprep.operators.scores import cumulative_share, softmax_by_group, top_p_filter
from convprep.operators.tokens import decode, encode, fit_vocabulary, tokenize, tokenize_dataset
from convprep.plans import fixtures as fx


@pytest.fixture(scope="module")
def docs(spark):
    return tokenize(fx.load(spark, SF_SMALL, "documents").select("doc_id", "text"), "text", "tokens")


def test_decode_encode_is_identity(spark, docs):
    vocab = fit_vocabulary(docs, ["tokens"])
    enc = encode(docs, ["doc_id"], ["tokens"], ["ids"], vocab)
    dec = decode(enc.select("doc_id", "ids", "tokens"), ["doc_id"], "ids", vocab)
    bad = dec.where(F.col("decoded") != F.array_join("tokens", " ")).count()
    assert bad == 0


def test_vocabulary_ids_dense_and_ordered(spark, docs):
    vocab = fit_vocabulary(docs, ["tokens"]).toPandas().sort_values("id")
    assert list(vocab["id"]) == list(range(len(vocab)))
    key = list(zip(-vocab["n"], vocab["tok"]))
    assert key == sorted(key)


def test_prepend_space_equals_prepend_nospace_without_synonyms(spark, docs):
    vocab = fit_vocabulary(docs, ["tokens"])
    links = fx.topic_links_view(fx.load(spark, SF_SMALL, "documents"), fx.load(spark, SF_SMALL, "labels"))
    src = links.join(fx.load(spark, SF_SMALL, "documents").select("doc_id", "text"), "doc_id")
    from convprep.operators.keywords import prepare_keywords

    d10 = tokenize_dataset(prepare_keywords(src, "doc_id", "text", cluster=True), vocab)
    a = format_examples(d10, "prepend_nospace").withColumnRenamed("ids", "a")
    b = format_examples(d10, "prepend_space", vocab=vocab).withColumnRenamed("ids", "b")
    assert a.join(b, "id").where(F.col("a") != F.col("b")).count() == 0


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_dense_index_independent_of_partitioning(spark, parts):
    df = fx.load(spark, SF_SMALL, "documents").select("doc_id", "n_chars")
    got = dense_index(df, [F.desc("n_chars"), "doc_id"], num_buckets=parts).toPandas()
    exp = df.toPandas().sort_values(["n_chars", "doc_id"], ascending=[False, True]).reset_index(drop=True)
    exp["row_id"] = range(len(exp))
    merged = got.merge(exp, on="doc_id", suffixes=("", "_e"))
    assert len(merged) == len(exp) and (merged["row_id"] == merged["row_id_e"]).all()


def test_batches_are_permutations_and_padded_to_width(spark, docs):
    vocab = fit_vocabulary(docs, ["tokens"])
    seqs = encode(docs, ["doc_id"], ["tokens"], ["ids"], vocab).select(F.col("doc_id").alias("id"), "ids")
    n = seqs.count()
    seqs = with_row_id(seqs)
    assigned = assign_batches(seqs.select("id", ROW), batch_size=3, epochs=4, seed=1, row_id="id", num_buckets=5)
    per_epoch = assigned.groupBy("epoch").agg(F.countDistinct("id").alias("d"), F.count("*").alias("c")).collect()
    assert sorted(r["epoch"] for r in per_epoch) == [0, 1, 2, 3]
    assert all(r["d"] == n and r["c"] == n for r in per_epoch)
    pos = assigned.select((F.col("batch_id") * 3 + F.col("pos_in_batch")).alias("p"), "epoch")
    assert pos.groupBy("epoch").agg(F.max("p").alias("m"), F.countDistinct("p").alias("k")).where(
        (F.col("m") != n - 1) | (F.col("k") != n)).count() == 0
    orders = [r["ids"] for r in assigned.groupBy("epoch").agg(
        F.array_sort(F.collect_list(F.struct("batch_id", "pos_in_batch", "id"))).alias("ids")).collect()]
    assert len({tuple(x["id"] for x in o) for o in orders}) == 4  # a fresh permutation per epoch
    padded = pad_batches(assigned, seqs, "ids")
    assert padded.where(F.size("padded_ids") != F.col("width")).count() == 0
    widths = padded.groupBy("epoch", "batch_id").agg(F.countDistinct("width").alias("k"))
    assert widths.where(F.col("k") != 1).count() == 0


def test_batches_repeatable_across_partition_counts(spark):
    df = spark.range(0, 500).withColumnRenamed("id", "row_id")
    a = assign_batches(df, 7, 2, 9, num_buckets=1).toPandas().sort_values(["epoch", "row_id"]).reset_index(drop=True)
    b = assign_batches(df, 7, 2, 9, num_buckets=64).toPandas().sort_values(["epoch", "row_id"]).reset_index(drop=True)
    assert a.equals(b)


def test_shares_sum_to_one_and_top_p_keeps_one(spark):
    logits = fx.logits_view(fx.load(spark, SF_SMALL, "embeddings"))
    sm = softmax_by_group(logits, "vec_id", "l")
    sums = sm.groupBy("vec_id").agg(F.sum("p").alias("s"))
    assert sums.where(F.abs(F.col("s") - 1) > 1e-9).count() == 0
    cum = cumulative_share(sm, "vec_id", "tok", "l", "p")
    assert cum.groupBy("vec_id").agg(F.max("cum").alias("m")).where(F.abs(F.col("m") - 1) > 1e-9).count() == 0
    for p in [1e-12, 0.3, 0.99]:
        kept = top_p_filter(logits, "vec_id", "tok", "l", p=p).groupBy("vec_id").count()
        assert kept.count() == logits.select("vec_id").distinct().count()


@pytest.mark.parametrize("checkpointed", [False, True])
def test_dense_index_consistent_when_columns_are_pruned(spark, checkpointed):
    """Payload columns unused by the size count must not change bucket
    numbering (regression: two range exchanges sampled different bounds)."""
    from convprep.session import cut_lineage

    df = spark.range(0, 3000).withColumnRenamed("id", "row_id").withColumn("payload", F.col("row_id") % 11)
    if checkpointed:
        df = cut_lineage(df)
    a = assign_batches(df, 4, 3, 7, num_buckets=8).toPandas()
    assert a["batch_id"].min() == 0
    assert a.groupby(["epoch", "batch_id", "pos_in_batch"]).size().max() == 1
    assert (a.groupby("epoch")["row_id"].nunique() == 3000).all()
    d = dense_index(df, [F.desc("payload"), "row_id"], out="rank", num_buckets=8).toPandas()
    assert sorted(d["rank"]) == list(range(3000))
    exp = d.sort_values(["payload", "row_id"], ascending=[False, True])["rank"].tolist()
    assert exp == list(range(3000))


def test_dense_index_with_coalesced_ranges(spark):
    """Default bucket count (the session's shuffle partitions) with AQE free
    to coalesce adjacent ranges: numbering stays dense and ordered."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        df = spark.range(0, 5000).select(F.col("id").alias("k"), (F.col("id") * 7919 % 5000).alias("v"))
        got = dense_index(df, ["v", "k"], out="rn").toPandas().sort_values("rn")
        assert list(got["rn"]) == list(range(5000))
        assert list(got["v"]) == sorted(got["v"])
        a = assign_batches(df.withColumnRenamed("k", "row_id"), 3, 2, 5).toPandas()
        assert a.groupby(["epoch", "batch_id", "pos_in_batch"]).size().max() == 1
        assert (a.groupby("epoch")["row_id"].nunique() == 5000).all()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_vocabulary_min_count_and_max_size(spark, docs):
    full = fit_vocabulary(docs, ["tokens"]).toPandas()
    pruned = fit_vocabulary(docs, ["tokens"], min_count=3).toPandas()
    assert set(pruned["tok"]) == set(full.loc[full["n"] >= 3, "tok"])
    assert sorted(pruned["id"]) == list(range(len(pruned)))
    top = fit_vocabulary(docs, ["tokens"], max_size=50).toPandas().sort_values("id")
    assert list(top["tok"]) == list(full.sort_values("id")["tok"][:50])


@pytest.mark.parametrize("name", [
    "sender_training_set", "padded_batches", "sampled_candidates", "tokenized_keywords",
    "control_vectors", "shuffled_documents", "lineitem_nucleus",
])
def test_queries_independent_of_shuffle_partitions(spark, name):
    import __spark_entry__ as entry

    old = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for parts in ["1", "8", "64"]:
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            rows = entry.queries()[name](spark, SF_SMALL).collect()
            results.append(sorted(tuple(r) for r in rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1] == results[2]


def test_empty_inputs(spark):
    from convprep.operators.scores import sample_candidates, softmax_by_group

    empty = spark.createDataFrame([], "id long, text string")
    assert dense_index(empty, ["id"]).count() == 0
    toks = tokenize(empty, "text", "tokens")
    vocab = fit_vocabulary(toks, ["tokens"])
    assert vocab.count() == 0
    assert encode(toks, ["id"], ["tokens"], ["ids"], vocab).count() == 0
    assert assign_batches(empty.select(F.col("id").alias("row_id")), 2, 3, 1).count() == 0
    logits = spark.createDataFrame([], "g long, cand int, score double")
    assert softmax_by_group(logits, "g").count() == 0
    assert sample_candidates(logits, "g", "cand", "score", k=3, p=0.5).count() == 0
