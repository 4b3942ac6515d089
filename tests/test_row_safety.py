"""Null and repeated keys, null groups, text candidates, numbered files, broken
input: no row is lost, mixed or changed."""

import json

import pytest
from pyspark.sql import functions as F

from convprep.operators.examples import apply_batch, batch_examples, pad_batches, stored_sequences
from convprep.operators.index import assign_batches, dense_index
from convprep.operators.keywords import prepare_keywords, translate_keywords
from convprep.operators.scores import argmax_by_group, cross_entropy, softmax_by_group, top_k_filter, top_p_filter
from convprep.operators.lookup import block_counts, code_blocks, lookup_arrays
from convprep.operators.tokens import decode, encode, fit_encode, fit_subword_merges, fit_vocabulary, pretokenize, subword_pieces
from convprep.operators.vectors import control_vectors
from convprep.plans.fixtures import topic_links_view
from convprep.plans.training_set import sender_training_set
from convprep.sources.messages import load_comments, read_keyed_records, read_message_export, read_records
from convprep.sources.sinks import write_csv_table
from convprep.sources.tables import chunk_text, read_csv_table


def test_translation_is_one_answer_for_dict_and_table(spark):
    rows = [(None, ["x", "q"]), (1, ["x", "y"]), (1, ["z"]), (2, [None, "x"]), (2, ["x", None]), (3, None), (3, None)]
    df = spark.createDataFrame(rows, "id long, keywords array<string>")
    small = {"x": "X"}
    big = small | {f"k{i}": "v" for i in range(10_001)}
    table = spark.createDataFrame([("x", "X")], "keyword string, translation string")
    answers = [sorted(map(str, translate_keywords(df, s).select("id", "keywords", "used_keywords").collect()))
               for s in (small, big, table)]
    assert answers[0] == answers[1] == answers[2] and len(answers[0]) == len(rows)
    assert not any("\\x00" in a for a in answers[2])


def test_encode_keeps_rows_of_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a"), (2, "a"), (2, "b c"), (2, "b c"), (3, None)], "id long, text string")
    vocab = fit_vocabulary(df, [pretokenize("text")])
    for out in (encode(df, ["id"], [pretokenize("text")], ["ids"], vocab), fit_encode(df, [pretokenize("text")], ["ids"])[0]):
        got = sorted((str(r["id"]), r["text"] or "", len(r["ids"] or [])) for r in out.select("id", "text", "ids").collect())
        assert got == [("2", "a", 1), ("2", "b c", 2), ("2", "b c", 2), ("3", "", 0), ("None", "a", 1)]


def test_hot_mode_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, 1, 0.5), (None, 2, 1.5), (1, 1, 2.0), (1, 2, 1.0)], "g long, cand int, score double")

    def same(fn):
        a, b = (sorted(map(str, fn(h).collect())) for h in (False, True))
        assert a == b and a

    same(lambda h: softmax_by_group(df, "g", hot_groups=h).select("g", "cand", F.round("p", 9).alias("p")))
    same(lambda h: top_k_filter(df, "g", k=1, hot_groups=h, cand="cand").select("g", "cand"))
    same(lambda h: top_p_filter(df, "g", p=0.3, hot_groups=h).select("g", "cand"))
    t = df.withColumn("target", F.lit(1))
    same(lambda h: cross_entropy(t, "g", hot_groups=h).select("g", F.round("loss", 9).alias("loss")))


def test_argmax_of_text_candidates(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (1, "a", 2.0), (1, "c", 1.0), (2, "z", None), (2, "y", 0.0)],
                               "g long, cand string, score double")
    assert dict(argmax_by_group(df, "g").collect()) == {1: "a", 2: "y"}


def test_numbered_exports_are_read_in_numeric_order(spark, tmp_dir):
    for i in range(1, 13):
        with open(f"{tmp_dir}/message_{i}.json", "w") as f:
            json.dump({"messages": [{"sender_name": "s", "content": f"m{i}", "type": "Generic"}]}, f)
    rows = load_comments(spark, tmp_dir, "content", kind="export").orderBy("row_id").collect()
    assert [r["text"] for r in rows] == [f"m{i}" for i in range(1, 13)]


def test_csv_keeps_outer_blanks(spark, tmp_dir):
    texts = ["  lead", "trail  ", "\ttab", 'a "quoted" one', "back\\slash", "two\nlines", "a,b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    write_csv_table(df, f"{tmp_dir}/csv")
    assert [r["text"] for r in read_csv_table(spark, f"{tmp_dir}/csv").orderBy(F.col("id").cast("int")).collect()] == texts


def test_broken_input_stops_the_run(spark, tmp_dir):
    with open(f"{tmp_dir}/bad.json", "w") as f:
        f.write('{"messages": [{"sender_name": ')
    with pytest.raises(Exception):
        read_message_export(spark, f"{tmp_dir}/bad.json").collect()
    with pytest.raises(Exception):
        read_records(spark, f"{tmp_dir}/bad.json", "t", schema="t string").collect()
    with pytest.raises(Exception):
        read_keyed_records(spark, f"{tmp_dir}/bad.json", "struct<text:string>", "text").collect()
    with pytest.raises(Exception):
        stored_sequences(spark.createDataFrame([(1, "[1, 2]"), (2, "[1, x")], "id long, token_ids string")).collect()
    with pytest.raises(ValueError):
        chunk_text(spark.createDataFrame([(1, "a b")], "id long, text string"), "id", size=2, step=3)


def test_subword_pieces_give_the_text_back(spark):
    rows = [(None, "ab\u0001cd ab"), (1, "ab ab"), (1, "cd"), (2, None), (2, "ab\u0001cd ab")]
    df = spark.createDataFrame(rows, "id long, text string")
    merges = fit_subword_merges(df, n_merges=4)
    assert all("\u0001" not in r["merged"] for r in merges.collect())
    out = subword_pieces(df, ["id"], merges).collect()
    key = str
    assert sorted(((r["id"], "".join(r["pieces"])) for r in out), key=key) == sorted(
        ((i, t or "") for i, t in rows), key=key)


def test_dense_index_numbers_null_groups(spark):
    df = spark.createDataFrame([(None, i) for i in range(5)] + [(g, i) for g in range(40) for i in range(3)], "g long, i long")
    got = sorted((str(r["g"]), r["i"], r["n"]) for r in dense_index(df, ["i"], out="n", partition_by=["g"]).collect())
    assert got == sorted((str(r["g"]), r["i"], r["i"]) for r in df.collect())


def test_documents_without_labels_have_no_keywords(spark):
    docs = spark.createDataFrame([(1, "a", "s", "en"), (2, "b", "s", "en")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    kw = prepare_keywords(topic_links_view(docs, labels, keep=("text",)), "doc_id", "text", cluster=True)
    assert {r["id"]: r["keywords"] for r in kw.collect()} == {1: [], 2: ["quality", "toxic", "s"]}


# ---- a row is a row, whatever its key --------------------------------------

THREE = [(1, [1, 2, 3]), (1, [4, 5]), (None, [6, 7])]


def three(spark):
    return spark.createDataFrame(THREE, "id long, ids array<long>")


def test_batches_of_repeated_and_null_keys(spark):
    got = batch_examples(three(spark), batch_size=2, epochs=3, seed=1).collect()
    for e in range(3):
        rows = [r for r in got if r["epoch"] == e]
        assert sorted((str(r["id"]), r["padded_ids"][:2]) for r in rows) == [("1", [1, 2]), ("1", [4, 5]), ("None", [6, 7])]
        assert sorted((r["batch_id"], r["pos_in_batch"]) for r in rows) == [(0, 0), (0, 1), (1, 0)]
        for r in rows:
            assert len(r["padded_ids"]) == r["width"] == max(
                len([i for i in x["padded_ids"] if i]) for x in rows if x["batch_id"] == r["batch_id"])
    with pytest.raises(ValueError, match="row ids"):
        pad_batches(assign_batches(three(spark), 2, 1, 1, row_id="id"), three(spark))


def test_batch_order_of_repeated_keys_is_the_same_on_every_run(spark):
    df = spark.createDataFrame([(i % 3, [i, i + 1]) for i in range(60)], "id long, ids array<long>")

    def run(n):
        return sorted((r["epoch"], r["batch_id"], r["pos_in_batch"], r["padded_ids"])
                      for r in batch_examples(df.repartition(n), batch_size=4, epochs=2, seed=3).collect())

    assert run(1) == run(7)


def test_stored_sequences_of_repeated_and_null_keys(spark):
    got = stored_sequences(three(spark).withColumnRenamed("ids", "token_ids"), batch_size=3).collect()
    assert sorted((str(r["id"]), [i for i in r["padded_ids"] if i]) for r in got) == sorted((str(i), x) for i, x in THREE)


def test_training_set_of_repeated_and_null_order(spark):
    rows = [(1, 1, "a b"), (1, 1, "c d e"), (None, 2, "f g")]
    msgs = spark.createDataFrame([(c, t, "u", x, "Generic") for c, t, x in rows],
                                 "conv_id long, turn long, sender_name string, content string, type string")
    ts, vocab = sender_training_set(msgs, "u")
    got = decode(ts, ["row_id"], "token_ids", vocab).orderBy("row_id").collect()
    assert [(r["row_id"], r["conv_id"], r["decoded"]) for r in got] == [(0, None, "f g"), (1, 1, "a b"), (2, 1, "c d e")]
    given, _ = sender_training_set(msgs, "u", vocab=vocab)
    assert sorted(given.collect()) == sorted(ts.collect())


def test_control_vectors_of_repeated_and_null_keys(spark):
    emb = spark.createDataFrame([(0, [0.0, 2.0]), (1, [1.0, 4.0])], "token_id long, embedding array<double>")
    df = spark.createDataFrame([(1, [0]), (1, [1]), (None, [0, 1]), (None, None)], "id long, keyword_ids array<long>")
    got = control_vectors(df, "id", emb, dim=2, seed=4).collect()
    assert sorted((str(r["id"]), r["n_vectors"], r["vector"]) for r in got if r["n_vectors"]) == [
        ("1", 1, [0.0, 2.0]), ("1", 1, [1.0, 4.0]), ("None", 2, [0.5, 3.0])]
    assert len(got) == 4


def test_maps_and_alike_rows_keep_their_own_tokens(spark):
    df = spark.createDataFrame([(1, {"k": "x y"}), (1, {"k": "z w"}), (1, {"k": "z w"})], "id long, m map<string,string>")
    enc, vocab = fit_encode(df, [pretokenize(F.col("m")["k"])], ["ids"])
    back = decode(enc, ["id"], "ids", vocab).collect()
    assert sorted((r["m"]["k"], r["decoded"]) for r in back) == [("x y", "x y"), ("z w", "z w"), ("z w", "z w")]


# ---- block dictionaries ----------------------------------------------------

@pytest.mark.parametrize("size", [1, 3, 200_000])
def test_block_lookup_of_several_arrays_and_sizes(spark, size):
    import random

    rng = random.Random(size)
    rows = [(i % 5 if i % 7 else None, [rng.choice(["a", "b", "c", "zz", None]) for _ in range(rng.randrange(6))] if i % 11 else None,
             [rng.choice(["c", "q"])] * (i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x array<string>, y array<string>").repartition(4)
    table = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v long")
    val = {"a": 1, "b": 2, "c": 3}

    def run(**kw):
        out = lookup_arrays(df, ["id"], ["x", "y"], ["vx", "vy"], table, "k", "v", "bigint", block_elements=size, **kw)
        return sorted((str(r["id"]), str(r["x"]), str(r["y"]), str(r["vx"]), str(r["vy"])) for r in out.collect())

    def want(fn):
        return sorted((str(i), str(x), str(y), str(None if x is None else fn(x)), str(fn(y))) for i, x, y in rows)

    assert run() == want(lambda x: [val.get(e) for e in x])
    assert run(default=-1) == want(lambda x: [val.get(e, -1) for e in x])
    assert run(inner=True) == want(lambda x: [val[e] for e in x if e in val])


def test_block_counts_are_token_counts(spark):
    df = spark.createDataFrame([(["a", "b", "a", None],), ([],), (None,), (["a"],)], "t array<string>").repartition(3)
    assert sorted(tuple(r) for r in block_counts(code_blocks(df, ["t"], block_elements=2)).collect()) == [("a", 3), ("b", 1)]


def test_apply_batch_cuts_where_keys_change(spark):
    import pandas as pd

    df = spark.createDataFrame([(i // 3, i) for i in range(2000)], "batch_id long, v long").repartition(9)

    def total(pdf):
        return pd.DataFrame({"batch_id": [pdf["batch_id"].iloc[0]], "n": [len(pdf)], "s": [pdf["v"].sum()]})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = apply_batch(df, total, "batch_id long, n long, s long", keys=["batch_id"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(tuple(r) for r in got) == [(b, len(v), sum(v)) for b in range(667) for v in [range(3 * b, min(2000, 3 * b + 3))]]
