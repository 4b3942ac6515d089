"""Sources and sinks: JSON exports with ragged keys, CSV round trips with
newlines and quotes, keyed records, per-sender stores, manifests."""

import json
import os

from pyspark.sql import functions as F

from convprep.functions.arrays import parse_id_list
from convprep.sources.messages import load_comments, read_keyed_records, read_message_export, read_records
from convprep.sources.sinks import (
    run_manifest,
    write_csv_table,
    write_metric_history,
    write_per_sender,
    write_run_manifest,
)
from convprep.sources.tables import chunk_text, read_csv_table


def _write(path, obj):
    with open(path, "w") as f:
        json.dump(obj, f, indent=2)


def test_export_files_union_ragged_and_missing_content(spark, tmp_dir):
    _write(os.path.join(tmp_dir, "message_1.json"), {"messages": [
        {"sender_name": "a", "content": "hi\nthere", "type": "Generic", "photos": [{"uri": "x"}]},
        {"sender_name": "b", "type": "Generic"},
    ], "title": "t"})
    _write(os.path.join(tmp_dir, "message_2.json"), {"messages": [
        {"sender_name": "a", "content": "say \"yes\"", "type": "Share", "extra": 1},
    ]})
    df = read_message_export(spark, os.path.join(tmp_dir, "message_*.json"))
    rows = sorted((r["file_name"].rsplit("/", 1)[-1], r["pos"], r["sender_name"], r["content"], r["type"]) for r in df.collect())
    assert rows == [
        ("message_1.json", 0, "a", "hi\nthere", "Generic"),
        ("message_1.json", 1, "b", None, "Generic"),
        ("message_2.json", 0, "a", 'say "yes"', "Share"),
    ]
    # explicit schema keeps the scan narrow: unused fields are not read
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "photos" not in plan
    comments = load_comments(spark, os.path.join(tmp_dir, "message_*.json"), "content", kind="export")
    assert [r["row_id"] for r in comments.orderBy("row_id").collect()] == [0, 1]


def test_csv_round_trip_keeps_newlines_quotes_and_lists(spark, tmp_dir):
    df = spark.createDataFrame(
        [(0, 'line1\nline2 "quoted", comma', [1, 2, 3]), (1, "", [])], "id long, text string, token_ids array<int>")
    path = os.path.join(tmp_dir, "csv")
    write_csv_table(df, path)
    back = read_csv_table(spark, path, schema="id long, text string, token_ids string")
    got = sorted((r["id"], r["text"], r["ids"]) for r in back.select("id", "text", parse_id_list("token_ids").alias("ids")).collect())
    assert got == [(0, 'line1\nline2 "quoted", comma', [1, 2, 3]), (1, None, [])] or \
        got == [(0, 'line1\nline2 "quoted", comma', [1, 2, 3]), (1, "", [])]


def test_records_and_keyed_records(spark, tmp_dir):
    rec = os.path.join(tmp_dir, "records.jsonl")
    with open(rec, "w") as f:
        f.write(json.dumps({"id": 1, "body": "x"}) + "\n" + json.dumps({"id": 2, "body": None}) + "\n")
    df = read_records(spark, rec, "body")
    assert sorted(df.columns) == ["id", "text"]
    keyed = os.path.join(tmp_dir, "keyed.json")
    _write(keyed, {"k1": {"body": "one", "kind": "a"}, "k2": {"body": "two", "kind": "b"}})
    out = read_keyed_records(spark, keyed, "struct<body:string,kind:string>", "body")
    assert sorted((r["id"], r["text"], r["kind"]) for r in out.collect()) == [("k1", "one", "a"), ("k2", "two", "b")]


def test_per_sender_store_prunes_partitions(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "a", "z")], "id long, sender_name string, content string")
    path = os.path.join(tmp_dir, "senders")
    write_per_sender(df, path)
    back = spark.read.parquet(path).where(F.col("sender_name") == "a")
    assert sorted(r["id"] for r in back.collect()) == [1, 3]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sender_name" in plan


def test_per_sender_store_writes_few_files(spark, tmp_dir):
    import glob

    df = spark.range(5000).selectExpr("id", "concat('s', id % 5) as sender_name").repartition(64)
    path = os.path.join(tmp_dir, "few")
    write_per_sender(df, path)
    files = glob.glob(f"{path}/*/*.parquet")
    assert 5 <= len(files) <= 10 and spark.read.parquet(path).count() == 5000


def test_manifest_and_metric_history(spark, tmp_dir):
    ds = spark.createDataFrame([(0, [1, 2]), (1, [1, 2, 3, 4])], "id long, token_ids array<int>")
    m = run_manifest(spark, {"epochs": 10, "batch_size": 2}, ds).first()
    assert (m["epochs"], m["batch_size"], m["n_rows"], m["min_len"], m["max_len"]) == ("10", "2", 2, 2, 4)
    write_run_manifest(spark, os.path.join(tmp_dir, "manifest"), {"epochs": 10}, ds)
    assert spark.read.json(os.path.join(tmp_dir, "manifest")).count() == 1
    hist = spark.createDataFrame([(1, 0.5), (0, 0.75)], "epoch int, value double")
    write_metric_history(hist, os.path.join(tmp_dir, "loss"))
    back = spark.read.option("header", True).csv(os.path.join(tmp_dir, "loss")).collect()
    assert [(r["epoch"], r["value"]) for r in back] == [("0", "0.75"), ("1", "0.5")]


def test_chunk_text_windows(spark):
    words = [f"w{i}" for i in range(10)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "   ")], "id long, text string")
    got = [(r["chunk"], r["text"]) for r in chunk_text(df, "id", size=4, step=3).orderBy("chunk").collect()]
    expected = [(i, " ".join(words[s:s + 4])) for i, s in enumerate(range(0, 10, 3))]
    assert got == expected


def test_corpus_source_chunks_and_indexes(spark, tmp_dir):
    words = [f"w{i}" for i in range(10)]
    with open(os.path.join(tmp_dir, "corpus.txt"), "w") as f:
        f.write(" ".join(words[:5]) + "\n" + " ".join(words[5:]))
    rows = load_comments(spark, os.path.join(tmp_dir, "corpus.txt"), "text", kind="corpus", size=4, step=4)
    got = [(r["row_id"], r["text"]) for r in rows.orderBy("row_id").collect()]
    assert got == [(0, "w0 w1 w2 w3"), (1, "w4 w5 w6 w7"), (2, "w8 w9")]


def test_export_as_json_lines(spark, tmp_dir):
    path = os.path.join(tmp_dir, "lines.json")
    with open(path, "w") as f:
        f.write(json.dumps({"messages": [{"sender_name": "a", "content": "x", "type": "Generic"}]}) + "\n")
        f.write(json.dumps({"messages": [{"sender_name": "b", "content": "y", "type": "Generic"},
                                         {"sender_name": "c", "type": "Share"}]}) + "\n")
    df = read_message_export(spark, path, multi_line=False)
    assert sorted((r["pos"], r["sender_name"], r["content"]) for r in df.collect()) == [
        (0, "a", "x"), (0, "b", "y"), (1, "c", None)]


def test_training_set_from_export_path_and_stored_csv(spark, tmp_dir):
    from convprep.operators.examples import stored_sequences
    from convprep.plans.training_set import sender_training_set

    for i in range(2):
        _write(os.path.join(tmp_dir, f"message_{i}.json"), {"messages": [
            {"sender_name": "u", "content": f"hello world {i} again", "type": "Generic"},
            {"sender_name": "u", "content": "one", "type": "Generic"},
            {"sender_name": "v", "content": "not me", "type": "Generic"},
        ]})
    ts, vocab = sender_training_set(os.path.join(tmp_dir, "message_*.json"), "u")
    rows = sorted((r["file_name"].rsplit("/", 1)[-1], r["pos"], r["n_tokens"]) for r in ts.collect())
    assert rows == [("message_0.json", 0, 4), ("message_1.json", 0, 4)]  # "one" is too short
    csv = os.path.join(tmp_dir, "stored")
    write_csv_table(ts.select(F.col("row_id").alias("id"), "token_ids"), csv)
    batches = stored_sequences(csv, "token_ids", "id", batch_size=2, epochs=1, seed=0)
    got = batches.collect()
    assert len(got) == 2 and all(len(r["padded_ids"]) == r["width"] == 4 for r in got)


def test_stored_sequences_from_parquet_stage(spark, tmp_dir):
    from convprep.operators.examples import stored_sequences
    from convprep.sources.sinks import write_dataset

    df = spark.createDataFrame([(0, [1, 2]), (1, [3, 4, 5]), (2, [6])], "id long, token_ids array<int>")
    write_dataset(df, os.path.join(tmp_dir, "stage"))
    out = stored_sequences(spark.read.parquet(os.path.join(tmp_dir, "stage")), "token_ids", "id", batch_size=3)
    got = {r["id"]: r["padded_ids"] for r in out.collect()}
    assert got == {0: [1, 2, 0], 1: [3, 4, 5], 2: [6, 0, 0]}


def test_load_comments_needs_an_order(spark):
    import pytest

    df = spark.createDataFrame([("a",), ("b",)], "body string")
    with pytest.raises(ValueError):
        load_comments(spark, df, "body")
    assert load_comments(spark, df, "body", order=["text"]).count() == 2
