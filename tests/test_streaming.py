"""Streaming parity: the stateless operators give the batch result."""

import json
import os

from convprep.plans.training_set import select_sender_messages
from convprep.sources.messages import read_message_export
from convprep.streaming.messages import read_message_stream, run_available_now, sender_tokens


def test_available_now_equals_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "src")
    os.makedirs(src)
    for i in range(3):
        msgs = [{"sender_name": "u" if j % 2 else "v", "content": f"m{i} {j} word" if j != 3 else None,
                 "type": "Generic" if j != 4 else "Share"} for j in range(6)]
        with open(os.path.join(src, f"message_{i}.json"), "w") as f:
            json.dump({"messages": msgs}, f)
    out, ckpt = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ckpt")
    run_available_now(sender_tokens(read_message_stream(spark, src), "u"), out, ckpt)
    streamed = sorted((r["file_name"], r["pos"], r["n_tokens"]) for r in spark.read.parquet(out).collect())
    batch = sender_tokens(read_message_export(spark, src), "u")
    assert streamed == sorted((r["file_name"], r["pos"], r["n_tokens"]) for r in batch.collect())
    assert len(streamed) == select_sender_messages(read_message_export(spark, src), "u").count()


def test_one_file_per_trigger_and_restart(spark, tmp_dir):
    """Files processed one per micro-batch give the batch result; a second
    run over the same checkpoint only picks up files that arrived since."""
    src = os.path.join(tmp_dir, "src")
    os.makedirs(src)

    def export(i):
        msgs = [{"sender_name": "u", "content": f"file {i} message {j}", "type": "Generic"} for j in range(3)]
        with open(os.path.join(src, f"message_{i}.json"), "w") as f:
            json.dump({"messages": msgs}, f)

    for i in range(3):
        export(i)
    out, ckpt = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ckpt")
    run_available_now(sender_tokens(read_message_stream(spark, src, max_files_per_trigger=1), "u"), out, ckpt)
    assert spark.read.parquet(out).count() == 9
    export(3)  # a new file after the first run
    run_available_now(sender_tokens(read_message_stream(spark, src, max_files_per_trigger=1), "u"), out, ckpt)
    rows = spark.read.parquet(out)
    assert rows.count() == 12
    assert rows.select("file_name", "pos").distinct().count() == 12  # nothing processed twice
