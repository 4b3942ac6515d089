"""Stateless message preparation on a file stream.

The reference reads everything before it starts, so there is no state,
watermark or window to carry over. The per-row operators (S1 flatten, P5-P7
filters, P1 rename, H1 tokens, H9 cut, P8 length filter) run unchanged on a
streaming DataFrame; ``availableNow`` processes all files present and stops,
which gives the batch result incrementally and survives restarts through
the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convprep.functions.arrays import size_of, truncate_sequence
from convprep.functions.text import pretokenize
from convprep.operators.rows import drop_short_sequences, rename_text
from convprep.plans.training_set import select_sender_messages
from convprep.sources.messages import MESSAGE_FIELDS, export_schema


def read_message_stream(
    spark: SparkSession, path: str, message_fields: T.StructType = MESSAGE_FIELDS, max_files_per_trigger: int | None = None
) -> DataFrame:
    """S1 on a stream: one row per message of each new export file."""
    reader = spark.readStream.schema(export_schema(message_fields)).option("multiLine", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.json(path)
    names = [f.name for f in message_fields.fields]
    return raw.select(F.col("_metadata.file_path").alias("file_name"), F.posexplode("messages").alias("pos", "m")).select(
        "file_name", F.col("pos").cast("bigint").alias("pos"), *[F.col(f"m.{n}").alias(n) for n in names]
    )


def sender_tokens(messages: DataFrame, sender: str, max_len: int = 1023, min_len: int = 2, pattern: str = "blank") -> DataFrame:
    """Stateless part of C10: sender, non-null, generic, tokens cut to
    ``max_len``, rows with fewer than ``min_len`` tokens dropped."""
    picked = rename_text(select_sender_messages(messages, sender), "content")
    toks = picked.withColumn("tokens", truncate_sequence(pretokenize("text", pattern), max_len))
    kept = drop_short_sequences(toks, "tokens", min_len)
    return kept.withColumn("n_tokens", size_of("tokens"))


def run_available_now(df: DataFrame, out_path: str, checkpoint_path: str, fmt: str = "parquet") -> None:
    """Process every file present now, write ``fmt`` files, stop."""
    q = (
        df.writeStream.format(fmt)
        .option("checkpointLocation", checkpoint_path)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(out_path)
    )
    q.awaitTermination()
    exc = q.exception()
    if exc is not None:
        raise RuntimeError(str(exc))
