"""A sender's training set, end to end.

export -> sender -> non-null content -> generic type -> comments with
``row_id`` -> blank tokens -> vocabulary -> ids -> cut at ``max_len`` ->
drop sequences shorter than ``min_len``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from convprep.functions.arrays import size_of, truncate_sequence
from convprep.functions.text import pretokenize
from convprep.operators.index import dense_index
from convprep.operators.rows import (
    drop_missing_text,
    drop_short_sequences,
    filter_message_type,
    filter_sender,
    rename_text,
)
from convprep.operators.tokens import encode, fit_encode
from convprep.sources.messages import file_order

# The reference's sequence limits.
MAX_LEN = 1023
MIN_LEN = 2


def select_sender_messages(messages: DataFrame, sender: str, kind: str = "Generic") -> DataFrame:
    """One sender's non-null messages of one type."""
    return filter_message_type(drop_missing_text(filter_sender(messages, sender), "content"), kind)


def sender_training_set(
    messages: DataFrame | str,
    sender: str,
    order: Sequence[str] = ("conv_id", "turn"),
    vocab: DataFrame | None = None,
    max_len: int = MAX_LEN,
    min_len: int = MIN_LEN,
    pattern: str = "blank",
) -> tuple[DataFrame, DataFrame]:
    """Returns ``(training_set, vocab)``. ``messages`` is a message frame or
    a chat export path (then ``order`` is the file and message position).

    ``training_set``: ``row_id`` (dense, in ``order``) + ``order`` columns +
    ``text, token_ids, n_tokens``. Without ``vocab`` one is fitted on the
    selected messages. Ids are numbered before short rows are dropped, as in
    the reference, so ``row_id`` may have gaps.
    """
    if isinstance(messages, str):
        # A chat export path or glob (S1); its order columns are the file and
        # the position in the file's message list.
        from pyspark.sql import SparkSession

        from convprep.sources.messages import read_message_export

        messages = read_message_export(SparkSession.getActiveSession(), messages)
        order = ("file_name", "pos")
    picked = rename_text(select_sender_messages(messages, sender), "content")
    picked = drop_missing_text(picked, "text").select(*order, "text")
    # Numbered once, as the first written stage; the number is the row's identity
    # from here on, so order columns may be null or repeat (then the text decides).
    by = [*file_order("file_name"), *[c for c in order if c != "file_name"]] if "file_name" in order else list(order)
    rows = dense_index(picked, [*by, "text"], out="row_id")
    tokens = [pretokenize("text", pattern)]
    if vocab is None:
        enc, vocab = fit_encode(rows, tokens, ["token_ids"])
    else:
        enc = encode(rows, ["row_id"], tokens, ["token_ids"], vocab)
    kept = drop_short_sequences(enc.withColumn("token_ids", truncate_sequence("token_ids", max_len)), "token_ids", min_len)
    out = kept.select("row_id", *order, "text", "token_ids", size_of("token_ids").alias("n_tokens"))
    return out, vocab


__all__ = ["MAX_LEN", "MIN_LEN", "select_sender_messages", "sender_training_set"]
