"""Training examples and padded batches.

Training-loop code in the reference builds these one row at a time; here
each format is one projection and batches are a key-only range shuffle plus
joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convprep.functions.arrays import concat_ids, ids_text, pad_sequence, parse_id_list
from convprep.functions.text import prepend_text, pretokenize
from convprep.operators.index import ROW, assign_batches, with_row_id
from convprep.operators.tokens import UNK_ID, encode

KINDS = ("prepend_nospace", "prepend_space", "keyword")


def format_examples(
    df: DataFrame,
    kind: str,
    vocab: DataFrame | None = None,
    pattern: str = "blank",
    unk_id: int | None = UNK_ID,
    same_vocab: bool = False,
) -> DataFrame:
    """C5 on a D10 table (``id, text, keywords, used_keywords, text_ids,
    keyword_ids``):

    * ``prepend_nospace``: ``(id, ids)`` with ``ids = keyword_ids + text_ids``;
    * ``prepend_space``: ``(id, ids)``: the text with the ``keywords``
      (not ``used_keywords``) put in front, last first, re-encoded with
      ``vocab``. With ``same_vocab`` the caller says that ``text_ids`` come from
      this vocabulary and pattern; split at blanks, the joined text has the
      tokens of the keywords and then those of the text, so only the
      keywords are encoded;
    * ``keyword``: ``(id, text_ids, keyword_ids)``.
    """
    if kind == "prepend_nospace":
        return df.select("id", concat_ids("keyword_ids", "text_ids").alias("ids"))
    if kind == "prepend_space":
        if vocab is None:
            raise ValueError("prepend_space re-encodes text: give vocab")
        if same_vocab and pattern == "blank":
            front = F.array_join(F.reverse(F.coalesce("keywords", F.array().cast("array<string>"))), " ")
            staged = df.select("id", "text_ids", pretokenize(front, pattern).alias("_cp_t"))
            enc = encode(staged, ["id", "text_ids"], ["_cp_t"], ["_cp_k"], vocab, unk_id=unk_id, join_back=False)
            none = F.array().cast("array<bigint>")
            return enc.select("id", concat_ids("_cp_k", F.coalesce("text_ids", none)).alias("ids"))
        staged = df.select("id", "text", "keywords")
        staged = staged.select("id", pretokenize(prepend_text("text", "keywords"), pattern).alias("_cp_t"))
        return encode(staged, ["id"], ["_cp_t"], ["ids"], vocab, unk_id=unk_id, join_back=False)
    if kind == "keyword":
        return df.select("id", "text_ids", "keyword_ids")
    raise ValueError(f"unknown kind {kind!r}; one of {KINDS}")


def prepend_control_examples(df: DataFrame) -> DataFrame:
    """Keyword ids before text ids (same as ``prepend_nospace``)."""
    return format_examples(df, "prepend_nospace")


def bag_of_words_examples(df: DataFrame) -> DataFrame:
    """Text ids with ragged keyword ids (same as ``keyword``)."""
    return format_examples(df, "keyword")


def max_len_per_batch(df: DataFrame, ids: str | None = "ids", out: str = "width", sizes: str | None = None) -> DataFrame:
    """The padding width, the longest list of the batch (from the list
    column ``ids``, or from a precomputed size column ``sizes``)."""
    w = Window.partitionBy("epoch", "batch_id")
    n = F.col(sizes) if sizes is not None else F.size(ids)
    return df.withColumn(out, F.max(n).over(w).cast("int"))


def pad_batches(
    assigned: DataFrame,
    examples: DataFrame,
    ids: str = "ids",
    pad_id: int = 0,
    key: str = "id",
    keep: Sequence[str] = (),
    sizes: str | None = None,
) -> DataFrame:
    """Padded batches from a batch assignment (W6) and examples.

    Both come from one frame with surrogate row ids
    (:func:`convprep.operators.index.with_row_id`) and are joined by them, so
    rows with null or repeated keys come back once per epoch, with their own
    lists. Only narrow columns take the batch-wide steps: the width is a window
    max per ``(epoch, batch_id)`` over list sizes, and the wide lists are joined
    once at the end. When ``assigned`` already carries the list size in a
    ``sizes`` column, no size join is needed. ``keep`` carries extra example
    columns unpadded (the ragged keyword ids of the ``keyword`` kind). Output
    ``epoch, batch_id, pos_in_batch, key, width, padded_ids, keep...``.
    """
    for name, df in (("assigned", assigned), ("examples", examples)):
        if ROW not in df.columns:
            raise ValueError(f"{name} has no row ids: take both from with_row_id()")
    narrow = assigned.select("epoch", "batch_id", "pos_in_batch", ROW, *([sizes] if sizes else []))
    if not sizes:
        sizes = "_cp_n"
        narrow = narrow.join(examples.select(ROW, F.size(ids).alias(sizes)), ROW)
    narrow = max_len_per_batch(narrow, None, "width", sizes=sizes).drop(sizes)
    wide = narrow.join(examples.select(ROW, key, ids, *keep), ROW)
    return wide.select(
        "epoch", "batch_id", "pos_in_batch", key, "width",
        pad_sequence(ids, F.col("width"), pad_id).alias("padded_ids"), *keep,
    )


def assign_examples(
    examples: DataFrame, batch_size: int, epochs: int, seed: int, ids: str = "ids", key: str = "id",
) -> tuple[DataFrame, DataFrame]:
    """W6 over examples: ``(assigned, examples)``, both with row ids.

    ``assigned`` is narrow: ``key``, the list's size ``n_ids``, and the batch.
    The order of an epoch is that of ``md5(seed:epoch:key)``; examples that share a key go
    by their lists, and examples alike in both are told apart by their row id.
    """
    staged = with_row_id(examples)
    narrow = staged.select(ROW, key, F.size(ids).alias("n_ids"), F.md5(ids_text(ids)).alias("_cp_tie"))
    return assign_batches(narrow, batch_size, epochs, seed, row_id=key, ties=["_cp_tie"]).drop("_cp_tie"), staged


def batch_examples(
    examples: DataFrame, batch_size: int, epochs: int, seed: int, ids: str = "ids", pad_id: int = 0,
    key: str = "id", keep: Sequence[str] = (),
) -> DataFrame:
    """Examples -> shuffled, padded batches; every example once per
    epoch, whatever its key."""
    assigned, staged = assign_examples(examples.select(key, ids, *keep), batch_size, epochs, seed, ids, key)
    return pad_batches(assigned, staged, ids, pad_id, key, keep, sizes="n_ids")


def stored_sequences(
    stored: DataFrame | str,
    sample_column: str = "token_ids",
    key: str = "id",
    batch_size: int = 2,
    epochs: int = 1,
    seed: int = 0,
    pad_id: int = 0,
) -> DataFrame:
    """A stored set with id lists as text -> parsed -> padded batches.

    ``stored`` is a DataFrame (lists as text, or native arrays from a Parquet
    stage) or the path of a stored CSV set (S2). A list that does not parse
    stops the run; rows without a list are left out.
    """
    if isinstance(stored, str):
        from pyspark.sql import SparkSession

        from convprep.sources.tables import read_csv_table

        stored = read_csv_table(SparkSession.getActiveSession(), stored)
    from pyspark.sql import types as T

    if isinstance(stored.schema[sample_column].dataType, T.ArrayType):
        ids = F.col(sample_column).cast("array<bigint>")  # Parquet stage (S9): native lists
    else:
        # CSV stage (S7): lists as text, each parsed once
        bad = F.concat(F.lit("not a list of ids: "), F.col(sample_column))
        ids = F.coalesce(parse_id_list(sample_column), F.raise_error(bad))
    parsed = stored.where(F.col(sample_column).isNotNull()).select(F.col(key), ids.alias("ids"))
    return batch_examples(parsed, batch_size, epochs, seed, "ids", pad_id, key)


def token_pairs(
    df: DataFrame, key: Sequence[str], col: str, ctrl: str | int | None = None
) -> DataFrame:
    """One row per (context, target) along each sequence.

    Without ``ctrl``: next-token pairs ``(t[i], t[i+1])``; with ``ctrl`` the
    control element predicts token 0 and each token the next:
    ``(ctrl, t[0]), (t[0], t[1]), ...``. Pairs are cut from the array of
    each row (``arrays_zip``), so no shuffle or window is needed. Output
    ``key..., pos, context, target`` with ``pos`` the target's position.
    """
    seq = F.col(col)
    if ctrl is None:
        ctx = F.slice(seq, 1, F.greatest(F.size(seq) - 1, F.lit(0)))
        tgt = F.slice(seq, 2, F.greatest(F.size(seq) - 1, F.lit(0)))
        offset = 1
    else:
        ctx = F.concat(F.array(F.lit(ctrl).cast(df.schema[col].dataType.elementType)), F.slice(seq, 1, F.greatest(F.size(seq) - 1, F.lit(0))))
        tgt = seq
        offset = 0
    zipped = F.arrays_zip(ctx.alias("context"), tgt.alias("target"))
    # posexplode_outer + filter: a plain posexplode makes Catalyst add
    # filters that rebuild the zipped arrays once more per row.
    exploded = df.select(*key, F.posexplode_outer(zipped).alias("_cp_i", "_cp_z")).where(F.col("_cp_z").isNotNull())
    return exploded.select(
        *key,
        (F.col("_cp_i") + offset).cast("bigint").alias("pos"),
        F.col("_cp_z.context").alias("context"),
        F.col("_cp_z.target").alias("target"),
    )


def apply_batch(
    df: DataFrame, fn: Callable, schema: str, keys: Sequence[str] = ("epoch", "batch_id")
) -> DataFrame:
    """the open collate hook: ``fn(pandas.DataFrame) -> pandas.DataFrame``
    once per batch.

    Batches are ranges of the sorted keys, so rows are range-partitioned on them
    (a batch lies in one partition) and cut where the keys change as they stream
    by: one Python call and one result per Arrow batch of rows, however small
    the batches are.
    """
    from convprep.session import ship_package

    ship_package(df.sparkSession)
    by = list(keys)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            at = pdf[by]
            before = at.shift()
            new = (at.ne(before) & ~(at.isna() & before.isna())).any(axis=1).to_numpy()
            starts = [0, *[i for i in new.nonzero()[0].tolist() if i]]
            done = [fn(pdf.iloc[a:b].reset_index(drop=True)) for a, b in zip(starts, starts[1:], strict=False)]
            held = pdf.iloc[starts[-1]:].reset_index(drop=True)  # may go on in the next Arrow batch
            if done:
                yield pd.concat(done, ignore_index=True)
        if held is not None:
            yield fn(held)

    return df.repartitionByRange(*by).sortWithinPartitions(*by).mapInPandas(cut, schema)


def next_token_pairs(df: DataFrame, key: Sequence[str], col: str) -> DataFrame:
    """W5, plain form: ``(t[i], t[i+1])`` pairs."""
    return token_pairs(df, key, col)


def previous_token_pairs(df: DataFrame, key: Sequence[str], col: str, ctrl: str | int = "<ctrl>") -> DataFrame:
    """W5, control form: the control element predicts token 0."""
    return token_pairs(df, key, col, ctrl=ctrl)
