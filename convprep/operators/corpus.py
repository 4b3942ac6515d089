"""Corpus text by concatenation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convprep.session import ship_package

SHARD_BYTES = 64 * 1024 * 1024


def concat_corpus(
    df: DataFrame, text_col: str, order: Sequence[str], by: Sequence[str], out: str = "corpus"
) -> DataFrame:
    """Per group, ``''`` then ``' ' + text`` for each row in ``order``.

    The result keeps the leading blank. ``by`` is required: one corpus for a
    whole table would be one task's row; group it (per conversation, per
    source) or write ordered text shards instead. A group's text is held in
    one row, so groups must be of bounded size (a conversation, a file).
    """
    if not by:
        raise ValueError("concat_corpus needs group columns (by=...)")
    parts = F.array_sort(F.collect_list(F.struct(*[F.col(o) for o in order], F.col(text_col).alias("_cp_t"))))
    return df.where(F.col(text_col).isNotNull()).groupBy(*by).agg(
        F.concat(F.lit(" "), F.array_join(F.transform(parts, lambda x: x["_cp_t"]), " ")).alias(out)
    )


def concat_corpus_shards(
    df: DataFrame, text_col: str, order: Sequence[str], by: Sequence[str], out: str = "corpus",
    max_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """A6, scalable form: the same text cut into ordered shards of bounded size.

    Rows are range-partitioned on ``(by, order)`` (Spark samples the key, so
    a group holding a third of all rows spreads over many partitions) and sorted;
    as they stream by, running byte sums choose the borders: a shard ends with its group, its
    partition, or before the row that would take it over ``max_bytes``. Only a
    single longer row makes a larger shard. A group's shards, in ``shard`` order,
    concatenate to exactly the :func:`concat_corpus` text (every piece keeps its
    leading blanks). Output ``(by..., shard, out)``; ``shard`` numbers are
    ascending, not dense.
    """
    ship_package(df.sparkSession)
    keys = [F.col(c) for c in [*by, *order]]
    ranged = df.where(F.col(text_col).isNotNull()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    # Python sees the group as text, and Spark reads it again.
    group = F.to_json(F.struct(*[F.col(c) for c in by]))
    rows = ranged.select(group.alias("_cp_g"), F.col(text_col).alias("_cp_t"))
    schema = T.StructType([T.StructField("_cp_by", T.StringType()), T.StructField("shard", T.LongType()),
                           T.StructField(out, T.StringType())])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard, group, held, size = TaskContext.get().partitionId() << 33, None, [], 0
        for pdf in batches:
            done = []
            for g, t in zip(pdf["_cp_g"], pdf["_cp_t"], strict=True):
                n = len(t.encode()) + 1
                if held and (g != group or size + n > max_bytes):
                    done.append((group, shard, "".join(held)))
                    shard, held, size = shard + 1, [], 0
                group = g
                held.append(" " + t)
                size += n
            yield pd.DataFrame(done, columns=["_cp_by", "shard", out])
        if held:
            yield pd.DataFrame([(group, shard, "".join(held))], columns=["_cp_by", "shard", out])

    shards = rows.mapInPandas(cut, schema)
    back = T.StructType([df.schema[c] for c in by])
    return shards.select(F.from_json("_cp_by", back.json()).alias("_cp_by"), "shard", out).select(
        *[F.col(f"_cp_by.`{c}`").alias(c) for c in by], "shard", out)
