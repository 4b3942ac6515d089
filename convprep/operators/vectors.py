"""Control vectors from embeddings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convprep.functions.arrays import bounded_runs
from convprep.functions.random import uniform
from convprep.operators.lookup import code_blocks, or_fail

BLOCK_VALUES = 2**23  # components of the vectors a block holds at most
_AT_ONCE = 8_192  # vectors gathered at once


def lookup_embeddings(
    ids: DataFrame,
    emb: DataFrame,
    id_col: str = "token_id",
    emb_key: str = "token_id",
    emb_col: str = "embedding",
    skip_missing: bool = False,
) -> DataFrame:
    """Gather embedding rows by id (repeated ids keep their multiplicity).
    An id without an embedding stops the run; ``skip_missing`` drops it. Spark
    broadcasts the table where its bytes allow it."""
    table = emb.select(F.col(emb_key).alias(id_col), F.col(emb_col).alias("embedding"))
    if skip_missing:
        return ids.join(table, id_col)
    return ids.join(table, id_col, "left").withColumn(
        "embedding", or_fail(F.col("embedding"), F.col(id_col), "embedding"))


def mean_vector(df: DataFrame, key: Sequence[str], vec: str = "embedding", out: str = "vector") -> DataFrame:
    """A4: element-wise mean of the vectors of each key.

    ``Summarizer.mean`` is a JVM aggregate with map-side partial
    aggregation, so hot keys collapse before the shuffle.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    agg = df.groupBy(*key).agg(
        Summarizer.mean(array_to_vector(F.col(vec))).alias("_cp_m"),
        F.count(F.lit(1)).cast("bigint").alias("n_vectors"),
    )
    return agg.select(*key, vector_to_array("_cp_m").alias(out), "n_vectors")


def random_vector(seed: int, key, dim: int) -> Column:
    """A5: a seeded uniform [0, 1) vector of ``dim`` values for ``key``
    (same value anywhere, unlike ``rand()``)."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: uniform(seed, key, i))


def control_vectors(
    df: DataFrame,
    key: str,
    emb: DataFrame,
    ids: str = "keyword_ids",
    dim: int | None = None,
    seed: int = 0,
    emb_key: str = "token_id",
    emb_col: str = "embedding",
    skip_missing: bool = False,
) -> DataFrame:
    """C11: the bag-of-words control vector of each row: the mean embedding
    of its ids (J2 + A4), or a seeded random vector (A5) when it has no ids.
    An id without an embedding stops the run; with ``skip_missing`` it is left
    out of the mean. Null ids are no ids. Output ``key, n_vectors, vector``, a
    row for each row of ``df``: ``key`` is only carried along, so it may be null or
    repeat (rows of one key without ids draw the same vector).

    Rows stay in blocks (:func:`~convprep.operators.lookup.code_blocks`): each
    distinct id of a block is joined to ``emb`` once and its vectors go to the
    block, where the means are taken. What moves is a vector for each distinct id
    of a block, not one for each id of a row. An id with several vectors counts
    with all of them. ``dim`` is read off the embeddings when not given.
    """
    if dim is None:
        dim = len(emb.select(emb_col).first()[0])
    kind = df.schema[ids].dataType.elementType.simpleString()
    staged = df.select(F.col(f"`{key}`").alias("_cp_key"), F.col(f"`{ids}`").alias("_cp_ids"))
    stage = code_blocks(staged, ["_cp_ids"], kind, max(1, BLOCK_VALUES // dim), ["_cp_key"])
    entries = stage.where("_cp.d is not null").select(
        F.col("_cp.b").alias("_cp_b"), F.posexplode("_cp.d").alias("_cp_p", "_cp_id"))
    double = emb.schema[emb_col].dataType.simpleString() != "array<float>"  # floats travel as they are
    table = emb.select(F.col(emb_key).cast(kind).alias("_cp_id"),
                       (F.col(emb_col).cast("array<double>") if double else F.col(emb_col)).alias("_cp_v"))
    if skip_missing:
        found = entries.join(table.where("_cp_v is not null"), "_cp_id")
    else:
        found = entries.join(table, "_cp_id", "left").withColumn(
            "_cp_v", or_fail(F.col("_cp_v"), F.col("_cp_id"), "embedding"))
    rows = stage.select(F.col("_cp.b").alias("_cp_b"), "_cp_key", F.col("_cp.c0").alias("_cp_c"))
    schema = T.StructType([stage.schema["_cp_key"], T.StructField("n_vectors", T.LongType()),
                           T.StructField("_cp_m", T.ArrayType(T.DoubleType()))])

    def means(rows: pa.Table, vectors: pa.Table) -> pa.Table:
        place = vectors["_cp_p"].to_numpy()
        lists = vectors["_cp_v"].combine_chunks()
        if (lists.value_lengths().to_numpy(zero_copy_only=False) != dim).any():
            raise ValueError(f"an embedding has not {dim} components")
        codes = rows["_cp_c"].combine_chunks()
        owner = np.repeat(np.arange(len(codes)), codes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        flat = codes.flatten()
        owner = owner[flat.is_valid().to_numpy(zero_copy_only=False)]
        flat = flat.drop_null().to_numpy(zero_copy_only=False)
        size = 1 + max(flat.max(initial=-1), place.max(initial=-1))
        number = np.bincount(place, minlength=size)
        table = np.zeros((size, dim))
        values = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        if number.max(initial=0) > 1:
            np.add.at(table, place, values)
        else:
            table[place] = values
        n = np.bincount(owner, weights=number[flat], minlength=len(codes)).astype(np.int64)
        out = np.zeros((len(codes), dim))
        at = 0
        for lo, hi in bounded_runs(np.bincount(owner, minlength=len(codes)).tolist(), _AT_ONCE):
            end = at + int(np.searchsorted(owner[at:], hi))
            mine = owner[at:end]
            if len(mine):
                first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
                out[mine[first]] = np.add.reduceat(table[flat[at:end]], first)
            at = end
        out /= np.maximum(n, 1)[:, None]
        offsets = pa.array(np.arange(len(codes) + 1, dtype=np.int32) * np.int32(dim))
        mean = pa.ListArray.from_arrays(offsets, pa.array(out.ravel()), mask=pa.array(n == 0))
        return pa.table([rows["_cp_key"], pa.array(n), mean], names=schema.names)

    agg = rows.groupBy("_cp_b").cogroup(found.select("_cp_b", "_cp_p", "_cp_v").groupBy("_cp_b")).applyInArrow(means, schema)
    return agg.select(
        F.col("_cp_key").alias(key),
        "n_vectors",
        F.when(F.col("n_vectors") > 0, F.col("_cp_m")).otherwise(random_vector(seed, "_cp_key", dim)).alias("vector"),
    )


def prefix_control(vectors: DataFrame, ctrl: str = "vector", seq: str = "vectors", out: str = "inputs") -> DataFrame:
    """H17 as a step: the control vector becomes position 0."""
    return vectors.withColumn(out, F.concat(F.array(F.col(ctrl)), F.col(seq)))
