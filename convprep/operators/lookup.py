"""Element-wise lookup of array columns through a key/value table, by block
dictionaries.

This is the equi-join behind encode (token -> id), decode (id -> token) and
keyword translation (keyword -> synonym). Plan:

1. the rows are cut into blocks of about ``block_elements`` elements where
   they lie, without a shuffle: each block's elements become codes into the
   block's dictionary of distinct elements (Arrow's dictionary encoding).
   This stage is written once; the dictionary sits in the block's first row.
   A row's place in its block is its identity: keys of the caller may repeat
   or be null, and rows alike are rows of their own;
2. each dictionary entry is joined to the table once per block, however often
   the element occurs, so a frequent element is no hot key;
3. the found values go back to their block, and every code is replaced by the
   value at its place, without a hash.

No element, key or row hash is shuffled. The rows move at most once, by
block, and not at all where Spark finds the value arrays small enough to
broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convprep.session import ship_package, spread, stored

SELF = object()  # default marker: a miss keeps the looked-up element
FAIL = object()  # default marker: a miss stops the run

BLOCK_ELEMENTS = 200_000  # for scalar values
BLOCK_ELEMENTS_WIDE = 20_000  # where a value is an array or struct


def or_fail(value: Column, key: Column, what: str) -> Column:
    """``value``, or an error naming ``key`` where it is null."""
    return F.coalesce(value, F.raise_error(F.concat(
        F.lit(f"no {what} for "), F.coalesce(key.cast("string"), F.lit("null")))))


def code_blocks(
    df: DataFrame, cols: Sequence[str | Column], key_type: str = "string",
    block_elements: int = BLOCK_ELEMENTS, keep: Sequence[str] | None = None,
) -> DataFrame:
    """``df`` (or its columns ``keep``) with a struct ``_cp``: block ``b``, the
    codes ``c0, c1, ...`` of the arrays ``cols``, and in the first row of each
    block its dictionary ``d`` with the counts ``n`` of its elements.

    Columns of ``cols`` are names or array expressions (e.g. ``pretokenize``),
    evaluated once. A null array has null codes, a null element a null code. A
    block ends with the row that reaches ``block_elements``; an Arrow batch ends
    it too. Written once, so that all that reads it sees the same blocks.

    Rows stream through Python with the columns kept and nothing else, block by
    block: what the arrays are computed from (the value arrays of an earlier
    lookup, say) is not queued beside a UDF, and a task holds one batch of input
    and one block of output.
    """
    ship_package(df.sparkSession)
    kept = df.columns if keep is None else list(keep)
    arrays = [(F.col(f"`{c}`") if isinstance(c, str) else c).cast(f"array<{key_type}>").alias(f"_cp_a{j}")
              for j, c in enumerate(cols)]
    source = spread(df).select(*[F.col(f"`{c}`") for c in kept], *arrays)
    codes = [T.StructField(f"c{j}", T.ArrayType(T.IntegerType())) for j in range(len(cols))]
    coded_type = T.StructType([
        T.StructField("b", T.LongType()), *codes,
        T.StructField("d", T.ArrayType(source.schema[-1].dataType.elementType)),
        T.StructField("n", T.ArrayType(T.LongType()))])
    schema = T.StructType([*source.schema.fields[:len(kept)], T.StructField("_cp", coded_type)])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            arrays = batch.columns[len(kept):]
            lengths = [a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for a in arrays]
            before = np.cumsum(sum(lengths)) - sum(lengths)
            number = before // block_elements
            starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else before
            stops = np.append(starts[1:], len(number))
            for lo, hi in zip(starts.tolist(), stops.tolist(), strict=True):
                lists = [a.slice(lo, hi - lo) for a in arrays]
                parts = [x.flatten() for x in lists]
                coded = (parts[0] if len(parts) == 1 else pa.concat_arrays(parts)).dictionary_encode()
                counts = np.bincount(coded.indices.drop_null().to_numpy(zero_copy_only=False),
                                     minlength=len(coded.dictionary))
                fields, at = [pa.array(np.full(hi - lo, block))], 0
                for x, n, p in zip(lists, lengths, parts, strict=True):
                    fields.append(_lists(n[lo:hi], coded.indices.slice(at, len(p)).cast(pa.int32()), x.is_null()))
                    at += len(p)
                sizes = np.zeros(hi - lo, np.int64)
                sizes[0] = len(coded.dictionary)
                later = pa.array(np.arange(hi - lo) > 0)
                fields += [_lists(sizes, coded.dictionary, later), _lists(sizes, pa.array(counts.astype(np.int64)), later)]
                marks = pa.StructArray.from_arrays(fields, names=coded_type.names)
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(lo, hi - lo) for c in batch.columns[:len(kept)]], marks], names=schema.names)
                block += 1

    return stored(source.mapInArrow(code, schema), "blocks")


def _lists(lengths: np.ndarray, flat: pa.Array, missing: pa.Array) -> pa.ListArray:
    """Lists of ``lengths`` cut from ``flat``; null where ``missing``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), flat, mask=missing)


def block_counts(stage: DataFrame) -> DataFrame:
    """``(tok, n)``: how often each element occurs in the arrays of ``stage``
    (:func:`code_blocks`); a block sends each of its elements once."""
    entries = stage.where("_cp.d is not null").select(F.explode(F.arrays_zip("_cp.d", "_cp.n")).alias("e"))
    return entries.groupBy(F.col("e.d").alias("tok")).agg(F.sum("e.n").alias("n"))


def lookup_codes(
    stage: DataFrame, outs: Sequence[str], table: DataFrame, table_key: str, table_value: str, value_type: str,
    default=None, inner: bool = False, narrow: bool = False,
) -> DataFrame:
    """The rows of ``stage`` (:func:`code_blocks`) with the value of each element
    in ``outs``, one column for each coded array; see :func:`lookup_arrays`.

    ``narrow`` says that all kept columns are wanted: the rows of a block and its
    values then meet as two groups and the values are taken in Arrow. Otherwise a join
    puts the value array beside each row, which copies it for each row but lets
    Spark leave out columns that nobody reads."""
    entries = stage.where("_cp.d is not null").select(
        F.col("_cp.b").alias("_cp_b"), F.posexplode("_cp.d").alias("_cp_p", "_cp_k"))
    t = table.select(F.col(f"`{table_key}`").alias("_cp_k"), F.col(f"`{table_value}`").cast(value_type).alias("_cp_v"),
                     F.lit(True).alias("_cp_f"))
    joined = entries.join(t, "_cp_k", "left")
    value, key = F.col("_cp_v"), F.col("_cp_k")
    at_null = F.lit(None).cast(value_type)
    if default is SELF:
        value = F.coalesce(value, key.cast(value_type))
    elif default is FAIL and not inner:
        value = or_fail(value, key, table_value)
        at_null = or_fail(at_null, F.lit(None), table_value)
    elif default is not None and not inner:
        at_null = F.lit(default).cast(value_type)
        value = F.coalesce(value, at_null)
    found = F.coalesce(F.col("_cp_f"), F.lit(False)) & F.col("_cp_v").isNotNull()
    if narrow:
        looked = joined.select("_cp_b", "_cp_p", value.alias("_cp_v"), found.alias("_cp_f"))
        fill = None if default is None or default is SELF or default is FAIL or inner else default
        return _gather(stage, outs, looked, fill, inner, f"no {table_value} for null" if default is FAIL and not inner else None)
    entry = F.struct("_cp_p", value.alias("v"), *([found.alias("f")] if inner else []))
    packed = joined.groupBy("_cp_b").agg(F.sort_array(F.collect_list(entry)).alias("_cp_s"))
    packed = packed.select("_cp_b", F.transform("_cp_s", lambda x: x["v"]).alias("_cp_v"),
                           *([F.transform("_cp_s", lambda x: x["f"]).alias("_cp_f")] if inner else []))
    rows = stage.withColumn("_cp_b", F.col("_cp.b")).join(packed, "_cp_b", "left")
    new = []
    for j, out in enumerate(outs):
        codes = F.col(f"_cp.c{j}")
        if inner:
            codes = F.filter(codes, lambda c: F.coalesce(F.get("_cp_f", c), F.lit(False)))
        looked = F.transform(codes, lambda c: F.when(c.isNull(), at_null).otherwise(F.get("_cp_v", c)))
        new.append(looked.cast(f"array<{value_type}>").alias(out))
    kept = [F.col(f"`{c}`") for c in stage.columns if c != "_cp" and c not in outs]
    return rows.select(*kept, *new)


def _gather(stage: DataFrame, outs: Sequence[str], looked: DataFrame, fill, inner: bool, fail: str | None) -> DataFrame:
    """The rows of ``stage`` with the values ``looked(_cp_b, _cp_p, _cp_v, _cp_f)``
    of their codes: null codes give ``fill`` or stop the run with ``fail``;
    ``inner`` drops them and values not found."""
    kept = [c for c in stage.columns if c != "_cp" and c not in outs]
    codes = [f"_cp_c{j}" for j in range(len(outs))]
    rows = stage.select(*[F.col(f"`{c}`") for c in kept], F.col("_cp.b").alias("_cp_b"),
                        *[F.col(f"_cp.c{j}").alias(c) for j, c in enumerate(codes)])
    lists = T.ArrayType(looked.schema["_cp_v"].dataType)
    schema = T.StructType([*[stage.schema[c] for c in kept], *[T.StructField(c, lists) for c in outs]])

    def gather(rows: pa.Table, values: pa.Table) -> pa.Table:
        order = pa.array(np.argsort(values["_cp_p"].to_numpy(), kind="stable"))
        table, found = (values[c].combine_chunks().take(order) for c in ("_cp_v", "_cp_f"))
        new = []
        for name in codes:
            places = rows[name].combine_chunks()
            lengths = places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = places.flatten()
            if fail is not None and flat.null_count:
                raise ValueError(fail)
            if inner:
                good = found.take(flat).fill_null(False)
                before = np.concatenate([[0], np.cumsum(good.to_numpy(zero_copy_only=False).astype(np.int64))])
                lengths = np.diff(before[np.concatenate([[0], np.cumsum(lengths)])])
                flat = flat.filter(good)
            taken = table.take(flat)
            if fill is not None and taken.null_count:
                taken = taken.fill_null(pa.scalar(fill, taken.type))
            new.append(_lists(lengths, taken, places.is_null()))
        return pa.Table.from_arrays([*[rows[c] for c in kept], *new], names=schema.names)

    return rows.groupBy("_cp_b").cogroup(looked.groupBy("_cp_b")).applyInArrow(gather, schema)


def lookup_arrays(
    df: DataFrame,
    key: Sequence[str],
    cols: Sequence[str | Column],
    outs: Sequence[str],
    table: DataFrame,
    table_key: str,
    table_value: str,
    value_type: str,
    default=None,
    inner: bool = False,
    key_type: str = "string",
    join_back: bool = True,
    block_elements: int | None = None,
) -> DataFrame:
    """Map every element of each array in ``cols`` through ``table``.

    Every row comes back once, whether ``key`` is null, repeated or neither;
    it is only carried along. A miss gives ``default``: None keeps null,
    :data:`SELF` keeps the element, :data:`FAIL` stops the run, else a literal;
    ``inner=True`` drops misses and null elements instead. Null input arrays
    give null, empty ones empty arrays. ``table`` must have unique
    ``table_key`` values; ``key_type`` is the element type of the inputs.
    With ``join_back=False`` only ``key`` and ``outs`` are returned.
    """
    if block_elements is None:
        block_elements = BLOCK_ELEMENTS_WIDE if "<" in value_type else BLOCK_ELEMENTS
    stage = code_blocks(df, cols, key_type, block_elements, None if join_back else list(dict.fromkeys(key)))
    return lookup_codes(stage, outs, table, table_key, table_value, value_type, default, inner, narrow=not join_back)
