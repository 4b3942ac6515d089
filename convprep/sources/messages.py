"""Message and comment sources.

Explicit read schemas throughout: Spark does not prune unused struct
fields below ``explode``, so the schema is what keeps scans narrow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convprep.operators.index import dense_index
from convprep.operators.rows import drop_missing_text, rename_text
from convprep.sources.keyed import read_keyed_records

MESSAGE_FIELDS = T.StructType(
    [
        T.StructField("sender_name", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("type", T.StringType()),
    ]
)


def export_schema(message_fields: T.StructType = MESSAGE_FIELDS) -> T.StructType:
    """``struct<messages: array<struct<...>>>`` for a chat export file."""
    return T.StructType([T.StructField("messages", T.ArrayType(message_fields))])


def read_message_export(
    spark: SparkSession,
    path: str | Sequence[str],
    message_fields: T.StructType = MESSAGE_FIELDS,
    multi_line: bool = True,
) -> DataFrame:
    """S1 + U1: all messages of a set of export files, one row per message.

    ``path`` is a file, folder or glob (many files = one scan, UNION ALL
    semantics, ragged keys become NULL). Adds ``file_name`` and ``pos`` (the
    index inside the file's ``messages`` list) as the order columns.
    ``multi_line`` files are read whole, one task per file. A file that does
    not parse stops the run.
    """
    reader = spark.read.schema(export_schema(message_fields)).option("multiLine", multi_line).option("mode", "FAILFAST")
    raw = reader.json(path if isinstance(path, str) else list(path))
    names = [f.name for f in message_fields.fields]
    return raw.select(
        F.col("_metadata.file_path").alias("file_name"),
        F.posexplode("messages").alias("pos", "m"),
    ).select("file_name", F.col("pos").cast("bigint").alias("pos"), *[F.col(f"m.{n}").alias(n) for n in names])


def file_order(file_name: str = "file_name") -> list[Column]:
    """Order of numbered files: the last number of the name without folder and
    extension (files without one first), then the name. A part file that Spark
    wrote goes by the number of its folder."""
    own = F.regexp_extract(F.col(file_name), r"([^/]*?)(?:\.[^./]*)*$", 1)
    folder = F.regexp_extract(F.col(file_name), r"([^/]*)/part-[^/]*$", 1)
    stem = F.when(folder != "", folder).otherwise(own)
    return [F.regexp_extract(stem, r"(\d{1,18})\D*$", 1).try_cast("bigint").asc_nulls_first(), F.col(file_name).asc()]


def union_exports(dfs: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by name of frames with ragged columns."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def read_records(spark: SparkSession, path: str, text_field: str, schema=None, multi_line: bool = False) -> DataFrame:
    """S3: JSON records (JSON lines, or one JSON array per file with
    ``multi_line``), text field renamed to ``text``."""
    reader = spark.read.option("multiLine", multi_line).option("mode", "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema)
    return rename_text(reader.json(path), text_field)


def from_table(df: DataFrame, text_field: str) -> DataFrame:
    """An existing frame, text field renamed."""
    return rename_text(df, text_field)


def select_source(spark: SparkSession, source, text_field: str, kind: str | None = None, **kw) -> DataFrame:
    """Dispatch on the source: a DataFrame, or a path with ``kind`` in
    ``records`` / ``keyed`` / ``export`` / ``corpus`` (plain text files, read
    whole and cut into token windows by S6; ``size`` and ``step`` in ``kw``).
    Anything else raises TypeError."""
    if isinstance(source, DataFrame):
        return from_table(source, text_field)
    if isinstance(source, str) and kind == "corpus":
        from convprep.sources.tables import chunk_text

        files = spark.read.text(source, wholetext=True).select(
            F.col("_metadata.file_path").alias("file_name"), F.col("value").alias("text"))
        chunks = chunk_text(files, "file_name", "text", size=kw.get("size", 128), step=kw.get("step", 128))
        return chunks.select("file_name", F.col("chunk").alias("pos"), "text")
    if isinstance(source, str):
        if kind == "records":
            return read_records(spark, source, text_field, **kw)
        if kind == "keyed":
            return read_keyed_records(spark, source, kw.pop("record_schema"), text_field)
        if kind == "export":
            return rename_text(read_message_export(spark, source, **kw), text_field)
        raise ValueError("a path source needs kind='records', 'keyed', 'export' or 'corpus'")
    raise TypeError(f"unsupported source type: {type(source).__name__}")


def load_comments(
    spark: SparkSession,
    source,
    text_field: str,
    order: Sequence | None = None,
    kind: str | None = None,
    **kw,
) -> DataFrame:
    """Source -> rename text -> drop null text -> ``row_id`` 0..n-1.

    ``order`` is the unique order the ids follow (the reference uses the
    frame's row order); by default the source's own order columns.
    """
    df = drop_missing_text(select_source(spark, source, text_field, kind, **kw), "text")
    if order is None:
        if {"file_name", "pos"} <= set(df.columns):
            order = [*file_order("file_name"), "pos"]
        elif "id" in df.columns:
            order = ["id"]
        else:
            # JSON lines and CSV carry no row position Spark could read back.
            raise ValueError("give order=[...] (unique columns) for a source without file/pos or id")
    return dense_index(df, order, out="row_id")
