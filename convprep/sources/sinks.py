"""Sinks and the dataset registry."""

from __future__ import annotations

import itertools
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _json_arrays(df: DataFrame) -> DataFrame:
    """Array / map / struct columns as JSON text (CSV has no list type)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_csv_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header and ``"`` escaping; lists written as JSON text;
    no index column."""
    _json_arrays(df).write.mode(mode).options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_per_sender(df: DataFrame, path: str, sender_col: str = "sender_name", mode: str = "overwrite") -> None:
    """One data set per sender in a single pass (partition folders), so
    a later sender filter prunes partitions. Rows are rebalanced by sender first:
    Spark joins small senders into a task and splits large ones by bytes (its
    advisory partition size), so a sender is neither many tiny files nor one task."""
    df.hint("rebalance", F.col(sender_col)).write.mode(mode).partitionBy(sender_col).parquet(path)


def write_dataset(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Stage store, Parquet with native ``array<int>``."""
    df.write.mode(mode).parquet(path)


def run_manifest(
    spark: SparkSession, params: Mapping[str, object], df: DataFrame | None = None, ids_col: str = "token_ids"
) -> DataFrame:
    """S10 (data part): one row of run parameters plus data set counts.

    Parameters become string columns; counts come from one aggregate over
    ``df`` (rows, min / max list size).
    """
    lits = [F.lit(str(v)).alias(k) for k, v in params.items()]
    if df is None:
        return spark.range(1).select(*lits)
    return df.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.min(F.size(ids_col)).cast("bigint").alias("min_len"),
        F.max(F.size(ids_col)).cast("bigint").alias("max_len"),
    ).select(*lits, "n_rows", "min_len", "max_len")


def write_run_manifest(spark: SparkSession, path: str, params: Mapping[str, object], df: DataFrame | None = None,
                       ids_col: str = "token_ids") -> None:
    """Write the manifest as one JSON file."""
    run_manifest(spark, params, df, ids_col).coalesce(1).write.mode("overwrite").json(path)


def write_run(spark: SparkSession, df: DataFrame, path: str, params: Mapping[str, object], ids_col: str = "token_ids") -> None:
    """S9 and S10 in one go: the data set a run was trained on, under ``path``/data, and
    the manifest of what was written there, under ``path``/manifest."""
    write_dataset(df, f"{path}/data")
    write_run_manifest(spark, f"{path}/manifest", params, spark.read.parquet(f"{path}/data"), ids_col)


def write_metric_history(df: DataFrame, path: str, order_col: str = "epoch") -> None:
    """Per-epoch metric values as one small ordered CSV (the input is
    one row per epoch)."""
    df.orderBy(order_col).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


# ------------------------------------------------------------ C4 registry

_counter = itertools.count()


def register_dataset(df: DataFrame, key: str | None = None) -> str:
    """C4: register a prepared data set under ``key`` (generated
    ``dataset_<n>`` when None) as a temporary view; returns the key."""
    if key is None:
        key = f"dataset_{next(_counter)}"
    df.createOrReplaceTempView(key)
    return key


def dataset(spark: SparkSession, key: str) -> DataFrame:
    """C4: the registered data set; an unknown key raises."""
    if not spark.catalog.tableExists(key):
        raise KeyError(f"no data set registered as {key!r}")
    return spark.table(key)
