"""Row-level projections, filters and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The three stored dataset schemas.
SCHEMAS = {
    "keywords": ["id", "text", "keywords"],
    "tokenized_keywords": [
        "id", "text", "keywords", "used_keywords",
        "tokenized_text", "tokenized_keywords", "text_ids", "keyword_ids",
    ],
    "tokenized": ["id", "text", "tokenized_text", "token_ids"],
}


def rename_text(df: DataFrame, text_field: str, to: str = "text") -> DataFrame:
    """Rename the caller's text field; no-op when absent."""
    if text_field == to or text_field not in df.columns:
        return df
    return df.withColumnRenamed(text_field, to)


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop columns; a missing name raises (as pandas does)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    return df.drop(*cols)


def project_schema(df: DataFrame, kind: str) -> DataFrame:
    """Keep exactly one of the named dataset schemas."""
    if kind not in SCHEMAS:
        raise ValueError(f"unknown schema {kind!r}; one of {sorted(SCHEMAS)}")
    return df.select(*SCHEMAS[kind])


def drop_missing_text(df: DataFrame, col: str = "text") -> DataFrame:
    """P5: drop rows whose ``col`` is null (empty strings stay)."""
    return df.dropna(subset=[col])


def filter_sender(df: DataFrame, sender: str, col: str = "sender_name") -> DataFrame:
    """Exact, case-sensitive sender match (pushed to Parquet scans)."""
    return df.filter(F.col(col) == F.lit(sender))


def filter_message_type(df: DataFrame, kind: str = "Generic", col: str = "type") -> DataFrame:
    """Keep one message type; null type is dropped."""
    return df.filter(F.col(col) == F.lit(kind))


def drop_short_sequences(df: DataFrame, col: str = "token_ids", min_len: int = 2) -> DataFrame:
    """Drop rows whose list has fewer than ``min_len`` items; null drops."""
    return df.filter(F.coalesce(F.size(col), F.lit(-1)) >= min_len)


def find_empty_sequences(df: DataFrame, col: str = "token_ids", row_id: str = "row_id") -> DataFrame:
    """The row ids whose (parsed) list is empty."""
    return df.filter(F.size(col) == 0).select(row_id)


def lookup_row(df: DataFrame, row_id_value: int, cols: Sequence[str] | None = None, row_id: str = "row_id") -> DataFrame:
    """P10: point access by row id (an equality filter, pushed down)."""
    out = df.filter(F.col(row_id) == F.lit(row_id_value))
    return out.select(*cols) if cols else out


def limit_rows(df: DataFrame, start: int, stop: int, row_id: str = "row_id") -> DataFrame:
    """Rows ``start <= row_id < stop``; repeatable, unlike ``limit``."""
    return df.filter((F.col(row_id) >= start) & (F.col(row_id) < stop))


def count_rows(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A1: ``len(frame)`` as a one-row (or per-group) DataFrame."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))


def length_stats(df: DataFrame, col: str, by: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """A2: min / max / mean / count / median of list lengths.

    The median is exact (``percentile``) unless ``approx``: its buffer maps
    each distinct length to a count and aggregates partially, so memory is
    bounded by the number of distinct lengths, not rows, even for a group
    holding a third of the table; ``approx`` uses a fixed-size sketch.
    """
    n = F.size(col)
    median = F.percentile_approx(n, 0.5) if approx else F.percentile(n, F.lit(0.5))
    return df.groupBy(*by).agg(
        F.min(n).cast("bigint").alias("min_len"),
        F.max(n).cast("bigint").alias("max_len"),
        F.round(F.avg(n), 6).alias("avg_len"),
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        median.cast("double").alias("median_len"),
    )
