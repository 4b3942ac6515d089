"""Table sources: the driver's parquet tables, stored CSV sets, text chunks
(S2, S6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convprep.functions.text import pretokenize

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_csv_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A stored CSV set with a header; chat text holds newlines and
    quotes, hence ``multiLine`` and ``"`` escaping (such files do not split).
    List columns arrive as JSON text: parse them with ``parse_id_list``."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def chunk_text(
    df: DataFrame,
    key: str,
    text_col: str = "text",
    size: int = 128,
    step: int = 100,
    pattern: str = "blank",
) -> DataFrame:
    """Fixed token windows of ``size`` tokens every ``step`` tokens.

    Output ``(key, chunk, n_tokens, text)``; the last window may be short;
    rows without tokens give no chunk. Windows are cut with array functions
    on each row, so a long text never leaves its task.
    """
    if size <= 0 or step <= 0:
        raise ValueError("size and step must be positive")
    if step > size:
        raise ValueError("step must not exceed size: the tokens between windows would be lost")
    toks = df.select(key, pretokenize(text_col, pattern).alias("_cp_t")).where(F.size("_cp_t") > 0)
    starts = F.sequence(F.lit(0), F.size("_cp_t") - 1, F.lit(step))
    windows = F.transform(starts, lambda i: F.slice("_cp_t", i + 1, size))
    return toks.select(key, F.posexplode(windows).alias("chunk", "_cp_w")).select(
        key,
        F.col("chunk").cast("bigint").alias("chunk"),
        F.size("_cp_w").cast("bigint").alias("n_tokens"),
        F.array_join("_cp_w", " ").alias("text"),
    )
