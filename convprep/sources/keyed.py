"""A large JSON object ``{"id": {record}, ...}`` read by many tasks.

Spark's JSON reader takes a multi-line document whole. Here the text reader cuts
files at every ``}``, so a file is read by byte ranges through any file system
that Spark knows, and what a piece means is found afterwards:

1. within a JSON text, the parity of unescaped quotes tells whether a place lies
   in a string, and brackets outside strings tell its depth. Both are running
   sums, over the pieces of a byte range first (once for each of the two states
   the range may start in), then over the ranges of a file (one row each);
2. a ``}`` outside strings that leads back to depth 1 ends a record. Records are
   numbered by a running count, again by range and then by file;
3. the pieces of a record are gathered and parsed, and nothing larger is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convprep.operators.rows import rename_text
from convprep.session import stored

_RANGE = ["_f", "_b"]  # a byte range of a file
_BEFORE = (Window.unboundedPreceding, -1)


def _count(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]", ""))


def _depth(text: Column) -> Column:
    """Brackets opened less brackets closed in ``text``, which starts outside strings; it holds no ``}``."""
    bare = F.regexp_replace(text, '"[^"]*("|$)', "")
    return _count(bare, r"\[{") - _count(bare, r"\]")


def _pieces(spark: SparkSession, path) -> DataFrame:
    """The pieces of the files, written: place (``_f, _b, _i``), ``value``, and
    the effect of each: ``odd`` quotes, ``out`` / ``ins`` the change of depth if
    it starts outside / inside a string."""
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_i"), F.col("_metadata.file_size").alias("size"), "value")
    # Escapes occur inside strings alone, whatever the state at the start.
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    return stored(raw.withColumn("_p", plain).select(
        *_RANGE, "_i", "size", "value", (_count(F.col("_p"), '"') % 2).alias("odd"),
        _depth(F.col("_p")).alias("out"), _depth(F.concat(F.lit('"'), "_p")).alias("ins")), "pieces")


def _over_ranges(ranges: DataFrame, col: Column, name: str) -> DataFrame:
    """Adds the sum of ``col`` over the earlier ranges of the file."""
    w = Window.partitionBy("_f").orderBy("_b").rowsBetween(*_BEFORE)
    return ranges.withColumn(name, F.coalesce(F.sum(col).over(w), F.lit(0)))


def _placed(pieces: DataFrame) -> DataFrame:
    """Each piece's place with ``inside`` (the state after it), ``depth`` (after
    the ``}`` that follows it) and ``rec`` (the number of records that ended
    before it), written."""
    order = Window.partitionBy(*_RANGE).orderBy("_i")
    rows = pieces.select(*_RANGE, "_i", "size", "odd", "out", "ins", F.octet_length("value").alias("bytes"),
                         (F.trim(F.regexp_replace("value", r"\s", "")) == "").alias("blank"))
    rows = rows.withColumn("q", F.coalesce(F.sum("odd").over(order.rowsBetween(*_BEFORE)), F.lit(0)) % 2)
    for h in (0, 1):  # the state at the start of the range
        start = (F.col("q") + h) % 2
        change = F.when(start == 0, F.col("out")).otherwise(F.col("ins")) - F.when(
            (start + F.col("odd")) % 2 == 0, 1).otherwise(0)
        rows = rows.withColumn(f"d{h}", F.sum(change).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = stored(rows, "states")
    ranges = rows.groupBy(*_RANGE).agg(
        F.sum("odd").alias("odd"), *[F.max_by(f"d{h}", "_i").alias(f"d{h}") for h in (0, 1)])
    ranges = _over_ranges(ranges, F.col("odd"), "h").withColumn("h", F.col("h") % 2)
    ranges = _over_ranges(ranges, F.when(F.col("h") == 0, F.col("d0")).otherwise(F.col("d1")), "base")
    rows = rows.join(ranges.select(*_RANGE, "h", "base"), _RANGE).select(
        *_RANGE, "_i", "size", "bytes", "blank",
        ((F.col("q") + F.col("h") + F.col("odd")) % 2).alias("inside"),
        (F.col("base") + F.when(F.col("h") == 0, F.col("d0")).otherwise(F.col("d1"))).alias("depth"))
    ends = (F.col("inside") == 0) & (F.col("depth") == 1)
    rows = stored(rows.withColumn("ends", ends).withColumn(
        "r", F.coalesce(F.sum(F.col("ends").cast("long")).over(order.rowsBetween(*_BEFORE)), F.lit(0))), "depths")
    totals = rows.groupBy(*_RANGE).agg(F.sum(F.col("ends").cast("long")).alias("n"))
    first = _over_ranges(totals, F.col("n"), "first").select(*_RANGE, "first")
    return rows.join(first, _RANGE).withColumn("rec", F.col("first") + F.col("r")).drop("first", "r")


def _check(placed: DataFrame) -> None:
    """Every file is one closed JSON object; the first that is not stops the run."""
    last = F.struct("_b", "_i")
    files = placed.groupBy("_f").agg(
        F.max_by(F.struct("inside", "depth", "blank"), last).alias("end"),
        F.sum(F.col("bytes") + 1).alias("total"), F.first("size").alias("size"))
    # A text after the last bracket has no } of its own: one byte less than the
    # pieces say (a byte order mark, which the reader skips, has three). A
    # compressed file has another size altogether.
    over = F.col("total") - F.col("size")
    good = (F.col("end.inside") == 0) & (
        ((F.col("end.depth") == 0) & ~over.isin(1, -2))
        | ((F.col("end.depth") == -1) & F.col("end.blank") & ~over.isin(0, -3)))
    bad = files.where(~good).select("_f").head(1)
    if bad:
        raise ValueError(f"not one whole JSON object: {bad[0][0]}")


def read_keyed_records(spark: SparkSession, path, record_schema: str, text_field: str) -> DataFrame:
    """One JSON object per file mapping ``id -> record``; the outer key
    becomes ``id``. ``record_schema`` is a DDL struct type string such as
    ``'struct<text:string,kind:string>'``.

    A file is read by byte ranges (a compressed one by one task), and no task
    holds more than a range's pieces in a sort, or one record. Entries that are
    not objects (null, say) are parsed together with the next object. Repeated
    keys give a row each; an empty file gives none. A file that is not one whole
    JSON object stops the run.
    """
    pieces = _pieces(spark, path)
    placed = stored(_placed(pieces), "records")
    _check(placed)
    # What follows the outer } is blank, as the depth there (-1 at most) and the parse say.
    parts = pieces.select(*_RANGE, "_i", "value").join(placed.select("_i", "rec", "ends", "depth"), "_i")
    after = F.col("depth") < 0
    entries = parts.groupBy("_f", "rec").agg(
        F.sort_array(F.collect_list(F.when(~after, F.struct("_b", "_i", "value")))).alias("ps"),
        F.max("ends").alias("ended"),
        F.max(F.when(after & (F.regexp_replace("value", r"\s", "") != ""), F.col("value"))).alias("rest"))
    text = F.concat(F.array_join(F.transform("ps", lambda p: p["value"]), "}"), F.when(F.col("ended"), "}").otherwise(""))
    body = F.regexp_replace(text, r"^\s+|\s+$", "")
    opening = F.when(F.col("rec") == 0, "{").otherwise(",")
    body = (
        F.when(F.col("rest").isNotNull(), F.raise_error(F.concat(F.lit("text after the JSON object in "), "_f")))
        .when((F.col("rec") > 0) & (body == ""), "")
        .when(F.substring(body, 1, 1) != opening, F.raise_error(F.concat(F.lit("no JSON object of records: "), "_f")))
        .when(body == ",", ",")
        .otherwise(F.substring(body, F.lit(2), F.length(body)))
    )
    whole = F.concat(F.lit("{"), body, F.lit("}"))
    parsed = entries.select(F.from_json(whole, f"map<string,{record_schema}>", {"mode": "FAILFAST"}).alias("m"))
    return rename_text(parsed.select(F.explode("m").alias("id", "r")).select("id", "r.*"), text_field)
