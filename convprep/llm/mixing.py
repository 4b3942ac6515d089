"""Mixing sources to target weights by Pareto order sampling (Rosén, 1997).

A source's target is a multiple of its size. Each document's expected number of
copies follows from it; the whole part is allocated for certain, the rest is an
inclusion probability p. Documents are ranked by their random odds u/(1-u)
divided by their inclusion odds p/(1-p), and the lowest ranks are taken until
the words asked for are reached: a sample of fixed size, here in words.

What a source takes is told by a rule of a few numbers (rates, and the rank of
the last document taken), found from aggregates. No source is sorted as a whole:
a histogram of ranks finds the bucket in which the last one lies, and only that
bucket is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convprep.llm.common import words, written

CAP = 3
BUCKETS = 4096
SALTS = 64
SOURCE_WEIGHTS = (5, 2, 1)


def fill(groups: DataFrame, within: list[str], size: str, weight: str, total: str, cap: int = CAP) -> DataFrame:
    """Share ``total`` over the groups of each ``within`` by weight, none above
    ``cap`` times its size; the excess goes to the others by weight until none
    is above. Adds ``target``.

    The outcome is min(cap * size, weight * c). With groups sorted by
    cap * size / weight, c is the largest of (total - capped sizes before k) /
    (weights from k on). Sizes and weights are whole numbers, so the sums are
    exact. Runs over one row per group.
    """
    w = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    order = w.orderBy(F.col(size) / F.col(weight), *[c for c in groups.columns if c not in within])
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.col(total) - F.lit(cap) * before).cast("double") / rest
    out = groups.withColumn("_level", level).withColumn("_c", F.greatest(F.max("_level").over(w), F.lit(0.0)))
    return out.withColumn("target", F.least(
        (F.lit(cap) * F.col(size)).cast("double"), F.col(weight) * F.col("_c"))).drop("_level", "_c")


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from the md5 of seed and key; the same on every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / F.lit(2.0**52)


def _ranked(df: DataFrame) -> DataFrame:
    """Adds rate, whole copies, p, rank q and its bucket from target and size of
    the row's cell."""
    rate = F.when(F.col("cell_size") > 0, F.col("cell_target") / F.col("cell_size")).otherwise(0.0)
    df = df.withColumn("rate", rate).withColumn("whole", F.floor("rate").cast("long"))
    df = df.withColumn("p", F.col("rate") - F.col("whole"))
    q = F.col("u") * (1 - F.col("p")) / ((1 - F.col("u")) * F.col("p"))
    df = df.withColumn("q", F.when((F.col("p") > 0) & (F.col("size") > 0), q))
    return df.withColumn("bucket", F.floor(F.col("q") / (1 + F.col("q")) * BUCKETS).cast("int"))


_RANK = ("bucket", "q", "key", "size", "tie", "copy")
_ALIKE = ["key", "source", "tier", "size", "tie"]
_SPREAD = 1000  # copies of a row that one task makes at a time


def mixing_rules(narrow: DataFrame) -> DataFrame:
    """One row per (source, tier): target and size of source and cell, ``cut``
    (rank of the last document taken) and ``extra`` (a document taken beside).

    ``narrow`` has key, source, tier, size, tie, copy and u. The number of rows returned is
    that of the sources and tiers. ``extra`` is the document beyond the cut that
    fills best what the cut leaves short; it matters for small sources.
    """
    sizes = narrow.groupBy("source", "tier").agg(F.sum("size").alias("cell_size"))
    sources = sizes.groupBy("source").agg(F.sum("cell_size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = sources.withColumn("weight", F.element_at(
        F.array(*[F.lit(x).cast("long") for x in SOURCE_WEIGHTS]),
        (place % len(SOURCE_WEIGHTS) + 1).cast("int")))
    sources = sources.withColumn("all", F.sum("source_size").over(Window.partitionBy(F.lit(0))))
    sources = fill(sources, [], "source_size", "weight", "all").withColumnRenamed("target", "source_target")
    cells = sizes.alias("c").join(sources.alias("s"), F.expr("c.source <=> s.source")).select(
        "c.source", "tier", "cell_size", "source_size", "source_target",
        (F.col("tier") * F.col("cell_size")).alias("weight"))
    cells = fill(cells.withColumn("weight", F.greatest("weight", F.lit(1))), ["source"],
                 "cell_size", "weight", "source_target").withColumnRenamed("target", "cell_target")
    cells = written(cells.drop("weight"), "mixing-cells")

    ranked = _ranked(_with_cells(narrow, cells))
    # Words by bucket of rank; bucket -1 holds what is certain.
    hist = ranked.groupBy("source", F.coalesce("bucket", F.lit(BUCKETS + 1)).alias("bucket")).agg(
        F.sum("size").alias("n"), F.sum(F.col("whole") * F.col("size")).alias("certain"),
        F.max("source_target").alias("source_target"))
    w = Window.partitionBy("source")
    hist = hist.withColumn("asked", F.col("source_target") - F.sum("certain").over(w))
    hist = hist.where(F.col("bucket") <= BUCKETS).withColumn(
        "upto", F.sum("n").over(w.orderBy("bucket")))
    border = hist.where("upto > asked").groupBy("source").agg(
        F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"), "asked")).alias("b"))
    border = written(border.select(
        "source", F.col("b.bucket").alias("border"), F.col("b.before").alias("before"), F.col("b.asked").alias("asked")),
        "mixing-border")

    # Sort the border bucket of each source alone.
    inside = ranked.alias("r").join(
        border.alias("b"), F.expr("r.source <=> b.source and r.bucket = b.border")).select("r.*", "before", "asked")
    run = Window.partitionBy("source").orderBy(*_RANK)  # range frame: equal rows go together
    inside = inside.withColumn("upto", F.col("before") + F.sum("size").over(run))
    cut = inside.where("upto <= asked").groupBy("source").agg(
        F.max(F.struct(*_RANK, "upto")).alias("cut"))
    cut = border.alias("b").join(cut.alias("c"), F.expr("b.source <=> c.source"), "left").select(
        "b.source", "border", "cut",
        (F.col("asked") - F.coalesce("cut.upto", "before")).alias("short"))
    # Beyond the cut, the document that comes nearest to what is short.
    beyond = _salted_join(ranked.where("q is not null"), cut, ["source"]).where(~_taken()).withColumn(
        "miss", F.abs(F.col("short") - F.col("size")))
    extra = beyond.where("miss < short").groupBy("source").agg(
        F.min(F.struct("miss", *_RANK)).alias("extra"))
    rules = cells.alias("s").join(cut.drop("short").alias("c"), F.expr("s.source <=> c.source"), "left").join(
        extra.alias("x"), F.expr("s.source <=> x.source"), "left")
    return written(rules.select("s.*", "border", "cut", "extra"), "mixing-rules")


def _salted_join(df: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Join the one row that ``few`` has for ``keys`` (nulls are equal). Its rows are
    repeated for each salt, so the documents of a hot source spread over as many tasks."""
    salt = F.pmod(F.xxhash64("key", "tie", "copy"), F.lit(SALTS)).cast("int")
    spread = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = " and ".join(f"d.{k} <=> k.{k}" for k in [*keys, "_salt"])
    return df.withColumn("_salt", salt).alias("d").join(spread.alias("k"), F.expr(on)).select(
        *[f"d.{c}" for c in df.columns], *[f"k.{c}" for c in few.columns if c not in keys])


def _with_cells(df: DataFrame, cells: DataFrame) -> DataFrame:
    """Join the rows of the cells by source and tier."""
    return _salted_join(df, cells, ["source", "tier"])


def _taken() -> Column:
    """Whether the rank is in the sample: below the border bucket, or in it and
    not beyond the cut. Without a border the whole source is taken."""
    row = F.struct(*[F.col(c) for c in _RANK])
    cut = F.struct(*[F.col(f"cut.{c}") for c in _RANK])
    return F.col("border").isNull() | (F.col("bucket") < F.col("border")) | (
        (F.col("bucket") == F.col("border")) & F.coalesce(F.col("cut").isNotNull() & (row <= cut), F.lit(False)))


def with_copies(narrow: DataFrame, rules: DataFrame) -> DataFrame:
    """``narrow`` and its further columns with source_size, source_target and
    ``copies``, the number of times the mix takes the document (0 to 3)."""
    ranked = _ranked(_with_cells(narrow, rules))
    row = F.struct(*[F.col(c) for c in _RANK])
    extra = F.struct(*[F.col(f"extra.{c}") for c in _RANK])
    more = F.col("q").isNotNull() & (_taken() | F.coalesce(F.col("extra").isNotNull() & (row == extra), F.lit(False)))
    return ranked.withColumn("copies", F.col("whole") + more.cast("long")).drop(
        "rate", "whole", "p", "q", "bucket", "cell_size", "cell_target", "border", "cut", "extra")


def _entries(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
             tier: str | None = None, keep: bool = False) -> DataFrame:
    """key, source, tier, size (words; none for null) and tie of every document;
    with ``keep`` also the document as struct ``row``. ``tie`` tells documents apart
    that share a key, or have none: the md5 of the text and of the further columns."""
    others = []
    for f in docs.schema.fields:
        if f.name not in (key, text, source, tier):
            c = F.col(f"`{f.name}`")
            deep = f.dataType.typeName() in ("array", "map", "struct", "variant")
            others.append(F.coalesce(F.to_json(F.struct(c)) if deep else c.cast("string"), F.lit("null")))
    tie = F.coalesce(F.md5(F.col(f"`{text}`").cast("binary")), F.lit("null"))
    if others:
        tie = F.concat(tie, F.lit("-"), F.md5(F.concat_ws("|", *others).cast("binary")))
    out = [F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"),
           (F.lit(1) if tier is None else F.col(f"`{tier}`")).cast("long").alias("tier"),
           F.size(words(F.col(f"`{text}`"))).cast("long").alias("size"), tie.alias("tie")]
    if keep:
        out.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return docs.select(*out)


def _draw(seed: int) -> Column:
    """The number that a copy draws: of its key, its tie and which of the rows alike it is."""
    return uniform(F.concat(F.coalesce(F.col("key").cast("string"), F.lit("null")), F.lit(":"), F.col("tie"), F.lit(":"),
                            F.col("copy").cast("string")), seed)


def _repeat(df: DataFrame, times: str, out: str) -> DataFrame:
    """Each row ``times`` times, numbered from 0 in ``out``; runs of ``_SPREAD`` copies go to
    different tasks, so no task makes all copies of a row."""
    runs = df.withColumn("_run", F.explode(F.expr(f"sequence(0L, ({times} - 1) div {_SPREAD})"))).where(f"{times} > 0")
    runs = runs.withColumn("_salt", F.when(F.col("_run") > 0, F.xxhash64("_run", F.monotonically_increasing_id())))
    many = runs.where("_run > 0").repartition("_salt")
    both = runs.where("_run = 0").unionByName(many)
    return both.withColumn(out, F.explode(F.expr(
        f"sequence(_run * {_SPREAD}, least((_run + 1) * {_SPREAD}, {times}) - 1)"))).drop("_run", "_salt")


def narrowed(docs: DataFrame, seed: int = 11, **names) -> DataFrame:
    """One row per document: key, source, tier, size, tie, copy and u. Documents alike in all
    columns are counted before they meet, and numbered (``copy``) from their count,
    so each draws a number of its own and none are sorted together."""
    counts = _entries(docs, **names).groupBy(*_ALIKE).agg(F.count("*").alias("_n"))
    return _repeat(counts, "_n", "copy").drop("_n").withColumn("u", _draw(seed))


def mix(docs: DataFrame, seed: int = 11, **names) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with the
    columns of ``docs``, whatever their names.

    ``tier`` may name a column of small positive whole numbers: documents of
    tier 2 are wanted twice as often as those of tier 1 of the same source,
    within the cap. The texts are read twice, for the sizes and for the copies;
    they are shuffled only where rules or repeated rows are too many for Spark to broadcast. Rows alike in all
    columns are one row with the sum of their copies. Null texts and texts without words have size 0 and are
    never taken; an empty table gives an empty mix.
    """
    narrow = written(narrowed(docs, seed, **names), "mixing")
    rules = mixing_rules(narrow)
    rows = _entries(docs, keep=True, **names).withColumn("copy", F.lit(0).cast("long")).withColumn("u", _draw(seed))
    alike = F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in _ALIKE]))
    taken = with_copies(rows, rules).select("row", "copies", alike.alias("alike"))
    repeated = narrow.groupBy(*_ALIKE).agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        return taken.where("copies > 0").select("row", F.explode(F.expr("sequence(1L, copies)")).alias("_n")).select("row.*")
    on = " and ".join(f"a.{c} <=> b.{c}" for c in _ALIKE)
    sums = with_copies(narrow.alias("a").join(repeated.alias("b"), F.expr(on), "left_semi"), rules)
    sums = written(sums.groupBy(alike.alias("alike")).agg(F.sum("copies").alias("sum")), "mixing-repeated")
    once = taken.join(sums, "alike", "left_anti").where("copies > 0").select(
        "row", F.explode(F.expr("sequence(1L, copies)")).alias("_n"))
    more = taken.join(sums.where("sum > 0"), "alike").groupBy("alike").agg(F.first("row").alias("row"), F.first("sum").alias("sum"))
    return once.select("row").union(_repeat(more, "sum", "_n").select("row")).select("row.*")


def op6_pareto_mix(docs: DataFrame) -> DataFrame:
    """Digest of the contract. Documents alike in doc_id, source and text are interchangeable here."""
    narrow = written(narrowed(docs.select("doc_id", "text", "source")), "mixing")
    out = with_copies(narrow, mixing_rules(narrow))
    return out.select(F.col("key").alias("doc_id"), "size", "source_size", F.col("source_target").alias("target"),
                      (F.col("copies") * F.col("size")).alias("taken"))


ORACLE_OP6 = r"""
WITH d0 AS (
  SELECT doc_id, source, coalesce(md5(text), 'null') AS tie,
         row_number() OVER (PARTITION BY doc_id, source, text) - 1 AS copy,
         CAST(coalesce(len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0) AS BIGINT) AS size
  FROM documents),
d AS (SELECT *, (CAST('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || tie || ':' || copy), 1, 13) AS BIGINT)
                 + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM d0),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
              sum(source_size) OVER () AS total FROM s0),
s2 AS (SELECT *, CAST(total - 3 * coalesce(sum(source_size) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source, source_size
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
              / sum(weight) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source, source_size
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
s3 AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), weight * greatest(max(level) OVER (), 0.0)) AS target FROM s2),
-- one tier: the cell's share of the source's target is weight * (target / weight)
s AS (SELECT source, source_size, target,
             least(CAST(3 * source_size AS DOUBLE), greatest(source_size, 1) * greatest(target / greatest(source_size, 1), 0.0)) AS cell
      FROM s3),
r0 AS (SELECT d.*, s.source_size, s.target,
              CASE WHEN s.source_size > 0 THEN s.cell / s.source_size ELSE 0 END AS rate
       FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
r1 AS (SELECT *, CAST(floor(rate) AS BIGINT) AS whole, rate - floor(rate) AS p FROM r0),
r2 AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN u * (1 - p) / ((1 - u) * p) END AS q FROM r1),
r3 AS (SELECT *, CAST(floor(q / (1 + q) * 4096) AS INT) AS bucket,
              target - sum(whole * size) OVER (PARTITION BY source) AS asked FROM r2),
r4 AS (SELECT *, CASE WHEN q IS NOT NULL THEN sum(CASE WHEN q IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source, q IS NULL
                   ORDER BY bucket, q, doc_id, size, tie, copy) END AS upto FROM r3),
r5 AS (SELECT *, coalesce(upto <= asked, false) AS taken,
              asked - coalesce(max(CASE WHEN upto <= asked THEN upto END) OVER (PARTITION BY source), 0) AS short FROM r4),
r6 AS (SELECT *, CASE WHEN q IS NOT NULL AND NOT taken AND abs(short - size) < short THEN abs(short - size) END AS miss FROM r5),
x AS (SELECT source, min(row(miss, bucket, q, doc_id, size, tie, copy)) AS best FROM r6 WHERE miss IS NOT NULL GROUP BY source),
r7 AS (SELECT r6.*, miss IS NOT NULL AND row(miss, bucket, q, doc_id, size, tie, copy) = x.best AS extra
       FROM r6 LEFT JOIN x ON r6.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN taken OR coalesce(extra, false) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM r7
"""
