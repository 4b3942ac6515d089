"""Helpers shared by the operators: words, row keys, written stages and
connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convprep.session import scratch_path

# A word is a run of characters other than blank, tab, LF, VT, FF and CR.
BLANKS = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text, in order; none for null. The same rule as
    ``bytes.split()`` in Python, which splits at these six characters."""
    return F.coalesce(F.array_remove(F.split(text, BLANKS), ""), F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    An array expression used inside a lambda would be evaluated again for each
    element; bound as a lambda variable it is not.
    """
    return F.transform(F.array(value), body)[0]


def row_key(*cols: str | Column) -> Column:
    """64-bit key of a row's columns; nulls have a key too. Rows that are alike
    in all of ``cols`` share it, and get the same answer from every operator
    that joins by it."""
    cols = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.xxhash64(*[x for c in cols for x in (c, c.isNull())])


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder (spark.checkpoint.dir) and
    read it back: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges`` (``a``, ``b`` long): one row
    (``node``, ``component``) per node that has an edge, ``component`` being
    the smallest node of its component.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each
    is an aggregate of the smallest neighbour per node, joined back, so no
    node's neighbours are gathered in one place. The rounds number in the
    logarithm of the graph; each is written to the shared folder.
    """
    def smallest(directed: DataFrame) -> DataFrame:
        """Directed rows (u, v) with ``m``, the least of u and all its v."""
        least = directed.groupBy("u").agg(F.min("v").alias("m"))
        return directed.join(least, "u").withColumn("m", F.least("u", "m"))

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    # Edges point from the larger node (a) to the smaller (b).
    now = written(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = mark(now)
    while before[0]:
        large = smallest(both(now)).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = smallest(large.select(F.col("a").alias("u"), F.col("b").alias("v")))
        small = down.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            down.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = written(small.where("a <> b").distinct(), name)
        after = mark(now)
        if after == before:
            break
        before = after
    # Every edge now leads straight to the smallest node of its component.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def block_pairs(members: DataFrame, per_block: int) -> DataFrame:
    """Deal each component's members into blocks and pair the blocks.

    ``members`` has node and component, ``per_block`` is the mean size of a
    block. A member is returned once for each pair (i <= j) of blocks its own
    is part of, so that every two members of a component meet in exactly one
    place: (component, i, i) if they share a block, else (component, i, j).
    ``own`` is the member's block. Small components are one block.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("n"))
    dealt = members.join(sizes, "component").withColumn("blocks", F.ceil(F.col("n") / per_block).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return other.select("node", "component", "own", F.least("own", "other").alias("i"),
                        F.greatest("own", "other").alias("j"))


def groups_of(batches, keys: list[str]):
    """Data frames of equal ``keys`` from the batches of a partition sorted by them."""
    import pandas as pd

    held: list = []
    for pdf in batches:
        if not len(pdf):
            continue
        values = pdf[keys].to_numpy()
        cuts = [0, *((values[1:] != values[:-1]).any(axis=1).nonzero()[0] + 1).tolist(), len(pdf)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            part = pdf.iloc[lo:hi]
            if held and (held[-1][keys].iloc[-1].to_numpy() != part[keys].iloc[0].to_numpy()).any():
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)


def forest(n: int, a, b) -> list[int]:
    """Smallest number connected to each of 0..n-1 by the links a[k] - b[k]."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = root(int(x)), root(int(y))
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [root(x) for x in range(n)]
