"""Sharding over fixed virtual slots (native: no Python on rows).

A record's slot is a hash of its key modulo a fixed number of slots, so it never
changes. Bytes are aggregated per slot, and a versioned table maps slots to
shards. Balancing and growing edit that table alone: records are not rehashed,
and a new shard only receives slots.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convprep.llm.common import row_key, written
from convprep.session import scratch_path

N_SLOTS = 4096


def virtual_slot(*keys: str | Column, n_slots: int = N_SLOTS) -> Column:
    """Slot of a record, from a hash of ``keys`` (nulls hash like a value)."""
    return F.pmod(row_key(*keys), F.lit(n_slots)).cast("int")


def slot_totals(slotted: DataFrame, slot: str = "vslot", size: str = "size",
                copies: str | None = None) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of the slots in use: one aggregate, at most ``n_slots`` rows.
    A row stands for ``copies`` rows, or for itself."""
    n = F.col(copies) if copies else F.lit(1)
    rows = slotted.groupBy(slot).agg(F.sum(F.col(size) * n).alias("b"), F.sum(n).alias("n")).collect()
    return sorted((r[0], r["b"] or 0, r["n"]) for r in rows)


def balance(totals: list[tuple[int, int, int]], n_shards: int, n_slots: int = N_SLOTS) -> list[int]:
    """A first map: the heaviest slot goes to the lightest shard, in turn. Slots
    not in use are dealt by the number of slots a shard has. Entry i is the
    shard of slot i."""
    weight = {s: (b, n) for s, b, n in totals}
    heap = [(0, 0, 0, k) for k in range(n_shards)]
    out = [0] * n_slots
    for s in sorted(range(n_slots), key=lambda s: (*(-x for x in weight.get(s, (0, 0))), s)):
        b, n, count, k = heapq.heappop(heap)
        out[s] = k
        heapq.heappush(heap, (b + weight.get(s, (0, 0))[0], n + weight.get(s, (0, 0))[1], count + 1, k))
    return out


def grow(current: list[int], totals: list[tuple[int, int, int]], n_shards: int) -> list[int]:
    """Edit a map for ``n_shards`` shards: slots move into the new shards only,
    each time from the heaviest old shard to the lightest new one, as long as
    that brings the two nearer. No slot moves between old shards."""
    weight = {s: b for s, b, _ in totals}
    old = max(current) + 1 if current else 0
    out, load = list(current), [0] * max(n_shards, old)
    slots: list[list[int]] = [[] for _ in load]
    for s in sorted(range(len(current)), key=lambda s: (weight.get(s, 0), -s)):
        load[current[s]] += weight.get(s, 0)
        slots[current[s]].append(s)
    share = sum(load) / max(1, n_shards)
    for new in range(old, n_shards):
        while load[new] < share:
            donor = max(range(old), key=lambda k: (load[k], -k))
            fits = [s for s in slots[donor] if 0 < weight.get(s, 0) <= share - load[new]]
            if not fits or load[donor] <= load[new]:
                break
            s = fits[-1]
            slots[donor].remove(s)
            slots[new].append(s)
            out[s] = new
            load[donor] -= weight[s]
            load[new] += weight[s]
    return out


def store_map(spark: SparkSession, shards: list[int], path: str, version: int,
              totals: list[tuple[int, int, int]] = ()) -> None:
    """Write version ``version`` of the slot table: slot, shard, first_row (rows
    of the shard in earlier slots). Versions are never overwritten."""
    rows = {s: n for s, _, n in totals}
    seen: dict[int, int] = {}
    first = []
    for s, k in enumerate(shards):
        first.append(seen.get(k, 0))
        seen[k] = first[-1] + rows.get(s, 0)

    def lookup(values, kind: str) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")[F.col("id").cast("int")]

    spark.range(0, len(shards), 1, 1).select(
        F.col("id").cast("int").alias("vslot"), lookup(shards, "int").alias("shard"),
        lookup(first, "bigint").alias("first_row"),
    ).write.mode("errorifexists").parquet(f"{path}/version={version:06d}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The slot table of ``version``, by default the newest."""
    every = spark.read.parquet(path)
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == int(version)).drop("version")


def assign(slotted: DataFrame, slot_map: DataFrame, slot: str = "vslot") -> DataFrame:
    """``slotted`` with the columns of its slot's row of the map. The map is
    broadcast: it has exactly as many rows as there are slots."""
    return slotted.join(F.broadcast(slot_map.withColumnRenamed("vslot", slot)), slot)


def shard_documents(
    docs: DataFrame, n_shards: int = 24, n_slots: int = N_SLOTS, map_path: str | None = None,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Put every record into a shard of nearly equal bytes and number the rows of
    each shard from 0 without gaps.

    Returns ``key``, size (UTF-8 bytes of the text, none for null, plus 8),
    text_crc32, vslot, shard and slot (the row's number within its shard). The
    slot hashes key and text, so records whose key is null spread by their
    text. Rows alike in both share a slot up to a slot's fair share of the
    bytes; more of them go by parts to slots of a hash with the part's number.
    Other columns, whatever their names, are not read. An empty table gives an
    empty result. The texts are read once: sizes and slots of the different
    rows, with their counts, are written as a narrow table, from which the
    totals and the numbering are made. Numbering sorts within virtual slots,
    thousands of which spread over the tasks; no task holds a whole shard.
    """
    spark = docs.sparkSession
    narrow = written(docs.select(
        F.col(f"`{key}`").alias("id"),
        (F.coalesce(F.octet_length(f"`{text}`"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(f"`{text}`").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        row_key(f"`{key}`", f"`{text}`").alias("hash"),
    ).groupBy("id", "size", "text_crc32", "hash").agg(F.count("*").alias("n")), "sharding")
    fair = (narrow.agg(F.sum(F.col("size") * F.col("n"))).first()[0] or 0) / n_slots
    # A part is of ``most`` rows, the last one of the rest; part 0 goes by the hash alone.
    most = F.greatest(F.lit(1), F.floor(F.lit(float(fair)) / F.col("size"))).cast("long")
    parts = narrow.withColumn("most", most).withColumn(
        "part", F.explode(F.expr("sequence(0, cast((n - 1) div most as bigint))")))
    parts = parts.withColumn("n", F.least(F.col("most"), F.col("n") - F.col("part") * F.col("most")))
    slot = F.when(F.col("part") == 0, F.col("hash")).otherwise(F.xxhash64("hash", "part"))
    parts = written(parts.select("id", "size", "text_crc32", "hash", "part", "n",
                                 F.pmod(slot, F.lit(n_slots)).cast("int").alias("vslot")), "sharding-parts")
    totals = slot_totals(parts, copies="n")
    path = map_path or scratch_path(spark, "slot-map")
    store_map(spark, balance(totals, n_shards, n_slots), path, 1, totals)
    placed = assign(parts, load_map(spark, path, 1))
    before = Window.partitionBy("vslot").orderBy("id", "size", "text_crc32", "hash", "part").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("end", F.col("first_row") + F.sum("n").over(before))
    return placed.select(F.col("id").alias(key), "size", "text_crc32", "vslot", "shard",
                         F.explode(F.expr("sequence(end - n, end - 1)")).alias("slot"))


def op9_virtual_slots(docs: DataFrame) -> DataFrame:
    """Digest of the contract, law ``bytes``."""
    return shard_documents(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
