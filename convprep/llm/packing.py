"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted, each with a cost. Pieces of documents
are placed longest first into the open bin they fill best; where none fits, the
bin size of least cost is opened; at the end every bin shrinks to the smallest
permitted length that holds its contents. Which sizes may be opened is chosen
jointly: each block of pieces is packed under every largest permitted length,
and the cheapest packing is kept.

Pieces are dealt into blocks of bounded size by a hash, and a block is packed in
one task. A block leaves at most a few bins part-filled, so with thousands of
pieces in a block the loss against one global packing is small.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convprep.llm.common import words, written

CAPACITIES = (512, 1024, 2048, 4096, 8192)
SEQUENCE_COST = 32
BLOCK_PIECES = 8192


def sequence_costs(capacities=CAPACITIES, per_sequence: float = SEQUENCE_COST) -> dict[int, float]:
    """Cost of a sequence of each permitted length: its tokens, padding included,
    and a fixed part."""
    return {int(c): float(c + per_sequence) for c in sorted(capacities)}


def pack_block(lengths: list[int], costs: dict[int, float]) -> list[tuple[int, list[int]]]:
    """Bins (capacity, piece numbers) of one block; every length is from 1 to the
    largest capacity."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    caps = sorted(costs)
    best: tuple[float, list] | None = None
    for largest in caps:
        if order and lengths[order[0]] > largest:
            continue
        bins = _best_fit(lengths, order, {c: costs[c] for c in caps if c <= largest})
        sized = [(min(c for c in caps if c >= used), pieces) for used, pieces in bins]
        total = sum(costs[c] for c, _ in sized)
        if best is None or total < best[0]:
            best = (total, sized)
    return best[1] if best else []


def _best_fit(lengths: list[int], order: list[int], costs: dict[int, float]) -> list[tuple[int, list[int]]]:
    price = min(v / c for c, v in costs.items())  # the least a token can cost
    rest = sum(lengths)  # words not placed yet
    used: list[int] = []
    pieces: list[list[int]] = []
    room: dict[int, list[int]] = {}  # bins by free words
    free = 0  # bit f is set if a bin has f words free
    for i in order:
        n = lengths[i]
        rest -= n
        fits = free >> n
        if fits:
            f = n + (fits & -fits).bit_length() - 1
            b = room[f].pop()
            if not room[f]:
                free ^= 1 << f
        else:
            # The bin whose cost, less what its spare room is worth, is least.
            c = min((c for c in costs if c >= n), key=lambda c: (costs[c] - price * min(c - n, rest), c))
            b, f = len(used), c
            used.append(0)
            pieces.append([])
        used[b] += n
        pieces[b].append(i)
        left = f - n
        if left:
            room.setdefault(left, []).append(b)
            free |= 1 << left
    return list(zip(used, pieces, strict=True))


def pack_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", capacities=CAPACITIES,
    per_sequence: float = SEQUENCE_COST, block_pieces: int = BLOCK_PIECES,
) -> DataFrame:
    """One row per piece: ``key``, piece (from 0), start and length in words,
    bin_id, capacity and used of its bin, and its offset there.

    A document longer than the largest capacity is cut into pieces of that
    length and a rest. Documents without words, and null texts, give one row of
    length 0 with null bin. Repeated rows are packed each for itself. Columns
    other than ``key`` and ``text`` are not read, whatever their names; an
    empty table gives an empty result. Only keys and lengths are shuffled.
    """
    costs, largest = sequence_costs(capacities, per_sequence), max(capacities)
    sizes = written(docs.select(
        F.col(f"`{key}`").alias("key"), F.size(words(F.col(f"`{text}`"))).alias("n")), "packing")
    count = F.ceil(F.col("n") / largest).cast("int")
    pieces = sizes.where("n > 0").select(
        "key", "n", F.monotonically_increasing_id().alias("row"),
        F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    pieces = pieces.select(
        "key", "piece", "row", (F.col("piece") * largest).alias("start"),
        F.least(F.lit(largest), F.col("n") - F.col("piece") * largest).alias("length"))
    total = sizes.agg(F.sum(count)).first()[0] or 0
    blocks = max(1, -(-total // block_pieces))
    # The row number keeps repeated rows from meeting in one block.
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("row", "piece"), F.lit(blocks)).cast("int"))
    key_type = docs.schema[key].dataType.simpleString()
    schema = (f"key {key_type}, piece int, start int, length int, bin_id long, capacity int, "
              "used int, offset int")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "piece"], ignore_index=True)
        bins = pack_block(pdf["length"].tolist(), costs)
        out = {c: np.zeros(len(pdf), np.int64) for c in ("bin_id", "capacity", "used", "offset")}
        base = int(pdf["block"].iloc[0]) << 32
        for b, (capacity, members) in enumerate(bins):
            at = 0
            ends = np.cumsum(pdf["length"].to_numpy()[members])
            for i, e in zip(members, ends, strict=True):
                out["offset"][i], at = at, e
            out["bin_id"][members], out["capacity"][members], out["used"][members] = base + b, capacity, at
        return pdf[["key", "piece", "start", "length"]].assign(**out)

    packed = pieces.groupBy("block").applyInPandas(pack, schema)
    none = sizes.where("n = 0").select(
        "key", F.lit(0).alias("piece"), F.lit(0).alias("start"), F.lit(0).alias("length"),
        *[F.lit(None).cast(t).alias(c) for c, t in
          (("bin_id", "long"), ("capacity", "int"), ("used", "int"), ("offset", "int"))])
    return packed.union(none).withColumnRenamed("key", key)


def op8_best_fit_packing(docs: DataFrame) -> DataFrame:
    return pack_documents(docs)
