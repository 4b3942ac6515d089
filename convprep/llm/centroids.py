"""Lloyd's clustering of integer vectors with a Walsh-Hadamard progressive search.

Vectors and centroids go through the Walsh-Hadamard transform in whole numbers
(entries +1 and -1, no scaling), which multiplies every squared distance by the
number of components. With the coefficients ordered by sequency, coarse ones
come first and hold most of the distance between smooth vectors. The search adds
up squared coefficient differences from coarse to fine. A sum so far is never
above the whole sum, so a centroid whose sum so far exceeds the whole sum of
another is strictly worse and is dropped; those that stay are added up over all
coefficients. All arithmetic is in whole numbers, so the result is exact, ties
included.

The transform is taken once; the rounds read its table. A task sends one partial
sum per cluster, and the sums of the coefficients, transformed back, are the
sums of the vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convprep.llm.common import written

SCALE = 1024
SEED = 3
CLUSTERS = 8
ROUNDS = 10
STEPS = (4, 16)  # coefficients seen when centroids are dropped; then all
_EXACT = 1 << 23  # below this, sums of squares of 64 coefficients fit 64 bits


def hadamard(n: int) -> np.ndarray:
    """The n x n matrix (n a power of two), rows by the number of sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((h[:, 1:] != h[:, :-1]).sum(axis=1))]


def transform(vectors: np.ndarray) -> np.ndarray:
    """Coefficients of the rows, by butterflies, in sequency order."""
    n = vectors.shape[1]
    out, half = vectors, 1
    while half < n:
        pairs = out.reshape(len(out), -1, 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2)
        out, half = out.reshape(len(vectors), n), 2 * half
    # The butterflies give the rows of the plain matrix; sort them as hadamard() does.
    plain = np.ones((1, 1), np.int64)
    while len(plain) < n:
        plain = np.block([[plain, plain], [plain, -plain]])
    return out[:, np.argsort((plain[:, 1:] != plain[:, :-1]).sum(axis=1))]


def nearest(coef: np.ndarray, centers: np.ndarray, steps=STEPS) -> tuple[np.ndarray, np.ndarray, int]:
    """For every row of coefficients the nearest centre (ties: the smaller
    number), the squared distance times the number of components, and how many
    coefficient differences were added up."""
    rows, n = coef.shape
    k = len(centers)
    total = np.zeros((rows, k), np.result_type(coef.dtype, centers.dtype))
    low, work = 0, 0
    alive = np.ones((rows, k), bool)
    everything = np.arange(rows)
    bound = None
    for high in [*[s for s in steps if s < n], n]:
        for c in range(k):
            at = np.flatnonzero(alive[:, c])
            d = coef[at, low:high] - centers[c, low:high]
            total[at, c] += (d * d).sum(axis=1)
            work += len(at) * (high - low)
        if high < n:
            if bound is None:
                # The whole sum of the centre that looks best so far is what the others must not exceed.
                guess = total.argmin(axis=1)
                d = coef[:, high:] - centers[guess, high:]
                bound = total[everything, guess] + (d * d).sum(axis=1)
                work += rows * (n - high)
            alive &= total <= bound[:, None]
        low = high
    # A dropped centre's sum exceeds the bound, which the least whole sum does not.
    best = total.argmin(axis=1)
    return best, total[everything, best], work


def _floors(vec: Column, scale: int) -> Column:
    """Whole doubles; from 2**53 on every double is whole."""
    def one(x: Column) -> Column:
        y = x.cast("double") * F.lit(float(scale))
        return F.when(F.abs(y) < F.lit(2.0**53), F.floor(y).cast("double")).otherwise(y)
    return F.transform(vec, one)


def _kept(vec: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` components, none null or non-finite."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vec.isNotNull() & (F.size(vec) == dim) & F.coalesce(fine, F.lit(False))


def _integers(column: pd.Series, dim: int) -> np.ndarray:
    """Whole doubles as 64-bit integers where their squares fit, else as Python's."""
    x = np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, dim))
    return x.astype(np.int64) if np.abs(x).max(initial=0) < _EXACT else np.array([[int(v) for v in r] for r in x], object)


def cluster(
    df: DataFrame, key: str = "vec_id", vec: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
    dim: int = 64, scale: int = SCALE, seed: int = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """Cluster the vectors ``floor(scale * x)``; returns the table (``key``,
    cluster, distance) and the final centroids (integers, clusters x dim).

    The first centroids are the ``clusters`` vectors whose sha256 of
    ``seed:key`` is smallest, in ascending order (a null key comes last; rows
    alike in key go by their components). In each round every vector goes to the nearest
    centroid, and every centroid that got vectors becomes the floor of their mean.
    After the rounds vectors are assigned once more.

    Vectors that are null, have another number of components than ``dim`` (a
    power of two), or hold null or non-finite ones are left out. Rows that repeat
    count each for themselves. With fewer vectors than clusters there are as
    many centroids as vectors; an empty table gives an empty one. Other columns
    are not read. A squared distance beyond 64 bits (components beyond about 1e6)
    is an error. Every round reads the table of coefficients and
    shuffles one partial sum per task and cluster.
    """
    if dim & (dim - 1):
        raise ValueError("dim must be a power of two")
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    column = F.col(f"`{vec}`")
    kept = df.where(_kept(column, dim)).select(F.col(f"`{key}`").alias("id"), column.alias("v"))
    whole = kept.select("id", _floors(F.col("v"), scale).alias("v"))

    @F.pandas_udf("wide boolean, coef binary")
    def to_coefficients(vectors: pd.Series) -> pd.DataFrame:
        x = _integers(vectors, dim)
        wide = x.dtype == object
        c = transform(x)
        return pd.DataFrame({"wide": [wide] * len(x), "coef": [
            " ".join(map(str, r)).encode() if wide else r.astype(np.int64).tobytes() for r in c]})

    def unpack(wide: pd.Series, coef: pd.Series) -> np.ndarray:
        if wide.any():
            return np.array([[int(v) for v in c.split()] if w else np.frombuffer(c, np.int64).tolist()
                             for w, c in zip(wide, coef, strict=True)], object).reshape(len(coef), dim)
        return np.frombuffer(b"".join(coef), np.int64).reshape(len(coef), dim)

    label = F.when(F.col("id").isNotNull(), F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    first = whole.select("v", label.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters).collect()
    centers = np.array([[int(x) for x in r["v"]] for r in first], object).reshape(len(first), dim)
    if not len(centers):
        empty = spark.createDataFrame([], f"id {kind}, cluster int, distance long")
        return empty.withColumnRenamed("id", key), centers
    stored = written(whole.select("id", to_coefficients("v").alias("c")).select("id", "c.wide", "c.coef"), "centroid-coefficients")

    def narrow(x: np.ndarray) -> np.ndarray:
        """Python integers as 64-bit ones where squares fit."""
        return x.astype(np.int64) if all(abs(v) < _EXACT * dim for v in x.flat) else x

    def partial(coef_centers: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = np.zeros((len(coef_centers), dim), object)
            counts = np.zeros(len(coef_centers), np.int64)
            for pdf in batches:
                coef = unpack(pdf["wide"], pdf["coef"])
                best, _, _ = nearest(coef, coef_centers)
                for c in np.unique(best):
                    sums[c] += coef[best == c].sum(axis=0).astype(object)
                    counts[c] += (best == c).sum()
            at = np.flatnonzero(counts)
            if not len(at):
                return
            yield pd.DataFrame({"cluster": np.repeat(at, dim), "i": np.tile(np.arange(dim), len(at)),
                                "s": [str(v) for v in sums[at].flat], "n": np.repeat(counts[at], dim)})
        return run

    for _ in range(rounds):
        here = narrow(transform(centers))
        got = stored.select("wide", "coef").mapInPandas(partial(here), "cluster int, i int, s string, n long").groupBy("cluster", "i").agg(
            F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()
        sums = np.zeros((len(centers), dim), object)
        counts = np.zeros(len(centers), object)
        for r in got:  # clusters x dim rows
            sums[r["cluster"], r["i"]], counts[r["cluster"]] = int(r["s"]), r["n"]
        h = hadamard(dim).astype(object)
        for c in np.flatnonzero(counts):
            centers[c] = (h.T @ sums[c]) // dim // counts[c]

    last = narrow(transform(centers))

    @F.pandas_udf("cluster int, distance long")
    def assign(wide: pd.Series, coef: pd.Series) -> pd.DataFrame:
        best, far, _ = nearest(unpack(wide, coef), last)
        return pd.DataFrame({"cluster": best, "distance": far // dim})

    out = stored.select(F.col("id").alias(key), assign("wide", "coef").alias("_a"))
    return out.select(F.col(f"`{key}`"), "_a.cluster", "_a.distance"), centers


def op12_walsh_hadamard(embeddings: DataFrame) -> DataFrame:
    """Digest of the contract."""
    assigned, centers = cluster(embeddings)
    assigned = written(assigned, "centroid-clusters")
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # a row per cluster, eight at most
    inertia = sum(r["s"] for r in sums)
    rows = [(r["cluster"], r["s"], inertia, hashlib.sha256(",".join(map(str, centers[r["cluster"]])).encode()).hexdigest())
            for r in sums]
    per = assigned.sparkSession.createDataFrame(
        rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(per), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """Rounds written out one after another: each has the centroids as rows of
    (cluster, component list)."""
    steps = [r"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS INT) AS cluster, v
  FROM (SELECT v, CASE WHEN vec_id IS NOT NULL THEN sha256('3:' || CAST(vec_id AS VARCHAR)) END AS h FROM kept
        ORDER BY h NULLS LAST, v LIMIT 8) AS f),"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""
d{r} AS MATERIALIZED (
  SELECT rid, min(row(d, cluster)) AS best FROM (
    SELECT k.rid, c.cluster, list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
    FROM kept AS k, c{r} AS c) AS a GROUP BY rid),""")
        if r < ROUNDS:
            steps.append(f"""
m{r} AS MATERIALIZED (
  SELECT cluster, list(m ORDER BY i) AS v FROM (
    SELECT d.best[2] AS cluster, i, CAST(floor_div(sum(k.v[i]), count(*)) AS HUGEINT) AS m
    FROM d{r} AS d JOIN kept AS k USING (rid), range(1, 65) AS t(i) GROUP BY ALL) AS s GROUP BY cluster),
c{r + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} AS c LEFT JOIN m{r} AS m USING (cluster)),""")
    steps.append(f"""
g AS (SELECT k.vec_id, d.best[2] AS cluster, CAST(d.best[1] AS BIGINT) AS distance FROM d{ROUNDS} AS d JOIN kept AS k USING (rid))
SELECT vec_id, g.cluster, distance, CAST(sum(distance) OVER (PARTITION BY g.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c.v, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM g JOIN c{ROUNDS} AS c ON g.cluster = c.cluster
""")
    # floor of an exact quotient of whole numbers: // rounds towards zero
    return "".join(steps).replace(
        "floor_div(sum(k.v[i]), count(*))",
        "(sum(k.v[i]) // count(*)) - CASE WHEN sum(k.v[i]) < 0 AND sum(k.v[i]) % count(*) <> 0 THEN 1 ELSE 0 END")


ORACLE_OP12 = _oracle()
