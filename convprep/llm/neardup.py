"""Near-duplicate vectors by NN-descent.

A neighbour graph starts from random-hyperplane buckets and is refined in
rounds: at every vector its neighbours, and those it is a neighbour of, are
compared with each other, and whoever finds a nearer one takes it into its list.
Lists whose farthest entry is still a near-duplicate are saturated and grow. The
graph is audited against brute force on a bounded set of vectors; below the
recall asked for, further rounds run with longer lists.

Edges near the threshold join vectors into candidate components. A saturated list
may have had no room for an edge to another component, so the vectors of such
lists are searched again, with lists of vectors of other components only, until
no edge between components is found. Every two members of a component are
compared in double precision, in blocks of bounded size, which supplies the
links within it that lists had no room for.

Vectors alike in all components are one node throughout. Refinement works on
8-bit copies of the vectors; the results do not.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convprep.llm.common import block_pairs, components, forest, groups_of, row_key, written

THRESHOLD = 0.95
MARGIN = 0.04  # below the threshold, for the 8-bit copies
NEIGHBOURS = 12
SATURATED = 48
TABLES = 6
LEAF = 48
ROUNDS = 3
AUDIT = 256
AUDIT_LINKED = 64
AUDIT_MOST = 4096
RECALL = 0.97
ATTEMPTS = 4
PER_BLOCK = 256

_LIST = "node long, nbrs array<long>, sims array<float>"


def usable(vector: Column) -> Column:
    """Whether a vector can link: not null, no null, infinite or NaN component, not zero."""
    v = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision, scaled first so no square over- or underflows."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _pack8(vectors: np.ndarray) -> list[bytes]:
    q = np.rint(vectors / np.abs(vectors).max(axis=1, keepdims=True) * 127).astype(np.int8)
    return [r.tobytes() for r in q]


def _unpack8(packed) -> np.ndarray:
    return _unit(np.frombuffer(b"".join(packed), np.int8).reshape(len(packed), -1).astype(np.float64)).astype(np.float32)


def _top(node: np.ndarray, nbr: np.ndarray, sim: np.ndarray, k: int, more: int, near: float) -> pd.DataFrame:
    """Lists of each node's nearest distinct neighbours: ``k``, or up to ``more`` where
    the k-th is at least ``near``."""
    order = np.lexsort((nbr, node))
    node, nbr, sim = node[order], nbr[order], sim[order]
    new = np.concatenate([[True], (node[1:] != node[:-1]) | (nbr[1:] != nbr[:-1])])
    sim = np.maximum.reduceat(sim, np.flatnonzero(new)) if len(sim) else sim
    node, nbr = node[new], nbr[new]
    order = np.lexsort((nbr, -sim, node))
    node, nbr, sim = node[order], nbr[order], sim[order]
    starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, int)
    rank = np.arange(len(node)) - np.repeat(starts, np.diff(np.append(starts, len(node))))
    keep = (rank < k) | ((rank < more) & (sim >= near))
    node, nbr, sim = node[keep], nbr[keep], sim[keep].astype(np.float32)
    starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, int)
    return pd.DataFrame({"node": node[starts], "nbrs": np.split(nbr, starts[1:]) if len(starts) else [],
                         "sims": np.split(sim, starts[1:]) if len(starts) else []})


def _tables(nodes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """The 8-bit vectors, each in one bucket of every hyperplane table."""
    def bucket(batches):
        for pdf in batches:
            size = pdf["vector"].map(len).to_numpy()
            for d in np.unique(size):
                part = pdf[size == d]
                v = np.stack(part["vector"].to_numpy()).astype(np.float64)
                v8 = _pack8(v)
                for t in range(tables):
                    planes = np.random.default_rng([seed, t, int(d)]).standard_normal((int(d), bits))
                    sign = (v @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(v), np.int64)
                    yield pd.DataFrame({"t": t, "dim": int(d), "bucket": sign, "node": part["node"].to_numpy(), "v8": v8})

    return nodes.select("node", "vector").mapInPandas(bucket, "t int, dim int, bucket long, node long, v8 binary")


def _start(nodes: DataFrame, count: int, k: int, seed: int) -> DataFrame:
    """First lists: the nearest within each bucket of each table, other than those of
    the vector's own ``component``. A bucket of many vectors is dealt into parts."""
    bits = max(0, min(30, math.ceil(math.log2(max(1, count) / LEAF))))
    placed = _tables(nodes, bits, TABLES, seed)
    full = placed.groupBy("t", "dim", "bucket").agg(F.count("*").alias("n")).where(f"n > {2 * LEAF}")
    placed = placed.join(full, ["t", "dim", "bucket"], "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64("node", "t"), F.ceil(F.col("n") / (2 * LEAF))), F.lit(0)))
    keys = ["t", "dim", "bucket", "part"]
    placed = placed.drop("n").join(nodes.select("node", "component"), "node")
    met = placed.repartition(*[F.col(c) for c in keys]).sortWithinPartitions(*keys, "node")

    def near(batches):
        for g in groups_of(batches, keys):
            if len(g) > 1:
                yield from _local_join([(g["node"].to_numpy(), _unpack8(g["v8"].tolist()), np.full(len(g), -2.0),
                                         g["component"].to_numpy())], k)

    return met.mapInPandas(near, _LIST)


def _local_join(parts, k: int):
    """Compare the members of each part that are of different components; lists of
    up to ``k`` per node, of those nearer than what its own list ends with."""
    held: list = [[], [], []]
    size = 0

    def flush():
        out = _top(*[np.concatenate(x) for x in held], k, k, 2.0)
        held[:] = [], [], []
        return out

    for node, unit, last, component in parts:
        sim = unit @ unit.T
        sim[component[:, None] == component] = -2.0
        if len(node) > k + 1:
            cut = np.partition(sim, len(node) - k, axis=1)[:, len(node) - k][:, None]
            x, y = np.nonzero((sim > last[:, None]) & (sim >= cut) & (sim > -1.5))
        else:
            x, y = np.nonzero((sim > last[:, None]) & (sim > -1.5))
        for h, values in zip(held, (node[x], node[y], sim[x, y]), strict=True):
            h.append(values)
        size += len(x)
        if size > 400_000:
            yield flush()
            size = 0
    if size:
        yield flush()


def _merge(lists: DataFrame, k: int, more: int, near: float) -> DataFrame:
    """One list per node of all its lists."""
    gathered = lists.groupBy("node").agg(F.flatten(F.collect_list("nbrs")).alias("nbrs"),
                                         F.flatten(F.collect_list("sims")).alias("sims"))

    def merge(batches):
        for pdf in batches:
            if len(pdf):
                sizes = pdf["nbrs"].map(len).to_numpy()
                yield _top(np.repeat(pdf["node"].to_numpy(), sizes), np.concatenate(pdf["nbrs"].to_numpy()),
                           np.concatenate(pdf["sims"].to_numpy()).astype(np.float64), k, more, near)

    return gathered.mapInPandas(merge, _LIST)


def _round(graph: DataFrame, small: DataFrame, k: int, more: int, near: float) -> DataFrame:
    """One round: neighbours of neighbours, in both directions."""
    forward = graph.select(F.col("node").alias("at"), F.explode(F.slice("nbrs", 1, 2 * k)).alias("node"))
    # In-links are thinned to about k per vector, however many it has.
    degree = forward.groupBy("node").agg(F.count("*").alias("n"))
    thin = forward.join(degree, "node").where(
        F.pmod(F.xxhash64("at", "node"), F.lit(1 << 20)) < F.lit(k << 20) / F.col("n"))
    pairs = forward.union(thin.select(F.col("node").alias("at"), F.col("at").alias("node"))).distinct()
    # A list with room, be it for more near-duplicates, takes any.
    full = (F.size("nbrs") >= more) | ((F.size("nbrs") >= k) & (F.element_at("sims", -1) < near))
    last = graph.select("node", F.when(full, F.element_at("sims", -1)).when(
        F.size("nbrs") >= k, F.lit(near)).otherwise(F.lit(-2.0)).alias("last"))
    met = pairs.join(small.join(last, "node", "left"), "node").repartition("at").sortWithinPartitions("at", "node")

    def join(batches):
        yield from _local_join(
            ((g["node"].to_numpy(), _unpack8(g["v8"].tolist()), np.nan_to_num(g["last"].to_numpy(float), nan=-2.0),
              g["component"].to_numpy())
             for g in groups_of(batches, ["at"]) if len(g) > 1), k)

    found = met.select("at", "node", "v8", "last", "component").mapInPandas(join, _LIST)
    return _merge(graph.union(found), k, more, near)


def _descent(nodes: DataFrame, small: DataFrame, count: int, rounds: int, k: int, more: int, near: float,
             seed: int, graph: DataFrame | None = None) -> DataFrame:
    """Neighbour lists of ``nodes``, of vectors of other components than their own,
    refined in rounds from ``graph`` or from buckets."""
    if graph is None:
        graph = written(_merge(_start(nodes, count, k, seed), k, more, near), "neighbours")
    def state(g: DataFrame) -> tuple[int, float]:
        """Edges of near-duplicates, and the similarity of all."""
        row = g.agg(F.sum(F.size(F.filter("sims", lambda x: x >= near))),
                    F.sum(F.aggregate("sims", F.lit(0.0), lambda a, x: a + x))).first()
        return row[0] or 0, row[1] or 0.0

    now = state(graph)
    for _ in range(rounds):
        graph = written(_round(graph, small, k, more, near), "neighbours")
        before, now = now, state(graph)
        if now[0] <= before[0] and now[1] - before[1] <= 0.001 * abs(before[1]):
            break
    return graph


def _near_edges(graph: DataFrame, near: float) -> DataFrame:
    return graph.select(F.col("node").alias("a"), F.explode(F.arrays_zip("nbrs", "sims")).alias("e")).where(
        F.col("e.sims") >= near).select("a", F.col("e.nbrs").alias("b"))


def _candidates(nodes: DataFrame, small: DataFrame, count: int, rounds: int, k: int, more: int, near: float,
                seed: int, graph: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The neighbour lists, and the members of the candidate components.

    An edge is missed for want of room only if the lists at both its ends are
    full of near-duplicates. The vectors of such lists are searched again among
    themselves, within other components only; every edge found joins two
    components, and it ends when there is none or no list is full.
    """
    alone = F.col("node").alias("component")
    graph = first = _descent(nodes.select("node", "vector", alone), small.select("node", "v8", alone),
                             count, rounds, k, more, near, seed, graph)
    edges = written(_near_edges(graph, near), "vector-edges")
    while True:
        members = written(components(edges, "vector-candidates"), "vector-members")
        full = graph.where((F.size("nbrs") >= k) & (F.element_at("sims", -1) >= near)).select("node")
        full = written(full.join(members, "node"), "vector-full")
        left = full.agg(F.count("*"), F.count_distinct("component")).first()
        if left[1] < 2:
            return first, members
        seed += 1
        graph = _descent(nodes.select("node", "vector").join(full, "node"), small.join(full, "node"),
                         left[0], rounds, k, more, near, seed)
        new = written(_near_edges(graph, near), "vector-edges")
        if new.isEmpty():
            return first, members
        edges = edges.union(new)


def _compared(members: DataFrame, nodes: DataFrame, threshold: float, per_block: int) -> DataFrame:
    """Compare all members of each component in double precision; rows (node, links,
    label) as in the Jaccard join."""
    met = block_pairs(members, per_block).join(nodes, "node").select(
        "component", "i", "j", "node", "own", "copies", "vector")
    met = met.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node")

    def compare(batches):
        for g in groups_of(batches, ["component", "i", "j"]):
            if len(g) < 2:
                continue
            unit = _unit(np.stack(g["vector"].to_numpy()).astype(np.float64))
            first = (g["own"] == g["i"]).to_numpy()
            within = g["i"].iloc[0] == g["j"].iloc[0]
            a = np.flatnonzero(first)
            b = a if within else np.flatnonzero(~first)
            linked = unit[a] @ unit[b].T >= threshold
            if within:
                np.fill_diagonal(linked, False)
            copies, links = g["copies"].to_numpy(), np.zeros(len(g), np.int64)
            links[a] += linked @ copies[b]
            if not within:
                links[b] += linked.T @ copies[a]
            x, y = linked.nonzero()
            node, hit = g["node"].to_numpy(), links > 0
            yield pd.DataFrame({"node": node[hit], "links": links[hit],
                                "label": node[forest(len(g), a[x], b[y])][hit]})

    return met.mapInPandas(compare, "node long, links long, label long")


def audit(nodes: DataFrame, met: DataFrame, linked: DataFrame, threshold: float, queries: int = AUDIT,
          enough: int = AUDIT_LINKED, most: int = AUDIT_MOST) -> float:
    """Recall of ``met`` (node, links) against brute force: the share of its links
    that a vector has, as the mean over the vectors queried that have a link. The
    vectors of the largest component of ``linked`` (node, component) count as one.

    Vectors are drawn in the order of their hashes, few of the largest component,
    and more of them until ``enough`` outside of it have a link; at most about
    ``most`` are. 1 if none has a link.
    """
    hot = linked.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").first()
    hot = None if hot is None else hot["component"]
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    drawn = nodes.join(linked, "node", "left").select(
        "node", "vector", F.coalesce(F.col("component") == F.lit(hot).cast("long"), F.lit(False)).alias("hot"),
        F.xxhash64("node", F.lit("audit")).alias("draw"))
    rest = drawn.where("not hot").orderBy("draw")
    chosen = drawn.where("hot").orderBy("draw").limit(max(1, queries // 8)).collect()
    share: list[float] = []
    inside: list[float] = []
    size, after = queries, None
    while True:
        more = (rest if after is None else rest.where(F.col("draw") > after)).limit(size).collect()
        for is_hot, found in _shares(nodes, links, [*chosen, *more], threshold):
            (inside if is_hot else share).append(found)
        if len(more) < size or len(share) >= enough or 2 * size > most:
            break
        size, after, chosen = 2 * size, more[-1]["draw"], []
    if inside:
        share.append(sum(inside) / len(inside))
    return sum(share) / len(share) if share else 1.0


def _shares(nodes: DataFrame, links: DataFrame, chosen: list, threshold: float) -> list[tuple[bool, float]]:
    """Of the ``chosen`` nodes that have a link, whether they are hot and the share of
    their links found; all nodes are compared with them."""
    hot = {r["node"]: r["hot"] for r in chosen}
    if not hot:
        return []
    by_size = {}
    for d in {len(r["vector"]) for r in chosen}:
        mine = [r for r in chosen if len(r["vector"]) == d]
        by_size[d] = np.array([r["node"] for r in mine]), _unit(np.array([r["vector"] for r in mine], float))

    def brute(batches):
        for pdf in batches:
            size = pdf["vector"].map(len).to_numpy()
            for d, (ids, units) in by_size.items():
                part = pdf[size == d]
                if not len(part):
                    continue
                near = _unit(np.stack(part["vector"].to_numpy()).astype(np.float64)) @ units.T >= threshold
                near &= part["node"].to_numpy()[:, None] != ids[None, :]
                true = part["copies"].to_numpy() @ near
                yield pd.DataFrame({"node": ids[true > 0], "links": true[true > 0]})

    true = nodes.mapInPandas(brute, "node long, links long").groupBy("node").agg(F.sum("links").alias("true"))
    true = {r["node"]: r["true"] for r in true.collect()}  # as many as are chosen, at most
    found = {r["node"]: r["links"] for r in links.where(F.col("node").isin(list(true))).collect()} if true else {}
    return [(hot[k], found.get(k, 0) / n) for k, n in true.items()]


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD,
    neighbours: int = NEIGHBOURS, rounds: int = ROUNDS, recall: float = RECALL, per_block: int = PER_BLOCK,
    seed: int = 3,
) -> DataFrame:
    """One row per vector: ``key``, n_links (other vectors of cosine >= ``threshold``
    linked with it) and component_id (smallest key reachable by links, its own
    included).

    Vectors that are null, zero or hold null, infinite or NaN components link
    with nothing, nor do vectors of different lengths with each other. Repeated
    rows and equal vectors are vectors of their own that link. A component of
    null keys alone has a null component_id. Other columns are not read,
    whatever their names; an empty table gives an empty result. It is an error
    if the audit still shows less than ``recall`` with the longest lists.
    """
    rows = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("vector"))
    rows = rows.withColumn("usable", usable(F.col("vector")))
    nodes = written(rows.where("usable").groupBy("vector").agg(F.count("*").alias("copies")).select(
        row_key("vector").alias("node"), "vector", "copies"), "vectors")
    count, near = nodes.count(), threshold - MARGIN

    def small8(batches):
        for pdf in batches:
            yield pd.DataFrame({"node": pdf["node"], "v8": [_pack8(np.asarray([v], float))[0] for v in pdf["vector"]]})

    small = nodes.select("node", "vector").mapInPandas(small8, "node long, v8 binary")
    small = written(small, "vectors8")
    k, more = neighbours, SATURATED
    graph = None
    for attempt in range(ATTEMPTS):
        graph, members = _candidates(nodes, small, count, rounds, k, more, near, seed, graph)
        met = written(_compared(members, nodes, threshold, per_block), "vector-links")
        linked = written(components(met.select(F.col("node").alias("a"), F.col("label").alias("b")),
                                    "vector-components"), "vector-linked")
        seen = audit(nodes, met, linked, threshold)
        if seen >= recall:
            break
        if attempt + 1 == ATTEMPTS:
            raise RuntimeError(f"near-duplicates: recall of {seen:.4f} with lists of {k} to {more}, {recall} asked for")
        k, more = 2 * k, 2 * more
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    of_node = nodes.select("node", "copies").join(linked, "node", "left").join(links, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    placed = rows.select("id", F.when(F.col("usable"), row_key("vector")).alias("node")).join(of_node, "node", "left")
    least = placed.where("component is not null").groupBy("component").agg(F.min("id").alias("least"))
    out = placed.join(least, "component", "left")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def op2_nn_descent(vectors: DataFrame) -> DataFrame:
    """Digest of the contract."""
    return near_duplicates(vectors).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE_OP2 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(c.b, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(c.b, vec_id)) AS kept
FROM embeddings LEFT JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
"""
