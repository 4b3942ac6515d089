"""N-gram Jaccard join by MinHash banding.

Documents are sets of word 5-grams. MinHash signatures are cut into bands, the
numbers of bands and rows following from the recall asked for at the threshold.
Documents that agree in a band are candidates; the shuffle carries band hashes
only. Candidates are verified on their full n-gram sets.

Documents of equal sets are one node throughout. Nodes joined by candidate
bands form candidate components; every two nodes of one component are verified
in blocks of bounded size, and a block returns link counts and a spanning
forest, never its pairs.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convprep.llm.common import block_pairs, components, forest, groups_of, row_key, words, written

N = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 200
PER_BLOCK = 256
CHUNK = 1 << 15

_M = np.uint64(0x9E3779B97F4A7C15)


def banding(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, hence the fewest false candidates, for which
    1 - (1 - threshold ** rows) ** bands >= recall within ``max_hashes``."""
    best = (1, 1)
    for rows in range(1, 33):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows > max_hashes and rows > 1:
            break
        best = (bands, rows)
    return best


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def ngrams(hashes: np.ndarray, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of a text given as word
    hashes. A text of fewer than n words is one n-gram: all its words."""
    w = np.asarray(hashes, dtype=np.int64).view(np.uint64)
    size = min(n, len(w))
    if not size:
        return np.zeros(0, np.uint64)
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = h * _M + w[k:len(w) - size + 1 + k]
    return np.unique(_mix(h))


def _seeds(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    draw = r.integers(0, 2**63, (2, count), dtype=np.int64).view(np.uint64)
    return draw[0], draw[1] | np.uint64(1)


def signatures(sets: list[np.ndarray], bands: int, rows: int, seed: int = 5) -> np.ndarray:
    """Band hashes (len(sets) x bands) of non-empty n-gram sets."""
    xor, mul = _seeds(bands * rows, seed)
    out = np.empty((len(sets), bands), np.uint64)
    lo = 0
    while lo < len(sets):
        hi, total = lo, 0
        while hi < len(sets) and (hi == lo or total + len(sets[hi]) <= CHUNK):
            total += len(sets[hi])
            hi += 1
        flat = np.concatenate(sets[lo:hi])
        starts = np.cumsum([0, *map(len, sets[lo:hi - 1])])
        for b in range(bands):
            h = np.full(hi - lo, b + 1, np.uint64)
            for k in range(b * rows, (b + 1) * rows):
                h = _mix(h * _M + np.minimum.reduceat((flat ^ xor[k]) * mul[k], starts))
            out[lo:hi, b] = h
        lo = hi
    return out


def _word_hashes(text: str) -> F.Column:
    return F.transform(words(F.col(text)), lambda w: F.xxhash64(w))


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(row_key(f"`{key}`", f"`{text}`").alias("rid"), F.col(f"`{key}`").alias("id"),
                       F.col(f"`{text}`").alias("text"))


def _sketches(keyed: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """rid, id, size of the n-gram set, its 128-bit identity (s1, s2), band hashes."""
    kind = keyed.schema["id"].dataType.simpleString()

    def sketch(batches):
        for pdf in batches:
            sets = [ngrams(h, n) for h in pdf["hashes"]]
            full = [s for s in sets if len(s)]
            sig = iter(signatures(full, bands, rows).view(np.int64).tolist() if full else [])
            with np.errstate(over="ignore"):
                yield pd.DataFrame({
                    "rid": pdf["rid"], "id": pdf["id"], "n": [len(s) for s in sets],
                    "s1": [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets],
                    "s2": [int(_mix(s ^ _M).sum(dtype=np.uint64).view(np.int64)) for s in sets],
                    "bands": [next(sig) if len(s) else None for s in sets]})

    return keyed.select("rid", "id", _word_hashes("text").alias("hashes")).mapInPandas(
        sketch, f"rid long, id {kind}, n int, s1 long, s2 long, bands array<long>")


def _verified(nodes: DataFrame, texts: DataFrame, n: int, threshold: float, per_block: int) -> DataFrame:
    """For ``nodes`` (node, component, copies) in candidate components: rows
    (node, links, label). ``links`` counts documents of other nodes at or above
    the threshold met in one pair of blocks, ``label`` the smallest node that
    the links there connect it to."""
    share = Fraction(str(threshold))
    num, den = share.numerator, share.denominator
    dealt = block_pairs(nodes, per_block).join(nodes.select("node", "copies"), "node")
    met = dealt.join(texts.select(F.col("rid").alias("node"), "text"), "node")
    met = met.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node")
    met = met.select("component", "i", "j", "node", "own", "copies", _word_hashes("text").alias("hashes"))

    def verify(batches):
        for g in groups_of(batches, ["component", "i", "j"]):
            g = g.drop_duplicates("node")  # rows alike have one key
            if len(g) < 2:
                continue
            first = (g["own"] == g["i"]).to_numpy()
            within = g["i"].iloc[0] == g["j"].iloc[0]
            a = np.flatnonzero(first)
            b = a if within else np.flatnonzero(~first)
            sets = [ngrams(h, n) for h in g["hashes"]]
            sizes = np.array([len(s) for s in sets])
            both = common_counts(sets, a, b)
            union = sizes[a][:, None] + sizes[b][None, :] - both
            linked = both * den >= union * num
            if within:
                np.fill_diagonal(linked, False)
            copies = g["copies"].to_numpy()
            links = np.zeros(len(g), np.int64)
            links[a] += linked @ copies[b]
            if not within:
                links[b] += linked.T @ copies[a]
            x, y = linked.nonzero()
            node = g["node"].to_numpy()
            label = node[forest(len(g), a[x], b[y])]
            hit = links > 0
            yield pd.DataFrame({"node": node[hit], "links": links[hit], "label": label[hit]})

    return met.mapInPandas(verify, "node long, links long, label long")


def common_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sets a[i] and b[j], as products of presence
    matrices over a few thousand elements at a time; elements in one set alone
    are left out."""
    _, element, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = count > 1
    place = np.cumsum(shared) - 1
    use = shared[element]
    row, element = row[use], place[element[use]]
    order = np.argsort(element, kind="stable")
    row, element = row[order], element[order]
    out = np.zeros((len(a), len(b)), np.int64)
    for lo in range(0, int(shared.sum()), columns):
        x, y = np.searchsorted(element, [lo, lo + columns])
        m = np.zeros((len(sets), columns), np.float32)
        m[row[x:y], element[x:y] - lo] = 1
        out += np.rint(m[a] @ m[b].T).astype(np.int64)
    return out


def jaccard_classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD,
    recall: float = RECALL, max_hashes: int = MAX_HASHES, per_block: int = PER_BLOCK,
) -> DataFrame:
    """One row per document: rid (key of the row), ``key``, class_id (smallest key
    of the documents connected by links, itself included), n_links (other
    documents whose n-gram sets have a Jaccard similarity of ``threshold`` or
    more) and best (rid of the document that stands for the class).

    A pair at the threshold is a candidate with probability ``recall``, a closer
    one with more; pairs that meet in a candidate component are verified
    whatever their bands. A text of fewer than n words is one n-gram; null texts
    and texts without words link with nothing. Repeated rows are documents of
    their own that link with each other. A null key counts as larger than any
    other. Other columns are not read, whatever their names; an empty table
    gives an empty result.
    """
    bands, rows = banding(threshold, recall, max_hashes)
    keyed = _keyed(docs, key, text)
    sketches = written(_sketches(keyed, n, bands, rows), "jaccard-sketches")
    nodes = written(sketches.where("n > 0").groupBy("s1", "s2", "n").agg(
        F.min("rid").alias("node"), F.count("*").alias("copies"), F.any_value("bands").alias("bands")),
        "jaccard-nodes")
    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    edges = banded.join(shared, "band").where("node <> least").select(
        F.col("node").alias("a"), F.col("least").alias("b"))
    candidates = components(edges, "jaccard-candidates").join(nodes.select("node", "copies"), "node")
    met = written(_verified(written(candidates, "jaccard-members"), keyed, n, threshold, per_block), "jaccard-links")
    linked = components(met.select(F.col("node").alias("a"), F.col("label").alias("b")), "jaccard-classes")
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    of_node = nodes.drop("bands").join(linked, "node", "left").join(links, "node", "left").select(
        "s1", "s2", "n", F.coalesce("component", "node").alias("component"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    placed = sketches.drop("bands").join(of_node, ["s1", "s2", "n"], "left")
    # A document without words stands alone.
    alone = F.col("component").isNull()
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("rid").alias("rid"))
    best = placed.where(~alone).groupBy("component").agg(F.min(rank).alias("best"))
    out = placed.join(best, "component", "left")
    return out.select(
        "rid", F.col("id").alias(key), F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("rid")).otherwise(F.col("best.rid")).alias("best"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class, that of the smallest key (of rows
    alike in key and text, one). Documents without words all stay, but of rows
    alike only one."""
    classes = jaccard_classes(docs, key, text, **options)
    stay = classes.where("rid = best").select("rid").distinct()
    rows = docs.select(row_key(f"`{key}`", f"`{text}`").alias("rid"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(stay, "rid").dropDuplicates(["rid"]).select("row.*")


def op5_minhash_join(docs: DataFrame) -> DataFrame:
    return jaccard_classes(docs).select("doc_id", "class_id", "n_links")
