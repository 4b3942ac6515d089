"""Substring dedup by super-k-mer partitioning.

A window is 50 consecutive words. Its minimiser is the least hash among the word
8-grams in it. Consecutive windows that share a minimiser form a super-k-mer and
travel together, as one packed string, to the minimiser's bucket; there all
windows are sorted, so equal ones are found exactly. Equal windows have equal
minimisers, hence meet.

What cannot matter does not travel: a minimiser seen in one document only is
dropped, super-k-mers of equal content are sent once, and a minimiser whose
super-k-mers are all alike needs no sorting. The bucket of a minimiser with more
than ``PER_BUCKET`` different contents is not gathered: its windows are counted by
an aggregate over 128-bit digests of their words, which splits over the tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convprep.llm.common import groups_of, row_key, words, written

WINDOW = 50
GRAM = 8
PER_BUCKET = 512

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def super_kmers(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """(minimisers, content hashes, first windows, numbers of windows) of the
    super-k-mers of a text given as word hashes; none if it has no window."""
    w = np.asarray(hashes, dtype=np.int64).view(np.uint64)
    n = len(w) - window + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 4
    power = np.full(len(w) + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    back = np.full(n, _INVERSE, np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * power[:-1], dtype=np.uint64)])
    grams = len(w) - gram + 1
    low = np.zeros(grams, np.uint64)
    for k in range(gram):
        low = low * np.uint64(_BASE) + w[k:k + grams]
    low, size, span = _mix(low), 1, window - gram + 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[:len(low) - (span - size)], low[span - size:])
    start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    count = np.diff(np.append(start, n))
    end = start + count + window - 1
    content = _mix((prefix[end] - prefix[start]) * back[start] + count.astype(np.uint64))
    return low[start].view(np.int64), content.view(np.int64), start, count


def _cut(docs_words: DataFrame, window: int, gram: int) -> DataFrame:
    kind = docs_words.schema["id"].dataType.simpleString()

    def cut(batches):
        for pdf in batches:
            parts = [super_kmers(h, window, gram) for h in pdf["hashes"]]
            sizes = [len(p[0]) for p in parts]
            cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*parts, strict=True)] or [[]] * 4
            yield pd.DataFrame({
                "mini": cols[0], "content": cols[1], "rid": np.repeat(pdf["rid"].to_numpy(), sizes),
                "id": np.repeat(pdf["id"].to_numpy(), sizes), "start": cols[2], "count": cols[3]})

    return docs_words.mapInPandas(cut, f"mini long, content long, rid long, id {kind}, start int, count int")


def _pack(texts: DataFrame, window: int) -> DataFrame:
    """Super-k-mers as packed strings. ``texts`` has text and ``parts``: structs of
    mini, content, id, start and count."""
    kind = texts.schema["parts"].dataType.elementType["id"].dataType.simpleString()
    names = ["mini", "content", "id", "packed"]

    def pack(batches):
        for pdf in batches:
            out = []
            for text, parts in zip(pdf["text"], pdf["parts"], strict=True):
                w = text.encode().split()
                out += [(p["mini"], p["content"], p["id"], b" ".join(w[p["start"]:p["start"] + p["count"] + window - 1]))
                        for p in parts]
            yield pd.DataFrame(out, columns=names)

    return texts.mapInPandas(pack, f"mini long, content long, id {kind}, packed binary")


def _digests(texts: DataFrame, window: int) -> DataFrame:
    """The windows of the super-k-mers in ``parts``, one row each: a 128-bit digest
    of the window's words, ``at``, its number in the super-k-mer, and ``salt``, by
    which the contents of a minimiser are dealt into ``buckets``."""
    kind = texts.schema["parts"].dataType.elementType["id"].dataType.simpleString()
    names = ["mini", "content", "id", "at", "salt", "digest"]

    def cut(batches):
        for pdf in batches:
            out = []
            for text, parts in zip(pdf["text"], pdf["parts"], strict=True):
                w = text.encode().split()
                for p in parts:
                    run = w[p["start"]:p["start"] + p["count"] + window - 1]
                    ends = np.cumsum([len(x) + 1 for x in run])
                    starts = np.concatenate([[0], ends[:-1]]).tolist()
                    ends = (ends - 1).tolist()
                    packed = memoryview(b" ".join(run))
                    salt = p["content"] % p["buckets"]
                    out += [(p["mini"], p["content"], p["id"], i, salt, hashlib.blake2b(
                        packed[starts[i]:ends[i + window - 1]], digest_size=16).digest()) for i in range(p["count"])]
            yield pd.DataFrame(out, columns=names)

    return texts.mapInPandas(cut, f"mini long, content long, id {kind}, at int, salt int, digest binary")


def _least_of_windows(texts: DataFrame, window: int) -> DataFrame:
    """What :func:`_sort_windows` finds, for minimisers of many contents.

    The least id of each window comes from an aggregate that starts before the
    shuffle, so a window that millions of documents share is one row a task. It
    goes back by window and salt, to the salts the window occurs in, so that the
    rows of such a window meet it in many tasks. Neighbouring windows of a content
    that are found come back as one run.
    """
    each = written(_digests(texts, window), "windows")
    salted = each.groupBy("mini", "digest", "salt").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    least = salted.groupBy("mini", "digest").agg(
        F.min("lo").alias("least"), F.max("hi").alias("hi"), F.collect_list("salt").alias("salts"))
    back = least.where("least < hi").select("mini", "digest", "least", F.explode("salts").alias("salt"))
    met = each.join(back, ["mini", "digest", "salt"]).where("id > least").select("mini", "content", "at")
    number = F.row_number().over(Window.partitionBy("mini", "content").orderBy("at"))
    runs = met.withColumn("run", F.col("at") - number).groupBy("mini", "content", "run").agg(
        F.min("at").alias("at"), F.count("*").cast("int").alias("n"))
    return runs.select("mini", "content", "at", "n")


def _equal_windows(flat: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Numbers of the windows ``flat[at:at + window]``, equal for equal windows only.

    Windows are sorted by a hash; those of one hash are compared word by word with
    the first of them, and sorted as they are should any differ.
    """
    power = np.full(len(flat) + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(
        _mix(flat.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
    # Shifted to the last power instead of back to the first: one table serves both.
    key = _mix((prefix[at + window] - prefix[at]) * power[len(flat) - at])
    _, first, number, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    again = np.flatnonzero((counts[number] > 1) & (first[number] != np.arange(len(at))))
    steps = np.arange(window)
    for lo in range(0, len(again), 10_000):
        some = again[lo:lo + 10_000]
        if (flat[at[some][:, None] + steps] != flat[at[first[number[some]]][:, None] + steps]).any():
            rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, window)[at])
            return np.unique(rows.view(np.dtype((np.void, rows.itemsize * window))).ravel(), return_inverse=True)[1]
    return number


def _sort_windows(packed: DataFrame, window: int) -> DataFrame:
    """Sort the windows of each minimiser; rows (mini, content, at, n): runs of
    windows of a content that also start in a document of smaller id."""
    def find(batches):
        for g in groups_of(batches, ["mini"]):
            split = pc.split_pattern(pa.array(g["packed"], pa.large_binary()), b" ")
            flat = split.flatten().dictionary_encode().indices.to_numpy()
            counts = split.value_lengths().to_numpy() - (window - 1)
            ends = np.cumsum(counts + window - 1)
            owner = np.repeat(np.arange(len(g)), counts)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            number = _equal_windows(flat, np.repeat(ends - counts - window + 1, counts) + place, window)
            ids = g["id"].to_numpy()
            least = np.full(number.max() + 1, ids.max())
            np.minimum.at(least, number, ids[owner])
            hit = np.flatnonzero(least[number] < ids[owner])
            if not len(hit):
                continue
            owner, place = owner[hit], place[hit]
            new = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(place) != 1)]))
            yield pd.DataFrame({
                "mini": g["mini"].iloc[0], "content": g["content"].to_numpy()[owner[new]], "at": place[new],
                "n": np.diff(np.append(new, len(hit)))})

    met = packed.repartition("mini").sortWithinPartitions("mini", "content")
    return met.mapInPandas(find, "mini long, content long, at int, n int")


def repeated_spans(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM,
    per_bucket: int = PER_BUCKET,
) -> DataFrame:
    """Documents with words to remove: rid, text and ``spans``, the word ranges
    (lo, hi) covered by windows that also start in a document of smaller key.

    Windows are judged on the input. Documents with a null key neither lose
    words nor make others lose any; rows of one key do not count as smaller than
    each other. Other columns are not read, whatever their names. Texts of fewer
    words than a window have none; an empty table gives an empty result.
    """
    rid = row_key(f"`{key}`", f"`{text}`").alias("rid")
    known = docs.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    hashed = known.select(rid, F.col(f"`{key}`").alias("id"),
                          F.transform(words(F.col(f"`{text}`")), lambda w: F.xxhash64(w)).alias("hashes"))
    pieces = written(_cut(hashed, window, gram), "super-kmers")
    shared = pieces.groupBy("mini").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("mini")
    alive = written(pieces.join(shared, "mini"), "shared-super-kmers")
    contents = written(alive.groupBy("mini", "content").agg(
        F.min(F.struct("id", "rid", "start", "count")).alias("first")), "contents")
    many = contents.groupBy("mini").agg(F.count("*").alias("n")).where("n > 1")
    sent = contents.join(many, "mini").select(
        F.col("first.rid").alias("rid"), F.struct(
            "mini", "content", "first.id", "first.start", "first.count",
            F.ceil(F.col("n") / per_bucket).cast("int").alias("buckets")).alias("part"))
    # Texts that hold a shared minimiser, with the super-k-mers they send.
    parts = alive.select("rid", F.lit(None).cast(sent.schema["part"].dataType).alias("part")).distinct().union(sent)
    parts = parts.groupBy("rid").agg(F.collect_list("part").alias("parts"))
    texts = written(known.select(rid, F.col(f"`{text}`").alias("text")).join(parts, "rid"), "shared-texts")
    few, lots = (texts.select("text", F.filter("parts", test).alias("parts")).where(F.size("parts") > 0)
                 for test in (lambda p: p["buckets"] == 1, lambda p: p["buckets"] > 1))
    found = _sort_windows(_pack(few, window), window).union(_least_of_windows(lots, window))
    found = found.groupBy("mini", "content").agg(F.collect_set(F.struct("at", "n")).alias("runs"))
    # A later document of a content loses all its windows, the first one those found.
    judged = alive.join(contents.select("mini", "content", F.col("first.id").alias("first")), ["mini", "content"])
    ends = F.col("start") + F.col("count") + (window - 1)
    later = judged.where("id > first").select(
        "rid", F.array(F.struct(F.col("start").alias("lo"), ends.alias("hi"))).alias("spans"))
    first = judged.where("id = first").join(found, ["mini", "content"]).select("rid", F.transform(
        "runs", lambda r: F.struct((F.col("start") + r["at"]).alias("lo"),
                                   (F.col("start") + r["at"] + r["n"] + (window - 1)).alias("hi"))).alias("spans"))
    spans = later.union(first).groupBy("rid").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    return texts.select("rid", "text").dropDuplicates(["rid"]).join(spans, "rid")


def kept_words(text: str, spans) -> list[bytes]:
    """Words of a text outside ``spans``, (lo, hi) ranges of word numbers."""
    w = text.encode().split()
    out, at = [], 0
    for lo, hi in sorted(spans):
        out += w[at:lo] if lo > at else []
        at = max(at, hi)
    return out + w[at:]


def op3_super_kmers(docs: DataFrame) -> DataFrame:
    """Digest of the contract. Texts that keep all words are digested in the scan;
    only the others are fetched."""
    def digest(batches):
        for pdf in batches:
            kept = [kept_words(t, [(s["lo"], s["hi"]) for s in x])
                    for t, x in zip(pdf["text"], pdf["spans"], strict=True)]
            yield pd.DataFrame({"rid": pdf["rid"], "n_kept": [len(k) for k in kept],
                                "kept": [hashlib.sha256(b" ".join(k)).hexdigest() for k in kept]})

    cut = repeated_spans(docs).mapInPandas(digest, "rid long, n_kept long, kept string")
    w = words(F.col("text"))
    whole = docs.select(row_key("doc_id", "text").alias("rid"), "doc_id", w.alias("w")).select(
        "rid", "doc_id", F.size("w").cast("long").alias("n_words"),
        F.sha2(F.array_join("w", " "), 256).alias("whole"))
    out = whole.join(cut, "rid", "left")
    return out.select("doc_id", "n_words", F.coalesce(F.col("n_words") - F.col("n_kept"), F.lit(0)).alias("n_removed"),
                      F.coalesce("kept", "whole").alias("kept_sha256"))


ORACLE_OP3 = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
k AS (SELECT row_number() OVER () AS r, doc_id, w FROM w),
win AS (
  SELECT r, doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS s
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM k WHERE len(w) >= 50)),
hit AS (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY s) AS lo FROM win) WHERE lo < doc_id),
pos AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM hit),
gone AS (SELECT r, list(p) AS ps, count(*) AS n FROM pos GROUP BY r),
tok AS (SELECT k.r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM k JOIN gone USING (r)),
kept AS (SELECT tok.r, string_agg(x, ' ' ORDER BY tok.p) AS t
         FROM tok LEFT JOIN pos ON tok.r = pos.r AND tok.p = pos.p WHERE pos.p IS NULL GROUP BY tok.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN gone.n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept.t, '') END) AS kept_sha256
FROM k LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""
