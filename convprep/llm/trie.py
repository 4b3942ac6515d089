"""Prefix trie of conversations by double-array tries (Aoe, 1989).

Conversations become strings of turns, a turn being 16 bytes of the sha256 of its
role and text and 4 bytes of its length. The strings are sorted over the cluster
and cut into shards, each a run of neighbours in that order. In a shard turns get
dense ids, and the shard's trie is packed into two arrays: from state s the turn
id c leads to BASE[s] + c, and that place is a child of s if CHECK there is s.
Walking all strings through the arrays gives the nodes and their counts.

Strings that start alike are neighbours, so a node lies in one shard, unless it
is on the path of the shard's first or last string. Such border nodes (a path or
two a shard) go out with what the shard holds below them, and are merged over all
shards.

Strings are cut into segments of ``SEGMENT`` turns. A segment of a longer
conversation is a string below the node where the segment before it ends; that node
is a border node in both, and its sums run over all segments below it. Thus no
conversation is ever in one place, and equal conversations are counted in as many
shards as they fill.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convprep.llm.common import written

SEGMENT = 64
SHARD_TURNS = 100_000
SALTS = 16
_TURN = 20
_ROOT = bytes(16)
_NO_ENDS = hashlib.sha256(b"").hexdigest()


# ---- the arrays ------------------------------------------------------------

class DoubleArray:
    """A trie over strings of dense ids; the strings are sorted so that those that
    start alike are neighbours. State 0 is the root."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        self.base, self.check = np.zeros(64, np.int64), np.full(64, -1, np.int64)
        self.check[0] = 0
        self._low = 1
        begin = np.cumsum(sizes) - sizes
        state = np.zeros(len(sizes), np.int64)
        for depth in range(int(sizes.max(initial=0))):
            live = np.flatnonzero(sizes > depth)
            code, parent = codes[begin[live] + depth], state[live]
            new = np.ones(len(live), bool)
            new[1:] = (code[1:] != code[:-1]) | (parent[1:] != parent[:-1])
            state[live] = self._children(parent[new], code[new])[np.cumsum(new) - 1]

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _children(self, parent: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Place the children of one level; children of one parent are neighbours."""
        cuts = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1], [True]]))
        lo, size = cuts[:-1], np.diff(cuts)
        for a, n in zip(lo[size > 1], size[size > 1], strict=True):
            self._place(parent[a], np.sort(code[a:a + n]))
        # An only child fits any free place: these fill the gaps.
        only = lo[size == 1]
        free = np.flatnonzero(self.check < 0)
        if len(free) < len(only):
            self._grow(len(self.check) + len(only) - len(free))
            free = np.flatnonzero(self.check < 0)
        free = free[:len(only)]
        self.base[parent[only]] = free - code[only]
        self.check[free] = parent[only]
        return self.base[parent] + code

    def _place(self, parent: int, codes: np.ndarray) -> None:
        """First place from the lowest free one on where all children fit, within reach; else the end."""
        span = int(codes[-1] - codes[0]) + 1
        reach = 1024
        self._grow(self._low + reach + span)
        while self.check[self._low] >= 0:
            self._low += 1
            self._grow(self._low + reach + span)
        steps = codes - codes[0]
        starts = self._low + np.flatnonzero(self.check[self._low:self._low + reach] < 0)
        fits = np.ones(len(starts), bool)
        for step in steps:
            at = np.flatnonzero(fits)
            if not len(at):
                break
            fits[at] = self.check[starts[at] + step] < 0
        start = int(starts[fits][0]) if fits.any() else int(np.flatnonzero(self.check >= 0)[-1]) + 1
        self._grow(start + span)
        self.base[parent] = start - codes[0]
        self.check[start + steps] = parent

    def walk(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The state after each turn of each string."""
        out = np.full(len(codes), -1, np.int64)
        begin = np.cumsum(sizes) - sizes
        state = np.zeros(len(sizes), np.int64)
        for depth in range(int(sizes.max(initial=0))):
            live = np.flatnonzero(sizes > depth)
            at = begin[live] + depth
            to = self.base[state[live]] + codes[at]
            if (self.check[to] != state[live]).any():
                raise ValueError("string is not in the trie")
            state[live] = out[at] = to
        return out


def _dense(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Dense ids of equal keys, numbered as they first occur in ``order``."""
    _, first, inverse = np.unique(keys[order], return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    out = np.empty(len(keys), np.int64)
    out[order] = rank[inverse]
    return out


def _segment_key(root: bytes, segment: bytes) -> bytes:
    """Key of the node where a full segment below ``root`` ends."""
    return hashlib.blake2b(root + hashlib.sha256(segment).digest()[:16], digest_size=16).digest()


_NODES = ("border boolean, key binary, root binary, above array<binary>, conv_id long, depth long, parent_conv_id long, "
          "parent binary, n_convs long, n_children long, n_leaves long, saved_tokens long, length long, ends string, "
          "first_end long, end_ids binary")


def shard_nodes(rows: pd.DataFrame, segment: int) -> pd.DataFrame:
    """Nodes of one shard: complete ones, and border ones with the sums below them.
    ``rows`` (band, root, string, last, conv_id) are sorted by all of them but ``last``."""
    strings = rows["string"].tolist()
    n_turns = np.array([len(s) // _TURN for s in strings])
    sizes = n_turns + 1  # the first symbol stands for the root
    begin = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(strings), np.uint8).reshape(-1, _TURN)
    turn_place = np.ones(sizes.sum(), bool)
    turn_place[begin] = False
    place = np.arange(sizes.sum()) - np.repeat(begin, sizes)
    turns = np.ascontiguousarray(raw).view(np.dtype((np.void, _TURN))).ravel()
    roots = rows["root"].tolist()
    root_id = np.cumsum([True, *[a != b for a, b in zip(roots[1:], roots, strict=False)]]) - 1
    codes = np.empty(sizes.sum(), np.int64)
    codes[begin] = root_id
    level_order = np.argsort(place[turn_place], kind="stable")
    codes[turn_place] = root_id[-1] + 1 + _dense(turns, level_order) if len(turns) else 0

    trie = DoubleArray(codes, sizes)
    state = trie.walk(codes, sizes)
    top = len(trie.check)
    owner = np.repeat(np.arange(len(rows)), sizes)
    conv = rows["conv_id"].to_numpy(np.int64)
    band = rows["band"].to_numpy(np.int64)
    last = rows["last"].to_numpy(bool)
    end_state = state[begin + sizes - 1]
    n = np.bincount(state, minlength=top)
    least = np.full(top, np.iinfo(np.int64).max)
    np.minimum.at(least, state, conv[owner])
    depth, some = np.zeros(top, np.int64), np.zeros(top, np.int64)
    depth[state], some[state] = place, np.arange(len(state))  # ``some``: a place of that state
    length = np.zeros(top, np.int64)
    if len(turns):
        length[state[turn_place]] = raw[:, 16:].astype(np.int64) @ (256 ** np.arange(3, -1, -1))
    # Border: the first and the last string, all that go on, and the roots.
    border = np.zeros(top, bool)
    whole = np.concatenate([[0, len(rows) - 1], np.flatnonzero(~last)])
    for r in np.unique(whole):
        border[state[begin[r]:begin[r] + sizes[r]]] = True
    border[state[begin]] = True

    used = np.unique(state)
    kids, leaves, saved = (np.zeros(top, np.int64) for _ in range(3))
    own = (n - 1) * length
    for d in range(int(depth[used].max()), 0, -1):
        level = used[(depth[used] == d) & ~border[used]]
        leaves[level] += kids[level] == 0
        saved[level] += own[level]
        up = trie.check[level]
        np.add.at(kids, up, 1)
        np.add.at(leaves, up, leaves[level])
        np.add.at(saved, up, saved[level])

    # Strings that end alike are neighbours, their conversations ascending.
    ends = {}
    stops = np.flatnonzero(last)
    for part in np.split(stops, np.flatnonzero(np.diff(end_state[stops])) + 1) if len(stops) else []:
        ends[int(end_state[part[0]])] = (int(conv[part[0]]), ",".join(map(str, conv[part].tolist())).encode())

    keys: dict[int, bytes] = {}
    above: dict[int, list[bytes]] = {}
    for s in used[border[used]][np.argsort(depth[used[border[used]]], kind="stable")].tolist():
        r = int(owner[some[s]])
        if depth[s] == 0:
            keys[s], above[s] = roots[r], []
            continue
        p = int(trie.check[s])
        above[s] = [*above[p], keys[p]]
        d = int(depth[s])
        keys[s] = (_segment_key(roots[r], strings[r]) if d == segment else
                   hashlib.blake2b(keys[p] + strings[r][(d - 1) * _TURN:d * _TURN], digest_size=16).digest())

    out = []
    for s in used.tolist():
        r, p = int(owner[some[s]]), int(trie.check[s])
        at = int(band[r]) * segment + int(depth[s])
        if not border[s]:
            out.append((False, None, None, None, int(least[s]), at, None if border[p] else int(least[p]),
                        keys[p] if border[p] else None, int(n[s]), int(kids[s]), int(leaves[s]), int(saved[s]), None,
                        hashlib.sha256(ends[s][1]).hexdigest() if s in ends else _NO_ENDS, None, None))
            continue
        # A root below another segment has been counted where that one ends.
        again = depth[s] == 0 and band[r] > 0
        first, text = ends.get(s, (None, None))
        out.append((True, keys[s], roots[r], above[s], None if again else int(least[s]), None if again else at, None,
                    above[s][-1] if above[s] else None, 0 if again else int(n[s]), int(kids[s]), int(leaves[s]),
                    int(saved[s]), int(length[s]), None, first, text))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _NODES.split(", ")], dtype=object)


# ---- on tables -------------------------------------------------------------

def numbered_turns(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, i (place in the conversation, from 0) and the turn's 20 bytes. Turns are
    sorted over the cluster, so a conversation may span tasks; a task numbers its
    rows, and the few numbers of conversations that go over its edge are carried on
    (two a task). Null keys are no conversation."""
    said, who = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.coalesce(F.col(f"`{role}`"), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said), 256), 1, 32)
    code = F.unhex(F.concat(digest, F.lpad(F.hex(F.char_length(said)), 8, "0")))
    narrow = turns.where(F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), code.alias("code"))
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("code")]

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        previous, carried, first = None, 0, None
        for pdf in batches:
            ids = pdf["conv_id"].to_numpy(np.int64)
            if not len(ids):
                continue
            first = ids[0] if first is None else first
            change = np.concatenate([[True], ids[1:] != ids[:-1]])
            starts = np.flatnonzero(change)
            i = np.arange(len(ids)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(ids)]])))
            if ids[0] == previous:
                i[:(starts[1] if len(starts) > 1 else len(ids))] += carried
            previous, carried = ids[-1], i[-1] + 1
            yield pd.DataFrame({"conv_id": ids, "code": pdf["code"], "i": i, "task": task, "head": ids == first})

    local = written(narrow.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "code").mapInPandas(
        number, "conv_id long, code binary, i long, task int, head boolean"), "trie-turns")
    # How many turns of its first conversation lie before each task: from the last row of each task.
    tails = local.groupBy("task").agg(F.max(F.struct("conv_id", "i", "head")).alias("t"), F.min("conv_id").alias("first"))
    carry, before, offsets = None, 0, []
    for r in tails.orderBy("task").collect():  # a row per task
        offset = before if r["first"] == carry else 0
        offsets.append((r["task"], offset))
        before = r["t"]["i"] + 1 + (offset if r["t"]["head"] else 0)
        carry = r["t"]["conv_id"]
    moved = [x for x in offsets if x[1]]
    if not moved:
        return local.select("conv_id", "i", "code")
    few = turns.sparkSession.createDataFrame(moved, "task int, moved long")
    return local.join(F.broadcast(few), "task", "left").select(
        "conv_id", (F.col("i") + F.when(F.col("head"), F.coalesce("moved", F.lit(0))).otherwise(0)).alias("i"), "code")


def rebuilt_turns(numbered: DataFrame, family: int, shared: Column, most: int) -> DataFrame:
    """Every conversation c with the first ``shared`` (at most ``most``) turns of conversation
    c - c % family in place of its own: conv_id, place (from 0; -1 marks a conversation that may have no turns), code."""
    base = F.col("conv_id") - F.col("conv_id") % family
    heads = numbered.where((F.col("conv_id") % family == 0) & (F.col("i") < most)).groupBy(
        F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("i", "code"))).alias("heads"))
    rows = numbered.withColumn("base", base).join(heads, "base", "left").withColumn("h", shared)
    rows = rows.withColumn("heads", F.coalesce(F.slice("heads", 1, F.col("h")), F.expr("cast(array() as array<struct<i:bigint,code:binary>>)")))
    own = F.struct((F.size("heads") + F.col("i") - F.col("h")).alias("place"), "code")
    lent = F.transform("heads", lambda x: F.struct(x["i"].alias("place"), x["code"].alias("code")))
    nothing = F.struct(F.lit(-1).cast("long").alias("place"), F.lit(b"").alias("code"))
    out = F.concat(F.when(F.col("i") >= F.col("h"), F.array(own)).otherwise(F.array().cast("array<struct<place:bigint,code:binary>>")),
                   F.when(F.col("i") == 0, F.concat(F.array(nothing), lent)).otherwise(F.array().cast("array<struct<place:bigint,code:binary>>")))
    return rows.select("conv_id", F.explode(out).alias("x")).select("conv_id", "x.place", "x.code")


def _segments(rows: DataFrame, segment: int) -> tuple[DataFrame, DataFrame | None]:
    """Strings (band, root, string, last, conv_id), and of the conversations of more
    than one segment the keys (conv_id, band, root)."""
    packed = rows.groupBy("conv_id", F.floor(F.greatest("place", F.lit(0)) / segment).cast("int").alias("band")).agg(
        F.array_sort(F.collect_list(F.struct("place", "code"))).alias("t"))
    string = F.aggregate("t", F.lit(b""), lambda s, x: F.concat(s, x["code"]))
    packed = written(packed.select("conv_id", "band", string.alias("string")), "trie-strings")
    full = F.octet_length("string") == segment * _TURN
    short = packed.where(~full & (F.col("band") == 0)).select(
        "band", F.lit(_ROOT).alias("root"), "string", F.lit(True).alias("last"), "conv_id")
    rest = packed.where(full | (F.col("band") > 0))
    if rest.isEmpty():
        return short, None

    @F.pandas_udf("array<binary>")
    def chain(digests: pd.Series) -> pd.Series:
        out = []
        for row in digests:
            key, keys = _ROOT, []
            for d in row:
                keys.append(key)
                key = hashlib.blake2b(key + d, digest_size=16).digest()
            out.append(keys)
        return pd.Series(out, dtype=object)

    digest = F.unhex(F.substring(F.sha2("string", 256), 1, 32))
    keys = rest.select("conv_id", "band", digest.alias("d")).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("band", "d"))).alias("ds"))
    keys = keys.select("conv_id", F.size("ds").alias("n"), F.posexplode(chain(F.transform("ds", lambda x: x["d"]))).alias("band", "root"))
    keys = written(keys, "trie-keys")
    more = rest.join(keys, ["conv_id", "band"]).select(
        "band", "root", "string", (F.col("band") == F.col("n") - 1).alias("last"), "conv_id")
    return short.union(more), keys.where("band > 0").select("conv_id", "band", "root")


def _hash_ends(pieces: DataFrame) -> DataFrame:
    """sha256 of the ids that end at a border node: its shards' pieces, ascending, are
    hashed as they stream by."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, h = None, None
        for pdf in batches:
            done = []
            for k, text in zip(pdf["key"], pdf["end_ids"], strict=True):
                if k == key:
                    h.update(b",")
                else:
                    if key is not None:
                        done.append((key, h.hexdigest()))
                    key, h = k, hashlib.sha256()
                h.update(text)
            yield pd.DataFrame(done, columns=["key", "ends"])
        if key is not None:
            yield pd.DataFrame([(key, h.hexdigest())], columns=["key", "ends"])

    return pieces.select("key", "first_end", "end_ids").repartition("key").sortWithinPartitions("key", "first_end").select(
        "key", "end_ids").mapInPandas(run, "key binary, ends string")


def _merge_borders(border: DataFrame, long: DataFrame | None) -> DataFrame:
    """One row per border node, with the sums over its whole subtree."""
    merged = border.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.max("parent").alias("parent"),
        F.max_by("root", F.size("above")).alias("root"), F.max_by("above", F.size("above")).alias("above"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("inner"), F.sum("n_leaves").alias("leaves"),
        F.sum("saved_tokens").alias("saved"), F.max("length").alias("length"))
    outer = merged.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("outer"))
    ends = _hash_ends(border.where("end_ids is not null"))
    merged = merged.join(outer, "key", "left").join(ends, "key", "left")
    merged = merged.withColumn("n_children", F.col("inner") + F.coalesce("outer", F.lit(0)))
    merged = written(merged.select(
        "key", "root", "above", "conv_id", "depth", "parent", "n_convs", "n_children", F.coalesce("ends", F.lit(_NO_ENDS)).alias("ends"),
        (F.col("leaves") + (F.col("n_children") == 0).cast("long")).alias("leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("length")).alias("saved")), "trie-border")
    values = merged.select("key", "above", "leaves", "saved")
    if long is not None:
        # Sums over the segments below each: a segment counts for the least conversation that has it.
        tops = long.groupBy("root").agg(F.min("conv_id").alias("least"))
        inside = merged.join(tops.select(F.col("root").alias("key")), "key", "left_anti").select("root", "leaves", "saved").union(
            merged.select(F.col("key").alias("root"), "leaves", "saved")).groupBy("root").agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).join(tops, "root")
        mine = F.col("least") == F.col("conv_id")
        from pyspark.sql import Window

        below = Window.partitionBy("conv_id").orderBy(F.desc("band"))
        sums = long.join(inside, "root").select("root", *[
            F.sum(F.when(mine, F.col(c)).otherwise(0)).over(below).alias(c) for c in ("leaves", "saved")])
        sums = written(sums.groupBy("root").agg(F.sum("leaves").alias("all_leaves"), F.sum("saved").alias("all_saved")), "trie-segments")
        values = values.join(sums.withColumnRenamed("root", "key"), "key", "left").select(
            "key", "above", F.coalesce("all_leaves", "leaves").alias("leaves"), F.coalesce("all_saved", "saved").alias("saved"))
    up = values.select(F.explode(F.concat("above", F.array("key"))).alias("key"), "leaves", "saved").groupBy("key").agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    if long is not None:
        up = up.join(sums.withColumnRenamed("root", "key"), "key", "left").select(
            "key", F.coalesce("all_leaves", "n_leaves").alias("n_leaves"), F.coalesce("all_saved", "saved_tokens").alias("saved_tokens"))
    names = merged.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return merged.drop("leaves", "saved").join(up, "key").join(names, "parent", "left")


_OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]


def prefix_trie(strings: DataFrame, long: DataFrame | None, segment: int = SEGMENT, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the trie of ``strings`` (see ``_segments``)."""
    order = ["band", "root", "string", "conv_id"]

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            step = max(1, shard_turns // (segment + 1))
            for lo in range(0, len(pdf), step):
                part = pdf.iloc[lo:lo + step]
                held.append(part)
                size += len(part) + int(part["string"].map(len).sum()) // _TURN
                if size >= shard_turns:
                    yield shard_nodes(pd.concat(held, ignore_index=True), segment)
                    held, size = [], 0
        if size:
            yield shard_nodes(pd.concat(held, ignore_index=True), segment)

    nodes = strings.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(shards, _NODES)
    nodes = written(nodes, "trie-nodes")
    border = _merge_borders(nodes.where("border"), long)
    border = written(border.select("key", *_OUT), "trie-merged")
    inner = nodes.where("not border")
    # A border node may have most nodes as children, so the join is salted.
    salt = F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)).cast("int")
    names = border.select(F.col("key").alias("parent"), F.col("conv_id").alias("above_id"),
                          F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = inner.where("parent is not null").withColumn("salt", salt).drop("parent_conv_id").join(
        names, ["parent", "salt"]).withColumnRenamed("above_id", "parent_conv_id")
    return inner.where("parent is null").select(*_OUT).union(joined.select(*_OUT)).union(border.select(*_OUT))


def conversation_trie(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    family: int = 1, shared: Column | None = None, most: int = 0,
    segment: int = SEGMENT, shard_turns: int = SHARD_TURNS,
) -> DataFrame:
    """One row per node of the prefix trie of the conversations: conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends (sha256 of the ids of conversations that end there, ascending, joined by commas).

    Turns are ordered by ``turn``, null first, ties by the sha256 of role and text;
    null roles and texts are empty. Rows without a key are no conversation. With
    ``shared`` (an expression over conv_id of at most ``most``), each conversation's first turns
    are replaced by those of conversation c - c % ``family``. An empty table
    has no node. Other columns are not read.
    """
    numbered = numbered_turns(turns, key, turn, role, text)
    if shared is None:
        shared = F.lit(0)
    strings, long = _segments(rebuilt_turns(numbered, family, shared, most), segment)
    return prefix_trie(strings, long, segment, shard_turns)


def op13_double_array(conversations: DataFrame) -> DataFrame:
    """Digest of the contract."""
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    out = conversation_trie(conversations, family=100, shared=shared, most=5)
    return out.withColumnRenamed("ends", "ends_sha256")


ORACLE_OP13 = r"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS c, length(coalesce(text, '')) AS len,
         sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS code,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
-- unsigned crc32 of the decimal id, bit by bit
h AS (
  SELECT c, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
      lambda a, b: list_reduce([xor(a, b), 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT],
        lambda x, y: CASE WHEN x & 1::UBIGINT = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT) % 6 AS BIGINT) AS h
  FROM (SELECT DISTINCT c FROM t) AS d),
r AS (
  SELECT h.c, t.i AS place, t.code, t.len FROM h JOIN t ON t.c = h.c - h.c % 100 AND t.i < h.h
  UNION ALL
  SELECT t.c, 100 + t.i, t.code, t.len FROM t JOIN h ON t.c = h.c AND t.i >= h.h),
p AS (
  SELECT c, len, list(code) OVER (PARTITION BY c ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path FROM r
  UNION ALL
  SELECT c, 0, CAST([] AS VARCHAR[]) FROM h),
n AS (SELECT path, len(path) AS depth, min(c) AS conv_id, count(*) AS n_convs, max(len) AS len FROM p GROUP BY path),
k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
w AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON n.path = k.path),
s AS (
  SELECT path[1:d] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * len) AS saved_tokens
  FROM (SELECT w.*, unnest(range(0, depth + 1)) AS d FROM w) AS x GROUP BY ALL),
e AS (
  SELECT path, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids
  FROM (SELECT c, arg_max(path, len(path)) AS path FROM p GROUP BY c) AS y GROUP BY path)
SELECT w.conv_id, w.depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM w JOIN s ON w.path = s.path LEFT JOIN e ON w.path = e.path
LEFT JOIN n AS u ON w.depth > 0 AND u.path = w.path[1:w.depth - 1]
"""
