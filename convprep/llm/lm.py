"""Cross-entropy difference of matched n-gram language models (Moore & Lewis, 2010).

A target and a background bigram model are counted from the same corpus with one
vocabulary and one smoothing, so they differ in their counts alone. A document's
score is its mean loss per token under the target model less that under the
background model: the lower, the more it is like the target.

A document's own tokens are left out of the model of its side when it is scored,
so no document is judged by a model that has seen it.

The vocabulary is every word that occurs ``min_count`` times, however many there
are: words travel as 64-bit hashes, and no table of all words is in one place.

Documents are cut into blocks where they lie; a block is one row, its words coded by
its own dictionary. Words and then bigrams are counted in the block, and their sorted
keys go out packed, some bytes a key, to the part of the key space they belong to.
What comes back to a block are the corpus counts of the keys that another block
has too: of all others its own counts are those of the corpus. No table of all words
or bigrams is ever in one place, and no token is shuffled on its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convprep.llm.common import written

MIN_COUNT = 2
BLOCK_TOKENS = 2_000_000
PART_TOKENS = 1_000_000  # tokens of the corpus for each part of the key space
PSEUDO = 8.0
_AT_ONCE = 250_000  # tokens scored at a time
_REMEMBERED = 100_000  # words whose hashes a task keeps

# In place of a word's hash: the place before a text; any word; a word outside the vocabulary.
_START, _ANY, _RARE = np.array([0x2545F4914F6CDD1D, 0x5851F42D4C957F2D, 0x14057B7EF767814F], np.int64)
_MARKS = -1  # in place of a part: the target documents of a block
_BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    return text.lower().encode().split() if text else []


def _hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little", signed=True)


def _key(previous: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit key of a bigram, of hashes that are uniform."""
    return (previous.view(np.uint64) * _BASE + word.view(np.uint64)).view(np.int64)


def _loss(c2, c1, cw, n, words: int, pseudo: float) -> np.ndarray:
    """Minus log of the smoothed bigram probability: ``pseudo`` tokens of the unigram
    model, itself with one more of each word, are added to each context."""
    unigram = (cw + 1.0) / (n + words + 1.0)
    return -np.log((c2 + pseudo * unigram) / (c1 + pseudo))


# ---- packed keys -----------------------------------------------------------

def _planes(values: np.ndarray) -> bytes:
    """Bytes of the numbers, all first bytes first: sorted keys and small counts pack well."""
    return np.ascontiguousarray(values.astype(values.dtype.newbyteorder(">")).view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T)
    return raw.view(np.dtype(kind).newbyteorder(">")).ravel().astype(kind)


def _counts(values: np.ndarray) -> bytes:
    """Counts are small and random, which takes an entropy coder."""
    return zstandard.compress(_planes(values), 1) if len(values) else b""


def _from_counts(data: bytes, kind: str) -> np.ndarray:
    return _from_planes(zstandard.decompress(data), kind) if data else np.zeros(0, kind)


_SENT = "part int, block long, keys binary, t binary, b binary"
_BACK = "block long, part int, n long, at binary, t binary, b binary"


def _cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each part of the key space starts in sorted keys, and their end."""
    starts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)
    return np.append(np.searchsorted(keys, starts), len(keys))


def _send(block: int, keys: np.ndarray, t: np.ndarray, b: np.ndarray, bits: int) -> pd.DataFrame:
    """Rows of the sorted distinct ``keys`` of a block, one for each part that has some."""
    cuts = _cuts(keys, bits)
    parts = np.flatnonzero(np.diff(cuts))
    spans = [slice(cuts[p], cuts[p + 1]) for p in parts]
    return pd.DataFrame({"part": parts, "block": block, "keys": [_planes(keys[s]) for s in spans],
                         "t": [_counts(t[s].astype(np.uint32)) for s in spans],
                         "b": [_counts(b[s].astype(np.uint32)) for s in spans]})


def _places(start: int, n: int, bits: bytes) -> np.ndarray:
    """Places, from ``start`` on, whose bit is set."""
    return start + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=n))


def _merge(lowest: int, flags: bool):
    """Per part: to each block that has them the places (a bit for each key it
    sent) and corpus counts of keys that another block has too. With ``flags`` only the places of keys that the block's
    own counts call rare (below ``lowest``) and the corpus does not, and one
    row, block -1, with the number of keys that are not rare."""
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        lists = [_from_planes(k, "uint64") for k in pdf["keys"]]
        sizes = np.array([len(x) for x in lists])
        keys = np.concatenate(lists)
        t, b = (np.concatenate([_from_counts(x, "uint32") for x in pdf[c]]).astype(np.int64) for c in ("t", "b"))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        run = np.diff(np.append(first, len(keys)))
        total_t, total_b = np.add.reduceat(t[order], first), np.add.reduceat(b[order], first)
        sent = np.empty(len(keys), bool)
        sent[order] = np.repeat(run > 1, run)
        all_t, all_b = np.empty_like(t), np.empty_like(b)
        all_t[order], all_b[order] = np.repeat(total_t, run), np.repeat(total_b, run)
        if flags:
            sent &= (t + b < lowest) & (all_t + all_b >= lowest)
        rows = [(-1, part, int((total_t + total_b >= lowest).sum()), b"", b"", b"")] if flags else []
        for block, lo, n in zip(pdf["block"], np.cumsum(sizes) - sizes, sizes, strict=True):
            at = sent[lo:lo + n]
            if at.any():
                counts = (b"", b"") if flags else tuple(_counts(x[lo:lo + n][at].astype(np.uint64)) for x in (all_t, all_b))
                rows.append((int(block), part, n, np.packbits(at).tobytes(), *counts))
        return pd.DataFrame(rows, columns=["block", "part", "n", "at", "t", "b"])

    return merge


class _Block:
    """A block: its sorted word hashes, the code of each token, the documents' sizes."""

    def __init__(self, row):
        self.number, self.ids = int(row["block"]), row["ids"]
        self.words = _from_planes(row["words"], "uint64")
        self.codes = _from_counts(row["codes"], "int32")
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.counts = np.bincount(self.codes, minlength=len(self.words))

    def inside(self, known: pd.DataFrame) -> np.ndarray:
        """Whether each document is a target."""
        out = np.zeros(len(self.sizes), bool)
        for at in known["at"][known["part"] == _MARKS]:
            out[_from_planes(at, "uint32")] = True
        return out


class _Bigrams:
    """The bigrams of a block, with rare words as one, and their keys.

    ``hashes`` are those of the block's words, of the rare word and of the place
    before a text; tokens are places in it. ``keys`` are sorted: of the distinct bigrams,
    contexts and words, and of all tokens; ``of`` leads from each of these to its key.
    """

    def __init__(self, block: _Block, known: pd.DataFrame, bits: int, lowest: int):
        rare = block.counts < lowest
        cuts = _cuts(block.words, bits)
        for part, size, at in zip(known["part"], known["n"], known["at"], strict=True):
            if part != _MARKS:
                rare[_places(cuts[part], size, at)] = False
        n = len(block.words)
        self.hashes = np.concatenate([block.words.view(np.int64), [_RARE, _START]])
        names = np.where(rare, n, np.arange(n)).astype(np.int32)
        self.word = names[block.codes] if len(block.codes) else np.zeros(0, np.int32)
        self.previous = np.empty_like(self.word)
        self.previous[1:] = self.word[:-1]
        self.previous[(np.cumsum(block.sizes) - block.sizes)[block.sizes > 0]] = n + 1
        self.owner = np.repeat(np.arange(len(block.sizes)), block.sizes)
        pairs, self.pair = np.unique(self.previous.astype(np.int64) * (n + 2) + self.word, return_inverse=True)
        self.pair_context, self.pair_word = pairs // (n + 2), pairs % (n + 2)
        h, anything = self.hashes, np.full(n + 2, _ANY)
        every = np.concatenate([_key(h[self.pair_context], h[self.pair_word]), _key(h, anything), _key(anything, h),
                                _key(anything[:1], anything[:1])])
        self.keys, place = np.unique(every.view(np.uint64), return_inverse=True)
        self.of = np.split(place, np.cumsum([len(pairs), n + 2, n + 2]))

    def counts(self, side: np.ndarray) -> np.ndarray:
        """How often each key occurs in the tokens of ``side``."""
        n, out = len(self.hashes), np.zeros(len(self.keys), np.int64)
        for place, values in zip(self.of, (
                np.bincount(self.pair[side], minlength=len(self.pair_word)), np.bincount(self.previous[side], minlength=n),
                np.bincount(self.word[side], minlength=n), np.array([side.sum()])), strict=True):
            np.add.at(out, place, values)
        return out

    def corpus(self, own: np.ndarray, back: pd.DataFrame, column: str, bits: int) -> np.ndarray:
        """Corpus counts of the keys from the block's own and those that came back."""
        out, cuts = own.copy(), _cuts(self.keys, bits)
        for part, size, at, values in zip(back["part"], back["n"], back["at"], back[column], strict=True):
            out[_places(cuts[part], size, at)] = _from_counts(values, "uint64").astype(np.int64)
        return out


def _losses(x: _Bigrams, sizes: np.ndarray, inside: np.ndarray, t: np.ndarray, b: np.ndarray, n_words: int, pseudo: float):
    """Per document the mean losses under both models, its own tokens left out of
    its side's. Some documents at a time, to bound memory."""
    ends = np.cumsum(sizes)
    out = np.full((2, len(sizes)), np.nan)
    lo = 0
    while lo < len(sizes):
        start = ends[lo] - sizes[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, start + _AT_ONCE, "right")))
        out[:, lo:hi] = _some_losses(x, x.pair[start:ends[hi - 1]], x.owner[start:ends[hi - 1]] - lo, sizes[lo:hi],
                                     inside[lo:hi], t, b, n_words, pseudo)
        lo = hi
    return out


def _some_losses(x: _Bigrams, pairs: np.ndarray, owner: np.ndarray, sizes: np.ndarray, inside: np.ndarray,
                 t: np.ndarray, b: np.ndarray, n_words: int, pseudo: float):
    kinds = max(1, len(x.pair_word))
    entry, own = np.unique(owner * kinds + pairs, return_counts=True)
    doc, pair = entry // kinds, entry % kinds
    n = len(x.hashes)
    looked, mine = [x.of[0][pair]], [own]
    for place, code in ((x.of[1], x.pair_context[pair]), (x.of[2], x.pair_word[pair])):
        _, group = np.unique(doc * n + code, return_inverse=True)
        looked.append(place[code])
        mine.append(np.bincount(group, own)[group] if len(group) else own)
    looked.append(np.full(len(pair), x.of[3][0]))
    mine.append(sizes[doc])
    out = []
    with np.errstate(invalid="ignore", divide="ignore"):
        for of, on in ((t, inside), (b, ~inside)):
            values = [of[at] - np.where(on[doc], m, 0) for at, m in zip(looked, mine, strict=True)]
            out.append(np.bincount(doc, _loss(*values, n_words, pseudo) * own, len(sizes)) / sizes)
    return out


def cross_entropy_difference(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", size: int | None = None,
    min_count: int = MIN_COUNT, block_tokens: int = BLOCK_TOKENS, pseudo: float = PSEUDO, part_tokens: int = PART_TOKENS,
) -> DataFrame:
    """One row per document: ``key``, n_tokens, in_target, ce_target and
    ce_background (nats per token, the document itself left out), score (their
    difference).

    ``target`` has the keys of the target documents; all others are background.
    Texts are lower-cased; words that occur less than ``min_count`` times are one
    word. With ``size``, so are words that make up less than 1/``size`` of all
    tokens (hence at most ``size`` are told apart); by default no word is. Null texts
    and texts without words have no tokens and null losses. Repeated rows are
    scored each for itself, leaving out one copy; a null key is background. An
    empty table gives an empty result; with no target, its model is the
    smoothing alone. Other columns are not read, whatever their names. A block holds
    about ``block_tokens`` tokens, or one longer text.
    """
    kind = docs.schema[key].dataType.simpleString()

    def encode(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        held: dict[bytes, int] = {}
        ids, sizes, hashes, n = [], [], [], 0

        def block():
            words, codes = np.unique(np.concatenate(hashes).view(np.uint64), return_inverse=True)
            return pd.DataFrame({"block": [number], "ids": [ids], "words": [_planes(words)],
                                 "codes": [_counts(codes.astype(np.int32))], "n": [len(codes)],
                                 "sizes": [np.array(sizes, np.int64).tobytes()]})

        for pdf in batches:
            for i, t in zip(pdf["id"], pdf["text"], strict=True):
                w = tokens(t)
                for x in set(w).difference(held):
                    held[x] = _hash(x)
                ids.append(i)
                sizes.append(len(w))
                hashes.append(np.array([held[x] for x in w], np.int64))
                n += len(w) + 1  # so that blocks of empty texts end too
                if len(held) > _REMEMBERED:
                    held = {}
                if n >= block_tokens:
                    yield block()
                    number, ids, sizes, hashes, n = number + 1, [], [], [], 0
        if ids:
            yield block()

    # Keys travel as text: within pandas, nulls would make floats of 64-bit numbers.
    named = docs.select(F.col(f"`{key}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text"))
    blocks = written(named.mapInPandas(
        encode, "block long, ids array<string>, words binary, codes binary, n long, sizes binary"), "lm-blocks")
    total = blocks.agg(F.sum("n")).first()[0] or 0
    blocks = blocks.drop("n")
    bits = max(0, (max(1, total // part_tokens) - 1).bit_length())
    lowest = max(min_count, -(-total // size) if size else 1)

    def send_words(batches):
        for pdf in batches:
            for _, row in pdf.iterrows():
                x = _Block(row)
                yield _send(x.number, x.words, x.counts, np.zeros_like(x.counts), bits)

    words = blocks.mapInPandas(send_words, _SENT).groupBy("part").applyInPandas(_merge(lowest, True), _BACK)
    words = written(words, "lm-words")
    n_words = words.where("block = -1").agg(F.sum("n")).first()[0] or 0

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [_MARKS], "n": [len(pdf)],
                             "at": [_planes(pdf["i"].to_numpy(np.uint32))], "t": [b""], "b": [b""]})

    wanted = target.select(F.col(f"`{key}`").cast(kind).cast("string").alias("id")).where("id is not null").distinct()
    places = blocks.select("block", F.posexplode("ids").alias("i", "id"))
    marks = places.join(wanted, "id", "left_semi").groupBy("block").applyInPandas(pack, _BACK)
    known = written(words.where("block >= 0").union(marks), "lm-known")
    by_block = blocks.groupBy("block")

    def send_bigrams(block_pdf: pd.DataFrame, known_pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(block_pdf):
            return pd.DataFrame(columns=[c.split()[0] for c in _SENT.split(", ")])
        block = _Block(block_pdf.iloc[0])
        x = _Bigrams(block, known_pdf, bits, lowest)
        side = block.inside(known_pdf)[x.owner]
        return _send(block.number, x.keys, x.counts(side), x.counts(~side), bits)

    # Both joins read one exchange of the blocks; what is sent back is not written in between.
    shared = by_block.cogroup(known.groupBy("block")).applyInPandas(send_bigrams, _SENT).groupBy("part").applyInPandas(
        _merge(lowest, False), _BACK)
    everything = known.withColumn("what", F.lit(0)).union(shared.withColumn("what", F.lit(1)))

    def score(block_pdf: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        if not len(block_pdf):
            return pd.DataFrame(columns=["id", "n_tokens", "in_target", "ce_target", "ce_background", "score"])
        block = _Block(block_pdf.iloc[0])
        known_pdf, counts = back[back["what"] == 0], back[back["what"] == 1]
        x = _Bigrams(block, known_pdf, bits, lowest)
        inside = block.inside(known_pdf)
        side = inside[x.owner]
        t, b = (x.corpus(x.counts(s), counts, c, bits) for c, s in (("t", side), ("b", ~side)))
        ce_t, ce_b = _losses(x, block.sizes, inside, t, b, n_words, pseudo)
        out = pd.DataFrame({"id": list(block.ids), "n_tokens": block.sizes, "in_target": inside,
                            "ce_target": ce_t, "ce_background": ce_b, "score": ce_t - ce_b})
        return out.astype({c: object for c in ("ce_target", "ce_background", "score")}).where(out.notna(), None)

    out = by_block.cogroup(everything.groupBy("block")).applyInPandas(
        score, "id string, n_tokens long, in_target boolean, ce_target double, ce_background double, score double")
    return out.select(F.col("id").cast(kind).alias(key), "n_tokens", "in_target", "ce_target", "ce_background", "score")


def op4_cross_entropy(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Target: documents labelled of good quality."""
    return cross_entropy_difference(docs, labels.where("quality = 1").select("doc_id"))
