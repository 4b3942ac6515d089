"""Quality of documents by a linear-chain conditional random field over lines.

Every line (split at ``\\n``) is good or bad. A line's potential is linear in
features of the line and of the lines before and after it; a 2 x 2 table of
potentials joins neighbouring labels. The field is fitted by maximum conditional
likelihood (L-BFGS, ridge) on documents whose lines all carry the document's
label. A document's quality is the mean of its lines' forward-backward marginals
of "good", weighted by their lengths.

Forward and backward messages are products of 2 x 2 matrices, taken for all
lines of a batch at once by doubling the reach of the products: a document of n
lines needs log2(n) steps, so very long documents cost no Python loop per line.
Features are counted over the code points of whole texts, a batch at a time.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convprep.llm.common import written

PER_LABEL = 3000  # labelled documents of each label that the fit may use
LINES = 400_000  # lines that the fit may use
RIDGE = 1e-3
CUT = 0.3
_BLANK, _LOWER, _UPPER, _DIGIT, _STOP, _SYMBOL, _OTHER = range(7)
_CHARS = 2_000_000  # code points worked on at a time; a longer text is taken alone
_PRIME = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _kinds() -> np.ndarray:
    """Kind of every code point."""
    table = np.full(0x110000, _OTHER, np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))
        if c[0] in "LM":
            table[i] = _UPPER if c in ("Lu", "Lt") else _LOWER
        elif c[0] == "N":
            table[i] = _DIGIT
        elif c[0] == "S":
            table[i] = _SYMBOL
    table[[ord(c) for c in ".,;:!?'\"()-"]] = _STOP
    table[[ord(c) for c in "#*%&|<>@/\\_{}[]~"]] = _SYMBOL
    table[[ord(c) for c in " \t\n\v\f\r"]] = _BLANK
    return table


@functools.lru_cache(4)
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _PRIME)]), dtype=np.uint64)


def _hashes(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each stretch of code points (stretches in order, apart or adjacent)."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    sizes = end - begin
    inside = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    place = inside - np.repeat(begin, sizes)
    top = 1 << int(max(10, int(sizes.max(initial=1)).bit_length()))
    value = (points[inside].astype(np.uint64) + np.uint64(1)) * _powers(top)[place]
    sums = np.zeros(len(begin) + 1, np.uint64)
    sums[1:] = np.cumsum(value, dtype=np.uint64)[np.cumsum(sizes) - 1] if len(value) else 0
    out = sums[1:] - sums[:-1]
    out[sizes == 0] = 0
    return out ^ (out >> np.uint64(29))


def _seen(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether the same (group, value) comes earlier in the arrays."""
    order = np.lexsort((np.arange(len(value)), value, group))
    same = np.zeros(len(value), bool)
    same[order[1:]] = (value[order[1:]] == value[order[:-1]]) & (group[order[1:]] == group[order[:-1]])
    return same


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of the texts, its place in its document, and its
    length in code points. Texts that are null are one empty line."""
    texts = ["" if t is None else t for t in texts]
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    breaks = np.flatnonzero(points == 10)
    begin, end = np.concatenate([[0], breaks[:-1] + 1]), breaks
    n_lines = np.array([t.count("\n") + 1 for t in texts], int)
    doc = np.repeat(np.arange(len(texts)), n_lines)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)

    kind = _kinds()[points]
    # Every line ends in a line break, so no stretch for reduceat is empty.
    counts = {k: np.add.reduceat(kind == k, begin, dtype=np.int64) for k in range(7)}
    chars = end - begin
    ink = np.maximum(1, chars - (counts[_BLANK] - 1))
    letters = np.maximum(1, counts[_LOWER] + counts[_UPPER])
    # Words: stretches without blanks.
    full = kind != _BLANK
    w_begin = np.flatnonzero(full & ~np.concatenate([[False], full[:-1]]))
    w_end = np.flatnonzero(full & ~np.concatenate([full[1:], [False]])) + 1
    w_line = np.searchsorted(breaks, w_begin)
    hashes = _hashes(points, w_begin, w_end)
    n_words = np.bincount(w_line, minlength=len(doc))
    words = np.maximum(1, n_words)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(w_line, flags, len(doc)) / words

    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (w_line[1:] == w_line[:-1])
    in_line = _seen(w_line, hashes)
    in_doc = _seen(doc[w_line], hashes) & ~in_line
    copied = _seen(doc, _hashes(points, begin, end)) & (n_words > 0)
    capital = kind[w_begin] == _UPPER
    last = kind[w_end - 1]
    lengths = w_end - w_begin
    shares = np.stack([
        counts[_UPPER] / letters, counts[_DIGIT] / ink, counts[_STOP] / ink, counts[_SYMBOL] / ink, counts[_OTHER] / ink,
        share(again), share(in_line), share(in_doc), share(capital), share(last == _STOP), share(last == _SYMBOL),
        share(lengths <= 2), share(lengths >= 16)], axis=1)
    rest = np.stack([
        np.log1p(n_words), np.log1p(chars), np.log1p(ink / words), copied, n_words == 0,
        np.isin(points[np.maximum(begin, end - 1)], [ord(c) for c in ".!?:;"])], axis=1)
    own = np.concatenate([shares, np.sqrt(shares), rest], axis=1)

    first, final = place == 0, np.concatenate([place[1:] == 0, [True]]) if len(place) else place == 0
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first], after[final] = 0, 0
    return np.concatenate([own, before, after, first[:, None], final[:, None]], axis=1), place, chars


# ---- the chain -------------------------------------------------------------

def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices given by their logarithms."""
    return np.logaddexp(a[:, :, :1] + b[:, :1, :], a[:, :, 1:] + b[:, 1:, :])


def messages(good: np.ndarray, joint: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logarithms of forward and backward messages (lines x 2) and the steps
    (lines x 2 x 2) they are products of. ``good`` is each line's potential of the
    label 1 against 0, ``joint`` the table of neighbouring labels, ``place`` the
    line's place in its document."""
    n = len(good)
    node = np.stack([np.zeros(n), good], axis=1)
    step = np.where((place == 0)[:, None, None], 0.0, joint) + node[:, None, :]
    left = n - np.concatenate([np.flatnonzero(place == 0), [n]])
    until = np.repeat(left[1:], -np.diff(left))  # lines of the table after the document
    behind = n - 1 - np.arange(n) - until  # lines of the document after this one
    ahead, back = step.copy(), step.copy()
    reach = 1
    while True:
        f, b = np.flatnonzero(place >= reach), np.flatnonzero(behind >= reach)
        if not len(f):
            break
        # Each product covers ``reach`` lines, or as many as there are; both sides are read before they change.
        ahead[f] = _product(ahead[f - reach], ahead[f])
        back[b] = _product(back[b], back[b + reach])
        reach *= 2
    alpha = ahead[:, 0]
    beta = np.zeros((n, 2))
    more = np.flatnonzero(behind > 0)
    beta[more] = np.logaddexp(back[more + 1, :, 0], back[more + 1, :, 1])
    return alpha, beta, step


def marginals(good: np.ndarray, joint: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Probability that each line is good, given its whole document."""
    alpha, beta, _ = messages(good, joint, place)
    both = alpha + beta
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))


def _loss(params: np.ndarray, x: np.ndarray, place: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float):
    """Negative weighted conditional log-likelihood per document with ridge, and its gradient."""
    w, joint = params[:-4], params[-4:].reshape(2, 2)
    alpha, beta, step = messages(x @ w, joint, place)
    last = np.concatenate([place[1:] == 0, [True]])
    total = np.logaddexp(alpha[last, 0], alpha[last, 1])
    per_line = np.repeat(total, np.diff(np.concatenate([[-1], np.flatnonzero(last)])))
    follow = np.flatnonzero(place > 0)
    value = (weight[last] * total).sum() - (weight * y * (x @ w)).sum()
    value -= (weight[follow] * joint[y[follow - 1], y[follow]]).sum()
    p = np.exp((alpha + beta)[:, 1] - per_line)
    g = x.T @ (weight * (p - y))
    pair = np.exp(alpha[follow - 1][:, :, None] + step[follow] + beta[follow][:, None, :] - per_line[follow][:, None, None])
    gj = (weight[follow][:, None, None] * pair).sum(axis=0)
    np.subtract.at(gj, (y[follow - 1], y[follow]), weight[follow])
    docs = weight[last].sum() if len(last) else 1.0
    return (value / docs + ridge * params @ params / 2, np.concatenate([g, gj.ravel()]) / docs + ridge * params)


def minimise(f, at: np.ndarray, steps: int = 120, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking for a convex function that returns value and gradient."""
    value, grad = f(at)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, a = grad.copy(), []
        for s, y in reversed(past):
            a.append(s @ d / (y @ s))
            d -= a[-1] * y
        if past:
            d *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1])
        for (s, y), k in zip(past, reversed(a), strict=True):
            d += s * (k - y @ d / (y @ s))
        size, slope = (1.0 if past else 1.0 / max(1.0, np.abs(grad).sum())), grad @ d
        while True:
            new = at - size * d
            v, g = f(new)
            if v <= value - 1e-4 * size * slope or size < 1e-10:
                break
            size /= 2
        if value - v < 1e-8 * max(1.0, abs(value)):
            return new if v < value else at
        if (new - at) @ (g - grad) > 1e-14:
            past = [*past, (new - at, g - grad)][-memory:]
        at, value, grad = new, v, g
    return at


@dataclass
class Model:
    """Means and scales of the features, weights (the last one constant), and
    the table of neighbouring labels."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    joint: np.ndarray

    def good(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]


def fit(texts: list[str | None], labels: list[int], ridge: float = RIDGE, lines: int = LINES) -> Model:
    """Fit the field; each document counts alike, whatever its lines. Documents
    beyond ``lines`` lines in all are left out of the fit."""
    sizes = np.cumsum([(t or "").count("\n") + 1 for t in texts])
    n = max(1, int((sizes <= lines).sum()))
    parts = [line_features(texts[lo:lo + 500]) for lo in range(0, n, 500)]
    # The last part may reach beyond n; cut it by lines.
    upto = int(sizes[n - 1])
    raw = np.concatenate([p[0] for p in parts])[:upto]
    place = np.concatenate([p[1] for p in parts])[:upto]
    count = np.diff(np.concatenate([[0], sizes[:n]]))
    y = np.repeat(np.array(labels[:n], int), count)
    weight = np.repeat(1.0 / count, count)
    mean, scale = raw.mean(axis=0), raw.std(axis=0)
    scale[scale < 1e-9] = 1.0
    x = np.concatenate([np.clip((raw - mean) / scale, -8, 8), np.ones((len(raw), 1))], axis=1)
    got = minimise(lambda p: _loss(p, x, place, y, weight, ridge), np.zeros(x.shape[1] + 4))
    return Model(mean, scale, got[:-4], got[-4:].reshape(2, 2))


def score_texts(model: Model | None, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per run of texts: marginals of the lines, the lines' places, and the documents' scores."""
    lo = 0
    while lo < len(texts):
        hi, chars = lo, 0
        while hi < len(texts) and (hi == lo or chars + len(texts[hi] or "") <= _CHARS):
            chars += len(texts[hi] or "")
            hi += 1
        features, place, length = line_features(texts[lo:hi])
        p = np.full(len(place), 0.5) if model is None else marginals(model.good(features), model.joint, place)
        doc = np.cumsum(place == 0) - 1
        weight = length + 1.0  # with its line break
        yield p, place, np.bincount(doc, p * weight) / np.bincount(doc, weight)
        lo = hi


# ---- on tables -------------------------------------------------------------

def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          per_label: int = PER_LABEL, lines: int = LINES, ridge: float = RIDGE) -> Model | None:
    """Fit on at most ``per_label`` labelled documents per label and ``lines``
    lines, those of the lowest hash of their key. The fit alone is bounded so.

    ``labels`` has the key and the label (1 good, else bad); rows with a null are
    left out, and a key with several labels counts once for each. None without
    any labelled document.
    """
    marked = labels.select(F.col(f"`{key}`").alias("id"), (F.col(f"`{label}`") == 1).cast("int").alias("y")).where(
        "id is not null and y is not null").select("id", "y", (
            F.pmod(F.xxhash64("id", F.lit("linecrf")), F.lit(2**30)) / F.lit(2.0**30)).alias("u"))
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.coalesce(*[F.when(F.col("y") == k, F.lit(min(1.0, per_label / n))) for k, n in sorted(counts.items())])
    most = per_label * len(counts) + 10 * int(per_label**0.5) + 10
    sample = written(marked.where(F.col("u") < share).limit(most), "linecrf-labels")
    found = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).join(
        F.broadcast(sample), "id").limit(most).collect()  # at most ``most`` rows on both sides
    if not found:
        return None
    found.sort(key=lambda r: (r["u"], str(r["id"]), r["y"], r["text"] or ""))
    return fit([r["text"] for r in found], [r["y"] for r in found], ridge, lines)


def _rows(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def score_documents(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` as struct ``row`` with score (0 to 1), in one pass without a shuffle.
    Null and empty texts are one empty line; rows that repeat get equal scores;
    without a model the score is 0.5."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([np.zeros(0), *[s for _, _, s in score_texts(held.value, texts.tolist())]]))

    return docs.select(_rows(docs), score(F.col(f"`{text}`")).alias("score"))


def label_lines(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """One row per line of every document: the document as struct ``row``, line (from 0),
    good (its marginal) and label (1 if that is at least 0.5)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def lines(texts: pd.Series) -> pd.Series:
        out: list = []
        for p, place, _ in score_texts(held.value, texts.tolist()):
            out += np.split(p, np.flatnonzero(place == 0)[1:])
        return pd.Series(out, dtype=object)

    return docs.select(_rows(docs), F.posexplode(lines(F.col(f"`{text}`"))).alias("line", "good")).select(
        "row", "line", "good", (F.col("good") >= 0.5).cast("int").alias("label"))


def op11_line_crf(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Digest of the contract. A row with a null doc_id is neither held out nor
    learned from."""
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = train(docs, labels.where(part != 0))
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select(F.col("row.doc_id").alias("doc_id"), "score").select(
        "doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"))
