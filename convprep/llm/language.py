"""Language identification with string kernels.

A text is the set of its n-grams of code points (n = 1, 2, 3 blended, as presence, not
counts), letters of any script each for itself. The kernel of two texts is |A and B| / sqrt(|A| |B|). Landmark texts
give a Nyström approximation, in which one kernel ridge regression per language
is fitted against the rest. A text's kernel values against all landmarks, times
the regression weights, is one product of its presence vector with a fixed
matrix; texts are scored in batches of such products.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convprep.llm.common import written
from convprep.llm.jaccard import common_counts

PER_LANGUAGE = 400
LANDMARKS = 160
RIDGE = 1e-4
_POINTS = np.uint64(0x110000)  # code points there are


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(i))[0] in "LM" for i in range(0x110000)), bool, 0x110000).astype(np.uint8)


def presence(text: str) -> np.ndarray:
    """Sorted distinct n-grams of a text, n = 1 to 3, as numbers; none if it has no letter.

    An n-gram is a run of code points of the lower-cased text, each letter or mark
    itself and all others one sign; its number is these code points as digits, so
    no two n-grams share one.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_letters()[points] > 0, points, 0).astype(np.uint64)
    if not c.any():
        return np.zeros(0, np.uint64)
    pair = (c[:-1] + np.uint64(1)) * _POINTS + c[1:]
    return np.unique(np.concatenate([c, pair, pair[:-1] * _POINTS + c[2:]]))


@dataclass
class Model:
    """Languages, the n-grams of the landmarks (sorted), and a row of ``weights`` for each."""

    languages: list[str]
    known: np.ndarray
    weights: np.ndarray

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """The rows of those n-grams that a landmark has."""
        at = np.minimum(np.searchsorted(self.known, grams), max(0, len(self.known) - 1))
        return at[self.known[at] == grams] if len(self.known) else at[:0]


def fit(sets: list[np.ndarray], labels: list[str],
        landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nyström kernel ridge regression, one language against the rest."""
    languages = sorted(set(labels))
    per = max(1, landmarks // max(1, len(languages)))
    chosen = [i for k in languages for i in [j for j, x in enumerate(labels) if x == k][:per]]
    size = np.array([len(s) for s in sets], float)
    marks = np.array(chosen, dtype=int)
    kernel = common_counts(sets, np.arange(len(sets)), marks) / np.sqrt(size[:, None] * size[marks][None, :])
    kernel[marks, np.arange(len(marks))] = 1.0  # common_counts leaves out what only one text has
    target = np.array([[x == k for k in languages] for x in labels], float)
    # Subset of regressors: (C'C + ridge n W) a = C'Y with C all against landmarks.
    left = kernel.T @ kernel + ridge * len(sets) * kernel[marks]
    alpha = np.linalg.solve(left + 1e-9 * np.eye(len(marks)), kernel.T @ target)
    known = np.unique(np.concatenate([sets[i] for i in chosen]))
    weights = np.zeros((len(known), len(languages)))
    for i, a in zip(chosen, alpha, strict=True):
        weights[np.searchsorted(known, sets[i])] += a / np.sqrt(size[i])
    return Model(languages, known, weights.astype(np.float32))


def score_batch(model: Model, sets: list[np.ndarray], cells: int = 8_000_000) -> np.ndarray:
    """Regression values (texts x languages): presence matrix (of ``cells`` at most)
    times weights, a block of texts at a time, over the square root of the set sizes."""
    out = np.zeros((len(sets), len(model.languages)))
    block = max(1, min(256, cells // max(1, len(model.known))))
    for lo in range(0, len(sets), block):
        part = sets[lo:lo + block]
        x = np.zeros((len(part), len(model.weights)), np.float32)
        for i, s in enumerate(part):
            x[i, model.rows(s)] = 1
        size = np.sqrt(np.maximum(1, [len(s) for s in part]))
        out[lo:lo + block] = (x @ model.weights) / size[:, None]
    return out


def train(rows: DataFrame, text: str = "text", lang: str = "lang", draw: Column | None = None,
          per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model | None:
    """Fit on a bounded sample of ``rows`` with a non-null ``lang``: about
    ``per_language`` texts of each language, those of the lowest ``draw`` (a
    column of uniform 64-bit hashes). The classifier alone is bounded by this;
    None if there is no labelled text with a letter.
    """
    labelled = rows.where(F.col(f"`{lang}`").isNotNull()).select(
        F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"),
        (F.pmod(draw, F.lit(2**30)) / F.lit(2.0**30)).alias("u")).where(F.rlike("text", F.lit(r"\p{L}")))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, per_language / n))) for k, n in sorted(counts.items())])
    # The limit binds only if thousands of rows share one hash.
    sample = written(labelled.where(F.col("u") < share).limit(2 * per_language * len(counts) + 100), "language-sample")

    def sets(batches):
        for pdf in batches:
            yield pd.DataFrame({"u": pdf["u"], "lang": pdf["lang"],
                                "grams": [presence(t).view(np.int64) for t in pdf["text"]]})

    got = sample.mapInPandas(sets, "u double, lang string, grams array<long>").collect()
    got = sorted((r for r in got if r["grams"]), key=lambda r: (r["u"], r["lang"], r["grams"]))
    if not got:
        return None
    return fit([np.array(r["grams"], np.int64).view(np.uint64) for r in got], [r["lang"] for r in got], landmarks)


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` as struct ``row`` with lang_pred and score (0 to 1). ``und`` and 0 for
    null texts and texts without a letter, and for all if there is no model. One
    pass, no shuffle; repeated rows get equal predictions."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by landmarks and languages

    @F.pandas_udf("lang string, score double")
    def label(texts: pd.Series) -> pd.DataFrame:
        m = held.value
        if m is None:
            return pd.DataFrame({"lang": ["und"] * len(texts), "score": [0.0] * len(texts)})
        sets = [presence(t or "") for t in texts]
        value = score_batch(m, sets)
        best = value.argmax(axis=1)
        some = np.array([len(s) > 0 for s in sets], bool)
        score = np.clip(value[np.arange(len(sets)), best], 0, 1)
        return pd.DataFrame({"lang": np.where(some, np.array(m.languages, object)[best], "und"),
                             "score": np.where(some, score, 0.0)})

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       label(F.col(f"`{text}`")).alias("p")).select(
        "row", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op10_string_kernel(docs: DataFrame) -> DataFrame:
    """Digest of the contract. A row with a null doc_id is neither held out nor
    learned from."""
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = train(docs.where(part != 0), draw=F.xxhash64("doc_id", F.lit("language")))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select(F.col("row.doc_id").alias("doc_id"), "lang_pred", "score").select(
        "doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
