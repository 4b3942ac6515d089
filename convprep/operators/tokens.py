"""Tokenize, fit a vocabulary, encode, decode.

The reference injects a pretrained tokenizer object; here the vocabulary is
fitted from the data (A10: word level, H3: sub-word merges) and the per-row
codec becomes joins against that vocabulary, so no Python runs per token on
the built-in path.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convprep.functions.arrays import bounded_runs
from convprep.functions.text import clean_decoded, pretokenize
from convprep.operators.index import dense_index
from convprep.operators.lookup import block_counts, code_blocks, lookup_arrays, lookup_codes
from convprep.session import spread, stored

UNK_ID = -1


def tokenize(df: DataFrame, col: str = "text", out: str = "tokens", pattern: str = "blank") -> DataFrame:
    """H1 as a DataFrame step: add the pre-token array of ``col``."""
    return df.withColumn(out, pretokenize(col, pattern))


def _numbered(counts: DataFrame, min_count: int, max_size: int | None, num_buckets: int | None) -> DataFrame:
    """``(tok, id, n)`` of ``(tok, n)``: ids by count desc then token asc."""
    if min_count > 1:
        counts = counts.where(F.col("n") >= min_count)
    indexed = dense_index(counts, [F.desc("n"), F.asc("tok")], out="id", num_buckets=num_buckets)
    if max_size is not None:
        indexed = indexed.where(F.col("id") < max_size)
    return indexed.select("tok", F.col("id").cast("bigint").alias("id"), F.col("n").cast("bigint").alias("n"))


def fit_vocabulary(
    df: DataFrame,
    cols: Sequence[str],
    min_count: int = 1,
    max_size: int | None = None,
    num_buckets: int | None = None,
) -> DataFrame:
    """A10: ``(tok, id bigint, n bigint)``, ids by count desc then token asc.

    Tokens come from one or more ``array<string>`` columns (names or
    expressions such as ``pretokenize("text")``). Counting is a
    partial + final hash aggregate (hot tokens collapse map-side), the ids
    come from the range-partitioned dense index, never a global window.
    ``max_size`` keeps the most frequent tokens.
    """
    toks = None
    for c in cols:
        # explode_outer + filter: avoids re-evaluating the array per row in
        # filters Catalyst would infer for a plain explode.
        part = df.select(F.explode_outer(F.col(c) if isinstance(c, str) else c).alias("tok"))
        toks = part if toks is None else toks.unionByName(part)
    counts = toks.where(F.col("tok").isNotNull()).groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    return _numbered(counts, min_count, max_size, num_buckets)


def fit_encode(
    df: DataFrame,
    tokens: Sequence[str],
    outs: Sequence[str],
    min_count: int = 1,
    max_size: int | None = None,
    unk_id: int | None = UNK_ID,
    keep: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """A10 and J3 over the same rows: fit a vocabulary on the token columns and
    encode them with it. Returns ``(df or its columns keep, with outs; vocab)``.

    The texts are tokenized once: the blocks' dictionaries give the counts, and
    the codes the ids.
    """
    stage = code_blocks(df, tokens, keep=keep)
    vocab = _numbered(block_counts(stage), min_count, max_size, None)
    return lookup_codes(stage, outs, vocab, "tok", "id", "bigint", default=unk_id,
                        narrow=keep is not None), vocab


def encode(
    df: DataFrame,
    key: Sequence[str],
    tokens: Sequence[str],
    outs: Sequence[str],
    vocab: DataFrame,
    unk_id: int | None = UNK_ID,
    join_back: bool = True,
) -> DataFrame:
    """Token arrays -> id arrays through ``vocab(tok, id)``.

    Several token columns are encoded in one pass, by block dictionaries
    (:mod:`convprep.operators.lookup`). Unknown tokens get ``unk_id`` (None
    keeps a null). ``join_back=False`` returns only ``key`` and the id columns.
    """
    return lookup_arrays(df, key, tokens, outs, vocab, "tok", "id", "bigint", default=unk_id, join_back=join_back)


def decode(
    df: DataFrame,
    key: Sequence[str],
    ids: str,
    vocab: DataFrame,
    out: str = "decoded",
    joiner: str = " ",
    join_back: bool = True,
    clean: bool = False,
) -> DataFrame:
    """Id arrays -> text, tokens joined by ``joiner`` in position order.

    Unknown ids are skipped (``array_join`` drops nulls). ``clean`` takes out
    the blank before ``. , ! ?``. ``join_back=False`` returns only ``key`` and the text.
    """
    looked = lookup_arrays(df, key, [ids], ["_cp_toks"], vocab, "id", "tok", "string", default=None,
                           key_type="bigint", join_back=join_back)
    text = F.array_join("_cp_toks", joiner)
    return looked.withColumn(out, clean_decoded(text) if clean else text).drop("_cp_toks")


def tokenize_dataset(
    df: DataFrame,
    vocab: DataFrame,
    synonyms=None,
    number_of_keywords: int | None = None,
    pattern: str = "blank",
    unk_id: int | None = UNK_ID,
) -> DataFrame:
    """The tokenized dataset.

    With a ``keywords`` column the result has the D10 schema ``id, text,
    keywords, used_keywords, tokenized_text, tokenized_keywords, text_ids,
    keyword_ids``; without, D11: ``id, text, tokenized_text, token_ids``.
    """
    from convprep.operators.keywords import translate_keywords

    # The tokens are cut again from the stored text where they are wanted: as kept
    # columns they would pass the workers and be written beside the arrays to code.
    text_tokens = pretokenize("text", pattern)
    if "keywords" in df.columns:
        step = translate_keywords(df.select("id", "text", "keywords"), synonyms, number_of_keywords)
        keyword_tokens = F.flatten(F.transform("used_keywords", lambda k: pretokenize(k, pattern)))
        enc = encode(step, ["id"], [text_tokens, keyword_tokens], ["text_ids", "keyword_ids"], vocab, unk_id=unk_id)
        return enc.select(
            "id", "text", "keywords", "used_keywords", text_tokens.alias("tokenized_text"),
            keyword_tokens.alias("tokenized_keywords"), "text_ids", "keyword_ids",
        )
    enc = encode(df.select("id", "text"), ["id"], [text_tokens], ["token_ids"], vocab, unk_id=unk_id)
    return enc.select("id", "text", text_tokens.alias("tokenized_text"), "token_ids")


# ---------------------------------------------------------------- sub-words

_SEP = "\u0001"  # parts words
_REMEMBERED = 200_000  # words whose pieces a task keeps
_AT_ONCE = 100_000  # words whose pieces a task holds
_AT_ONCE_CHARS = 1_000_000  # characters of text whose tokens a task holds
_LISTED = 1_024  # pairs whose exact counts the driver of a fit keeps


def _pair_counts(words: DataFrame) -> DataFrame:
    """``(a, b, cnt)``: adjacent symbols of ``words(syms, n)``, weighted by ``n``."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("syms") - 1),
        lambda i: F.struct(F.element_at("syms", i).alias("a"), F.element_at("syms", i + 1).alias("b")),
    )
    rows = words.where(F.size("syms") >= 2).select("n", F.explode_outer(pairs).alias("p"))
    return rows.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("n").alias("cnt"))


def merge_pair(syms: Sequence[str], a: str, b: str) -> list[str]:
    """``syms`` with every ``a, b`` joined, left to right."""
    out, i, n = [], 0, len(syms)
    while i < n:
        if i + 1 < n and syms[i] == a and syms[i + 1] == b:
            out.append(a + b)
            i += 2
        else:
            out.append(syms[i])
            i += 1
    return out


def _replay(words: list[list[str]], plan: Sequence[tuple[str, str]]) -> Iterator[tuple[int, int, list[str], list[str]]]:
    """Apply the merges of ``plan`` in order to ``words`` (changed in place);
    yields ``(step, word, symbols before, symbols after)`` for each change. An
    index from the pairs of the plan to their words leads each step to the
    words that hold its pair; no other word is looked at again."""
    planned = set(plan)
    where: dict[tuple[str, str], set[int]] = {}

    def enter(i: int) -> None:
        s = words[i]
        for p in zip(s, s[1:]):
            if p in planned:
                where.setdefault(p, set()).add(i)

    for i in range(len(words)):
        enter(i)
    for step, (a, b) in enumerate(plan):
        for i in where.pop((a, b), ()):
            old = words[i]
            new = merge_pair(old, a, b)
            if len(new) != len(old):  # else an earlier merge took one of the two
                words[i] = new
                enter(i)
                yield step, i, old, new


def _advance(words: DataFrame, plan: Sequence[tuple[str, str]]) -> DataFrame:
    """``words(syms, n)`` after the merges of ``plan``, written; words of one symbol go."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            syms = [list(s) for s in pdf["syms"]]
            for _ in _replay(syms, plan):
                pass
            yield pd.DataFrame({"syms": pd.Series(syms, dtype=object), "n": pdf["n"].to_numpy()})

    return stored(words.mapInPandas(run, "syms array<string>, n bigint").where(F.size("syms") >= 2), "words")


def _changes(words: DataFrame, done: Sequence[tuple[str, str]], guess: Sequence[tuple[str, str]],
             known: set[tuple[str, str]], cutoff: int) -> list:
    """What the merges ``guess``, after ``done``, change in the pair counts:
    rows ``(a, b, steps[(step, d)])`` of the pairs in ``known`` and of the new
    pairs that come to more than ``cutoff`` at once (a step has at most
    ``2 * count / cutoff`` of those, so the driver gets a bounded number)."""
    plan, first = [*done, *guess], len(done)
    made = {a + b for a, b in guess}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        delta: dict[tuple[int, str, str], int] = {}

        def rows() -> pd.DataFrame:
            keys = list(delta)
            out = pd.DataFrame({"step": [k[0] for k in keys], "a": [k[1] for k in keys], "b": [k[2] for k in keys],
                                "d": list(delta.values()), "known": [k[1:] in known for k in keys]})
            delta.clear()
            return out

        for pdf in batches:
            ns = pdf["n"].tolist()
            for step, i, old, new in _replay([list(s) for s in pdf["syms"]], plan):
                if step < first:
                    continue
                for syms, n in ((old, -ns[i]), (new, ns[i])):
                    for p in zip(syms, syms[1:]):
                        if p in known or p[0] in made or p[1] in made:
                            k = (step - first, *p)
                            delta[k] = delta.get(k, 0) + n
            if len(delta) > 200_000:
                yield rows()
        if delta:
            yield rows()

    found = words.mapInPandas(run, "step int, a string, b string, d bigint, known boolean").repartition("a", "b")
    by_step = found.groupBy("a", "b", "step").agg(F.sum("d").alias("d"), F.max("known").alias("known"))
    by_pair = by_step.groupBy("a", "b").agg(
        F.collect_list(F.struct("step", "d")).alias("steps"), F.max("d").alias("top"), F.max("known").alias("known"))
    return by_pair.where(F.col("known") | (F.col("top") > cutoff)).select("a", "b", "steps").collect()


def _best(counts: dict) -> tuple[tuple[str, str], float]:
    """The pair merged next: highest count, then smallest pair."""
    return min(counts.items(), key=lambda e: (-e[1], e[0]))


def _guess(counts: dict[tuple[str, str], int], size: int, floor: int) -> list[tuple[str, str]]:
    """The next merges, the first for certain, the rest as they would be if the
    neighbours of a pair did not depend on each other."""
    est: dict[tuple[str, str], float] = dict(counts)
    out: list[tuple[str, str]] = []
    while est and len(out) < size:
        (a, b), c = _best(est)
        if c <= floor:
            break
        out.append((a, b))
        del est[a, b]
        starts = c + sum(v for p, v in est.items() if p[0] == a)
        ends = c + sum(v for p, v in est.items() if p[1] == b)
        for (x, y), v in list(est.items()):
            if y == a:
                moved = v * c / starts
                est[x, y] -= moved
                est[x, a + b] = est.get((x, a + b), 0) + moved
            if x == b:
                moved = v * c / ends
                est[x, y] = est[x, y] - moved
                est[a + b, y] = est.get((a + b, y), 0) + moved
    return out


def fit_subword_merges(
    df: DataFrame,
    col: str = "text",
    n_merges: int = 10,
    pattern: str = "words",
    min_pair_count: int = 2,
    checkpoint_every: int = 5,
    batch: int = 64,
) -> DataFrame:
    """H3: learn ``n_merges`` byte-pair style merges from the corpus: always the
    pair with the highest count, then the smallest pair.

    Work is on the distinct pre-tokens with their counts (a fraction of the
    corpus), written once. A round guesses up to ``batch`` next merges and one
    job replays them on the words, step by step through an index from pair to
    words in each task, and adds up what each step changes in the pair counts.
    The driver keeps the exact counts of at most about a thousand best pairs;
    with these changes it checks the guess and takes its merges as far as each
    was the best pair indeed, at least the first, so the merges equal the
    one-at-a-time fit. A pair outside the list never comes above its last
    count: counts fall, but for pairs of a new symbol, and those are sent
    when they pass it. When the best known pair falls to that bound, or a merge
    makes a symbol that an earlier one made from other parts, all pairs are
    counted and listed again.

    The merges taken are written into the words every ``checkpoint_every``
    rounds; no round depends on cached blocks, and a lost executor costs the
    running round. The character U+0001 parts words. Returns ``(rank, left,
    right, merged, n)``.
    """
    from convprep.session import ship_package

    spark = df.sparkSession
    ship_package(spark)  # the replay runs in executor Python workers
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = (
        spread(df.select(col)).select(F.explode_outer(pretokenize(col, pattern)).alias("w"))
        .select(F.explode_outer(F.split("w", _SEP)).alias("w"))
        .where(F.length("w") > 1)
        .groupBy("w").agg(F.count(F.lit(1)).alias("n"))
        .select(F.regexp_extract_all("w", F.lit(r"(?s)(.)"), 1).alias("syms"), "n")
    )
    # A fixed partition count (AQE does not coalesce it) keeps rounds parallel.
    words = stored(words.repartition(parts, "syms"), "words")
    merges: list[tuple[int, str, str, str, int]] = []
    made: set[str] = set()
    done: list[tuple[str, str]] = []  # merges taken and not yet written into the words
    counts: dict[tuple[str, str], int] = {}
    cutoff, relist, rounds = 0, True, 0
    while len(merges) < n_merges:
        if done and (relist or rounds % checkpoint_every == 0):
            words, done = _advance(words, done), []
        if relist:
            top = (
                _pair_counts(words).where(F.col("cnt") >= min_pair_count)
                .orderBy(F.desc("cnt"), F.asc("a"), F.asc("b")).limit(_LISTED + 1).collect()
            )
            # Pairs not listed have at most this count; the last of a full list only sets it.
            cutoff = int(top[-1]["cnt"]) if len(top) > _LISTED else min_pair_count - 1
            counts = {(r["a"], r["b"]): int(r["cnt"]) for r in top[:_LISTED]}
            if not counts:
                break
        # Straight after a listing the first is the best pair even at the cutoff.
        guess = _guess(counts, min(batch, n_merges - len(merges)), cutoff) or [_best(counts)[0]]
        changes: list[list[tuple[str, str, int]]] = [[] for _ in guess]
        for r in _changes(words, done, guess, set(counts), cutoff):
            for s in r["steps"]:
                changes[s["step"]].append((r["a"], r["b"], int(s["d"])))
        rounds += 1
        fresh, relist = relist, False
        for step, pair in enumerate(guess):
            best, n = _best(counts)
            if best != pair or not (n > cutoff or (fresh and step == 0)):
                break
            new = "".join(pair)
            merges.append((len(merges), *pair, new, n))
            done.append(pair)
            for a, b, d in changes[step]:
                # A pair below the list may only have lost: it stays below.
                if (a, b) in counts or d > cutoff:
                    counts[a, b] = counts.get((a, b), 0) + d
            counts = {p: c for p, c in counts.items() if c > 0}
            again = new in made
            made.add(new)
            if again:
                relist = True
                break
        relist = relist or not counts or _best(counts)[1] <= cutoff
    schema = "rank int, left string, right string, merged string, n bigint"
    return spark.createDataFrame(merges, schema)


def merge_ranks(merges: Sequence[tuple[str, str]]) -> dict[tuple[str, str], int]:
    """``(left, right) -> rank`` for :func:`apply_merges`."""
    ranks: dict[tuple[str, str], int] = {}
    for r, pair in enumerate(merges):
        ranks.setdefault(tuple(pair), r)
    return ranks


def apply_merges(word: str, merges) -> list[str]:
    """Split ``word`` into learned pieces: repeatedly merge every occurrence
    (left to right) of the adjacent pair with the lowest rank.

    Same result as replaying the merges in rank order. The symbols are a linked
    list and the mergeable pairs a heap of (rank, place), so a word of n symbols
    takes n log n steps: each merge takes one pair off the list and looks at the
    two new neighbours alone. ``merges`` is a rank dict or a list of pairs.
    """
    ranks = merges if isinstance(merges, dict) else merge_ranks(merges)
    syms = list(word)
    n = len(syms)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((syms[i], syms[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        # All places of the lowest rank, left to right, before pairs that its merges make.
        lowest, places = heap[0][0], []
        while heap and heap[0][0] == lowest:
            places.append(heapq.heappop(heap)[1])
        merged = []
        for i in places:
            j = after[i]
            if syms[i] is None or j >= n or ranks.get((syms[i], syms[j])) != lowest:
                continue  # a merge to the left has taken one of the two
            syms[i] += syms[j]
            syms[j] = None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            merged.append(i)
        for i in merged:
            for k in (before[i], i):
                if k >= 0 and after[k] < n:
                    r = ranks.get((syms[k], syms[after[k]]))
                    if r is not None:
                        heapq.heappush(heap, (r, k))
    return [x for x in syms if x is not None]


def subword_pieces(
    df: DataFrame,
    key: Sequence[str],
    merges: DataFrame,
    col: str = "text",
    out: str = "pieces",
    pattern: str = "words",
) -> DataFrame:
    """H2, sub-word form: split ``col`` into learned sub-word pieces.

    One pass over the text, no shuffle: pre-tokens are cut in the JVM, and an
    Arrow-batched iterator UDF replays the merges (the merge list is bounded by
    ``n_merges`` and shipped once per task), each task remembering the pieces
    of the words it met last. A batch is cut and sent back some words at a time,
    so a worker never holds the pieces of a whole batch. Null texts have no pieces; ``key`` is not read.
    """
    from convprep.session import ship_package

    ship_package(df.sparkSession)  # the replay runs in executor Python workers
    # The merge list is bounded by n_merges; it ships to tasks with the closure.
    ranks = merge_ranks([(r["left"], r["right"]) for r in merges.orderBy("rank").collect()])

    @F.arrow_udf("array<string>")
    def _replay(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cut = functools.lru_cache(_REMEMBERED)(lambda w: apply_merges(w, ranks))
        for words in batches:
            lengths = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for lo, hi in bounded_runs(lengths, _AT_ONCE):
                coded = words.slice(lo, hi - lo).flatten().dictionary_encode()
                known = pa.array([cut(w) for w in coded.dictionary.to_pylist()], pa.list_(pa.string()))
                pieces = known.take(coded.indices)
                ends = np.concatenate([[0], np.cumsum(pieces.value_lengths().to_numpy(zero_copy_only=False))])
                offsets = ends[np.concatenate([[0], np.cumsum(lengths[lo:hi])])]
                yield pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pieces.flatten())

    return df.withColumn(out, _replay(pretokenize(col, pattern)))


def encode_subwords(
    df: DataFrame,
    key: Sequence[str],
    merges: DataFrame,
    col: str = "text",
    vocab: DataFrame | None = None,
    out: str = "ids",
    pattern: str = "words",
    keep: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """H2, sub-word form end to end: pieces (replayed once), a piece vocabulary
    (fitted when not given) and the id lists.
    Returns ``(df with pieces and out, vocab)``; with ``keep`` these columns
    and ``out``, the others are not written."""
    pieces = subword_pieces(df, key, merges, col, "pieces", pattern)
    if vocab is None:
        return fit_encode(pieces, ["pieces"], [out], keep=keep)
    if keep is not None:
        return encode(pieces, keep, ["pieces"], [out], vocab, join_back=False), vocab
    return encode(pieces, key, ["pieces"], [out], vocab), vocab


# ---------------------------------------------------------------- UDF hook


def apply_tokenizer(
    df: DataFrame,
    col: str,
    fn: Callable[[str], list] | None = None,
    out: str = "tokens",
    return_type: str = "array<string>",
    factory: Callable[[], Callable[[str], list]] | None = None,
) -> DataFrame:
    """plug in a user's tokenizer as an Arrow-batched pandas UDF.

    ``factory`` builds the tokenizer once per Python worker (iterator form),
    for tokenizers with loaded state; ``fn`` is used as is otherwise. Tokens are
    sent back some texts at a time, not a batch at once.
    """
    if fn is None and factory is None:
        raise ValueError("give fn or factory")
    from convprep.session import ship_package

    ship_package(df.sparkSession)

    @F.pandas_udf(return_type)
    def _tok(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = factory() if factory is not None else fn
        for s in batches:
            for lo, hi in bounded_runs([0 if t is None else len(t) for t in s], _AT_ONCE_CHARS):
                yield s.iloc[lo:hi].map(lambda t: None if t is None else list(f(t)))

    return df.withColumn(out, _tok(F.col(col)))


def ascii_blank_split(text: str) -> list[str]:
    """A plain-Python blank splitter equal to the ``(\\S+)`` pattern."""
    return re.findall(r"\S+", text, flags=re.ASCII)


__all__ = [
    "UNK_ID",
    "apply_merges",
    "apply_tokenizer",
    "ascii_blank_split",
    "decode",
    "encode",
    "encode_subwords",
    "fit_encode",
    "fit_subword_merges",
    "fit_vocabulary",
    "merge_ranks",
    "subword_pieces",
    "tokenize",
    "tokenize_dataset",
]


# Inventory names for the same operators.
encode_by_vocabulary = encode
decode_by_vocabulary = decode
__all__ += ["decode_by_vocabulary", "encode_by_vocabulary"]
