"""H3: merges learned by Spark equal a brute-force Python loop on a small
fixture taken from the documents table."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from convprep.functions.text import WORD_PATTERN
from convprep.operators.tokens import apply_merges, fit_subword_merges, subword_pieces
from convprep.plans import fixtures as fx


def brute_force(texts, n_merges, min_pair_count=2):
    import regex

    words = Counter()
    for t in texts:
        for w in regex.findall(WORD_PATTERN, t):
            words[tuple(w)] += 1
    merges = []
    for _ in range(n_merges):
        pairs = Counter()
        for w, c in words.items():
            for a, b in zip(w, w[1:]):
                pairs[(a, b)] += c
        cands = [(-c, p) for p, c in pairs.items() if c >= min_pair_count]
        if not cands:
            break
        negc, (a, b) = min(cands)
        merges.append((a, b, -negc))
        new = Counter()
        for w, c in words.items():
            out, i = [], 0
            while i < len(w):
                if i + 1 < len(w) and w[i] == a and w[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(w[i])
                    i += 1
            new[tuple(out)] += c
        words = new
    return merges


def test_merges_match_brute_force(spark):
    docs = fx.load(spark, SF_SMALL, "documents").orderBy("doc_id").limit(200)  # the small fixture
    texts = [r["text"] for r in docs.collect()]
    got = fit_subword_merges(docs, "text", n_merges=12).orderBy("rank").collect()
    exp = brute_force(texts, 12)
    assert [(r["left"], r["right"], r["n"]) for r in got] == exp


def test_apply_merges_left_to_right():
    assert apply_merges("aaaaa", [("a", "a")]) == ["aa", "aa", "a"]
    assert apply_merges("abab", [("a", "b"), ("ab", "ab")]) == ["abab"]


def test_pieces_concatenate_back_to_pretokens(spark):
    docs = fx.load(spark, SF_SMALL, "documents").select("doc_id", "text")
    merges = fit_subword_merges(docs, "text", n_merges=5)
    pieces = subword_pieces(docs, ["doc_id"], merges, "text")
    joined = pieces.select(F.array_join("pieces", "").alias("a"),
                           F.array_join(F.regexp_extract_all("text", F.lit(WORD_PATTERN), 1), "").alias("b"))
    assert joined.where(F.col("a") != F.col("b")).count() == 0


def test_batched_merges_of_equal_symbols_equal_one_by_one(spark):
    df = spark.createDataFrame([("aaaa",)] * 100 + [("bc",)] * 50, "text string")
    one, many = ([tuple(r) for r in fit_subword_merges(df, "text", n_merges=3, batch=b).orderBy("rank").collect()] for b in (1, 32))
    assert one == many and [r[3] for r in one] == ["aa", "aaaa", "bc"]


def test_rank_first_equals_sequential_replay():
    import random

    def replay(word, merges):
        syms = list(word)
        for a, b in merges:
            out, i = [], 0
            while i < len(syms):
                if i + 1 < len(syms) and syms[i] == a and syms[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(syms[i])
                    i += 1
            syms = out
        return syms

    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    merges = [m[:2] for m in brute_force(words, 15, min_pair_count=1)]
    for w in words:
        assert apply_merges(w, merges) == replay(w, merges), w


def test_encode_subwords_round_trip(spark):
    from convprep.operators.tokens import decode, encode_subwords

    docs = fx.load(spark, SF_SMALL, "documents").select("doc_id", "text")
    merges = fit_subword_merges(docs, "text", n_merges=8)
    enc, vocab = encode_subwords(docs, ["doc_id"], merges)
    dec = decode(enc, ["doc_id"], "ids", vocab, out="back", joiner="")
    joined = dec.select(F.col("back"), F.array_join(F.regexp_extract_all("text", F.lit(WORD_PATTERN), 1), "").alias("b"))
    assert joined.where(F.col("back") != F.col("b")).count() == 0
    assert enc.where(F.array_contains("ids", -1)).count() == 0


@pytest.mark.parametrize("n", [12, 40])
def test_batched_rounds_equal_one_merge_per_round(spark, n):
    docs = fx.load(spark, SF_SMALL, "documents").orderBy("doc_id").limit(200)
    texts = [r["text"] for r in docs.collect()]
    batched = fit_subword_merges(docs, "text", n_merges=n).orderBy("rank").collect()
    single = fit_subword_merges(docs, "text", n_merges=n, batch=1).orderBy("rank").collect()
    exp = brute_force(texts, n)
    assert [(r["left"], r["right"], r["n"]) for r in batched] == exp
    assert [(r["left"], r["right"], r["n"]) for r in single] == exp


def test_guess_starts_with_the_best_pair_and_stops_at_the_bound():
    from convprep.operators.tokens import _guess

    assert _guess({("a", "b"): 100, ("c", "d"): 100, ("x", "y"): 10}, 5, 10) == [("a", "b"), ("c", "d")]
    # every b follows an a: merging a, b moves the count of (b, c) to (ab, c)
    assert _guess({("a", "b"): 100, ("b", "c"): 90}, 2, 5) == [("a", "b"), ("ab", "c")]
    assert _guess({("a", "b"): 4}, 2, 4) == []


def test_replay_follows_its_index():
    from convprep.operators.tokens import _replay as replay_words

    words = [list("abab"), list("cab"), list("zzz"), list("abz")]
    plan = [("a", "b"), ("ab", "ab"), ("z", "z"), ("ab", "z")]
    seen = [(step, i) for step, i, _, _ in replay_words(words, plan)]
    assert words == [["abab"], ["c", "ab"], ["zz", "z"], ["abz"]]
    assert sorted(seen) == [(0, 0), (0, 1), (0, 3), (1, 0), (2, 2), (3, 3)]


@pytest.mark.parametrize("listed", [1, 5, 1024])
def test_any_length_of_the_list_gives_the_same_merges(spark, monkeypatch, listed):
    import random

    from convprep.operators import tokens

    monkeypatch.setattr(tokens, "_LISTED", listed)
    rng = random.Random(5)
    # few letters and long words: symbols made from several parts, ties, equal symbols
    texts = ["".join(rng.choices("abcd", weights=[5, 3, 2, 1], k=rng.randint(1, 30))) for _ in range(120)] + ["", "a", "aaaaaaa"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    got = fit_subword_merges(df, "text", n_merges=40, batch=16, checkpoint_every=3).orderBy("rank").collect()
    assert [(r["left"], r["right"], r["n"]) for r in got] == brute_force(texts, 40)


def test_merges_end_with_the_pairs(spark):
    df = spark.createDataFrame([("ab",)] * 3 + [("c",), ("de",)], "text string")
    got = fit_subword_merges(df, "text", n_merges=10).collect()
    assert [(r["left"], r["right"], r["n"]) for r in got] == [("a", "b", 3)]
    assert fit_subword_merges(df.limit(0), "text", n_merges=3).count() == 0


def test_many_merges_of_whole_documents_equal_brute_force(spark):
    docs = fx.load(spark, SF_SMALL, "documents")
    got = fit_subword_merges(docs, "text", n_merges=250).orderBy("rank").collect()
    exp = brute_force([r["text"] for r in docs.collect()], 250)
    assert [(r["left"], r["right"], r["n"]) for r in got] == exp


def _replay(word, ranks):
    syms = list(word)
    while True:
        best = min((ranks[p] for p in zip(syms, syms[1:]) if p in ranks), default=None)
        if best is None:
            return syms
        out, i = [], 0
        while i < len(syms):
            if i + 1 < len(syms) and ranks.get((syms[i], syms[i + 1])) == best:
                out.append(syms[i] + syms[i + 1])
                i += 2
            else:
                out.append(syms[i])
                i += 1
        syms = out


def test_merges_equal_a_replay_round_by_round():
    import random

    from convprep.operators.tokens import apply_merges, merge_ranks

    rng = random.Random(7)
    for _ in range(400):
        pieces, merges = list("abc"), []
        for _ in range(rng.randrange(1, 12)):
            pair = (rng.choice(pieces), rng.choice(pieces))
            merges.append(pair)
            pieces.append("".join(pair))
        rng.shuffle(merges)  # also lists that no fit would learn
        ranks = merge_ranks(merges)
        word = "".join(rng.choices("abc", k=rng.randrange(0, 40)))
        assert apply_merges(word, ranks) == _replay(word, ranks)


def test_time_of_merging_is_near_linear():
    import random
    import time

    from convprep.operators.tokens import apply_merges, merge_ranks

    rng = random.Random(1)
    ranks = merge_ranks([("a", "b"), ("ab", "c"), ("c", "a"), ("abc", "abc"), ("b", "b"), ("a", "a"), ("aa", "b")])

    def took(n):
        word = "".join(rng.choices("abc", k=n))
        t = time.perf_counter()
        assert "".join(apply_merges(word, ranks)) == word
        return time.perf_counter() - t

    took(2000)
    assert took(200_000) < 60 * max(0.005, min(took(20_000) for _ in range(3)))
