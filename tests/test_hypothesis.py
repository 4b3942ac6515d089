"""Generated inputs for the per-row functions, checked against plain Python
readings of the reference's rules. Each example is a batch of rows in one
DataFrame, so a handful of Spark jobs covers many cases."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from convprep.functions.arrays import pad_sequence, take_last, truncate_sequence
from convprep.functions.text import prepend_text, pretokenize, strip_sentiment, truncate_at_stop
from convprep.sources.tables import chunk_text

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
text = st.text(alphabet=st.sampled_from(list("ab .+-\n\t!é")), max_size=30)
words = st.lists(st.text(alphabet="abc+-", max_size=4), max_size=6)


@SETTINGS
@given(st.lists(st.tuples(text, st.sampled_from([".", "!", "ab", ""])), min_size=1, max_size=20))
def test_stop_cut_and_prompt(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "i long, r struct<t:string,s:string>").select("i", "r.*")
    for stop in {s for _, s in rows}:
        got = {r["i"]: r["x"] for r in df.select("i", truncate_at_stop("t", stop).alias("x")).collect()}
        assert got == {i: t[: t.find(stop) + 1] for i, (t, _) in enumerate(rows)}


@SETTINGS
@given(st.lists(st.tuples(text, words), min_size=1, max_size=20), st.integers(min_value=-1, max_value=8))
def test_prepend_take_last_strip(spark, rows, n):
    df = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(rows)], "i long, t string, k array<string>")
    out = df.select(
        "i", prepend_text("t", "k").alias("p"), take_last("k", n).alias("last"),
        F.transform("k", lambda x: strip_sentiment(x)).alias("s"),
    ).collect()
    for r in out:
        t, k = rows[r["i"]]
        expected = t
        for kw in k:
            expected = kw + " " + expected
        assert r["p"] == expected
        ks, popped = list(k), []
        for _ in range(max(n, 0)):
            if not ks:
                break
            popped.append(ks.pop())
        assert r["last"] == popped
        assert r["s"] == [x.rstrip("+-") for x in k]


@SETTINGS
@given(st.lists(st.lists(st.integers(min_value=0, max_value=99), max_size=12), min_size=1, max_size=20),
       st.integers(min_value=0, max_value=15))
def test_truncate_and_pad(spark, seqs, width):
    df = spark.createDataFrame(list(enumerate(seqs)), "i long, ids array<int>")
    out = df.select("i", truncate_sequence("ids", 5).alias("t"), pad_sequence("ids", width, 0).alias("p")).collect()
    for r in out:
        ids = seqs[r["i"]]
        assert r["t"] == ids[:5]
        assert r["p"] == ids + [0] * max(width - len(ids), 0)


@SETTINGS
@given(st.lists(text, min_size=1, max_size=20), st.integers(min_value=1, max_value=5), st.integers(min_value=1, max_value=5))
def test_blank_tokens_and_windows(spark, texts, size, step):
    import re

    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    toks = {r["i"]: r["w"] for r in df.select("i", pretokenize("text").alias("w")).collect()}
    ref = {i: re.findall(r"\S+", t, flags=re.ASCII) for i, t in enumerate(texts)}
    assert toks == ref
    if step > size:  # would lose the tokens between windows
        with pytest.raises(ValueError, match="step"):
            chunk_text(df, "i", "text", size, step)
        return
    got = sorted((r["i"], r["chunk"], r["text"]) for r in chunk_text(df, "i", "text", size, step).collect())
    exp = sorted((i, c, " ".join(w[s:s + size])) for i, w in ref.items() for c, s in enumerate(range(0, len(w), step)))
    assert got == exp
