"""Steps whose rows stay narrow and whose batches stay small, whatever the input."""

import pytest
from pyspark.sql import functions as F

from convprep.functions.arrays import bounded_runs
from convprep.functions.text import pretokenize
from convprep.llm import substrings
from convprep.operators import lookup, tokens
from convprep.operators.vectors import control_vectors


def test_rows_are_coded_without_a_queue_of_value_arrays(spark, monkeypatch):
    plans = []

    def spy(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    stored = lookup.stored
    monkeypatch.setattr(lookup, "stored", spy)
    df = spark.createDataFrame([(i, f"a b{i % 3} a c ,") for i in range(20)] + [(20, None), (None, "")], "id long, text string")
    enc, vocab = tokens.fit_encode(df, [pretokenize("text")], ["ids"], keep=["id"])
    back = tokens.decode(enc, ["id"], "ids", vocab, join_back=False).collect()
    # The second stage reads the looked-up ids of the first: a UDF beside them would queue whole dictionaries.
    assert len(plans) == 2 and not [p for p in plans if "ArrowEvalPython" in p]
    assert {r["id"]: r["decoded"] for r in back} == {i: f"a b{i % 3} a c ," for i in range(20)} | {20: None, None: ""}


@pytest.mark.parametrize("with_keywords", [True, False])
def test_a_tokenized_set_sends_its_tokens_to_python_once(spark, monkeypatch, with_keywords):
    stages = []

    def spy(df, name):
        stages.append(df.columns)
        return stored(df, name)

    stored = lookup.stored
    rows = [(1, "a b  a", ["b", None, "a z"]), (1, "a b  a", ["b", None, "a z"]), (None, None, None), (2, "", [])]
    df = spark.createDataFrame(rows, "id long, text string, keywords array<string>")
    vocab = spark.createDataFrame([("a", 0), ("b", 1)], "tok string, id long")
    monkeypatch.setattr(lookup, "stored", spy)
    out = tokens.tokenize_dataset(df if with_keywords else df.drop("keywords"), vocab)
    # Kept token columns would pass the workers, and be written, beside the same arrays to code.
    assert stages == [["id", "text", *(["keywords", "used_keywords"] if with_keywords else []), "_cp"]]
    ids = "text_ids" if with_keywords else "token_ids"
    got = sorted(((r["id"], r["text"], r["tokenized_text"], r[ids]) for r in out.collect()), key=str)
    a = (1, "a b  a", ["a", "b", "a"], [0, 1, 0])
    assert got == sorted([a, a, (2, "", [], []), (None, None, None, None)], key=str)
    if with_keywords:
        first = out.where("id = 2 or id is null").select("used_keywords", "tokenized_keywords", "keyword_ids").collect()
        assert [tuple(r) for r in first] == [([], [], [])] * 2
        full = out.where("id = 1").selectExpr("used_keywords", "tokenized_keywords", "keyword_ids").collect()
        assert [tuple(r) for r in full] == [(["a z", None, "b"], None, None)] * 2


@pytest.mark.parametrize("sizes, most, want", [
    ([], 5, [(0, 0)]), ([1, 1], 5, [(0, 2)]), ([9, 1, 1], 2, [(0, 1), (1, 3)]), ([0, 0, 2, 0], 2, [(0, 3), (3, 4)]),
])
def test_bounded_runs(sizes, most, want):
    assert list(bounded_runs(sizes, most)) == want


def test_tokens_and_pieces_come_back_some_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(tokens, "_AT_ONCE_CHARS", 6)
    monkeypatch.setattr(tokens, "_AT_ONCE", 3)
    df = spark.createDataFrame([(i, "abab ab" if i % 5 else None) for i in range(40)], "id long, text string").coalesce(1)
    got = tokens.apply_tokenizer(df, "text", tokens.ascii_blank_split)
    assert {r["id"]: r["tokens"] for r in got.collect()} == {i: ["abab", "ab"] if i % 5 else None for i in range(40)}
    merges = spark.createDataFrame([(0, "a", "b")], "rank int, left string, right string")
    pieces = tokens.subword_pieces(df, ["id"], merges)
    assert {r["id"]: r["pieces"] for r in pieces.collect()} == {i: ["ab", "ab", " ", "ab"] if i % 5 else [] for i in range(40)}


def test_encode_subwords_writes_the_kept_columns_alone(spark):
    df = spark.createDataFrame([(1, "abab"), (2, None)], "id long, text string")
    merges = spark.createDataFrame([(0, "a", "b")], "rank int, left string, right string")
    enc, vocab = tokens.encode_subwords(df, ["id"], merges, keep=["id"])
    assert enc.columns == ["id", "ids"] and {r["id"]: r["ids"] for r in enc.collect()} == {1: [0, 0], 2: []}
    again, _ = tokens.encode_subwords(df, ["id"], merges, vocab=vocab, keep=["id"])
    assert sorted(again.collect()) == sorted(enc.collect())


def test_control_vectors_look_an_id_up_once_a_block(spark):
    emb = spark.createDataFrame([(0, [0.0, 2.0]), (1, [1.0, 4.0]), (1, [3.0, 0.0]), (2, None)], "token_id long, embedding array<double>")
    df = spark.createDataFrame([(1, [0] * 50 + [1]), (1, [None, 0]), (2, [5, 2]), (None, [])], "id long, keyword_ids array<long>")
    out = control_vectors(df, "id", emb, dim=2, seed=4, skip_missing=True)
    # Only the distinct ids of a block are joined to the vectors; no row of ids is exploded.
    assert "explode_outer" not in (plan := out._jdf.queryExecution().toString()) and "FlatMapCoGroupsInArrow" in plan
    got = [(r["id"], r["n_vectors"], [round(x, 9) for x in r["vector"]]) for r in out.collect() if r["n_vectors"]]
    assert sorted(got) == [(1, 1, [0.0, 2.0]), (1, 52, [round(4 / 52, 9), round(104 / 52, 9)])]
    with pytest.raises(Exception, match="no embedding for 2|no embedding for 5"):
        control_vectors(df, "id", emb, dim=2).collect()


@pytest.mark.parametrize("size", [2, 200_000])
def test_narrow_lookup_takes_a_blocks_values_once(spark, size):
    rows = [(i % 3 or None, ["a", None, "zz", "c"][: i % 5] if i % 4 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x array<string>")
    table = spark.createDataFrame([("a", 1), ("c", 3)], "k string, v long")

    def run(value_type="bigint", **kw):
        out = lookup.lookup_arrays(df, ["id"], ["x"], ["y"], table, "k", "v", value_type, join_back=False, block_elements=size, **kw)
        # Else each row is written beside all values of its block.
        assert "FlatMapCoGroupsInArrow" in out._jdf.queryExecution().toString()
        return sorted((str(r["id"]), str(r["y"])) for r in out.collect())

    def want(fn):
        return sorted((str(i), str(None if x is None else fn(x))) for i, x in rows)

    val = {"a": 1, "c": 3}
    assert run() == want(lambda x: [val.get(e) for e in x])
    assert run(default=-1) == want(lambda x: [val.get(e, -1) for e in x])
    assert run(inner=True) == want(lambda x: [val[e] for e in x if e in val])
    assert run("string", default=lookup.SELF) == want(lambda x: [None if e is None else str(val.get(e, e)) for e in x])
    with pytest.raises(Exception, match="no v for"):
        run(default=lookup.FAIL)


def test_dense_index_writes_a_compressed_stage(spark):
    from convprep.operators.index import dense_index

    df = spark.createDataFrame([(i % 4, i) for i in range(50)], "g long, v long")
    out = dense_index(df, ["v"], out="n", partition_by=["g"])
    assert "parquet" in out._jdf.queryExecution().toString().lower()
    assert sorted(tuple(r) for r in out.collect()) == sorted((i % 4, i, i // 4) for i in range(50))


def test_stored_lists_are_parsed_once(spark):
    from convprep.operators.examples import stored_sequences

    df = spark.createDataFrame([(1, "[1,2]"), (2, None), (3, "[]")], "id long, token_ids string")
    got = stored_sequences(df, batch_size=3).collect()
    assert sorted((r["id"], r["padded_ids"]) for r in got) == [(1, [1, 2]), (3, [0, 0])]
    with pytest.raises(Exception, match="not a list of ids"):
        stored_sequences(spark.createDataFrame([(1, "[x")], df.schema), batch_size=3).collect()


def test_windows_of_hot_minimisers_come_back_as_runs(spark):
    part = "struct<mini:long,content:long,id:long,start:int,count:int,buckets:int>"
    words = [f"w{i}" for i in range(12)]
    other = [*words[:5], "x", *words[6:]]
    rows = [(" ".join(words), [(7, 1, 1, 0, 10, 2)]), (" ".join(other), [(7, 2, 2, 0, 10, 2)])]
    texts = spark.createDataFrame(rows, f"text string, parts array<{part}>")
    got = substrings._least_of_windows(texts, 3).collect()
    assert sorted((r["content"], r["at"], r["n"]) for r in got) == [(2, 0, 3), (2, 6, 4)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string")
    spans = substrings.repeated_spans(docs, window=3, gram=2, per_bucket=1)
    assert "explode(runs" not in spans._jdf.queryExecution().toString()
    assert spans.select(F.size("spans").alias("n")).collect()
