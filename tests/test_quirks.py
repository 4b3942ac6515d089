"""Hand-written rows per quirk (SURVEY Appendix A); expected values come
from reading the reference's rules, checked with plain Python."""

import pytest
from pyspark.sql import functions as F

from convprep.functions.arrays import parse_id_list, take_last
from convprep.functions.text import prepend_text, strip_sentiment, truncate_at_stop
from convprep.operators.keywords import TOPIC_LINK_TYPE, prepare_keywords, translate_keywords
from convprep.operators.scores import top_k_filter, top_p_filter


def link(cluster, type_):
    return {"cluster": cluster, "phrase": "p", "phrase_synonym": "p", "disease": "", "type": type_}


@pytest.fixture()
def links(spark):
    rows = [
        (1, "t1", [link("c1", "quality+"), link("", "toxic-"), link("c1", "")]),  # empty type, empty cluster
        (2, "t2", [link("c2", "+"), link("c3", "sym+-+"), link("c2", "a+b")]),   # '+' alone, runs, inner '+'
        (3, "t3", None),                                                          # null list
        (4, "t4", []),
        (5, "t5", [link("x", "b"), link("y", "a"), link("x", "b")]),             # duplicates
    ]
    return spark.createDataFrame(rows, f"doc_id long, text string, topic_links {TOPIC_LINK_TYPE}")


def _collect(df, col="keywords"):
    return {r["id"]: r[col] for r in df.collect()}


def test_type_keywords_strip_and_dedupe(links):
    got = _collect(prepare_keywords(links, "doc_id", "text"))
    assert got == {1: ["quality", "toxic"], 2: ["", "sym", "a+b"], 3: [], 4: [], 5: ["b", "a"]}


def test_sentiment_and_cluster_lists_not_cross_deduped(links):
    got = _collect(prepare_keywords(links, "doc_id", "text", sentiment=True, cluster=True))
    assert got[1] == ["quality+", "toxic-", "c1"]
    assert got[2] == ["+", "sym+-+", "a+b", "c2", "c3"]
    assert got[5] == ["b", "a", "x", "y"]


def test_strip_sentiment_rule(spark):
    df = spark.createDataFrame([("sym+-+",), ("a+b",), ("+",), ("plain",)], "t string")
    got = [r[0] for r in df.select(strip_sentiment("t")).collect()]
    assert got == ["sym", "a+b", "", "plain"] == [s.rstrip("+-") for s in ["sym+-+", "a+b", "+", "plain"]]


@pytest.fixture()
def kw(spark):
    rows = [(1, ["a", "b", "c"]), (2, ["quality", "toxic", "source"]), (3, None), (4, ["x", "y"]), (5, ["qa", "qb"])]
    return spark.createDataFrame(rows, "id long, keywords array<string>")


def _pop(keywords, n, synonyms):
    """Plain-Python reading of the reference's pop loop."""
    ks = list(keywords or [])
    rng = len(ks) if n is None else n
    out = []
    for _ in range(rng):
        if not ks:
            break
        k = ks.pop()
        out.append(synonyms.get(k, k) if synonyms is not None else k)
    if synonyms is not None:
        seen = []
        for x in out:
            if x not in seen:
                seen.append(x)
        out = seen
    return out


@pytest.mark.parametrize("n", [None, 0, 1, 2, 10])
@pytest.mark.parametrize("syn", [None, {"quality": "good", "toxic": "harmful", "qa": "same", "qb": "same"}])
def test_translate_keywords_dict(kw, n, syn):
    got = _collect(translate_keywords(kw, syn, n), "used_keywords")
    src = {r["id"]: r["keywords"] for r in kw.collect()}
    for i, ks in src.items():
        assert got[i] == _pop(ks, n, syn), (i, n)


@pytest.mark.parametrize("n", [None, 1])
def test_translate_keywords_join_path_equals_map_path(spark, kw, n):
    syn = {"quality": "good", "toxic": "harmful", "qa": "same", "qb": "same"}
    table = spark.createDataFrame(sorted(syn.items()), "keyword string, translation string")
    a = _collect(translate_keywords(kw, syn, n), "used_keywords")
    b = _collect(translate_keywords(kw, table, n), "used_keywords")
    assert a == b


def test_take_last_bounds(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "k array<string>")
    row = df.select(take_last("k", 0).alias("z"), take_last("k", 5).alias("big"), take_last("k").alias("all")).first()
    assert row["z"] == [] and row["big"] == ["c", "b", "a"] and row["all"] == ["c", "b", "a"]


def test_tie_at_kth_score_survives(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (1, 1, 4.0), (1, 2, 4.0), (1, 3, 3.0)], "g int, cand int, score double")
    kept = sorted(r["cand"] for r in top_k_filter(df, "g", "score", 2).collect())
    assert kept == [0, 1, 2]
    assert top_k_filter(df, "g", "score", None).count() == 4
    assert top_k_filter(df, "g", "score", 0).count() == 4


def test_top_p_keeps_first_and_min_keep(spark):
    df = spark.createDataFrame([(1, i, float(10 - i)) for i in range(6)], "g int, cand int, score double")
    assert [r["cand"] for r in top_p_filter(df, "g", "cand", "score", p=1e-9).collect()] == [0]
    kept = sorted(r["cand"] for r in top_p_filter(df, "g", "cand", "score", p=1e-9, min_keep=3).collect())
    assert kept == [0, 1, 2, 3]  # min_keep = m keeps m + 1 (flags cleared before the shift)


@pytest.mark.parametrize("text,stop,expected,kept", [
    ("Hello. World", ".", "Hello.", "Hello."),
    ("no mark", ".", "", "no mark"),
    ("a<eos>b", "<eos>", "a<", "a<"),
    ("abc", "", "a", "a"),
])
def test_truncate_at_stop(spark, text, stop, expected, kept):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(truncate_at_stop("t", stop).alias("x"), truncate_at_stop("t", stop, True).alias("y")).first()
    assert row["x"] == text[: text.find(stop) + 1] == expected
    assert row["y"] == kept


def test_prepend_text_reverses_keywords(spark):
    df = spark.createDataFrame([("text", ["k1", "k2"]), ("t", None)], "text string, keywords array<string>")
    got = [r[0] for r in df.select(prepend_text("text", "keywords")).collect()]
    expected = "text"
    for k in ["k1", "k2"]:
        expected = k + " " + expected
    assert got == [expected, "t"]


def test_malformed_id_list_is_null(spark):
    df = spark.createDataFrame([("[1, 2]",), ("[]",), ("[1, x]",), ("__import__('os')",)], "s string")
    got = [r[0] for r in df.select(parse_id_list("s")).collect()]
    assert got == [[1, 2], [], None, None]


def test_null_and_empty_sequences(spark):
    from convprep.operators.rows import drop_short_sequences, find_empty_sequences

    df = spark.createDataFrame([(0, [1, 2]), (1, [3]), (2, []), (3, None)], "row_id long, token_ids array<int>")
    assert [r[0] for r in drop_short_sequences(df).collect()] == [0]
    assert [r[0] for r in find_empty_sequences(df).collect()] == [2]


def test_drop_columns_raises_on_missing(spark):
    from convprep.operators.rows import drop_columns

    df = spark.createDataFrame([(1, "a")], "id long, text string")
    with pytest.raises(KeyError):
        drop_columns(df, ["nope"])
    assert drop_columns(df, ["id"]).columns == ["text"]


def test_unknown_kinds_raise(spark):
    from convprep.operators.examples import format_examples
    from convprep.operators.rows import project_schema
    from convprep.sources.messages import select_source

    df = spark.createDataFrame([(1, "a")], "id long, text string")
    with pytest.raises(ValueError):
        format_examples(df, "nope")
    with pytest.raises(ValueError):
        project_schema(df, "nope")
    with pytest.raises(TypeError):
        select_source(spark, 42, "text")


def test_registry_generates_keys_and_unknown_raises(spark):
    from convprep.sources.sinks import dataset, register_dataset

    df = spark.createDataFrame([(1, "a")], "id long, text string")
    k1 = register_dataset(df)
    k2 = register_dataset(df)
    assert k1 != k2 and k1.startswith("dataset_")
    assert dataset(spark, k1).count() == 1
    with pytest.raises(KeyError):
        dataset(spark, "no_such_set")


def test_control_vector_random_when_no_keyword(spark):
    from convprep.operators.vectors import control_vectors

    emb = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "token_id long, embedding array<float>")
    rows = spark.createDataFrame([(1, [0, 1, 1]), (2, []), (3, None)], "id long, keyword_ids array<long>")
    got = {r["id"]: r for r in control_vectors(rows, "id", emb, dim=2, seed=3).collect()}
    assert got[1]["n_vectors"] == 3 and [round(x, 6) for x in got[1]["vector"]] == [round(7 / 3, 6), round(10 / 3, 6)]
    assert got[2]["n_vectors"] == 0 and all(0 <= x < 1 for x in got[2]["vector"])
    again = {r["id"]: r for r in control_vectors(rows, "id", emb, dim=2, seed=3).collect()}
    assert again[2]["vector"] == got[2]["vector"]  # seeded, repeatable
    assert got[3]["n_vectors"] == 0


def test_ids_without_embedding_stop_the_run(spark):
    from convprep.operators.lookup import FAIL, lookup_arrays
    from convprep.operators.vectors import control_vectors, lookup_embeddings

    emb = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "token_id long, embedding array<double>")
    rows = spark.createDataFrame([(1, [0, 1]), (2, [1, 7])], "id long, keyword_ids array<long>")
    with pytest.raises(Exception, match="no embedding for 7"):
        control_vectors(rows, "id", emb, dim=2).collect()
    got = {r["id"]: r["n_vectors"] for r in control_vectors(rows, "id", emb, dim=2, skip_missing=True).collect()}
    assert got == {1: 2, 2: 1}
    ids = spark.createDataFrame([(0,), (0,), (7,)], "token_id long")
    with pytest.raises(Exception, match="no embedding for 7"):
        lookup_embeddings(ids, emb).collect()
    assert lookup_embeddings(ids, emb, skip_missing=True).count() == 2
    with pytest.raises(Exception, match="no embedding for 7"):
        lookup_arrays(rows, ["id"], ["keyword_ids"], ["v"], emb, "token_id", "embedding", "array<double>",
                      default=FAIL, key_type="bigint").collect()


def test_part_files_go_by_the_number_of_their_folder(spark):
    from convprep.sources.messages import file_order

    names = ["x/export=10/part-00000-9a1.c000.json", "x/export=2/part-00001-7.c000.json",
             "x/export=2/part-00000-8.c000.json", "x/message_3.json", "x/notes.json"]
    df = spark.createDataFrame([(n,) for n in names], "file_name string")
    got = [r[0] for r in df.orderBy(*file_order("file_name")).collect()]
    assert got == [names[4], names[2], names[1], names[3], names[0]]


def test_lookup_row_and_union_and_shuffle(spark):
    from convprep.operators.index import shuffle_rows
    from convprep.operators.rows import lookup_row
    from convprep.sources.messages import union_exports

    df = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "row_id long, text string")
    assert [r["text"] for r in lookup_row(df, 7, ["text"]).collect()] == ["t7"]
    a = spark.createDataFrame([(1, "x")], "id long, a string")
    b = spark.createDataFrame([(2, "y")], "id long, b string")
    u = union_exports([a, b, a])
    assert u.count() == 3 and sorted(u.columns) == ["a", "b", "id"]
    s1 = shuffle_rows(df, seed=5, epoch=0).toPandas().sort_values("rn")
    s2 = shuffle_rows(df, seed=5, epoch=1).toPandas().sort_values("rn")
    assert sorted(s1["row_id"]) == list(range(20)) and list(s1["rn"]) == list(range(20))
    assert list(s1["row_id"]) != list(s2["row_id"])


def test_max_len_per_batch(spark):
    from convprep.operators.examples import max_len_per_batch

    df = spark.createDataFrame([(0, 0, [1]), (0, 0, [1, 2, 3]), (0, 1, [4, 5])], "epoch int, batch_id long, ids array<int>")
    got = sorted((r["batch_id"], r["width"]) for r in max_len_per_batch(df).collect())
    assert got == [(0, 3), (0, 3), (1, 2)]


def test_map_lookup_or_self(spark):
    from convprep.functions.arrays import map_lookup_or_self

    df = spark.createDataFrame([("a",), ("z",)], "k string")
    m = F.create_map(F.lit("a"), F.lit("A"))
    assert [r[0] for r in df.select(map_lookup_or_self("k", m)).collect()] == ["A", "z"]


def test_prepare_keyword_dataset_registers(spark, links):
    from convprep.operators.tokens import fit_vocabulary, tokenize
    from convprep.plans.keyword_set import prepare_keyword_dataset
    from convprep.sources.sinks import dataset

    vocab = fit_vocabulary(tokenize(links, "text", "t"), ["t"])
    key, d10 = prepare_keyword_dataset(links, "doc_id", "text", vocab, key="kw_set", cluster=True)
    assert key == "kw_set" and dataset(spark, key).count() == links.count()
    assert d10.columns == ["id", "text", "keywords", "used_keywords", "tokenized_text",
                           "tokenized_keywords", "text_ids", "keyword_ids"]


def test_clean_decoded_blanks(spark):
    from convprep.functions.text import clean_decoded

    df = spark.createDataFrame([("hello , world ! ok .",)], "t string")
    assert df.select(clean_decoded("t")).first()[0] == "hello, world! ok."


def test_apply_tokenizer_factory_builds_state_once_per_worker(spark):
    import re

    from convprep.operators.tokens import apply_tokenizer

    def factory():
        pattern = re.compile(r"[a-z]+")  # state built once per Python worker
        return pattern.findall

    df = spark.createDataFrame([(1, "ab cd, ef"), (2, None), (3, "")], "id long, text string")
    got = {r["id"]: r["tokens"] for r in apply_tokenizer(df, "text", factory=factory).collect()}
    assert got == {1: ["ab", "cd", "ef"], 2: None, 3: []}
    with pytest.raises(ValueError):
        apply_tokenizer(df, "text")


def test_topic_link_field_argument_is_honoured(spark, links):
    """Q6: the reference ignores the argument and reads a fixed column."""
    renamed = links.withColumnRenamed("topic_links", "my_links")
    got = _collect(prepare_keywords(renamed, "doc_id", "text", topic_link_field="my_links"))
    assert got[1] == ["quality", "toxic"]


def test_cross_entropy_padding_counts_unless_masked(spark):
    """Q14: padding targets count in the loss by default; mask_padding drops them."""
    import math

    from convprep.operators.scores import cross_entropy, mean_cross_entropy

    rows = []
    for g, target in [(0, 1), (1, 0)]:  # group 1 has the pad id (0) as target
        for c, s in enumerate([0.5, 2.0, -1.0]):
            rows.append((g, c, s, target))
    df = spark.createDataFrame(rows, "g int, cand int, score double, target int")
    lse = math.log(sum(math.exp(x) for x in [0.5, 2.0, -1.0]))
    got = {r["g"]: r["loss"] for r in cross_entropy(df, "g", "cand", "score", "target").collect()}
    assert abs(got[0] - (lse - 2.0)) < 1e-12 and abs(got[1] - (lse - 0.5)) < 1e-12
    masked = mean_cross_entropy(cross_entropy(df, "g", "cand", "score", "target", mask_padding=True)).first()
    assert masked["n"] == 1 and abs(masked["mean_loss"] - (lse - 2.0)) < 1e-12


def test_top_p_on_zero_weights_keeps_first(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.0), (2, 0, 3.0), (2, 1, 1.0)], "g int, c int, w double")
    got = sorted((r["g"], r["c"]) for r in top_p_filter(df, "g", "c", "w", p=0.5, weight="w").collect())
    assert got == [(1, 0), (2, 0)]


def test_recommended_conf_bounds():
    from convprep.session import recommended_conf

    big = recommended_conf(100 * 2**40, executors=1000, cores_per_executor=8)
    assert big["spark.sql.shuffle.partitions"] == str(3 * 100 * 2**10)  # 1 GiB each, no cap
    small = recommended_conf(2**30, executors=2, cores_per_executor=4)
    assert int(small["spark.sql.shuffle.partitions"]) >= 16  # at least two waves
    assert big["spark.cleaner.referenceTracking.cleanCheckpoints"] == "true"
