"""Registered queries: one Spark callable per operator group, each with
its DuckDB oracle SQL over the same parquet tables.

Every query reads whole tables (or views Spark derives from them); no row
caps or id subsets. Arrays leave as ``'1,2,3'`` text, floats rounded to 6
places, counts as bigint, so both engines hash alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convprep.functions.arrays import ids_text
from convprep.functions.random import uniform_sql
from convprep.plans import fixtures as fx
from convprep.plans.fixtures import with_views
from convprep.plans.training_set import sender_training_set

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


# ----------------------------------------------------------------- C10

_SENDER = "user"


@register(
    "sender_training_set",
    with_views(
        """
select r.row_id, r.conv_id, r.turn, cast(len(ids[1:1023]) as bigint) as n_tokens,
       array_to_string(ids[1:1023], ',') as ids
from r join q using (row_id) where len(ids) >= 2""",
        "v_messages",
        extra=(
            ("s", """select conv_id, turn, content as text from v_messages
      where sender_name = 'user' and content is not null and type = 'Generic'"""),
            ("r", "select *, row_number() over (order by conv_id, turn) - 1 as row_id from s"),
            ("t", """select row_id, i - 1 as pos, w[i] as tok
      from (select row_id, w, unnest(range(1, len(w) + 1)) as i
            from (select row_id, regexp_extract_all(text, '(\\S+)', 1) as w from r))"""),
            ("v", """select tok, row_number() over (order by n desc, tok) - 1 as id
      from (select tok, count(*) as n from t group by tok)"""),
            ("q", "select row_id, list(id order by pos) as ids from t join v using (tok) group by row_id"),
        ),
    ),
)
def q_sender_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    msgs = fx.messages_view(fx.load(spark, sf_dir, "conversations"))
    ts, _ = sender_training_set(msgs, _SENDER)
    return ts.select("row_id", "conv_id", "turn", "n_tokens", ids_text("token_ids").alias("ids"))


# --------------------------------------------------- rows: P1-P10, A1, A2, T6


@register(
    "sender_messages",
    with_views(
        """select conv_id, turn, content as text from v_messages
where sender_name = 'assistant' and content is not null and type = 'Generic'""",
        "v_messages",
    ),
)
def q_sender_messages(spark, sf_dir):
    from convprep.operators.rows import rename_text
    from convprep.plans.training_set import select_sender_messages

    msgs = fx.messages_view(fx.load(spark, sf_dir, "conversations"))
    return rename_text(select_sender_messages(msgs, "assistant"), "content").select("conv_id", "turn", "text")


@register(
    "message_counts",
    with_views(
        """select sender_name, type, cast(count(*) as bigint) as n_rows from v_messages
where content is not null group by sender_name, type""",
        "v_messages",
    ),
)
def q_message_counts(spark, sf_dir):
    from convprep.operators.rows import count_rows, drop_missing_text

    msgs = fx.messages_view(fx.load(spark, sf_dir, "conversations"))
    return count_rows(drop_missing_text(msgs, "content"), by=["sender_name", "type"])


@register(
    "dense_index_documents",
    """select doc_id, cast(row_number() over (order by n_chars desc, doc_id) - 1 as bigint) as row_id
from documents""",
)
def q_dense_index_documents(spark, sf_dir):
    from convprep.operators.index import dense_index

    docs = fx.load(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return dense_index(docs, [F.desc("n_chars"), "doc_id"], out="row_id").select("doc_id", "row_id")


_SEQ_ORACLE_BASE = ("v_tokens", "v_vocab", "v_sequences")


def _encoded_documents(spark, sf_dir):
    """v_sequences in Spark: blank tokens -> fitted vocabulary -> ids."""
    from convprep.functions.text import pretokenize
    from convprep.operators.tokens import fit_encode

    docs = fx.load(spark, sf_dir, "documents").select("doc_id", "text")
    return fit_encode(docs, [pretokenize("text")], ["ids"], keep=["doc_id"])


@register(
    "vocabulary",
    with_views("select tok, id, cast(n as bigint) as n from v_vocab", "v_tokens", "v_vocab"),
)
def q_vocabulary(spark, sf_dir):
    from convprep.operators.tokens import fit_vocabulary, tokenize

    docs = tokenize(fx.load(spark, sf_dir, "documents").select("text"), "text", "tokens")
    return fit_vocabulary(docs, ["tokens"])


@register(
    "encode_documents",
    with_views(
        """select d.doc_id, cast(coalesce(len(s.ids), 0) as bigint) as n_ids,
       coalesce(array_to_string(s.ids, ','), '') as ids
from documents d left join v_sequences s using (doc_id)""",
        *_SEQ_ORACLE_BASE,
    ),
)
def q_encode_documents(spark, sf_dir):
    from convprep.functions.arrays import size_of

    enc, _ = _encoded_documents(spark, sf_dir)
    return enc.select("doc_id", size_of("ids").alias("n_ids"), ids_text("ids").alias("ids"))


@register(
    "decode_documents",
    """select doc_id, array_to_string(regexp_extract_all(text, '(\\S+)', 1), ' ') as decoded from documents""",
)
def q_decode_documents(spark, sf_dir):
    from convprep.operators.tokens import decode

    enc, vocab = _encoded_documents(spark, sf_dir)
    return decode(enc.select("doc_id", "ids"), ["doc_id"], "ids", vocab, join_back=False)


@register(
    "word_pretokens",
    """select doc_id, cast(len(w) as bigint) as n_pretokens, cast(len(list_distinct(w)) as bigint) as n_distinct,
       md5(array_to_string(w, '|')) as digest
from (select doc_id, regexp_extract_all(text, '( ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+)', 1) as w
      from documents)""",
)
def q_word_pretokens(spark, sf_dir):
    from convprep.functions.text import pretokenize

    docs = fx.load(spark, sf_dir, "documents").select("doc_id", pretokenize("text", "words").alias("w"))
    return docs.select(
        "doc_id",
        F.size("w").cast("bigint").alias("n_pretokens"),
        F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"),
        F.md5(F.array_join("w", "|")).alias("digest"),
    )


@register(
    "truncated_sequences",
    with_views(
        """select doc_id, cast(len(ids) as bigint) as n_before, cast(len(ids[1:1023]) as bigint) as n_after,
       array_to_string(ids[1:1023], ',') as ids
from v_sequences where len(ids[1:1023]) >= 2""",
        *_SEQ_ORACLE_BASE,
    ),
)
def q_truncated_sequences(spark, sf_dir):
    from convprep.functions.arrays import size_of, truncate_sequence
    from convprep.operators.rows import drop_short_sequences

    enc, _ = _encoded_documents(spark, sf_dir)
    cut = enc.select("doc_id", size_of("ids").alias("n_before"), truncate_sequence("ids", 1023).alias("ids"))
    kept = drop_short_sequences(cut, "ids", 2)
    return kept.select("doc_id", "n_before", size_of("ids").alias("n_after"), ids_text("ids").alias("ids"))


@register(
    "empty_sequences",
    """select doc_id as row_id from documents where len(regexp_extract_all(text, '(\\S+)', 1)) = 0""",
)
def q_empty_sequences(spark, sf_dir):
    from convprep.operators.rows import find_empty_sequences

    enc, _ = _encoded_documents(spark, sf_dir)
    return find_empty_sequences(enc.withColumnRenamed("doc_id", "row_id"), "ids", "row_id")


@register(
    "sequence_length_stats",
    """select lang, cast(min(n) as bigint) as min_len, cast(max(n) as bigint) as max_len,
       round(avg(n), 6) as avg_len, cast(count(*) as bigint) as n_rows,
       cast(quantile_cont(n, 0.5) as double) as median_len
from (select lang, len(regexp_extract_all(text, '(\\S+)', 1)) as n from documents) group by lang""",
)
def q_sequence_length_stats(spark, sf_dir):
    from convprep.functions.text import pretokenize
    from convprep.operators.rows import length_stats

    docs = fx.load(spark, sf_dir, "documents").select("lang", pretokenize("text").alias("tokens"))
    return length_stats(docs, "tokens", by=["lang"])


@register(
    "row_range",
    """select doc_id, row_id from (
  select doc_id, cast(row_number() over (order by doc_id) - 1 as bigint) as row_id from documents)
where row_id >= 100 and row_id < 200""",
)
def q_row_range(spark, sf_dir):
    from convprep.operators.index import dense_index
    from convprep.operators.rows import limit_rows

    docs = dense_index(fx.load(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])
    return limit_rows(docs, 100, 200).select("doc_id", "row_id")


@register(
    "tokenized_documents",
    with_views(
        """select d.doc_id as id, cast(len(regexp_extract_all(d.text, '(\\S+)', 1)) as bigint) as n_tokenized,
       coalesce(array_to_string(s.ids, ','), '') as token_ids
from documents d left join v_sequences s using (doc_id)""",
        *_SEQ_ORACLE_BASE,
    ),
)
def q_tokenized_documents(spark, sf_dir):
    from convprep.operators.rows import project_schema
    from convprep.operators.tokens import fit_vocabulary, tokenize, tokenize_dataset

    docs = fx.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    vocab = fit_vocabulary(tokenize(docs, "text", "tokens"), ["tokens"])
    d11 = project_schema(tokenize_dataset(docs, vocab), "tokenized")
    return d11.select("id", F.size("tokenized_text").cast("bigint").alias("n_tokenized"),
                      ids_text("token_ids").alias("token_ids"))


@register(
    "text_windows",
    """select doc_id, cast(k - 1 as bigint) as chunk, cast(len(w[s + 1: s + 128]) as bigint) as n_tokens,
       array_to_string(w[s + 1: s + 128], ' ') as text
from (select doc_id, w, unnest(range(0, len(w), 100)) as s, generate_subscripts(range(0, len(w), 100), 1) as k
      from (select doc_id, regexp_extract_all(text, '(\\S+)', 1) as w from documents) where len(w) > 0)""",
)
def q_text_windows(spark, sf_dir):
    from convprep.sources.tables import chunk_text

    return chunk_text(fx.load(spark, sf_dir, "documents"), "doc_id", "text", size=128, step=100)


# ------------------------------------- keywords: P11, H4, H6, H14, T5, J1, C2, C3

_KW_DEDUPE = "list_filter({l}, lambda x, i: list_position({l}, x) = i)"
_SYN_MAP = "MAP {'quality': 'good', 'toxic': 'harmful'}"

# K: keywords with cluster names, sentiment stripped (C2, cluster=True).
_KEYWORD_CTES = (
    ("kt", """select doc_id as id,
      list_transform(list_filter(topic_links, lambda x: len(x.type) > 0), lambda x: rtrim(x.type, '+-')) as t,
      list_transform(list_filter(topic_links, lambda x: len(x.cluster) > 0), lambda x: x.cluster) as c
      from v_topic_links"""),
    ("k", "select id, list_concat(" + _KW_DEDUPE.format(l="t") + ", " + _KW_DEDUPE.format(l="c") + ") as k from kt"),
)


def _keyword_source(spark, sf_dir):
    docs = fx.load(spark, sf_dir, "documents")
    return fx.topic_links_view(docs, fx.load(spark, sf_dir, "labels"), keep=("text",))


def _keywords(spark, sf_dir, sentiment=False, cluster=True):
    from convprep.operators.keywords import prepare_keywords

    return prepare_keywords(_keyword_source(spark, sf_dir), "doc_id", "text", "topic_links",
                            sentiment=sentiment, cluster=cluster)


@register(
    "topic_keywords",
    with_views(
        "select doc_id as id, array_to_string(" + _KW_DEDUPE.format(l="t") + ", '|') as keywords from ("
        "select doc_id, list_transform(list_filter(topic_links, lambda x: len(x.type) > 0), "
        "lambda x: rtrim(x.type, '+-')) as t from v_topic_links)",
        "v_topic_links",
    ),
)
def q_topic_keywords(spark, sf_dir):
    kw = _keywords(spark, sf_dir, sentiment=False, cluster=False)
    return kw.select("id", F.array_join("keywords", "|").alias("keywords"))


@register(
    "topic_keywords_cluster",
    with_views(
        "select doc_id as id, array_to_string(list_concat(" + _KW_DEDUPE.format(l="t") + ", "
        + _KW_DEDUPE.format(l="c") + "), '|') as keywords from ("
        "select doc_id, list_transform(list_filter(topic_links, lambda x: len(x.type) > 0), lambda x: x.type) as t, "
        "list_transform(list_filter(topic_links, lambda x: len(x.cluster) > 0), lambda x: x.cluster) as c "
        "from v_topic_links)",
        "v_topic_links",
    ),
)
def q_topic_keywords_cluster(spark, sf_dir):
    kw = _keywords(spark, sf_dir, sentiment=True, cluster=True)
    return kw.select("id", F.array_join("keywords", "|").alias("keywords"))


def _translated_sql(pick: str, translate: bool) -> str:
    r = f"list_transform({pick}, lambda x: coalesce({_SYN_MAP}[x], x))" if translate else pick
    used = _KW_DEDUPE.format(l="r") if translate else "r"
    return with_views(
        f"select id, array_to_string({used}, '|') as used_keywords from (select id, {r} as r from k)",
        "v_topic_links",
        extra=_KEYWORD_CTES,
    )


@register("translated_keywords", _translated_sql("list_reverse(k)", True))
def q_translated_keywords(spark, sf_dir):
    from convprep.operators.keywords import translate_keywords

    out = translate_keywords(_keywords(spark, sf_dir), fx.synonyms_view(spark), None)
    return out.select("id", F.array_join("used_keywords", "|").alias("used_keywords"))


@register("translated_keywords_last1", _translated_sql("list_reverse(k)[1:1]", True))
def q_translated_keywords_last1(spark, sf_dir):
    from convprep.operators.keywords import translate_keywords

    out = translate_keywords(_keywords(spark, sf_dir), fx.SYNONYMS, 1)
    return out.select("id", F.array_join("used_keywords", "|").alias("used_keywords"))


@register("picked_keywords", _translated_sql("list_reverse(k)[1:2]", False))
def q_picked_keywords(spark, sf_dir):
    from convprep.operators.keywords import translate_keywords

    out = translate_keywords(_keywords(spark, sf_dir), None, 2)
    return out.select("id", F.array_join("used_keywords", "|").alias("used_keywords"))


# D10 in DuckDB: used keywords (translated), their tokens and ids (-1 = unknown).
_D10_CTES = _KEYWORD_CTES + (
    ("kw", "select id, " + _KW_DEDUPE.format(l="r") + " as used from (select id, "
     f"list_transform(list_reverse(k), lambda x: coalesce({_SYN_MAP}[x], x)) as r from k)"),
    ("ktok", "select id, flatten(list_transform(used, lambda x: regexp_extract_all(x, '(\\S+)', 1))) as tk from kw"),
    ("ku", "select id, i, tk[i] as tok from (select id, tk, unnest(range(1, len(tk) + 1)) as i from ktok)"),
    ("ki", "select id, list(coalesce(v.vid, -1) order by i) as kids from ku "
     "left join (select tok, id as vid from v_vocab) v using (tok) group by id"),
    ("d10", """select k.id, k.k as keywords, kw.used, ktok.tk, coalesce(ki.kids, []) as kids,
       coalesce(s.ids, []) as tids, d.text
      from k join kw using (id) join ktok using (id) left join ki using (id)
      left join v_sequences s on s.doc_id = k.id join documents d on d.doc_id = k.id"""),
)
_D10_VIEWS = ("v_topic_links", "v_tokens", "v_vocab", "v_sequences")


def _d10(spark, sf_dir):
    from convprep.operators.tokens import fit_vocabulary, tokenize, tokenize_dataset

    docs = tokenize(fx.load(spark, sf_dir, "documents").select("text"), "text", "tokens")
    vocab = fit_vocabulary(docs, ["tokens"])
    return tokenize_dataset(_keywords(spark, sf_dir), vocab, synonyms=fx.SYNONYMS), vocab


@register(
    "tokenized_keywords",
    with_views(
        """select id, array_to_string(keywords, '|') as keywords, array_to_string(used, '|') as used_keywords,
       array_to_string(tk, '|') as tokenized_keywords, array_to_string(kids, ',') as keyword_ids,
       cast(len(tids) as bigint) as n_text_ids, array_to_string(tids, ',') as text_ids from d10""",
        *_D10_VIEWS,
        extra=_D10_CTES,
    ),
)
def q_tokenized_keywords(spark, sf_dir):
    d10, _ = _d10(spark, sf_dir)
    return d10.select(
        "id",
        F.array_join("keywords", "|").alias("keywords"),
        F.array_join("used_keywords", "|").alias("used_keywords"),
        F.array_join("tokenized_keywords", "|").alias("tokenized_keywords"),
        ids_text("keyword_ids").alias("keyword_ids"),
        F.size("text_ids").cast("bigint").alias("n_text_ids"),
        ids_text("text_ids").alias("text_ids"),
    )


# ------------------------------------------------- examples: C5, C8, C9, H5


@register(
    "examples_prepend_nospace",
    with_views(
        """select id, cast(len(kids) + len(tids) as bigint) as n_ids,
       array_to_string(list_concat(kids, tids), ',') as ids from d10""",
        *_D10_VIEWS,
        extra=_D10_CTES,
    ),
)
def q_examples_prepend_nospace(spark, sf_dir):
    from convprep.operators.examples import prepend_control_examples

    d10, _ = _d10(spark, sf_dir)
    ex = prepend_control_examples(d10)
    return ex.select("id", F.size("ids").cast("bigint").alias("n_ids"), ids_text("ids").alias("ids"))


@register(
    "examples_keyword",
    with_views(
        "select id, array_to_string(tids, ',') as text_ids, array_to_string(kids, ',') as keyword_ids from d10",
        *_D10_VIEWS,
        extra=_D10_CTES,
    ),
)
def q_examples_keyword(spark, sf_dir):
    from convprep.operators.examples import bag_of_words_examples

    d10, _ = _d10(spark, sf_dir)
    ex = bag_of_words_examples(d10)
    return ex.select("id", ids_text("text_ids").alias("text_ids"), ids_text("keyword_ids").alias("keyword_ids"))


@register(
    "examples_prepend_space",
    with_views(
        """select id, cast(count(*) as bigint) as n_ids, array_to_string(list(coalesce(v.vid, -1) order by i), ',') as ids
from (select id, i, w[i] as tok from (
        select id, w, unnest(range(1, len(w) + 1)) as i from (
          select id, regexp_extract_all(array_to_string(list_concat(list_reverse(keywords), [text]), ' '),
                                        '(\\S+)', 1) as w from d10)))
left join (select tok, id as vid from v_vocab) v using (tok) group by id""",
        *_D10_VIEWS,
        extra=_D10_CTES,
    ),
)
def q_examples_prepend_space(spark, sf_dir):
    from convprep.operators.examples import format_examples

    d10, vocab = _d10(spark, sf_dir)
    ex = format_examples(d10, "prepend_space", vocab=vocab, same_vocab=True)
    return ex.select("id", F.size("ids").cast("bigint").alias("n_ids"), ids_text("ids").alias("ids"))


@register(
    "prepended_text",
    with_views(
        "select id, md5(array_to_string(list_concat(list_reverse(keywords), [text]), ' ')) as digest from d10",
        *_D10_VIEWS,
        extra=_D10_CTES,
    ),
)
def q_prepended_text(spark, sf_dir):
    from convprep.functions.text import prepend_text

    kw = _keywords(spark, sf_dir)
    return kw.select("id", F.md5(prepend_text("text", "keywords")).alias("digest"))


# --------------------------------------- batches: W6, T4, P4, A7, H10, C6, C7, A8, F2


def _batch_sql(seqs_sql: str, batch_size: int, epochs: int, seed: int, final: str, views=_SEQ_ORACLE_BASE) -> str:
    return with_views(
        final,
        *views,
        extra=(
            ("seqs", seqs_sql),
            ("ep", f"select id, ids, unnest(range(0, {epochs})) as epoch from seqs"),
            ("rn", f"""select *, row_number() over (partition by epoch
                   order by md5(concat_ws(':', {seed}, epoch, id)), id) - 1 as rn from ep"""),
            ("b", f"select *, rn // {batch_size} as batch_id, rn % {batch_size} as pos_in_batch from rn"),
            ("w", "select *, max(len(ids)) over (partition by epoch, batch_id) as width from b"),
        ),
    )


_TRAIN_SEQS = "select doc_id as id, ids[1:1023] as ids from v_sequences where len(ids[1:1023]) >= 2"
_PADDED_FINAL = """select cast(epoch as bigint) as epoch, cast(batch_id as bigint) as batch_id,
       cast(pos_in_batch as bigint) as pos_in_batch, id, cast(width as bigint) as width,
       array_to_string(ids, ',') || repeat(',0', cast(width - len(ids) as integer)) as padded_ids from w"""


def _training_sequences(spark, sf_dir):
    from convprep.functions.arrays import truncate_sequence
    from convprep.operators.rows import drop_short_sequences

    enc, _ = _encoded_documents(spark, sf_dir)
    seqs = enc.select(F.col("doc_id").alias("id"), truncate_sequence("ids", 1023).alias("ids"))
    return drop_short_sequences(seqs, "ids", 2)


def _padded_out(df, extra=()):
    return df.select(
        F.col("epoch").cast("bigint").alias("epoch"), "batch_id", "pos_in_batch", "id",
        F.col("width").cast("bigint").alias("width"), ids_text("padded_ids").alias("padded_ids"), *extra,
    )


@register("padded_batches", _batch_sql(_TRAIN_SEQS, 4, 3, 7, _PADDED_FINAL))
def q_padded_batches(spark, sf_dir):
    from convprep.operators.examples import batch_examples

    return _padded_out(batch_examples(_training_sequences(spark, sf_dir), batch_size=4, epochs=3, seed=7))


@register(
    "epoch_rollup",
    _batch_sql(
        _TRAIN_SEQS, 4, 3, 7,
        """select cast(epoch as bigint) as epoch, round(sum(v) / sum(n), 6) as epoch_loss,
       round(avg(v), 6) as mean_batch_loss, cast(count(*) as bigint) as n_batches, cast(sum(n) as bigint) as n_samples
from (select epoch, batch_id, avg(len(ids)) as v, count(*) as n from b group by epoch, batch_id) group by epoch""",
    ),
)
def q_epoch_rollup(spark, sf_dir):
    from convprep.operators.examples import assign_examples
    from convprep.operators.scores import epoch_rollup

    assigned, _ = assign_examples(_training_sequences(spark, sf_dir), batch_size=4, epochs=3, seed=7)
    metrics = assigned.groupBy("epoch", "batch_id").agg(
        F.avg("n_ids").alias("value"), F.count(F.lit(1)).alias("n_samples"))
    out = epoch_rollup(metrics)
    return out.select(
        F.col("epoch").cast("bigint").alias("epoch"), F.round("epoch_loss", 6).alias("epoch_loss"),
        F.round("mean_batch_loss", 6).alias("mean_batch_loss"), "n_batches", "n_samples",
    )


@register(
    "batch_summaries",
    _batch_sql(
        _TRAIN_SEQS, 4, 3, 7,
        """select cast(epoch as bigint) as epoch, cast(batch_id as bigint) as batch_id, cast(count(*) as bigint) as n_rows,
       cast(max(width) as bigint) as width, cast(sum(len(ids)) as bigint) as n_ids from w group by epoch, batch_id""",
    ),
)
def q_batch_summaries(spark, sf_dir):
    import pandas as pd

    from convprep.operators.examples import apply_batch, batch_examples

    seqs = _training_sequences(spark, sf_dir).withColumn("n", F.size("ids"))
    padded = batch_examples(seqs, batch_size=4, epochs=3, seed=7, keep=["n"]).withColumnRenamed("n", "n_ids")

    def collate(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({
            "epoch": [int(pdf["epoch"].iloc[0])], "batch_id": [int(pdf["batch_id"].iloc[0])],
            "n_rows": [len(pdf)], "width": [int(pdf["padded_ids"].map(len).max())],
            "n_ids": [int(pdf["n_ids"].sum())],
        })

    schema = "epoch bigint, batch_id bigint, n_rows bigint, width bigint, n_ids bigint"
    return apply_batch(padded.select("epoch", "batch_id", "padded_ids", "n_ids"), collate, schema)


# --------------------------------------------------------- pairs: W5


@register(
    "next_token_pairs",
    with_views(
        """select doc_id, cast(pos as bigint) as pos, context, tok as target from (
  select doc_id, pos, tok, lag(tok) over (partition by doc_id order by pos) as context from v_tokens)
where pos >= 1""",
        "v_tokens",
    ),
)
def q_next_token_pairs(spark, sf_dir):
    from convprep.functions.text import pretokenize
    from convprep.operators.examples import next_token_pairs

    docs = fx.load(spark, sf_dir, "documents").select("doc_id", pretokenize("text").alias("tokens"))
    return next_token_pairs(docs, ["doc_id"], "tokens")


@register(
    "control_token_pairs",
    with_views(
        """select doc_id, cast(pos as bigint) as pos,
       lag(tok, 1, '<ctrl>') over (partition by doc_id order by pos) as context, tok as target from v_tokens""",
        "v_tokens",
    ),
)
def q_control_token_pairs(spark, sf_dir):
    from convprep.functions.text import pretokenize
    from convprep.operators.examples import previous_token_pairs

    docs = fx.load(spark, sf_dir, "documents").select("doc_id", pretokenize("text").alias("tokens"))
    return previous_token_pairs(docs, ["doc_id"], "tokens", ctrl="<ctrl>")


# ------------------------------------ scores: W1-W4, T1-T3, A9, C12 on v_logits

_LOGIT_CTES = (
    ("e1", "select *, exp(l - max(l) over (partition by vec_id)) as e from v_logits"),
    ("sm", "select *, e / sum(e) over (partition by vec_id) as p from e1"),
    ("cs", """select *, sum(p) over (partition by vec_id order by l desc, tok
                 rows between unbounded preceding and current row) as cum,
             row_number() over (partition by vec_id order by l desc, tok) as rk from sm"""),
    ("cp", "select *, lag(cum) over (partition by vec_id order by l desc, tok) as prev from cs"),
)


def _logits(spark, sf_dir):
    return fx.logits_view(fx.load(spark, sf_dir, "embeddings"))


def _logit_sql(final: str, extra=()) -> str:
    return with_views(final, "v_logits", extra=_LOGIT_CTES + tuple(extra))


@register("softmax_scores", _logit_sql("select vec_id, tok, round(p, 6) as p from sm"))
def q_softmax_scores(spark, sf_dir):
    from convprep.operators.scores import softmax_by_group

    out = softmax_by_group(_logits(spark, sf_dir), "vec_id", "l")
    return out.select("vec_id", "tok", F.round("p", 6).alias("p"))


@register("top_k_scores", _logit_sql(
    "select vec_id, tok from (select *, rank() over (partition by vec_id order by l desc) as r from v_logits) where r <= 5"))
def q_top_k_scores(spark, sf_dir):
    from convprep.operators.scores import top_k_filter

    return top_k_filter(_logits(spark, sf_dir), "vec_id", "l", 5).select("vec_id", "tok")


@register("cumulative_shares", _logit_sql("select vec_id, tok, round(cum, 6) as cum from cs"))
def q_cumulative_shares(spark, sf_dir):
    from convprep.operators.scores import cumulative_share, softmax_by_group

    sm = softmax_by_group(_logits(spark, sf_dir), "vec_id", "l")
    out = cumulative_share(sm, "vec_id", "tok", "l", "p")
    return out.select("vec_id", "tok", F.round("cum", 6).alias("cum"))


@register("sorted_scores", _logit_sql("select vec_id, tok, cast(rk as bigint) as rk from cs"))
def q_sorted_scores(spark, sf_dir):
    from convprep.operators.scores import sort_scores

    return sort_scores(_logits(spark, sf_dir), "vec_id", "tok", "l").select("vec_id", "tok", "rk")


@register("top_p_scores", _logit_sql("select vec_id, tok from cp where rk = 1 or prev <= 0.5"))
def q_top_p_scores(spark, sf_dir):
    from convprep.operators.scores import top_p_filter

    return top_p_filter(_logits(spark, sf_dir), "vec_id", "tok", "l", p=0.5).select("vec_id", "tok")


@register("top_p_min_keep", _logit_sql("select vec_id, tok from cp where rk = 1 or prev <= 0.01 or rk <= 4"))
def q_top_p_min_keep(spark, sf_dir):
    from convprep.operators.scores import top_p_filter

    return top_p_filter(_logits(spark, sf_dir), "vec_id", "tok", "l", p=0.01, min_keep=3).select("vec_id", "tok")


@register("argmax_scores", _logit_sql("select vec_id, tok from cs where rk = 1"))
def q_argmax_scores(spark, sf_dir):
    from convprep.operators.scores import argmax_by_group

    return argmax_by_group(_logits(spark, sf_dir), "vec_id", "tok", "l", out="tok")


def _draw_sql(src: str, seed: int, draws: int) -> tuple:
    u = uniform_sql(str(seed), "vec_id", "draw")
    return (
        ("dc", f"select *, max(cum) over (partition by vec_id) as tot from {src}"),
        ("dd", f"""select vec_id, draw, {u} * tot as x from (
               select vec_id, max(tot) as tot, unnest(range(0, {draws})) as draw from dc group by vec_id)"""),
        ("dp", """select dd.vec_id, cast(dd.draw as integer) as draw, arg_min(dc.tok, dc.cum) as tok
               from dd join dc on dd.vec_id = dc.vec_id and dc.cum >= dd.x group by dd.vec_id, dd.draw"""),
    )


@register("sampled_scores", _logit_sql("select vec_id, draw, tok from dp", _draw_sql("cs", 11, 3)))
def q_sampled_scores(spark, sf_dir):
    from convprep.operators.scores import sample_by_group

    return sample_by_group(_logits(spark, sf_dir), "vec_id", "tok", "l", seed=11, draws=3, out="tok")


@register(
    "cross_entropy_scores",
    _logit_sql("""select vec_id, round(ln(sum(exp(l - m))) + max(m) - max(case when tok = label then l end), 6) as loss
from (select *, max(l) over (partition by vec_id) as m from v_logits) group by vec_id"""),
)
def q_cross_entropy_scores(spark, sf_dir):
    from convprep.operators.scores import cross_entropy

    out = cross_entropy(_logits(spark, sf_dir), "vec_id", "tok", "l", "label")
    return out.select("vec_id", F.round("loss", 6).alias("loss"))


@register(
    "mean_cross_entropy",
    _logit_sql("""select round(avg(loss), 6) as mean_loss, cast(count(*) as bigint) as n from (
  select vec_id, ln(sum(exp(l - m))) + max(m) - max(case when tok = label then l end) as loss
  from (select *, max(l) over (partition by vec_id) as m from v_logits) group by vec_id)"""),
)
def q_mean_cross_entropy(spark, sf_dir):
    from convprep.operators.scores import cross_entropy, mean_cross_entropy

    out = mean_cross_entropy(cross_entropy(_logits(spark, sf_dir), "vec_id", "tok", "l", "label"))
    return out.select(F.round("mean_loss", 6).alias("mean_loss"), "n")


# Top-k 10, nucleus 0.9 on the renormalised kept scores, seeded draws.
_C12_CTES = (
    ("k1", "select * from (select *, rank() over (partition by vec_id order by l desc) as r from v_logits) where r <= 10"),
    ("k2", "select *, exp(l - max(l) over (partition by vec_id)) as e from k1"),
    ("k3", "select *, e / sum(e) over (partition by vec_id) as p from k2"),
    ("k4", """select *, sum(p) over (partition by vec_id order by l desc, tok
                rows between unbounded preceding and current row) as cum0,
            row_number() over (partition by vec_id order by l desc, tok) as rk0 from k3"""),
    ("k5", "select *, lag(cum0) over (partition by vec_id order by l desc, tok) as prev0 from k4"),
    ("k6", "select vec_id, tok, l from k5 where rk0 = 1 or prev0 <= 0.9"),
    ("k7", "select *, exp(l - max(l) over (partition by vec_id)) as e from k6"),
    ("k8", "select *, e / sum(e) over (partition by vec_id) as p from k7"),
    ("k9", """select *, sum(p) over (partition by vec_id order by l desc, tok
                rows between unbounded preceding and current row) as cum from k8"""),
)


@register("sampled_candidates", _logit_sql("select vec_id, draw, tok from dp", _C12_CTES + _draw_sql("k9", 5, 2)))
def q_sampled_candidates(spark, sf_dir):
    from convprep.operators.scores import sample_candidates

    return sample_candidates(_logits(spark, sf_dir), "vec_id", "tok", "l", k=10, p=0.9, seed=5, draws=2)


@register(
    "greedy_candidates",
    _logit_sql("select vec_id, cast(0 as integer) as draw, tok from cs where rk = 1"),
)
def q_greedy_candidates(spark, sf_dir):
    from convprep.operators.scores import sample_candidates

    return sample_candidates(_logits(spark, sf_dir), "vec_id", "tok", "l")


@register(
    "lineitem_nucleus",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey from (
  select *, row_number() over w as rk, lag(cum) over w as prev from (
    select *, sum(share) over (partition by l_orderkey order by l_extendedprice desc, l_linenumber, l_partkey, l_suppkey
                               rows between unbounded preceding and current row) as cum
    from (select *, l_extendedprice / sum(l_extendedprice) over (partition by l_orderkey) as share from lineitem))
  window w as (partition by l_orderkey order by l_extendedprice desc, l_linenumber, l_partkey, l_suppkey))
where rk = 1 or prev <= 0.5""",
)
def q_lineitem_nucleus(spark, sf_dir):
    from convprep.operators.scores import top_p_filter

    li = fx.load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    cut = top_p_filter(li, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "l_extendedprice",
                       p=0.5, weight="l_extendedprice")
    return cut.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


# ------------------------------------------- vectors: J2, A4, A5, H17, C11

_CTRL_SEED = 13


@register(
    "control_vectors",
    with_views(
        """select d.row_id, cast(coalesce(a.n, 0) as bigint) as n_vectors, cast(d.dim as bigint) as dim,
       round(coalesce(a.value, {u}), 6) as value
from (select row_id, unnest(range(0, 64)) as dim from m) d
left join a on a.row_id = d.row_id and a.dim = d.dim""",
        extra=(
            ("m", "select conv_id, turn, text, row_number() over (order by conv_id, turn) - 1 as row_id from conversations"),
            ("t", "select row_id, unnest(regexp_extract_all(text, '(\\S+)', 1)) as tok from m"),
            ("v", "select tok, row_number() over (order by n desc, tok) - 1 as id from (select tok, count(*) as n from t group by tok)"),
            ("f", "select t.row_id, e.embedding from t join v using (tok) join embeddings e on e.vec_id = v.id % (select count(*) from embeddings)"),
            ("a", """select row_id, i - 1 as dim, avg(embedding[i]::double) as value, count(*) as n
               from (select row_id, embedding, unnest(range(1, len(embedding) + 1)) as i from f) group by row_id, i"""),
        ),
    ).replace("{u}", uniform_sql(
        str(_CTRL_SEED), "d.row_id", "d.dim")),
)
def q_control_vectors(spark, sf_dir):
    from convprep.operators.vectors import control_vectors

    enc = _conversation_ids(spark, sf_dir)
    emb = fx.load(spark, sf_dir, "embeddings")
    vec = control_vectors(_on_vectors(enc, emb), "row_id", emb, ids="ids", dim=64, seed=_CTRL_SEED, emb_key="vec_id")
    return vec.select("row_id", "n_vectors", F.posexplode("vector").alias("dim", "value")).select(
        "row_id", "n_vectors", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


def _on_vectors(enc, emb):
    """Token ids as ids of the given vectors: id modulo their number, so every token has one."""
    n = emb.count()
    return enc.withColumn("ids", F.transform("ids", lambda i: (i % n).cast("int")))


def _conversation_ids(spark, sf_dir):
    """Messages with dense row ids, encoded with a vocabulary fitted on them."""
    from convprep.functions.text import pretokenize
    from convprep.operators.index import dense_index
    from convprep.operators.tokens import fit_encode

    conv = fx.load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    rows = dense_index(conv, ["conv_id", "turn"], out="row_id")
    return fit_encode(rows, [pretokenize("text")], ["ids"], keep=["row_id"])[0]


@register(
    "control_prefixed_inputs",
    with_views(
        """select m.row_id, cast(1 + coalesce(a.n, 0) as bigint) as n_positions,
       round(coalesce(a.first_mean, {u}), 6) as first_value,
       round(coalesce(a.last_first, coalesce(a.first_mean, {u})), 6) as last_value
from m left join a using (row_id)""",
        extra=(
            ("m", "select conv_id, turn, text, row_number() over (order by conv_id, turn) - 1 as row_id from conversations"),
            ("t", """select row_id, i - 1 as pos, w[i] as tok
               from (select row_id, w, unnest(range(1, len(w) + 1)) as i
                     from (select row_id, regexp_extract_all(text, '(\\S+)', 1) as w from m))"""),
            ("v", "select tok, row_number() over (order by n desc, tok) - 1 as id from (select tok, count(*) as n from t group by tok)"),
            ("f", "select t.row_id, t.pos, e.embedding from t join v using (tok) join embeddings e on e.vec_id = v.id % (select count(*) from embeddings)"),
            ("a", """select row_id, count(*) as n, avg(embedding[1]::double) as first_mean,
                      arg_max(embedding[1]::double, pos) as last_first from f group by row_id"""),
        ),
    ).replace("{u}", uniform_sql(
        str(_CTRL_SEED), "m.row_id", "0")),
)
def q_control_prefixed_inputs(spark, sf_dir):
    from convprep.operators.lookup import FAIL, lookup_arrays
    from convprep.operators.vectors import control_vectors, prefix_control

    emb = fx.load(spark, sf_dir, "embeddings")
    enc = _on_vectors(_conversation_ids(spark, sf_dir), emb)
    ctrl = control_vectors(enc, "row_id", emb, ids="ids", dim=64, seed=_CTRL_SEED, emb_key="vec_id")
    # J2 per position: the token vectors in order, looked up last, so that they are not shuffled.
    tokvecs = lookup_arrays(enc.join(ctrl, "row_id"), ["row_id", "vector"], ["ids"], ["vectors"], emb, "vec_id",
                            "embedding", "array<double>", default=FAIL, key_type="bigint", join_back=False)
    inputs = prefix_control(tokvecs, "vector", "vectors", "inputs")
    return inputs.select(
        "row_id",
        F.size("inputs").cast("bigint").alias("n_positions"),
        F.round(F.element_at(F.element_at("inputs", 1), 1), 6).alias("first_value"),
        F.round(F.element_at(F.element_at("inputs", -1), 1), 6).alias("last_value"),
    )


# -------------------------------------------------------------- corpus: A6


@register(
    "conversation_corpus",
    """select conv_id, md5(' ' || string_agg(text, ' ' order by turn)) as digest,
       cast(length(' ' || string_agg(text, ' ' order by turn)) as bigint) as n_chars
from conversations group by conv_id""",
)
def q_conversation_corpus(spark, sf_dir):
    from convprep.operators.corpus import concat_corpus

    conv = fx.load(spark, sf_dir, "conversations")
    out = concat_corpus(conv, "text", ["turn"], ["conv_id"])
    return out.select("conv_id", F.md5("corpus").alias("digest"), F.length("corpus").cast("bigint").alias("n_chars"))


# ------------------------------------------------- text: H4, H7, H8


@register(
    "message_text_functions",
    with_views(
        """select conv_id, turn, left(content, instr(content, '.')) as stop_cut,
       case when instr(content, '.') = 0 then content else left(content, instr(content, '.')) end as kept_cut,
       concat_ws(' ', sender_name, left(content, instr(content, '.'))) as prompted
from v_messages where content is not null""",
        "v_messages",
    ),
)
def q_message_text_functions(spark, sf_dir):
    from convprep.functions.text import prefix_prompt, truncate_at_stop

    msgs = fx.messages_view(fx.load(spark, sf_dir, "conversations")).dropna(subset=["content"])
    return msgs.select(
        "conv_id", "turn",
        truncate_at_stop("content", ".").alias("stop_cut"),
        truncate_at_stop("content", ".", keep_if_missing=True).alias("kept_cut"),
        prefix_prompt("sender_name", truncate_at_stop("content", ".")).alias("prompted"),
    )


@register(
    "stripped_types",
    with_views(
        """select doc_id, i - 1 as link, topic_links[i].type as raw_type, rtrim(topic_links[i].type, '+-') as keyword
from (select doc_id, topic_links, unnest(range(1, len(topic_links) + 1)) as i from v_topic_links)""",
        "v_topic_links",
    ),
)
def q_stripped_types(spark, sf_dir):
    from convprep.functions.text import strip_sentiment

    links = fx.topic_links_view(fx.load(spark, sf_dir, "documents"), fx.load(spark, sf_dir, "labels"))
    ex = links.select("doc_id", F.posexplode("topic_links").alias("link", "x"))
    return ex.select("doc_id", F.col("link").cast("bigint").alias("link"), F.col("x.type").alias("raw_type"),
                     strip_sentiment(F.col("x.type")).alias("keyword"))


# ------------------------------- sources and sinks: S1-S4, S7-S10, U1, C1, C7
# These write a Spark-derived stage into the shared checkpoint folder and read
# it back through the source operator under test.


# Conversations per export file in the round trips (the reference reads a
# handful of large export files, each with a long message list).
_CONVS_PER_EXPORT = 50


def _write_exports(spark, sf_dir, name, per_file=_CONVS_PER_EXPORT):
    """Export files from v_messages: ``{"messages": [...]}`` per file, each
    holding the messages of ``per_file`` consecutive conversations in order."""
    from convprep.session import scratch_path

    msgs = fx.messages_view(fx.load(spark, sf_dir, "conversations"))
    exports = msgs.groupBy(F.floor(F.col("conv_id") / per_file).alias("export")).agg(
        F.array_sort(F.collect_list(F.struct("conv_id", "turn", "sender_name", "content", "type"))).alias("messages"))
    path = scratch_path(spark, name)
    exports.write.partitionBy("export").json(path)
    return path


def _export_fields():
    from pyspark.sql import types as T

    from convprep.sources.messages import MESSAGE_FIELDS

    return T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType())]
                        + MESSAGE_FIELDS.fields)


@register(
    "message_export_roundtrip",
    with_views(
        f"""select conv_id, cast(row_number() over (partition by conv_id // {_CONVS_PER_EXPORT}
                                          order by conv_id, turn) - 1 as bigint) as pos,
       turn, sender_name, content, type from v_messages""",
        "v_messages",
    ),
)
def q_message_export_roundtrip(spark, sf_dir):
    from convprep.sources.messages import read_message_export

    path = _write_exports(spark, sf_dir, "exports")
    back = read_message_export(spark, f"{path}/export=*/*.json", _export_fields())
    return back.select("conv_id", "pos", "turn", "sender_name", "content", "type")


_CONVS_PER_NUMBERED = 8


@register(
    "numbered_export_rows",
    with_views(
        f"""select cast(row_number() over (order by conv_id // {_CONVS_PER_NUMBERED}, conv_id, turn) - 1 as bigint) as row_id,
       conv_id, turn, sender_name, content as text from v_messages where content is not null""",
        "v_messages",
    ),
)
def q_numbered_export_rows(spark, sf_dir):
    """Files numbered 0, 1, 2, ... 10, 11, ...: rows follow the numbers, not the names."""
    from convprep.sources.messages import load_comments

    path = _write_exports(spark, sf_dir, "numbered", _CONVS_PER_NUMBERED)
    rows = load_comments(spark, f"{path}/export=*/*.json", "content", kind="export", message_fields=_export_fields())
    return rows.select("row_id", "conv_id", "turn", "sender_name", "text")


@register(
    "records_roundtrip",
    with_views(
        """select cast(row_number() over (order by conv_id, turn) - 1 as bigint) as row_id, conv_id, turn,
       content as text from v_messages where content is not null""",
        "v_messages",
    ),
)
def q_records_roundtrip(spark, sf_dir):
    from convprep.session import scratch_path
    from convprep.sources.messages import load_comments

    msgs = fx.messages_view(fx.load(spark, sf_dir, "conversations"))
    path = scratch_path(spark, "records")
    msgs.write.json(path)
    schema = "conv_id bigint, turn bigint, sender_name string, content string, type string"
    out = load_comments(spark, path, "content", order=["conv_id", "turn"], kind="records", schema=schema)
    return out.select("row_id", "conv_id", "turn", "text")


@register(
    "keyed_records_roundtrip",
    with_views(
        """select cast(conv_id as varchar) || '_' || cast(turn as varchar) as id, content as text, sender_name
from v_messages where content is not null""",
        "v_messages",
    ),
)
def q_keyed_records_roundtrip(spark, sf_dir):
    from convprep.operators.rows import drop_missing_text
    from convprep.session import scratch_path
    from convprep.sources.messages import read_keyed_records

    msgs = fx.messages_view(fx.load(spark, sf_dir, "conversations"))
    # Stand-in files: one JSON object each, a record a line between an opening
    # line (an entry without a record) and a closing one.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    lines = msgs.select(
        F.pmod(F.xxhash64("conv_id", "turn"), F.lit(n)).alias("part"), F.lit(1).alias("ord"),
        F.concat(F.lit(',"'), key, F.lit('": '), F.to_json(F.struct("content", "sender_name"))).alias("value"))
    ends = spark.range(n).select(F.col("id").alias("part"), F.explode(F.expr(
        """array(struct(0 as ord, '{"": null' as value), struct(2 as ord, '}' as value))""")).alias("e"))
    lines = lines.unionByName(ends.select("part", "e.*"))
    path = scratch_path(spark, "keyed")
    lines.repartition(n, "part").sortWithinPartitions("part", "ord").drop("ord").write.partitionBy("part").text(path)
    out = read_keyed_records(spark, f"{path}/part=*", "struct<content:string,sender_name:string>", "content")
    return drop_missing_text(out, "text").select("id", "text", "sender_name")


@register(
    "per_sender_store",
    with_views("select conv_id, turn, sender_name, content, type from v_messages where sender_name = 'system'",
               "v_messages"),
)
def q_per_sender_store(spark, sf_dir):
    from convprep.operators.rows import filter_sender
    from convprep.session import scratch_path
    from convprep.sources.sinks import write_per_sender

    msgs = fx.messages_view(fx.load(spark, sf_dir, "conversations"))
    path = scratch_path(spark, "senders")
    write_per_sender(msgs, path)
    back = filter_sender(spark.read.parquet(path), "system")  # partition pruning
    return back.select("conv_id", "turn", "sender_name", "content", "type")


@register("stored_sequence_batches", _batch_sql(_TRAIN_SEQS, 2, 1, 3, _PADDED_FINAL))
def q_stored_sequence_batches(spark, sf_dir):
    from convprep.operators.examples import stored_sequences
    from convprep.session import scratch_path
    from convprep.sources.sinks import write_csv_table, write_dataset
    from convprep.sources.tables import read_csv_table

    seqs = _training_sequences(spark, sf_dir).select("id", F.col("ids").alias("token_ids"))
    stage = scratch_path(spark, "stage")
    write_dataset(seqs, stage)                      # S9: parquet stage
    csv = scratch_path(spark, "csv")
    write_csv_table(spark.read.parquet(stage), csv)  # S7: lists as JSON text
    stored = read_csv_table(spark, csv, schema="id bigint, token_ids string")  # S2
    return _padded_out(stored_sequences(stored, "token_ids", "id", batch_size=2, epochs=1, seed=3))


@register(
    "run_manifest",
    ORACLE["sender_training_set"].split("\nselect r.row_id")[0] + """
select 'conversations' as source, 'user' as sender, '1023' as max_tokens, '2' as min_tokens,
       cast(count(*) as bigint) as n_rows, cast(min(len(ids[1:1023])) as bigint) as min_len,
       cast(max(len(ids[1:1023])) as bigint) as max_len
from r join q using (row_id) where len(ids) >= 2""",
)
def q_run_manifest(spark, sf_dir):
    from convprep.sources.sinks import run_manifest

    msgs = fx.messages_view(fx.load(spark, sf_dir, "conversations"))
    ts, _ = sender_training_set(msgs, _SENDER)
    params = {"source": "conversations", "sender": _SENDER, "max_tokens": 1023, "min_tokens": 2}
    return run_manifest(spark, params, ts, "token_ids")


# ------------------------------------------------------ UDF hook: F1


@register(
    "udf_tokenize",
    """select doc_id, cast(len(w) as bigint) as n_tokens, md5(array_to_string(w, ' ')) as digest
from (select doc_id, regexp_extract_all(text, '(\\S+)', 1) as w from documents)""",
)
def q_udf_tokenize(spark, sf_dir):
    from convprep.operators.tokens import apply_tokenizer, ascii_blank_split

    docs = apply_tokenizer(fx.load(spark, sf_dir, "documents").select("doc_id", "text"), "text", ascii_blank_split)
    return docs.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"),
                       F.md5(F.array_join("tokens", " ")).alias("digest"))


# ------------------------------------------------------- sub-words: H3, H2


_MERGES = 10


def _subword_sql(final: str) -> str:
    """The sub-word fit in SQL, its rounds unrolled. A word's symbols stand
    between chr(1) and chr(2), so a plain left-to-right replace merges a pair.
    ``m`` has the merges, ``p`` the pieces of each pre-token of each document."""
    ctes = ["""tok as materialized (select doc_id, i, w[i] as w from (
  select doc_id, w, unnest(range(1, len(w) + 1)) as i from (
    select doc_id, regexp_extract_all(text, '( ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+)', 1) as w from documents)))""",
            """s0 as materialized (select w, n,
  chr(1) || array_to_string(regexp_extract_all(w, '(?s).'), chr(2) || chr(1)) || chr(2) as sym
  from (select w, count(*) as n from tok group by w))"""]
    for r in range(_MERGES):
        ctes += [f"""b{r} as materialized (
  select x[i] as a, x[i + 1] as b, cast(sum(n) as bigint) as n from (
    select n, x, unnest(range(1, len(x))) as i from (
      select n, string_split(substr(sym, 2, length(sym) - 2), chr(2) || chr(1)) as x from s{r}))
  group by all having sum(n) >= 2 order by n desc, a, b limit 1)""",
                 f"""s{r + 1} as materialized (select w, s.n, coalesce(replace(sym, chr(1) || a || chr(2) || chr(1) || b || chr(2),
  chr(1) || a || b || chr(2)), sym) as sym from s{r} s left join b{r} on true)"""]
    ctes.append("m as (" + " union all ".join(
        f"select {r} as rank, a as \"left\", b as \"right\", a || b as merged, n from b{r}" for r in range(_MERGES)) + ")")
    ctes.append(f"""p as materialized (select doc_id, i, string_split(substr(sym, 2, length(sym) - 2), chr(2) || chr(1)) as x
  from tok join s{_MERGES} using (w))""")
    return "with " + ",\n".join(ctes) + "\n" + final


@register("subword_merges", _subword_sql('select cast(rank as integer) as rank, "left", "right", merged, n from m'))
def q_subword_merges(spark, sf_dir):
    from convprep.operators.tokens import fit_subword_merges

    return fit_subword_merges(fx.load(spark, sf_dir, "documents"), "text", n_merges=_MERGES)


@register("subword_encode", _subword_sql("""select d.doc_id, cast(coalesce(n_ids, 0) as bigint) as n_ids,
       md5(coalesce(ids, '')) as digest from documents d left join (
  select doc_id, count(*) as n_ids, string_agg(id, ',' order by i, k) as ids
  from (select doc_id, i, unnest(x) as piece, unnest(range(1, len(x) + 1)) as k from p) join (
    select piece, row_number() over (order by count(*) desc, piece) - 1 as id
    from (select unnest(x) as piece from p) group by piece) using (piece)
  group by doc_id) using (doc_id)"""))
def q_subword_encode(spark, sf_dir):
    from convprep.operators.tokens import encode_subwords, fit_subword_merges

    docs = fx.load(spark, sf_dir, "documents").select("doc_id", "text")
    merges = fit_subword_merges(docs, "text", n_merges=_MERGES)
    enc, _ = encode_subwords(docs, ["doc_id"], merges, keep=["doc_id"])
    return enc.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), F.md5(ids_text("ids")).alias("digest"))


@register("subword_pieces", _subword_sql("""select d.doc_id, cast(coalesce(n, 0) as bigint) as n_pieces,
       md5(coalesce(t, '')) as digest from documents d left join (
  select doc_id, sum(len(x)) as n, string_agg(array_to_string(x, '|'), '|' order by i) as t
  from p group by doc_id) using (doc_id)"""))
def q_subword_pieces(spark, sf_dir):
    from convprep.operators.tokens import fit_subword_merges, subword_pieces

    docs = fx.load(spark, sf_dir, "documents").select("doc_id", "text")
    merges = fit_subword_merges(docs, "text", n_merges=_MERGES)
    out = subword_pieces(docs, ["doc_id"], merges, "text")
    return out.select("doc_id", F.size("pieces").cast("bigint").alias("n_pieces"),
                      F.md5(F.array_join("pieces", "|")).alias("digest"))


# --------------------------------------------- streaming parity (optional)


@register(
    "streamed_sender_tokens",
    with_views(
        """select conv_id, turn, cast(len(w[1:1023]) as bigint) as n_tokens, array_to_string(w[1:1023], ' ') as tokens
from (select conv_id, turn, regexp_extract_all(content, '(\\S+)', 1) as w from v_messages
      where sender_name = 'user' and content is not null and type = 'Generic')
where len(w[1:1023]) >= 2""",
        "v_messages",
    ),
)
def q_streamed_sender_tokens(spark, sf_dir):
    from convprep.session import scratch_path
    from convprep.streaming.messages import read_message_stream, run_available_now, sender_tokens

    src = _write_exports(spark, sf_dir, "stream-src")
    stream = sender_tokens(read_message_stream(spark, f"{src}/export=*/", _export_fields()), _SENDER)
    out = scratch_path(spark, "stream-out")
    run_available_now(stream, out, scratch_path(spark, "stream-ckpt"))
    back = spark.read.parquet(out)
    return back.select("conv_id", "turn", "n_tokens", F.array_join("tokens", " ").alias("tokens"))


# ----------------------------------------------- randomness: T4, A5 alone


@register(
    "shuffled_documents",
    """select doc_id, cast(row_number() over (order by md5(concat_ws(':', 42, 0, doc_id)), doc_id) - 1 as bigint) as rn
from documents""",
)
def q_shuffled_documents(spark, sf_dir):
    from convprep.operators.index import shuffle_rows

    docs = fx.load(spark, sf_dir, "documents").select("doc_id")
    return shuffle_rows(docs, seed=42, epoch=0, row_id="doc_id", out="rn").select("doc_id", "rn")


@register(
    "random_vectors",
    "select vec_id, cast(d - 1 as bigint) as dim, round({u}, 6) as value "
    "from (select vec_id, unnest(range(1, len(embedding) + 1)) as d from embeddings)".replace(
        "{u}", uniform_sql("21", "vec_id", "d - 1")),
)
def q_random_vectors(spark, sf_dir):
    from convprep.operators.vectors import random_vector

    emb = fx.load(spark, sf_dir, "embeddings")
    vec = emb.select("vec_id", random_vector(21, "vec_id", 64).alias("v"))
    return vec.select("vec_id", F.posexplode("v").alias("dim", "value")).select(
        "vec_id", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


# ------------------------------------------ bounded vocabulary (A10 + J3)

_TOP = 5000


@register(
    "encode_bounded_vocabulary",
    with_views(
        f"""select d.doc_id, cast(coalesce(len(s.ids), 0) as bigint) as n_ids,
       cast(coalesce(list_count(list_filter(s.ids, lambda x: x = -1)), 0) as bigint) as n_unknown,
       coalesce(array_to_string(s.ids, ','), '') as ids
from documents d left join (
  select doc_id, list(case when id < {_TOP} then id else -1 end order by pos) as ids
  from v_tokens join v_vocab using (tok) group by doc_id) s using (doc_id)""",
        "v_tokens", "v_vocab",
    ),
)
def q_encode_bounded_vocabulary(spark, sf_dir):
    from convprep.functions.text import pretokenize
    from convprep.operators.tokens import encode, fit_vocabulary

    docs = fx.load(spark, sf_dir, "documents").select("doc_id", "text")
    vocab = fit_vocabulary(docs, [pretokenize("text")], max_size=_TOP)
    enc = encode(docs, ["doc_id"], [pretokenize("text")], ["ids"], vocab, join_back=False)
    return enc.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_ids"),
        F.size(F.filter("ids", lambda x: x == -1)).cast("bigint").alias("n_unknown"),
        ids_text("ids").alias("ids"))


# ------------------------- bag-of-words batches: C9 + C6 with ragged keyword ids


@register(
    "keyword_batches",
    with_views(
        """select cast(epoch as bigint) as epoch, cast(batch_id as bigint) as batch_id,
       cast(pos_in_batch as bigint) as pos_in_batch, id, cast(width as bigint) as width,
       array_to_string(ids, ',') || repeat(',0', cast(width - len(ids) as integer)) as padded_ids,
       array_to_string(kids, ',') as keyword_ids
from (select *, max(len(ids)) over (partition by epoch, batch_id) as width from (
  select *, rn // 2 as batch_id, rn % 2 as pos_in_batch from (
    select *, row_number() over (partition by epoch order by md5(concat_ws(':', 9, epoch, id)), id) - 1 as rn
    from (select id, tids as ids, kids, unnest(range(0, 2)) as epoch from d10))))""",
        *_D10_VIEWS,
        extra=_D10_CTES,
    ),
)
def q_keyword_batches(spark, sf_dir):
    from convprep.operators.examples import bag_of_words_examples, batch_examples

    d10, _ = _d10(spark, sf_dir)
    ex = bag_of_words_examples(d10).withColumnRenamed("text_ids", "ids")
    padded = batch_examples(ex, batch_size=2, epochs=2, seed=9, keep=["keyword_ids"])
    return _padded_out(padded, extra=[ids_text("keyword_ids").alias("keyword_ids")])


# ------------------------------ vocabulary over the letter/number split (A10, H1)


@register(
    "word_vocabulary",
    """select tok, cast(row_number() over (order by n desc, tok) - 1 as integer) as id, cast(n as bigint) as n
from (select tok, count(*) as n from (
        select unnest(regexp_extract_all(text, '( ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+)', 1)) as tok
        from documents) group by tok)""",
)
def q_word_vocabulary(spark, sf_dir):
    from convprep.functions.text import pretokenize
    from convprep.operators.tokens import fit_vocabulary

    docs = fx.load(spark, sf_dir, "documents").select("text")
    return fit_vocabulary(docs, [pretokenize("text", "words")])


# -------------------- nucleus cut in hot-group mode (W4 over range partitions)


@register(
    "supplier_nucleus_hot",
    """select l_suppkey, l_orderkey, l_linenumber, l_partkey from (
  select *, row_number() over w as rk,
         coalesce(sum(l_extendedprice) over (w rows between unbounded preceding and 1 preceding), 0)
           / sum(l_extendedprice) over (partition by l_suppkey) as prev
  from lineitem
  window w as (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey))
where rk = 1 or prev <= 0.5""",
)
def q_supplier_nucleus_hot(spark, sf_dir):
    from convprep.operators.scores import top_p_filter

    li = fx.load(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey",
                                                   "l_extendedprice")
    # Per supplier: the lines that cover half its revenue. A supplier may
    # hold a large share of all lines, so the running shares come from range
    # partitions rather than one task per supplier.
    cut = top_p_filter(li, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"], "l_extendedprice",
                       p=0.5, weight="l_extendedprice", hot_groups=True)
    return cut.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


@register(
    "line_nucleus_by_weight",
    """select l_linenumber, l_orderkey, l_partkey, l_suppkey, l_quantity from (
  select *, row_number() over w as rk,
         coalesce(sum(l_quantity) over (w rows between unbounded preceding and 1 preceding), 0)
           / sum(l_quantity) over (partition by l_linenumber) as prev
  from lineitem
  window w as (partition by l_linenumber order by l_quantity desc, l_orderkey, l_partkey, l_suppkey))
where rk = 1 or prev <= 0.25""",
)
def q_line_nucleus_by_weight(spark, sf_dir):
    from convprep.operators.scores import top_p_filter

    li = fx.load(spark, sf_dir, "lineitem").select("l_linenumber", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    # Seven groups of very different size, each a large share of the table: the
    # sketch finds those above the bound and only they are split.
    return top_p_filter(li, "l_linenumber", ["l_orderkey", "l_partkey", "l_suppkey"], "l_quantity",
                        p=0.25, weight="l_quantity", heavy_rows=8_000)


@register(
    "supplier_draws_hot",
    """with c as (
  select l_suppkey, concat_ws('-', l_orderkey, l_linenumber, l_partkey) as line,
         sum(l_extendedprice) over (partition by l_suppkey
             order by l_extendedprice desc, concat_ws('-', l_orderkey, l_linenumber, l_partkey)
             rows between unbounded preceding and current row) as cum
  from lineitem),
t as (select l_suppkey, max(cum) as tot from c group by l_suppkey),
d as (select l_suppkey, unnest(range(0, 5)) as draw, tot from t),
dx as (select l_suppkey, draw, """ + uniform_sql("17", "l_suppkey", "draw") + """ * tot as x from d)
select dx.l_suppkey, cast(dx.draw as integer) as draw, arg_min(c.line, c.cum) as line
from dx join c on c.l_suppkey = dx.l_suppkey and c.cum >= dx.x
group by dx.l_suppkey, dx.draw""",
)
def q_supplier_draws_hot(spark, sf_dir):
    from convprep.operators.scores import sample_by_group

    li = fx.load(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_extendedprice",
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("line"))
    # Five seeded draws per supplier, proportional to line revenue; a supplier
    # may hold a large share of all lines, so the draw runs over range partitions.
    return sample_by_group(li, "l_suppkey", "line", "l_extendedprice", seed=17, draws=5,
                           weight="l_extendedprice", out="line", hot_groups=True)


# ------------------- rows with null and repeated keys: J1, J3 by row, not by key


@register(
    "encode_repeated_ids",
    """with m as (select row_number() over () as r, case when turn % 3 = 0 then null else conv_id end as id, text
  from conversations),
t as (select r, i, w[i] as tok from (
  select r, w, unnest(range(1, len(w) + 1)) as i from (
    select r, regexp_extract_all(text, '(\\S+)', 1) as w from m))),
v as (select tok, row_number() over (order by n desc, tok) - 1 as vid from (select tok, count(*) as n from t group by tok)),
s as (select r, list(vid order by i) as ids from t join v using (tok) group by r)
select id, text, coalesce(array_to_string(s.ids, ','), '') as ids from m left join s using (r)""",
)
def q_encode_repeated_ids(spark, sf_dir):
    from convprep.functions.text import pretokenize
    from convprep.operators.tokens import encode, fit_vocabulary

    conv = fx.load(spark, sf_dir, "conversations").select(
        F.when(F.col("turn") % 3 != 0, F.col("conv_id")).alias("id"), "text")
    vocab = fit_vocabulary(conv, [pretokenize("text")])
    enc = encode(conv, ["id"], [pretokenize("text")], ["ids"], vocab)
    return enc.select("id", "text", F.coalesce(ids_text("ids"), F.lit("")).alias("ids"))


_ROWS = """m as (select row_number() over () as r, conv_id, turn, text,
       case when turn % 3 = 0 then null else turn % 3 end as id from conversations)"""
_ROW_IDS = _ROWS + """,
t as (select r, i, w[i] as tok from (
  select r, w, unnest(range(1, len(w) + 1)) as i from (
    select r, regexp_extract_all(text, '(\\S+)', 1) as w from m))),
v as (select tok, row_number() over (order by n desc, tok) - 1 as vid from (select tok, count(*) as n from t group by tok)),
s as (select r, list(vid order by i) as ids from t join v using (tok) group by r)"""


def _repeated_ids(spark, sf_dir):
    """Messages whose id is null or one of two numbers, and their token ids."""
    from convprep.functions.text import pretokenize
    from convprep.operators.tokens import fit_encode

    conv = fx.load(spark, sf_dir, "conversations").select(
        F.when(F.col("turn") % 3 != 0, F.col("turn") % 3).alias("id"), "conv_id", "turn", "text")
    return fit_encode(conv, [pretokenize("text")], ["ids"])[0]


_REPEATED_BATCHES = f"""with {_ROW_IDS},
q as (select id, s.ids, array_to_string(s.ids, ',') as tie, unnest(range(0, 2)) as epoch from m join s using (r)),
rn as (select *, row_number() over (partition by epoch order by md5(concat_ws(':', 5, epoch, id)), id nulls first, md5(tie)) - 1 as rn
       from q),
b as (select *, rn // 4 as batch_id, rn % 4 as pos_in_batch from rn),
w as (select *, max(len(ids)) over (partition by epoch, batch_id) as width from b)
{_PADDED_FINAL}"""


@register("batches_repeated_ids", _REPEATED_BATCHES)
def q_batches_repeated_ids(spark, sf_dir):
    from convprep.operators.examples import batch_examples

    ex = _repeated_ids(spark, sf_dir).where(F.size("ids") > 0).select("id", "ids")
    return _padded_out(batch_examples(ex, batch_size=4, epochs=2, seed=5))


@register("stored_repeated_ids", _REPEATED_BATCHES)
def q_stored_repeated_ids(spark, sf_dir):
    from convprep.operators.examples import stored_sequences
    from convprep.session import scratch_path
    from convprep.sources.sinks import write_dataset

    stage = scratch_path(spark, "stage")
    write_dataset(_repeated_ids(spark, sf_dir).where(F.size("ids") > 0).select("id", F.col("ids").alias("token_ids")), stage)
    return _padded_out(stored_sequences(spark.read.parquet(stage), batch_size=4, epochs=2, seed=5))


@register(
    "training_set_repeated_order",
    f"""with {_ROWS},
r as (select row_number() over (order by id nulls first, text) - 1 as row_id, id, text,
       regexp_extract_all(text, '(\\S+)', 1) as w from m)
select row_id, id, text, cast(len(w[1:1023]) as bigint) as n_tokens, array_to_string(w[1:1023], ' ') as tokens
from r where len(w) >= 2""",
)
def q_training_set_repeated_order(spark, sf_dir):
    """C10 with an order column that is null or repeats: every message keeps its own row and ids."""
    from convprep.operators.tokens import decode

    msgs = fx.load(spark, sf_dir, "conversations").select(
        F.when(F.col("turn") % 3 != 0, F.col("turn") % 3).alias("id"), F.lit("all").alias("sender_name"),
        F.col("text").alias("content"), F.lit("Generic").alias("type"))
    ts, vocab = sender_training_set(msgs, "all", order=["id"])
    back = decode(ts, ["row_id"], "token_ids", vocab, out="tokens")
    return back.select("row_id", "id", "text", "n_tokens", "tokens")


@register(
    "control_vectors_repeated_ids",
    f"""with {_ROW_IDS}
select id, cast(n as bigint) as n_vectors, round(v1, 6) as first_value, round(v64, 6) as last_value
from (select m.r, m.id, count(*) as n, avg(e.embedding[1]::double) as v1, avg(e.embedding[64]::double) as v64
      from m join t using (r) join v using (tok) join embeddings e on e.vec_id = v.vid % (select count(*) from embeddings)
      group by m.r, m.id)""",
)
def q_control_vectors_repeated_ids(spark, sf_dir):
    from convprep.operators.vectors import control_vectors

    emb = fx.load(spark, sf_dir, "embeddings")
    enc = _on_vectors(_repeated_ids(spark, sf_dir).where(F.size("ids") > 0), emb)
    vec = control_vectors(enc, "id", emb, ids="ids", dim=64, emb_key="vec_id")
    return vec.select("id", "n_vectors", F.round(F.element_at("vector", 1), 6).alias("first_value"),
                      F.round(F.element_at("vector", -1), 6).alias("last_value"))


@register(
    "translated_repeated_ids",
    with_views(
        f"""select case when id % 3 = 0 then null else id % 50 end as id,
       array_to_string({_KW_DEDUPE.format(l="r")}, '|') as used_keywords
from (select id, list_transform(list_reverse(k), lambda x: coalesce({_SYN_MAP}[x], x)) as r from k)""",
        "v_topic_links",
        extra=_KEYWORD_CTES,
    ),
)
def q_translated_repeated_ids(spark, sf_dir):
    from convprep.operators.keywords import translate_keywords

    kw = _keywords(spark, sf_dir).withColumn("id", F.when(F.col("id") % 3 != 0, F.col("id") % 50))
    out = translate_keywords(kw, fx.synonyms_view(spark), None)
    return out.select("id", F.array_join("used_keywords", "|").alias("used_keywords"))


# --------------------------------- frames, registry, lookups: S5, P2, P10, C4


@register("registered_documents", "select doc_id, text, source, n_chars from documents")
def q_registered_documents(spark, sf_dir):
    from convprep.operators.rows import drop_columns
    from convprep.sources.messages import from_table
    from convprep.sources.sinks import dataset, register_dataset

    docs = from_table(fx.load(spark, sf_dir, "documents").withColumnRenamed("text", "body"), "body")  # S5
    key = register_dataset(drop_columns(docs, ["lang"]))  # P2, C4
    return dataset(spark, key).select("doc_id", "text", "source", "n_chars")


@register(
    "row_lookup",
    """select row_id, conv_id, turn, text from (
  select conv_id, turn, text, row_number() over (order by conv_id, turn) - 1 as row_id from conversations)
where row_id = 17""",
)
def q_row_lookup(spark, sf_dir):
    from convprep.operators.index import dense_index
    from convprep.operators.rows import lookup_row

    conv = fx.load(spark, sf_dir, "conversations")
    found = lookup_row(dense_index(conv.select("conv_id", "turn"), ["conv_id", "turn"]), 17)
    return found.join(conv, ["conv_id", "turn"]).select("row_id", "conv_id", "turn", "text")


# ------------------------------------------------ list helpers: A3, H6, H14, H15


@register(
    "distinct_words",
    """select doc_id, cast(len(w) as bigint) as n_words, cast(len(list_distinct(w)) as bigint) as n_distinct
from (select doc_id, regexp_extract_all(text, '(\\S+)', 1) as w from documents)""",
)
def q_distinct_words(spark, sf_dir):
    from convprep.functions.arrays import dedupe, size_of
    from convprep.functions.text import pretokenize

    docs = fx.load(spark, sf_dir, "documents").select("doc_id", pretokenize("text").alias("w"))
    return docs.select("doc_id", size_of("w").alias("n_words"), size_of(dedupe("w")).alias("n_distinct"))


@register(
    "topic_fields",
    with_views(
        """select doc_id, array_to_string(list_transform(topic_links, lambda x: x.phrase), '|') as phrases,
       array_to_string(list_reverse(list_transform(topic_links, lambda x: x.type)), '|') as types_reversed
from v_topic_links""",
        "v_topic_links",
    ),
)
def q_topic_fields(spark, sf_dir):
    from convprep.functions.arrays import reverse_array, topic_field

    links = _keyword_source(spark, sf_dir)
    return links.select("doc_id", F.array_join(topic_field("topic_links", "phrase"), "|").alias("phrases"),
                        F.array_join(reverse_array(topic_field("topic_links", "type")), "|").alias("types_reversed"))


# ------------------------------------------------------ vectors: J2 and A4 alone


@register(
    "mean_embeddings",
    """select source, cast(n as bigint) as n_vectors, cast(i - 1 as bigint) as dim, round(value, 6) as value from (
  select source, i, avg(embedding[i]::double) as value, count(*) as n from (
    select d.source, e.embedding, unnest(range(1, len(e.embedding) + 1)) as i
    from documents d join embeddings e on e.vec_id = d.doc_id % (select count(*) from embeddings))
  group by source, i)""",
)
def q_mean_embeddings(spark, sf_dir):
    from convprep.operators.vectors import lookup_embeddings, mean_vector

    emb = fx.load(spark, sf_dir, "embeddings")
    ids = fx.load(spark, sf_dir, "documents").select("source", (F.col("doc_id") % emb.count()).alias("token_id"))
    found = lookup_embeddings(ids, emb, emb_key="vec_id")
    mean = mean_vector(found.withColumn("embedding", F.col("embedding").cast("array<double>")), ["source"])
    return mean.select("source", "n_vectors", F.posexplode("vector").alias("dim", "value")).select(
        "source", "n_vectors", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


# --------------------------------------- files: S2, S7, S11; corpus shards: A6


@register(
    "message_text_csv",
    with_views(
        """select conv_id, turn, '  ' || content || chr(9) || '"q", \\ ' || chr(10) || 'end ' as text
from v_messages where content is not null""",
        "v_messages",
    ),
)
def q_message_text_csv(spark, sf_dir):
    from convprep.session import scratch_path
    from convprep.sources.sinks import write_csv_table
    from convprep.sources.tables import read_csv_table

    msgs = fx.messages_view(fx.load(spark, sf_dir, "conversations")).dropna(subset=["content"])
    path = scratch_path(spark, "text-csv")
    write_csv_table(msgs.select("conv_id", "turn", F.concat(
        F.lit("  "), "content", F.lit('\t"q", \\ \nend ')).alias("text")), path)
    return read_csv_table(spark, path, schema="conv_id bigint, turn bigint, text string")


@register(
    "metric_history",
    "select cast(turn as bigint) as epoch, cast(count(*) as bigint) as n, round(avg(length(text)), 6) as mean_chars "
    "from conversations group by turn",
)
def q_metric_history(spark, sf_dir):
    from convprep.session import scratch_path
    from convprep.sources.sinks import write_metric_history
    from convprep.sources.tables import read_csv_table

    conv = fx.load(spark, sf_dir, "conversations")
    path = scratch_path(spark, "metrics")
    write_metric_history(conv.groupBy(F.col("turn").alias("epoch")).agg(
        F.count("*").alias("n"), F.round(F.avg(F.length("text")), 6).alias("mean_chars")), path)
    return read_csv_table(spark, path, schema="epoch bigint, n bigint, mean_chars double")


@register("conversation_corpus_shards", ORACLE["conversation_corpus"])
def q_conversation_corpus_shards(spark, sf_dir):
    from convprep.operators.corpus import concat_corpus_shards

    shards = concat_corpus_shards(fx.load(spark, sf_dir, "conversations"), "text", ["turn"], ["conv_id"])
    # A conversation is small enough to be put together again.
    whole = shards.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("shard", "corpus"))), lambda x: x["corpus"]), "")
        .alias("corpus"))
    return whole.select("conv_id", F.md5("corpus").alias("digest"), F.length("corpus").cast("bigint").alias("n_chars"))


# ------------------------------------------------- softmax over hot groups


@register(
    "softmax_by_label_hot",
    with_views(
        """select vec_id, tok, round(exp(l - m) / sum(exp(l - m)) over (partition by label), 9) as p
from (select *, max(l) over (partition by label) as m from v_logits)""",
        "v_logits",
    ),
)
def q_softmax_by_label_hot(spark, sf_dir):
    from convprep.operators.scores import softmax_by_group

    out = softmax_by_group(_logits(spark, sf_dir), "label", "l", hot_groups=True)
    return out.select("vec_id", "tok", F.round("p", 9).alias("p"))


# --------------------------- ranks over groups that may be a third of all rows


@register(
    "sorted_scores_by_label_hot",
    with_views(
        "select label, vec_id, cast(tok as bigint) as tok, cast(row_number() over (partition by label order by l desc, vec_id, tok) as bigint) as rk from v_logits",
        "v_logits"),
)
def q_sorted_scores_by_label_hot(spark, sf_dir):
    from convprep.operators.scores import sort_scores

    out = sort_scores(_logits(spark, sf_dir), "label", ["vec_id", "tok"], "l", hot_groups=True)
    return out.select("label", "vec_id", F.col("tok").cast("bigint").alias("tok"), "rk")


# ----------------------- a run's data set and manifest, written and read back


@register("written_run", ORACLE["run_manifest"])
def q_written_run(spark, sf_dir):
    from convprep.session import scratch_path
    from convprep.sources.sinks import write_run

    ts, _ = sender_training_set(fx.messages_view(fx.load(spark, sf_dir, "conversations")), _SENDER)
    path = scratch_path(spark, "run")
    write_run(spark, ts, path, {"source": "conversations", "sender": _SENDER, "max_tokens": 1023, "min_tokens": 2})
    return spark.read.schema("source string, sender string, max_tokens string, min_tokens string, "
                             "n_rows bigint, min_len bigint, max_len bigint").json(f"{path}/manifest")


# ------------------------------------------------- blanks cleaned up on decode


@register(
    "decode_cleaned_messages",
    """select conv_id, turn, regexp_replace(array_to_string(regexp_extract_all(text, '(\\S+)', 1), ' '), ' ([.,!?])', '\\1', 'g') as decoded
from conversations""",
)
def q_decode_cleaned_messages(spark, sf_dir):
    from convprep.functions.text import pretokenize
    from convprep.operators.tokens import decode, fit_encode

    conv = fx.load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    enc, vocab = fit_encode(conv, [pretokenize("text")], ["ids"], keep=["conv_id", "turn"])
    return decode(enc, ["conv_id", "turn"], "ids", vocab, join_back=False, clean=True)
