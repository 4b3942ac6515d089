"""Views that give the driver's tables the reference's input shapes.

Each has a twin in DuckDB SQL (:data:`ORACLE_VIEWS`) used by the oracle
queries, so both engines start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convprep.functions.text import pretokenize
from convprep.sources.tables import read_table

# The synonym fixture; 'source' keywords have no translation.
SYNONYMS = {"quality": "good", "toxic": "harmful"}


def messages_view(conversations: DataFrame) -> DataFrame:
    """v_messages: chat messages with null contents and non-generic types."""
    return conversations.select(
        "conv_id",
        "turn",
        F.col("role").alias("sender_name"),
        F.when(F.col("turn") % 7 == 6, F.lit(None).cast("string")).otherwise(F.col("text")).alias("content"),
        F.when(F.col("turn") % 5 == 4, F.lit("Share")).otherwise(F.lit("Generic")).alias("type"),
    )


def synonyms_view(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(SYNONYMS.items()), "keyword string, translation string")


def topic_links_view(documents: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """v_topic_links: every document, with three links if it is labelled (one
    with an empty cluster, one with an empty type) and none otherwise; ``keep``
    carries document columns."""
    def link(cluster, type_):
        return F.struct(
            cluster.alias("cluster"), F.col("lang").alias("phrase"), F.col("lang").alias("phrase_synonym"),
            F.lit("").alias("disease"), type_.alias("type"),
        )

    q = F.concat(F.lit("quality"), F.when(F.col("quality") == 1, "+").otherwise("-"))
    t = F.concat(F.lit("toxic"), F.when(F.col("toxic") == 1, "+").otherwise("-"))
    links = F.array(link(F.col("source"), q), link(F.lit(""), t), link(F.col("source"), F.lit("")))
    rows = documents.join(labels.withColumn("_labelled", F.lit(True)), "doc_id", "left")
    return rows.select(
        "doc_id", F.when(F.col("_labelled"), links).otherwise(F.filter(links, lambda x: F.lit(False))).alias("topic_links"),
        *keep,
    )


def tokens_view(documents: DataFrame) -> DataFrame:
    """v_tokens: ``(doc_id, pos, tok)`` blank-separated tokens."""
    return documents.select("doc_id", F.posexplode(pretokenize("text")).alias("pos", "tok"))


def logits_view(embeddings: DataFrame) -> DataFrame:
    """v_logits: 64 candidate scores per vector, ``label`` is the target."""
    return embeddings.select("vec_id", "label", F.posexplode("embedding").alias("tok", "l")).select(
        "vec_id", "label", F.col("tok").cast("int").alias("tok"), F.col("l").cast("double").alias("l")
    )


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


# DuckDB forms of the same views, prepended as CTEs to oracle queries.
ORACLE_VIEWS = {
    "v_messages": """
select conv_id, turn, role as sender_name,
       case when turn % 7 = 6 then null else text end as content,
       case when turn % 5 = 4 then 'Share' else 'Generic' end as type
from conversations""",
    "v_synonyms": """
select * from (values ('quality', 'good'), ('toxic', 'harmful')) as t(keyword, translation)""",
    "v_topic_links": """
select d.doc_id, case when l.doc_id is null then [] else [
  {'cluster': d.source, 'phrase': d.lang, 'phrase_synonym': d.lang, 'disease': '',
   'type': 'quality' || case when l.quality = 1 then '+' else '-' end},
  {'cluster': '', 'phrase': d.lang, 'phrase_synonym': d.lang, 'disease': '',
   'type': 'toxic' || case when l.toxic = 1 then '+' else '-' end},
  {'cluster': d.source, 'phrase': d.lang, 'phrase_synonym': d.lang, 'disease': '',
   'type': ''}] end as topic_links
from documents d left join labels l on d.doc_id = l.doc_id""",
    "v_tokens": """
select doc_id, i - 1 as pos, w[i] as tok
from (select doc_id, w, unnest(range(1, len(w) + 1)) as i
      from (select doc_id, regexp_extract_all(text, '(\\S+)', 1) as w from documents))""",
    "v_vocab": """
select tok, cast(row_number() over (order by n desc, tok) - 1 as integer) as id, n
from (select tok, count(*) as n from v_tokens group by tok) as c""",
    "v_sequences": """
select doc_id, list(id order by pos) as ids
from v_tokens join v_vocab using (tok) group by doc_id""",
    "v_logits": """
select vec_id, label, cast(i - 1 as integer) as tok, embedding[i]::double as l
from (select *, unnest(range(1, len(embedding) + 1)) as i from embeddings)""",
}


def with_views(sql: str, *names: str, extra: tuple[tuple[str, str], ...] = ()) -> str:
    """Prefix ``sql`` with the named oracle views, then ``extra`` (name,
    body) pairs, as CTEs in the given order."""
    parts = [(n, ORACLE_VIEWS[n]) for n in names] + list(extra)
    if not parts:
        return sql
    ctes = ",\n".join(f"{n} as ({body})" for n, body in parts)
    return f"with {ctes}\n{sql}"
