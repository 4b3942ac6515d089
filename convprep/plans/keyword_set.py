"""The keyword data set flow: topic links -> keywords (C2) -> tokenized
set (C3) -> registered under a key (C4)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from convprep.operators.keywords import prepare_keywords
from convprep.operators.tokens import UNK_ID, tokenize_dataset
from convprep.sources.sinks import register_dataset


def prepare_keyword_dataset(
    df: DataFrame,
    id_field: str,
    text_field: str,
    vocab: DataFrame,
    topic_link_field: str = "topic_links",
    key: str | None = None,
    sentiment: bool = False,
    cluster: bool = False,
    synonyms=None,
    number_of_keywords: int | None = None,
    pattern: str = "blank",
    unk_id: int | None = UNK_ID,
) -> tuple[str, DataFrame]:
    """Returns ``(key, D10 frame)``; the frame is also registered as a
    temporary view under ``key`` (generated when None)."""
    kw = prepare_keywords(df, id_field, text_field, topic_link_field, sentiment=sentiment, cluster=cluster)
    d10 = tokenize_dataset(kw, vocab, synonyms, number_of_keywords, pattern, unk_id)
    return register_dataset(d10, key), d10
