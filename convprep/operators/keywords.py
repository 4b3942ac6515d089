"""Keywords from topic links, and their translation (P11, H4, H6, H14, T5,
H16, J1, C2)."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convprep.functions.arrays import dedupe, take_last, topic_field
from convprep.functions.text import strip_sentiment
from convprep.operators.lookup import SELF, lookup_arrays
from convprep.session import ship_package

TOPIC_LINK_TYPE = (
    "array<struct<cluster:string,phrase:string,phrase_synonym:string,disease:string,type:string>>"
)


def non_empty_elements(links, field: str) -> Column:
    """P11 + H14: the ``field`` of every link whose ``field`` is non-empty.

    Tested before any suffix strip, so a type of ``+`` alone survives here.
    Null link lists count as empty.
    """
    c = F.col(links) if isinstance(links, str) else links
    picked = topic_field(F.filter(c, lambda x: F.length(x[field]) > 0), field)
    return F.coalesce(picked, F.array().cast("array<string>"))


def prepare_keywords(
    df: DataFrame,
    id_field: str,
    text_field: str,
    topic_link_field: str = "topic_links",
    sentiment: bool = False,
    cluster: bool = False,
) -> DataFrame:
    """``(id, text, keywords)`` from topic links.

    keywords = distinct types (suffix ``+``/``-`` stripped unless
    ``sentiment``), then with ``cluster`` the distinct non-empty clusters;
    the two lists are not de-duplicated against each other. Distinct keeps
    first occurrence order.
    """
    types = non_empty_elements(topic_link_field, "type")
    if not sentiment:
        types = F.transform(types, lambda t: strip_sentiment(t))
    keywords = dedupe(types)
    if cluster:
        keywords = F.concat(keywords, dedupe(non_empty_elements(topic_link_field, "cluster")))
    return df.select(
        F.col(id_field).alias("id"), F.col(text_field).alias("text"), keywords.alias("keywords")
    )


def synonym_table(synonyms: DataFrame, key: str = "keyword", value: str = "translation") -> DataFrame:
    """A dict has unique keys: reduce a synonym table to one row per keyword."""
    return synonyms.groupBy(F.col(key).alias("keyword")).agg(F.max(value).alias("translation"))


def _translate(synonyms: dict[str, str]):
    """Arrow function: the elements of string lists, translated where ``synonyms`` has them."""
    keys, values = list(synonyms), list(synonyms.values())

    @F.arrow_udf("array<string>")
    def translate(lists: pa.Array) -> pa.Array:
        words = lists.flatten()
        place = pc.index_in(words, value_set=pa.array(keys, words.type))
        found = pc.coalesce(pa.array(values, words.type).take(place), words)
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), found)

    return translate


def translate_keywords(
    df: DataFrame,
    synonyms: Mapping[str, str] | DataFrame | None = None,
    number_of_keywords: int | None = None,
    col: str = "keywords",
    out: str = "used_keywords",
    key: str = "id",
) -> DataFrame:
    """J1 with T5: take the last ``number_of_keywords`` keywords, last first.

    With ``synonyms`` each is translated (a miss keeps the keyword) and the
    result de-duplicated (first occurrence kept); without, the picked
    keywords are kept as they are, duplicates included. Null keyword lists
    count as empty. A dict, which the driver holds, goes to the tasks with the
    function and is looked up by hash, an Arrow batch at a time; a DataFrame
    ``(keyword, translation)`` goes through the block dictionaries of
    :func:`lookup_arrays`. Neither depends on how many entries there are, and both give the
    same rows. ``key`` is only carried along.
    """
    picked = take_last(col, number_of_keywords)
    if synonyms is None:
        return df.withColumn(out, picked)
    if isinstance(synonyms, Mapping):
        ship_package(df.sparkSession)
        return df.withColumn(out, F.array_distinct(_translate(dict(synonyms))(picked)))
    table = synonym_table(synonyms)
    looked = lookup_arrays(df, [key], [picked], ["_cp_tr"], table, "keyword", "translation", "string", default=SELF)
    return looked.withColumn(out, F.array_distinct("_cp_tr")).drop("_cp_tr")
