"""String column functions (pre-tokenizing, keyword text, generation text).

All are built-in Spark expressions: they stay in the JVM and in codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from convprep.functions.arrays import _col

# The two pre-token patterns (group 1 is the token).
BLANK_PATTERN = r"(\S+)"
WORD_PATTERN = r"( ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+)"
PATTERNS = {"blank": BLANK_PATTERN, "words": WORD_PATTERN}
_BLANKS = "[ \\t\\n\\x0B\\f\\r]+"  # the characters \\s matches in Java

# Fixed value: the characters stripped from the end of a topic type.
SENTIMENT_MARKS = "+-"


def pretokenize(text, pattern: str = "blank") -> Column:
    """H1: ``array<string>`` of pre-tokens, ``regexp_extract_all`` group 1.

    ``pattern`` is ``"blank"``, ``"words"`` or a regular expression with one
    group. Null text gives null.
    """
    if pattern == "blank":
        # Same tokens as (\S+) (Java's ASCII blanks), but a split is cheaper
        # than extracting every match.
        return F.filter(F.split(_col(text), _BLANKS), lambda x: x != "")
    regex = PATTERNS.get(pattern, pattern)
    return F.regexp_extract_all(_col(text), F.lit(regex), 1)


def strip_sentiment(type_col) -> Column:
    """H4: drop any run of ``+``/``-`` at the end (``sym+-+`` -> ``sym``)."""
    return F.rtrim(_col(type_col), F.lit(SENTIMENT_MARKS))


def prepend_text(text, keywords) -> Column:
    """H5: ``k_n ... k_2 k_1 text``: each keyword in turn is put in front,
    so the keyword order is reversed. Null keywords = none."""
    kws = F.coalesce(_col(keywords), F.array().cast("array<string>"))
    return F.array_join(F.concat(F.reverse(kws), F.array(_col(text))), " ")


def truncate_at_stop(text, stop: str, keep_if_missing: bool = False) -> Column:
    """H7: ``text[: text.find(stop) + 1]``.

    Keeps only the first character of the stop mark; a missing mark gives
    ``''`` unless ``keep_if_missing``.
    """
    t = _col(text)
    pos = F.instr(t, stop)
    cut = F.left(t, pos)
    if keep_if_missing:
        return F.when(pos == 0, t).otherwise(cut)
    return cut


def prefix_prompt(prompt, text) -> Column:
    """H8: ``prompt + ' ' + text``."""
    return F.concat_ws(" ", _col(prompt), _col(text))


def clean_decoded(text) -> Column:
    """Optional blank clean-up on decode: no blank before ``. , ! ?``."""
    return F.regexp_replace(_col(text), r" ([.,!?])", "$1")
