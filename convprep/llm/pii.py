"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits,
URL schemes and cue words. From each anchor a small parser for its kind walks to
the boundaries of the candidate and checks it. Every parser is linear in the
text: no candidate is scanned twice, and nothing backtracks.
"""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "address")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMERIC = re.compile(r"[0-9][0-9. -]*")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Both without an upper bound, and linear: possessive, and no two matches scan the same characters,
# for one starts behind "://" and stops at "/", the other starts behind ":" or "=" and stops there.
_USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=-]++(?::[^\s@/]*+)?+(?=@)")
_SECRET = re.compile(r"[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?([A-Za-z0-9_/+.-]{16,}+=*+)")
_IBAN = re.compile(r"[ :=#.]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_ACCOUNT_NO = re.compile(r"(?:[ \t]?(?:number|no\.?|nr\.?|#))?[ \t]?[:=#][ \t]?([0-9](?:[ -]?[0-9]){5,19})(?![0-9])")
_STREET = re.compile(r"[0-9]{1,5}[A-Za-z]? (?:[A-Z][a-z]{1,20} ){1,3}$")

_SECRET_CUES = ("token", "api_key", "apikey", "api-key", "secret", "password", "passwd")
_ACCOUNT_CUES = ("account", "ssn", "passport")
_STREET_CUES = ("Street", "Avenue", "Road", "Boulevard", "Lane")


@functools.cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    anchors = {"@": "at", "+": "plus", "://": "scheme"} | dict.fromkeys("0123456789", "digit")
    for kind, cues in (("secret", _SECRET_CUES), ("account", _ACCOUNT_CUES), ("iban", ("iban",))):
        anchors |= {f(c): kind for c in cues for f in (str.lower, str.upper, str.capitalize)}
    anchors |= dict.fromkeys(_STREET_CUES, "street")
    for text, kind in anchors.items():
        a.add_word(text, (kind, len(text)))
    a.make_automaton()
    return a


def _digits(s: str) -> str:
    return "".join(_PART.findall(s))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every hit, in code points, end exclusive, ordered by
    kind as in ``KINDS`` and by start. Hits of one kind do not overlap."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return []
    done = dict.fromkeys((*KINDS, "digits"), 0)

    def add(kind: str, lo: int, hi: int) -> None:
        if lo >= done[kind]:
            found[kind].append((lo, hi))
            done[kind] = hi

    for end, (anchor, size) in _automaton().iter(text):
        at, after = end - size + 1, end + 1
        if anchor == "digit":
            if at < done["digits"]:
                continue
            m = _NUMERIC.match(text, at)
            done["digits"] = m.end()
            for c in _CARD.finditer(text, at, m.end()):
                number = _digits(c.group())
                if 13 <= len(number) <= 19 and _luhn(number):
                    add("card", *c.span())
            for c in _DOTTED.finditer(text, at, m.end()):
                parts = [p.span() for p in _PART.finditer(text, *c.span())]
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i:i + 4]
                    if all(hi - lo <= 3 or not text[lo:hi - 3].strip("0") for lo, hi in four) and all(
                            int(text[max(lo, hi - 3):hi]) <= 255 for lo, hi in four):
                        add("ip", four[0][0], four[-1][1])
        elif anchor == "at":
            lo = at
            while lo > done["email"] and text[lo - 1] in _LOCAL:
                lo -= 1
            if lo < at and (m := _DOMAIN.match(text, after)):
                add("email", lo, m.end())
        elif anchor == "plus":
            if (m := _PHONE.match(text, at)) and 9 <= len(_digits(m.group())) <= 15:
                add("phone", *m.span())
        elif anchor == "scheme":
            if m := _USERINFO.match(text, after):
                add("account", *m.span())
        elif anchor == "secret":
            m = _SECRET.match(text, after)
            if m and re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1]):
                add("account", *m.span(1))
        elif anchor == "iban":
            if (m := _IBAN.match(text, after)) and _mod97(m[1]):
                add("account", *m.span(1))
        elif anchor == "account":
            if m := _ACCOUNT_NO.match(text, after):
                add("account", *m.span(1))
        elif anchor == "street":
            if m := _STREET.search(text, max(0, at - 80), at):
                add("address", m.start(), after)
    return [(k, lo, hi) for k in KINDS for lo, hi in found[k]]


def spans_column(text: Column) -> Column:
    """All spans of a text as ``kind:start:end`` joined by commas ("" for none and
    for null)."""

    @F.pandas_udf("string")
    def spans(s: pd.Series) -> pd.Series:
        return pd.Series([",".join(f"{k}:{a}:{b}" for k, a, b in find_spans(t)) for t in s], dtype=object)

    return spans(text)


def redacted_column(text: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; spans that
    overlap are replaced as one, named after the first. Null stays null."""

    def redact(t: str | None) -> str | None:
        if t is None:
            return None
        out, at = [], 0
        spans = sorted(((lo, hi, k) for k, lo, hi in find_spans(t)), key=lambda x: (x[0], -x[1]))
        for lo, hi, kind in spans:
            if lo >= at:
                out += [t[at:lo], f"<{kind.upper()}>"]
            at = max(at, hi)
        return "".join([*out, t[at:]]) if spans else t

    @F.pandas_udf("string")
    def redacted(s: pd.Series) -> pd.Series:
        return pd.Series([redact(t) for t in s], dtype=object)

    return redacted(text)


def with_spans(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """``docs`` with array column ``into`` of (kind, start, end).

    One pass, no shuffle; rows are independent, so repeated rows get equal
    spans and an empty table gives an empty result. Null and empty texts have
    no spans. Whole texts are read, however long. ``into`` must be a new name.
    """
    parts = F.filter(F.split(spans_column(F.col(f"`{text}`")), ","), lambda s: s != "")
    return docs.withColumn(into, F.transform(parts, lambda s: F.struct(
        F.split_part(s, F.lit(":"), F.lit(1)).alias("kind"),
        F.split_part(s, F.lit(":"), F.lit(2)).cast("int").alias("start"),
        F.split_part(s, F.lit(":"), F.lit(3)).cast("int").alias("end"))))


def redact_documents(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, same columns and rows; a
    column ``n_chars`` is brought in line with the new text."""
    out = docs.withColumn(text, redacted_column(F.col(f"`{text}`")))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
    return out


def op7_anchor_pii(docs: DataFrame) -> DataFrame:
    """Digest of the contract."""
    rows = docs.select("doc_id", spans_column(F.col("text")).alias("spans"))
    parts = F.filter(F.split("spans", ","), lambda s: s != "")

    def of(*kinds: str) -> Column:
        return F.filter(parts, lambda s: F.split_part(s, F.lit(":"), F.lit(1)).isin(*kinds))

    return rows.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.array_join(of(*BASE_KINDS), ","), 256).alias("base_sha256"), "spans")
