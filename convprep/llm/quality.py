"""Quality rules as a short-circuit cascade (native: no Python on rows).

Each rule names the features it reads and a condition under which it rejects a
text. Features are computed only for texts that no earlier rule has rejected.
The order is planned from a sample: rejections among the texts still alive, per
unit of cost of the features not computed before. The order decides how much
work is done, never the verdict: a text is kept if no rule rejects it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convprep.llm.common import let, words

WINDOW = 5
# What is not of a script that writes without blanks between words.
UNSPACED = (r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]+")
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Feature:
    """A value computed from a text. ``expr`` maps a getter of other features
    to a column; ``cost`` is the work per text as (feature or "chars", units)."""

    expr: Callable[[Callable[[str], Column]], Column]
    cost: tuple[str, float]
    needs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    """Rejects a text where ``rejects`` holds (null counts as no rejection)."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Callable[[str], Column]], Column]


def _windows(w: Column, size: int) -> Column:
    return F.when(F.size(w) >= size, F.transform(
        F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.array_join(F.slice(w, i, size), " ")))


def repeated_words(w: Column, size: int = WINDOW) -> Column:
    """Words covered by a window of ``size`` words found twice or more.

    A first test on 64-bit window hashes settles the texts without repeats
    (distinct hashes prove distinct windows); the others sort their windows
    as text, so equal hashes of different windows change nothing.
    """
    hashes = let(w, lambda w: F.transform(
        F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size))))
    some = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))

    def starts(w: Column) -> Column:
        pairs = F.transform(_windows(w, size), lambda s, i: F.struct(s.alias("s"), i.alias("i")))
        return let(F.sort_array(pairs), lambda p: F.array_sort(F.transform(
            F.filter(p, lambda x, j: (
                (F.get(p, j - 1)["s"] == x["s"]) | (F.get(p, j + 1)["s"] == x["s"]))),
            lambda x: x["i"])))

    covered = let(let(w, starts), lambda s: F.aggregate(
        F.transform(s, lambda x, j: F.least(F.coalesce(F.get(s, j + 1) - x, F.lit(size)), F.lit(size))),
        F.lit(0).cast("long"), lambda a, x: a + x))
    return F.when(F.size(w) <= size, 0).when(some, covered).otherwise(0).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))


#: Costs in nanoseconds per character or word, orders of magnitude measured once.
FEATURES: dict[str, Feature] = {
    "words": Feature(lambda f: words(f("text")), ("chars", 12)),
    "n_words": Feature(lambda f: F.size(f("words")).cast("long"), ("words", 0.01), ("words",)),
    "word_chars": Feature(
        lambda f: F.length(F.array_join(f("words"), "")).cast("long"), ("words", 15), ("words",)),
    "n_symbols": Feature(
        lambda f: (F.length("text") - F.length(F.regexp_replace(f("text"), SYMBOLS, ""))).cast("long"),
        ("chars", 8)),
    "lines": Feature(lambda f: _lines(f("text")), ("chars", 4)),
    "n_lines": Feature(lambda f: F.size(f("lines")).cast("long"), ("words", 0.01), ("lines",)),
    "n_dup_lines": Feature(
        lambda f: (F.size(f("lines")) - F.size(F.array_distinct(f("lines")))).cast("long"),
        ("words", 2), ("lines",)),
    "n_letters": Feature(
        lambda f: F.length(F.regexp_replace(f("text"), r"[^\p{L}\p{M}]+", "")).cast("long"), ("chars", 15)),
    "n_unspaced": Feature(
        lambda f: F.length(F.regexp_replace(f("text"), UNSPACED, "")).cast("long"), ("chars", 15)),
    "n_repeat_words": Feature(lambda f: repeated_words(f("words")), ("words", 900), ("words",)),
}


def default_rules(
    min_words: int = 10,
    max_repeat_percent: int = 20,
    max_symbol_percent: int = 5,
    max_dup_line_percent: int = 30,
    min_letter_percent: int = 75,
    mean_word_chars: tuple[int, int] = (2, 25),
) -> list[Rule]:
    low, high = mean_word_chars
    return [
        Rule("few_words", ("n_words",), lambda f: f("n_words") < min_words),
        Rule("repeated_words", ("n_words", "n_repeat_words"),
             lambda f: 100 * f("n_repeat_words") > max_repeat_percent * f("n_words")),
        Rule("symbols", ("word_chars", "n_symbols"),
             lambda f: 100 * f("n_symbols") > max_symbol_percent * f("word_chars")),
        Rule("repeated_lines", ("n_lines", "n_dup_lines"),
             lambda f: 100 * f("n_dup_lines") > max_dup_line_percent * f("n_lines")),
        Rule("few_letters", ("word_chars", "n_letters"),
             lambda f: 100 * f("n_letters") < min_letter_percent * f("word_chars")),
        Rule("word_length", ("n_words", "word_chars", "n_unspaced"),
             lambda f: (f("word_chars") < low * f("n_words")) | (
                 (f("word_chars") > high * f("n_words")) & (2 * f("n_unspaced") <= f("word_chars")))),
    ]


@dataclass
class Plan:
    """Rules in the order to run, with what the sample showed."""

    rules: list[Rule]
    sampled: int = 0
    steps: list[dict] = field(default_factory=list)


def _closure(needs, known: set[str]) -> list[str]:
    """Features to compute for ``needs``, inputs first, without ``known``."""
    out: list[str] = []
    for n in needs:
        for m in [*_closure(FEATURES[n].needs, known | set(out)), n]:
            if m not in known and m not in out:
                out.append(m)
    return out


def _free_name(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def plan_cascade(
    docs: DataFrame,
    rules: list[Rule] | None = None,
    text: str = "text",
    fraction: float = 0.05,
    sample_rows: int = 1000,
    known: tuple[str, ...] = (),
    seed: int = 7,
) -> Plan:
    """Order ``rules`` by rejection per cost, judged on a sample.

    The sample is bounded (``sample_rows`` rows of a ``fraction`` of the table)
    and read with ``take``, which opens only as many partitions as it needs.
    What comes back per row is a verdict per rule and the work sizes, never the
    text. Rules are picked greedily: the next one has the most rejections among
    sampled rows that no picked rule rejects, per cost of features that are not
    yet computed (``known`` ones are free). Ties, and rules that reject
    nothing, go by cost, then by given order. An empty table keeps the given
    order.
    """
    rules = default_rules() if rules is None else list(rules)
    part = docs.select(F.col(text).alias("text")).sample(fraction=fraction, seed=seed)
    everything = _closure([n for r in rules for n in r.needs], set())
    for n in everything:
        part = part.withColumn(n, FEATURES[n].expr(F.col))
    rows = part.select(
        F.coalesce(F.length("text"), F.lit(0)).alias("chars"), F.size(words(F.col("text"))).alias("words"),
        *[F.coalesce(r.rejects(F.col), F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules)],
    ).take(sample_rows)
    if not rows:
        return Plan(rules)
    size = {k: sum(r[k] for r in rows) / len(rows) for k in ("chars", "words")}
    have, alive, left, steps = set(known), list(range(len(rows))), list(range(len(rules))), []

    def cost(i: int) -> float:
        return 1.0 + sum(size[FEATURES[n].cost[0]] * FEATURES[n].cost[1] for n in _closure(rules[i].needs, have))

    while left:
        scored = []
        for i in left:
            hits = sum(rows[k][f"r{i}"] for k in alive)
            scored.append((-hits / cost(i), cost(i), i, hits))
        _, price, i, hits = min(scored)
        steps.append({"rule": rules[i].name, "alive": len(alive), "rejected": hits, "cost": round(price, 1)})
        have.update(_closure(rules[i].needs, have))
        alive = [k for k in alive if not rows[k][f"r{i}"]]
        left.remove(i)
    by_name = {r.name: r for r in rules}
    return Plan([by_name[s["rule"]] for s in steps], len(rows), steps)


def quality_cascade(
    docs: DataFrame,
    plan: Plan | None = None,
    rules: list[Rule] | None = None,
    text: str = "text",
    always: tuple[str, ...] = (),
    verdict: str = "failed_rule",
) -> DataFrame:
    """``docs`` plus ``verdict``: the name of the rule that rejected the text,
    null if it is kept; plus one struct column ``features`` if ``always`` names
    features to return for every row.

    One pass, no shuffle. A feature outside ``always`` is computed only while no
    rule has rejected the row. A null text has no words, characters or lines.
    All other columns pass through whatever their names; ``verdict`` and
    ``features`` get leading underscores if the table has such a column. Rows
    are judged one by one, so repeated rows get the same verdict; an empty
    table gives an empty result.
    """
    plan = plan or plan_cascade(docs, rules, text, known=tuple(_closure(always, set())))
    verdict, out_features = _free_name(docs, verdict), _free_name(docs, "features")
    # The input row travels as one struct, so no column name can clash.
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                     F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    done: set[str] = set()

    def add(df: DataFrame, names, alive: Column | None) -> DataFrame:
        for n in _closure(names, done):
            value = FEATURES[n].expr(F.col)
            df = df.withColumn(n, value if alive is None else F.when(alive, value))
            done.add(n)
        return df

    df = add(df, always, None).withColumn("failed", F.lit(None).cast("string"))
    for rule in plan.rules:
        alive = F.col("failed").isNull()
        df = add(df, rule.needs, alive)
        hit = F.when(alive & F.coalesce(rule.rejects(F.col), F.lit(False)), F.lit(rule.name))
        df = df.withColumn("failed", F.coalesce(F.col("failed"), hit))
    extra = [F.struct(*[F.col(n) for n in always]).alias(out_features)] if always else []
    return df.select("row.*", F.col("failed").alias(verdict), *extra)


def keep_good(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """The rows that no rule rejects, with the columns of ``docs``.

    Catalyst pushes a filter below the projections by putting their expressions
    in its condition, each feature once per use. The row number, which is never
    negative, keeps the filter above them.
    """
    verdict, number = _free_name(docs, "failed_rule"), _free_name(docs, "row_number")
    out = quality_cascade(docs, rules=rules, text=text, verdict=verdict)
    out = out.withColumn(number, F.monotonically_increasing_id())
    return out.where(F.col(verdict).isNull() & (F.col(number) >= 0)).drop(verdict, number)


def op1_quality_rules(docs: DataFrame) -> DataFrame:
    """Digest of the contract: base features of every text, ``base_failed`` (the
    first two rules of :func:`default_rules`) and ``kept``."""
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = quality_cascade(docs.select("doc_id", "text"), always=base)
    f = F.col("features")
    return judged.select(
        "doc_id", *[f[c].alias(c) for c in base],
        ((f["n_words"] < 10) | (100 * f["n_repeat_words"] > 20 * f["n_words"])).alias("base_failed"),
        F.col("failed_rule").isNull().alias("kept"))


ORACLE_OP1 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t),
k AS (SELECT row_number() OVER () AS r, * FROM w),
win AS (
  SELECT r, i, array_to_string(w[i:i+4], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM k WHERE len(w) >= 5)),
rep AS (
  SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, sum(least(coalesce(nx - i, 5), 5)) AS n FROM rep GROUP BY r),
f AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(length(regexp_replace(text, '[^\p{L}\p{M}]', '', 'g')) AS BIGINT) AS n_letters,
         CAST(length(regexp_replace(text, '[^\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]', '', 'g')) AS BIGINT) AS n_unspaced,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM k LEFT JOIN cov USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words
            OR 100 * n_symbols > 5 * word_chars OR 100 * n_dup_lines > 30 * n_lines
            OR 100 * n_letters < 75 * word_chars
            OR word_chars < 2 * n_words OR (word_chars > 25 * n_words AND 2 * n_unspaced <= word_chars)) AS kept
FROM f
"""
