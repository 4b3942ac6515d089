"""Operators against brute force on small tables, and their edge cases."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_SMALL
from convprep.llm import catalog, jaccard, language, lm, mixing, neardup, packing, pii, quality, sharding, substrings
from convprep.llm.common import components, load

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}x{i // 7}" for i in range(20_000))
PROSE = " ".join(["the quick brown fox jumps over a lazy dog and runs home"] + [f"then word{c} follows" for c in "abcdefghijklmnop"])
EDGES = [
    (1, None, None, None, None), (None, PROSE, "en", "a", 5), (2, "", "en", "a", 0), (3, " \t\n", "en", "", 3),
    (4, LONG, "en", "b", len(LONG)), (5, PROSE, "en", "a", 9), (5, PROSE, "en", "a", 9), (6, PROSE, None, None, 9),
    (7, "one two", "fr", "b", 7), (8, PROSE + " end", "en", "a", 1), (9, "12345 !!", "en", "c", 8),
]
CLASH = ["row", "features", "failed_rule", "rid", "node", "key", "words", "size", "u", "tier", "component", "vslot", "failed"]


def clashing(df):
    """The table with extra columns named like the operators' own."""
    return df.withColumns({c: F.lit(1) for c in CLASH})


def edges(spark):
    return clashing(spark.createDataFrame(EDGES, DOCS))


def nothing(spark):
    return clashing(spark.createDataFrame([], DOCS))


def small(spark):
    return load(spark, SF_SMALL, "documents")


def texts(spark):
    return [(r["doc_id"], r["text"]) for r in small(spark).select("doc_id", "text").collect()]


# ---- edge cases common to all operators on documents -----------------------

ON_DOCS = {
    "quality": quality.op1_quality_rules, "substrings": substrings.op3_super_kmers, "jaccard": jaccard.op5_minhash_join,
    "mixing": mixing.op6_pareto_mix, "pii": pii.op7_anchor_pii, "packing": packing.op8_best_fit_packing,
    "sharding": sharding.op9_virtual_slots, "language": language.op10_string_kernel,
    "lm": lambda d: lm.cross_entropy_difference(d, d.where("doc_id = 5").select("doc_id")),
}


@pytest.mark.parametrize("name", ON_DOCS)
def test_edge_rows_all_come_back(spark, name):
    rows = ON_DOCS[name](edges(spark)).collect()
    ids = Counter(r["doc_id"] for r in rows if name != "packing" or r["piece"] == 0)
    assert ids == Counter(e[0] for e in EDGES)


@pytest.mark.parametrize("name", ON_DOCS)
def test_empty_table(spark, name):
    assert ON_DOCS[name](nothing(spark)).collect() == []


def test_stages_keep_columns_and_empty_tables(spark):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, edges(spark), SF_SMALL)
        assert out.columns == edges(spark).columns and out.count() > 0
        assert stage(spark, nothing(spark), SF_SMALL).count() == 0


# ---- operators one by one --------------------------------------------------

def brute_quality(t):
    t = t or ""
    w = WORD.findall(t)
    spots = defaultdict(list)
    for i in range(len(w) - 4):
        spots[tuple(w[i:i + 5])].append(i)
    cover = {i + k for s in spots.values() if len(s) > 1 for i in s for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    chars, letters = sum(map(len, w)), sum(unicodedata.category(c)[0] in "LM" for c in t)
    unspaced = len(regex.findall(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]", t))
    n = len(w), chars, len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)
    base = n[0] < 10 or 100 * n[4] > 20 * n[0]
    bad = (100 * n[2] > 5 * chars or 100 * n[3] > 30 * len(lines) or 100 * letters < 75 * chars
           or chars < 2 * n[0] or (chars > 25 * n[0] and 2 * unspaced <= chars))
    return (*n, base, not (base or bad))


def test_quality_equals_brute_force(spark):
    got = {r[0]: tuple(r)[1:] for r in quality.op1_quality_rules(small(spark)).collect()}
    assert got == {i: brute_quality(t) for i, t in texts(spark)}


def test_quality_order_changes_no_verdict_and_short_circuits(spark):
    docs, rules = small(spark), quality.default_rules()
    plan = quality.plan_cascade(docs, fraction=1.0)
    assert sorted(s["rule"] for s in plan.steps) == sorted(r.name for r in rules)
    alone = [quality.plan_cascade(docs, [r], fraction=1.0).steps[0] for r in rules]
    assert plan.steps[0]["rule"] == max(alone, key=lambda s: s["rejected"] / s["cost"])["rule"]
    assert [s["alive"] for s in plan.steps[1:]] == [s["alive"] - s["rejected"] for s in plan.steps[:-1]]
    a = quality.quality_cascade(docs, quality.Plan(rules)).where("failed_rule is null").select("doc_id")
    b = quality.quality_cascade(docs, quality.Plan(rules[::-1])).where("failed_rule is null").select("doc_id")
    assert sorted(a.collect()) == sorted(b.collect()) == sorted(quality.keep_good(docs).select("doc_id").collect())


CLEAN = {
    "hi": "भारत एक विशाल देश है जहाँ अनेक भाषाएँ बोली जाती हैं और लोग मिलकर त्योहार मनाते हैं। यहाँ की संस्कृति बहुत पुरानी है।",
    "zh": " ".join(["中文文本通常不在词语之间使用空格，因此每一行都很长，读者自己分开词语。", "这是一个普通的段落，内容干净而且完整，没有任何重复的句子在里面出现。"]
                   + [f"第{c}句话讲述了另一个城市里的人们每天如何生活和工作以及学习新的知识。" for c in "一二三四五六七八九"]),
    "th": " ".join(f"ภาษาไทยไม่มีการเว้นวรรคระหว่างคำดังนั้นข้อความจึงยาวมาก{c}" for c in "กขคงจฉชซฌญฎ"),
}


def test_clean_texts_of_other_scripts_are_kept(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CLEAN.values())], "doc_id long, text string")
    assert all(r["kept"] for r in quality.op1_quality_rules(df).collect())
    assert quality.keep_good(df).count() == len(CLEAN)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert all(r[0] for r in con.sql(f"select kept from ({quality.ORACLE_OP1})").fetchall())
    junk = spark.createDataFrame([(1, " ".join("x" * 40 + c for c in "abcdefghijklmnop")), (2, "12 34 5 6 7 8 9 10 11 12 13 14")],
                                 "doc_id long, text string")
    assert not any(r["kept"] for r in quality.op1_quality_rules(junk).collect())


def test_repeated_words_overlap(spark):
    t = "a b c d e a b c d e x a b c d e"
    row = quality.op1_quality_rules(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
    assert row["n_repeat_words"] == 15


def test_components(spark):
    r = random.Random(4)
    pairs = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = dict(components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {x: root(x) for p in pairs if p[0] != p[1] for x in p}


def shingles(t):
    w = WORD.findall(t or "")
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_jaccard(rows):
    sets = [shingles(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both * 10 >= 8 * (len(sets[a]) + len(sets[b]) - both):
                links[a], links[b] = links[a] + 1, links[b] + 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    least = defaultdict(lambda: math.inf)
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(least[root(i)], k)
    return sorted((k, least[root(i)], links[i]) for i, (k, _) in enumerate(rows))


def near_copies(n=60):
    """A group of near copies that takes several blocks, and copies of one text."""
    r = random.Random(9)
    base = [f"v{r.randint(0, 900)}" for _ in range(120)]
    out = [(1000 + i, " ".join([*base[:i % 100], f"n{i}", *base[i % 100 + 1:]])) for i in range(n)]
    return out + [(5000 + i, " ".join(base)) for i in range(7)] + [(6000, "a  b\tc"), (6001, "a b c"), (6002, None)]


def test_jaccard_equals_brute_force(spark):
    rows = texts(spark) + near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.jaccard_classes(df, per_block=16).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got)) == brute_jaccard(rows)
    kept = sorted(r[0] for r in jaccard.drop_near_duplicates(df, per_block=16).select("doc_id").collect())
    assert kept == sorted({c for _, c, _ in brute_jaccard(rows)})


def test_banding_meets_recall():
    for threshold, recall in ((0.8, 0.9999), (0.9, 0.99), (0.5, 0.9)):
        bands, rows = jaccard.banding(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= jaccard.MAX_HASHES


def brute_substrings(rows, window=50):
    first = {}
    ws = [(k, WORD.findall(t or "")) for k, t in rows]
    for k, w in ws:
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            first[key] = min(first.get(key, k), k)
    out = []
    for k, w in ws:
        gone = {i + j for i in range(len(w) - window + 1) if first[tuple(w[i:i + window])] < k for j in range(window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def shared_passages():
    r = random.Random(3)
    passage = [f"p{r.randint(0, 400)}" for _ in range(90)]
    loop = ["ha", "ho"] * 80
    out = []
    for i in range(40):
        own = [f"o{r.randint(0, 5000)}" for _ in range(r.randint(0, 120))]
        cut = r.randint(0, len(own))
        lo = r.randint(0, 30)
        out.append((100 + (i * 7) % 40, " ".join(own[:cut] + passage[lo:lo + r.randint(49, 90)] + (loop[i:] if i % 5 == 0 else []) + own[cut:])))
    return [*out, (3, " ".join(passage)), (3, " ".join(passage[::-1] + loop)), (900, None), (901, " ".join(passage[:49]))]


@pytest.mark.parametrize("per_bucket", [512, 2])
def test_substrings_equal_brute_force(spark, per_bucket, monkeypatch):
    monkeypatch.setattr(substrings.repeated_spans, "__defaults__", ("doc_id", "text", 50, 8, per_bucket))
    rows = shared_passages()
    got = substrings.op3_super_kmers(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(tuple, got)) == brute_substrings(rows)


@pytest.mark.parametrize("blind", [False, True])
def test_equal_windows_have_equal_numbers(blind, monkeypatch):
    if blind:  # all hashes alike: the windows themselves are sorted
        monkeypatch.setattr(substrings, "_mix", lambda h: h * np.uint64(0))
    flat = np.random.default_rng(1).integers(0, 2, 400).astype(np.int32)
    at = np.arange(395)
    number = substrings._equal_windows(flat, at, 5)
    windows = [tuple(flat[i:i + 5]) for i in at]
    assert all((number[i] == number[j]) == (windows[i] == windows[j]) for i in at for j in range(0, 395, 7))


def test_a_window_in_very_many_documents_is_counted_before_the_shuffle(spark):
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"a{i}x{k}" for k in range(9)] + passage[:50 + i % 11] + [f"b{i}x{k}" for k in range(45)]))
            for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    got = substrings.op3_super_kmers(docs).collect()
    assert sorted(map(tuple, got)) == brute_substrings(rows)
    parts = [{"mini": 1, "content": i, "id": i, "start": 9, "count": 1, "buckets": 40} for i in range(1500)]
    texts = spark.createDataFrame([(t, [p]) for (_, t), p in zip(rows, parts, strict=True)],
                                  "text string, parts array<struct<mini:long,content:long,id:long,start:int,count:int,buckets:int>>")
    met = substrings._digests(texts, 50)
    assert met.select("digest").distinct().count() == 1 and met.select("salt").distinct().count() == 40
    found = substrings._least_of_windows(texts, 50)
    assert sorted(map(tuple, found.collect())) == [(1, i, 0, 1) for i in range(1, 1500)]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".") if kind == "ip"),
                    "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def test_pii_base_equals_patterns(spark):
    r = random.Random(1)
    bits = ["1", "22", "255", "300", "0004", ".", ".", " ", "-", "@", "a", "b.c", "+", "4111111111111111", "(", ")",
            "+1 (551) 555-0826", "x@y.z", "\n", "é", "😀", "://"]
    cases = ["".join(r.choice(bits) for _ in range(r.randint(1, 16))) for _ in range(20_000)] + [t for _, t in texts(spark)]
    for t in cases:
        assert [s for s in pii.find_spans(t) if s[0] in BASE] == brute_spans(t), t
    row = pii.op7_anchor_pii(spark.createDataFrame([(1, "é x@y.z 1.2.3.4")], "doc_id long, text string")).first()
    assert row["base_sha256"] == hashlib.sha256(b"email:2:7,ip:8:15").hexdigest() and row["n_ip"] == 1


def test_pii_adds_validated_accounts_and_addresses():
    t = 'IBAN: DE89370400440532013000 bad IBAN: DE89370400440532013001 token = "5d190bd7c06284de91015a36" 12 Baker Street'
    assert [t[a:b] for k, a, b in pii.find_spans(t) if k in ("account", "address")] == [
        "DE89370400440532013000", "5d190bd7c06284de91015a36", "12 Baker Street"]
    assert pii.find_spans("The token was lost on the road to the account of a Street.") == []


def test_pii_long_credentials_are_found_whole(spark):
    secret, password = "aB3_" * 225, "p4ss" * 100
    t = f"token={secret} see https://{'user' * 60}:{password}@host/x"
    assert [t[a:b] for k, a, b in pii.find_spans(t) if k == "account"] == [secret, f"{'user' * 60}:{password}"]
    row = pii.redact_documents(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
    assert row["text"] == "token=<ACCOUNT> see https://<ACCOUNT>@host/x"
    for long in ("token=" * 100_000, "token=a1" * 100_000, "://a" * 100_000, "://a:" * 100_000, "token" * 100_000 + "=" + "a1" * 100_000):
        pii.find_spans(long)


def test_pii_is_linear_in_long_runs():
    for t in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" + "(" * 200_000, "@" * 100_000):
        pii.find_spans(t)


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.co now", 15), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in pii.redact_documents(df).orderBy("doc_id").collect()] == [
        (1, "mail <EMAIL> now", 16), (2, None, None), (3, "clean", 5)]


def test_packing_covers_every_word_once(spark):
    docs = small(spark).withColumn("text", F.expr("if(doc_id % 50 = 0, repeat(concat(text, ' '), 9), text)"))
    n = {r[0]: len(WORD.findall(r[1])) for r in docs.select("doc_id", "text").collect()}
    rows = packing.pack_documents(docs, capacities=(64, 256, 1024), block_pieces=50).collect()
    spans, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        spans[r["doc_id"]].append((r["start"], r["length"]))
        if r["bin_id"] is not None:
            bins[r["bin_id"]].append(r)
    for k, parts in spans.items():
        at = 0
        for s, ln in sorted(parts):
            assert s == at
            at += ln
        assert at == n[k]
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        used, capacity = {(r["used"], r["capacity"]) for r in members}.pop()
        assert used == at and capacity == min(c for c in (64, 256, 1024) if c >= at)


def plain_best_fit(lengths, costs):
    """The same rules with a scan over all bins."""
    best = None
    for largest in sorted(costs):
        if max(lengths) > largest:
            continue
        allowed = {c: v for c, v in costs.items() if c <= largest}
        price, rest, bins = min(v / c for c, v in allowed.items()), sum(lengths), []
        for n in sorted(lengths, reverse=True):
            rest -= n
            fits = [b for b in bins if b[1] - b[0] >= n]
            b = min(fits, key=lambda b: b[1] - b[0]) if fits else None
            if b is None:
                bins.append(b := [0, min((c for c in allowed if c >= n), key=lambda c: (costs[c] - price * min(c - n, rest), c))])
            b[0] += n
        total = sum(costs[min(c for c in costs if c >= b[0])] for b in bins)
        best = total if best is None else min(best, total)
    return best


def test_packing_equals_plain_best_fit():
    r = random.Random(2)
    costs = packing.sequence_costs((16, 32, 64))
    for _ in range(200):
        lengths = [r.choice([r.randint(1, 64), r.randint(1, 9)]) for _ in range(r.randint(1, 60))]
        bins = packing.pack_block(lengths, costs)
        assert sorted(i for _, m in bins for i in m) == list(range(len(lengths)))
        assert sum(costs[c] for c, _ in bins) == plain_best_fit(lengths, costs)


def test_shards_are_even_and_gapless(spark, tmp_dir):
    rows = sharding.op9_virtual_slots(small(spark)).collect()
    size, slots = Counter(), defaultdict(list)
    for r in rows:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in rows)
    assert max(size.values()) - min(size.values()) <= largest


def plain_slot(doc_id, text, n_slots=4096):
    """The hash of key and text that Spark documents (xxHash64, seed 42, column by
    column, nulls passing the seed on), with a flag of null after each."""
    h = 42
    for value in (None if doc_id is None else doc_id.to_bytes(8, "little", signed=True),
                  doc_id is None, None if text is None else text.encode(), text is None):
        if isinstance(value, bool):
            value = int(value).to_bytes(4, "little")
        if value is not None:
            h = xxhash.xxh64(value, seed=h).intdigest()
    return (h - (1 << 64) if h >> 63 else h) % n_slots


def test_each_row_lies_where_its_slot_and_the_map_put_it(spark):
    docs = small(spark).select("doc_id", "text").union(spark.createDataFrame(
        [(None, "no id"), (None, None), (-5, None), (-6, ""), (2**60, "é\U0001f600")], "doc_id long, text string"))
    rows = [tuple(r) for r in docs.collect()]
    want, total = [], defaultdict(lambda: (0, 0))
    for i, t in rows:
        raw = (t or "").encode()
        s = plain_slot(i, t)
        want.append((i, len(raw) + 8, zlib.crc32(raw), s))
        total[s] = total[s][0] + len(raw) + 8, total[s][1] + 1
    # The heaviest slot goes to the lightest shard: by bytes, rows, slots, number.
    load_of, shard = [(0, 0, 0, k) for k in range(24)], {}
    for s, (b, n) in sorted(total.items(), key=lambda x: (-x[1][0], -x[1][1], x[0])):
        x = min(load_of)
        shard[s] = x[3]
        load_of[x[3]] = x[0] + b, x[1] + n, x[2] + 1, x[3]
    want = [(*x, shard[x[3]]) for x in want]
    got = [tuple(r) for r in sharding.shard_documents(docs).select("doc_id", "size", "text_crc32", "vslot", "shard").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_shards_are_even_with_many_rows_alike(spark):
    alike = [(None, "same text " * 10)] * 2000 + [(7, None)] * 1000
    rows = [*alike, *((i, "own %d " % i * 12) for i in range(100, 6100))]
    got = sharding.op9_virtual_slots(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    want = Counter((k, len(t or "") + 8) for k, t in rows)
    assert Counter((r["doc_id"], r["size"]) for r in got) == want
    size, slots = Counter(), defaultdict(list)
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(slots) == 24 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - min(size.values()) <= 0.01 * sum(size.values()) / 24


def test_growing_moves_slots_into_the_new_shard_only(spark, tmp_dir):
    r = random.Random(5)
    totals = [(s, r.randint(1, 1000), 3) for s in range(400)]
    old = sharding.balance(totals, 6, 400)
    new = sharding.grow(old, totals, 7)
    assert {b for a, b in zip(old, new, strict=True) if a != b} == {6}
    load_of = Counter()
    for s, b, _ in totals:
        load_of[new[s]] += b
    assert max(load_of.values()) < 1.1 * sum(load_of.values()) / 7
    sharding.store_map(spark, old, f"{tmp_dir}/map", 1, totals)
    sharding.store_map(spark, new, f"{tmp_dir}/map", 2, totals)
    assert [x["shard"] for x in sharding.load_map(spark, f"{tmp_dir}/map").orderBy("vslot").collect()] == new
    assert [x["shard"] for x in sharding.load_map(spark, f"{tmp_dir}/map", 1).orderBy("vslot").collect()] == old


def test_mix_meets_targets_and_reruns(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    rows = mixing.op6_pareto_mix(docs).collect()
    taken, target, largest = Counter(), {}, Counter()
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    for r in rows:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        target[s] = r["target"]
        largest[s] = max(largest[s], r["size"])
        assert 0 <= r["taken"] <= 3 * r["size"]
    # Whole documents: off by a part of one document at most, 3 % here.
    assert all(abs(taken[s] - t) <= min(largest[s] / 2, 0.03 * t) for s, t in target.items())
    assert sorted(rows) == sorted(mixing.op6_pareto_mix(docs.repartition(7)).collect())


REPEATED = {
    "one id": [(7, f"a b c d {i}", "s") for i in range(3000)] + [(10_000 + i, f"w x y z {i}", "s") for i in range(3000)],
    "null ids": [(None, f"a b c d {i}", "s") for i in range(3000)] + [(i, f"w x y z {i}", "s") for i in range(3000)],
    "alike": [(None, "a b c d e", "s")] * 4000 + [(i, f"w x y z {i}", "s") for i in range(2000)],
    "alike, with id": [(1, "a b c d e", "s")] * 2500 + [(i, f"w x y z {i}", "s") for i in range(2000)],
}


@pytest.mark.parametrize("name", REPEATED)
def test_mix_meets_targets_with_repeated_and_null_ids(spark, name):
    rows = REPEATED[name] + [(20_000 + i, "o p", None) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.op6_pareto_mix(df).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    for size in {r["source_size"] for r in got}:
        part = [r for r in got if r["source_size"] == size]
        assert abs(sum(r["taken"] for r in part) / part[0]["target"] - 1) < 0.01
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in part)
    again = mixing.op6_pareto_mix(df.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    want = con.sql(mixing.ORACLE_OP6)
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in got) == Counter(
        (r[0], r[1], r[4]) for r in want.fetchall())
    # The copies themselves, made from the same decisions.
    extra = df.withColumn("more", F.lit(1))
    mixed = mixing.mix(extra)
    assert mixed.columns == extra.columns
    for s, n in mixed.groupBy("source").agg(F.sum(F.size(F.split("text", " ")))).collect():
        target = next(r["target"] for r in got if r["source_size"] == sum(len(x[1].split()) for x in rows if x[2] == s))
        assert abs(n / target - 1) < 0.01


def test_tiers_are_mixed_by_weight(spark):
    df = spark.createDataFrame([(i, "a b c d", "s" if i % 2 else "t", 1 + i % 4 // 2) for i in range(2000)],
                               "doc_id long, text string, source string, grade long")
    out = mixing.mix(df, tier="grade").groupBy("source", "grade").count().collect()
    n = {(r["source"], r["grade"]): r["count"] for r in out}
    for s in "st":
        assert abs(n[s, 2] / n[s, 1] - 2) < 0.3 or n[s, 2] == 1500


def test_language_learns_and_holds_out(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    got = {r["doc_id"]: r for r in language.op10_string_kernel(docs).collect()}
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [k for k, r in got.items() if r["held_out"]]
    assert sum(got[k]["lang_pred"] == lang[k] for k in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    # What is held out, and what a row says of itself, is not used.
    lied = docs.withColumn("lang", F.expr("if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 'xx', lang)")).withColumn("source", F.lit("z"))
    assert {r["doc_id"]: r["lang_pred"] for r in language.op10_string_kernel(lied).collect()} == {k: r["lang_pred"] for k, r in got.items()}


def test_language_without_letters(spark):
    rows = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.op10_string_kernel(edges(spark)).collect()}
    assert rows[1] == rows[2] == rows[3] == ("und", 0.0) and rows[5][0] in ("en", "fr")


def test_presence_is_a_set():
    assert len(language.presence("abab")) == len({"a", "b", "ab", "ba", "aba", "bab"})
    assert len(language.presence("AbaB")) == len(language.presence("abab"))
    assert len(language.presence("12 !")) == 0 and len(language.presence("")) == 0
    assert len(language.presence("a1b")) == len({"a", "1", "b", "a1", "1b", "a1b"})
    assert len(np.intersect1d(language.presence("\u10d0\u10d1"), language.presence("\u0561\u0562"))) == 0


def grams(text):
    c = [x if unicodedata.category(x)[0] in "LM" else "." for x in text.lower()]
    return {tuple(c[i:i + n]) for n in (1, 2, 3) for i in range(len(c) - n + 1)}


def test_scores_equal_brute_force_kernel_ridge():
    rng = random.Random(2)
    texts = ["".join(rng.choices(a, k=rng.randrange(5, 60))) for a in ("abcde fg", "cdefg hij", "\u0561\u0562\u0563\u0564 ab") for _ in range(12)]
    labels = [k for k in "xyz" for _ in range(12)]
    model = language.fit([language.presence(t) for t in texts], labels, landmarks=9, ridge=0.01)
    new = ["abc abd", "hij hij cde", "\u0562\u0563 x", "zz 12"]
    got = language.score_batch(model, [language.presence(t) for t in new], cells=100)

    def kernel(a, b):
        a, b = grams(a), grams(b)
        return len(a & b) / math.sqrt(len(a) * len(b))

    marks = [texts[i] for i in (0, 1, 2, 12, 13, 14, 24, 25, 26)]
    c = np.array([[kernel(t, m) for m in marks] for t in texts])
    w = np.array([[kernel(t, m) for m in marks] for t in marks])
    y = np.array([[x == k for k in "xyz"] for x in labels], float)
    alpha = np.linalg.solve(c.T @ c + 0.01 * len(texts) * w + 1e-9 * np.eye(9), c.T @ y)
    want = np.array([[kernel(t, m) for m in marks] for t in new]) @ alpha
    assert np.allclose(got, want, atol=1e-4)


def test_languages_of_many_scripts(spark):
    rng = random.Random(5)
    letters = {"en": range(97, 123), "fr": [*range(97, 123), 233, 232, 234, 231, 224], "ka": range(0x10D0, 0x10F1),
               "hy": range(0x561, 0x587), "ru": range(0x430, 0x450), "el": range(0x3B1, 0x3CA), "zh": range(0x4E00, 0x4F00),
               "hi": [*range(0x905, 0x93A), *range(0x93E, 0x94D)]}
    rows = []
    for k, points in letters.items():
        vocabulary = ["".join(map(chr, rng.choices(list(points), k=rng.randrange(2, 8)))) for _ in range(300)]
        rows += [(len(rows) + i, " ".join(rng.choices(vocabulary, k=rng.randrange(8, 40))), k, "s", 1) for i in range(150)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in language.op10_string_kernel(docs).collect()}
    held = [r for r in rows if got[r[0]]["held_out"]]
    assert len(held) > 150
    for k in letters:
        mine = [r for r in held if r[2] == k]
        assert sum(got[r[0]]["lang_pred"] == k for r in mine) >= 0.97 * len(mine), k



def brute_lm(rows, target, size, min_count, pseudo):
    docs = [(k, (t or "").lower().split()) for k, t in rows]
    n = Counter(w for _, ws in docs for w in ws)
    total = sum(n.values())
    vocab = {w for w, c in n.items() if c >= min_count and c * size >= total}
    docs = [(k, ["<s>"] + [w if w in vocab else "<unk>" for w in ws]) for k, ws in docs]
    out = {}
    for x, (k, ws) in enumerate(docs):
        if len(ws) == 1:
            out[k] = None
            continue
        ce = []
        for side in (True, False):
            bi, ctx, uni = Counter(), Counter(), Counter()
            for y, (j, vs) in enumerate(docs):
                if x != y and (j in target) == side:
                    bi.update(zip(vs, vs[1:]))
                    ctx.update(vs[:-1])
                    uni.update(vs[1:])
            m = sum(uni.values())
            ce.append(-sum(math.log((bi[a, b] + pseudo * (uni[b] + 1) / (m + len(vocab) + 1)) / (ctx[a] + pseudo))
                           for a, b in zip(ws, ws[1:])) / (len(ws) - 1))
        out[k] = ce
    return out


def test_lm_equals_brute_force(spark):
    rows = [(i, " ".join(random.Random(i).choices("alpha beta gamma delta eps zeta rare%d" .replace("%d", str(i)).split(), k=i % 9)))
            for i in range(40)] + [(99, None)]
    target = set(range(0, 40, 3))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = spark.createDataFrame([(i,) for i in [*target, 0, 12345]], "doc_id long")
    got = {r["doc_id"]: r for r in lm.cross_entropy_difference(df, wanted, size=30, block_tokens=40, part_tokens=16).collect()}
    for k, ce in brute_lm(rows, target, 30, 2, lm.PSEUDO).items():
        assert got[k]["in_target"] == (k in target)
        if ce is None:
            assert got[k]["score"] is None and got[k]["n_tokens"] == 0
        else:
            assert [got[k]["ce_target"], got[k]["ce_background"]] == pytest.approx(ce)
            assert got[k]["score"] == pytest.approx(ce[0] - ce[1])


def test_lm_keeps_rare_words_on_large_corpora(spark):
    """A word twice among many tokens is a word, whatever the size of the corpus."""
    rows = [(i, "the of and to " * 20_000) for i in range(4)] + [(10, "the zebra the"), (11, "the zebra the"), (12, "the gnu the")]
    rows += [(20, "the okapi the"), (21, "the okapi the")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    target = {10, 11}
    got = {r["doc_id"]: r for r in lm.cross_entropy_difference(df, df.where("doc_id in (10, 11)"), block_tokens=100_000).collect()}
    for k, ce in brute_lm(rows, target, 10**9, 2, lm.PSEUDO).items():
        assert [got[k]["ce_target"], got[k]["ce_background"]] == pytest.approx(ce)
    assert got[10]["score"] != pytest.approx(got[20]["score"])


def test_nn_descent_equals_brute_force(spark):
    r = np.random.default_rng(8)
    base = r.standard_normal((300, 32))
    near = base[r.integers(0, 40, 300)] + 0.12 * r.standard_normal((300, 32))
    hot = base[7] + 0.05 * r.standard_normal((300, 32))
    v = np.concatenate([base, near, hot, np.repeat(base[3:4], 30, axis=0)]).astype(np.float32)
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)]
    odd = [(9001, None), (9002, [0.0] * 32), (9003, [float("nan")] * 32), (9004, [None] + [1.0] * 31), (9005, []),
           (9006, [1.0, 2.0]), (9007, [2.0, 4.0]), (None, [5.0, -1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({"node": F.lit(1), "vector": F.lit(2)})
    got = {r["vec_id"]: r for r in neardup.op2_nn_descent(df).collect()}
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    found = sum(got[i]["n_links"] for i in range(len(v)))
    assert found >= 0.97 * linked.sum() and all(got[i]["n_links"] <= linked[i].sum() for i in range(len(v)))
    for k in (9001, 9002, 9003, 9004, 9005):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True)
    assert got[9006]["n_links"] == 1 and got[9007]["component_id"] == 9006
    empty = df.limit(0)
    assert neardup.op2_nn_descent(empty).count() == 0


def test_nn_descent_joins_crowded_groups(spark):
    """Tight groups, larger than a list, that are near-duplicates of each other."""
    r = np.random.default_rng(5)
    rows, want = [], {}
    for pair in range(6):
        a, b = np.linalg.qr(r.standard_normal((32, 2)))[0].T
        for centre in (a, 0.96 * a + 0.28 * b):
            for _ in range(50):
                want[len(rows)] = (99, 100 * pair)
                rows.append((len(rows), (centre + 1e-4 * r.standard_normal(32)).tolist()))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)).collect()
    assert {x["vec_id"]: (x["n_links"], x["component_id"]) for x in got} == want


def test_audit_weighs_vectors_alike(spark, monkeypatch):
    """One hot group found whole, and 100 pairs all missed, among vectors without links."""
    r = np.random.default_rng(6)
    hot = r.standard_normal(32) + 1e-3 * r.standard_normal((300, 32))
    pairs = np.repeat(r.standard_normal((100, 32)), 2, axis=0) + 1e-3 * r.standard_normal((200, 32))
    v = np.concatenate([hot, pairs, r.standard_normal((300, 32))])
    nodes = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "node long, vector array<double>, copies long")
    met = spark.createDataFrame([(i, 299, 0) for i in range(300)], "node long, links long, label long")
    linked = met.select("node", F.lit(0).cast("long").alias("component"))
    assert neardup.audit(nodes, met, linked, 0.95) < 0.1
    whole = met.union(spark.createDataFrame([(i, 1, i - i % 2) for i in range(300, 500)], met.schema))
    assert neardup.audit(nodes, whole, linked, 0.95) == 1.0
    # A recall that stays too low is an error.
    monkeypatch.setattr(neardup, "audit", lambda *a: 0.5)
    monkeypatch.setattr(neardup, "ATTEMPTS", 1)
    df = nodes.limit(20).selectExpr("node as vec_id", "vector as embedding")
    with pytest.raises(RuntimeError, match="recall of 0.5"):
        neardup.near_duplicates(df)


# ---- registered queries and the pipeline -----------------------------------

@pytest.mark.parametrize("name", ["op1_quality_rules", "op2_nn_descent", "op3_super_kmers", "op6_pareto_mix"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF_SMALL}/{t}.parquet'")
    want = con.execute(catalog.ORACLE[name])
    cols = sorted(d[0] for d in want.description)
    want = con.execute(f"select {', '.join(cols)} from ({catalog.ORACLE[name]})").fetchall()
    df = catalog.QUERIES[name](spark, SF_SMALL)
    assert sorted(df.columns) == cols
    assert sorted(map(tuple, df.select(cols).collect()), key=str) == sorted(want, key=str)


def test_pipeline_equals_brute_force_stage_by_stage(spark):
    docs = small(spark).cache()
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, SF_SMALL).cache()
        after = [tuple(r) for r in out.collect()]
        if name == "quality":
            assert sorted(after) == sorted(r for r in before if brute_quality(r[1])[-1])
        elif name == "near_duplicates":
            keep = {c for _, c, _ in brute_jaccard([(r[0], r[1]) for r in before])}
            assert sorted(after) == sorted(r for r in before if r[0] in keep)
        elif name == "pii":
            assert Counter(r[0] for r in after) == Counter(r[0] for r in before)
            assert not any(brute_spans(r[1]) for r in after) and all(r[4] == len(r[1]) for r in after)
        elif name == "mixing":
            con = duckdb.connect()
            con.register("documents", docs.toPandas())
            # The stage also tells rows apart by their other columns.
            sql = mixing.ORACLE_OP6.replace("AS tie,", """|| '-' || md5(concat_ws('|', coalesce(lang, 'null'),
                coalesce(CAST(n_chars AS VARCHAR), 'null'))) AS tie,""", 1)
            want = {k: t // max(1, s) for k, s, t in con.execute(f"select doc_id, size, taken from ({sql})").fetchall()}
            assert Counter(after) == Counter({r: want[r[0]] for r in before if want[r[0]]})
        else:
            words_in = Counter()
            for r in before:
                words_in[r[0]] += len(WORD.findall(r[1]))
            words_out = Counter()
            for r in out.collect():
                words_out[r["doc_id"]] += r["length"]
            assert words_in == words_out
        docs = out
