"""Line field, centroid search and prefix trie against brute force, and their edge cases."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from convprep.llm import catalog, centroids, linecrf, trie
from convprep.llm.common import load

# ---- line field ------------------------------------------------------------


def brute_chain(good, joint):
    """Marginals and log-partition by summing over all labellings."""
    n = len(good)
    weights = {}
    for y in itertools.product((0, 1), repeat=n):
        e = sum(g for g, v in zip(good, y) if v) + sum(joint[a][b] for a, b in zip(y, y[1:]))
        weights[y] = math.exp(e)
    z = sum(weights.values())
    return [sum(w for y, w in weights.items() if y[i]) / z for i in range(n)], math.log(z)


def test_marginals_equal_brute_force():
    rng = np.random.default_rng(5)
    sizes = [1, 2, 7, 1, 5, 3, 8]
    place = np.concatenate([np.arange(n) for n in sizes])
    good, joint = rng.normal(size=len(place)) * 2, rng.normal(size=(2, 2))
    got = linecrf.marginals(good, joint, place)
    want = [m for part in np.split(good, np.cumsum(sizes)[:-1]) for m in brute_chain(part, joint)[0]]
    assert np.allclose(got, want, atol=1e-12)


def test_loss_gradient_and_partition():
    rng = np.random.default_rng(6)
    sizes = [1, 4, 6, 2]
    place = np.concatenate([np.arange(n) for n in sizes])
    x, y = rng.normal(size=(len(place), 3)), rng.integers(0, 2, len(place))
    weight = np.repeat([1.0, 0.25, 0.5, 2.0], sizes)
    p = rng.normal(size=7)
    value, grad = linecrf._loss(p, x, place, y, weight, 0.1)
    joint = p[3:].reshape(2, 2)
    want = 0.0
    for lo, n, w in zip(np.cumsum(sizes) - sizes, sizes, (1.0, 0.25, 0.5, 2.0)):
        g, labels = x[lo:lo + n] @ p[:3], y[lo:lo + n]
        score = (g * labels).sum() + sum(joint[a, b] for a, b in zip(labels, labels[1:]))
        want += w * (brute_chain(g, joint)[1] - score)
    assert value == pytest.approx(want / 3.75 + 0.05 * p @ p)
    for k in range(7):
        d = np.zeros(7)
        d[k] = 1e-6
        slope = (linecrf._loss(p + d, x, place, y, weight, 0.1)[0] - linecrf._loss(p - d, x, place, y, weight, 0.1)[0]) / 2e-6
        assert grad[k] == pytest.approx(slope, abs=1e-5)


def test_strong_evidence_does_not_overflow():
    place = np.arange(5000)
    got = linecrf.marginals(np.tile([900.0, -900.0], 2500), np.array([[1.0, -2.0], [-2.0, 1.0]]), place)
    assert np.isfinite(got).all() and got[0] > 0.99 and got[1] < 0.01


def test_features_do_not_depend_on_neighbouring_documents():
    texts = ["Ab cd.\nEF  12\n\nab ab", None, "", "x" * 30 + " y\ny", "a\tb\x0bc $$ é日本", "Ab cd.\nEF  12\n\nab ab"]
    f, place, chars = linecrf.line_features(texts)
    sizes = [(t or "").count("\n") + 1 for t in texts]
    assert place.tolist() == [i for n in sizes for i in range(n)]
    assert chars.tolist() == [len(x) for t in texts for x in (t or "").split("\n")]
    alone = np.concatenate([linecrf.line_features([t])[0] for t in texts])
    assert np.allclose(f, alone)
    assert np.allclose(f[:4], f[-4:])


def field(spark):
    docs, labels = load(spark, "/root/testdata/sf0.01", "documents"), load(spark, "/root/testdata/sf0.01", "labels")
    return docs, labels


def test_quality_on_held_out_documents(spark):
    docs, labels = field(spark)
    rows = linecrf.op11_line_crf(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    pairs = [(a["score"] > b["score"]) + 0.5 * (a["score"] == b["score"]) for a in held for b in held if a["quality"] > b["quality"]]
    assert len(held) > 40 and sum(pairs) / len(pairs) > 0.99
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.97


def test_score_is_the_length_weighted_mean_of_line_marginals(spark):
    docs, labels = field(spark)
    model = linecrf.train(docs, labels, per_label=100)
    some = docs.where("doc_id < 60")
    score = {r["row"]["doc_id"]: r["score"] for r in linecrf.score_documents(some, model).collect()}
    lines = defaultdict(dict)
    for r in linecrf.label_lines(some, model).collect():
        lines[r["row"]["doc_id"]][r["line"]] = r["good"]
        assert r["label"] == int(r["good"] >= 0.5)
    for r in some.collect():
        parts = r["text"].split("\n")
        assert sorted(lines[r["doc_id"]]) == list(range(len(parts)))
        w = [len(p) + 1 for p in parts]
        assert score[r["doc_id"]] == pytest.approx(sum(a * lines[r["doc_id"]][i] for i, a in enumerate(w)) / sum(w))


DOCS = "doc_id long, text string, lang string, row int, id int, score int"
LONG = "\n".join(f"Line {i} says w{i % 31} and more." for i in range(20_000))


def test_field_edges(spark):
    rows = [(2**53 + 1, None, "en", 1, 1, 1), (None, "Some text.", None, 1, 1, 1), (2, "", "en", 1, 1, 1), (3, "\n\n", "en", 1, 1, 1),
            (4, LONG, "en", 1, 1, 1), (5, "Ab cd.", "en", 1, 1, 1), (5, "Ab cd.", "en", 1, 1, 1), (6, "x" * 200_000, "en", 1, 1, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(2, 0, 1), (3, 1, 0), (4, 1, 0), (None, 1, 1), (5, None, 0), (5, 0, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    got = linecrf.op11_line_crf(docs, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert all(r["score"] is not None and 0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    # No labels, labels of one kind, no documents.
    assert {r["score"] for r in linecrf.op11_line_crf(docs, labels.where("false")).collect()} == {0.5}
    assert len(linecrf.op11_line_crf(docs, labels.where("quality = 1")).collect()) == len(rows)
    assert linecrf.op11_line_crf(docs.where("false"), labels).collect() == []


# ---- centroids -------------------------------------------------------------


def test_transform_is_the_hadamard_matrix():
    x = np.random.default_rng(1).integers(-5000, 5000, (7, 64))
    h = centroids.hadamard(64)
    assert (centroids.transform(x) == x @ h.T).all()
    assert (h @ h.T == 64 * np.eye(64)).all()
    assert ((h[:, 1:] != h[:, :-1]).sum(axis=1) == np.arange(64)).all()


def test_search_is_exact_and_drops_centroids():
    rng = np.random.default_rng(2)
    centers = rng.integers(-300, 300, (8, 64))
    centers[5] = centers[2]  # a tie
    x = centers[rng.integers(0, 8, 500)] + rng.integers(-40, 40, (500, 64))
    best, far, work = centroids.nearest(centroids.transform(x), centroids.transform(centers))
    d = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2)
    assert (best == d.argmin(axis=1)).all() and (far == 64 * d.min(axis=1)).all() and 5 not in best
    assert work < 500 * 8 * 64 * 0.7
    y = rng.integers(-9, 9, (300, 64))  # nothing to drop, many ties
    few = rng.integers(-1, 2, (8, 64))
    best, far, _ = centroids.nearest(centroids.transform(y), centroids.transform(few))
    d = ((y[:, None, :] - few[None]) ** 2).sum(axis=2)
    assert (best == d.argmin(axis=1)).all() and (far == 64 * d.min(axis=1)).all()


def brute_lloyd(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centers = [list(v) for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        centers = [[sum(col) // at.count(j) for col in zip(*[v for (_, v), a in zip(kept, at) if a == j])] if j in at else c
                   for j, c in enumerate(centers)]
    got = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in got:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return Counter((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, d, j in got)


def digest(df):
    return Counter((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


VECS = "vec_id long, embedding array<double>, cluster int, id int, a int, v int, coef int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, 1, 1, 1) for r in rows], VECS).repartition(3)


def test_clusters_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.3) + (i % 5) for _ in range(64)]) for i in range(120)]
    rows += [(200, rows[0][1])] * 30 + [(2**53 + 1, rows[1][1]), (None, rows[2][1]), (None, rows[3][1]), (7, rows[4][1])]
    rows += [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, [None] + [1.0] * 63),
             (305, [float("nan")] + [1.0] * 63), (306, [float("inf")] + [1.0] * 63), (307, [-0.0] * 64)]
    assert digest(centroids.op12_walsh_hadamard(vectors(spark, rows))) == brute_lloyd(rows)


def test_few_equal_and_large_vectors(spark):
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-0.25] * 64)]
    assert digest(centroids.op12_walsh_hadamard(vectors(spark, rows))) == brute_lloyd(rows)
    big = [(i, [x * 1e5 for x in range(i, i + 64)]) for i in range(20)]  # beyond the 64-bit fast path
    assert digest(centroids.op12_walsh_hadamard(vectors(spark, big))) == brute_lloyd(big)
    assert centroids.op12_walsh_hadamard(vectors(spark, rows).where("false")).collect() == []


# ---- trie ------------------------------------------------------------------


def test_double_array_walks_all_strings():
    rng = random.Random(4)
    strings = sorted({tuple(rng.randrange(9) for _ in range(rng.randrange(1, 7))) for _ in range(400)})
    codes, sizes = np.array([c for s in strings for c in s]), np.array([len(s) for s in strings])
    t = trie.DoubleArray(codes, sizes)
    states = t.walk(codes, sizes)
    where = {}
    for s, part in zip(strings, np.split(states, np.cumsum(sizes)[:-1])):
        for d, state in enumerate(part):
            assert where.setdefault(s[:d + 1], state) == state
    assert len(set(where.values())) == len(where)  # a state for each prefix
    assert len(where) > 0.5 * (t.check >= 0).sum()
    with pytest.raises(ValueError):
        t.walk(np.array([8, 8, 8, 8, 8, 8, 8]), np.array([7]))


def brute_trie(rows, shared=lambda c: 0, family=1):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            code = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            convs[c].append((t is not None, t or 0, code, role, text))
    convs = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        base = c - int(math.fmod(c, family))
        built[c] = tuple(convs.get(base, [])[:shared(c)] + own[shared(c):])
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = Counter(s[:-1] for s in members if s)
    leaves, saved = Counter(), Counter()
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += kids[s] == 0
            saved[s[:d]] += (len(m) - 1) * len(s[-1][1]) if s else 0
    out = Counter()
    for s, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(s))))
        out[(min(m), len(s), min(members[s[:-1]]) if s else None, len(m), kids[s], leaves[s], saved[s],
             hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def nodes(df):
    return Counter(tuple(r[c] for c in trie._OUT) for r in df.select(*trie._OUT).collect())


TURNS = "conv_id long, turn long, role string, text string, i int, code int, key int, depth int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, 1, 1) for r in rows], TURNS)


@pytest.mark.parametrize("segment, shard", [(64, 100_000), (3, 40), (1, 10), (2, 5)])
def test_trie_equals_brute_force(spark, segment, shard):
    rng = random.Random(segment)
    rows = []
    for c in range(-130, 260, 3):
        for t in range(rng.choice([1, 2, 5, 9])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "bot", None]), rng.choice(["a", "bb", "", None, "é日"])))
    rows += [(500 + c, t, "user", "same" * t) for c in range(60) for t in range(7)]  # copies
    rows += [(100, t, "user", f"turn {t // 2}") for t in range(80)]  # a long conversation, and half of it again
    rows += [(101, t, "user", f"turn {t // 2}") for t in range(40)]
    rows += [(0, 0, "user", "twice"), (0, 0, "user", "twice"), (None, 1, "user", "x")]
    rng.shuffle(rows)
    part = trie.conversation_trie(turns(spark, rows).repartition(5), segment=segment, shard_turns=shard)
    assert nodes(part) == brute_trie(rows)


def test_rebuilt_conversations_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(c, t, "user", rng.choice("abc")) for c in [*range(-105, 320, 2), 200, 1000, 2**53 + 1] for t in range(rng.randrange(1, 8))]
    got = trie.op13_double_array(turns(spark, rows)).withColumnRenamed("ends_sha256", "ends")
    assert nodes(got) == brute_trie(rows, lambda c: zlib.crc32(str(c).encode()) % 6, 100)


def test_trie_edges(spark):
    empty = turns(spark, []).where("false")
    assert trie.op13_double_array(empty).collect() == []
    assert trie.op13_double_array(turns(spark, [(None, 1, "a", "b")])).collect() == []
    # A conversation all of whose turns are replaced, by one that is absent, is a member of the root alone.
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 >= 2)
    got = trie.op13_double_array(turns(spark, [(c, 0, "a", "b"), (c, 1, None, None)])).collect()
    assert [(r["conv_id"], r["depth"], r["n_convs"], r["n_children"], r["n_leaves"]) for r in got] == [(c, 0, 1, 0, 1)]
    assert got[0]["ends_sha256"] == hashlib.sha256(str(c).encode()).hexdigest()


# ---- SQL -------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op12_walsh_hadamard", "op13_double_array"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    want = con.sql(catalog.ORACLE[name])
    got = catalog.QUERIES[name](spark, SF_SMALL).select(*want.columns)
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
