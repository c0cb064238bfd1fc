"""Phrases, hard negatives and exact search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemill.llm import classifier, collocations, negatives, quality_rules, simhash, topk

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_phrases(rows, least, top=2000, longest=5):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    f[lang, tuple(w[i : i + n])] += 1
    kept = {k: v for k, v in f.items() if v >= least}
    out = []
    for (lang, p), a in kept.items():
        inside = any(100 * v >= 100 * a for (x, q), v in kept.items() if x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
        if len(p) > 1 and not inside:
            score, _, l, r = min((1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.append((lang, -score, -a, " ".join(p).encode(), l, r, total[lang]))
    out.sort()
    ranks, done = Counter(), []
    for lang, score, a, p, l, r, n in out:
        ranks[lang] += 1
        if ranks[lang] <= top:
            done.append((lang, ranks[lang], p.decode(), -a, l, r, n, -score))
    return done


@pytest.fixture(scope="module")
def phrase_rows():
    rng = random.Random(5)
    words = ["the", "Of", "é", "ÉCOLE", "a-b", "日本", "x", "y", "İ", "\x1c", "the", "the"]
    rows = [("en", None), (None, ""), ("fr", " \t "), (None, "..!"), ("xx", None)]
    rows += [(rng.choice(["en", "fr", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(rng.randint(1, 120)))) for _ in range(60)]
    return [*rows, rows[9], rows[9], ("en", "One fine day. " * 300), ("fr", "the same words " * 4000)]


@pytest.mark.parametrize("bits", [64, 9, 1])
def test_phrases(spark, phrase_rows, bits):
    docs = spark.createDataFrame([(i, t, g, 0) for i, (g, t) in enumerate(phrase_rows)], "doc_id long, text string, lang string, n long")
    found = sorted(map(tuple, collocations.report(docs.repartition(3), least=12, top=40, bits=bits).collect()))
    assert found == brute_phrases(phrase_rows, 12, 40) and len(found) > 40


def test_phrases_of_one_length_and_of_nothing(spark, phrase_rows):
    docs = spark.createDataFrame(phrase_rows, "lang string, text string")
    assert collocations.report(docs.limit(0)).count() == 0
    assert collocations.report(docs, least=10**6).count() == 0
    assert sorted(map(tuple, collocations.report(docs, least=12, longest=2).collect())) == brute_phrases(phrase_rows, 12, longest=2)


def test_phrase_scores_beyond_64_bits(spark):
    big = 10**15
    found = spark.createDataFrame([("en", 0, "", 7 * big), ("en", 1, "a", big + 1), ("en", 1, "b", big + 3), ("en", 2, "a b", big)], "lang string, n int, phrase string, k long")
    assert collocations.scored(found).first()["score"] == 1000 * big * 7 * big // ((big + 1) * (big + 3))


def whole(rows):
    """(id, label, integer vector) of the rows that take part, once each."""
    out = {(i, label, tuple(math.floor(256 * x) for x in v)) for i, v, label in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    return sorted(out, key=repr)


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute_topk(rows, k=5):
    vectors = {(i, v) for i, _, v in whole(rows)}
    out = []
    for i, q in vectors:
        if i % 50 == 0:
            found = sorted({(-dot(q, v), j) for j, v in vectors if j != i})[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def brute_negatives(rows, k=5):
    vectors = [(i, (label + 1) % 10 if i % 7 == 0 else label, v) for i, label, v in whole(rows) if label is not None]
    out = []
    for i, y, q in vectors:
        if i % 100:
            continue
        scores = {(-dot(q, v), j, z == y) for j, z, v in vectors if j != i}
        for p, j, _ in sorted(x for x in scores if x[2])[:k]:
            fit = sorted((s, m) for s, m, same in scores if not same and 80 * -p <= 100 * -s <= 100 * -p)[:k]
            out += [(i, j, r + 1, m, -p, -s) for r, (s, m) in enumerate(fit)]
    return sorted(out)


@pytest.fixture(scope="module")
def vector_rows():
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.3, 6).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(1200)]
    same = rng.normal(0, 0.3, 6).astype(np.float32).tolist()
    rows += [(2000 + i, same, i % 3) for i in range(300)]  # one vector, many ids
    rows += [(3000 + i, (np.array(same) * 2).tolist(), 1) for i in range(101)]
    nan, inf = float("nan"), float("inf")
    rows += [(5000, None, 1), (5050, [], 1), (5100, [0.0] * 6, 2), (5150, [nan] + [1.0] * 5, 1), (5200, [1.0] * 5 + [-inf], 1), (5250, [1.0, None], 1), (5300, [1.0, 2.0], None), (5350, [3.0, -1.0], 2), (None, [9.0] * 6, 1)]
    rows += [(5400, [30000.5] * 6, 1), (5401, [-30000.25, 30000.0, 1.0], 2), (5500, [200000.0] * 6, 2)]
    return [*rows, rows[0], rows[50], rows[100]]  # repeated rows


VECTORS = "vec_id long, embedding array<double>, label int"


def test_threshold_search(spark, vector_rows):
    df = spark.createDataFrame(vector_rows, VECTORS)
    want = brute_topk(vector_rows)
    assert sorted(map(tuple, topk.report(df).collect())) == want
    clashing = df.select("*", *[df.vec_id.alias(c) for c in ("id", "v", "query", "score", "rank")])
    assert sorted(map(tuple, topk.report(clashing, block=64, query_bytes=2000).collect())) == want  # many blocks of rows and of queries
    assert topk.report(df.limit(0)).count() == topk.report(df.where("vec_id = 50").distinct()).count() == 0


def test_threshold_search_stops_early():
    rng = np.random.default_rng(3)
    rows = np.floor(np.abs(rng.standard_cauchy((8000, 4))) * 50).clip(0, 5000)
    lists, read = topk.Lists(rows, np.arange(8000), 5), 0
    for q in rng.integers(1, 9, (20, 4)).astype(float):
        best = topk.Best(5)
        read += lists.search(q, -1, best)
        s = (rows @ q).astype(int)
        assert best.ids.tolist() == np.lexsort((np.arange(8000), -s))[:5].tolist()
    assert read < 20 * 8000 / 4


def test_hard_negatives(spark, vector_rows):
    df = spark.createDataFrame(vector_rows, VECTORS)
    want = brute_negatives(vector_rows)
    assert len(want) > 100 and sorted(map(tuple, negatives.report(df).collect())) == want
    clashing = df.select("*", *[df.vec_id.alias(c) for c in ("id", "v", "anchor", "score", "windows", "rank")])
    assert sorted(map(tuple, negatives.report(clashing, block=256, query_bytes=500).collect())) == want
    assert negatives.report(df.limit(0)).count() == negatives.report(df.where("vec_id = 100")).count() == negatives.report(df.where("label IS NULL")).count() == 0


def test_boxes_prune():
    rng = np.random.default_rng(4)
    rows = np.floor(rng.normal(0, 100, (4000, 2)))
    tree = negatives.Tree(rows, rng.integers(0, 5, 4000), np.arange(4000), leaf=32, fanout=4)
    for level in tree.levels:
        for i in range(len(level.low)):
            assert (level.low[i] <= level.high[i]).all()
    q = np.array([[3.0, -2.0]])
    bounds = [(low[0].tolist(), high[0].tolist()) for low, high in tree.bounds(q)]
    s = (tree.vectors @ q[0]).astype(int)
    for window, same in (((-math.inf, math.inf), True), ((100.0, 300.0), False)):
        best = [negatives.Best(5)]
        read = tree.walk(q[0], bounds, [window], best, 3, same, -1)
        fit = [(-x, i) for x, i, y in zip(s.tolist(), tree.ids.tolist(), tree.labels.tolist()) if (y == 3) == same and window[0] <= x <= window[1]]
        assert list(zip((-best[0].scores).tolist(), best[0].ids.tolist())) == sorted(fit)[:5]
        assert read < 4000 / 32 / 2


def test_near_duplicates_in_groups_of_copies_with_edited_blocks(spark):
    """Thirty groups of forty copies, each with one to three blocks of its own: similarities lie around 0.8, links hang together in all ways."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    texts = []
    for _ in range(30):
        base = [word() for _ in range(200)]
        for _ in range(40):
            own = list(base)
            for _ in range(rng.randint(1, 3)):
                at, n = rng.randrange(190), rng.randint(2, 10)
                own[at : at + n] = [word() for _ in range(n)]
            texts.append(own)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = 0
    for g in range(0, len(texts), 40):
        for i in range(g, g + 40):
            for j in range(g, i):
                if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    pairs += 1
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    assert pairs > 1000
    found = simhash.near_duplicates(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string"))
    assert {r.id: r.component_id for r in found.collect()} == {i: find(i) for i in range(len(texts))}


def test_fences_follow_their_rule(spark):
    """Quartiles of logarithmic buckets, blended with those of the language, whose own are blended with those of everything."""
    rng = random.Random(6)
    rows = [(" ".join("ab$"[: rng.randint(1, 3)] * rng.randint(1, 4) for _ in range(rng.randint(1, 60))), g, h) for g, h, n in (("en", "x", 150), ("en", "y", 3), ("fr", "x", 40), (None, None, 1)) for _ in range(n)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    found = {(r.lang, r.source): r for r in quality_rules.thresholds(quality_rules.measure(docs)).collect()}
    gamma = (1 + quality_rules.ACCURACY) / (1 - quality_rules.ACCURACY)

    def quartiles(values):
        b = sorted(-(10**9) if v == 0 else math.ceil(math.log(v) / math.log(gamma)) for v in values)
        at = [b[math.ceil(len(b) * q) - 1] for q in (0.25, 0.75)]
        return [0.0 if x == -(10**9) else gamma**x * 2 / (1 + gamma) for x in at], len(b)

    def blended(own, wide):
        (q, n), w = own, quality_rules.BLEND
        return [(n * a + w * b) / (n + w) for a, b in zip(q, wide)]

    for m, value in (("symbol_share", lambda t: t.count("$") / len(t.replace(" ", ""))), ("word_length", lambda t: len(t.replace(" ", "")) / len(t.split()))):
        least, every = quality_rules.MEASURES[m][2], quartiles([value(t) for t, _, _ in rows])[0]
        for (g, h), r in found.items():
            by_lang = blended(quartiles([value(t) for t, x, _ in rows if x == g]), every)
            q1, q3 = blended(quartiles([value(t) for t, x, y in rows if (x, y) == (g, h)]), by_lang)
            reach = max(least, quality_rules.REACH * (q3 - q1))
            assert r[f"{m}_low"] == pytest.approx(q1 - reach) and r[f"{m}_high"] == pytest.approx(q3 + reach)


def test_model_of_repeated_ids(spark):
    """Labels and documents that repeat an id give one model, whatever order they come in."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    docs += [(r.doc_id, docs[(i * 7) % len(docs)].text) for i, r in enumerate(docs[:60])]
    labels = [(r[0], i % 2) for i, r in enumerate(docs)]
    models = []
    for seed in (1, 2):
        d, y = random.Random(seed).sample(docs, len(docs)), random.Random(seed).sample(labels, len(labels))
        models.append(classifier.train(spark.createDataFrame(d, "doc_id long, text string"), spark.createDataFrame(y, "doc_id long, quality int")))
    assert models[0][1] == models[1][1] and (models[0][0] == models[1][0]).all()
