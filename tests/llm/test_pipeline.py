"""The pipeline's stages against plain restatements, and all operators over tables with nulls and clashing columns."""

import importlib.util
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_operators import SF, odd, pairs  # noqa: F401
from tidemill.llm import chat, classifier, decontam, mixing, packing, quality_rules, secrets, shards, simhash, warc

CLASHES = ("row", "id", "fp", "n_words", "length", "score", "word", "h", "at", "task", "piece", "low", "m", "level", "label", "node", "spans", "value", "fold", "number", "base", "kept", "record", "digest", "key")


@pytest.fixture(scope="module")
def pipeline():
    path = Path(__file__).resolve().parents[2] / "corpus_pipeline.py"
    spec = importlib.util.spec_from_file_location("corpus_pipeline", path)
    module = importlib.util.module_from_spec(spec)
    sys.modules["corpus_pipeline"] = module
    spec.loader.exec_module(module)
    return module


def test_stages_on_odd_rows(spark, odd, pipeline):  # noqa: F811
    docs, texts = odd, {d: t for d, t in pairs(odd)}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "best-fit packing":
            assert {r.doc_id for r in out.collect()} == {d for d, _ in pairs(docs)}
            continue
        assert out.columns == docs.columns
        left = dict(pairs(out))
        assert set(left) <= {d for d, _ in pairs(docs)}
        if name == "quality rules":
            assert not any(brute.quality_counts(t)[-1] for t in left.values())
        if name == "secret scans":
            assert set(left) == {d for d, _ in pairs(docs)} and all(not brute.base_spans(t) for t in left.values())
        else:
            assert all(t == texts[d] for d, t in left.items() if d is not None)
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs = spark.createDataFrame(out.collect(), docs.schema)


def test_stages_on_documents(spark, pipeline):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = pairs(spark.read.parquet(f"{SF}/benchmark.parquet"), "item_id", "text")
    kept = pipeline.quality(spark, docs, SF)
    once = pipeline.near_dedup(spark, kept, SF)
    left = [brute.lower(t) for _, t in pairs(once)]
    assert len(left) == len(set(left)) and {brute.lower(t) for _, t in pairs(kept)} >= set(left)
    least = {}
    for d, t in pairs(kept):
        least[brute.lower(t)] = min(d, least.get(brute.lower(t), d))
    assert {d for d, _ in pairs(once)} <= set(least.values())
    clean = pipeline.decontaminate(spark, once, SF)
    dirty = {r[0] for r in brute.decontaminate(pairs(once), bench) if r[-1]}
    assert {d for d, _ in pairs(clean)} == {d for d, _ in pairs(once)} - dirty
    safe = pipeline.secret_scan(spark, clean, SF)
    spans = {d: brute.base_spans(t) for d, t in pairs(clean)}
    for d, t in pairs(safe):
        assert ("[SECRET]" in t) >= bool(spans[d]) and (spans[d] or t == dict(pairs(clean))[d] or "[SECRET]" in t)
    assert all(r.n_chars == len(r.text) for r in safe.collect())


def test_run(spark, pipeline):
    out = pipeline.run(spark, SF)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
    assert 0 < out.select("doc_id").distinct().count() < spark.read.parquet(f"{SF}/documents.parquet").count()


def test_extra_columns_with_clashing_names(spark, pipeline):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    extra = docs.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHES)])
    bench, labels = spark.read.parquet(f"{SF}/benchmark.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    pages, talks = spark.read.parquet(f"{SF}/pages.parquet").limit(40), spark.read.parquet(f"{SF}/conversations.parquet")
    wide = lambda df: df.select("*", *[F.lit("x").alias(c) for c in CLASHES])
    same = [
        (quality_rules.report, (docs,), (extra,)), (simhash.report, (docs,), (extra,)), (decontam.report, (docs, bench), (extra, wide(bench))), (secrets.report, (docs,), (extra,)), (packing.packed, (docs,), (extra,)),
        (classifier.report, (docs, labels), (extra, wide(labels))), (chat.report, (talks,), (wide(talks),)), (warc.report, (pages,), (wide(pages),)),
    ]
    for f, plain, clashing in same:
        assert sorted(map(repr, f(*plain).collect())) == sorted(map(repr, f(*clashing).collect())), f
    for f in (mixing.score, shards.report):
        assert sorted(map(repr, f(docs.coalesce(1)).collect())) == sorted(map(repr, f(extra.coalesce(1)).collect())), f
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, extra, SF)
        assert out.columns == extra.columns and out.where("at <> 'x8'").count() == 0, name


def test_classifier_on_odd_rows(spark, odd):  # noqa: F811
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (5, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    rows = classifier.report(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    empty = [r.score for r in rows if r.doc_id in (0, 1)]
    assert empty[0] == empty[1]


def test_op4_and_op7_over_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(None,) * 5, (1, None, None, None, None), (None, "a b c d e f", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(None, None, None), (1, None, None)], "doc_id long, quality int, toxic int")
    assert shards.report(docs).agg(F.sum("n_ids")).first()[0] == 3 + 6 and classifier.report(docs, labels).where("score = 0.5").count() == 3
    assert classifier.report(docs.limit(0), labels).count() == shards.report(docs.limit(0)).count() == mixing.score(docs.limit(0)).count() == 0


def test_a_text_of_many_megabytes(spark):
    """One long text, without and with spaces: whole results, in bounded memory."""
    words = " ".join(f"w{i * i % 7919}" for i in range(1_200_000))
    texts = [words, "x" * 6_000_000, "short one"]
    docs = spark.createDataFrame([(i, t, "en", "s0", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    bench = spark.createDataFrame([(0, words[-400:]), (1, "y " * 20)], "item_id long, text string")
    tokens = {0: 1_200_001, 1: 2, 2: 3}
    assert {r.doc_id: r.n_tokens for r in mixing.score(docs).collect()} == tokens
    found = {r.doc_id: r for r in decontam.report(docs, bench).collect()}
    assert found[0].contaminated and found[0].n_words == 1_200_000 and not found[1].contaminated
    counts = {r.doc_id: r.n_words for r in quality_rules.report(docs).collect()}
    assert counts == {i: n - 1 for i, n in tokens.items()}
    assert simhash.report(docs).count() == 3 and classifier.score(docs, (np.zeros(classifier.BUCKETS, np.float32), 0.0)).where("score = 0.5").count() == 3


def test_nulls_in_every_column(spark):
    docs = spark.createDataFrame([(None,) * 5, (1, None, None, None, None), (None, "a b c d e f", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    nothing = spark.createDataFrame([(None, None)], "item_id string, text string")
    assert decontam.report(docs, nothing).count() == simhash.report(docs).count() == packing.packed(docs).count() == quality_rules.report(docs).count() == secrets.report(docs).count() == mixing.score(docs).count() == 3
    assert warc.report(spark.createDataFrame([(None, None, None)], "page_id long, url string, html string")).count() == 1
    assert chat.report(spark.createDataFrame([(None, None, None, None)], "conv_id long, turn int, role string, text string")).count() == 2
