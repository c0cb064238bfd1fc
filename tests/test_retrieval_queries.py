"""Retrieval queries against their SQL, at the size that the task fixes."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemill.operators import retrieval
from tidemill.plans import q_retrieval

SF = "/root/testdata/sf0.001"


def rows(columns, values):
    order = sorted(columns)
    at = [list(columns).index(c) for c in order]
    return order, sorted((tuple(round(v[i], 6) if isinstance(v[i], float) else v[i] for i in at) for v in values), key=repr)


def from_duckdb(sql):
    con = duckdb.connect()
    for t in ("embeddings", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = con.execute(sql)
    return rows([c[0] for c in out.description], out.fetchall())


def from_spark(spark, name):
    df = q_retrieval.QUERIES[name](spark, SF)
    return rows(df.columns, map(tuple, df.collect()))


NAMES = ["top1_vector_topk", "top3_boosts", "top5_hybrid_search", "top6_bm25", "top7_dense_and_keyword", "win12_relevant_rank", "agg13_retrieval_metrics", "agg13_recall_by_source", "agg13_search_report", "agg17_department_vote", "evl2_retrieval_evaluation", "jn7_benchmark_queries", "jn8_similarity_block"]


@pytest.mark.parametrize("name", NAMES)
def test_query_follows_its_sql(spark, name):
    assert from_spark(spark, name) == from_duckdb(q_retrieval.SQL[name])


def test_searches_take_every_twentieth_row():
    assert "q.id % 20 = 0" in q_retrieval.SQL["top1_vector_topk"] and "WHERE doc_id IN" not in q_retrieval.SQL["evl2_retrieval_evaluation"]


def test_small_runs_of_queries_give_the_same(spark, monkeypatch):
    whole = from_spark(spark, "top1_vector_topk"), from_spark(spark, "top6_bm25")
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 600)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    assert whole == (from_spark(spark, "top1_vector_topk"), from_spark(spark, "top6_bm25"))


def test_ties_and_text_ids(spark):
    corpus = spark.createDataFrame([(f"id{i:02d}", [1.0, float(i % 3)]) for i in range(30)] + [("none", None)], "id string, vector array<double>").repartition(3)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 2.0]), (3, None)], "query_id long, vector array<double>")
    found = sorted((r.query_id, r.rank, r.id) for r in retrieval.vector_topk(asked, corpus, 4).collect())
    assert found == [(1, i + 1, f"id{3 * i:02d}") for i in range(4)] + [(2, i + 1, f"id{3 * i + 2:02d}") for i in range(4)]
    assert retrieval.vector_topk(asked.limit(0), corpus, 4).count() == retrieval.bm25(spark.createDataFrame([(1, "")], "query_id long, text string"), corpus.select("id", "id").toDF("id", "text"), 3).count() == 0


def test_postings_find_every_score_that_may_count():
    """Scores by postings with a cut, against sums over all terms, at every threshold."""
    import numpy as np

    from tidemill.operators.retrieval import SLACK, _Postings, _Top

    rng = np.random.default_rng(1)
    for _ in range(300):
        docs, terms = int(rng.integers(1, 60)), int(rng.integers(1, 30))
        row, term = np.nonzero(rng.random((docs, terms)) < rng.random(terms) ** 2)
        weight = np.round(rng.random(len(row)) * rng.random(terms)[term] * 5, 2) + 0.01
        dense = np.zeros((docs, terms))
        dense[row, term] = weight
        order = rng.permutation(len(row))
        postings = _Postings(row[order], term[order], weight[order])
        asked = np.sort(rng.choice(terms + 5, int(rng.integers(1, terms + 5)), replace=False))
        want = dense[:, asked[asked < terms]].sum(axis=1)
        for least in (-np.inf, 0.0, *np.quantile(want, (0.5, 0.9, 1.0)), want.max() + 1):
            found, scores = postings.search(asked, least)
            assert np.allclose(scores, want[found]) and len(set(found.tolist())) == len(found)
            assert set(np.flatnonzero((want > 0) & (want >= least))) <= set(found.tolist()) and (want[found] >= least - 2 * SLACK).all()
        top = _Top(3)
        for part in np.array_split(np.arange(docs), 4):
            at = np.isin(row, part)
            own = _Postings(row[at], term[at], weight[at])
            found, scores = own.search(asked, top.least)
            if len(found):
                top.add(found, scores)
        best = sorted((-round(w, 9), i) for i, w in enumerate(want.tolist()) if w > 0)[:3]
        assert [(-s, i) for s, i in zip(top.scores.tolist(), top.ids.tolist() if top.ids is not None else [])] == best


def test_chunks_that_are_all_known_are_refused(spark):
    from tidemill.operators import ingest

    rows = [(1, 0, "정상적인 의료 문장이 여기에 있습니다."), (1, 1, "짧음"), (2, 0, " 정상적인 의료 문장이 여기에 있습니다. "), (2, 1, "또 하나의 정상적인 문장이 여기에 있습니다"), (3, 0, None)]
    chunks = spark.createDataFrame(rows, "doc long, place int, chunk string")
    kept, counts = ingest.gate_chunks(chunks, chunks.limit(0), ["doc", "place"])
    assert ingest.require_kept(counts) == {"total": 5, "rejected": 2, "duplicate": 1, "kept": 2}
    assert sorted((r.doc, r.place) for r in kept.collect()) == [(1, 0), (2, 1)]
    _, again = ingest.gate_chunks(chunks, kept, ["doc", "place"])
    with pytest.raises(ValueError, match="no chunk is left"):
        ingest.require_kept(again)


def test_an_evaluation_without_queries_is_a_row_of_zeros(spark):
    from tidemill.operators import evaluation

    corpus = spark.createDataFrame([(1, "a b"), (2, "c")], "id long, text string")
    queries = spark.createDataFrame([], "query_id long, text string, relevant_id long")
    row = evaluation.evaluate_embedding(corpus, queries, "hashing", 16).first().asDict()
    assert row.pop("config") == "hashing" and row.pop("dimension") == 16 and set(row.values()) == {0}
    assert tuple(evaluation.answer_metrics(evaluation.answer_cases(corpus.limit(0).withColumn("expected", F.lit("")).withColumn("predicted", F.lit("")))).first()) == (0, 0.0, 0.0)


def test_a_vector_search_works_on_bounded_blocks(monkeypatch):
    """The best rows of many small blocks are those of a plain sort, and no block of scores grows with a batch."""
    import numpy as np

    from tidemill.operators.retrieval import CORPUS_BLOCK, QUERY_BLOCK, QUERY_BYTES, _Best

    assert QUERY_BLOCK * CORPUS_BLOCK * 8 <= 4 << 20 and QUERY_BYTES <= 16 << 20
    rng = np.random.default_rng(3)
    for ids in (rng.permutation(900), np.array([f"n{i}" for i in rng.permutation(900)])):
        scores = np.round(rng.random((7, 900)), 2) + rng.choice([0.0, 2e-10], (7, 900))
        best = _Best(7, 5, 3)
        for at in np.array_split(np.arange(900), 40):
            at = at[np.argsort(ids[at])]
            best.see(ids[at], lambda i, j, at=at: scores[i:j][:, at])
        for q in range(7):
            want = sorted(zip(-np.round(scores[q], 9), ids.tolist()))[:5]
            assert list(zip(-best.scores[q // 3][q % 3], best.ids[q // 3][q % 3].tolist())) == want


def test_a_vector_search_takes_arrow_batches_in_parts(spark, monkeypatch):
    """What a task multiplies at once is no Arrow batch of 10,000 rows (80 MB of scores), but a part of it."""
    import numpy as np

    seen = []
    monkeypatch.setattr(retrieval._Best, "see", lambda self, ids, scores: seen.append(len(ids)))
    import pyarrow as pa

    class Corpus:
        """A stand-in that runs the task's function here."""

        def mapInArrow(self, f, kind):  # noqa: N802
            list(f([pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.array([[1.0, 2.0]] * 10_000)], names=["id", "vector"])]))
            return spark.createDataFrame([], kind)

        sparkSession = spark  # noqa: N815
        schema = spark.createDataFrame([], "id long, vector array<double>").schema
        where = select = lambda self, *_: self

    retrieval._nearest(spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>"), Corpus(), 3)
    assert sum(seen) == 10_000 and max(seen) <= 2048


def test_evaluations_follow_their_sql_on_texts_without_a_direction(spark, tmp_path):
    """Texts whose tokens cancel out in every bucket (NaN in SQL, sorted first), passages within words and of few words."""
    from tidemill.operators.embedding import _place

    places = {t: _place(t, 64) for t in (f"w{i}" for i in range(200))}
    a, b = next((x, y) for x in places for y in places if places[x] == (places[y][0], -places[y][1]))
    texts = [f"{a} {b}", f"{b} {a}", "the quick brown fox jumps over a lazy dog", "xthe quick brown fox jumps over a lazy dogs", "alpha beta", "gammalpha betas", f"{b} {a} {a} {b}", f"{a} {a} {b} {b}", "lazy dog", f"{a}, {b}!"]
    spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, "he quick brown fox jumps over a lazy do"), (2, "lpha bet"), (3, "lazy dog"), (4, "absent"), (5, None), (6, f"{a} {b}")]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("evl2_retrieval_evaluation", "top7_dense_and_keyword", "top6_bm25"):
        df, out = q_retrieval.QUERIES[name](spark, str(tmp_path)), con.execute(q_retrieval.SQL[name])
        assert rows(df.columns, map(tuple, df.collect())) == rows([c[0] for c in out.description], out.fetchall()), name


def test_passages_are_found_wherever_they_stand(spark):
    import random

    rng = random.Random(5)
    texts = ["".join(rng.choices("ab é", k=rng.randint(0, 3000))) for _ in range(60)] + [None, ""]
    cut = [t[i : i + n] for t in texts[:30] if t for n in (1, 7, 15, 16, 17, 40, 5000) for i in (0, len(t) // 2)]
    passages = [(i, p) for i, p in enumerate([*cut, "", "nowhere in any text", None])]
    for most in (retrieval.TEXT_BYTES, 100):
        want = {(i, p, min(d for d, t in enumerate(texts) if t is not None and p in t)) for i, p in passages if p is not None and any(t is not None and p in t for t in texts)}
        found = retrieval.first_holding(spark.createDataFrame(passages, "query_id long, text string"), spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)).collect()
        assert {tuple(r) for r in found} == want and len(found) == len(want)
        whole = retrieval._Passages([p.encode() for p in cut])
        old, retrieval.TEXT_BYTES = retrieval.TEXT_BYTES, most
        assert all(whole.within(t.encode()) == {i for i, p in enumerate(cut) if p in t} for t in texts[:10])
        retrieval.TEXT_BYTES = old


def test_embeddings_in_one_pass_add_rows_that_share_an_id(spark):
    from tidemill.operators import embedding

    rows_ = [(1, "a b c a"), (2, None), (3, ""), (1, "c d"), (4, "é ß"), (None, "x"), (None, "y x")] + [(i, f"t{i} u{i % 7}") for i in range(10, 3000)]
    got = {r.id: r.vector for r in embedding.hashing_embedding(spark.createDataFrame(rows_, "id long, text string").repartition(3), 16).collect()}
    joined = {}
    for i, t in rows_:
        joined[i] = joined.get(i, "") + " " + (t or "")
    want = dict(zip(joined, embedding.HashingProvider("h", 16).embed_texts(list(joined.values()))))
    assert got.keys() == want.keys() and all(abs(x - y) < 1e-12 for k in want for x, y in zip(got[k], want[k]))
    blank = embedding.hashing_embedding(spark.createDataFrame([(1, ""), (2, None)], "id long, text string").coalesce(1), 4).collect()
    assert sorted((r.id, r.vector) for r in blank) == [(1, [0.0] * 4), (2, [0.0] * 4)]
