"""TOP1-TOP7, JN1, JN7-JN10, WIN9, WIN12, EMB1-EMB4, EVL1, EVL2, AGG13, AGG17, AGG21, SCL14, FLT14 over embeddings, documents and benchmark."""

from pyspark.sql import functions as F

from tidemill.functions import text as X
from tidemill.operators import consultation as C
from tidemill.operators import embedding as E
from tidemill.operators import evaluation as V
from tidemill.operators import lexicon as L
from tidemill.operators import retrieval as R
from tidemill.plans.tables import benchmark, documents, embeddings, scratch

# provider A: the first 32 dimensions, provider B: the last
_HALF = {"a": 1, "b": 33}


def _store(s, d):
    e = embeddings(s, d)
    return e.select(F.explode(F.array(*[F.struct(F.lit(p).alias("provider"), F.slice("embedding", i, 32).alias("vector")) for p, i in _HALF.items()])).alias("x"), F.col("vec_id").alias("id")).select("x.provider", "id", "x.vector")


def _queries(s, d):
    own = embeddings(s, d).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("d"), F.col("label") % 3).alias("department"), F.col("embedding").alias("asked"))
    return own.join(_store(s, d).withColumnRenamed("id", "query_id"), "query_id")


def _documents(s, d):
    return embeddings(s, d).select(F.col("vec_id").alias("id"), (F.col("label") % 5 + 1).alias("tier"), F.array(F.concat(F.lit("d"), F.col("label") % 3)).alias("departments"), "embedding")


def _search(s, d, top_k=5):
    return R.hybrid_search(_queries(s, d), _store(s, d), _documents(s, d), top_k, lambda: X.cosine(F.col("asked"), F.col("embedding")))


_N = 20
_SQL_LISTS = """e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), store AS (SELECT 0 AS list_no, id, v[1:32] AS v FROM e UNION ALL SELECT 1, id, v[33:64] FROM e),
sims AS (SELECT q.id AS query_id, c.list_no, c.id, round(list_cosine_similarity(q.v, c.v), 9) AS score FROM store q JOIN store c USING (list_no) WHERE q.id % 20 = 0),
lists AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, list_no ORDER BY score DESC, id) AS rank FROM sims) WHERE rank <= 20),
fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(list_no) AS first_list, arg_min(rank, list_no) AS first_rank FROM lists GROUP BY query_id, id),
boosts AS (SELECT f.query_id, f.id, f.first_list, f.first_rank, round(f.score * CASE d.label % 5 + 1 WHEN 1 THEN 1.15::DOUBLE WHEN 2 THEN 1.08::DOUBLE WHEN 4 THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN d.label % 3 = q.label % 3 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END, 9) AS score, d.v AS dv, q.v AS qv
FROM fused f JOIN e d ON d.id = f.id JOIN e q ON q.id = f.query_id)"""
_TOP5 = f"""WITH {_SQL_LISTS}, pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_list, first_rank, id) AS before FROM boosts) WHERE before <= 15),
s AS (SELECT query_id, id, before, round(list_cosine_similarity(qv, dv), 9) AS score FROM pool) SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM s) WHERE rank <= 5"""


def _vector_lists(s, d):
    return R.vector_topk(_queries(s, d).where("provider = 'a'"), _store(s, d).where("provider = 'a'"), _N)


def _both_lists(s, d):
    return R.vector_lists(_queries(s, d), _store(s, d), _N)


def _passages(s, d):
    """Benchmark texts that a document holds verbatim, with the least such document; a few rows, found once for all who read them."""
    found = R.first_holding(benchmark(s, d).select(F.col("item_id").alias("query_id"), "text"), documents(s, d).select(F.col("doc_id").alias("id"), "text"))
    path = scratch(s, "passages")
    found.select(F.col("query_id").alias("item_id"), F.col("text").alias("query"), F.col("id").alias("relevant_id")).write.parquet(path)
    return s.read.parquet(path)


_PASSAGES = "passages AS (SELECT b.item_id, b.text AS query, min(d.doc_id) AS relevant_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1, 2)"
_WORDS = r"regexp_extract_all(lower({}), '[\pL\pM\p{{Nd}}\p{{Pc}}]+')"


def _bm25(s, d, k=10):
    q = _passages(s, d).select(F.col("item_id").alias("query_id"), F.col("query").alias("text"))
    return R.bm25(q, documents(s, d).select(F.col("doc_id").alias("id"), "text"), k)


_BM25_SCORES = f"""q AS (SELECT item_id AS query_id, unnest(list_distinct({_WORDS.format("query")})) AS term FROM passages),
t AS (SELECT doc_id AS id, {_WORDS.format('text')} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t), u AS (SELECT id, len(w) AS length, unnest(w) AS term FROM t),
tf AS (SELECT id, term, length, count(*) AS tf FROM u WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT q.query_id, tf.id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean)))), 9) AS score FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY ALL)"""
_BM25 = f"""WITH {_PASSAGES}, {_BM25_SCORES}
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 10"""


def _evaluation(s, d, configs):
    r = None
    for name, df in configs.items():
        one = df.select(F.lit(name).alias("config"), "query_id", "id", "rank")
        r = one if r is None else r.unionByName(one)
    near = embeddings(s, d).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("relevant_id"))
    return V.relevant_ranks(r, near, list(configs))


def _configs(s, d):
    lists = _both_lists(s, d)
    fused = R.rank_by(R.fuse(lists), F.desc("score"), "first_list", "first_rank", "id").where("rank <= 10")
    return {"a": lists.where("list_no = 0"), "b": lists.where("list_no = 1"), "rrf": fused}


def _failures(s, d):
    """A third of the queries find nothing in list a."""
    configs = _configs(s, d)
    configs["a"] = configs["a"].where("query_id % 3 > 0")
    answered = None
    for name, df in configs.items():
        one = df.select(F.lit(name).alias("config"), "query_id")
        answered = one if answered is None else answered.unionByName(one)
    return V.search_report(_evaluation(s, d, configs), answered)


_RANKS = f"""WITH {_SQL_LISTS}, all_lists AS (SELECT CASE list_no WHEN 0 THEN 'a' ELSE 'b' END AS config, query_id, id, rank FROM lists
UNION ALL SELECT 'rrf', query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_list, first_rank, id) AS rank FROM fused) WHERE rank <= 10),
ranks AS (SELECT config, query_id, min(rank) FILTER (id = query_id) AS rank FROM all_lists GROUP BY ALL)"""


def _metrics(ks, by="config"):
    cols = [f"round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_{k}" for k in ks] + [f"round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE / {k} ELSE 0 END), 6) AS precision_{k}" for k in ks]
    cols += [f"round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END), 6) AS ndcg_{k}" for k in ks]
    return f"SELECT {by}, count(*) AS queries, {', '.join(cols)}, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM ranks GROUP BY {by}"


def _emb_terms(s, d):
    return E.hashing_terms(benchmark(s, d).select(F.col("item_id").alias("id"), "text"), 64)


def _hash64(x: str) -> str:
    return f"('0x' || sha256({x})[1:16])::UBIGINT"


_TERMS = f"""SELECT id, bucket, sum(sgn * n)::DOUBLE AS value FROM (SELECT id, (({_hash64("':' || t")}) % 64)::INT AS bucket, CASE WHEN ({_hash64("'sign:' || t")}) % 2 = 0 THEN 1 ELSE -1 END AS sgn, n
FROM (SELECT item_id AS id, t, count(*) AS n FROM (SELECT item_id, unnest({_WORDS.format('text')}) AS t FROM benchmark) GROUP BY ALL)) GROUP BY id, bucket HAVING sum(sgn * n) <> 0"""


def _evl2(s, d):
    p = _passages(s, d)
    return V.evaluate_embedding(documents(s, d).select(F.col("doc_id").alias("id"), "text"), p.select(F.col("item_id").alias("query_id"), F.col("query").alias("text"), "relevant_id"), "hashing", 64)


_VEC = """SELECT id, list(coalesce(value, 0) ORDER BY b) AS v FROM (SELECT ids.id, b, value FROM (SELECT DISTINCT id FROM {0}) ids CROSS JOIN (SELECT unnest(range(64)) AS b) LEFT JOIN {1} t ON t.id = ids.id AND t.bucket = b) GROUP BY id"""


def _terms_sql(source: str) -> str:
    return _TERMS.replace("SELECT item_id AS id, t, count(*) AS n FROM (SELECT item_id, unnest(" + _WORDS.format("text") + ") AS t FROM benchmark)", f"SELECT id, t, count(*) AS n FROM (SELECT id, unnest({_WORDS.format('text')}) AS t FROM {source})")


_EVL2 = f"""WITH {_PASSAGES}, corpus AS (SELECT doc_id AS id, text FROM documents), asked AS (SELECT item_id AS id, query AS text FROM passages),
ct AS ({_terms_sql('corpus')}), qt AS ({_terms_sql('asked')}), cv AS ({_VEC.format('corpus', 'ct')}), qv AS ({_VEC.format('asked', 'qt')}),
r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT qv.id AS query_id, cv.id, round(list_cosine_similarity(qv.v, cv.v), 9) AS score FROM qv, cv)),
ranks AS (SELECT 'hashing' AS config, p.item_id AS query_id, min(CASE WHEN r.rank <= 5 THEN r.rank END) AS rank FROM passages p LEFT JOIN r ON r.query_id = p.item_id AND r.id = p.relevant_id GROUP BY 2)
SELECT *, 64 AS dimension FROM ({_metrics((1, 5))})"""


def _top7(s, d):
    p = _passages(s, d).select(F.col("item_id").alias("query_id"), F.col("query").alias("text"), "relevant_id")
    return V.compare_rerank(p.select("query_id", "text"), documents(s, d).select(F.col("doc_id").alias("id"), "text"), p.select("query_id", "relevant_id"))


_TOP7 = f"""WITH {_PASSAGES}, corpus AS (SELECT doc_id AS id, text FROM documents), asked AS (SELECT item_id AS id, query AS text FROM passages),
ct AS ({_terms_sql('corpus')}), qt AS ({_terms_sql('asked')}), cv AS ({_VEC.format('corpus', 'ct')}), qv AS ({_VEC.format('asked', 'qt')}), {_BM25_SCORES},
dense AS (SELECT qv.id AS query_id, cv.id, coalesce(round(list_cosine_similarity(qv.v, cv.v), 9), 0) AS score FROM qv, cv),
both_lists AS (SELECT * FROM (SELECT 0 AS list_no, *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dense UNION ALL SELECT 1, *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) FROM sc) WHERE rank <= 50),
f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(list_no) AS first_list, arg_min(rank, list_no) AS first_rank FROM both_lists GROUP BY ALL),
rrf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_list, first_rank, id) AS rank FROM f),
pool AS (SELECT rrf.query_id, rrf.id, rank AS before, list_distinct({_WORDS.format('asked.text')}) AS a, list_distinct({_WORDS.format('corpus.text')}) AS b FROM rrf JOIN asked ON asked.id = query_id JOIN corpus ON corpus.id = rrf.id WHERE rank <= 20),
again AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)), 9) DESC, before) AS rank FROM pool),
results AS (SELECT 'rrf' AS config, query_id, id, rank FROM rrf UNION ALL SELECT 'rrf_rerank', query_id, id, rank FROM again),
ranks AS (SELECT c.config, p.item_id AS query_id, min(r.rank) AS rank FROM passages p CROSS JOIN (VALUES ('rrf'), ('rrf_rerank')) c(config) LEFT JOIN results r ON r.config = c.config AND r.query_id = p.item_id AND r.id = p.relevant_id GROUP BY ALL)
{_metrics((1, 5, 10))}"""


def _chunks(s, d):
    """Sentence-like chunks of documents, with a status and two providers' vectors by id."""
    return documents(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "chunk"), "source").select((F.col("doc_id") * 1000 + F.col("chunk_index")).alias("chunk_id"), "doc_id", "chunk_index", "chunk", "source")


_CHUNKS = r"chunks AS (SELECT doc_id * 1000 + i - 1 AS chunk_id, doc_id, i - 1 AS chunk_index, l[i] AS chunk, source FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"


def _searchable(s, d):
    docs = documents(s, d).select("doc_id", F.element_at(F.array(*map(F.lit, ("completed", "dataset_import", "processing"))), (F.col("doc_id") % 3 + 1).cast("int")).alias("status"))
    return R.searchable(docs)


def _jn1(s, d):
    vectors = embeddings(s, d).select(F.col("vec_id").alias("v"), F.lit("a").alias("provider_name"))
    return _chunks(s, d).join(_searchable(s, d), "doc_id").join(vectors.where("provider_name = 'a'"), F.col("chunk_id") == F.col("v") * 1000).select("chunk_id", "doc_id", "status")


def _jn7(s, d):
    p = _passages(s, d).select(F.col("relevant_id").cast("string").alias("key"), "query")
    stored = documents(s, d).select("doc_id", F.col("doc_id").cast("string").alias("key"), "source")
    return V.benchmark_queries(p, stored, _chunks(s, d))


def _votes(s, d):
    return R.department_votes(_search(s, d).join(_documents(s, d).select("id", "departments"), "id"))


def _block(s, d):
    """Each source's first five chunks, some with a tier and departments."""
    tier = F.when(F.col("doc_id") % 3 == 0, "높음").when(F.col("doc_id") % 3 == 1, "낮음")
    return C.reference_block(_chunks(s, d).withColumns({"tier": tier, "departments": F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("d1"), F.lit("d2")))}), "source", "chunk_id", origin="source")


_LEX = {"en": ("the", "and", "with"), "de": ("der", "und", "nicht"), "fr": ("les", "dans")}


def _lexicon(s, d):
    """JN9: how many texts hold each word between spaces."""
    padded = s.createDataFrame([(k, f" {w} ") for k, ws in _LEX.items() for w in ws], "lexicon string, word string")
    return L.match(documents(s, d), padded, whole_words=False).groupBy("lexicon", F.trim("word").alias("word")).agg(F.count("*").alias("n"))


def _lexicon_matches(s, d):
    """JN9: the words of the benchmark's items, in five lexicons, as whole words of the documents."""
    words = benchmark(s, d).select(F.concat(F.lit("b"), F.col("item_id") % 5).alias("lexicon"), F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{Nd}_]+"), F.lit(0))).alias("word"))
    return L.match(documents(s, d), words.where(F.length("word") >= 4).distinct())


_LEXICON = r"""lex AS (SELECT DISTINCT lexicon, word FROM (SELECT 'b' || item_id % 5 AS lexicon, unnest(regexp_extract_all(text, '[\pL\p{Nd}_]+')) AS word FROM benchmark) WHERE length(word) >= 4),
m AS (SELECT doc_id AS id, lexicon, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\pL\p{Nd}_]+')) AS word FROM documents) JOIN lex USING (word) GROUP BY ALL)"""
_LEX_SQL = " UNION ALL ".join(f"SELECT '{k}' AS lexicon, '{w}' AS word, count(*) AS n FROM documents WHERE contains(text, ' {w} ')" for k, ws in _LEX.items() for w in ws)
_R5 = "SELECT query_id, id, rank, score FROM"

QUERIES = {
    "top1_vector_topk": lambda s, d: _vector_lists(s, d),
    "top2_rrf": lambda s, d: R.fuse(_both_lists(s, d)),
    "top3_boosts": lambda s, d: R.hybrid_search(_queries(s, d), _store(s, d), _documents(s, d), 5),
    "top4_rerank": lambda s, d: _search(s, d, 5).select("query_id", "id"),
    "top5_hybrid_search": lambda s, d: _search(s, d),
    "top5_hybrid_search_plain": lambda s, d: R.hybrid_search(_queries(s, d), _store(s, d), _documents(s, d), 5, boosts=False),
    "top6_bm25": _bm25,
    "top7_dense_and_keyword": _top7,
    "jn1_searchable_chunks": _jn1,
    "jn7_benchmark_queries": _jn7,
    "jn8_similarity_block": lambda s, d: R.vector_topk(_queries(s, d).where("provider = 'b'"), _store(s, d).where("provider = 'b'"), 3, block=4),
    "jn9_lexicon": _lexicon,
    "jn9_lexicon_matches": _lexicon_matches,
    "jn9_lexicon_votes": lambda s, d: L.votes(_lexicon_matches(s, d)),
    "jn10_rank_fusion": lambda s, d: R.fuse(_both_lists(s, d)).select("query_id", "id", "score"),
    "win9_rank_columns": lambda s, d: _both_lists(s, d),
    "win12_relevant_rank": lambda s, d: _evaluation(s, d, _configs(s, d)),
    "scl14_metrics": lambda s, d: _evaluation(s, d, _configs(s, d)).select("config", "query_id", X.recall_at(F.col("rank"), 5).alias("recall"), X.precision_at(F.col("rank"), 5).alias("precision"), X.reciprocal_rank(F.col("rank")).alias("rr"), F.round(X.ndcg_at(F.col("rank"), 5), 9).alias("ndcg")),
    "agg13_retrieval_metrics": lambda s, d: V.retrieval_metrics(_evaluation(s, d, _configs(s, d))),
    "agg13_recall_by_source": lambda s, d: V.recall_by_source(_evaluation(s, d, _configs(s, d)), embeddings(s, d).select(F.col("vec_id").alias("query_id"), F.concat(F.lit("s"), F.col("label") % 4).alias("source"))),
    "agg13_search_report": _failures,
    "agg17_department_vote": _votes,
    "agg21_reference_block": _block,
    "emb1_hashing_terms": _emb_terms,
    "emb1_hashing_embedding": lambda s, d: E.hashing_embedding(benchmark(s, d).select(F.col("item_id").alias("id"), "text"), 64).select("id", F.size("vector").alias("width"), F.round(X.norm(F.col("vector")), 6).alias("norm"), F.transform("vector", lambda x: F.round(x.cast("double"), 5) + F.lit(0.0)).alias("vector")),
    "emb2_provider_embedding": lambda s, d: E.embed(documents(s, d).select(F.col("doc_id").alias("id"), "text"), lambda: E.HashingProvider("hashing", 64)),
    "emb3_multi_provider": lambda s, d: E.embed_all(benchmark(s, d).select(F.col("item_id").alias("id"), "text"), {"h64": (lambda: E.HashingProvider("h64", 64), 64), "h128": (lambda: E.HashingProvider("h128", 128), 128)}).groupBy("provider", "problem").agg(F.count("*").alias("n")),
    "emb4_model_comparison": lambda s, d: V.retrieval_metrics(_evaluation(s, d, {k: v for k, v in _configs(s, d).items() if k != "rrf"}), (1, 5)).withColumn("dimension", F.lit(32)),
    "evl1_evaluation_set": lambda s, d: V.evaluation_set(benchmark(s, d).select(F.col("item_id").alias("id"), "text", F.substring_index("text", " ", 1).alias("complaint"), F.expr("substring(text, length(substring_index(text, ' ', 1)) + 2)").alias("question")), "text", ["complaint", "question"])[1],
    "evl2_retrieval_evaluation": _evl2,
    "flt14_searchable": _searchable,
}

SQL = {
    "top1_vector_topk": f"WITH {_SQL_LISTS} SELECT query_id, id, score, rank FROM lists WHERE list_no = 0",
    "top2_rrf": f"WITH {_SQL_LISTS} SELECT query_id, id, score, first_list, first_rank FROM fused",
    "top3_boosts": f"WITH {_SQL_LISTS} SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_list, first_rank, id) AS rank FROM boosts) WHERE rank <= 5",
    "top4_rerank": f"SELECT query_id, id FROM ({_TOP5})",
    "top5_hybrid_search": _TOP5,
    "top5_hybrid_search_plain": f"WITH {_SQL_LISTS} SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_list, first_rank, id) AS rank FROM fused) WHERE rank <= 5",
    "top6_bm25": _BM25,
    "top7_dense_and_keyword": _TOP7,
    "jn1_searchable_chunks": f"WITH {_CHUNKS} SELECT chunk_id, c.doc_id, CASE c.doc_id % 3 WHEN 0 THEN 'completed' ELSE 'dataset_import' END AS status FROM chunks c JOIN embeddings e ON c.chunk_id = e.vec_id * 1000 WHERE c.doc_id % 3 < 2",
    "jn7_benchmark_queries": f"WITH {_PASSAGES} SELECT query, relevant_id * 1000 AS relevant_chunk_id, source FROM passages JOIN documents ON doc_id = relevant_id",
    "jn8_similarity_block": f"WITH {_SQL_LISTS} SELECT query_id, id, score, rank FROM lists WHERE list_no = 1 AND rank <= 3",
    "jn9_lexicon": f"SELECT * FROM ({_LEX_SQL}) WHERE n > 0",
    "jn9_lexicon_matches": f"WITH {_LEXICON} SELECT id, lexicon, word, n FROM m",
    "jn9_lexicon_votes": f"WITH {_LEXICON} SELECT id, lexicon, words, n FROM (SELECT id, lexicon, count(*) AS words, sum(n)::BIGINT AS n FROM m GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY id ORDER BY words DESC, n DESC, lexicon) = 1",
    "jn10_rank_fusion": f"WITH {_SQL_LISTS} SELECT query_id, id, score FROM fused",
    "win9_rank_columns": f"WITH {_SQL_LISTS} SELECT query_id, id, score, rank, list_no FROM lists",
    "win12_relevant_rank": f"{_RANKS} SELECT config, query_id, rank FROM ranks",
    "scl14_metrics": f"{_RANKS} SELECT config, query_id, CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END AS recall, CASE WHEN rank <= 5 THEN 0.2::DOUBLE ELSE 0 END AS precision, coalesce(1.0::DOUBLE / rank, 0) AS rr, round(CASE WHEN rank <= 5 THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END, 9) AS ndcg FROM ranks",
    "agg13_retrieval_metrics": f"{_RANKS} {_metrics((1, 5, 10))}",
    "agg13_recall_by_source": f"{_RANKS} SELECT config, 's' || label % 4 AS source, count(*) AS queries, round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_5 FROM ranks JOIN embeddings ON vec_id = query_id GROUP BY ALL",
    "agg13_search_report": f"""{_RANKS}, known AS (SELECT * FROM ranks WHERE config <> 'a' OR query_id % 3 > 0), lost AS (SELECT config, count(*) FILTER (WHERE config = 'a' AND query_id % 3 = 0) AS failed FROM ranks GROUP BY config)
SELECT m.*, failed FROM ({_metrics((1, 5, 10)).replace("FROM ranks", "FROM known")}) m JOIN lost USING (config)""",
    "agg17_department_vote": f"""WITH t AS ({_TOP5}), c AS (SELECT query_id, 'd' || label % 3 AS department, count(*) AS n, min(rank) AS first FROM t JOIN embeddings ON vec_id = id GROUP BY ALL)
SELECT query_id, department, CASE WHEN n >= 2 THEN '높음' ELSE '중간' END AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, first) AS k FROM c) WHERE k = 1""",
    "agg21_reference_block": f"""WITH {_CHUNKS}, cut AS (SELECT *, regexp_replace(chunk, '^\\s+|\\s+$', '', 'g') AS c FROM chunks)
SELECT source, '[참고 의료 정보]' || string_agg(chr(10) || chr(10) || '[문서 ' || n || ']' || chr(10) || '출처: ' || source || CASE doc_id % 3 WHEN 0 THEN ' (신뢰도: 높음)' WHEN 1 THEN ' (신뢰도: 낮음)' ELSE '' END
|| CASE WHEN doc_id % 2 = 0 THEN chr(10) || '관련 진료과: d1, d2' ELSE '' END || chr(10) || CASE WHEN length(c) > 800 THEN regexp_replace(c[1:800], '\\s+$', '') || '…' ELSE c END, '' ORDER BY n) AS block
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY chunk_id) AS n FROM cut WHERE c <> '') WHERE n <= 5 GROUP BY source""",
    "emb1_hashing_terms": _TERMS,
    "emb1_hashing_embedding": f"""WITH corpus AS (SELECT item_id AS id, text FROM benchmark), ct AS ({_terms_sql('corpus')}), cv AS ({_VEC.format('corpus', 'ct')})
SELECT id, 64 AS width, round(n / n, 6) AS norm, list_transform(v, lambda x: round(x / n, 5) + 0.0::DOUBLE) AS vector FROM (SELECT id, v, sqrt(list_inner_product(v, v)) AS n FROM cv)""",
    "emb3_multi_provider": "SELECT provider, NULL::VARCHAR AS problem, count(*) AS n FROM benchmark, (VALUES ('h64'), ('h128')) p(provider) GROUP BY provider",
    "emb4_model_comparison": f"{_RANKS} SELECT *, 32 AS dimension FROM ({_metrics((1, 5))}) WHERE config <> 'rrf'",
    "evl1_evaluation_set": "SELECT item_id AS query_id, trim(text) AS text, item_id AS relevant_id FROM benchmark",
    "evl2_retrieval_evaluation": _EVL2,
    "flt14_searchable": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'completed' ELSE 'dataset_import' END AS status FROM documents WHERE doc_id % 3 < 2",
}
