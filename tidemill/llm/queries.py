"""The registered queries of this folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, classifier, collocations, decontam, mixing, negatives, packing, quality_rules, secrets, shards, simhash, topk, warc


def _table(name: str):
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


documents, embeddings, pages, benchmark, labels, conversations = map(_table, ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_context_mixing": lambda s, d: mixing.score(documents(s, d)),
    "op2_warc": lambda s, d: warc.report(pages(s, d)),
    "op3_decontamination": lambda s, d: decontam.report(documents(s, d), benchmark(s, d)),
    "op4_training_order": lambda s, d: shards.report(documents(s, d)),
    "op5_simhash": lambda s, d: simhash.report(documents(s, d)),
    "op6_packing": lambda s, d: packing.packed(documents(s, d)),
    "op7_quality_classifier": lambda s, d: classifier.report(documents(s, d), labels(s, d)),
    "op8_chat": lambda s, d: chat.report(conversations(s, d)),
    "op9_secrets": lambda s, d: secrets.report(documents(s, d)),
    "op10_quality_rules": lambda s, d: quality_rules.report(documents(s, d)),
    "op11_collocations": lambda s, d: collocations.report(documents(s, d)),
    "op12_hard_negatives": lambda s, d: negatives.report(embeddings(s, d)),
    "op13_exact_topk": lambda s, d: topk.report(embeddings(s, d)),
    "pipeline": _pipeline,
}

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGEST = f"""array_to_string(list_transform(range(32), lambda i: '{_BASE32}'[('0b' || bits[i * 5 + 1:i * 5 + 5])::INT + 1]), '')"""
_BITS = "array_to_string(list_transform(string_split(sha1(coalesce(html, '')), ''), lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', c)]), '')"
_VECTORS = "list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_ESCAPED = r"length(regexp_replace(coalesce({}, ''), '([<\[\\])', '\1\\', 'g'))"

ORACLE_SQL: dict[str, str] = {
    "op2_warc": f"""WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, coalesce(html, '') AS h, {_BITS} AS bits FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, {_DIGEST} AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f""",
    "op3_decontamination": f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), i AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw), dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, k, dw.n, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n), hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY 1),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS l FROM m GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(l), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_collocations": rf"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOW.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t), totals AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS k FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, unnest(range(1, 6)) AS s(m) WHERE len(w) >= m) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m >= 2), held AS (SELECT lang, phrase, max(k) AS longer FROM (SELECT lang, k, array_to_string(w[i:i + z - 1], ' ') AS phrase FROM (SELECT lang, k, w, z, unnest(range(1, m - z + 2)) AS i FROM c, unnest(range(2, 5)) AS s(z) WHERE z < m)) GROUP BY ALL),
cuts AS (SELECT c.lang, c.phrase, c.k AS a, j, l.k AS l, r.k AS r, n, (1000::HUGEINT * c.k * n) // (l.k::HUGEINT * r.k) AS score FROM (SELECT *, unnest(range(1, m)) AS j FROM c LEFT JOIN held USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * k) c
JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[j + 1:], ' ') JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM lowest QUALIFY rank <= 2000""",
    "op12_hard_negatives": f"""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_VECTORS} AND label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id))::INT AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score QUALIFY rank <= 5""",
    "op13_exact_topk": f"""WITH e AS (SELECT vec_id, {_VECTORS}), s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 5""",
    "op8_chat": rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, 23 + {_ESCAPED.format('role')} + {_ESCAPED.format('text')} AS n, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS of FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(CASE WHEN role = 'assistant' OR k = of THEN upto ELSE 0 END)::BIGINT AS formatted_chars FROM s GROUP BY conv_id""",
}
