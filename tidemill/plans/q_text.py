"""Scalar functions (SCL), predicates (FLT) and report aggregations over documents, benchmark and conversations."""

from pyspark.sql import functions as F

from tidemill.functions import text as X
from tidemill.functions import udfs
from tidemill.operators import evaluation as V
from tidemill.operators import reports as R
from tidemill.plans.tables import benchmark, conversations, documents, embeddings, events, labels, pages

_JUNK = r"[^가-힣a-zA-Z0-9\s.,%()\-/·α-ω]"
_S = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_REASON = rf"""CASE WHEN length({_S}) < 15 THEN 'too_short' WHEN regexp_matches({_S}, '[\x{{FFFD}}\x00-\x08\x0b\x0c\x0e-\x1f]') THEN 'broken_unicode'
WHEN regexp_matches({_S}, '<[a-zA-Z/][^>]{{0,80}}>|&[a-z]+;|\{{\{{.*?\}}\}}') THEN 'html_residue'
WHEN regexp_matches({_S}, '(?im)^\s*(system\s*:|###\s*instruction|<\|.*?\|>|assistant\s*:|user\s*:)') THEN 'prompt_wrapper'
WHEN length(regexp_replace({_S}, '{_JUNK}+', '', 'g')) < 0 THEN '' WHEN (length({_S}) - length(regexp_replace({_S}, '{_JUNK}', '', 'g'))) / length({_S}) > 0.3 THEN 'junk_ratio' END"""
_SENT = r"list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
_NORM = r"regexp_replace(regexp_replace(lower({}), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_EMAIL, _PHONE = X.EMAIL, X.PHONE


def _pairs(s, d):
    """Consecutive user and assistant turns as (conv_id, turn, question, answer)."""
    c = conversations(s, d)
    a = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return a.join(b, ["conv_id", "turn"])


_SQL_PAIRS = "pairs AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"
_TOK = f"regexp_extract_all({_NORM}, '[가-힣]+|[a-z0-9]+')"


def _f1(a: str, b: str) -> str:
    x, y = _TOK.format(a), _TOK.format(b)
    return f"""(SELECT CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 WHEN len(x) = 0 OR len(y) = 0 OR n = 0 THEN 0.0 ELSE 2.0 * n / (len(x) + len(y)) END
FROM (SELECT {x} AS x, {y} AS y, coalesce(list_sum(list_transform(list_distinct({x}), lambda t: least(len(list_filter({x}, lambda v: v = t)), len(list_filter({y}, lambda v: v = t))))), 0) AS n))"""


def _reports(s, d):
    reason = X.reject_reason(F.col("text"))
    return documents(s, d).withColumn("reason", reason).withColumn("hash", X.content_hash(F.col("text")))


def _doc(s, d, *columns):
    return documents(s, d).select("doc_id", *columns)


def _flagged(s, d):
    """Labelled documents and whether an insult's keyword is in them."""
    flag = X.contains_any(F.lower(F.col("text")), ("idiot", "clown", "worthless"))
    return documents(s, d).join(labels(s, d), "doc_id").select("doc_id", "text", flag.alias("flag"), (F.col("toxic") == 1).alias("truth"))


def _chunk_flags(s, d):
    return R.chunk_flags(documents(s, d).select("doc_id", "text", "source")).drop("source")


def _answers(s, d):
    """Questions with five choices, the fifths of the answer; the right one as a letter or a number, or as neither; and responses that
    name it, that hold its text, or that do neither."""
    p = _pairs(s, d).withColumn("w", F.ceil(F.length("answer") / 5).cast("int"))
    choices = {k: F.when((F.col("turn") + i) % 5 != 0, F.substring("answer", i * F.col("w") + 1, F.col("w"))) for i, k in enumerate("ABCDE")}
    told = F.element_at(F.array(*map(F.lit, ("A", "2", "E", "7", "b"))), (F.col("conv_id") % 5 + 1).cast("int"))
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("I say "), F.upper(told), F.lit(", surely. "), "question")).when(F.col("turn") % 3 == 1, F.concat("question", F.lit(" "), "answer")).otherwise(F.col("question"))
    return p.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "question", *[c.alias(k) for k, c in choices.items()], told.alias("answer"), said.alias("response"))


_ANSWERS = f"""{_SQL_PAIRS}, w AS (SELECT *, ceil(length(answer) / 5.0)::INT AS w, ['A', '2', 'E', '7', 'b'][conv_id % 5 + 1] AS told, ['A', 'B', 'E', NULL, 'B'][conv_id % 5 + 1] AS gold_letter FROM pairs),
e AS (SELECT conv_id * 100 + turn AS id, question, gold_letter, coalesce(trim(regexp_replace(CASE WHEN (turn + strpos('ABCDE', gold_letter) - 1) % 5 <> 0 THEN substr(answer, (strpos('ABCDE', gold_letter) - 1) * w + 1, w) END, '\\s+', ' ', 'g')), '') AS gold_text,
CASE turn % 3 WHEN 0 THEN 'I say ' || upper(told) || ', surely. ' || question WHEN 1 THEN question || ' ' || answer ELSE question END AS response FROM w),
graded AS (SELECT *, coalesce(regexp_matches(response[1:20], '(^|[^\\pL\\pM\\p{{Nd}}\\p{{Pc}}])' || gold_letter || '([^\\pL\\pM\\p{{Nd}}\\p{{Pc}}]|$)'), false) OR (gold_text <> '' AND contains(response, gold_text)) AS correct FROM e)"""
_ENDS = " OR ".join(f"ends_with(regexp_replace(text, '\\s+$', ''), '{e}')" for e in X.FINAL_ENDINGS)
_FLAGS = rf"""flags AS (SELECT doc_id, text, length({_S}) < 30 AS too_short, length(text) > 2000 AS too_long,
CASE WHEN length({_S}) = 0 THEN true ELSE (length({_S}) - length(regexp_replace({_S}, '{_JUNK}', '', 'g'))) / length({_S}) > 0.3 END AS meaningless,
{_S} <> '' AND NOT ({_ENDS}) AS mid_cut,
(WITH s AS (SELECT unnest({_SENT}) AS x) SELECT count(*) >= 3 AND (SELECT coalesce(max(n), 0) >= 3 FROM (SELECT count(*) AS n FROM s GROUP BY x)) FROM s) AS repetition, source IS NULL AS no_metadata FROM documents)"""
_FLAG_NAMES = ("too_short", "too_long", "meaningless", "mid_cut", "repetition", "no_metadata")


_REVIEW = {"legal": "(licen[sc]ed|rights reserved)", "contact": r"@|\+\d", "secret": "(token|password)"}


QUERIES = {
    "scl1_content_hash": lambda s, d: _doc(s, d, X.content_hash(F.col("text")).alias("hash")),
    "scl2_split_sentences": lambda s, d: _doc(s, d, X.split_sentences(F.col("text")).alias("sentences")),
    "scl3_hard_blocks": lambda s, d: _doc(s, d, F.size(X.hard_blocks(F.col("text"))).alias("n_blocks")),
    "scl4_count_tokens": lambda s, d: _doc(s, d, X.count_tokens(F.col("text")).alias("n_tokens")),
    "scl5_clean_text": lambda s, d: _doc(s, d, X.clean_text(F.col("text")).alias("clean")),
    "scl5_clean_text_nfc": lambda s, d: _doc(s, d, X.clean_text(F.col("text"), udfs.nfc).alias("clean")),
    "scl6_strip_restatement": lambda s, d: conversations(s, d).select("conv_id", "turn", X.strip_restatement(F.col("text")).alias("answer")),
    "scl7_mask_pii": lambda s, d: _doc(s, d, X.mask_pii(F.col("text")).alias("masked"), X.count_pii(F.col("text")).cast("long").alias("n_pii")),
    "scl8_clean_document_text": lambda s, d: _doc(s, d, X.clean_document_text(F.col("text")).alias("clean")),
    "scl8_clean_document_text_nfkc": lambda s, d: _doc(s, d, X.clean_document_text(F.col("text"), udfs.nfkc, True).alias("clean")),
    "scl9_strip_reasoning": lambda s, d: conversations(s, d).select("conv_id", "turn", X.strip_reasoning(F.concat(F.lit("<think>plan\nmore</think>\nStep 2: "), F.col("text"))).alias("answer")),
    "scl10_normalize_answer": lambda s, d: benchmark(s, d).select("item_id", X.normalize_answer(F.col("text")).alias("answer")),
    "scl11_exact_match": lambda s, d: _pairs(s, d).select("conv_id", "turn", X.exact_match(F.col("question"), F.concat(F.lit("  "), "question", F.lit("\n"))).alias("same"), X.exact_match(F.col("question"), F.col("answer")).alias("other")),
    "scl12_token_f1": lambda s, d: _pairs(s, d).select("conv_id", "turn", F.round(X.token_f1(F.col("question"), F.col("answer")), 9).alias("f1")),
    "scl13_character_similarity": lambda s, d: _pairs(s, d).select("conv_id", "turn", udfs.sequence_ratio(X.normalize_answer(F.col("question")), X.normalize_answer(F.col("answer"))).alias("similarity")),
    "scl15_pad_and_narrow": lambda s, d: embeddings(s, d).select("vec_id", F.size(X.pad_vector(F.col("embedding"), 80)).alias("padded"), F.round(F.aggregate(X.narrow_vector(X.pad_vector(F.col("embedding"), 80), 32), F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("narrow_sum")),
    "scl16_cosine": lambda s, d: embeddings(s, d).select("vec_id", F.round(X.cosine(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)), 6).alias("cosine"), F.round(X.norm(F.col("embedding")), 6).alias("norm")),
    "scl18_input_language": lambda s, d: _doc(s, d, X.input_language(F.col("text")).alias("language")),
    "scl19_foreign_ratio": lambda s, d: _doc(s, d, F.round(X.foreign_ratio(F.col("text"), "en"), 6).alias("ratio")),
    "scl20_nested_path": lambda s, d: events(s, d).select("event_id", F.get_json_object("props", "$.k").alias("k"), F.expr("try_variant_get(parse_json(props), '$.k', 'string')").alias("same_k")),
    "flt1_too_short": lambda s, d: documents(s, d).where(X.too_short(F.col("text"))).select("doc_id"),
    "flt2_broken_unicode": lambda s, d: _doc(s, d, X.broken_unicode(F.col("text")).alias("broken")),
    "flt3_html_residue": lambda s, d: pages(s, d).select("page_id", X.html_residue(F.col("html")).alias("residue")),
    "flt4_prompt_wrapper": lambda s, d: _doc(s, d, X.prompt_wrapper(F.col("text")).alias("wrapper")),
    "flt5_junk_ratio": lambda s, d: _doc(s, d, F.round(X.junk_ratio(F.col("text")), 6).alias("ratio")),
    "flt6_refusals": lambda s, d: _doc(s, d, X.contains_any(F.col("text"), ("All rights reserved", "licensed under")).alias("refusal")),
    "flt7_leakage": lambda s, d: _pairs(s, d).select("conv_id", "turn", udfs.similar(F.col("question"), F.col("answer"), 0.5).alias("leak")),
    "flt8_clean_content": lambda s, d: _doc(s, d, X.clean_content(F.col("text")).alias("content"), X.reject_reason(F.col("text")).alias("reason")),
    "flt9_needs_review": lambda s, d: _doc(s, d, X.needs_review(F.col("text"), "(token|licensed\\s*under|rights)").alias("needs_review")),
    "flt10_garbage": lambda s, d: _doc(s, d, X.garbage(F.col("text")).alias("garbage")),
    "flt11_quality_verdict": lambda s, d: _pairs(s, d).select("conv_id", "turn", X.quality_verdict(F.col("question"), F.col("answer"), 30, 200, 1000).alias("reason")),
    "flt15_chunk_flags": lambda s, d: _chunk_flags(s, d).drop("text"),
    "flt16_emergency": lambda s, d: _doc(s, d, X.emergency(F.col("text"), ("idiot", "clown th", "worthless")).alias("emergency")),
    "flt17_risky_dosage": lambda s, d: _doc(s, d, X.risky_dosage(F.col("text")).alias("risky")),
    "flt18_non_answer": lambda s, d: _doc(s, d, X.contains_any(F.col("text"), ("All rights reserved",)).alias("non_answer")),
    "flt19_embedding_problem": lambda s, d: embeddings(s, d).select("vec_id", X.embedding_problem(F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 9)).otherwise(F.col("embedding")), 64).alias("problem")),
    "flt20_canonical_url": lambda s, d: pages(s, d).select("page_id", X.canonical_url(F.col("url")).alias("url")),
    "agg7_ingestion_report": lambda s, d: _reports(s, d).groupBy("source").agg(
        F.count("*").alias("raw"), F.sum(F.when(F.col("reason").isNull(), 1).otherwise(0)).cast("long").alias("cleaned"), (F.sum(F.when(F.col("reason").isNull(), 1).otherwise(0)) - F.countDistinct(F.when(F.col("reason").isNull(), F.col("hash")))).cast("long").alias("duplicates")
    ),
    "agg8_filter_statistics": lambda s, d: _reports(s, d).groupBy(F.coalesce("reason", F.lit("passed")).alias("reason")).agg(F.count("*").alias("n")),
    "agg8_distributions": lambda s, d: R.distributions(_reports(s, d).select("reason", (F.col("doc_id") % 4 + 1).alias("source_tier"), F.when(F.col("doc_id") % 3 > 0, F.when(F.col("doc_id") % 3 == 1, "verified").otherwise("unverified")).alias("verification_status")), ["reason", "source_tier", "verification_status"]),
    "agg9_review_categories": lambda s, d: R.review_categories(documents(s, d), "text", _REVIEW),
    "agg9_default_categories": lambda s, d: R.review_categories(documents(s, d).select(F.concat_ws(" ", "text", F.when(F.col("doc_id") % 3 == 0, "수술  적응 용량"), F.when(F.col("doc_id") % 5 == 0, "진단 기준, 응급")).alias("text"))),
    "agg10_chunk_quality": lambda s, d: R.chunk_quality(_chunk_flags(s, d), "doc_id"),
    "agg14_answer_metrics": lambda s, d: V.answer_metrics(V.answer_cases(_pairs(s, d), "question", "answer")),
    "agg14_answer_cases": lambda s, d: V.answer_cases(_pairs(s, d), "question", "answer").select("conv_id", "turn", "exact_match", F.round("token_f1", 9).alias("token_f1")),
    "agg15_detector": lambda s, d: R.detector(_flagged(s, d)),
    "agg15_detector_faults": lambda s, d: R.detector_faults(_flagged(s, d)).select("doc_id", "fault", R.preview(F.col("text")).alias("preview")),
    "agg16_mcq_accuracy": lambda s, d: R.mcq_accuracy(R.mcq_graded(_answers(s, d))),
    "agg16_mcq_graded": lambda s, d: R.mcq_graded(_answers(s, d)).select("id", "gold_letter", "gold_text", "correct"),
    "agg16_mcq_wrong": lambda s, d: R.mcq_wrong(R.mcq_graded(_answers(s, d)), "id"),
}

SQL = {
    "scl1_content_hash": f"SELECT doc_id, sha256({_S}) AS hash FROM documents",
    "scl2_split_sentences": f"SELECT doc_id, {_SENT} AS sentences FROM documents",
    "scl3_hard_blocks": r"SELECT doc_id, len(list_filter(string_split_regex(text, '\n\s*\n+'), lambda x: trim(x, ' ' || chr(10) || chr(9)) <> ''))::INT AS n_blocks FROM documents",
    "scl4_count_tokens": r"SELECT doc_id, len(regexp_extract_all(text, '[\pL\pM\p{Nd}\p{Pc}]+|[^\pL\pM\p{Nd}\p{Pc}\s]'))::INT AS n_tokens FROM documents",
    "scl5_clean_text": rf"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS clean FROM documents",
    "scl5_clean_text_nfc": rf"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS clean FROM documents",
    "scl7_mask_pii": f"""SELECT doc_id, regexp_replace(regexp_replace(text, '{_EMAIL}', '[이메일]', 'g'), '{_PHONE}', '[전화번호]', 'g') AS masked,
(len(regexp_extract_all(text, '{_EMAIL}')) + len(regexp_extract_all(regexp_replace(text, '{_EMAIL}', '[이메일]', 'g'), '{_PHONE}')))::BIGINT AS n_pii FROM documents""",
    "scl8_clean_document_text": r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS clean FROM documents""",
    "scl9_strip_reasoning": r"SELECT conv_id, turn, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS answer FROM conversations",
    "scl10_normalize_answer": f"SELECT item_id, {_NORM.format('text')} AS answer FROM benchmark",
    "scl11_exact_match": f"WITH {_SQL_PAIRS} SELECT conv_id, turn, 1.0::DOUBLE AS same, ({_NORM.format('question')} = {_NORM.format('answer')})::INT::DOUBLE AS other FROM pairs",
    "scl12_token_f1": f"WITH {_SQL_PAIRS} SELECT conv_id, turn, round({_f1('question', 'answer')}, 9) AS f1 FROM pairs",
    "scl15_pad_and_narrow": "SELECT vec_id, 80 AS padded, round(list_sum(list_transform(embedding[1:32], lambda x: x::DOUBLE)), 6) AS narrow_sum FROM embeddings",
    "scl16_cosine": "SELECT vec_id, round(list_cosine_similarity(embedding[1:32]::DOUBLE[], embedding[33:64]::DOUBLE[]), 6) AS cosine, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings",
    "scl18_input_language": "SELECT doc_id, CASE WHEN regexp_matches(text, '[가-힣]') THEN 'ko' WHEN regexp_matches(text, '[ぁ-んァ-ンー]') THEN 'ja' WHEN regexp_matches(text, '[一-鿿]') THEN 'zh' WHEN regexp_matches(text, '[a-zA-Z]') THEN 'en' ELSE 'ko' END AS language FROM documents",
    "scl19_foreign_ratio": rf"""SELECT doc_id, CASE WHEN length({_S}) = 0 THEN 0.0 ELSE round(1 - len(regexp_extract_all({_S}, '[a-zA-Zα-ωΑ-Ω0-9\s.,!?:;()\-/%·"''~…∼℃±×÷]')) / length({_S}), 6) END AS ratio FROM documents""",
    "scl20_nested_path": "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k') AS same_k FROM events",
    "flt1_too_short": f"SELECT doc_id FROM documents WHERE length({_S}) < 15",
    "flt2_broken_unicode": r"SELECT doc_id, regexp_matches(text, '[\x{FFFD}\x00-\x08\x0b\x0c\x0e-\x1f]') AS broken FROM documents",
    "flt3_html_residue": r"SELECT page_id, regexp_matches(html, '<[a-zA-Z/][^>]{0,80}>|&[a-z]+;|\{\{.*?\}\}') AS residue FROM pages",
    "flt4_prompt_wrapper": r"SELECT doc_id, regexp_matches(text, '(?im)^\s*(system\s*:|###\s*instruction|<\|.*?\|>|assistant\s*:|user\s*:)') AS wrapper FROM documents",
    "flt5_junk_ratio": f"SELECT doc_id, CASE WHEN length({_S}) = 0 THEN 1.0 ELSE round((length({_S}) - length(regexp_replace({_S}, '{_JUNK}', '', 'g'))) / length({_S}), 6) END AS ratio FROM documents",
    "flt6_refusals": "SELECT doc_id, contains(text, 'All rights reserved') OR contains(text, 'licensed under') AS refusal FROM documents",
    "flt8_clean_content": f"SELECT doc_id, CASE WHEN ({_REASON}) IS NULL THEN {_S} END AS content, {_REASON} AS reason FROM documents",
    "flt9_needs_review": r"SELECT doc_id, regexp_matches(text, '(token|licensed\s*under|rights)') AS needs_review FROM documents",
    "flt10_garbage": "SELECT doc_id, len(regexp_extract_all(text, '[가-힣a-zA-Z0-9]')) < 2 AS garbage FROM documents",
    "flt11_quality_verdict": f"""WITH {_SQL_PAIRS} SELECT conv_id, turn, CASE WHEN question = '' OR answer = '' THEN 'empty' WHEN question = answer THEN 'invalid_answer' WHEN length(question) < 30 OR length(answer) < 30 THEN 'too_short'
WHEN length(question) > 200 OR length(answer) > 1000 THEN 'too_long' END AS reason FROM pairs""",
    "flt15_chunk_flags": f"WITH {_FLAGS} SELECT doc_id, too_short, too_long, meaningless, mid_cut, repetition, no_metadata FROM flags",
    "flt16_emergency": "SELECT doc_id, regexp_matches(text, 'idiot|clown.{0,15}th|worthless') AS emergency FROM documents",
    "flt17_risky_dosage": r"SELECT doc_id, regexp_matches(text, '[0-9]+\s?(mg|[mM][lL])') AS risky FROM documents",
    "flt18_non_answer": "SELECT doc_id, contains(text, 'All rights reserved') AS non_answer FROM documents",
    "flt19_embedding_problem": "SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'dimension' END AS problem FROM embeddings",
    "flt20_canonical_url": r"""SELECT page_id, CASE WHEN length(url) <= 500 AND regexp_matches(url, '^(?i)https?://[^/?#\s@]+(/|\?|#|$)') AND (regexp_extract(url, '^[a-zA-Z]+://[^/?#]*?:(\d*)', 1) IN ('', CASE WHEN url ILIKE 'https%' THEN '443' ELSE '80' END))
THEN lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)), ':\d*$', '') || CASE WHEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) END || regexp_extract(url, '(\?[^#]*)', 1) END AS url FROM pages""",
    "agg7_ingestion_report": f"""SELECT source, count(*) AS raw, sum((reason IS NULL)::INT)::BIGINT AS cleaned, (sum((reason IS NULL)::INT) - count(DISTINCT CASE WHEN reason IS NULL THEN hash END))::BIGINT AS duplicates
FROM (SELECT source, {_REASON} AS reason, sha256({_S}) AS hash FROM documents) GROUP BY source""",
    "agg8_filter_statistics": f"SELECT coalesce({_REASON}, 'passed') AS reason, count(*) AS n FROM documents GROUP BY 1",
    "agg8_distributions": f"""WITH r AS (SELECT coalesce({_REASON}, 'unknown') AS reason, (doc_id % 4 + 1)::VARCHAR AS source_tier, ['unknown', 'verified', 'unverified'][doc_id % 3 + 1] AS verification_status FROM documents)
SELECT part, name, count(*) AS n FROM (SELECT unnest(['reason', 'source_tier', 'verification_status']) AS part, unnest([reason, source_tier, verification_status]) AS name FROM r) GROUP BY ALL""",
    "agg9_review_categories": r"""WITH c AS (SELECT 'legal' AS category, regexp_matches(text, '(licen[sc]ed|rights reserved)') AS hit FROM documents UNION ALL SELECT 'contact', regexp_matches(text, '@|\+\d') FROM documents
UNION ALL SELECT 'secret', regexp_matches(text, '(token|password)') FROM documents) SELECT category, sum(hit::INT)::BIGINT AS n, round(sum(hit::INT) / count(*), 6) AS share FROM c GROUP BY category HAVING sum(hit::INT) > 0""",
    "agg9_default_categories": r"""WITH c AS (SELECT doc_id, unnest(['수술 적응', '용량', '확진/진단기준', '응급/긴급']) AS category, unnest([3, 3, 5, 5]) AS every FROM documents)
SELECT category, count(*) FILTER (doc_id % every = 0) AS n, round(count(*) FILTER (doc_id % every = 0) / count(*), 6) AS share FROM c GROUP BY category""",
    "agg10_chunk_quality": f"WITH {_FLAGS}, line AS (SELECT *, replace({_S}, chr(10), ' ') AS t FROM flags), shown AS (SELECT *, CASE WHEN length(t) > 120 THEN t[1:120] || '…' ELSE t END AS p FROM line) SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS flag, sum({f}::INT)::BIGINT AS n, round(100.0 * sum({f}::INT) / count(*), 4) AS percent, coalesce(list(p ORDER BY doc_id) FILTER ({f}), [])[1:3] AS samples FROM shown" for f in _FLAG_NAMES) + ")",
    "agg14_answer_cases": f"WITH {_SQL_PAIRS} SELECT conv_id, turn, ({_NORM.format('question')} = {_NORM.format('answer')})::INT::DOUBLE AS exact_match, round({_f1('question', 'answer')}, 9) AS token_f1 FROM pairs",
    "agg14_answer_metrics": f"WITH {_SQL_PAIRS} SELECT count(*) AS cases, round(avg(({_NORM.format('question')} = {_NORM.format('answer')})::INT), 6) AS exact_match, round(avg({_f1('question', 'answer')}), 6) AS token_f1 FROM pairs",
    "agg15_detector": """WITH f AS (SELECT toxic = 1 AS t, regexp_matches(lower(text), 'idiot|clown|worthless') AS flag FROM documents JOIN labels USING (doc_id)),
c AS (SELECT sum((t AND flag)::INT)::BIGINT AS tp, sum((t AND NOT flag)::INT)::BIGINT AS fn, sum((NOT t AND flag)::INT)::BIGINT AS fp, sum((NOT t AND NOT flag)::INT)::BIGINT AS tn FROM f)
SELECT *, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp / nullif(fp + tn, 0), 6) AS fpr FROM c""",
    "agg15_detector_faults": f"""WITH f AS (SELECT doc_id, toxic = 1 AS t, regexp_matches(lower(text), 'idiot|clown|worthless') AS flag, replace({_S}, chr(10), ' ') AS line FROM documents JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN t THEN 'missed' ELSE 'false_alarm' END AS fault, CASE WHEN length(line) > 120 THEN line[1:120] || '…' ELSE line END AS preview FROM f WHERE t <> flag""",
    "agg16_mcq_accuracy": f"WITH {_ANSWERS} SELECT count(*) AS of, count(*) FILTER (correct) AS correct, round(count(*) FILTER (correct) / count(*), 6) AS accuracy FROM graded",
    "agg16_mcq_graded": f"WITH {_ANSWERS} SELECT id, gold_letter, gold_text, correct FROM graded",
    "agg16_mcq_wrong": f"WITH {_ANSWERS} SELECT id, question[1:60] AS question, coalesce(gold_letter, '') || '. ' || gold_text AS gold, response[1:150] AS response FROM graded WHERE NOT correct ORDER BY id LIMIT 5",
}
