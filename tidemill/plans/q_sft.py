"""SFT1-SFT10, FLT12, FLT13, WIN2-WIN4, TOP8-TOP10, TOP12, AGG11, AGG12, SNK6 over conversations and documents."""

from pyspark.sql import functions as F

from tidemill.functions import text as X
from tidemill.operators import sft as S
from tidemill.plans.q_text import _SQL_PAIRS, _pairs
from tidemill.plans.tables import conversations, documents

_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(<x>, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_MASK = f"regexp_replace(regexp_replace(<x>, '{X.EMAIL}', '[이메일]', 'g'), '{X.PHONE}', '[전화번호]', 'g')"


def _cm(x):
    return _MASK.replace("<x>", _CLEAN.replace("<x>", x))


def _messages(s, d):
    return S.conversation_messages(conversations(s, d))


_MESSAGES = f"""told AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role, {_cm('text')} AS content FROM conversations),
held AS (SELECT conv_id, list({{'role': role, 'content': content}} ORDER BY turn) FILTER (content <> '') AS m FROM told GROUP BY conv_id),
messages AS (SELECT conv_id, CASE WHEN len(m) >= 2 AND m[1].role = 'user' AND m[-1].role = 'assistant' THEN m END AS messages FROM held)"""


def _typed(s, d):
    """documents with a kind to mix and split by."""
    return documents(s, d).select("doc_id", "source", F.element_at(F.array(*map(F.lit, S.RATIOS)), (F.col("doc_id") % 3 + 1).cast("int")).alias("data_type"))


_TYPED = "typed AS (SELECT doc_id, source, ['medical_knowledge', 'medical_reasoning', 'conversation_style'][doc_id % 3 + 1] AS data_type FROM documents)"
_ORDER = "md5('42:' || doc_id), doc_id"


def _exam(s, d):
    """Questions whose choices are the fifths of the whole answer (in a map, its halves), some left out; the right one by index, or as
    a letter, a number or neither."""
    p = _pairs(s, d).withColumns({"w": F.ceil(F.length("answer") / 5).cast("int"), "h": F.ceil(F.length("answer") / 2).cast("int")})
    opt = {k: F.when((F.col("turn") + i) % 5 != 0, F.substring("answer", i * F.col("w") + 1, F.col("w"))) for i, k in enumerate("ABCDE")}
    return p.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "conv_id", "question", *[c.alias(k) for k, c in opt.items()], (F.col("turn") % 4).alias("answer_idx"), F.element_at(F.array(*map(F.lit, ("A", "2", "E", "7", "b"))), (F.col("conv_id") % 5 + 1).cast("int")).alias("answer"),
                    F.when(F.col("turn") % 3 > 0, "because").alias("explanation"), F.map_from_arrays(F.array(F.lit("option_A"), F.lit("option_B")), F.array(F.substring("answer", F.lit(1), F.col("h")), F.substring("answer", F.col("h") + 1, F.col("h")))).alias("options"))


def _converted(s, d):
    numbered = S.mcq_numbered(_exam(s, d))
    return numbered.withColumns({"source_dataset": F.col("conv_id") % 4, "reason": S.mcq_reason("question", "ABCDE", "answer")})


def _priority(s, d):
    return documents(s, d).withColumn("p", S.priority_of(F.col("source"), ["src3", "src1", "src2"]))


_P = "CASE source WHEN 'src3' THEN 1 WHEN 'src1' THEN 2 WHEN 'src2' THEN 3 ELSE 4 END"

QUERIES = {
    "sft1_qa_messages": lambda s, d: S.qa_messages(_pairs(s, d)).select("conv_id", "turn", S.rendered(F.col("messages")).alias("shown")),
    "sft2_mcq_columns": lambda s, d: S.mcq_columns(_exam(s, d)).select("id", S.rendered(F.col("messages")).alias("shown")),
    "sft3_mcq_map": lambda s, d: S.mcq_map(_exam(s, d)).select("id", S.rendered(F.col("messages")).alias("shown")),
    "sft4_mcq_numbered": lambda s, d: S.mcq_numbered(_exam(s, d), prefix="Answer: ").select("id", S.rendered(F.col("messages")).alias("shown")),
    "sft5_dialogue": lambda s, d: _messages(s, d).select("conv_id", S.rendered(F.col("messages")).alias("shown")),
    "sft6_merge_turns": lambda s, d: S.merge_turns(conversations(s, d).withColumn("role", F.when(F.col("role") == "system", "user").otherwise(F.col("role")))).select("conv_id", F.col("run").cast("long").alias("run"), "role", "content"),
    "sft7_strip_reasoning": lambda s, d: _messages(s, d).select("conv_id", S.rendered(S.strip_reasoning(F.col("messages"))).alias("shown")),
    "sft8_by_path": lambda s, d: S.by_path(_pairs(s, d).select("conv_id", "turn", F.struct(F.struct("question", "answer").alias("body")).alias("raw")), "raw.body.question", "raw.body.answer").select("conv_id", "turn", S.rendered(F.col("messages")).alias("shown")),
    "sft9_prompt_completion": lambda s, d: _messages(s, d).where("messages IS NOT NULL").select("conv_id", S.rendered(S.prompt_completion(F.col("messages"))[0]).alias("prompt"), S.prompt_completion(F.col("messages"))[1]["content"].alias("completion")),
    "sft10_rendered": lambda s, d: _messages(s, d).where("messages IS NOT NULL").select("conv_id", F.sha2(S.rendered(F.col("messages")), 256).alias("shown_sha256")),
    "flt12_mcq_valid": lambda s, d: _exam(s, d).select("id", S.mcq_valid("question", "ABCDE", "answer").alias("valid")),
    "flt13_structure": lambda s, d: conversations(s, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m")).groupBy((F.col("conv_id") % 3).alias("split")).agg(F.count_if(~S.structure_ok(F.col("m"))).alias("issues"), F.count("*").alias("n")),
    "win2_priority_dedup": lambda s, d: S.first_of(_priority(s, d), F.sha2("text", 256), "p", "doc_id").select("doc_id", "source"),
    "win3_question_dedup": lambda s, d: S.first_of(_messages(s, d).where("messages IS NOT NULL"), S.first_question(F.col("messages")), "conv_id").select("conv_id"),
    "win4_pair_dedup": lambda s, d: S.first_of(_pairs(s, d), F.sha2(F.concat("question", F.lit("\0"), "answer"), 256), "conv_id", "turn").select("conv_id", "turn"),
    "top8_cap_per_source": lambda s, d: S.cap_per_source(documents(s, d), "source", "doc_id", 20).select("source", "doc_id"),
    "top9_mix": lambda s, d: S.mix(_typed(s, d), "data_type", "doc_id").select("doc_id", "data_type"),
    "top10_split": lambda s, d: S.split(_typed(s, d), "data_type", "doc_id").select("doc_id", "data_type", "split"),
    "top12_sample": lambda s, d: documents(s, d).select("doc_id").orderBy(F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string"))), "doc_id").limit(10),
    "agg11_conversion_report": lambda s, d: S.conversion_report(_messages(s, d).withColumn("source_dataset", F.col("conv_id") % 4), "source_dataset"),
    "agg11_explanations": lambda s, d: S.conversion_report(_converted(s, d), "source_dataset", explanation="explanation").select("source_dataset", "total", "kept", "explained"),
    "agg11_reasons": lambda s, d: S.conversion_reasons(_converted(s, d), "source_dataset"),
    "agg12_mixture": lambda s, d: S.shares(_typed(s, d), "data_type"),
}

_Q, _A = _cm("question"), _cm("answer")
_SHOWN = "array_to_string(list_transform({}, lambda x: '<' || x.role || '>' || chr(10) || x.content || chr(10) || '</' || x.role || '>'), chr(10))"
_PAIR_SHOWN = f"'<user>' || chr(10) || {_Q} || chr(10) || '</user>' || chr(10) || '<assistant>' || chr(10) || {_A} || chr(10) || '</assistant>'"

def _clean(x):
    return f"coalesce({_CLEAN.replace('<x>', x)}, '')"


def _masked(x):
    return _MASK.replace("<x>", f"({x})")


_PART = "CASE WHEN (turn + {i}) % 5 <> 0 THEN substr(answer, {i} * w + 1, w) END"
_CHOICES = ", ".join("{'key': '" + k + "', 'text': " + _clean(_PART.format(i=i)) + "}" for i, k in enumerate("ABCDE"))
_EXAM = f"""{_SQL_PAIRS}, halves AS (SELECT *, ceil(length(answer) / 5.0)::INT AS w, ceil(length(answer) / 2.0)::INT AS h FROM pairs),
exam AS (SELECT conv_id * 100 + turn AS id, conv_id, {_clean('question')} AS question, list_filter([{_CHOICES}], lambda o: o.text <> '') AS five, turn % 4 AS answer_idx, ['A', '2', 'E', '7', 'b'][conv_id % 5 + 1] AS answer, ['A', 'B', 'E', NULL, 'B'][conv_id % 5 + 1] AS letter,
CASE WHEN turn % 3 > 0 THEN 'because' ELSE '' END AS explanation, {_clean('substr(answer, 1, h)')} AS a, {_clean('substr(answer, h + 1, h)')} AS b FROM halves)"""
_TWO = "'<user>' || chr(10) || {} || chr(10) || '</user>' || chr(10) || '<assistant>' || chr(10) || {} || chr(10) || '</assistant>'"
_ASK = "'다음 의학 문제에 답하세요.' || chr(10) || chr(10) || '질문:' || chr(10) || question"
_LIST = "array_to_string(list_transform({}, lambda o: o.key || '{} ' || o.text), chr(10))"

SQL = {
    "sft2_mcq_columns": f"""WITH {_EXAM}, four AS (SELECT *, list_filter(five, lambda o: o.key <> 'E') AS opts, ['A', 'B', 'C', 'D'][answer_idx + 1] AS l FROM exam), t AS (SELECT *, coalesce(list_filter(opts, lambda x: x.key = l)[1].text, upper(answer)) AS r FROM four)
SELECT id, CASE WHEN question <> '' AND len(opts) > 0 THEN {_TWO.format(_masked(_ASK + " || chr(10) || chr(10) || " + _LIST.format('opts', '.')), _masked("'정답은 ' || l || '입니다.' || chr(10) || chr(10) || l || '. ' || CASE WHEN r = upper(answer) THEN answer ELSE r END"))} END AS shown FROM t""",
    "sft3_mcq_map": f"""WITH {_EXAM}, t AS (SELECT *, upper(answer) AS l, CASE upper(answer) WHEN 'A' THEN a WHEN 'B' THEN b ELSE '' END AS r, list_filter([{{'key': 'A', 'text': a}}, {{'key': 'B', 'text': b}}], lambda o: o.text <> '') AS opts FROM exam)
SELECT id, CASE WHEN question <> '' AND len(opts) > 0 AND r <> '' THEN {_TWO.format(_masked(_ASK + " || chr(10) || chr(10) || '선택지:' || chr(10) || " + _LIST.format('opts', '.')), _masked("'정답은 ' || l || '입니다.' || chr(10) || chr(10) || l || '. ' || r || CASE WHEN explanation <> '' THEN chr(10) || chr(10) || '해설: ' || explanation ELSE '' END"))} END AS shown FROM t""",
    "sft4_mcq_numbered": f"""WITH {_EXAM}, t AS (SELECT *, list_filter(five, lambda x: x.key = letter)[1].text AS r FROM exam)
SELECT id, CASE WHEN question <> '' AND len(five) >= 2 AND r IS NOT NULL THEN {_TWO.format("'Answer: ' || question || chr(10) || " + _LIST.format('five', ')'), "letter || ') ' || r")} END AS shown FROM t""",
    "flt12_mcq_valid": f"WITH {_EXAM} SELECT id, question <> '' AND len(five) >= 2 AS valid FROM exam",
    "agg11_explanations": f"WITH {_EXAM} SELECT conv_id % 4 AS source_dataset, count(*) AS total, count(*) FILTER (question <> '' AND len(five) >= 2 AND list_filter(five, lambda x: x.key = letter)[1].text IS NOT NULL) AS kept, count(*) FILTER (explanation <> '') AS explained FROM exam GROUP BY 1",
    "agg11_reasons": f"""WITH {_EXAM}, t AS (SELECT conv_id % 4 AS source_dataset, CASE WHEN question = '' THEN 'no_question' WHEN len(five) < 2 THEN 'few_choices' WHEN list_filter(five, lambda x: x.key = letter)[1].text IS NULL THEN 'unknown_answer' END AS reason FROM exam)
SELECT source_dataset, reason, count(*) AS n, sum(count(*)) OVER (PARTITION BY reason)::BIGINT AS total FROM t WHERE reason IS NOT NULL GROUP BY source_dataset, reason""",
    "sft1_qa_messages": f"WITH {_SQL_PAIRS} SELECT conv_id, turn, {_PAIR_SHOWN} AS shown FROM pairs",
    "sft5_dialogue": f"WITH {_MESSAGES} SELECT conv_id, {_SHOWN.format('messages')} AS shown FROM messages",
    "sft6_merge_turns": """WITH t AS (SELECT conv_id, turn, text, CASE role WHEN 'system' THEN 'user' ELSE role END AS role FROM conversations), n AS (SELECT *, coalesce((lag(role) OVER w <> role)::INT, 1) AS new FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM n) SELECT conv_id, run::BIGINT AS run, any_value(role) AS role, string_agg(text, ' ' ORDER BY turn) AS content FROM r GROUP BY conv_id, run""",
    "sft7_strip_reasoning": f"WITH {_MESSAGES} SELECT conv_id, {_SHOWN.format('messages')} AS shown FROM messages",
    "sft8_by_path": f"WITH {_SQL_PAIRS} SELECT conv_id, turn, {_PAIR_SHOWN} AS shown FROM pairs",
    "sft9_prompt_completion": f"WITH {_MESSAGES} SELECT conv_id, {_SHOWN.format('messages[1:len(messages) - 1]')} AS prompt, messages[-1].content AS completion FROM messages WHERE messages IS NOT NULL",
    "sft10_rendered": f"WITH {_MESSAGES} SELECT conv_id, sha256({_SHOWN.format('messages')}) AS shown_sha256 FROM messages WHERE messages IS NOT NULL",
    "flt13_structure": "WITH m AS (SELECT conv_id, arg_min(role, turn) = 'user' AND arg_max(role, turn) = 'assistant' AND min(length(trim(text))) > 0 AS ok FROM conversations GROUP BY conv_id) SELECT conv_id % 3 AS split, count(*) FILTER (NOT ok) AS issues, count(*) AS n FROM m GROUP BY 1",
    "win2_priority_dedup": f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY {_P}, doc_id) AS n FROM documents) WHERE n = 1",
    "win3_question_dedup": f"""WITH {_MESSAGES}, q AS (SELECT conv_id, lower(list_filter(messages, lambda x: x.role = 'user')[1].content) AS q FROM messages WHERE messages IS NOT NULL) SELECT conv_id FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY conv_id) AS n FROM q) WHERE n = 1""",
    "win4_pair_dedup": f"WITH {_SQL_PAIRS} SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY question, answer ORDER BY conv_id, turn) AS n FROM pairs) WHERE n = 1",
    "top8_cap_per_source": f"SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_ORDER}) AS n FROM documents) WHERE n <= 20",
    "top9_mix": f"""WITH {_TYPED}, r AS (SELECT * FROM (VALUES ('medical_knowledge', 0.6::DOUBLE), ('medical_reasoning', 0.25::DOUBLE), ('conversation_style', 0.15::DOUBLE)) r(data_type, ratio)),
f AS (SELECT min(n / ratio) AS feasible FROM (SELECT data_type, count(*) AS n FROM typed GROUP BY 1) JOIN r USING (data_type))
SELECT doc_id, data_type FROM (SELECT *, row_number() OVER (PARTITION BY data_type ORDER BY {_ORDER}) AS n FROM typed) JOIN r USING (data_type), f WHERE n <= trunc(feasible * ratio)""",
    "top10_split": f"""WITH {_TYPED} SELECT doc_id, data_type, CASE WHEN n <= floor(ceil(c * 0.2::DOUBLE) / 2) THEN 'test' WHEN n <= ceil(c * 0.2::DOUBLE) THEN 'validation' ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY data_type ORDER BY {_ORDER}) AS n, count(*) OVER (PARTITION BY data_type) AS c FROM typed)""",
    "top12_sample": f"SELECT doc_id FROM documents ORDER BY {_ORDER} LIMIT 10",
    "agg11_conversion_report": f"""WITH {_MESSAGES}, z AS (SELECT conv_id % 4 AS source_dataset, messages, len(messages)::INT AS n, list_sum(list_transform(messages, lambda x: length(x.content)))::INT AS c FROM messages)
SELECT source_dataset, count(*) AS total, count(messages) AS kept, round(count(messages) / count(*), 6) AS ratio, round(avg(n), 6) AS avg_turns, min(n) AS min_turns, max(n) AS max_turns, round(avg(c), 6) AS avg_chars, max(c) AS max_chars FROM z GROUP BY 1""",
    "agg12_mixture": f"WITH {_TYPED} SELECT data_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM typed GROUP BY data_type",
}
