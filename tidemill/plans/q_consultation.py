"""CON1-CON6, ANS1, ANS2 over conversations."""

from pyspark.sql import functions as F

from tidemill.operators import consultation as C
from tidemill.operators import conversations as V
from tidemill.plans.q_conversations import _PAIRS
from tidemill.plans.tables import conversations
from tidemill.sources.adapters import single_department

_LEXICON = {"north": ("the", "and th", "ing"), "south": ("der", "und", "sch"), "west": ("les", "que", "ment")}
_NAMES = ("the", "then", "der", "dans")


def _turns(s, d):
    return conversations(s, d).select("conv_id", "turn", "role", "text")


_CON1 = """WITH b AS (SELECT conv_id, turn, regexp_replace(text, '\\s+', '', 'g') AS b FROM conversations), h AS (SELECT conv_id, turn, {counts} FROM b),
r AS (SELECT *, greatest(north, south, west) AS best, (north = greatest(north, south, west))::INT + (south = greatest(north, south, west))::INT + (west = greatest(north, south, west))::INT AS ties FROM h)
SELECT conv_id, turn, CASE WHEN best = 0 THEN NULL WHEN north = best THEN 'north' WHEN south = best THEN 'south' ELSE 'west' END AS department,
CASE WHEN best = 0 THEN '낮음' WHEN ties > 1 THEN '중간' WHEN best >= 2 THEN '높음' ELSE '중간' END AS confidence FROM r""".format(counts=", ".join(f"{' + '.join(f'contains(b, {chr(39)}{w.replace(chr(32), str())}{chr(39)})::INT' for w in ws)} AS {k}" for k, ws in _LEXICON.items()))
_SINGLE = "CASE WHEN contains(text, 'then') THEN CASE WHEN contains(text, 'der') OR contains(text, 'dans') THEN NULL ELSE 'then' END ELSE CASE contains(text, 'the')::INT + contains(text, 'der')::INT + contains(text, 'dans')::INT WHEN 1 THEN CASE WHEN contains(text, 'the') THEN 'the' WHEN contains(text, 'der') THEN 'der' ELSE 'dans' END END END"


def _resolve(s, d):
    c = C.classified(_turns(s, d), lexicon=_LEXICON)
    given, sure, vote = F.when(F.col("turn") % 3 == 0, "given"), F.when(F.col("turn") % 2 == 0, C.HIGH).otherwise(C.LOW), F.when(F.col("conv_id") % 2 == 0, "voted")
    return c.select("conv_id", "turn", C.resolved(given, sure, vote, F.col("department")).alias("department"))


def _fill(s, d):
    t = _turns(s, d).where("role = 'assistant'")
    dep, conf = C.filled_from_answer(F.when(F.col("turn") % 4 == 1, "kept"), F.lit(C.HIGH), F.col("text"), _NAMES)
    return t.select("conv_id", "turn", dep.alias("department"), conf.alias("confidence"))


def _outcomes(s, d):
    p = V.pairs(_turns(s, d)).withColumns({"chunks": F.split("question", " "), "answer": F.when(F.col("turn") % 5 == 0, " ").otherwise(F.col("answer"))})
    return C.outcomes(p, "question", "answer", "chunks", F.contains("question", F.lit("idiot"))).select("conv_id", "turn", "is_emergency", "is_fallback", "error_type", "rag_hit_count")


def _prompts(s, d):
    p = V.pairs(_turns(s, d))
    held = p.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "question", "answer"))).alias("h"), F.max_by("question", "turn").alias("q"))
    return held.select("conv_id", F.explode(C.prompt("Be kind.", F.col("h"), F.col("q"), F.lit("hint"), F.when(F.col("conv_id") % 2 == 0, F.lit("refs")))).alias("m")).groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum(F.length("m.content")).alias("chars"))


def _answers(s, d):
    """Assistant turns, some of them spoilt as the rules expect."""
    t = _turns(s, d).where("role = 'assistant'")
    spoilt = F.element_at(F.array(F.concat(F.lit("<s>"), "text", F.lit("</s>")), F.concat("text", F.lit("\nuser: more?\n")), F.concat("text", F.lit("\n\nDisclaimer: not a doctor")), F.concat("text", F.lit("\nDisplayName: x")), F.concat("text", F.lit('\n{"a": 1}')), F.concat("text", F.lit("\nok\nok\nok")), F.col("text")), ((F.col("conv_id") + F.col("turn")) % 7 + 1).cast("int"))
    return C.sanitize(t.withColumn("answer", spoilt), language="en")


QUERIES = {
    "con1_classified": lambda s, d: C.classified(_turns(s, d), lexicon=_LEXICON).select("conv_id", "turn", "department", "confidence"),
    "con2_resolved": _resolve,
    "con3_filled_from_answer": _fill,
    "con4_outcomes": _outcomes,
    "con5_prompts": _prompts,
    "con6_single_department": lambda s, d: _turns(s, d).select("conv_id", "turn", single_department(F.col("text"), _NAMES).alias("department")),
    "ans1_sanitized": lambda s, d: _answers(s, d).select("conv_id", "turn", "sanitized", F.array_join("rules", ",").alias("rules")),
    "ans2_rule_report": lambda s, d: C.rule_report(_answers(s, d)),
}

SQL = {
    "con1_classified": _CON1,
    "con2_resolved": f"SELECT conv_id, turn, CASE WHEN turn % 3 = 0 AND turn % 2 = 0 THEN 'given' WHEN conv_id % 2 = 0 THEN 'voted' WHEN turn % 3 = 0 THEN 'given' ELSE department END AS department FROM ({_CON1})",
    "con3_filled_from_answer": f"SELECT conv_id, turn, coalesce(CASE WHEN turn % 4 = 1 THEN 'kept' END, {_SINGLE}) AS department, CASE WHEN turn % 4 <> 1 AND ({_SINGLE}) IS NOT NULL THEN '중간' ELSE '높음' END AS confidence FROM conversations WHERE role = 'assistant'",
    "con4_outcomes": f"""WITH {_PAIRS} SELECT conv_id, turn, contains(question, 'idiot') AS is_emergency, NOT contains(question, 'idiot') AND turn % 5 = 0 AS is_fallback, CASE WHEN NOT contains(question, 'idiot') AND turn % 5 = 0 THEN 'NonAnswerFiltered' END AS error_type,
CASE WHEN contains(question, 'idiot') THEN 0 ELSE len(string_split(question, ' '))::INT END AS rag_hit_count FROM pairs""",
    "con5_prompts": f"""WITH {_PAIRS} SELECT conv_id, count(*) * 2 + 2 AS messages, (8 + sum(length(question) + length(answer)) + 6 + CASE WHEN conv_id % 2 = 0 THEN 6 ELSE 0 END + length(arg_max(question, turn)))::BIGINT AS chars FROM pairs GROUP BY conv_id""",
    "con6_single_department": f"SELECT conv_id, turn, {_SINGLE} AS department FROM conversations",
}
