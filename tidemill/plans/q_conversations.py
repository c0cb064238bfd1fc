"""JN5, JN6, JN11, JN12, WIN6-WIN8, WIN10, WIN11, AGG22, TOP11 over conversations."""

from pyspark.sql import functions as F

from tidemill.operators import cascade
from tidemill.operators import conversations as C
from tidemill.plans.tables import conversations, documents

def _lang():
    return F.when(F.col("text").rlike("(^|[^a-z])(the|of)([^a-z]|$)"), "en").when(F.col("text").rlike("(^|[^a-z])(der|und)([^a-z]|$)"), "de")
_SQL_LANG = "CASE WHEN regexp_matches(text, '(^|[^a-z])(the|of)([^a-z]|$)') THEN 'en' WHEN regexp_matches(text, '(^|[^a-z])(der|und)([^a-z]|$)') THEN 'de' END"


def _heads(s, d):
    """Conversations with a title, an owner, a category and a time, made from their turns."""
    m = conversations(s, d)
    own = m.groupBy("conv_id").agg(F.min_by(F.when(F.col("role") == "user", F.col("text")), F.struct(F.col("role") != "user", "turn")).alias("t"), F.count("*").alias("updated_at"))
    return own.select("conv_id", F.substring("t", 1, 30).alias("title"), F.when(F.col("conv_id") % 3 == 0, "even").alias("category"), (F.col("conv_id") % 17).alias("user_id"), "updated_at")


_HEADS = """heads AS (SELECT conv_id, (arg_min(text, turn) FILTER (role = 'user'))[1:30] AS title, CASE WHEN conv_id % 3 = 0 THEN 'even' END AS category, conv_id % 17 AS user_id, count(*) AS updated_at FROM conversations GROUP BY conv_id)"""
_PAIRS = """pairs AS (SELECT conv_id, turn, question, text AS answer FROM (SELECT *, lag(role) OVER w AS r, lag(text) OVER w AS question FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'assistant' AND r = 'user' AND trim(text) <> '' AND trim(question) <> '')"""


def _mapping(s):
    return s.createDataFrame([(3, 100), (5, 101)], "old_id long, new_id long")


def _messages(s, d):
    """Turns as messages with an id of their own."""
    return conversations(s, d).select((F.col("conv_id") * 100 + F.col("turn")).alias("message_id"), "conv_id", "turn", "role", "text")


def _attachments(s, d):
    """One to three files of every third turn."""
    own = _messages(s, d).where("turn % 3 = 0").select("message_id", F.explode(F.sequence(F.lit(1), (F.col("conv_id") % 3 + 1).cast("int"))).alias("place"))
    return own.select((F.col("message_id") * 10 + F.col("place")).alias("attachment_id"), "message_id")


def _erased(s, d, part):
    """What stays of each table after two users' data go."""
    heads = _heads(s, d)
    tables = {
        "users": heads.select("user_id").distinct(), "conversations": heads, "messages": _messages(s, d), "attachments": _attachments(s, d),
        "logs": _messages(s, d).where("role = 'assistant'").select(F.col("message_id").alias("log_id"), "message_id"), "documents": documents(s, d).select("doc_id", (F.col("doc_id") % 17).alias("user_id")),
    }
    return cascade.erase(tables, cascade.USER_DATA, "users", s.createDataFrame([(3,), (5,)], "user_id long"))[part]


def _user_turns(s, d):
    return conversations(s, d).where("role = 'user'").select("conv_id", "turn", "text", _lang().alias("department"))


QUERIES = {
    "jn5_search": lambda s, d: C.search(_heads(s, d), conversations(s, d), "ing th").select("conv_id", "title"),
    "jn5_search_blank": lambda s, d: C.search(_heads(s, d), conversations(s, d), "  ").select("conv_id", "title"),
    "jn6_message_counts": lambda s, d: C.message_counts(_heads(s, d), conversations(s, d)),
    "jn6_attachment_counts": lambda s, d: C.attachment_counts(_heads(s, d), _messages(s, d), _attachments(s, d)),
    "jn11_remap_owner": lambda s, d: C.remap_owner(_heads(s, d), _mapping(s)).select("conv_id", "user_id", "remapped"),
    "jn12_erase_conversations": lambda s, d: _erased(s, d, "conversations").select("conv_id", "user_id"),
    "jn12_erase_messages": lambda s, d: _erased(s, d, "messages").select("conv_id", "turn"),
    "jn12_erase_attachments": lambda s, d: _erased(s, d, "attachments"),
    "jn12_erase_logs": lambda s, d: _erased(s, d, "logs"),
    "jn12_erase_documents": lambda s, d: _erased(s, d, "documents"),
    "win6_pairs": lambda s, d: C.pairs(conversations(s, d)),
    "win7_history": lambda s, d: C.history(C.pairs(conversations(s, d)), 6, 2000).select("conv_id", "turn", "back", "sum_chars"),
    "win8_expanded_queries": lambda s, d: C.expanded_queries(_user_turns(s, d)),
    "win10_titles": lambda s, d: C.titles(conversations(s, d)),
    "win11_sticky_category": lambda s, d: C.sticky_category(conversations(s, d).where("role = 'assistant'").select("conv_id", "turn", _lang().alias("department"), (F.length("text") < 200).alias("is_fallback"))),
    "agg22_by_category": lambda s, d: C.by_category(_heads(s, d)),
    "top11_newest_first": lambda s, d: _heads(s, d).withColumn("place", F.row_number().over(C.Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "conv_id"))).select("user_id", "conv_id", "place"),
}

SQL = {
    "jn5_search": f"""WITH {_HEADS} SELECT conv_id, title FROM heads h WHERE title ILIKE '%ing th%' OR category ILIKE '%ing th%' OR EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = h.conv_id AND c.text ILIKE '%ing th%')""",
    "jn5_search_blank": f"WITH {_HEADS} SELECT conv_id, title FROM heads",
    "jn6_message_counts": f"WITH {_HEADS} SELECT user_id, role, count(*) AS n FROM heads JOIN conversations USING (conv_id) GROUP BY ALL",
    "jn6_attachment_counts": "SELECT conv_id % 17 AS user_id, sum(conv_id % 3 + 1)::BIGINT AS n FROM conversations WHERE turn % 3 = 0 GROUP BY 1",
    "jn11_remap_owner": f"WITH {_HEADS} SELECT conv_id, CASE user_id WHEN 3 THEN 100 WHEN 5 THEN 101 ELSE user_id END AS user_id, user_id IN (3, 5) AS remapped FROM heads",
    "jn12_erase_conversations": f"WITH {_HEADS} SELECT conv_id, user_id FROM heads WHERE user_id NOT IN (3, 5)",
    "jn12_erase_messages": "SELECT conv_id, turn FROM conversations WHERE conv_id % 17 NOT IN (3, 5)",
    "jn12_erase_attachments": "SELECT (conv_id * 100 + turn) * 10 + unnest(range(1, conv_id % 3 + 2)) AS attachment_id, conv_id * 100 + turn AS message_id FROM conversations WHERE turn % 3 = 0 AND conv_id % 17 NOT IN (3, 5)",
    "jn12_erase_logs": "SELECT conv_id * 100 + turn AS log_id, conv_id * 100 + turn AS message_id FROM conversations WHERE role = 'assistant' AND conv_id % 17 NOT IN (3, 5)",
    "jn12_erase_documents": "SELECT doc_id, CASE WHEN doc_id % 17 NOT IN (3, 5) THEN doc_id % 17 END AS user_id FROM documents",
    "win6_pairs": f"WITH {_PAIRS} SELECT * FROM pairs",
    "win7_history": f"""WITH {_PAIRS} SELECT conv_id, turn, back, sum_chars FROM (SELECT *, row_number() OVER w AS back, (sum(length(question) + length(answer)) OVER w)::BIGINT AS sum_chars FROM pairs
WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) WHERE back <= 6 AND sum_chars <= 2000""",
    "win8_expanded_queries": f"""WITH u AS (SELECT conv_id, turn, text, {_SQL_LANG} AS dep FROM conversations WHERE role = 'user'),
l AS (SELECT *, lag(text, 1) OVER w AS t1, lag(text, 2) OVER w AS t2, lag(text, 3) OVER w AS t3, lag(dep, 1) OVER w AS d1, lag(dep, 2) OVER w AS d2, lag(dep, 3) OVER w AS d3 FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN dep IS NOT NULL THEN text WHEN d1 IS NOT NULL THEN concat_ws(' ', t1, text) WHEN d2 IS NOT NULL THEN concat_ws(' ', t2, t1, text) WHEN d3 IS NOT NULL THEN concat_ws(' ', t3, t2, t1, text) ELSE text END AS query FROM l""",
    "win10_titles": r"""SELECT conv_id, CASE WHEN length(t) > 40 THEN t[1:40] || '…' ELSE t END AS title FROM (SELECT conv_id, trim(replace(arg_min(text, turn), chr(10), ' ')) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id)""",
    "win11_sticky_category": f"SELECT conv_id, arg_min(coalesce({_SQL_LANG}, '기타'), turn) AS category FROM conversations WHERE role = 'assistant' AND length(text) >= 200 GROUP BY conv_id",
    "agg22_by_category": f"WITH {_HEADS} SELECT coalesce(category, '기타') AS category, conv_id, count(*) OVER (PARTITION BY coalesce(category, '기타')) AS n FROM heads",
    "top11_newest_first": f"WITH {_HEADS} SELECT user_id, conv_id, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, conv_id) AS place FROM heads",
}

