"""AGG1-AGG6, AGG18, STR5 over events as consultation logs."""

from pyspark.sql import functions as F

from tidemill.operators import dashboard as D
from tidemill.plans.tables import SQL_LOG, TODAY, documents, events, log


def _window(days: int) -> str:
    return f"created_at >= DATE '{TODAY}' - {days - 1} AND created_at < DATE '{TODAY}' + 1"


_BUCKET = "CASE WHEN n BETWEEN 1 AND 5 THEN '1-5' WHEN n BETWEEN 6 AND 10 THEN '6-10' WHEN n BETWEEN 11 AND 20 THEN '11-20' ELSE '21+' END"


def _usage(days: int) -> str:
    return f"""SELECT b.bucket, count(u.user_id)::BIGINT AS users FROM (VALUES ('1-5'), ('6-10'), ('11-20'), ('21+')) b(bucket)
LEFT JOIN (SELECT user_id, {_BUCKET} AS bucket FROM (SELECT user_id, count(*) AS n FROM log WHERE {_window(days)} AND user_id IS NOT NULL GROUP BY user_id)) u USING (bucket) GROUP BY b.bucket"""


def _daily(days: int) -> str:
    return f"""SELECT c.day, coalesce(k.total, 0)::BIGINT AS total, coalesce(k.emergencies, 0)::BIGINT AS emergencies
FROM (SELECT unnest(generate_series(DATE '{TODAY}' - {days - 1}, DATE '{TODAY}', INTERVAL 1 DAY))::DATE AS day) c
LEFT JOIN (SELECT created_at::DATE AS day, count(*) AS total, sum(CASE WHEN is_emergency THEN 1 ELSE 0 END) AS emergencies FROM log WHERE {_window(days)} GROUP BY 1) k USING (day)"""


_KPIS = f"""SELECT *, round(rag_hits / nullif(total, 0), 6) AS rag_hit_rate, round(fallbacks / nullif(total, 0), 6) AS fallback_rate FROM (
SELECT count(*) AS total, coalesce(sum((rag_hit_count > 0)::INT), 0)::BIGINT AS rag_hits, coalesce(sum(is_fallback::INT), 0)::BIGINT AS fallbacks, coalesce(sum(is_emergency::INT), 0)::BIGINT AS emergencies,
count(DISTINCT user_id) AS users, round(avg(response_time_ms), 6) AS avg_response_ms FROM log WHERE {_window(1)})"""
_MODELS = f"""SELECT model_id, count(*) AS total, sum(CASE WHEN is_fallback THEN 0 ELSE 1 END)::BIGINT AS succeeded, round(sum(CASE WHEN is_fallback THEN 0 ELSE 1 END) / count(*), 6) AS success_rate
FROM log WHERE {_window(14)} AND model_id IS NOT NULL GROUP BY model_id"""

QUERIES = {
    "agg1_kpis": lambda s, d: D.kpis(log(s, d), TODAY, documents(s, d), documents(s, d).select(F.explode(F.split("text", "\n")).alias("chunk"))),
    "agg1_kpis_no_rows": lambda s, d: D.kpis(log(s, d), "2025-06-01"),
    "agg2_daily": lambda s, d: D.daily(log(s, d), TODAY).select("day", "total"),
    "agg3_daily_emergency": lambda s, d: D.daily(log(s, d), TODAY, 30),
    "agg4_model_usage": lambda s, d: D.model_usage(log(s, d), TODAY),
    "agg5_usage_histogram": lambda s, d: D.usage_histogram(log(s, d), TODAY, 5),
    "agg6_overview": lambda s, d: D.overview(log(s, d), TODAY, 14),
    "agg18_user_summary": lambda s, d: D.user_summary(events(s, d).withColumnRenamed("ts", "created_at")),
    "str5_lifetime_quota": lambda s, d: D.lifetime_quota(events(s, d), "user_id", ["ts", "event_id"], 20).select("event_id", "user_id", "allowed"),
}

SQL = {
    "agg1_kpis": f"WITH {SQL_LOG}, k AS ({_KPIS}) SELECT *, (SELECT count(*) FROM documents) AS documents, (SELECT sum(len(string_split(text, chr(10)))) FROM documents)::BIGINT AS chunks FROM k",
    "agg1_kpis_no_rows": f"WITH {SQL_LOG} {_KPIS}".replace(TODAY, "2025-06-01"),
    "agg2_daily": f"WITH {SQL_LOG} SELECT day, total FROM ({_daily(14)})",
    "agg3_daily_emergency": f"WITH {SQL_LOG} {_daily(30)}",
    "agg4_model_usage": f"WITH {SQL_LOG} {_MODELS}",
    "agg5_usage_histogram": f"WITH {SQL_LOG} {_usage(5)}",
    "agg6_overview": f"""WITH {SQL_LOG}, k AS ({_KPIS}), parts AS (
SELECT 'kpis' AS part, unnest(['total', 'rag_hits', 'fallbacks', 'emergencies', 'users']) AS name, unnest([total, rag_hits, fallbacks, emergencies, users])::DOUBLE AS value FROM k
UNION ALL SELECT 'daily', day::VARCHAR, total::DOUBLE FROM ({_daily(14)}) UNION ALL SELECT 'models', model_id, total::DOUBLE FROM ({_MODELS})
UNION ALL SELECT 'usage', bucket, users::DOUBLE FROM ({_usage(14)})) SELECT * FROM parts""",
    "agg18_user_summary": "SELECT user_id, count(*) AS n, max(ts) AS last_at FROM events GROUP BY user_id",
    "str5_lifetime_quota": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 20 AS allowed FROM events",
}

