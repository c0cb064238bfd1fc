"""STR1-STR4 by their batch twins over events and documents, and the ingestion and daily streams themselves."""

import uuid

from pyspark.sql import functions as F

from tidemill.functions import text as X
from tidemill.operators import ingest as I
from tidemill.plans.q_ingest import _REASON, _records
from tidemill.plans.tables import SQL_LOG, events, scratch
from tidemill.sources.stores import HashIndex, Store
from tidemill.streaming import jobs as J


def _daily_stream(s, d):
    source = s.readStream.schema(events(s, d).schema).option("pathGlobFilter", "events.parquet").parquet(d)
    shaped = source.select(F.col("ts").cast("timestamp").alias("created_at"), (F.col("event_type") == "signup").alias("is_emergency"))
    name = f"daily_{uuid.uuid4().hex}"
    query = J.daily_stream(shaped).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return s.table(name)  # a row a day


def _ingest_stream(s, d):
    """The stream itself: records arrive priority by priority; after each arrival it runs, stops, and is started anew from its checkpoint."""
    base = scratch(s, "ingest-stream")
    records = _records(s, d)
    store, index = Store(s, f"{base}/store"), HashIndex(s, f"{base}/index")
    for priority in sorted(r[0] for r in records.select("priority").distinct().collect()):  # four at most
        records.where(F.col("priority") == priority).write.mode("append").parquet(f"{base}/in")
        J.ingest_stream(s.readStream.schema(records.schema).parquet(f"{base}/in"), store, index, f"{base}/checkpoint").awaitTermination()
    return store.visible("documents").select("document_key", "content_hash")


def _throttle(s, d):
    return J.throttle(events(s, d).select("event_id", F.col("user_id").alias("key"), "ts"), 3, 48).select("event_id", "allowed")


QUERIES = {
    "str1_ingest_twin": lambda s, d: I.ingest(_records(s, d)).where("status = 'kept'").select("document_key", "content_hash"),
    "str1_ingest_stream": _ingest_stream,
    "str2_dedup_twin": lambda s, d: _records(s, d).select(X.content_hash(F.col("content")).alias("content_hash")).dropDuplicates(),
    "str3_throttle": _throttle,
    "str4_daily_stream": _daily_stream,
}

_TRIM = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
SQL = {
    "str1_ingest_twin": rf"""WITH j AS (SELECT doc_id, source, regexp_extract(source, '(\d+)$', 1)::INT % 4 + 1 AS p, sha256({_TRIM}) AS h FROM documents WHERE ({_REASON}) IS NULL)
SELECT 'hf-dataset://' || source || '/' || doc_id AS document_key, h AS content_hash FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY p, doc_id) AS n FROM j) WHERE n = 1""",
    "str2_dedup_twin": f"SELECT DISTINCT sha256({_TRIM}) AS content_hash FROM documents",
    "str3_throttle": """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT event_id, user_id, ts, n, ts AS started, 1 AS c, true AS allowed FROM e WHERE n = 1
UNION ALL SELECT e.event_id, e.user_id, e.ts, e.n, CASE WHEN w.started < e.ts - INTERVAL 48 HOURS THEN e.ts ELSE w.started END, CASE WHEN w.started < e.ts - INTERVAL 48 HOURS THEN 1 ELSE least(w.c + 1, 3) END,
w.started < e.ts - INTERVAL 48 HOURS OR w.c < 3 FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1) SELECT event_id, allowed FROM w""",
    "str4_daily_stream": f"WITH {SQL_LOG} SELECT created_at::DATE AS day, count(*) AS total, sum(is_emergency::INT)::BIGINT AS emergencies FROM log GROUP BY 1",
}
SQL["str1_ingest_stream"] = SQL["str1_ingest_twin"]
