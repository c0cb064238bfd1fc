"""The driver's tables in the roles that the operators' inputs play."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TODAY = "2024-01-30"


def table(name: str):
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


documents, events, conversations, embeddings, pages, benchmark, labels = map(table, ("documents", "events", "conversations", "embeddings", "pages", "benchmark", "labels"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as consultation logs."""
    return events(spark, sf_dir).select(
        "event_id", F.col("ts").alias("created_at"), "user_id", F.col("event_type").alias("model_id"), (F.col("event_type") == "error").alias("is_fallback"), (F.col("event_type") == "signup").alias("is_emergency"),
        F.when(F.col("event_type") == "click", 1).otherwise(0).alias("rag_hit_count"), F.col("value").alias("response_time_ms"),
    )


SQL_LOG = """log AS (SELECT event_id, ts AS created_at, user_id, event_type AS model_id, event_type = 'error' AS is_fallback, event_type = 'signup' AS is_emergency,
    CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS rag_hit_count, value AS response_time_ms FROM events)"""


def scratch(spark: SparkSession, name: str) -> str:
    """A new path that driver and executors share: in the cluster's checkpoint folder; only where that is unset on one machine, as in
    tests, in a temporary one."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidemill-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
