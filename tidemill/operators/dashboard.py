"""Consultation-log analytics: KPIs, daily series, model usage, usage histogram, quotas.

A log has created_at (timestamp), user_id, model_id, is_fallback, is_emergency, rag_hit_count, response_time_ms. Today is a parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Least and most days of a series, and its default; usage buckets with their least and most.
DAYS = (1, 90, 14)
BUCKETS = (("1-5", 1, 5), ("6-10", 6, 10), ("11-20", 11, 20), ("21+", 21, None))


def clamp_days(days: int | None) -> int:
    return DAYS[2] if days is None else min(max(days, DAYS[0]), DAYS[1])


def window_of(log: DataFrame, today: str, days: int) -> DataFrame:
    """Rows of the last `days` days; the comparison is on the raw timestamp, so that file statistics prune."""
    end = F.lit(today).cast("date")
    return log.where((F.col("created_at") >= F.date_sub(end, clamp_days(days) - 1).cast("timestamp")) & (F.col("created_at") < F.date_add(end, 1).cast("timestamp")))


def _rate(part, whole):
    return F.round(part / F.nullif(whole, F.lit(0)), 6)


def kpis(log: DataFrame, today: str, documents: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """One row for today: total, rag_hits, fallbacks, emergencies, users, their rates (null without rows), mean response time; with a
    store's documents and chunks also how many it holds."""
    own = window_of(log, today, 1)
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    one = own.agg(
        F.count("*").alias("total"), count(F.col("rag_hit_count") > 0).alias("rag_hits"), count(F.col("is_fallback")).alias("fallbacks"), count(F.col("is_emergency")).alias("emergencies"),
        F.countDistinct("user_id").alias("users"), F.round(F.avg("response_time_ms"), 6).alias("avg_response_ms"),
    )
    for name, held in (("documents", documents), ("chunks", chunks)):
        if held is not None:
            one = one.crossJoin(held.agg(F.count("*").alias(name)))  # one row and one row
    return one.withColumns({"rag_hit_rate": _rate(F.col("rag_hits"), F.col("total")), "fallback_rate": _rate(F.col("fallbacks"), F.col("total"))})


def daily(log: DataFrame, today: str, days: int | None = None) -> DataFrame:
    """(day, total, emergencies) of every one of the last days, zeros included: one pass and a calendar of `days` rows."""
    days = clamp_days(days)
    counted = window_of(log, today, days).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("total"), F.sum(F.when(F.col("is_emergency"), 1).otherwise(0)).alias("emergencies"))
    end = F.lit(today).cast("date")
    calendar = log.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    return calendar.join(counted, "day", "left").select("day", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("emergencies", F.lit(0)).cast("long").alias("emergencies"))


def model_usage(log: DataFrame, today: str, days: int | None = None) -> DataFrame:
    own = window_of(log, today, clamp_days(days)).where("model_id IS NOT NULL")
    out = own.groupBy("model_id").agg(F.count("*").alias("total"), F.sum(F.when(F.col("is_fallback"), 0).otherwise(1)).cast("long").alias("succeeded"))
    return out.withColumn("success_rate", F.when(F.col("total") == 0, 0.0).otherwise(F.round(F.col("succeeded") / F.col("total"), 6))).orderBy(F.desc("total"), "model_id")


def usage_histogram(log: DataFrame, today: str, days: int | None = None) -> DataFrame:
    """(bucket, users) with empty buckets; user ids stay inside."""
    own = window_of(log, today, clamp_days(days)).where("user_id IS NOT NULL").groupBy("user_id").count()
    bucket = F.lit(None).cast("string")
    for name, low, high in reversed(BUCKETS):
        bucket = F.when((F.col("count") >= low) & (F.lit(high is None) | (F.col("count") <= F.lit(high))), name).otherwise(bucket)
    names = log.sparkSession.createDataFrame([(i, b[0]) for i, b in enumerate(BUCKETS)], "place int, bucket string")
    return names.join(own.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("users")), "bucket", "left").select("bucket", F.coalesce("users", F.lit(0)).cast("long").alias("users"))


def overview(log: DataFrame, today: str, days: int | None = None) -> DataFrame:
    """(part, name, value): today's KPIs, the daily series, model usage and the usage histogram, zeros included, from one scan.

    Every row counts in three grouping sets, its day, its model and its user; users are then counted by how much they used. Both
    levels combine counts before they shuffle, so a hot day, model or user is one row a task.
    """
    days = clamp_days(days)
    end = F.lit(today).cast("date")
    now = F.to_date("created_at") == end
    shaped = window_of(log, today, days).select(
        F.to_date("created_at").alias("day"), "model_id", "user_id", now.cast("int").alias("now"), (now & F.coalesce(F.col("rag_hit_count") > 0, F.lit(False))).cast("int").alias("rag"),
        (now & F.coalesce("is_fallback", F.lit(False))).cast("int").alias("fallback"), (now & F.coalesce("is_emergency", F.lit(False))).cast("int").alias("emergency"),
    )
    sets = shaped.groupingSets([["day"], ["model_id"], ["user_id"]], "day", "model_id", "user_id").agg(
        F.grouping_id().alias("of"), F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("now", "rag", "fallback", "emergency")]
    )
    row = lambda part, name, value: F.struct(F.lit(part).alias("part"), name.cast("string").alias("name"), value.cast("double").alias("value"))
    kpi = [row("kpis", F.lit(k), F.col(c)) for k, c in (("total", "now"), ("rag_hits", "rag"), ("fallbacks", "fallback"), ("emergencies", "emergency"))]
    bucket = F.lit(None).cast("string")
    for name, low, high in reversed(BUCKETS):
        bucket = F.when((F.col("n") >= low) & (F.lit(high is None) | (F.col("n") <= F.lit(high))), name).otherwise(bucket)
    of_user = F.array(row("usage", bucket, F.lit(1)), row("kpis", F.lit("users"), (F.col("now") > 0).cast("int")))
    # bits of grouping_id: 1 where a column isn't of the set, the first column's bit the highest
    told = F.when(F.col("of") == 0b011, F.array(row("daily", F.col("day"), F.col("n")), *kpi)).when((F.col("of") == 0b101) & F.col("model_id").isNotNull(), F.array(row("models", F.col("model_id"), F.col("n"))))
    told = told.when((F.col("of") == 0b110) & F.col("user_id").isNotNull(), of_user)
    zeros = [("kpis", k, 0.0) for k in ("total", "rag_hits", "fallbacks", "emergencies", "users")] + [("usage", b[0], 0.0) for b in BUCKETS]
    calendar = log.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day")).select(F.lit("daily").alias("part"), F.col("day").cast("string").alias("name"), F.lit(0.0).alias("value"))
    every = sets.select(F.explode(told).alias("r")).select("r.*").unionByName(log.sparkSession.createDataFrame(zeros, "part string, name string, value double")).unionByName(calendar)
    return every.groupBy("part", "name").agg(F.sum("value").alias("value"))


def lifetime_quota(events: DataFrame, key: str, order: list[str], limit: int) -> DataFrame:
    """events with `allowed`: whether fewer than `limit` of its key's events came before.

    Only a key's limit-th event matters: each task passes on the first `limit` events of a key that it has (Spark limits groups before
    their shuffle), and all events are compared with where the limit falls. A key that very many events share is never gathered.
    `order` names each event of a key once; events without a key are a key of their own.
    """
    placed = events.withColumn("_order", F.struct(*order))
    first = placed.select(key, "_order").withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_order"))).where(F.col("_n") <= limit)
    last = first.groupBy(F.col(key).alias("_key")).agg(F.max(F.when(F.col("_n") == limit, F.col("_order"))).alias("_last"))
    met = placed.join(last, F.col(key).eqNullSafe(F.col("_key")), "left")
    return met.withColumn("allowed", F.lit(limit > 0) & (F.col("_last").isNull() | (F.col("_order") <= F.col("_last")))).select(*events.columns, "allowed")


def quota_used(events: DataFrame, key: str) -> DataFrame:
    """(key, used) of events that were made before a stream of them begins: the state it starts from."""
    return events.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("used"))


def user_summary(conversations: DataFrame) -> DataFrame:
    return conversations.groupBy("user_id").agg(F.count("*").alias("n"), F.max("created_at").alias("last_at"))
