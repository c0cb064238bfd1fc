"""Streaming twins of batch operators: ingestion, deduplication, request throttling, daily counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemill.functions import text as X
from tidemill.operators import ingest
from tidemill.sources.stores import HashIndex, Store


def ingest_stream(stream: DataFrame, store: Store, index: HashIndex, checkpoint: str, most_tokens: int = ingest.MAX_TOKENS, overlap: int = ingest.OVERLAP_TOKENS) -> StreamingQuery:
    """Rows (document_key, content, source, priority, idx) cleaned, deduplicated against the index and stored documents, chunked and
    published batch by batch. A batch that is run again after a failure is written anew, or, if it had been completed, only adds its hashes to the index.
    """

    def each(batch: DataFrame, number: int) -> None:
        stored = store.visible("documents")
        fresh = batch if stored is None else ingest.split_existing(batch, stored)[0]
        kept = ingest.unseen(ingest.ingest(fresh).where("status = 'kept'"), index.read()).select("document_key", "source", "cleaned", "content_hash").persist()
        try:
            chunks = ingest.chunk_documents(kept, "document_key", "cleaned", most_tokens, overlap).withColumnRenamed("id", "document_key")
            name = f"stream-{number}"
            if store.states().where((F.col("batch") == name) & (F.col("state") == "completed")).isEmpty():
                store.write(name, {"documents": kept, "chunks": chunks})
            # from what is stored: the plan of `kept` reads the store and would now find its documents there
            index.append(store.visible("documents").where(F.col("batch") == name))
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_stream(stream: DataFrame, content: str = "content", time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first row of each content; with a time column, hashes are forgotten after `delay`, else the state grows with the stream."""
    hashed = stream.withColumn("content_hash", X.content_hash(F.col(content)))
    if time is None:
        return hashed.dropDuplicates(["content_hash"])
    return hashed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_hash"])


def daily_stream(log: DataFrame, delay: str = "1 day") -> DataFrame:
    """(day, total, emergencies) of created_at, kept current; rows later than `delay` are dropped with the watermark."""
    counted = log.withWatermark("created_at", delay).groupBy(F.window("created_at", "1 day").alias("w"))
    return counted.agg(F.count("*").alias("total"), F.sum(F.when(F.col("is_emergency"), 1).otherwise(0)).alias("emergencies")).select(F.to_date("w.start").alias("day"), "total", "emergencies")


# A key's window opens with its first event. An event more than `window` later opens a new one; the limit's last allowed event within it
# is the last that counts.

THROTTLED = "event_id long, key string, ts timestamp, allowed boolean"


def _step(started, count: int, at, window: pd.Timedelta, limit: int):
    """(started, count, allowed) after an event."""
    if started is None or started < at - window:
        return at, 1, True
    return started, min(count + 1, limit), count < limit


def throttle(events: DataFrame, limit: int, hours: int) -> DataFrame:
    """(event_id, key, ts, allowed) of events (event_id, key, ts), each key's in time order.

    Whether an event opens a window depends on the window before it, so a key's events are walked once, sorted by Spark and streamed
    through the task; a key that many events share is never held as a group.
    """
    window = pd.Timedelta(hours=hours)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, started, count = None, None, 0
        for rows in batches:
            allowed = []
            for k, at in zip(rows["key"], rows["ts"]):
                if k != key:
                    key, started, count = k, None, 0
                started, count, ok = _step(started, count, at, window, limit)
                allowed.append(ok)
            yield rows.assign(allowed=allowed)

    return events.select("event_id", F.col("key").cast("string").alias("key"), "ts").repartition("key").sortWithinPartitions("key", "ts", "event_id").mapInPandas(walk, THROTTLED)


class Throttle(StatefulProcessor):
    """The same rule over keyed state: the window's start and its count."""

    def __init__(self, limit: int, hours: int):
        self.limit, self.window = limit, pd.Timedelta(hours=hours)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "started timestamp, count int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        held = self.state.get() if self.state.exists() else (None, 0)
        started, count, allowed = pd.Timestamp(held[0]) if held[0] is not None else None, held[1], []
        for at in events["ts"]:
            started, count, ok = _step(started, count, at, self.window, self.limit)
            allowed.append(ok)
        self.state.update((started.to_pydatetime(), int(count)))
        yield events.assign(allowed=allowed, key=str(key[0]))[["event_id", "key", "ts", "allowed"]]

    def close(self) -> None:
        pass


def throttle_stream(events: DataFrame, limit: int, hours: int) -> DataFrame:
    """Needs the RocksDB state store (`use_rocksdb`)."""
    keyed = events.select("event_id", F.col("key").cast("string").alias("key"), "ts").groupBy("key")
    return keyed.transformWithStateInPandas(Throttle(limit, hours), THROTTLED, "append", "none")


QUOTED = "event_id long, key string, allowed boolean"


class Quota(StatefulProcessor):
    """Events of a key are allowed until `limit` of them have been; the state is how many have come."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("used", "used long")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self.state.update((int(initialState["used"].sum()),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        used = self.state.get()[0] if self.state.exists() else 0
        self.state.update((used + len(events),))
        allowed = [used + i < self.limit for i in range(len(events))]
        yield pd.DataFrame({"event_id": events["event_id"], "key": str(key[0]), "allowed": allowed})

    def close(self) -> None:
        pass


def quota_stream(events: DataFrame, limit: int, used: DataFrame | None = None) -> DataFrame:
    """(event_id, key, allowed) of a stream (event_id, key, ts), by keyed state that begins with `used` (key, used), what the batch
    history has counted (`dashboard.quota_used`). The state is one number a key. Needs the RocksDB state store (`use_rocksdb`)."""
    keyed = events.select("event_id", F.col("key").cast("string").alias("key"), "ts").groupBy("key")
    begun = used.select(F.col("key").cast("string").alias("key"), F.col("used").cast("long").alias("used")).groupBy("key") if used is not None else None
    return keyed.transformWithStateInPandas(Quota(limit), QUOTED, "append", "none", begun)


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
