"""Sinks: stage outputs, the document, chunk and embedding store with atomic publication, the committed-hash index.

A store is a folder with Parquet tables `documents`, `chunks`, `embeddings` (by provider), each partitioned by batch and attempt, and a
`batches` table of one row a state change, which names the attempt. Readers see the rows of the attempt whose completion is its batch's
last state; nothing is visible before that row is written, and that write is one job's commit. A batch may be written again under its
name, after a failure too: what an earlier attempt has left is never seen.

A batch may also replace documents. It then names them in a table `versions`, by table, whether it holds rows of them or not: of these
documents readers see what that batch and later ones hold, and nothing older, so a document may come to have no chunk. Embeddings are
replaced with the chunks that they were made of.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException, PySparkException

from tidemill.functions import text as X

TABLES = ("documents", "chunks", "embeddings")
#: Tables whose rows go when their document is replaced, whatever the new batch holds.
REPLACED = ("chunks", "embeddings")
STATES = "batch string, attempt string, state string, at timestamp, note string"


def write_stages(stages: dict[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """raw, processed, chunks, embeddings, ...: each under its name, by source."""
    for name, df in stages.items():
        df.write.mode("overwrite").partitionBy("source").format(kind).save(f"{path}/{name}")


class Store:
    def __init__(self, spark: SparkSession, path: str, key: str = "document_key"):
        self.spark, self.path, self.key = spark, path, key

    def _mark(self, batch: str, attempt: str, state: str, note: str | None = None) -> None:
        row = self.spark.createDataFrame([(batch, attempt, state, note)], "batch string, attempt string, state string, note string").withColumn("at", F.current_timestamp())
        row.select("batch", "attempt", "state", "at", "note").coalesce(1).write.mode("append").parquet(f"{self.path}/batches")

    def _read(self, table: str, schema: str | None = None) -> DataFrame | None:
        try:
            df = self.spark.read.schema(schema) if schema else self.spark.read
            return df.parquet(f"{self.path}/{table}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def states(self) -> DataFrame:
        found = self._read("batches", STATES)
        if found is None:
            return self.spark.createDataFrame([], STATES)
        return found.groupBy("batch").agg(F.max_by(F.struct("attempt", "state", "at", "note"), F.struct("at", F.col("state") != "processing")).alias("s")).select("batch", "s.*")

    def write(self, batch: str, tables: dict[str, DataFrame], replaced: DataFrame | None = None) -> None:
        """Stages all tables of a batch, then publishes it; an error leaves the batch aborted and invisible, and is raised. `replaced`
        holds the keys of documents of which older batches' chunks and embeddings, and any other table that the batch has, are no
        longer seen."""
        attempt = uuid.uuid4().hex
        self._mark(batch, attempt, "processing")
        try:
            if replaced is not None:
                of = F.explode(F.array(*map(F.lit, sorted({*REPLACED, *tables})))).alias("of")
                tables = tables | {"versions": replaced.select(F.col(self.key).cast("string").alias("replaced")).distinct().select("replaced", of)}
            for name, df in tables.items():
                by = ["batch", "attempt", *(["provider"] if name == "embeddings" else [])]
                df.withColumns({"batch": F.lit(batch), "attempt": F.lit(attempt)}).write.mode("append").partitionBy(*by).parquet(f"{self.path}/{name}")
        except Exception as e:
            self._mark(batch, attempt, "aborted", str(e)[:500])
            raise
        self._mark(batch, attempt, "completed")

    def _published(self, table: str, schema: str | None = None) -> DataFrame | None:
        """The rows of completed attempts, by a join with their states that prunes partitions, with the completion's time `_at`."""
        df = self._read(table, schema)
        if df is None:
            return None
        done = self.states().where("state = 'completed'").select("batch", "attempt", F.col("at").alias("_at"))
        return df.withColumns({c: F.col(c).cast("string") for c in ("batch", "attempt")}).join(done, ["batch", "attempt"]).drop("attempt")

    def visible(self, table: str) -> DataFrame | None:
        """What readers see of a table: the rows of completed batches, without those of documents that a later batch has replaced."""
        df = self._published(table)
        if df is None:
            return None
        versions = self._published("versions", "replaced string, of string, batch string, attempt string") if self.key in df.columns else None
        if versions is not None:
            newest = versions.where(F.col("of") == table).groupBy("replaced").agg(F.max(F.struct("_at", "batch")).alias("_newest"))
            of = df.join(newest, F.col(self.key).cast("string") == F.col("replaced"), "left")
            df = of.where(F.col("_newest").isNull() | (F.struct("_at", "batch") >= F.col("_newest"))).drop("replaced", "_newest")
        return df.drop("_at")

    def write_batches(self, batches: Iterable[tuple[str, Callable[[], dict[str, DataFrame]]]], keys: Callable[[str], DataFrame]) -> None:
        """Batches one by one: those that fail leave their documents' keys in `errors`, and later ones go on."""
        for batch, make in batches:
            try:
                self.write(batch, make())
            except (PySparkException, Py4JJavaError, RuntimeError, ValueError) as e:
                keys(batch).select(F.col("document_key"), F.lit(batch).alias("batch"), F.lit(str(e)[:500]).alias("error")).write.mode("append").parquet(f"{self.path}/errors")

    def replace_document(self, batch: str, chunks: DataFrame, embeddings: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
        """Writes documents' new chunks (and their embeddings) as a batch that replaces them, and gives the chunks that readers then
        see. `keys` names the documents, those that now have no chunk too; by default those of the chunks. Other documents keep theirs."""
        tables = {"chunks": chunks} | ({} if embeddings is None else {"embeddings": embeddings})
        self.write(batch, tables, chunks if keys is None else keys)
        return self.visible("chunks")


class HashIndex:
    """Content hashes of committed records; a missing folder is an empty index."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema("content_hash string").parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], "content_hash string")
            raise

    def append(self, committed: DataFrame) -> None:
        """Adds hashes after their records' sink has succeeded, never before; those already there aren't written again."""
        committed.select("content_hash").distinct().join(self.read(), "content_hash", "left_anti").write.mode("append").parquet(self.path)


def hash_of(content: str):
    return X.content_hash(F.col(content))
