"""Where operators put what executors share, and filters of bounded size."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a Bloom filter: 12 a key, from 128 kB to 16 MB in all. Beyond its capacity it lets more rows through to the exact join,
#: never fewer.
BLOOM_BITS = (1 << 20, 1 << 27)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder (spark.checkpoint.dir); only where that is unset on one machine, as in tests, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        found = spark.sparkContext.getCheckpointDir()
        if found is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            found = tempfile.mkdtemp(prefix="tidemill-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: lost executors don't bring its lineage back."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def gathered(df: DataFrame, rows: int, each: int = 1 << 19) -> DataFrame:
    """df in as many partitions as `rows` of them ask for: rounds over a small state needn't write a file for each shuffle partition, and
    what is in one partition is grouped and joined with the like without a shuffle."""
    return df.coalesce(max(1, -(-rows // each)))


#: Keys that `lookup` broadcasts at most, and rows of one key below which it doesn't care.
HOT_KEYS, HOT_ROWS = 4096, 1000


def lookup(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """The inner join of left with right, which has each key once, whatever share of left one key has.

    A key with more than one in HOT_KEYS of left's rows is hot: there are HOT_KEYS at most, and their rows of right are broadcast. All
    others are joined by shuffle. left and right are read more than once and should be cut.
    """
    counts = left.groupBy(on).agg(F.count("*").alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    found = [r[0] for r in counts.where(F.col("_n") > max(HOT_ROWS, total // HOT_KEYS)).select(on).collect()]
    if not found:
        return left.join(right, on)
    hot = F.broadcast(left.sparkSession.createDataFrame([(k,) for k in found], left.select(on).schema))
    often = left.join(hot, on, "left_semi").join(F.broadcast(right.join(hot, on, "left_semi")), on)
    return often.unionByName(left.join(hot, on, "left_anti").join(right, on))


def row_key(*texts: str) -> Column:
    """A hash that tells apart rows which share an id."""
    return F.xxhash64(*[F.coalesce(F.col(t).cast("string"), F.lit("")) for t in texts])


def bloom(df: DataFrame, column: str) -> np.ndarray:
    """A filter (64-bit words) of a long column; the driver gets BLOOM_BITS / 64 words at most. df is read twice and should be cut."""
    bits = min(max(1 << (12 * df.count()).bit_length(), BLOOM_BITS[0]), BLOOM_BITS[1])
    low, high = F.col(column), F.shiftrightunsigned(F.col(column), 32)
    at = df.select(F.explode(F.array(F.pmod(low, F.lit(bits)), F.pmod(high, F.lit(bits)))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("b")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    return out


def in_bloom(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which 64-bit hashes the filter may hold."""
    bits = np.uint64(len(words) * 64 - 1)
    out = np.ones(len(h), bool)
    for at in (h & bits, (h >> np.uint64(32)) & bits):
        out &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def _maybe_in(keys: DataFrame, column: str):
    """A function of a long column: whether a Bloom filter of keys' column may hold it."""
    shared = keys.sparkSession.sparkContext.broadcast(bloom(keys, column))

    @F.pandas_udf("boolean")
    def maybe(key: pd.Series) -> pd.Series:
        return pd.Series(in_bloom(shared.value, key.to_numpy("int64").view(np.uint64)))

    return maybe


def without(docs: DataFrame, removed: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose (id, row key) isn't among those of removed (id, row).

    Only rows that pass a Bloom filter of the removed keys are shuffled for the exact join; the texts of all others stay where they
    are read. Null ids are matched as equal.
    """
    gone = cut(removed.select("id", "row").distinct().withColumn("_key", F.xxhash64("id", "row")))
    maybe = _maybe_in(gone, "_key")
    keyed = docs.withColumn("_without_row", row_key(text)).withColumn("_without_key", F.xxhash64(F.col(id_column), F.col("_without_row")))
    marked = keyed.withColumn("_without_maybe", maybe("_without_key"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    own = marked.where("_without_maybe").alias("own")
    left = own.join(gone.alias("gone"), F.col(f"own.{id_column}").eqNullSafe(F.col("gone.id")) & (F.col("own._without_row") == F.col("gone.row")), "left_anti")
    return marked.where("NOT _without_maybe").select(*columns).unionByName(left.select(*columns))


def among(docs: DataFrame, wanted: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """wanted (id, row, ...), each with the text (_among_text) of the rows of docs that have its id and row key.

    Only rows that pass a Bloom filter are shuffled, as in `without`. Null ids are matched as equal.
    """
    asked = cut(wanted.withColumn("_key", F.xxhash64("id", "row")))
    maybe = _maybe_in(asked, "_key")
    own = docs.select(F.col(id_column).alias("_among_id"), row_key(text).alias("_among_row"), F.col(text).alias("_among_text"))
    own = own.withColumn("_among_maybe", maybe(F.xxhash64("_among_id", "_among_row"))).where("_among_maybe")
    return own.join(asked, F.col("_among_id").eqNullSafe(F.col("id")) & (F.col("_among_row") == F.col("row")))
