"""Training-order materialisation: a keyed Feistel permutation gives every sequence its slot; shards of fixed stride hold them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _text
from ._spark import cut, new_path
from .packing import END_ID, tokenizer_path, word_ids

#: Ids of a sequence, sequences of a shard file.
LENGTH = 4096
SHARD = 2048
PAD_ID = 0
ROUNDS = 4
#: Bytes of an id in a shard: the vocabulary has fewer than 65,536.
WIDTH = 2


def sequences(docs: DataFrame, path: str, text: str = "text", length: int = LENGTH) -> DataFrame:
    """(task, at, n_ids, crc32, ids): the documents' ids, each followed by an end id, as one stream a task, cut into sequences of `length`
    (a task's last may be shorter). ids are little-endian 16-bit, compressed; crc32 is that of the padded sequence. Null counts as
    empty: an end id.

    No document is padded. The stream follows the table's own order within a task and tasks in turn, as `ordered` counts them: a table
    that is dealt to tasks in another way, as another cluster may do, is cut into other sequences; the same way gives the same. Ids
    that don't fit WIDTH bytes are an error.
    """
    size = WIDTH * length

    def run(batches):
        known, end, pack = word_ids(path), np.asarray([END_ID], "<u4").tobytes(), zstandard.ZstdCompressor(level=3).compress
        task, at, rest, pad = TaskContext.get().partitionId(), 0, b"", np.asarray([PAD_ID], "<u2").tobytes()

        def rows(stream: bytes, whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal at, rest
            stop = len(stream) if whole else len(stream) - len(stream) % size
            parts = [stream[i : min(i + size, stop)] for i in range(0, stop, size)]
            rest = stream[stop:]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([task] * len(parts), pa.int32()), pa.array(range(at, at + len(parts)), pa.int64()), pa.array([len(p) // WIDTH for p in parts], pa.int32()), pa.array([zlib.crc32(p + pad * ((size - len(p)) // WIDTH)) for p in parts], pa.int64()), pa.array([pack(p) for p in parts], pa.binary())], names=["task", "at", "n_ids", "crc32", "ids"])
                at += len(parts)

        for _, data, offsets in _text.text_slices(batches, "text"):
            raw = data.tobytes()
            ids = b"".join([known.of(raw[i:j]) + end for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
            wide = np.frombuffer(ids, "<u4")
            if wide.max() >= 1 << 8 * WIDTH:
                raise ValueError(f"the tokenizer gives the id {wide.max()}, which {WIDTH} bytes don't hold")
            yield from rows(rest + wide.astype("<u2").tobytes(), False)
        yield from rows(rest, True)

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "task int, at bigint, n_ids int, crc32 bigint, ids binary")


def permuted(index: Column, n: int, key: int) -> Column:
    """A keyed bijection of 0 .. n - 1: a balanced Feistel network over the least even number of bits that holds n, walked along its
    cycle until it falls below n again. Native expressions; the walk is unrolled (each step leaves at most three in four outside)."""
    half = max(1, -(-max(1, n - 1).bit_length() // 2))
    mask = (1 << half) - 1

    def once(x: Column) -> Column:
        left, right = F.shiftright(x, half), x.bitwiseAND(F.lit(mask).cast("long"))
        for r in range(ROUNDS):
            left, right = right, left.bitwiseXOR(F.xxhash64(F.lit(key).cast("long"), F.lit(r), right).bitwiseAND(F.lit(mask).cast("long")))
        return F.shiftleft(left, half).bitwiseOR(right)

    # walk within a higher-order function, so that the expression is as small as one network
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        F.struct(index.cast("long").alias("x"), F.lit(False).alias("done")),
        lambda a, _: F.when(a["done"], a).otherwise(F.struct(once(a["x"]).alias("x"), (once(a["x"]) < n).alias("done"))),
        lambda a: F.when(a["done"], a["x"]).otherwise(F.raise_error(F.lit("the cycle is longer than WALK")).cast("long")),
    )
    return walk


#: Steps of a cycle walk: the chance that one lasts longer is below 0.75 ** 256.
WALK = 256


def ordered(cut_sequences: DataFrame, key: int) -> tuple[DataFrame, int]:
    """cut_sequences with `sequence`, a dense number by task and place, and `slot`, that number permuted under the key; and how many
    there are. Only the tasks' counts are added up, one row a task; sequences stay where they are."""
    sizes = cut(cut_sequences.groupBy("task").agg(F.count("*").alias("_n")))
    before = sizes.select("task", (F.sum("_n").over(Window.orderBy("task")) - F.col("_n")).alias("_before"))
    n = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return cut_sequences.join(F.broadcast(before), "task").withColumn("sequence", F.col("_before") + F.col("at")).withColumn("slot", permuted(F.col("sequence"), max(1, n), key)).drop("_before"), n


#: Shards of a task that writes them, at most.
TASK_SHARDS = 16


def lines(slotted: DataFrame, n: int, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """(shard, value) of n slots, as they are written: padded ids, dealt to tasks by ranges of whole shards and sorted by slot.

    Slots are dense, so ranges are known without sampling. Rows are opened first and sorted last: the write finds them in the order
    that it needs, by shard, and doesn't sort again, which could mix the slots of a shard.
    """
    size, pad = WIDTH * length, np.asarray([PAD_ID], "<u2").tobytes()

    def opened(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [unpack(x.as_py(), max_output_size=size) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x + pad * ((size - len(x)) // WIDTH) for x in ids], pa.binary())], names=["shard", "slot", "value"])

    shards = max(1, -(-n // shard))
    tasks = min(shards, max(int(slotted.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shards // TASK_SHARDS)))
    numbered = slotted.select(F.floor(F.col("slot") / shard).cast("long").alias("shard"), "slot", "ids")
    dealt = numbered.repartitionById(tasks, F.floor(F.col("shard") * tasks / shards).cast("int"))
    sorted_lines = dealt.mapInArrow(opened, "shard bigint, slot bigint, value binary").sortWithinPartitions("shard", "slot")
    return sorted_lines.select("shard", F.col("value").cast("string").alias("value"))


def write(slotted: DataFrame, n: int, path: str, length: int = LENGTH, shard: int = SHARD) -> None:
    """Writes the shards of n slots under path/shard=<number>: a file holds its slots in order, each WIDTH * length bytes of ids
    (padded) and one separator byte, which Spark's text sink adds. Its commits leave nothing of a lost task behind."""
    lines(slotted, n, length, shard).write.partitionBy("shard").option("lineSep", "\n").text(path)


def read(spark: SparkSession, path: str, length: int = LENGTH, shard: int = SHARD, from_slot: int = 0) -> DataFrame:
    """(slot, ids_crc32) of every sequence from from_slot on; a shard below it isn't opened, as strides are fixed."""
    size = WIDTH * length

    def run(batches):
        for batch in batches:
            for s, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = memoryview(content.as_buffer())
                at = range(max(0, from_slot - s * shard) * (size + 1), len(raw), size + 1)
                yield pa.RecordBatch.from_arrays([pa.array([s * shard + x // (size + 1) for x in at], pa.int64()), pa.array([zlib.crc32(raw[x : x + size]) for x in at], pa.int64())], names=["slot", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")
    return files.select(F.col("shard").cast("long").alias("shard"), "content").where(F.col("shard") >= from_slot // shard).mapInArrow(run, "slot bigint, ids_crc32 bigint")


def report(docs: DataFrame, key: int = 20_240_601, path: str | None = None, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """Writes all documents' sequences in training order into the shared folder and reads the shards back: sequence, n_ids, slot,
    shard, place (in its shard), ids_crc32 (of the padded sequence, as read back; that another was written is an error).

    Null and empty texts are an end id; repeated rows are repeated in the stream; an empty table writes nothing.
    """
    spark = docs.sparkSession
    slotted, n = ordered(cut(sequences(docs, tokenizer_path(), length=length)), key)
    small = slotted.select("sequence", "n_ids", "slot", F.floor(F.col("slot") / shard).cast("long").alias("shard"), (F.col("slot") % shard).alias("place"), "crc32")
    if not n:
        return small.withColumnRenamed("crc32", "ids_crc32")
    path = path or new_path(spark, "shards")
    write(slotted, n, path, length, shard)
    checked = F.when(F.col("ids_crc32") == F.col("crc32"), F.col("ids_crc32")).otherwise(F.raise_error(F.concat(F.lit("another sequence was read back from slot "), F.col("slot").cast("string"))).cast("long"))
    return small.join(read(spark, path, length, shard), "slot").select("sequence", "n_ids", "slot", "shard", "place", checked.alias("ids_crc32"))
