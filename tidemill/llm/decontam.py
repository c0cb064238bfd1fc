"""Benchmark decontamination by winnowing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _text
from ._spark import bloom, cut, in_bloom, lookup, row_key, without

#: Words of a shared span that are always found, and words of a gram. A window of SPAN words has SPAN - GRAM + 1 grams.
SPAN = 10
GRAM = 5

_WINDOWS = "array<struct<start:int,size:int,w:bigint,h:bigint>>"


def _windows(h: np.ndarray, text: np.ndarray, span: int, gram: int, filter_words: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where windows of `span` words of one text begin, their hashes and their fingerprints, the least gram hash of each (winnowing).
    With a filter only those whose fingerprint passes."""
    if len(h) < span:
        return (np.zeros(0, np.int64), *(np.zeros(0, np.uint64),) * 2)
    g, n = _text.gram_hashes(h, gram), len(h) - span + 1
    least = g[:n].copy()
    for i in range(1, span - gram + 1):
        np.minimum(least, g[i : i + n], out=least)
    same = text[:n] == text[span - 1 :]
    if filter_words is None:
        start = np.flatnonzero(same)
    else:
        # neighbouring windows mostly share their fingerprint: it is looked up where it changes
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        start = np.flatnonzero(np.repeat(in_bloom(filter_words, least[first]), np.diff(np.append(first, n))) & same)
    return start, _text.gram_hashes(h, span)[start] if len(start) else np.zeros(0, np.uint64), least[start]


def _found(df: DataFrame, keys: list[str], span: int, gram: int, short: list[int], shared, item: bool) -> DataFrame:
    """keys, n_words and the windows c of each text: those of `span` words, and runs of the lengths in `short`; an item's only where
    it has no more words. `shared` is a filter of fingerprints; a run's fingerprint is its own hash."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    kind = pa.struct([("start", pa.int32()), ("size", pa.int32()), ("w", pa.int64()), ("h", pa.int64())])

    def run(batches):
        filter_words = shared.value if shared is not None else None
        for rows, data, offsets in _text.text_slices(batches, "text"):
            low = _text.LOWER[data]
            starts, ends, first = _text.word_spans(low, offsets, _text.WORD)
            h, count = _text.span_hashes(low, starts, ends), np.diff(first)
            text = np.repeat(np.arange(rows.num_rows), count)
            start, w, own = _windows(h, text, span, gram, filter_words)
            found = [(start, np.full(len(start), span), w, own)]
            for size in short:
                g = _text.gram_hashes(h, size)
                with np.errstate(over="ignore"):
                    g = _text.mixed(g + np.uint64(size))
                ok = text[: len(g)] == text[size - 1 :] if len(g) else np.zeros(0, bool)
                if item:
                    ok &= count[text[: len(g)]] == size
                start = np.flatnonzero(ok & in_bloom(filter_words, g)) if filter_words is not None else np.flatnonzero(ok)
                found.append((start, np.full(len(start), size), g[start], g[start]))
            start, size, w, own = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(start, kind="stable")
            start, size, w, own = start[order], size[order], w[order], own[order]
            of = text[start]
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(rows.num_rows + 1)), pa.int32()), pa.StructArray.from_arrays(
                [pa.array((start - first[of]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(w.view(np.int64)), pa.array(own.view(np.int64))], fields=list(kind)))
            yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(k)) for k in keys), pa.array(count, pa.int64()), lists], names=[*keys, "n_words", "c"])

    return df.select(*keys, "text").mapInArrow(run, f"{kinds}, n_words bigint, c {_WINDOWS}")


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, found, windows): rows has (id, row, n_words) of every document; found has (id, row, start, size, w), every occurrence of an
    item's window in a document; windows has (w, item_id) of the items.

    Winnowing keeps the least gram hash of each window of `span` words, so equal windows have equal fingerprints. Documents' windows
    whose fingerprint passes a filter made of the items' are joined with the items' distinct windows by fingerprint and by the window
    itself: each meets one row at most, however many items or documents share it. Items shorter than `span` are one window, looked up
    among all runs of their length. 64-bit hashes stand for words.
    """
    spark = docs.sparkSession
    source = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    theirs = cut(_found(source, ["item_id"], span, gram, list(range(1, span)), None, True).select("item_id", F.explode("c").alias("c")).select("item_id", "c.size", "c.w", "c.h").distinct())
    distinct = cut(theirs.select("w", F.col("h").alias("item_h"), "size").distinct())
    short = sorted(r[0] for r in distinct.where(F.col("size") < span).select("size").distinct().collect())
    shared = spark.sparkContext.broadcast(bloom(distinct, "item_h"))
    wanted = docs.select(F.col(doc_id).alias("id"), row_key(text).alias("row"), F.col(text).alias("text"))
    own = cut(_found(wanted, ["id", "row"], span, gram, short, shared, False))
    mine = cut(own.where("size(c) > 0").select("id", "row", F.explode("c").alias("c")).select("id", "row", "c.*").distinct())
    found = lookup(mine, distinct.select("w", "item_h", F.col("size").alias("_size")), "w").where("h = item_h AND size = _size")
    return own.select("id", "row", "n_words"), found.select("id", "row", "start", "size", "w"), theirs.select("w", "item_id")


def _in_turn():
    return Window.partitionBy("id", "row").orderBy("start", "stop")


def _reached(found: DataFrame) -> DataFrame:
    """found with each occurrence's stop and how far those before it in its document reach."""
    return found.withColumn("stop", F.col("start") + F.col("size")).withColumn("before", F.coalesce(F.max("stop").over(_in_turn().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def spans(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """(id, row, start, stop) of the maximal runs of words of documents that items' windows cover: hits extended as far as they go."""
    marked = _reached(matches(docs, items, **names)[1]).withColumn("run", F.sum(F.when(F.col("start") > F.col("before"), 1).otherwise(0)).over(_in_turn()))
    return marked.groupBy("id", "row", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs without a window of any item, with the columns of docs. Null and empty texts stay; rows that repeat share
    their fate; without items, or items with words, all stay; an empty table gives an empty one."""
    return without(docs, matches(docs, items)[1])


def _listed(found: DataFrame, windows: DataFrame) -> DataFrame:
    """(id, row, n_items, items_sha256) of the documents that hold windows of items with an id.

    Windows of the same items, and then documents with the same windows' items, are told by sums of hashes, and items are listed once
    for each such kind of document: a passage that many items and many documents share makes no row for each of both.
    """

    def kind(*c):  # of a set, whatever the order
        return F.struct(F.count("*").alias("n"), F.sum(F.xxhash64(*c) % (1 << 40)).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), *c)).alias("y"))

    named = cut(windows.where("item_id IS NOT NULL").select("w", F.col("item_id").cast("string").alias("item")).distinct())
    sets = named.groupBy("w").agg(kind("item").alias("items"))
    one = cut(sets.groupBy("items").agg(F.min("w").alias("w1")))
    held = cut(lookup(cut(found.select("id", "row", "w").distinct()), cut(sets), "w").select("id", "row", "items").distinct())
    docs = held.groupBy("id", "row").agg(kind("items.n", "items.x", "items.y").alias("all"))
    first = docs.groupBy("all").agg(F.min(F.struct("id", "row")).alias("d")).select("all", "d.*")
    same = first["id"].eqNullSafe(held["id"]) & (first["row"] == held["row"])
    listed = held.join(first, same).select("all", "items").join(one, "items").select("all", F.col("w1").alias("w")).join(named, "w").select("all", "item").distinct()
    told = listed.groupBy("all").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    return docs.join(told, "all").select("id", "row", "n_items", "items_sha256")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words; an item without words, or with a null text, never occurs. An item with a null id marks words
    but isn't listed or counted. Rows that repeat a document each get its result. Empty tables: no rows, or no hits.
    """
    rows, found, windows = matches(docs, items)
    found = cut(found)
    hits = _reached(found).groupBy("id", "row").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "before"))).alias("n_hit"))
    listed = _listed(found, windows).withColumnsRenamed({"id": "l_id", "row": "l_row"})
    marked = hits.join(listed, F.col("id").eqNullSafe(F.col("l_id")) & (F.col("row") == F.col("l_row")), "left").select(F.col("id").alias("hit_id"), F.col("row").alias("hit_row"), "n_hit", "n_items", "items_sha256")
    joined = rows.join(marked, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("row") == F.col("hit_row")), "left")
    return joined.select(
        F.col("id").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
