"""Quality classifier: supervised subword embeddings, averaged per document, trained by stochastic gradient descent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import row_key

#: Rows of vectors, their width, and the character n-grams of a word (the last may hold its end).
BUCKETS = 1 << 17
WIDTH = 16
GRAMS = (3, 4)
#: Labelled documents that training takes, those of least hashed id; half of them of each label where there are enough.
SAMPLE_DOCS = 4_000
EPOCHS = 6
RATE = 0.5
SEED = 7

#: The features of a repeated word, and how often one counts (a word has some ten features besides).
AGAIN, AGAIN_TIMES = 0x5EED, 3

_CLOSE = 0xFF  # a byte that UTF-8 never holds stands for a word's end


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of whole texts and the text of each, in blocks: each word, and each character n-gram of the marked word."""
    mask = np.uint64(BUCKETS - 1)
    starts, ends, first = _text.word_spans(data, offsets, _text.NOT_SPACE)
    words = _text.span_hashes(data, starts, ends)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    yield (words & mask).astype(np.int32), text
    # a word that its text had one, or two to four, words before is also the token "again": repetition is no word's own trait
    for near in ((1,), (2, 3, 4)):
        again = np.zeros(len(words), bool)
        for k in near:
            again[k:] |= (words[k:] == words[:-k]) & (text[k:] == text[:-k])
        of = np.repeat(text[again], AGAIN_TIMES)
        yield np.full(len(of), (AGAIN + near[0]) & (BUCKETS - 1), np.int32), of
    # n-grams by byte, none across words; a word's end takes part as a closing mark
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    for low in range(0, len(data), _text.SLICE_BYTES):
        high = min(len(data), low + _text.SLICE_BYTES)
        block = data[low : high + max(GRAMS) - 1]
        inside = _text.NOT_SPACE[block]
        marked = np.where(inside, block, np.uint8(_CLOSE)).astype(np.uint64) + np.uint64(1)
        for n in GRAMS:
            size = min(high - low, len(block) - n + 1)
            if size <= 0:
                continue
            ok = inside[:size].copy()
            h = marked[:size].copy()
            with np.errstate(over="ignore"):
                for i in range(1, n):
                    h = h * np.uint64(0x100000001B3) + marked[i : i + size]
                    ok &= ~edge[low + i : low + i + size]
                    if i < n - 1:
                        ok &= inside[i : i + size]
            keep = np.flatnonzero(ok)
            yield (_text.mixed(h[keep] + np.uint64(n << 56)) & mask).astype(np.int32), np.searchsorted(offsets, keep + low, "right") - 1


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(texts: list[bytes], labels: list[int]) -> tuple[np.ndarray, float]:
    """What each bucket adds to the log-odds of label 1 when averaged, and their bias.

    The model has WIDTH-wide vectors and a softmax over two labels; both are linear after the average, so the vectors fold into one
    number a bucket for scoring.
    """
    rng = np.random.default_rng(SEED)
    vectors = (rng.random((BUCKETS, WIDTH), np.float32) - 0.5) / WIDTH
    out, bias = np.zeros((2, WIDTH), np.float32), np.zeros(2, np.float32)
    docs = []
    for t in texts:
        data, count = _text.LOWER[np.frombuffer(t, np.uint8)], np.zeros(BUCKETS, np.int64)
        for f, _ in features(data, np.array([0, len(data)])):
            count += np.bincount(f, minlength=BUCKETS)
        own = np.flatnonzero(count)
        docs.append((own.astype(np.int32), (count[own] / max(1, count.sum())).astype(np.float32)))
    labels_ = np.asarray(labels)
    weight = len(labels_) / (2 * np.maximum(1, np.bincount(labels_, minlength=2)))
    steps, done = EPOCHS * max(1, len(docs)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            rate = RATE * (1 - done / steps)
            done += 1
            own, share = docs[i]
            mean = share @ vectors[own]
            error = _softmax(out @ mean + bias)
            error[labels_[i]] -= 1
            error *= min(weight[labels_[i]], 5.0)
            back = error @ out
            out -= rate * np.outer(error, mean)
            bias -= rate * 0.1 * error
            vectors[own] -= (np.float32(rate) * share)[:, None] * back.astype(np.float32)
    return vectors @ (out[1] - out[0]), float(bias[1] - bias[0])


def held_out(id_column: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS) -> tuple[np.ndarray, float]:
    """The folded model, fitted in one task on a bounded sample: labelled rows that aren't held out, `most` at most, balanced as far
    as each label goes. Rows with a null label or id are passed over; of labels that repeat an id the least counts, of documents
    that do the one of least row key; documents tied for the
    bound go by id. Without both labels, or without documents, the model answers 0.5."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)").where(~held_out("id")).groupBy("id").agg(F.min("label").alias("label"))
    by_label = [known.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(most // 2) for y in (0, 1)]
    chosen = by_label[0].unionByName(by_label[1])
    sample = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), "id")
    one = sample.groupBy("id").agg(F.min("label").alias("label"), F.min_by("text", row_key("text")).alias("text")).groupBy(F.lit(1).alias("one")).applyInPandas(_fit_group, "slope binary, bias double")
    row = one.first()
    if row is None:
        return np.zeros(BUCKETS, np.float32), 0.0
    return np.frombuffer(row["slope"], np.float32), row["bias"]


def _fit_group(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("id")
    if rows["label"].nunique() < 2:
        return pd.DataFrame({"slope": [np.zeros(BUCKETS, np.float32).tobytes()], "bias": [0.0]})
    slope, bias = fit([t.encode() if isinstance(t, str) else b"" for t in rows["text"]], rows["label"].tolist())
    return pd.DataFrame({"slope": [slope.astype(np.float32).tobytes()], "bias": [bias]})


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row, from its whole text alone: the softmax probability of label 1.

    Empty and null texts get the bias alone. Rows that repeat an id or a text are rows of their own; equal texts score equally. An
    empty table gives an empty one. One pass without a shuffle; the model is BUCKETS floats.
    """
    slope, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(slope)

    def run(batches):
        for rows, data, offsets in _text.text_slices(batches, "text"):
            total, many = np.zeros(rows.num_rows), np.zeros(rows.num_rows)
            for f, of in features(_text.LOWER[data], offsets):
                total += np.bincount(of, shared.value[f], rows.num_rows)
                many += np.bincount(of, minlength=rows.num_rows)
            mean = total / np.maximum(1, many)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(1 / (1 + np.exp(-(mean + bias))))], names=["doc_id", "score"])

    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
