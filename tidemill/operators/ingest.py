"""Corpus ingestion: gates, deduplication across sources and runs, chunking, reports."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemill.functions import text as X

# --- fixed values ---
MAX_TOKENS, OVERLAP_TOKENS = 300, 60
NATURAL_BREAKS = ("\n\n", "\n", ". ", " ")
LEAST_PART = 0.6
# --- end of fixed values ---


def first_by(df: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key by order, with the columns of df; exact ties are settled by a hash of the row.

    One grouped minimum that carries its row: df is derived once, and partial minima leave one candidate a key and task, so a key that
    many rows share is no task's burden.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    best = df.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*columns), F.struct(*order, F.xxhash64(*columns))).alias("_row"))
    return best.select("_row.*")


def dedup_content(records: DataFrame, priority: str, order: str) -> DataFrame:
    """One record per stripped content: least priority, then arrival."""
    keyed = records.withColumn("content_hash", X.content_hash(F.col("content")))
    return first_by(keyed, "content_hash", [priority, order])


def unseen(records: DataFrame, index: DataFrame) -> DataFrame:
    """Records (with content_hash) whose hash isn't in the index of earlier runs."""
    return records.join(index.select("content_hash"), "content_hash", "left_anti")


def split_existing(incoming: DataFrame, stored: DataFrame, key: str = "document_key") -> tuple[DataFrame, DataFrame]:
    """(new, skipped) of incoming by the keys already stored."""
    keys = stored.select(key)
    return incoming.join(keys, key, "left_anti"), incoming.join(keys, key, "left_semi")


def new_chunks(chunks: DataFrame, stored: DataFrame, order: list[str], text: str = "chunk") -> DataFrame:
    """Chunks whose text isn't stored, the first of each text by order. Texts meet by their hash."""
    own = chunks.withColumn("_h", F.sha2(text, 256))
    fresh = own.join(stored.select(F.sha2(text, 256).alias("_h")), "_h", "left_anti")
    return first_by(fresh, "_h", order).drop("_h")


def judge_chunks(chunks: DataFrame, stored: DataFrame, order: list[str], text: str = "chunk") -> DataFrame:
    """chunks with their text stripped and `status`: rejected by a gate, duplicate (its text is stored, or stands before by order), or kept.

    A text is rejected or not wherever it stands, so its first place is found by its hash alone, and the gates are asked once a chunk.
    `order` names each chunk once; rows that repeat it share their status.
    """
    own = chunks.withColumn(text, X.strip(F.col(text))).withColumns({"_h": F.sha2(text, 256), "_place": F.struct(*order)})
    held = stored.select(F.sha2(text, 256).alias("_h")).distinct()
    first = own.groupBy("_h").agg(F.min("_place").alias("_place")).join(held, "_h", "left_anti").withColumn("_first", F.lit(True))
    placed = own.join(first, ["_h", "_place"], "left")
    status = F.when(X.reject_reason(F.col(text)).isNotNull(), "rejected").when(F.col("_first"), "kept").otherwise("duplicate")
    return placed.withColumn("status", status).select(*[F.col(f"`{c}`") for c in chunks.columns], "status")


def gate_chunks(chunks: DataFrame, stored: DataFrame, order: list[str], text: str = "chunk") -> tuple[DataFrame, DataFrame]:
    """(chunks to store, counts): cleaned, then those that aren't stored and first of their text. counts: total, rejected, duplicate,
    kept, from one pass; `require_kept` refuses to go on where nothing is left."""
    judged = judge_chunks(chunks, stored, order, text)
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return judged.where("status = 'kept'").drop("status"), judged.agg(F.count("*").alias("total"), count("rejected"), count("duplicate"), count("kept"))


def require_kept(counts: DataFrame) -> dict[str, int]:
    """The counts of `gate_chunks`; an error where no chunk is left to store."""
    found = counts.first().asDict()
    if not found["kept"]:
        raise ValueError(f"no chunk is left to store: of {found['total']}, {found['rejected']} were rejected and {found['duplicate']} are known already")
    return found


def ingest(records: DataFrame, priority: str = "priority", order: str = "idx", observers: dict | None = None) -> DataFrame:
    """Every record with `status`: cleaned away (its reason), duplicate, or kept, and its cleaned content.

    One pass of gates, a grouped minimum by hash and a join on hash and place; `order` names each record once. observers: {stage: function of a DataFrame} are called with raw, processed,
    duplicate and record rows; they cannot change the result.
    """
    stripped = records.withColumn("_stripped", X.strip(F.col("content"))).withColumns({"_key": F.sha2("_stripped", 256), "_place": F.struct(priority, order)})
    # a content is rejected or not wherever it stands, so its first record is found without asking the gates
    first = stripped.groupBy("_key").agg(F.min("_place").alias("_place")).withColumn("_first", F.lit(True))
    placed = stripped.join(first, ["_key", "_place"], "left").withColumn("reason", X.reject_reason(F.col("_stripped")))
    kept = F.col("reason").isNull()
    placed = placed.withColumns({"cleaned": F.when(kept, F.col("_stripped")), "content_hash": F.when(kept, F.col("_key")).otherwise(F.concat(F.lit("-"), F.col(order).cast("string")))})
    status = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("_first"), "kept").otherwise("duplicate")
    out = placed.withColumn("status", status).select(*[F.col(f"`{c}`") for c in (*records.columns, "reason", "cleaned", "content_hash", "status")])
    for stage, see in (observers or {}).items():
        see({"raw": records, "processed": out.where("reason IS NULL"), "duplicate": out.where("status = 'duplicate'"), "record": out.where("status = 'kept'")}[stage])
    return out


def observed(ingested: DataFrame, observation: Observation) -> DataFrame:
    """What `ingest` gives, with its stages' counts (raw, processed, duplicate, record) put into `observation` by whichever job first
    reads it: no job of their own."""
    status = F.col("status")
    return ingested.observe(
        observation, F.count(F.lit(1)).alias("raw"), F.count_if(F.col("reason").isNull()).alias("processed"), F.count_if(status == "duplicate").alias("duplicate"), F.count_if(status == "kept").alias("record")
    )


def report(ingested: DataFrame, chunks: DataFrame | None = None, skipped: DataFrame | None = None, failed: DataFrame | None = None) -> DataFrame:
    """Counts by source of what `ingest` gives and, where they are passed, of its chunks, of the records `skipped` as already stored
    and of those whose batch `failed`: each with a source, grouped before it is joined."""
    counted = ingested.groupBy("source").agg(
        F.count("*").alias("raw"), F.count_if(F.col("reason").isNull()).alias("after_clean"), F.count_if(F.col("status") == "duplicate").alias("duplicate"), F.count_if(F.col("status") == "kept").alias("after_dedup"),
    )
    for name, more in (("chunks", chunks), ("skipped", skipped), ("failed", failed)):
        if more is not None:
            counted = counted.join(more.groupBy("source").agg(F.count("*").alias(name)), "source", "left").fillna(0, [name])
    return counted


class Words:
    """The default tokenizer of the chunker: words and single marks, with their places in the text."""

    pattern = re.compile(r"\w+|[^\w\s]")
    #: A space parts tokens: those of joined texts are those of each.
    parts_at_spaces = True

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.pattern.finditer(text)]

    def count(self, text: str) -> int:
        return len(self.pattern.findall(text))


class _Packer:
    """Fills pieces with sentences, by token places; a piece that closes leaves its last tokens to the next where they fit.

    `done` holds pieces and how many tokens they have. With a tokenizer that parts at spaces, a sentence's tokens are counted once, and
    places are asked only of the sentences that a piece's last tokens are in.
    """

    def __init__(self, tokenizer, most: int, overlap: int):
        self.spans, self.most, self.overlap = tokenizer.spans, most, overlap
        self.handed = getattr(tokenizer, "parts_at_spaces", False)
        self.count = getattr(tokenizer, "count", lambda text: len(tokenizer.spans(text)))
        self.done: list[tuple[str, int]] = []
        #: parts: where each sentence of the text begins, the sentence, and its places where they are known already
        self.text, self.tokens, self.parts = "", 0, []

    def close(self) -> tuple[str, list[tuple[int, int]]]:
        """The piece, and the places of its last `overlap` tokens."""
        last, tokens, parts = self.text, self.tokens, self.parts
        self.text, self.tokens, self.parts = "", 0, []
        if not last:
            return last, []
        if not self.handed:
            places = self.spans(last)
            self.done.append((last, len(places)))
            return last, places[-self.overlap :] if self.overlap else []
        self.done.append((last, tokens))
        places = []
        while parts and len(places) < self.overlap:
            at, sentence, own = parts.pop()
            places = [(a + at, b + at) for a, b in (self.spans(sentence) if own is None else own)] + places
        return last, places[-self.overlap :] if self.overlap else []

    def windows(self, sentence: str, spans: list[tuple[int, int]]) -> None:
        """A sentence beyond the budget: windows over its tokens, each `overlap` behind the end of the last."""
        self.close()
        stride = max(self.most - self.overlap, 1)
        for i in range(0, max(len(spans) - self.most, 0) + stride, stride):
            own = spans[i : i + self.most]
            piece = sentence[own[0][0] : own[-1][1]]
            self.done.append((piece, len(own) if self.handed else len(self.spans(piece))))

    def add(self, sentence: str) -> None:
        n = self.count(sentence)
        if n > self.most:
            return self.windows(sentence, self.spans(sentence))
        if self.tokens + n > self.most and self.text:
            closed, places = self.close()
            if len(places) + n <= self.most and places:
                start = places[0][0]
                self.text, self.tokens, self.parts = closed[start:], len(places), [(0, "", [(a - start, b - start) for a, b in places])]
        joined = f"{self.text} {sentence}"
        white = len(joined) - len(joined.lstrip())
        self.parts.append((len(self.text) + 1 - white, sentence, None))
        self.text, self.tokens = joined.strip(), self.tokens + n


def packed(sentences: list[str], tokenizer, most: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> list[tuple[str, int]]:
    """Pieces of a block and their tokens."""
    packer = _Packer(tokenizer, most, overlap)
    for s in sentences:
        packer.add(s)
    packer.close()
    return packer.done


def pack_block(sentences: list[str], tokenizer, most: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> list[str]:
    return [piece for piece, _ in packed(sentences, tokenizer, most, overlap)]


def chunk_documents(docs: DataFrame, id_column: str, text: str, most: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS, tokenizer=Words, boundary: str = X.UNICODE + X.HARD_BOUNDARY, keep_all: bool = False) -> DataFrame:
    """(id, chunk_index, chunk, token_count): blocks (parted at `boundary`) and sentences by native splits, garbage sentences dropped
    (not with `keep_all`), then packed by a task over its own documents. Chunks never cross a block; garbage chunks are dropped before
    numbering."""
    kind = docs.schema[id_column].dataType.simpleString()
    blocks = F.transform(X.hard_blocks(F.col(text), boundary), lambda b: X.split_sentences(b) if keep_all else F.filter(X.split_sentences(b), lambda s: ~X.garbage(s)))
    source = docs.select(F.col(id_column).alias("id"), blocks.alias("blocks"))
    meaning = re.compile(f"(?s){X.MEANINGFUL}.*?{X.MEANINGFUL}")

    def run(batches):
        words = tokenizer()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids, at, chunk, tokens = [], [], [], []
                for i, doc in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    made = [(c.strip(), n) for b in doc or [] for c, n in packed(b, words, most, overlap)]
                    made = [x for x in made if meaning.search(x[0])]
                    ids += [i] * len(made)
                    at += range(len(made))
                    chunk += [c for c, _ in made]
                    tokens += [n for _, n in made]
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(at, pa.int32()), pa.array(chunk), pa.array(tokens, pa.int32())], names=["id", "chunk_index", "chunk", "token_count"])

    return source.mapInArrow(run, f"id {kind}, chunk_index int, chunk string, token_count int")


def break_places(codes: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """For each kind of natural break, the strongest first: its width, and where each one ends in a text of code points."""
    out = []
    for mark in NATURAL_BREAKS:
        n = len(codes) - len(mark) + 1
        hit = np.ones(max(n, 0), bool)
        for i, c in enumerate(mark):
            hit &= codes[i : i + len(hit)] == ord(c)
        out.append((len(mark), np.flatnonzero(hit) + len(mark)))
    return out


def character_chunks(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """(place, piece) of a text. A piece ends at the last natural break of its final part (from LEAST_PART of the size on), tried from
    the strongest kind of break to the weakest, else at its full size; the next opens `overlap` characters before that.

    Breaks are found once over the whole text; each piece looks them up by bisection."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    breaks = break_places(np.frombuffer(text.encode("utf-32-le"), "<u4"))
    out, opened = [], 0
    while opened < len(text):
        limit, soft = opened + size, opened + int(size * LEAST_PART)
        stop = len(text)
        if limit < stop:
            last = ((width, int(ends[i - 1])) for width, ends in breaks if (i := int(np.searchsorted(ends, limit, "right"))))
            stop = next((end for width, end in last if end - width >= soft), limit)
        if piece := text[opened:stop].strip():
            out.append((opened, piece))
        opened = len(text) if stop == len(text) else max(stop - overlap, opened + 1)
    return out


#: Characters of pieces that a task gives on at once.
PIECE_CHARS = 4 << 20


def character_chunk_documents(docs: DataFrame, id_column: str, text: str, size: int, overlap: int) -> DataFrame:
    """(id, chunk_index, start, chunk) of every text; null and empty texts have no chunk. One pass over Arrow batches."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, at, start, chunk, held = [], [], [], [], 0

            def made(batch=batch):
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(at, pa.int32()), pa.array(start, pa.int32()), pa.array(chunk, pa.string())], names=["id", "chunk_index", "start", "chunk"])

            for place, t in enumerate(batch.column(1)):
                for i, (opened, piece) in enumerate(character_chunks(t.as_py() or "", size, overlap)):
                    ids.append(place)
                    at.append(i)
                    start.append(opened)
                    chunk.append(piece)
                    held += len(piece)
                    if held >= PIECE_CHARS:
                        yield made()
                        ids, at, start, chunk, held = [], [], [], [], 0
            if ids:
                yield made()

    return docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, chunk_index int, start int, chunk string")
