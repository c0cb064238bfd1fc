"""Embedding jobs: the hashing provider, batched pluggable providers, the long store."""

from __future__ import annotations

import hashlib
import re
import time
from collections import Counter
from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions import text as X

DIMENSION = 512
BATCH = 64


class Provider(Protocol):
    name: str
    dimension: int

    def embed_texts(self, texts: Sequence[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...


def hashing_terms(docs: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """(id, bucket, value): signed token counts; a token's bucket and sign come from SHA-256. Native and mergeable."""
    words = docs.select("id", F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(X.UNICODE + r"\w+"), F.lit(0))).alias("t"))
    counted = words.groupBy("id", "t").agg(F.count("*").alias("n"))
    high = lambda c: F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    bucket = (high(F.concat(F.lit(":"), "t")) % F.lit(dimension)).cast("int")
    sign = F.when(F.conv(F.substring(F.sha2(F.concat(F.lit("sign:"), "t"), 256), 16, 1), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    return counted.groupBy("id", bucket.alias("bucket")).agg(F.sum(sign * F.col("n")).cast("double").alias("value")).where("value <> 0")


def _place(token: str, dimension: int) -> tuple[int, int]:
    """A token's bucket and sign."""
    at, sign = (hashlib.sha256(f"{salt}:{token}".encode()).digest() for salt in ("", "sign"))
    return int.from_bytes(at[:8], "big") % dimension, -1 if sign[7] & 1 else 1


#: Tokens whose places a task remembers; rows whose sums it gives on at once.
PLACES, SUM_ROWS = 1 << 17, 1024


def hashing_embedding(docs: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """(id, vector): L2-normalised hashing embeddings of docs (id, text); texts without tokens get zeros.

    Tokens are taken natively and counted where they are read; only a text's sums are shuffled, to add those of rows that share an id.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def sums(batches):
        places = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SUM_ROWS):
                part = batch.slice(at, SUM_ROWS)
                sizes = pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
                told = pc.list_flatten(part.column(1)).dictionary_encode()
                if len(places) > PLACES:
                    places.clear()
                own = [places.get(t) or places.setdefault(t, _place(t, dimension)) for t in told.dictionary.to_pylist()]
                bucket, sign = np.array(own, np.int64).reshape(-1, 2)[told.indices.to_numpy(zero_copy_only=False)].T
                row = np.repeat(np.arange(len(sizes)), sizes)
                flat = np.bincount(row * dimension + bucket, sign, len(sizes) * dimension).astype(np.float64)  # integers where no text has a token
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * dimension), pa.array(flat))], names=["id", "sums"])

    def unit(batches):
        last, held = None, None

        def made():
            size = np.linalg.norm(held)
            return pa.RecordBatch.from_arrays([last, pa.array([held / size if size else held], pa.list_(pa.float64()))], names=["id", "vector"])

        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
            ids = batch.column(0)
            new = np.ones(len(v), bool)
            if len(v) > 1:
                new[1:] = pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), True).to_numpy(zero_copy_only=False) & ~(pc.is_null(ids[1:]).to_numpy(zero_copy_only=False) & pc.is_null(ids[:-1]).to_numpy(zero_copy_only=False))
            start = np.flatnonzero(new)
            added = np.add.reduceat(v, start, axis=0)
            if last is not None:
                if ids[0].as_py() == last[0].as_py():
                    added[0] += held
                else:
                    yield made()
            size = np.linalg.norm(added, axis=1, keepdims=True)
            if len(start) > 1:
                whole = np.divide(added, size, out=np.zeros_like(added), where=size > 0)[:-1]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(start[:-1])), pa.ListArray.from_arrays(pa.array(np.arange(len(whole) + 1, dtype=np.int32) * dimension), pa.array(whole.ravel()))], names=["id", "vector"])
            last, held = ids.slice(int(start[-1]), 1), added[-1]
        if last is not None:
            yield made()

    said = docs.select("id", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(X.UNICODE + r"\w+"), F.lit(0)).alias("t"))
    summed = said.mapInArrow(sums, f"id {kind}, sums array<double>")
    return summed.repartition("id").sortWithinPartitions("id").mapInArrow(unit, f"id {kind}, vector array<double>")


class HashingProvider:
    """The same embedding, text by text, behind the provider protocol."""

    def __init__(self, name: str = "hashing", dimension: int = DIMENSION):
        self.name, self.dimension = name, dimension

    def embed_texts(self, texts: Sequence[str]) -> list[list[float]]:
        counts = [Counter(re.findall(r"\w+", t.lower())) for t in texts]
        places = {t: _place(t, self.dimension) for t in set().union(*counts)}
        out = np.zeros((len(texts), self.dimension))
        for row, own in zip(out, counts):
            for token, n in own.items():
                at, sign = places[token]
                row[at] += sign * n
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size > 0, size, 1)).tolist()

    def embed_query(self, text: str) -> list[float]:
        return self.embed_texts([text])[0]


class Transient(Exception):
    """An error after which a batch is worth another try."""


def embed(docs: DataFrame, factory: Callable[[], Provider], batch: int = BATCH, tries: int = 3, pause: float = 0.5, query: bool = False) -> DataFrame:
    """(id, provider, vector) of docs (id, text) by a provider that each task makes once.

    Batches of `batch` at most; blank texts are passed over; transient errors are tried again, at doubling intervals, `tries` times.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        provider = factory()

        def ask(texts):
            for i in range(tries):
                try:
                    return [provider.embed_query(t) for t in texts] if query else provider.embed_texts(texts)
                except Transient:
                    if i == tries - 1:
                        raise
                    time.sleep(pause * 2**i)

        for rows in batches:
            for i in range(0, rows.num_rows, batch):
                part = rows.slice(i, batch)
                vectors = ask(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([provider.name] * part.num_rows), pa.array(vectors, pa.list_(pa.float64()))], names=["id", "provider", "vector"])

    return docs.where(X.strip(F.coalesce("text", F.lit(""))) != "").select("id", "text").mapInArrow(run, f"id {kind}, provider string, vector array<double>")


def embed_all(docs: DataFrame, factories: dict[str, tuple[Callable[[], Provider], int]]) -> DataFrame:
    """The long store of several providers, each vector with its `problem` (null where it may be stored)."""
    out = None
    for name, (factory, dimension) in factories.items():
        one = embed(docs, factory).withColumn("provider", F.lit(name)).withColumn("problem", X.embedding_problem(F.col("vector"), dimension))
        out = one if out is None else out.unionByName(one)
    return out
