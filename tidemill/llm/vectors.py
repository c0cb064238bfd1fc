"""Integer vectors for exact searches, and queries in blocks of a bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut

#: Components are floor(SCALE * x). They saturate at LIMIT, so that inner products of up to 2,048 components fit 64 bits.
SCALE = 256
LIMIT = 1 << 26
#: Bytes of queries that are broadcast at once.
QUERY_BYTES = 32 << 20
#: Rows that a task works on at once.
BLOCK = 8192


def integers(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", **more: Column) -> DataFrame:
    """(id, v, more...): vectors with integer components. Rows without an id, and those whose vector is null or holds a null or
    non-finite component, are left out."""
    whole = "_v IS NOT NULL AND forall(_v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    rounded = f"transform(_v, x -> cast(floor(greatest(least({SCALE}D * cast(x AS double), {LIMIT}D), -{LIMIT}D)) AS int))"
    named = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("_v"), *[c.alias(k) for k, c in more.items()])
    return named.where(f"id IS NOT NULL AND {whole}").select("id", F.expr(rounded).alias("v"), *more)


def width(vectors: DataFrame) -> int:
    """Components of the longest vector, one at least; shorter ones count as zero beyond their end."""
    return max(1, vectors.agg(F.max(F.size("v"))).first()[0] or 0)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as rows of dims numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims) < sizes[:, None]] = flat[offsets[0] : offsets[-1]]
    return out


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of rows with a query (or with the columns of queries): in doubles where these hold every sum, else in 64-bit integers."""
    if rows.shape[1] * float(np.abs(rows).max(initial=0)) * float(np.abs(query).max(initial=0)) < 1 << 53:
        return (rows @ query).astype(np.int64)
    return rows.astype(np.int64) @ query.astype(np.int64)


def blocks(queries: DataFrame, dims: int, most_bytes: int = QUERY_BYTES) -> Iterator[pa.Table]:
    """The rows of queries (cut before) in tables of most_bytes of components at most, one after the other through the driver."""
    most = max(1, most_bytes // (8 * dims))
    n = -(-queries.count() // most)
    while n:
        dealt = queries.withColumn("_block", F.pmod(F.xxhash64(*queries.columns), F.lit(n)))
        if n == 1 or max(r["count"] for r in dealt.groupBy("_block").count().collect()) <= most:
            for b in range(n):
                yield dealt.where(F.col("_block") == b).drop("_block").toArrow()
            return
        n *= 2


def runs(batches, dims: int, block: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """A task's rows in runs of `block`, with their vectors (column v)."""
    held, n = [], 0

    def joined():
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return whole, matrix(whole.column(whole.schema.get_field_index("v")), dims)

    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, block - n)
            held.append(part)
            n, batch = n + part.num_rows, batch.slice(part.num_rows)
            if n == block:
                yield joined()
                held, n = [], 0
    if held:
        yield joined()


def tasks(df: DataFrame, rows: int, least: int = 1024, most: int = 131_072) -> int:
    """Partitions for work on each of `rows` rows: some for every core, but of `least` to `most` rows each."""
    return max(1, -(-rows // most), min(rows // least, 2 * df.sparkSession.sparkContext.defaultParallelism))


class Best:
    """The k highest (score, id) pairs, ties to the smaller id; equal pairs count once."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> float:
        """A score that a further row must reach."""
        return self.scores[-1] if len(self.scores) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.scores) == self.k:
            at = np.flatnonzero(scores >= self.scores[-1])
            if not len(at):
                return
            scores, ids = scores[at], ids[at]
        s, i = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
        order = np.lexsort((i, -s))
        s, i = s[order], i[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (i[1:] != i[:-1])
        self.scores, self.ids = s[new][: self.k], i[new][: self.k]


def rounds(queries: DataFrame, dims: int, job, most_bytes: int = QUERY_BYTES) -> DataFrame | None:
    """The union of job(broadcast block) over all blocks of queries, each computed and its broadcast freed before the next."""
    found = None
    for table in blocks(queries, dims, most_bytes):
        shared = queries.sparkSession.sparkContext.broadcast(table)
        part = cut(job(shared))
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found
