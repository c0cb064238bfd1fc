"""Exact top-k search by the threshold algorithm over sorted lists, one for each dimension."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import cut
from .vectors import BLOCK, QUERY_BYTES, Best, integers, matrix, products, rounds, runs, tasks, width

#: Rows of a query's answer.
K = 5
#: Entries read from each list before the bound is looked at; they double from one look to the next.
DEPTH = 16


class Lists:
    """A block of vectors as lists sorted by each component. Equal vectors are one entry with its least ids."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, k: int):
        self.vectors, group = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, group.ravel()))
        ids, group = ids[order], group.ravel()[order]
        kept = np.ones(len(ids), bool)
        kept[1:] = (ids[1:] != ids[:-1]) | (group[1:] != group[:-1])
        ids, group = ids[kept], group[kept]
        self.ids, self.first = ids, np.searchsorted(group, np.arange(len(self.vectors) + 1))
        self.most = k + 1  # of an entry's ids: k, and the query's own
        self.order = np.argsort(self.vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.vectors, self.order, axis=0)

    def _members(self, entries: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.minimum(np.diff(self.first)[entries], self.most)
        at = np.repeat(self.first[entries] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return np.repeat(scores, n), self.ids[at]

    def search(self, query: np.ndarray, own: int, best: Best, depth: int = DEPTH) -> int:
        """Adds to best what this block has for a query; the entries that were scored.

        Lists are read in step, each from the end at which its products are highest. Every entry met is scored as a whole; what was
        not met scores no more than the sum of the products last read. Once that can't even tie with the k-th score, reading ends.
        """
        n, dims = self.vectors.shape
        up = query >= 0
        at, seen = 0, np.zeros(n, bool)
        edge = np.where(up, self.sorted[-1], self.sorted[0])
        while at < n and not bool(products(edge[None, :], query)[0] < best.least):
            stop = min(n, max(depth, 2 * at))
            met = np.zeros(n, bool)
            met[self.order[n - stop : n - at, up]] = True
            met[self.order[at:stop, ~up]] = True
            fresh = np.flatnonzero(met & ~seen)
            seen |= met
            if len(fresh):
                scores = products(self.vectors[fresh], query)
                high = np.flatnonzero(scores >= best.least)
                scores, ids = self._members(fresh[high], scores[high])
                best.add(scores[ids != own], ids[ids != own])
            at = n if seen.all() else stop
            edge = np.where(up, self.sorted[n - stop], self.sorted[stop - 1])
        return int(seen.sum())


def search(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, query, rank, vec_id, score): for each row of queries the k rows of vectors (all, if fewer) of the highest inner
    product, exactly, ties to the smaller id; rows with the query's own id are not its answers. Both have (id, v), see `integers`.

    Queries are broadcast in blocks of query_bytes; tasks hold a block of vectors at once as sorted lists and carry a query's k-th
    score from one to the next. A task sends k rows a query. Rows that repeat an id and a score count once; `query` tells queries
    that share an id apart.
    """
    base = cut(vectors.select("id", "v"))
    asked = cut(queries.select("id", F.xxhash64("v").alias("query"), "v").dropDuplicates(["id", "query"]))
    dims, n = max(width(base), width(asked)), base.count()
    dealt = cut(base.repartition(tasks(base, n), "id"))

    def job(shared):
        def run(batches):
            table = shared.value
            own, key, asked_v = table.column("id").to_pylist(), table.column("query").to_pylist(), matrix(table.column("v"), dims)
            best = [Best(k) for _ in own]
            for rows, v in runs(batches, dims, block):
                lists = Lists(v, rows.column(0).to_numpy(), k)
                for i, q in enumerate(asked_v):
                    lists.search(q, own[i], best[i])
            sizes = [len(b.ids) for b in best]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(own, np.int64), sizes)), pa.array(np.repeat(np.array(key, np.int64), sizes)), *(pa.array(np.concatenate(x)) for x in zip(*((b.ids, b.scores) for b in best)))], names=["query_id", "query", "vec_id", "score"])

        return dealt.mapInArrow(run, "query_id bigint, query bigint, vec_id bigint, score bigint")

    found = rounds(asked, dims, job, query_bytes)
    if found is None:
        return base.sparkSession.createDataFrame([], "query_id bigint, query bigint, rank int, vec_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "query", "rank", "vec_id", "score")


def report(embeddings: DataFrame, is_query: Column | None = None, k: int = K, **options) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of every row for which is_query (by default: ids divisible by 50) holds.

    Rows without an id, and vectors that are null or hold null or non-finite components, take no part; shorter vectors count as zero
    beyond their end. Rows that repeat an id and its score count once; a table of one row gives none, an empty one neither.
    """
    vectors = cut(integers(embeddings))
    return search(vectors, vectors.where(F.col("id") % 50 == 0 if is_query is None else is_query), k, **options).drop("query")
