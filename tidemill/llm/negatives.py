"""Hard-negative mining with R-trees packed by sort-tile-recursive (STR)."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import cut
from .vectors import BLOCK, QUERY_BYTES, Best, integers, matrix, products, rounds, runs, tasks, width

#: An anchor's positives, a positive's negatives.
POSITIVES, NEGATIVES = 5, 5
#: A negative scores between these shares (per cent) of the positive's score.
LOW, HIGH = 80, 100
#: Rows of a leaf, nodes under one above.
LEAF, FANOUT = 128, 8


def _packed(vectors: np.ndarray, at: np.ndarray, axes: list[int], leaf: int) -> list[np.ndarray]:
    """STR: rows sorted by the first axis and cut into slabs of whole leaves, each slab by the next axis, and so on."""
    if len(at) <= leaf:
        return [at]
    at = at[np.argsort(vectors[at, axes[0]], kind="stable")]
    leaves = -(-len(at) // leaf)
    slabs = leaves if len(axes) == 1 else int(np.ceil(leaves ** (1 / len(axes))))
    size = -(-leaves // slabs) * leaf
    return [x for i in range(0, len(at), size) for x in (_packed(vectors, at[i : i + size], axes[1:], leaf) if len(axes) > 1 else [at[i : i + size]])]


@dataclass
class _Level:
    """Bounding boxes of a level's nodes: corners and range of labels; nodes at first[i] to first[i + 1] below belong to node i."""

    low: np.ndarray
    high: np.ndarray
    labels: np.ndarray
    first: np.ndarray

    def bounds(self, positive: np.ndarray, negative: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of any point in each box with each query: each coordinate has its own interval, from
        one corner to the other, and intervals add up."""
        return positive @ self.low.T + negative @ self.high.T, positive @ self.high.T + negative @ self.low.T


class Tree:
    """An R-tree over a block of rows: labels are the first coordinate that rows are packed by, then those that vary most."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
        leaves = -(-len(ids) // leaf)
        axes = np.argsort(-vectors.var(axis=0), kind="stable")[: max(1, int(np.log2(max(2, leaves)) // 2))]
        keyed = np.column_stack((labels, vectors[:, axes]))
        packed = _packed(keyed, np.arange(len(ids)), list(range(keyed.shape[1])), leaf)
        at = np.concatenate(packed)
        self.vectors, self.labels, self.ids = vectors[at], labels[at], ids[at]
        first = np.concatenate(([0], np.cumsum([len(x) for x in packed])))
        low, high, marks = self.vectors, self.vectors, np.column_stack((self.labels, self.labels))
        self.levels: list[_Level] = []
        while True:
            start = first[:-1]
            level = _Level(np.minimum.reduceat(low, start), np.maximum.reduceat(high, start), np.column_stack((np.minimum.reduceat(marks[:, 0], start), np.maximum.reduceat(marks[:, 1], start))), first)
            self.levels.append(level)
            low, high, marks, n = level.low, level.high, level.labels, len(start)
            if n == 1:
                return
            first = np.append(np.arange(0, n, fanout), n)

    def bounds(self, queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        positive, negative = np.maximum(queries, 0), np.minimum(queries, 0)
        return [level.bounds(positive, negative) for level in self.levels]

    def walk(self, query: np.ndarray, bounds: list[tuple[list, list]], windows: list[tuple[float, float]], best: list[Best], label: int, same: bool, own: int) -> int:
        """Adds to each window's best the rows of the label (or of others) whose scores it holds; the leaves that were read.

        The node of the highest greatest product comes first. A node goes if its interval meets no window, if it is strictly below
        the k-th score of those it meets, or if its labels can't do.
        """
        top, read = max(high for _, high in windows), 0
        depth = len(self.levels) - 1
        queue = [(-bounds[depth][1][0], depth, 0)]
        while queue:
            key, d, i = heapq.heappop(queue)
            low, high = bounds[d][0][i], -key
            if not any(high >= max(w[0], b.least) and low <= w[1] for w, b in zip(windows, best)):
                if all(high < max(w[0], b.least) for w, b in zip(windows, best)):
                    break  # and so is all that is left in the queue
                continue
            level = self.levels[d]
            if d:
                for j in range(level.first[i], level.first[i + 1]):
                    a, z = self.levels[d - 1].labels[j]
                    if (a <= label <= z) if same else not (a == label == z):
                        heapq.heappush(queue, (-bounds[d - 1][1][j], d - 1, j))
                continue
            read += 1
            rows = slice(level.first[i], level.first[i + 1])
            scores, ids = products(self.vectors[rows], query), self.ids[rows]
            fit = ((self.labels[rows] == label) == same) & (ids != own)
            if top < np.inf:
                fit &= scores <= top
            scores, ids = scores[fit], ids[fit]
            for (least, most), b in zip(windows, best):
                at = np.flatnonzero((scores >= max(least, b.least)) & (scores <= most))
                if len(at):
                    b.add(scores[at], ids[at])
        return read


def _searched(dealt: DataFrame, asked: DataFrame, dims: int, k: int, same: bool, block: int, query_bytes: int) -> DataFrame | None:
    """(anchor, window, id, score) of what each task finds for the anchors (anchor, id, label, v, windows) in their windows."""

    def job(shared):
        def run(batches):
            table = shared.value
            anchors, own, label = (table.column(c).to_pylist() for c in ("anchor", "id", "label"))
            v, windows = matrix(table.column("v"), dims), [[(w["low"], w["high"]) for w in x] for x in table.column("windows").to_pylist()]
            best = [[Best(k) for _ in w] for w in windows]
            for rows, x in runs(batches, dims, block):
                tree = Tree(x, rows.column(1).to_numpy(), rows.column(0).to_numpy())
                for i in range(0, len(own), 256):
                    bounds = tree.bounds(v[i : i + 256])
                    for j in range(i, min(i + 256, len(own))):
                        tree.walk(v[j], [(low[j - i].tolist(), high[j - i].tolist()) for low, high in bounds], windows[j], best[j], label[j], same, own[j])
            found = [(a, w, b) for a, each in zip(anchors, best) for w, b in enumerate(each) if len(b.ids)]
            if found:
                sizes = [len(b.ids) for _, _, b in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([a for a, _, _ in found], sizes), pa.int64()), pa.array(np.repeat([w for _, w, _ in found], sizes), pa.int32()), *(pa.array(np.concatenate(c)) for c in zip(*((b.ids, b.scores) for _, _, b in found)))],
                    names=["anchor", "window", "id", "score"],
                )

        return dealt.mapInArrow(run, "anchor bigint, window int, id bigint, score bigint")

    return rounds(asked, dims, job, query_bytes)


def _first(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id"))
    return found.distinct().withColumn("rank", place).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row of vectors (id, label, v) for which
    `anchors` holds, its first `positives` other rows of the same label by inner product, and for each of these the first `negatives`
    rows of other labels that score between `low` and `high` per cent of it; ties go to the smaller id. Exact.

    Rows are dealt out by ranges of label and of the component that varies most, the first cut of STR; a task packs each run of `block`
    rows into a tree. Anchors are broadcast in blocks of query_bytes. A task sends at most as many rows a window as are asked for.
    Windows of one anchor are searched in one walk. Rows that repeat an id and a score count once; anchors that share an id but not a
    vector or a label are told apart.
    """
    base = cut(vectors.where("label IS NOT NULL").select("id", F.col("label").cast("long").alias("label"), "v"))
    n, dims = base.count(), width(base)
    spread = base.select(F.posexplode("v")).groupBy("pos").agg(F.var_pop("col").alias("spread")).orderBy(F.desc("spread"), "pos").first()
    component = F.coalesce(F.get("v", F.lit(spread["pos"] if spread else 0)), F.lit(0))
    ranged = base.withColumn("_first", component).repartitionByRange(tasks(base, n), "label", "_first", "id").sortWithinPartitions("label", "_first", "id")
    dealt = cut(ranged.select("id", "label", "v"))
    marked = base.where(anchors).withColumn("anchor", F.xxhash64("id", "label", "v")).dropDuplicates(["id", "anchor"])
    asked = cut(marked.withColumn("windows", F.array(F.struct(F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")))))
    result = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    none = base.sparkSession.createDataFrame([], result)
    found = _searched(dealt, asked, dims, positives, True, block, query_bytes)
    if found is None:
        return none
    chosen = cut(_first(found, positives).select("anchor", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # low * p <= 100 * n <= high * p, in integers
    bound = lambda share, up: (F.ceil if up else F.floor)(F.col("positive_score").cast("decimal(19,0)") * F.lit(share) / F.lit(100)).cast("double")
    each = chosen.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("window", bound(low, True).alias("low"), bound(high, False).alias("high")))).alias("windows"))
    narrowed = cut(asked.drop("windows").join(each, "anchor"))
    found = _searched(dealt, narrowed, dims, negatives, False, block, query_bytes)
    if found is None:
        return none
    names = marked.select("anchor", F.col("id").alias("anchor_id"))
    ranked = _first(found, negatives).withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(chosen, ["anchor", "window"]).join(names, "anchor")
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def report(embeddings: DataFrame, **options) -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by 100, after the labels of those divisible by 7 are raised by one
    (modulo 10): anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null id or label, a null vector, or a null or non-finite component take no part; shorter vectors count as zero beyond
    their end. An anchor without another row of its label, and a positive without a negative in its window (one of a negative score
    has none), give no row. Ties go to the smaller id; rows that repeat count once; an empty table gives an empty one.
    """
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(integers(embeddings, label=label), F.col("id") % 100 == 0, **options)
