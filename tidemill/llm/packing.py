"""Best-fit packing of token pieces by exact-complement hashing."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _text
from ._spark import cut, row_key

LENGTH = 4096
END_ID = 1
#: Words whose ids a Python worker remembers (some 100 MB); the memory is emptied when full.
REMEMBERED = 700_000
#: Pieces of one length are numbered in groups of about this many, by hash.
GROUP = 2_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# --- fixed values: the tokenizer's own pieces of a lower-cased word, and how it writes the bytes of a piece ---
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9]+")
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
# --- end of fixed values ---
_HIDDEN = [b for b in range(256) if b not in set(SHOWN)]
_AS_CHAR = {b: chr(b) for b in SHOWN} | {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}
#: Words that are cut into pieces here: visible ASCII and Latin-1 letters. All others go through the whole tokenizer.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


class WordIds(dict):
    """Ids (little-endian 32-bit) of words that ASCII white space parts, by a tokenizer that drops white space and never joins words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.encode, self.merge = whole.encode, whole.model.tokenize

    def _ids(self, word: str) -> list[int]:
        # a word of plain letters needs no normaliser beyond lower case, and a marked special token has a <|
        if not _PLAIN.fullmatch(word) or "<|" in word:
            return self.encode(word, add_special_tokens=False).ids
        pieces = PIECES.findall(word.lower())
        return [t.id for p in pieces for t in self.merge(p if p.isascii() else "".join([_AS_CHAR[b] for b in p.encode()]))]

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self._ids(word.decode("utf-8", "replace"))
        self[word] = ids = struct.pack(f"<{len(ids)}I", *ids)
        return ids

    def of(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


_known: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One memory of words for all the tasks that a Python worker runs in turn."""
    if path not in _known:
        _known[path] = WordIds(path)
    return _known[path]


def pieces(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32): every document's ids and an end id, cut only where longer than `length`.

    The tokenizer's pattern never crosses white space and drops it, so a text's ids are its words' ids in turn; each task asks the
    tokenizer once a word. Null counts as empty: the end id alone. `row` tells apart rows that share an id.
    """
    size = 4 * length

    def run(batches):
        known = word_ids(path)
        end = np.asarray([end_id], "<u4").tobytes()
        for rows, data, offsets in _text.text_slices(batches, "text"):
            raw, out = data.tobytes(), []
            for i in range(rows.num_rows):
                ids = known.of(raw[offsets[i] : offsets[i + 1]]) + end
                out += [(i, p, at // 4, min(size, len(ids) - at) // 4, zlib.crc32(ids[at : at + size])) for p, at in enumerate(range(0, len(ids), size))]
            of, p, start, n, crc = zip(*out)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(of)), rows.column(1).take(pa.array(of)), pa.array(p, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(id_column).alias("doc_id"), row_key(text).alias("row"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


class Sums:
    """Index of the sums of one, two and three available lengths: each pair's witness, whether there is a triple, 0 for none.

    Lengths only become fewer, so a sum without a combination stays without; a witness that has run out is looked for again.
    """

    def __init__(self, count: np.ndarray):
        self.count, most = count, len(count) - 1
        self.pair, self.triple = np.zeros(most + 1, np.int64), np.zeros(most + 1, bool)
        have = np.flatnonzero(count)
        for a in have[::-1].tolist():
            other = have[: np.searchsorted(have, min(a, most - a), "right")]
            self.pair[a + other[(other < a) | (count[a] > 1)]] = a
        for c in have.tolist():
            self.triple[c + np.flatnonzero(self.pair[: most - c + 1])] = True

    def fill(self, gap: int) -> list[int]:
        """One, two or three available lengths that fill the gap exactly, or none."""
        return [gap] if self.count[gap] else self._two(gap) or self._three(gap)

    def _two(self, gap: int, reserved: bool = False) -> list[int]:
        a = int(self.pair[gap])
        if not a:
            return []
        if self.count[a] > (2 * a == gap) and self.count[gap - a]:
            return [a, gap - a]
        a = np.flatnonzero(self.count[:gap])
        a = a[2 * a >= gap]
        a = a[self.count[gap - a] > (2 * a == gap)]
        if not reserved:
            self.pair[gap] = a[0] if len(a) else 0
        return [int(a[0]), gap - int(a[0])] if len(a) else []

    def _three(self, gap: int) -> list[int]:
        if not self.triple[gap]:
            return []
        c = np.flatnonzero(self.count[:gap])[::-1]
        c = c[self.pair[gap - c] > 0]
        a = self.pair[gap - c]
        b = gap - c - a
        there = (self.count[a] > (a == b) * 1 + (a == c)) & (self.count[b] > (a == b) * 1 + (b == c)) & (self.count[c] > (a == c) * 1 + (b == c))
        if there.any():
            i = int(np.argmax(there))
            return [int(c[i]), int(a[i]), int(b[i])]
        for c in c.tolist():  # witnesses that have run out
            self.count[c] -= 1
            two = self._two(gap - c, reserved=True)
            self.count[c] += 1
            if two:
                return [c, *two]
            self._two(gap - c)
        self.triple[gap] = False
        return []


def plan(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, list[int]]]:
    """Patterns (how many sequences, the lengths in each) that use up a histogram of piece lengths.

    From the longest piece down: while its gap has an exact complement of one, two or three available lengths, that pattern is used
    as often as its lengths last; what remains takes the largest length that fits (best fit) until nothing does.
    """
    count = np.zeros(length + 1, np.int64)
    for n, c in histogram.items():
        count[n] = c
    sums, out = Sums(count), []
    for top in range(length, 0, -1):
        while count[top]:
            count[top] -= 1
            pattern, gap = [top], length - top
            while gap:
                exact = sums.fill(gap)
                if exact:
                    np.subtract.at(count, exact, 1)
                    pattern += exact
                    break
                have = np.flatnonzero(count[: gap + 1])
                have = have[have > 0]
                if not len(have):
                    break
                fit = int(have[-1])
                count[fit] -= 1
                pattern.append(fit)
                gap -= fit
            need = np.bincount(pattern, minlength=length + 1)
            used = np.flatnonzero(need)
            more = int((count[used] // need[used]).min())
            count[used] -= more * need[used]
            out.append((1 + more, sorted(pattern, reverse=True)))
    return out


def runs(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go, by their rank in it: (length, first rank, ranks, first sequence, copies in a sequence, offset)."""
    out, rank, sequence = [], {}, 0
    for times, lengths in patterns:
        at = 0
        for n in sorted(set(lengths), reverse=True):
            copies = lengths.count(n)
            first = rank.get(n, 0)
            out.append((n, first, times * copies, sequence, copies, at))
            rank[n] = first + times * copies
            at += copies * n
        sequence += times
    return out


def pack(cut_pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """cut_pieces with sequence_id and offset: few sequences of `length` at most, gapless from 0.

    Only the histogram of lengths (`length` counts at most, however many pieces) reaches the driver, which plans patterns of lengths
    on it. Pieces are ranked within their length in two steps, by hashed groups and then across groups, so that a length
    which many share is not one task's; ranks meet the plan's runs by an equality join on length and group.
    """
    spark = cut_pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    groups = spark.createDataFrame([(n, -(-c // GROUP)) for n, c in histogram.items()] or [(0, 1)], "length bigint, _groups bigint")
    salted = cut_pieces.join(F.broadcast(groups), "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "row", "piece"), "_groups")).drop("_groups")
    inner = Window.partitionBy("length", "_salt").orderBy("doc_id", "row", "piece")
    ranked = salted.withColumn("_rank", F.row_number().over(inner) - 1)
    before = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n"))
    table = runs(plan(histogram, length))
    placed = spark.createDataFrame(table or [(0,) * 6], "length bigint, first bigint, ranks bigint, sequence bigint, copies bigint, place bigint")
    by_length = placed.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "ranks", "sequence", "copies", "place"))).alias("_runs"))
    # the runs that a group of ranks can meet, then the run of each rank by halving
    spans = before.join(F.broadcast(by_length), "length").select(
        "length", "_salt", "_before", F.expr("filter(_runs, r -> r.first < _before + _n AND r.first + r.ranks > _before)").alias("_runs")
    )
    at = F.col("_before") + F.col("_rank")
    met = ranked.join(spans, ["length", "_salt"]).withColumn("_at", at).withColumn("_run", F.expr("element_at(filter(_runs, r -> r.first <= _at AND _at < r.first + r.ranks), 1)"))
    step = F.col("_at") - F.col("_run.first")
    return met.select(
        *[c for c in cut_pieces.columns], (F.col("_run.sequence") + F.floor(step / F.col("_run.copies"))).cast("long").alias("sequence_id"),
        (F.col("_run.place") + F.pmod(step, F.col("_run.copies")) * F.col("length")).cast("long").alias("offset"),
    )


def packed(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per piece of every document, with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are packed as their end id; rows that repeat are packed as often; an empty table packs into nothing.
    """
    return pack(cut(pieces(docs, path or tokenizer_path(), id_column, text, length)), length).drop("row")
