"""Language-model scoring by online logistic context mixing, beside a smoothed unigram base.

Every symbol is coded by binary decisions whose hashed-context predictors are mixed by gated weights and refined. Counters of short
contexts have a fixed size. What texts share beyond those contexts is gathered by phrases, runs of some 32 words cut where the words
themselves say so: the corpus' table of phrases grows with it and is never in one place, and a text's phrases meet it by a join.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import cut

#: Every symbol is coded by binary decisions, those of a Huffman tree per previous symbol, or per previous two where these are common.
#: 0xFF, which UTF-8 never holds, ends a text.
END = 0xFF
#: Pairs of symbols that have a tree of their own.
PAIR_TREES = 1024
TREES = 256 + PAIR_TREES
#: Slots of the counters: the node alone (and with it the tree's symbols), three symbols, four, the word so far.
SLOTS = (1 << 19, 1 << 20, 1 << 21, 1 << 21)
#: Counters travel and are summed in blocks of this many slots.
BLOCK = 1 << 16
#: A counter is kept as one byte: 64 levels of log-odds, STEP to a unit, and how much it has seen (none, up to 3, up to 20, more).
STEP = 4
SEEN = (0, 3, 20)
INPUTS = len(SLOTS)
#: Weight sets: how much the counters of four symbols and of the word so far have seen.
GATES = 16
BUCKETS = 64
#: Buckets of a text's own refinement, and what its prior weighs in decisions.
OWN_BUCKETS, OWN_PRIOR = 16, 32.0
#: Symbols of a text between two updates of its own weights and refinement, once it has gone on for a while (see lane_edges); symbols
#: worked on at once, which fit a core's cache.
LANE_BYTES = 512
STEP_BYTES = 32_000
RATE, OWN_RATE = 0.4, 0.08
#: Text bytes whose contexts are laid out at once, a multiple of 4 LANE_BYTES. A longer text is laid out in parts, which hand on what
#: they know (`Part`), so that its score doesn't depend on where it is cut. A part's context reaches back over so many words, and no
#: further than so many bytes.
SLICE = 1 << 20
BACK_WORDS, BACK = 5, 1 << 16
#: Words of a phrase on average (a power of two), and the part of the probability that phrases of the corpus get.
PHRASE_WORDS = 32
PHRASE_SHARE = 1 / 16
#: Phrases whose counts are broadcast (some 0.5 MB); all others meet theirs by a join.
HEAD_PHRASES = 1 << 15
#: Words whose counts are broadcast (4 MB); all others meet theirs by a join.
HEAD_WORDS = 1 << 18
#: Distinct words, or phrases, a task counts before it sends them on.
COUNTED = 600_000
#: Groups in which the tasks' counters are summed before they are summed by block.
SUMMED = 64
#: Words or phrases of one text in one row; a text with more has more rows.
ROW_ITEMS = 50_000
NODE_FACTOR = np.uint32(0x9E3779B1)


def fold(id_column: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))), F.lit(10)).cast("int")


@dataclass
class Trees:
    """Binary decisions of each (tree, symbol): code is 256 times where they begin in `path`, which holds node * 2 + bit, and how many
    there are. of_pair: each pair's tree. counter: what each node has seen of its two sides, as a counter's bytes."""

    of_pair: np.ndarray
    code: np.ndarray
    path: np.ndarray
    counter: np.ndarray


def trees(of_pair: np.ndarray, counts: np.ndarray) -> Trees:
    """Huffman trees from counts by (tree, symbol); every symbol has a code in every tree."""
    code = np.zeros(len(counts) * 256, np.int64)
    seen = np.zeros((SLOTS[0], 2))
    steps: list[int] = []
    for tree, own in enumerate(counts.tolist()):
        heap = [(n * 256 + 1, s) for s, n in enumerate(own)]
        heapq.heapify(heap)
        up: dict[int, tuple[int, int]] = {}
        for node in range(256, 511):
            (x, left), (y, right) = heapq.heappop(heap), heapq.heappop(heap)
            up[left], up[right] = (node, 0), (node, 1)
            seen[tree * 256 + node - 256] = x // 256, y // 256  # a leaf weighs 256 times its count, and 1
            heapq.heappush(heap, (x + y, node))
        for s in range(256):
            path, at = [], s
            while at in up:
                at, b = up[at]
                path.append((tree * 256 + at - 256) * 2 + b)
            code[tree * 256 + s] = len(steps) << 8 | len(path)
            steps += reversed(path)
    return Trees(of_pair.astype(np.int64), code, np.asarray(steps, np.int64), packed_counts(seen[:, 0], seen[:, 1]))


@dataclass
class Part:
    """What a part of a long text hands on to the next: the phrase that is open at its end (hash so far, symbols, log2 probability),
    the text's own weights and refinement, and how many symbols have gone by."""

    hash: int = 0
    length: int = 0
    bits: float = 0.0
    own: np.ndarray | None = None
    tally: np.ndarray | None = None
    at: int = 0


@dataclass
class Lanes:
    """A slice of texts as symbols, each with its code's key and where its contexts' slots are in each counter; the phrases that the
    slice falls into, by their ends, and their hashes."""

    key: np.ndarray
    places: list[np.ndarray]
    offsets: np.ndarray
    stops: np.ndarray
    phrases: np.ndarray


def _symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts, each with its end, and their n + 1 offsets."""
    return np.insert(_text.LOWER[data], offsets[1:], END), offsets + np.arange(len(offsets))


def parts(batches, most: int):
    """Rows in slices of about `most` bytes as (rows, symbols, offsets, skip, part, last). A longer text comes alone, in parts cut at
    fixed places, with one `part` for all of them; the first `skip` symbols of a part are only there as the context of the others."""
    for rows, data, offsets in _text.text_slices(batches, "text", most):
        part = Part()
        if len(data) <= most or rows.num_rows > 1:
            yield rows, *_symbols(data, offsets), 0, part, True
            continue
        for i in range(0, len(data), most):
            low, last = _context(data, i), i + most >= len(data)
            cut = _text.LOWER[data[low : i + most]]
            cut = np.append(cut, np.uint8(END)) if last else cut
            yield rows, cut, np.array([0, len(cut)]), i - low, part, last


def _context(data: np.ndarray, i: int) -> int:
    """Where the context of a text's symbols from i on begins: after a space BACK_WORDS words before, but within BACK bytes."""
    low = max(0, i - BACK)
    space = _text.SPACE[data[low:i]]
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    return low + int(ends[-BACK_WORDS]) + 1 if len(ends) >= BACK_WORDS else low


def _before(symbols: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The symbol k places back in the same text, or END."""
    out = np.full(len(symbols), END, np.uint32)
    out[k:] = symbols[: len(symbols) - k]
    for i in range(k):
        starts = at[:-1] + i
        out[starts[starts < at[1:]]] = END
    return out


def lanes(symbols: np.ndarray, at: np.ndarray, of_pair: np.ndarray | None, skip: int = 0, part: Part | None = None, last: bool = True) -> Lanes:
    """Without of_pair only the phrases. Those of a long text's part begin with the one that the part before has left open; one that is
    open at its end is handed on."""
    size = len(symbols)
    b1 = _before(symbols, at, 1)
    with np.errstate(over="ignore"):
        p, q = _text._powers(size + 1)
        s = np.zeros(size + 1, np.uint64)
        np.cumsum((symbols + np.uint64(1)) * p[:size], out=s[1:])
        opens = _text.SPACE[b1]
        opens[at[:-1]] = True
        start = np.flatnonzero(opens)
        many = np.diff(np.append(start, size))
        word = s[:-1] - np.repeat(s[start], many)
        word *= np.repeat(q[start], many)
        word ^= word >> np.uint64(29)
        word *= np.uint64(0xBF58476D1CE4E5B9)
        # a phrase ends after a word that three words' hash chooses, one in PHRASE_WORDS, and with its text
        done = np.flatnonzero(_text.SPACE[symbols] & ~opens)
        three = _text.gram_hashes(word[done], 3) & np.uint64(PHRASE_WORDS - 1)
        ends = done[2:][three == 0]
        text = np.searchsorted(at, ends, "right")
        first = np.searchsorted(done, at[:-1])  # a text's first word that ends before a space
        ends = ends[(np.searchsorted(done, ends) >= first[text - 1] + 2) & (ends > skip)]
        stops = np.sort(np.concatenate((ends, at[1:])))
        starts = np.concatenate(([skip], stops[:-1]))
        raw = (s[stops] - s[starts]) * q[starts]
        if part is not None and part.length:
            raw[0] = np.uint64((part.hash + pow(_text._BASE, part.length, 1 << 64) * int(raw[0])) % (1 << 64))
        if not last:
            part.hash, part.length = int(raw[-1]), int(stops[-1] - starts[-1]) + (part.length if len(raw) == 1 else 0)
            stops, raw = stops[:-1], raw[:-1]
        phrases = _text.mixed(raw)
        if of_pair is None:
            return Lanes(symbols[:0], [], at, stops, phrases)
        b2, b3, b4 = (_before(symbols, at, k) for k in (2, 3, 4))
        tree = np.take(of_pair, b2 << 8 | b1)
        three = b3 << 16 | b2 << 8 | b1
        contexts = [three * np.uint32(0x85EBCA6B), (three | b4 << 24) * np.uint32(0xC2B2AE35), (word >> np.uint64(32)).astype(np.uint32) + tree.astype(np.uint32) * NODE_FACTOR]
        for h, size in zip(contexts, SLOTS[1:]):
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h >>= np.uint32(33 - size.bit_length())
    at = np.maximum(at - skip, 0)
    return Lanes((tree << 8 | symbols)[skip:], [h[skip:].view(np.int32) for h in contexts], at, stops - skip, phrases)


def decisions(t: Trees, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where each symbol's decisions begin; the symbol that each decision is of, its node and its bit."""
    code = np.take(t.code, key, mode="clip")
    count = code & 0xFF
    begin = np.cumsum(count) - count
    of = np.repeat(np.arange(len(key)), count)
    path = np.take((code >> 8) - begin, of, mode="clip")
    path += np.arange(len(path))
    step = np.take(t.path, path, mode="clip")
    return begin, of, step >> 1, step & 1


def slots(l: Lanes, of: np.ndarray, node: np.ndarray, pick: np.ndarray | slice):
    """The slot of each decision in each hashed counter: those of one symbol are near each other."""
    near = node & 0xFF
    for places in l.places:
        yield np.take(places[pick], of, mode="clip") ^ near


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def lane_edges(size: int) -> list[int]:
    """Where a text's own weights and refinement are updated: often at its start, less so as it goes on."""
    edges = [x for x in (0, 32, 64, 128, 256) if x < size]
    while edges[-1] + LANE_BYTES < size and edges[-1] < 16 * LANE_BYTES:
        edges.append((edges[-1] // LANE_BYTES + 1) * LANE_BYTES)
    while edges[-1] + 4 * LANE_BYTES < size:
        edges.append(edges[-1] + 4 * LANE_BYTES)
    return [*edges, size]


#: The middle of each bucket of a text's own refinement, as a probability.
_CENTRES = squash((np.arange(OWN_BUCKETS) + 0.5 - OWN_BUCKETS / 2) * (BUCKETS / OWN_BUCKETS) / 4)


class Mixer:
    """Gated weights over the predictors' log-odds, then refinements of the mixed probability: one that all texts share, by tree, and
    the text's own. A text's weights and refinement are fed back as it goes by; learning, so are the shared ones."""

    def __init__(self, t: Trees, tables: list[np.ndarray], weights: np.ndarray, refined: np.ndarray):
        self.trees, self.tables, self.weights, self.refined = t, tables, weights, refined
        self.hits = np.zeros((TREES * BUCKETS, 2))
        self.prior = refined
        self.steps, self.mean = 0, np.zeros_like(weights)

    def run(self, l: Lanes, learn: bool, part: Part | None = None) -> np.ndarray:
        """Log2 probability of each symbol. A text starts from the shared weights and refinement and adds its own corrections,
        updated at lane_edges from the errors so far; texts move on side by side. A long text's part goes on from the one before."""
        sizes = np.diff(l.offsets)
        gains = np.zeros(len(l.key), np.float32)
        order = np.argsort(-sizes, kind="stable")
        own, tally = np.zeros((len(sizes), INPUTS), np.float32), np.zeros((len(sizes), OWN_BUCKETS, 2), np.float32)
        done_before = part.at if part is not None else 0
        if done_before:
            own, tally = part.own, part.tally
        edges = lane_edges(done_before + int(sizes.max())) if len(l.key) else [0]
        edges = [0, *(e - done_before for e in edges if e > done_before)] if done_before else edges
        for low, high in zip(edges, edges[1:]):
            live = order[: np.searchsorted(-sizes[order], -low)]
            many = np.minimum(sizes[live], high) - low
            done = np.cumsum(many)
            i = 0
            while i < len(live):
                j = max(i + 1, int(np.searchsorted(done, done[i] - many[i] + STEP_BYTES, "right")))
                texts, n = live[i:j], many[i:j]
                edge = np.cumsum(n)
                pick = np.arange(edge[-1]) + np.repeat(l.offsets[texts] + low - (edge - n), n)
                gains[pick], own[texts], tally[texts] = self._step(l, pick, edge, own[texts], tally[texts], learn)
                i = j
        if part is not None:
            part.own, part.tally, part.at = own, tally, done_before + len(l.key)
        return gains

    def _step(self, l: Lanes, pick: np.ndarray, edge: np.ndarray, own: np.ndarray, tally: np.ndarray, learn: bool):
        begin, of, node, bit = decisions(self.trees, l.key[pick])
        first = np.take(begin, np.concatenate(([0], edge[:-1])))
        n = np.diff(np.append(first, len(of)))
        seen = [np.take(self.trees.counter, node, mode="clip"), *(np.take(table, s, mode="clip") for table, s in zip(self.tables, slots(l, of, node, pick)))]
        gate = (seen[2] & 3) << 2 | (seen[3] & 3)
        # the weights in force: those of the gate and the text's own corrections
        text = np.repeat(np.arange(len(own)), n)
        which = text * GATES
        which += gate
        force = (self.weights[None] + own[:, None]).reshape(-1, INPUTS).T / np.float32(STEP)
        z = np.zeros(len(node), np.float32)
        x = []
        for k in range(INPUTS):
            v = (seen[k] >> 2).astype(np.float32)
            v -= 32
            x.append(v)
            w = np.take(np.ascontiguousarray(force[k]), which, mode="clip")
            w *= v
            z += w
        p = np.exp(-z)
        p += 1
        np.reciprocal(p, out=p)
        hit = bit.astype(np.float32)
        error = hit - p
        z *= 4
        z += BUCKETS / 2
        np.maximum(z, 0, out=z)
        np.minimum(z, BUCKETS - 1, out=z)
        level = z.astype(np.uint8)
        bucket = node >> 8
        bucket *= BUCKETS
        bucket += level
        mine = text
        mine *= OWN_BUCKETS
        mine += level // np.uint8(BUCKETS // OWN_BUCKETS)
        p *= 2
        p += np.take(self.refined, bucket, mode="clip")
        p += np.take(((tally[..., 1] + OWN_PRIOR * _CENTRES) / (tally[..., 0] + OWN_PRIOR)).astype(np.float32).ravel(), mine, mode="clip")
        p *= 0.25
        np.maximum(p, np.float32(1e-6), out=p)
        np.minimum(p, np.float32(1 - 1e-6), out=p)
        p += hit
        p -= 1
        gain = np.log(np.abs(p, out=p), out=p)
        own, tally = own.copy(), tally.copy()
        hit *= 1 << 20
        hit += 1
        both = np.bincount(mine, hit, tally.size // 2).astype(np.int64)  # how many decisions, and how many ones
        tally += np.stack((both & 0xFFFFF, both >> 20), axis=-1).reshape(tally.shape)
        many = np.bincount(gate, minlength=GATES) + 256.0 if learn else None
        for k in range(INPUTS):
            x[k] *= error
            own[:, k] += OWN_RATE / STEP * np.add.reduceat(x[k], first) / n
            if learn:
                self.weights[:, k] += RATE / STEP * np.bincount(gate, x[k], GATES) / many
        if learn:
            self.hits[:, 0] += np.bincount(bucket, minlength=len(self.hits))
            self.hits[:, 1] += np.bincount(bucket, bit, len(self.hits))
            self.refined = refined_by(self.hits, self.prior)
            self.steps += 1
            self.mean += self.weights
        return np.add.reduceat(gain, begin) / np.float32(math.log(2)), own, tally


def packed_counts(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Counts of a slot's bits as one byte."""
    odds = np.clip(np.rint(np.log((one + 0.4) / (zero + 0.4)) * STEP), -32, 31).astype(np.int32)
    seen = np.searchsorted(SEEN, zero + one)
    return ((odds + 32) << 2 | seen).astype(np.uint8)


#: What a slot that nothing has filled holds: even odds, nothing seen.
EMPTY = 32 << 2


def start_weights() -> np.ndarray:
    return np.full((GATES, INPUTS), 0.4, np.float32)


def plain_refinement() -> np.ndarray:
    """The refinement that changes nothing: each bucket's own probability."""
    return np.tile(squash((np.arange(BUCKETS) + 0.5 - BUCKETS / 2) / 4), TREES).astype(np.float32)


def refined_by(hits: np.ndarray, prior: np.ndarray) -> np.ndarray:
    return ((hits[:, 1] + 20 * prior) / (hits[:, 0] + 20)).astype(np.float32)


#: Bytes of words: no white space, no END.
WORD = _text.NOT_SPACE.copy()
WORD[END] = False


class _Words:
    """The words of parts in turn, by the hashes that stand for them in all tables. A word that a part's end cuts is kept for the next
    part."""

    def __init__(self):
        self.left = np.zeros(0, np.uint8)

    def of(self, symbols: np.ndarray, at: np.ndarray, skip: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and each text's first of them (n + 1)."""
        raw, edges = symbols[skip:], np.maximum(at - skip, 0)
        if len(self.left) or not last:  # one long text
            raw = np.concatenate((self.left, raw))
            space = np.flatnonzero(_text.SPACE[raw]) if not last else None
            stop = len(raw) if last else int(space[-1]) if len(space) else 0
            raw, self.left, edges = raw[:stop], raw[stop:].copy(), np.array([0, stop])
        starts, ends, first = _text.word_spans(raw, edges, WORD)
        return _text.span_hashes(raw, starts, ends), first


#: What `gathered` counts.
WORDS, TRIPLES, PHRASES, TEXTS = range(4)


def _summed(key: np.ndarray, n: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often they occur: the distinct `key` n times each, and any once at each of its places in `more`."""
    out, place = np.unique(np.concatenate((key, *more)), return_inverse=True)
    total = np.bincount(place[len(key) :], minlength=len(out))
    total[place[: len(key)]] += n
    return out, total


def gathered(source: DataFrame) -> DataFrame:
    """(kind, key, n) over all texts, in one pass: words and phrases by their hash, runs of three symbols, and the texts themselves.
    Tasks add up what they see (at most COUNTED words and phrases at once), the rest is one grouped sum."""

    def run(batches):
        triples, texts, phrases, held, words = np.zeros(1 << 24, np.int32), 0, [], 0, _Words()  # 64 MB
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        seen, fresh, met = none, [], 0
        for _, symbols, at, skip, part, last in parts(batches, SLICE):
            l = lanes(symbols, at, None, skip, part, last)
            phrases.append(l.phrases)
            held += len(l.phrases)
            np.add.at(triples, ((_before(symbols, at, 2) << 16 | _before(symbols, at, 1) << 8) | symbols)[skip:].astype(np.intp), np.int32(1))
            fresh.append(words.of(symbols, at, skip, last)[0])
            met += len(fresh[-1])
            texts += last * (len(at) - 1)
            if met > COUNTED:
                seen, fresh, met = _summed(*seen, fresh), [], 0
            if len(seen[0]) > COUNTED:
                yield _found(WORDS, *seen)
                seen = none
            if held > COUNTED:
                yield _found(PHRASES, *np.unique(np.concatenate(phrases), return_counts=True))
                phrases, held = [], 0
        if texts:
            yield _found(WORDS, *_summed(*seen, fresh))
            yield _found(PHRASES, *np.unique(np.concatenate([np.zeros(0, np.uint64), *phrases]), return_counts=True))
            have = np.flatnonzero(triples)
            yield _found(TRIPLES, have, triples[have])
            yield _found(TEXTS, np.zeros(1, np.int64), [texts])

    found = source.select("text").mapInArrow(run, "kind int, key bigint, n bigint")
    return cut(found.groupBy("kind", "key").agg(F.sum("n").alias("n")))


def _found(kind: int, key: np.ndarray, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.astype(np.uint64).view(np.int64)), pa.array(n, pa.int64())], names=["kind", "key", "n"])


def learnt_trees(counts: DataFrame) -> Trees:
    """The driver gets 65,536 counts of pairs and TREES * 256 of symbols by tree at most."""
    triples = counts.where(F.col("kind") == TRIPLES).select(F.shiftright("key", 8).cast("int").alias("pair"), (F.col("key") % 256).cast("int").alias("symbol"), "n")
    pairs = np.zeros(65536, np.int64)
    for r in triples.groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[r["pair"]] = r["n"]
    of_pair = np.tile(np.arange(256, dtype=np.int32), 256)
    common = np.argsort(-pairs, kind="stable")[:PAIR_TREES]
    common = common[pairs[common] > 0]
    of_pair[common] = 256 + np.arange(len(common))
    own = counts.sparkSession.createDataFrame([(int(p), 256 + i) for i, p in enumerate(common)] or [(-1, 0)], "pair int, tree int")
    by_tree = triples.join(F.broadcast(own), "pair", "left").groupBy(F.coalesce("tree", F.col("pair") % 256).alias("tree"), "symbol").agg(F.sum("n").alias("n")).toPandas()
    found = np.zeros((TREES, 256), np.int64)
    found[by_tree["tree"].to_numpy(), by_tree["symbol"].to_numpy()] = by_tree["n"].to_numpy()
    return trees(of_pair, found)


def _counters(source: DataFrame, t: Trees) -> list[np.ndarray]:
    """Each counter's slots, from counts over all texts. Tasks sum their own; blocks are summed over groups of tasks, then over all."""
    shared = source.sparkSession.sparkContext.broadcast(t)

    def count(batches):
        own = [np.zeros(2 * size, np.int32) for size in SLOTS[1:]]  # 42 MB, whatever the task reads
        group = TaskContext.get().partitionId() % SUMMED
        for _, symbols, at, skip, part, last in parts(batches, SLICE):
            l = lanes(symbols, at, shared.value.of_pair, skip, part, last)
            for i in range(0, len(l.key), STEP_BYTES):
                pick = slice(i, i + STEP_BYTES)
                _, of, node, bit = decisions(shared.value, l.key[pick])
                for total, s in zip(own, slots(l, of, node, pick)):
                    s *= 2
                    s += bit
                    np.add.at(total, s, np.int32(1))
        for k, total in enumerate(own):
            for b in range(len(total) // (2 * BLOCK)):
                part = total[b * 2 * BLOCK : (b + 1) * 2 * BLOCK]
                if part.any():
                    yield _block(k * 1000 + b, group, part)

    def add(last: bool):
        def run(batches):
            key, total = None, None
            for batch in batches:
                for b, g, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    if key is None or b != key[0] or (g != key[1] and not last):
                        if key is not None:
                            yield done(*key, total)
                        key, total = (b, g), np.zeros(2 * BLOCK, np.int64)
                    own = np.frombuffer(zstandard.ZstdDecompressor().decompress(c.as_buffer()), np.int32)
                    total += own if len(own) == 2 * BLOCK else own.view(np.int64)
            if key is not None:
                yield done(*key, total)

        def done(block, group, total):
            return _block(block, group, packed_counts(total[::2], total[1::2]) if last else total)

        return run

    kind = "block int, part int, counts binary"
    tasks = source.select("text").mapInArrow(count, kind)
    groups = tasks.repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(add(False), kind)
    summed = groups.repartition("block").sortWithinPartitions("block").mapInArrow(add(True), kind)
    out = [np.full(size, EMPTY, np.uint8) for size in SLOTS[1:]]
    for r in summed.collect():  # sum(SLOTS[1:]) bytes at most
        k, b = divmod(r["block"], 1000)
        out[k][b * BLOCK : (b + 1) * BLOCK] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["counts"]), np.uint8)
    return out


def _block(block: int, group: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([group], pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(counts.tobytes())], pa.binary())], names=["block", "part", "counts"])


def _weights(source: DataFrame, t: Trees, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights (the mean of those that tasks learn online, by decisions) and the refinement."""
    shared = source.sparkSession.sparkContext.broadcast((t, tables))

    def run(batches):
        mixer = Mixer(*shared.value, start_weights(), plain_refinement())
        for _, symbols, at, skip, part, last in parts(batches, SLICE):
            mixer.run(lanes(symbols, at, mixer.trees.of_pair, skip, part, last), True, part)
        if mixer.steps:
            n = float(mixer.hits[:, 0].sum())
            flat = np.concatenate([(mixer.mean / mixer.steps).ravel() * n, mixer.hits.ravel()])
            have = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array(flat[have])], names=["i", "x"])

    flat = np.zeros(GATES * INPUTS + 2 * TREES * BUCKETS)
    for r in source.select("text").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        flat[r["i"]] = r["x"]
    hits = flat[GATES * INPUTS :].reshape(-1, 2)
    n = hits[:, 0].sum()
    weights = (flat[: GATES * INPUTS] / n).reshape(GATES, INPUTS).astype(np.float32) if n else start_weights()
    return weights, refined_by(hits, plain_refinement())


def train(source: DataFrame, counts: DataFrame):
    """(trees, counters, weights, refinement) learnt from rows (fold, text) whose fold isn't 0, and what `gathered` counted in them.

    All of them shape the trees and their nodes' counts, folds 1 to 8 fill the hashed counters, fold 9, which those haven't seen,
    teaches the weights and the refinement. This part of the model is of a fixed size; words and phrases are as many as the corpus has.
    """
    t = learnt_trees(counts)
    tables = _counters(source.where("fold BETWEEN 1 AND 8"), t)
    return t, tables, *_weights(source.where("fold = 9"), t, tables)


def _head(counts: DataFrame, most: int) -> tuple[DataFrame, np.ndarray]:
    """counts (kind, key, n) but for at most `most` of the commonest, and those as sorted (key, n).
    A key that isn't among them has less than 1 / most of all occurrences, so none is hot in a join."""
    by = counts.withColumn("bucket", F.floor(F.log2("n") * 16).cast("int"))
    sizes = sorted(by.groupBy("bucket").agg(F.count("*").alias("n")).collect(), reverse=True)  # 16 rows for each doubling
    least, taken = sizes[0]["bucket"] + 1 if sizes else 0, 0
    for r in sizes:
        if taken + r["n"] > most:
            break
        least, taken = r["bucket"], taken + r["n"]
    common = by.where(F.col("bucket") >= least).select("key", "n").toPandas().sort_values("key")
    return by.where(F.col("bucket") < least).drop("bucket"), common.to_numpy(np.int64).reshape(-1, 2)


def _among(common: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are among the sorted (key, n), and n."""
    if not len(common):
        return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
    place = np.minimum(np.searchsorted(common[:, 0], key), len(common) - 1)
    known = common[place, 0] == key
    return known, np.where(known, common[place, 1], 0)


def mixed_in(bits: np.ndarray, n: np.ndarray, of: int) -> np.ndarray:
    """What phrases gain in log2 probability by their counts n among `of`: they get PHRASE_SHARE of it, their symbols the rest."""
    own = bits + math.log2(1 - PHRASE_SHARE)
    with np.errstate(divide="ignore"):
        return np.where(n > 0, np.logaddexp2(np.log2(np.maximum(n, 1e-300) * (PHRASE_SHARE / max(of, 1))), own) - own, 0.0)


def score(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    score is the log10 probability of the whole lower-cased text (A-Z) and its end under the mixed model; base_score that of its
    words and end under the smoothed unigrams. A phrase's probability is PHRASE_SHARE of its share of all phrases of training rows
    (but for the row's own, if it is one of them) and the rest by its symbols. The commonest words' and phrases' counts are broadcast
    (HEAD_WORDS, HEAD_PHRASES); all others meet theirs by a join, so nothing is left out.

    Null and empty texts: their end alone. Rows that repeat an id or a text are rows of their own, with equal scores if they are on the
    same side of held_out. Without training rows the model is uniform-like and N and V are 0. An empty table gives an empty one. A text
    above SLICE bytes is worked on in parts, and scores as it would as a whole (words of more than some 13 kB that a part cuts aside).
    """
    spark = docs.sparkSession
    source = docs.select(fold(id_column).alias("fold"), F.col(text).alias("text"))
    counts = gathered(source.where("fold > 0"))
    model = train(source, counts)
    totals = {r["kind"]: (r["n"], r["v"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    end_count, phrases_in_all = totals.get(TEXTS, (0, 0))[0], totals.get(PHRASES, (0, 0))[0]
    n, v = totals.get(WORDS, (0, 0))[0] + end_count, totals.get(WORDS, (0, 0))[1] + (end_count > 0)
    below = n + 0.1 * (v + 1)
    rare, often = zip(*(_head(counts.where(F.col("kind") == k), most) for k, most in ((WORDS, HEAD_WORDS), (PHRASES, HEAD_PHRASES))))
    shared = spark.sparkContext.broadcast((model, often))
    end_score = math.log10((end_count + 0.1) / below) if below else math.log10(0.5)

    def run(batches):
        (t, tables, weights, refined), (often_words, often_phrases) = shared.value
        mixer, words, long = Mixer(t, tables, weights, refined), _Words(), None
        number = TaskContext.get().partitionId() << 40
        for rows, symbols, at, skip, part, last in parts(batches, SLICE):
            l = lanes(symbols, at, t.of_pair, skip, part, last)
            total = np.concatenate(([0.0], np.cumsum(mixer.run(l, False, part), dtype=np.float64)))
            bits = np.diff(total[np.concatenate(([0], l.stops))])
            if len(bits):
                bits[0] += part.bits
                part.bits = 0.0
            part.bits += 0.0 if last else total[-1] - total[l.stops[-1] if len(l.stops) else 0]
            edges = np.searchsorted(l.stops, l.offsets[1:], "right").tolist()
            key, first = words.of(symbols, at, skip, last)
            kinds, place = np.unique(key, return_inverse=True)
            common, n = _among(often_words, kinds.view(np.int64))
            text, hit = np.repeat(np.arange(len(first) - 1), np.diff(first)), common[place]
            have = np.bincount(text[hit], minlength=len(first) - 1).tolist()
            base = np.bincount(text[hit], np.log10((n + 0.1) / (below or 1.0))[place[hit]], len(first) - 1).tolist()
            # a text's other words, each once
            rest, times = np.unique(text[~hit] * max(1, len(kinds)) + place[~hit], return_counts=True)
            of, rest = np.divmod(rest, max(1, len(kinds)))
            rest, at_rest = kinds[rest].view(np.int64), np.searchsorted(of, np.arange(len(first)))
            out = []
            for k, (w, i, j, x, y) in enumerate(zip(np.diff(first).tolist(), [0, *edges], edges, at_rest.tolist(), at_rest[1:].tolist())):
                out.append([w, have[k], base[k], rest[x:y], times[x:y], l.phrases[i:j], bits[i:j]])
            if long is not None or not last:
                out = [out[0] if long is None else [*(x + y for x, y in zip(long[:3], out[0][:3])), *(np.concatenate((x, y)) for x, y in zip(long[3:], out[0][3:]))]]
                long = None if last else out[0]
            if last:
                yield _rows(rows, out, number, often_phrases, phrases_in_all, end_count, end_score)
                number += rows.num_rows

    source = docs.select(F.col(id_column).alias("doc_id"), (fold(id_column) == 0).alias("held_out"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    kinds = f"doc_id {kind}, held_out boolean, n_bytes bigint, number bigint, whole boolean, n_tokens bigint, have bigint, base double, bits double, rest array<bigint>, times array<bigint>, phrases array<bigint>, own array<bigint>, each array<double>"
    # a row's number is its task's and its place there; the checkpoint holds it fast
    scored = cut(source.mapInArrow(run, kinds))
    of_words = scored.select("number", F.lit(WORDS).alias("kind"), F.explode(F.arrays_zip(F.col("rest").alias("key"), F.col("times").alias("own"))).alias("x")).select("number", "kind", "x.key", "x.own", F.lit(0.0).alias("bits"))
    of_phrases = scored.select("number", F.lit(PHRASES).alias("kind"), F.explode(F.arrays_zip(F.col("phrases").alias("key"), "own", F.col("each").alias("bits"))).alias("x")).select("number", "kind", "x.key", "x.own", "x.bits")
    met = of_words.unionByName(of_phrases).join(rare[0].unionByName(rare[1]), ["kind", "key"], "left")
    is_word, n_, own = F.col("kind") == WORDS, F.coalesce("n", F.lit(0)), F.col("own")
    other, symbols = F.log2((n_ - own) * F.lit(PHRASE_SHARE / max(phrases_in_all, 1))), F.col("bits") + F.lit(math.log2(1 - PHRASE_SHARE))
    gain = F.greatest(other, symbols) + F.log2(1 + F.pow(F.lit(2.0), -F.abs(other - symbols))) - symbols
    added = met.groupBy("number").agg(
        F.sum(F.when(is_word, own * F.log10((n_ + 0.1) / F.lit(below or 0.2)))).alias("more"), F.sum(F.when(is_word & (n_ > 0), own)).alias("more_known"), F.sum(F.when(~is_word & (n_ > own), gain)).alias("more_bits")
    )
    out = scored.where("whole").drop("rest", "times", "phrases", "own", "each").join(added, "number", "left")
    bits = F.col("bits") + F.coalesce("more_bits", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("have") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (bits * math.log10(2)).alias("score"), "n_bytes", (-bits / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def _rows(rows: pa.RecordBatch, out: list, number: int, often: np.ndarray, of: int, end_count: int, end_score: float) -> pa.RecordBatch:
    """Texts as rows: what the common words and phrases give at once, and all others as lists, in more rows where they are many."""
    held = rows.column(1).to_pylist()
    text = np.repeat(np.arange(len(out)), [len(x[5]) for x in out])
    phrases, bits = (np.concatenate([x[k] for x in out]) for k in (5, 6))
    with np.errstate(over="ignore"):
        _, at, times = np.unique(_text.mixed(phrases + np.uint64(0x9E3779B97F4A7C15) * (text + 1).astype(np.uint64)), return_inverse=True, return_counts=True)
    own = np.where(np.array(held, bool)[text], 0, times[at])
    key = phrases.view(np.int64)
    known, n = _among(often, key)
    gain = bits + math.log2(1 - PHRASE_SHARE)
    gain[known] += mixed_in(bits[known], (n - own)[known], of)
    total = np.bincount(text, gain, len(out))
    edges = np.searchsorted(text, np.arange(len(out) + 1))
    made = {k: [] for k in ("at", "whole", "n_tokens", "have", "base", "bits", "rest", "times", "phrases", "own", "each")}
    for i, x in enumerate(out):
        left = np.flatnonzero(~known[edges[i] : edges[i + 1]]) + edges[i]
        rest, many = x[3], x[4]
        for j in range(0, max(1, len(rest), len(left)), ROW_ITEMS):
            some, one = left[j : j + ROW_ITEMS], slice(j, j + ROW_ITEMS)
            values = (i, j == 0, x[0] + 1, x[1] + (end_count > 0), x[2] + end_score, total[i], rest[one], many[one], key[some], own[some], bits[some])
            for c, value in zip(made.values(), values):
                c.append(value)
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), *(pa.list_(k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))]
    place = pa.array(made.pop("at"))
    columns = [pa.array(c, k) for c, k in zip(made.values(), kinds)]
    return pa.RecordBatch.from_arrays([*(rows.column(k).take(place) for k in range(3)), pa.array(place.to_numpy() + number), *columns], names=["doc_id", "held_out", "n_bytes", "number", *made])
