"""SimHash near-duplicates, found through deletion-variant signatures."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text, graph
from ._spark import among, cut, gathered, lookup, row_key, without

BITS = 64
#: Values of a group up to this size are compared as pairs at once; larger ones by a search that skips what is linked already. Links
#: of fingerprints are exact, so a search finds every component. Candidates of near-duplicates are not: bunches of more of them that a
#: search joins are given whole, for _across.
PAIRWISE, CANDIDATE_PAIRWISE = 8, 64
#: Pairs that are compared at once (some 64 bytes each).
PAIRS = 1 << 15


def _shingles(words: list[bytes], shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each run of `shingle` words, repeats included; of all words where they are fewer, of nothing where there are none."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([hashed(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, stops = (ends - lengths)[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    return np.fromiter((hashed(joined[i:j], seed) for i, j in zip(starts, stops)), np.uint64, len(starts))


def _fingerprint(words: list[bytes], shingle: int, seed: int) -> int:
    h = _shingles(words, shingle, seed)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 14):
        part = h[i : i + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id, row, fp long) for every row, `row` telling apart texts that share an id: the SimHash of its whole text's word shingles (XXH64), repeats included.

    Words part at ASCII white space after lower-casing A-Z. Fewer words than a shingle: the whole sequence is one shingle; no word
    or null: 0. One pass without a shuffle.
    """

    def run(batches):
        for rows, data, offsets in _text.text_slices(batches, "text"):
            raw = _text.LOWER[data].tobytes()
            fp = np.fromiter((_fingerprint(raw[i:j].split(), shingle, seed) for i, j in zip(offsets[:-1], offsets[1:])), np.uint64, rows.num_rows)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(fp.view(np.int64))], names=["id", "row", "fp"])

    source = docs.select(F.col(id_column).alias("id"), row_key(text).alias("row"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, row bigint, fp bigint")


def _cuts(segments: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    at = [BITS * i // segments for i in range(segments + 1)]
    return [(i, j - i) for i, j in zip(at, at[1:])]


def _signatures(fp: np.ndarray, segments: int, first: int = 0) -> np.ndarray:
    """The keys of fingerprints, one row a key: each segment whole, and each with one bit left out. A key holds the segment (counted
    from `first`), the place of the wildcard (0xFF for none) and the rest."""
    keys = []
    for s, (low, width) in enumerate(_cuts(segments)):
        part = (fp >> np.uint64(low)) & np.uint64((1 << width) - 1)
        top = np.uint64((first + s) << 56)
        keys.append(part | top | np.uint64(0xFF << 48))
        for p in range(width):
            keys.append((part & ~np.uint64(1 << p)) | top | np.uint64(p << 48))
    return np.stack(keys)


class _Verifier:
    """Links among rows that stand under one key. Columns: fingerprint, check (or nothing), node; the last names the row."""

    def __init__(self, segments: int, distance: int, check: int | None, pairwise: int = PAIRWISE):
        self.pairwise = pairwise
        self.cuts, self.segments, self.distance, self.check = _cuts(segments), segments, distance, check

    def near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ok = np.bitwise_count(x[..., 0] ^ y[..., 0]) <= self.distance
        return ok if self.check is None else ok & (np.bitwise_count(x[..., 1] ^ y[..., 1]) <= self.check)

    def spanning(self, rows: np.ndarray, joined: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Links that join all rows near each other into the right components, fewer than rows; memory is linear. `joined` gets the
        nodes of each component."""
        left, out = rows[np.argsort(rows[:, -1], kind="stable")], []
        while len(left) > 1:
            todo, left, own = [left[0]], left[1:], [left[0, -1:]]
            while todo and len(left):
                at = todo.pop()
                hit = self.near(left, at)
                if hit.any():
                    found, left = left[hit], left[~hit]
                    out.append((np.full(len(found), at[-1], np.uint64), found[:, -1]))
                    todo.extend(found)
                    own.append(found[:, -1])
            if len(own) > 1:
                joined.append(np.concatenate(own))
        return out

    def linked(self, keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Links (a, b), and the members (bunch, node) of what a search has joined; keys are sorted."""
        start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.append(start, len(keys)))
        a, b, bunches, nodes = ([np.zeros(0, np.uint64)] for _ in range(4))
        for n in range(2, self.pairwise + 1):
            every = start[size == n]
            i, j = np.triu_indices(n, 1)
            step = max(1, PAIRS // len(i))
            for own in (every[k : k + step] for k in range(0, len(every), step)):
                x, y = rows[(own[:, None] + i).ravel()], rows[(own[:, None] + j).ravel()]
                near = self.near(x, y)
                a.append(x[near, -1])
                b.append(y[near, -1])
        for i, n in zip(start[size > self.pairwise], size[size > self.pairwise]):
            members, place = rows[i : i + n], int(keys[i] >> np.uint64(48)) & 0xFF
            if place < 0xFF:  # without both values of the bit left out, the whole segment's own key has these pairs
                low = self.cuts[int(keys[i] >> np.uint64(56)) % self.segments][0]
                side = (members[:, 0] >> np.uint64(low + place)) & np.uint64(1)
                if side.all() or not side.any():
                    continue
            joined: list[np.ndarray] = []
            for x, y in self.spanning(members, joined):
                a.append(x)
                b.append(y)
            for own in joined:
                bunches.append(np.full(len(own), _text.mixed(keys[i : i + 1] ^ _text.mixed(own[:1]))[0]))
                nodes.append(own)
        return tuple(np.concatenate(x) for x in (a, b, bunches, nodes))


def links(nodes: DataFrame, distance: int = 4, fps: tuple[str, ...] = ("fp",), check: tuple[str, int] | None = None, node: str = "fp") -> DataFrame:
    """(a, b) pairs of distinct nodes with a fingerprint at `distance` bits or fewer (and, where asked, a check value within its own
    distance), enough to join every component. With a check value these are candidates: `member` marks rows that are no pair, but a
    bunch a and a node b of it (_verified).

    Cut into distance // 2 + 1 segments, one segment of a linked pair differs by one bit at most, so the pair shares that segment's
    signature with the right bit left out, or with none. Signatures are shuffled by hash and sorted; each group is verified by
    Hamming distance and, above a few members, yields a spanning set rather than all its pairs.
    """
    segments = distance // 2 + 1
    kept = [check[0], node] if check else []
    columns = ["fp", *(["check", "node"] if check else [])]
    kind = ", ".join(f"{c} bigint" for c in ("key", *columns))
    verifier = _Verifier(segments, distance, *((check[1], CANDIDATE_PAIRWISE) if check else (None,)))

    def sign(batches):
        for batch in batches:
            whole = [c.to_numpy().view(np.uint64) for c in batch.columns]
            for i in range(0, batch.num_rows, 4096):
                part = [c[i : i + 4096] for c in whole]
                for r in range(len(fps)):
                    keys = _signatures(part[r], segments, r * segments)
                    yield pa.RecordBatch.from_arrays([_array(keys.ravel()), *(_array(np.tile(c, len(keys))) for c in (part[r], *part[len(fps) :]))], names=["key", *columns])

    signed = nodes.select(*fps, *kept).mapInArrow(sign, kind)
    found = _verified(signed, verifier)
    return found if check else found.where("NOT member").drop("member")


def _array(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _verified(signed: DataFrame, verifier: _Verifier) -> DataFrame:
    """The links (a, b) among rows (key, then the verifier's columns) that share a key; with `member`, the bunches a and nodes b of
    groups that are too large for all their pairs."""

    def verify(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy().view(np.uint64) for c in batch.columns], axis=1))
            last = held[-1][-1, 0]
            if last == held[0][0, 0] or sum(map(len, held)) < 1 << 17:
                continue
            rows = np.concatenate(held)
            done = int(np.searchsorted(rows[:, 0].view(np.int64), np.int64(last.view(np.int64))))
            held = [rows[done:]]
            yield pairs(rows[:done])
        if held:
            yield pairs(np.concatenate(held))

    def pairs(rows):
        a, b, bunches, nodes = verifier.linked(rows[:, 0], rows[:, 1:]) if len(rows) else (np.zeros(0, np.uint64),) * 4
        member = np.arange(len(a) + len(bunches)) >= len(a)
        return pa.RecordBatch.from_arrays([_array(np.concatenate((a, bunches))), _array(np.concatenate((b, nodes))), pa.array(member)], names=["a", "b", "member"])

    return signed.repartition("key").sortWithinPartitions("key").mapInArrow(verify, "a bigint, b bigint, member boolean")


def clusters(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4, seed: int = 42) -> DataFrame:
    """(id, row, fp, component_id) for every row: component_id is the smallest id reachable through fingerprints at `distance` or fewer.

    Equal fingerprints are one node, so copies add no pairs. Null ids take part but never name a component, unless all its ids are
    null (then it is null). Rows that repeat an id appear as often. An empty table gives an empty one.
    """
    prints = cut(fingerprints(docs, id_column, text, shingle, seed))
    nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("least")))
    return _named(prints, nodes, links(nodes, distance), "fp").select("id", "row", "fp", "component_id")


#: Near-duplicates share this part of all shingles that either of them holds.
SIMILAR = (4, 5)
#: Candidates have near fingerprints of the words, or the same fingerprint of one of PARTS parts.
WORD_SEEDS = (42, 43)
WORD_DISTANCE = 5
#: A part is the PART_SHINGLES shingles that come first in as many random orders: two texts of similarity J share a given part's
#: fingerprint with probability J ** PART_SHINGLES wherever they differ, so at 0.8 all PARTS miss 1 pair in 38,000.
PARTS, PART_SHINGLES = 20, 4
#: One bit of each of the first 64 of these shingles. At 0.8 some 6.4 of them differ, and 21 or more less than once in a million.
CHECK_DISTANCE = 20
_ORDERS = np.random.default_rng(42).integers(0, 1 << 63, (2, PARTS * PART_SHINGLES), dtype=np.uint64)


def _bits(hashes: np.ndarray, weights: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += weights[i : i + (1 << 14)] @ part
    return int(np.packbits(2 * ones > weights.sum(), bitorder="little").view(np.uint64)[0])


def _word_fingerprint(words: list[bytes], seed: int) -> int:
    """SimHash of a text's distinct words, each weighing the bit length of its count; 0 for no words."""
    counted = Counter(words)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in counted), np.uint64, len(counted))
    return _bits(hashes, np.fromiter((n.bit_length() for n in counted.values()), np.int64, len(counted)))


def _parts(distinct: np.ndarray) -> tuple[np.ndarray, int]:
    """The keys of a text's parts, in the form of _signatures, and its check value; `distinct` are its shingles."""
    least = np.full(PARTS * PART_SHINGLES, ~np.uint64(0), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(distinct), 1 << 12):
            np.minimum(least, ((distinct[i : i + (1 << 12), None] ^ _ORDERS[0]) * (_ORDERS[1] << np.uint64(1) | np.uint64(1))).min(axis=0), out=least)
        check = np.packbits((least[:BITS] >> np.uint64(20) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64)[0]
        mixed, own = np.zeros(PARTS, np.uint64), least.reshape(PARTS, PART_SHINGLES)
        for k in range(PART_SHINGLES):
            mixed = _text.mixed(mixed + own[:, k])
    return mixed >> np.uint64(16) | np.arange(PARTS, dtype=np.uint64) << np.uint64(56) | np.uint64(0xFF << 48), int(check)


def _part_links(nodes: DataFrame) -> DataFrame:
    """(a, b) pairs of nodes (node, check, parts) that share a part's key and whose check values are near, and members, as links."""

    def sign(batches):
        for batch in batches:
            if batch.num_rows:
                keys = np.concatenate([np.frombuffer(p.as_buffer(), np.uint64) for p in batch.column(2)])
                check, node = (np.repeat(batch.column(i).to_numpy(), PARTS) for i in (1, 0))
                yield pa.RecordBatch.from_arrays([_array(keys), _array(check), _array(node)], names=["key", "fp", "node"])

    return _verified(nodes.select("node", "check", "parts").mapInArrow(sign, "key bigint, fp bigint, node bigint"), _Verifier(1, CHECK_DISTANCE, None, CANDIDATE_PAIRWISE))


#: Members that meet a copy of their leader's text in one group.
GROUP = 2_000


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets share SIMILAR of all their members."""
    share, of = SIMILAR
    if not len(x) or of * min(len(x), len(y)) < share * max(len(x), len(y)):
        return False
    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return of * both >= share * (len(x) + len(y) - both)


def _verified_pairs(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, id_column: str, text: str, shingle: int) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets are SIMILAR.

    The members b of a leader a meet copies of its text in groups of some GROUP, by hash; a task keeps one leader's shingles at a
    time and passes its members by, so no group is ever held, however many a leader has.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    leaders = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), F.col("a").alias("node"), F.lit(0).alias("role"))
    salted = lookup(pairs, cut(sizes), "a").select("a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("salt"), F.col("b").alias("node"), F.lit(1).alias("role"))
    wanted = lookup(cut(leaders.unionByName(salted)), nodes.select("node", "one"), "node").select("one.id", "one.row", "a", "salt", "role", "node")

    def run(batches):
        leader, own = None, None
        for batch in batches:
            for rows, data, offsets in _text.text_slices([batch], "text"):
                raw, a, b = _text.LOWER[data].tobytes(), [], []
                for lead, salt, role, node, i, j in zip(*(rows.column(c).to_pylist() for c in range(4)), offsets[:-1], offsets[1:]):
                    if role == 0 and leader == (lead, salt):
                        continue  # a repeated row
                    found = np.unique(_shingles(raw[i:j].split(), shingle, 42))
                    if role == 0:
                        leader, own = (lead, salt), found
                    elif _alike(own, found):
                        a.append(lead)
                        b.append(node)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    texts = among(docs, wanted, id_column, text).select("a", "salt", "role", "node", F.col("_among_text").alias("text"))
    return texts.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(run, "a bigint, b bigint")


#: What a group of a bunch's texts weighs: a text counts 1 and as much again for each ACROSS_SHINGLES of its shingles, so that a task,
#: which holds two groups, has some 10 MB of shingles at most besides a single text's.
ACROSS, ACROSS_SHINGLES = 512, 1024


def _leaders(pairs: DataFrame, members: DataFrame, roots: DataFrame, rows: int) -> DataFrame:
    """(a, b): for each component (roots: node, root) of candidate pairs, the node a that stands in most bunches, then pairs, and each
    other node b: the text that many are edits of, if there is one."""
    one, no = F.lit(1), F.lit(0)
    seen = members.select("node", one.alias("m"), no.alias("p")).unionByName(pairs.select(F.explode(F.array("a", "b")).alias("node"), no.alias("m"), one.alias("p")))
    counts = gathered(seen, rows).groupBy("node").agg(F.sum("m").alias("m"), F.sum("p").alias("p"))
    best = roots.join(counts, "node").groupBy("root").agg(F.max(F.struct("m", "p", "node"))["node"].alias("a"))
    return lookup(roots, cut(best), "root").where("a <> node").select("a", F.col("node").alias("b"))


def _bunches(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(bunch, node, whole): the bunches (members: bunch, node) whose nodes are compared with each other. Those of one component of
    candidates (roots: node, root) that overlap so much that all their pairs are more than those of all its nodes are one, the component
    (`whole`). A bunch lies in one component, so its least node tells which: memberships meet nothing by node."""
    sizes = cut(members.groupBy("bunch").agg(F.min("node").alias("node"), F.count("*").cast("double").alias("n")).join(roots, "node").select("bunch", "root", "n"))
    squares = sizes.groupBy("root").agg(F.sum(F.col("n") * F.col("n")).alias("squares"))
    whole = cut(roots.groupBy("root").agg(F.count("*").cast("double").alias("n")).join(squares, "root").where("squares >= n * n").select("root"))
    apart = sizes.join(whole, "root", "left_anti").select("bunch")
    return cut(lookup(roots, whole, "root").select(F.col("root").alias("bunch"), "node", F.lit(True).alias("whole")).unionByName(lookup(members, cut(apart), "bunch").select("bunch", "node", F.lit(False).alias("whole"))))


def _across(docs: DataFrame, nodes: DataFrame, bunches: DataFrame, similar: DataFrame, id_column: str, text: str, shingle: int) -> DataFrame:
    """(a, b) pairs of nodes of one bunch (bunches: bunch, node) that are SIMILAR, enough to join all that the pairs `similar` don't join.

    A bunch that is joined by now needs nothing. Any other is cut by hash into groups, first those of its largest joined part, then those
    of all other nodes, and each two of them meet in a tile, but for two of the first: texts are copied once a group that they meet, and
    every pair is compared of which check values are near.
    """
    roots = graph.components(similar).withColumnRenamed("node", "_node")
    named = cut(bunches.join(roots, F.col("node") == F.col("_node"), "left").select("bunch", "node", F.coalesce("root", "node").alias("root")))
    parts = named.groupBy("bunch", "root").agg(F.count("*").alias("n")).groupBy("bunch").agg(F.count("*").alias("parts"), F.max(F.struct("n", "root"))["root"].alias("most"))
    named = lookup(named, cut(parts.where("parts > 1").select("bunch", "most")), "bunch").withColumn("joined", F.col("root") == F.col("most"))
    own = cut(lookup(cut(named), nodes.select("node", "one", "check", "size"), "node"))
    weight = F.lit(1) + F.col("size") / ACROSS_SHINGLES
    groups = own.groupBy("bunch").agg(*[F.ceil(F.sum(F.when(F.col("joined") == of, weight)) / ACROSS).cast("int").alias(name) for of, name in ((True, "first"), (False, "rest"))])
    mine = F.when(F.col("joined"), F.pmod(F.xxhash64("node"), F.col("first"))).otherwise(F.col("first") + F.pmod(F.xxhash64("node"), F.col("rest"))).cast("int")
    others = F.sequence(F.when(F.col("joined"), F.col("first")).otherwise(0), F.col("first") + F.col("rest") - 1)
    dealt = lookup(own, cut(groups), "bunch").withColumn("mine", mine).withColumn("other", F.explode(others))
    wanted = dealt.select("one.id", "one.row", "bunch", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "node", "root", "check")
    rows = among(docs, wanted, id_column, text).select("bunch", "x", "y", "mine", "node", "root", "check", F.col("_among_text").alias("text"))

    def run(batches):
        tile, held = None, {}
        for batch in batches:
            for part, data, offsets in _text.text_slices([batch], "text"):
                raw = _text.LOWER[data].tobytes()
                for *at, mine, node, root, check, i, j in zip(*(part.column(c).to_pylist() for c in range(7)), offsets[:-1], offsets[1:]):
                    if at != tile:
                        yield from _joining(_tile(tile, held), held)
                        tile, held = at, {}
                    if node not in held:  # else a repeated row
                        held[node] = mine, root, check, np.unique(_shingles(raw[i:j].split(), shingle, 42))
        yield from _joining(_tile(tile, held), held)

    return rows.repartition("bunch", "x", "y").sortWithinPartitions("bunch", "x", "y").mapInArrow(run, "a bigint, b bigint").distinct()


def _tile(tile: list | None, held: dict[int, tuple]):
    """The SIMILAR pairs across roots of a tile's two groups (or within its one); held: node -> group, root, check value, shingles."""
    if not held:
        return
    share, of = SIMILAR
    node, mine, root, check = (np.array(x, np.int64) for x in (list(held), *([v[k] for v in held.values()] for k in range(3))))
    sets, check = [v[3] for v in held.values()], check.view(np.uint64)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    second, a, b = np.flatnonzero((mine == tile[2]) & (size > 0)), [], []
    for i in np.flatnonzero((mine == tile[1]) & (size > 0)).tolist():
        j = second[node[second] > node[i]] if tile[1] == tile[2] else second
        j = j[(root[j] != root[i]) & (np.bitwise_count(check[j] ^ check[i]) <= CHECK_DISTANCE) & (of * np.minimum(size[j], size[i]) >= share * np.maximum(size[j], size[i]))]
        if len(j):
            both = _shared(sets[i], [sets[k] for k in j.tolist()])
            j = j[of * both >= share * (size[i] + size[j] - both)]
            a += np.minimum(node[i], node[j]).tolist()
            b += np.maximum(node[i], node[j]).tolist()
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _joining(batches, held: dict[int, tuple]):
    """Those of a tile's pairs (batches of a, b) that join what roots and the pairs before them don't: fewer than the tile has roots."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for batch in batches:
        kept = []
        for k, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            x, y = top(held[a][1]), top(held[b][1])
            if x != y:
                up[x] = y
                kept.append(k)
        yield batch.take(pa.array(kept, pa.int64()))


def _shared(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many members each of `others` shares with `own`; all are sorted sets with members, passed by in runs of some PAIRS of them."""
    out, at = [], 0
    while at < len(others):
        to, n = at, 0
        while to < len(others) and (to == at or n + len(others[to]) <= PAIRS):
            n, to = n + len(others[to]), to + 1
        run = np.concatenate(others[at:to])
        hit = own[np.minimum(np.searchsorted(own, run), len(own) - 1)] == run
        starts = np.cumsum([0, *map(len, others[at : to - 1])])
        out.append(np.add.reduceat(hit.astype(np.int64), starts))
        at = to
    return np.concatenate(out)


def _similar(docs: DataFrame, nodes: DataFrame, found: DataFrame, id_column: str, text: str, shingle: int) -> DataFrame:
    """(a, b) pairs of nodes whose shingle sets are SIMILAR, enough to join every component, given candidates `found`.

    First all candidates that hang together are compared with one among them (_leaders), one comparison each. Then those candidate
    pairs are compared of which not both are like that one. In bunches, whose candidates are a spanning set, all pairs that aren't joined
    by then are compared as well; pairs of a component that is compared whole are among these.
    """
    low, high = (F.when(F.col("member"), F.col(c)).otherwise(f("a", "b")) for c, f in (("a", F.least), ("b", F.greatest)))
    found = cut(found.select(low.alias("a"), high.alias("b"), "member").distinct())
    rows = found.count()
    found, nodes = gathered(found, rows), gathered(nodes, nodes.count(), 1 << 16)
    members, found = found.where("member").select(F.col("a").alias("bunch"), F.col("b").alias("node")), found.where("NOT member AND a <> b").select("a", "b")
    roots = gathered(cut(graph.components(found)), rows)
    stars = cut(gathered(_leaders(found, members, roots, rows), rows))
    first = gathered(cut(gathered(_verified_pairs(docs, nodes, stars, id_column, text, shingle).distinct(), rows)), rows)
    bunches = None if members.isEmpty() else gathered(_bunches(members, roots), rows)
    if bunches is not None:
        found = gathered(cut(found.join(bunches.where("whole").select(F.col("node").alias("a")), "a", "left_anti")), rows)
    placed = first.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(first.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    ends = found.select("a", "b", F.explode(F.array("a", "b")).alias("node"))
    known = gathered(lookup(gathered(cut(ends), rows), gathered(cut(placed), rows), "node"), rows).groupBy("a", "b").agg(F.count("*").alias("n"))
    left = found.join(known.where("n = 2"), ["a", "b"], "left_anti")
    similar = first.unionByName(_verified_pairs(docs, nodes, gathered(cut(left), rows), id_column, text, shingle))
    if bunches is None:
        return similar
    similar = gathered(cut(similar), rows)
    return similar.unionByName(_across(docs, nodes, bunches.select("bunch", "node"), similar, id_column, text, shingle))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """(id, row, component_id) for every row: groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

    Candidates are texts of which either of two fingerprints of the words is near (WORD_DISTANCE bits, three segments: scattered
    edits), or of which a part's fingerprint is the same (any edits, blocks cut off or added too). Candidates are then compared by
    their shingles themselves; where more than CANDIDATE_PAIRWISE stand under one key, all that aren't joined yet are. Texts without
    words form one group.
    """

    def run(batches):
        for rows, data, offsets in _text.text_slices(batches, "text"):
            raw = _text.LOWER[data].tobytes()
            words = [raw[i:j].split() for i, j in zip(offsets[:-1], offsets[1:])]
            prints = [np.fromiter((_word_fingerprint(w, s) for w in words), np.uint64, len(words)) for s in WORD_SEEDS]
            sets = [np.unique(_shingles(w, shingle, 42)) for w in words]
            parts, checks = zip(*map(_parts, sets))
            prints += [np.array(checks, np.uint64), np.fromiter((xxhash.xxh64_intdigest(x.tobytes()) for x in sets), np.uint64, len(sets)), np.fromiter(map(len, sets), np.uint64, len(sets))]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *map(_array, prints), pa.array([p.tobytes() for p in parts], pa.binary())], names=["id", "row", "fp0", "fp1", "check", "node", "size", "parts"])

    source = docs.select(F.col(id_column).alias("id"), row_key(text).alias("row"), F.col(text).alias("text"))
    prints = cut(source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, row bigint, fp0 bigint, fp1 bigint, check bigint, node bigint, size bigint, parts binary"))
    nodes = cut(prints.groupBy("node").agg(F.min("id").alias("least"), F.min(F.struct("id", "row")).alias("one"), *[F.first(c).alias(c) for c in ("fp0", "fp1", "check", "size", "parts")]))
    found = links(nodes, WORD_DISTANCE, ("fp0", "fp1"), ("check", CHECK_DISTANCE), "node").unionByName(_part_links(nodes))
    similar = _similar(docs, nodes, found, id_column, text, shingle)
    return _named(prints.select("id", "row", "node"), nodes.select("node", "least"), similar, "node").select("id", "row", "component_id")


def _named(prints: DataFrame, nodes: DataFrame, found: DataFrame, node: str) -> DataFrame:
    """prints (id, row, <node>, ...) with component_id, the smallest id of the node's component."""
    roots = graph.components(found)
    members = cut(roots.join(nodes.select(F.col(node).alias("node"), "least"), "node"))
    names = cut(members.groupBy("root").agg(F.min("least").alias("component_id")))
    linked = lookup(members.select("node", "root"), names, "root").select(F.col("node").alias("_node"), "component_id", F.lit(True).alias("_linked"))
    named = nodes.join(linked, F.col(node) == F.col("_node"), "left").select(node, F.when(F.col("_linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    return lookup(prints, cut(named), node)


def survivors(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that name their group of near-duplicates, with the columns of docs: one document of each group.

    Rows that repeat an id and a text are one document and stay together. Rows with a null id stay only where their group has no id.
    """
    found = near_duplicates(docs, id_column, text)
    return without(docs, found.where(~F.col("id").eqNullSafe(F.col("component_id"))), id_column, text)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    return clusters(docs).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
