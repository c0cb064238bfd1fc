"""Phrase collocations by Rabin-Karp fingerprints: only phrases that are frequent ever become text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _text
from ._spark import bloom, cut, in_bloom, lookup

#: Words of the longest phrase, occurrences of the rarest, phrases a language.
LONGEST = 5
LEAST = 100
TOP = 2000
#: A candidate goes where a longer one holds it in this share (per cent) of its occurrences.
INSIDE = 100
#: The language of rows that name none.
UNKNOWN = "und"
#: Bytes that part pieces, and those that part words; lower-casing is that of A-Z.
BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?"]] = BREAK[10:14] = True
INWORD = ~BREAK
INWORD[[9, 32]] = False
#: Bits of a fingerprint. Tests narrow it so that fingerprints collide.
BITS = 64


def _grouped(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts f, and where its groups of equal values begin in that order."""
    order = np.argsort(f)
    f = f[order]
    return order, np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1]))) if len(f) else np.zeros(0, np.int64)


def _batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32 if k == "n" else np.int64)) for k, c in zip(names, columns)], names=names)


class _Slice:
    """The words of a run of texts, their pieces and their languages, and the fingerprints of their phrases."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, mask: int):
        self.rows, self.low, self.mask = rows, _text.LOWER[data], np.uint64(mask)
        self.starts, self.ends, first = _text.word_spans(self.low, offsets, INWORD)
        self.count = np.diff(first)
        text = np.repeat(np.arange(rows.num_rows), self.count)
        self.piece = np.searchsorted(np.flatnonzero(BREAK[self.low]), self.starts) + text
        langs = rows.column(1).dictionary_encode()
        self.lang_of, self.langs = langs.indices.to_numpy(zero_copy_only=False)[text], langs.dictionary.to_pylist()
        self.first_lang = langs.indices.to_numpy(zero_copy_only=False)
        self.seeds = [np.array([xxhash.xxh64_intdigest(x.encode(), s) for x in self.langs], np.uint64) for s in (1, 2)]
        self.doc = rows.column(2).to_numpy()[text]
        self._f = _text.Prefixes(_text.span_hashes(self.low, self.starts, self.ends))
        self._c: _text.Prefixes | None = None

    def _keyed(self, g: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _text.mixed(g + seed + np.uint64(n))

    def prints(self, n: int) -> np.ndarray:
        """Fingerprints of the runs of n words by their first word, those that leave a piece too."""
        g = self._f.of(n)
        return self._keyed(g, self.seeds[0][self.lang_of[: len(g)]], n) & self.mask

    def checks(self, n: int) -> np.ndarray:
        """The same from other hashes of the words' bytes."""
        if self._c is None:
            self._c = _text.Prefixes(_text.span_hashes(self.low, self.starts, self.ends, _text.OTHER_BASE), _text.OTHER_BASE)
        g = self._c.of(n)
        return self._keyed(g, self.seeds[1][self.lang_of[: len(g)]], n)

    def inside(self, n: int, m: int) -> np.ndarray:
        """Which of the first m runs of n words stay in a piece."""
        return self.piece[:m] == self.piece[n - 1 : n - 1 + m]

    def phrase(self, i: int, n: int) -> str:
        return b" ".join([self.low[s:e].tobytes() for s, e in zip(self.starts[i : i + n], self.ends[i : i + n])]).decode()

    def totals(self) -> tuple[np.ndarray, ...]:
        """A phrase of no words for each language with words, which occurs once with every word: the language's place among langs,
        fingerprint, check, least document key, occurrences."""
        words = np.bincount(self.first_lang, self.count, len(self.langs)).astype(np.int64)
        doc = np.full(len(self.langs), np.iinfo(np.int64).max)
        np.minimum.at(doc, self.first_lang[self.count > 0], self.rows.column(2).to_numpy()[self.count > 0])
        f = self._keyed(np.zeros(len(self.langs), np.uint64), self.seeds[0], 0) & self.mask
        c = self._keyed(np.zeros(len(self.langs), np.uint64), self.seeds[1], 0).view(np.int64)
        at = np.flatnonzero(words)
        return at, f[at].view(np.int64), c[at], doc[at], words[at]


#: Text bytes whose phrases a task adds up before it sends them on.
COUNTED_BYTES = 1 << 21


def _slices(batches, mask: int) -> Iterator[_Slice]:
    for rows, data, offsets in _text.text_slices(batches, "text", COUNTED_BYTES):
        yield _Slice(rows, data, offsets, mask)


def _counted(source: DataFrame, n: int, known, mask: int, least: int) -> DataFrame:
    """(n, f, k): fingerprints of phrases of n words and their occurrences, where these are `least` at least; with n = 1 also one row
    of n = 0 a language. Phrases are counted where both runs of n - 1 words in them may be frequent."""

    def run(batches):
        for s in _slices(batches, mask):
            f = s.prints(n)
            ok = s.inside(n, len(f))
            if known is not None:
                below = in_bloom(known.value, s.prints(n - 1))
                ok &= below[: len(f)] & below[1 : len(f) + 1]
            f = f[ok]
            order, first = _grouped(f)
            found = [np.full(len(first), n), f[order[first]].view(np.int64), np.diff(np.append(first, len(f)))]
            if n == 1:
                _, g, _, _, words = s.totals()
                found = [np.concatenate(x) for x in zip(found, (np.zeros(len(g), np.int64), g, words))]
            yield _batch(found, ["n", "f", "k"])

    grams = source.mapInArrow(run, "n int, f bigint, k bigint").groupBy("n", "f").agg(F.sum("k").alias("k"))
    return grams.where((F.col("k") >= least) | (F.col("n") == 0))


def _frequent(source: DataFrame, longest: int, least: int, mask: int) -> DataFrame:
    """All frequent phrases' fingerprints, level by level: a phrase can't be more frequent than the two it holds of one word less."""
    spark, found, known = source.sparkSession, None, None
    for n in range(1, longest + 1):
        level = cut(_counted(source, n, known, mask, least))
        found = level if found is None else found.unionByName(level)
        own = level.where(F.col("n") == n)
        if own.isEmpty():
            break
        if n < longest:
            known = spark.sparkContext.broadcast(bloom(own, "f"))
    return found


def _located(source: DataFrame, grams: DataFrame, longest: int, mask: int) -> DataFrame:
    """grams with c0 and c1, the least and the greatest check of their occurrences, and doc, the least document key that holds one."""
    shared = source.sparkSession.sparkContext.broadcast(bloom(grams, "f"))
    names = ["n", "f", "c0", "c1", "doc"]

    def run(batches):
        for s in _slices(batches, mask):
            _, g, c, doc, _ = s.totals()
            yield _batch([np.zeros(len(g)), g, c, c, doc], names)
            for n in range(1, longest + 1):
                f = s.prints(n)
                at = np.flatnonzero(s.inside(n, len(f)) & in_bloom(shared.value, f))
                if len(at):
                    order, first = _grouped(f[at])
                    at = at[order]
                    c, doc = s.checks(n)[at].view(np.int64), s.doc[at]
                    yield _batch([np.full(len(first), n), f[at][first].view(np.int64), *(g.reduceat(x, first) for g, x in ((np.minimum, c), (np.maximum, c), (np.minimum, doc)))], names)

    places = source.mapInArrow(run, "n int, f bigint, c0 bigint, c1 bigint, doc bigint").groupBy("n", "f").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1"), F.min("doc").alias("doc"))
    return grams.join(places, ["n", "f"])


def _pointed(source: DataFrame, grams: DataFrame, longest: int, mask: int) -> DataFrame:
    """(lang, n, phrase, k) of grams, each read from the document that its pointer names. Only those documents are looked at."""
    wanted = cut(grams.select("n", "f", "doc", "k").withColumn("_pair", F.xxhash64("n", "f", "doc")))
    spark = source.sparkSession
    docs_in, prints_in = (spark.sparkContext.broadcast(bloom(wanted, c)) for c in ("doc", "f"))

    def run(batches):
        def pointed():
            for b in batches:
                yield b.filter(pa.array(in_bloom(docs_in.value, b.column(2).to_numpy().view(np.uint64))))

        for s in _slices(pointed(), mask):
            out = []
            for i, f, *_ in zip(*(x.tolist() for x in s.totals())):
                out += [(0, f, s.langs[i], "", d) for d in np.unique(s.doc[s.lang_of == i]).tolist()]
            for n in range(1, longest + 1):
                f = s.prints(n)
                at = np.flatnonzero(s.inside(n, len(f)) & in_bloom(prints_in.value, f))
                at = at[np.lexsort((s.doc[at], f[at]))]
                at = at[np.concatenate(([True], (f[at][1:] != f[at][:-1]) | (s.doc[at][1:] != s.doc[at][:-1])))] if len(at) else at
                out += [(n, g, s.langs[s.lang_of[i]], s.phrase(i, n), d) for i, g, d in zip(at.tolist(), f[at].view(np.int64).tolist(), s.doc[at].tolist())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["n", "f", "lang", "phrase", "doc"])

    texts = source.mapInArrow(run, "n int, f bigint, lang string, phrase string, doc bigint").groupBy("n", "f", "doc").agg(F.min(F.struct("lang", "phrase")).alias("p"))
    return wanted.drop("_pair").join(texts, ["n", "f", "doc"]).select("p.lang", "n", "p.phrase", "k")


def _told_apart(source: DataFrame, grams: DataFrame, longest: int, mask: int, least: int) -> DataFrame:
    """(lang, n, phrase, k) of the phrases whose fingerprints are those of grams, counted by their text."""
    wanted = cut(grams.select("n", "f"))
    shared = source.sparkSession.sparkContext.broadcast(bloom(wanted, "f"))

    def run(batches):
        for s in _slices(batches, mask):
            seen: Counter = Counter()
            for i, f, _, _, k in zip(*(x.tolist() for x in s.totals())):
                seen[0, f, s.langs[i], ""] += k
            for n in range(1, longest + 1):
                f = s.prints(n)
                at = np.flatnonzero(s.inside(n, len(f)) & in_bloom(shared.value, f))
                seen.update((n, g, s.langs[s.lang_of[i]], s.phrase(i, n)) for i, g in zip(at.tolist(), f[at].view(np.int64).tolist()))
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*((*key, k) for key, k in seen.items())), (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["n", "f", "lang", "phrase", "k"])

    texts = source.mapInArrow(run, "n int, f bigint, lang string, phrase string, k bigint").groupBy("n", "f", "lang", "phrase").agg(F.sum("k").alias("k"))
    counted = texts.join(wanted, ["n", "f"], "left_semi")
    return counted.where((F.col("k") >= least) | (F.col("n") == 0)).select("lang", "n", "phrase", "k")


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, bits: int = BITS) -> DataFrame:
    """(lang, n, phrase, k): every phrase of up to `longest` words that occurs `least` times at least within pieces of its language's
    texts, with its occurrences, and one row of n = 0 a language with all its words.

    Tasks hash every word and find each phrase's fingerprint as a difference of prefix polynomials; one shuffle a length adds up
    fingerprints. Lengths are taken in turn, so that only phrases whose parts are frequent are counted; what passes from one length to
    the next is a filter of bounded size. The frequent ones then get a pointer to a document that holds them. A fingerprint whose occurrences don't agree in a
    second, independent hash of their words belongs to several phrases: these are told apart and counted by their text. All others
    become text once, where their pointers lead. Null texts are empty, a null language is UNKNOWN; rows that repeat count each time.
    """
    mask = (1 << bits) - 1
    named = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    source = named.withColumn("doc", F.xxhash64("text", "lang"))
    grams = cut(_located(source, cut(_frequent(source, longest, least, mask)), longest, mask))
    several = grams.where("c0 <> c1")
    found = _pointed(source, grams.where("c0 = c1"), longest, mask)
    if not several.isEmpty():
        found = found.unionByName(_told_apart(source, several, longest, mask, least))
    return found


def _key(lang: str | Column, phrase: Column) -> Column:
    """A language and a phrase as one string, without ambiguity."""
    return F.concat(F.length(lang).cast("string"), F.lit(":"), lang, phrase)


def scored(found: DataFrame, inside: int = INSIDE) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two words or more that no longer one holds in `inside` per cent of their
    occurrences; the score is that of the lowest cut. found is what `phrases` gives and should be cut.

    Parts are looked up by joins in which a part that very many phrases share is broadcast; arithmetic is exact, in decimals.
    """
    words = F.split("phrase", " ")
    of = found.where("n >= 2").select("lang", "phrase", F.col("n").alias("size"), F.col("k").alias("a"))
    held = of.where("size > 2").select("lang", "a", F.explode(F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")).alias("phrase"))
    longer = held.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = of.join(longer, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {inside} * a").drop("longer")
    cuts = left.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    first, rest = F.array_join(F.slice(words, F.lit(1), F.col("cut")), " "), F.array_join(F.slice(words, F.col("cut") + 1, F.col("size") - F.col("cut")), " ")
    keyed = cut(cuts.withColumn("first", _key(F.col("lang"), first)).withColumn("rest", _key(F.col("lang"), rest)))
    parts = cut(found.where("n >= 1").select(_key(F.col("lang"), F.col("phrase")).alias("part"), "k"))
    both = lookup(keyed, parts.select(F.col("part").alias("first"), F.col("k").alias("l")), "first")
    both = lookup(cut(both), parts.select(F.col("part").alias("rest"), F.col("k").alias("r")), "rest")
    every = lookup(cut(both), cut(found.where("n = 0").select("lang", F.col("k").alias("n"))), "lang")
    score = F.expr("(cast(a AS decimal(16, 0)) * cast(1000 AS decimal(4, 0)) * cast(n AS decimal(16, 0))) div (cast(l AS decimal(18, 0)) * cast(r AS decimal(18, 0)))")
    lowest = every.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c"))
    return lowest.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")


def report(docs: DataFrame, top: int = TOP, **options) -> DataFrame:
    """Each language's first `top` phrases by score: lang, rank, phrase, a, l, r, n, score.

    Null and empty texts have no words; a language without a frequent phrase gives no row; equal scores stand by a, then by the
    phrase's bytes; an empty table gives an empty one. Columns other than text and lang don't matter.
    """
    ranked = scored(cut(phrases(docs, **options))).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
