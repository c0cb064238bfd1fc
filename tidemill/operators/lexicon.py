"""Keyword matching against a lexicon table: one pass over a text finds all words of thousands."""

from __future__ import annotations

import unicodedata
from collections import Counter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of words that one automaton holds and that are broadcast at once; a larger lexicon is matched in several passes.
LEXICON_BYTES = 16 << 20

_automata: dict[int, ahocorasick.Automaton] = {}


def _automaton(shared) -> ahocorasick.Automaton:
    """The automaton of a broadcast list of words, made once in each worker."""
    if shared.id not in _automata:
        _automata.clear()
        made = ahocorasick.Automaton()
        for i, w in enumerate(shared.value):
            made.add_word(w, (i, len(w)))
        made.make_automaton()
        _automata[shared.id] = made
    return _automata[shared.id]


class _Words:
    """A broadcast of words with a name to keep their automaton by."""

    def __init__(self, spark, words: list[str]):
        self._broadcast = spark.sparkContext.broadcast(words)
        self.id = self._broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"_broadcast": self._broadcast, "id": self.id}

    @property
    def value(self) -> list[str]:
        return self._broadcast.value


def _word_character(c: str) -> bool:
    return c == "_" or unicodedata.category(c) == "Nd" or c.isalpha()


def _parts(words: DataFrame, most_bytes: int) -> list[list[str]]:
    """Distinct words in lists of about most_bytes each; a lexicon is read by the driver part by part."""
    size = words.agg(F.coalesce(F.sum(F.octet_length("word") + 8), F.lit(0))).first()[0]
    n = max(1, -(-size // most_bytes))
    return [[r[0] for r in words.where(F.pmod(F.xxhash64("word"), F.lit(n)) == i).orderBy("word").collect()] for i in range(n)]


def match(docs: DataFrame, lexicon: DataFrame, id_column: str = "doc_id", text: str = "text", whole_words: bool = True, most_bytes: int = LEXICON_BYTES) -> DataFrame:
    """(id, lexicon, word, n): how often each word of lexicon (lexicon, word) stands in each text; words that don't give no row.

    Texts pass an Aho-Corasick automaton once, however many words there are, and stay where they are read; occurrences may overlap.
    whole_words: no letter, digit or underscore stands on either side. A word of several lexicons counts for each. Null texts and
    words, and empty words, match nothing. The automaton is broadcast up to most_bytes of words; beyond that texts are read again for
    each further part of the lexicon.
    """
    spark, kind = docs.sparkSession, docs.schema[id_column].dataType.simpleString()
    named = lexicon.where("word IS NOT NULL AND word <> ''").select("lexicon", "word").distinct()
    words = named.select("word").distinct()
    source, found = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL"), None
    for part in _parts(words, most_bytes):
        if not part:
            continue
        shared = _Words(spark, part)

        def run(batches, shared=shared):
            known, said = _automaton(shared), shared.value
            for batch in batches:
                ids, word, n = [], [], []
                for at, t in enumerate(batch.column(1)):
                    t = t.as_py()
                    counted: Counter = Counter()
                    for end, (i, size) in known.iter(t):
                        if not whole_words or not (end + 1 < len(t) and _word_character(t[end + 1]) or end >= size and _word_character(t[end - size])):
                            counted[i] += 1
                    ids += [at] * len(counted)
                    word += [said[i] for i in counted]
                    n += counted.values()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(word, pa.string()), pa.array(n, pa.int64())], names=["id", "word", "n"])

        own = source.mapInArrow(run, f"id {kind}, word string, n bigint")
        found = own if found is None else found.unionByName(own)
    if found is None:
        return source.select("id", F.lit("").alias("lexicon"), F.lit("").alias("word"), F.lit(0).cast("long").alias("n")).limit(0)
    return found.join(named, "word").select("id", "lexicon", "word", "n")


def votes(matches: DataFrame) -> DataFrame:
    """(id, lexicon, words, n): of each text the lexicon with the most distinct words, then the most occurrences, then the least name."""
    counted = matches.groupBy("id", "lexicon").agg(F.count("*").alias("words"), F.sum("n").alias("n"))
    best = counted.groupBy("id").agg(F.min(F.struct(-F.col("words"), -F.col("n"), "lexicon", "words", "n")).alias("b"))
    return best.select("id", "b.lexicon", "b.words", "b.n")
