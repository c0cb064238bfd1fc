"""Quality rules: fixed base rules, then adaptive thresholds per language and source."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import _text
from ._spark import cut

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
MARKS = np.zeros(256, bool)
MARKS[list(b"!\"'()+,-./:;=?@[\\]^_`{}~")] = True
WINDOW = 8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_upper", "n_marks", "n_lines", "n_dup_lines", "n_repeat_words", "n_same_words")
#: Names that no column of a caller's table has.
PRE = "_quality_"

#: Measure: (expression over the counts, lower fence too, least distance of a fence from its quartile).
MEASURES = {
    "symbol_share": ("n_symbols / word_chars", False, 0.02),
    "upper_share": ("n_upper / word_chars", False, 0.15),
    "mark_share": ("n_marks / word_chars", False, 0.10),
    "dup_line_share": ("n_dup_lines / n_lines", False, 0.30),
    "same_share": ("n_same_words / n_words", False, 0.15),
    "repeat_share": ("n_repeat_words / n_words", False, 0.15),
    "word_length": ("word_chars / n_words", True, 1.50),
}
#: Relative accuracy of the quantile sketch: a bucket spans (1 + A) / (1 - A).
ACCURACY = 0.01
#: Fences stand this many interquartile ranges beyond the quartiles.
REACH = 4.0
#: A group's quartiles are blended with those of its language, which count as so many documents more; a language's with those of all.
BLEND = 100
#: Broadcast the thresholds up to so many groups (some 100 bytes each); beyond that, Spark joins them by shuffle.
BROADCAST_GROUPS = 20_000


def _counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    starts, ends, first = _text.word_spans(data, offsets, _text.NOT_SPACE)
    n = len(offsets) - 1
    chars = _text.sums(_text.NOT_SPACE[data] & ((data & 0xC0) != 0x80), offsets)
    raw = data.tobytes()
    lines, dup = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n):
        own = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x and not x.isspace()]
        lines[i], dup[i] = len(own), len(own) - len(set(own))
    h = _text.span_hashes(data, starts, ends)
    same = np.zeros(len(h), np.int64)
    same[1:] = h[1:] == h[:-1]
    same[first[:-1][np.diff(first) > 0]] = 0
    return [np.diff(first), chars, *(_text.sums(own[data], offsets) for own in (SYMBOLS, UPPER, MARKS)), lines, dup, _repeats(h, first), _text.sums(same, first)]


def _repeats(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words in 8-word windows that their text has twice or more."""
    windows = _text.gram_hashes(h, WINDOW)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = np.flatnonzero(text[: len(windows)] == text[WINDOW - 1 :]) if len(windows) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        keys = windows[whole] ^ _text.mixed(text[whole].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    hit = np.zeros(len(keys), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    step = np.zeros(len(h) + 1, np.int64)
    step[whole[hit]] += 1
    np.add.at(step, whole[hit] + WINDOW, -1)
    return _text.sums(np.cumsum(step[:-1]) > 0, first)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts of each whole text in columns that start with PRE; no shuffle.

    Null and empty texts have all counts 0; other columns pass through untouched, whatever their names.
    """

    def run(batches):
        for rows, data, offsets in _text.text_slices(batches, text):
            yield pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, _counts(data, offsets))], names=[*rows.schema.names, *(PRE + c for c in COUNTS)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(PRE + c, T.LongType()) for c in COUNTS)]))


def _measures(df: DataFrame) -> DataFrame:
    own = {c: f"{PRE}{c}" for c in COUNTS}

    def value(expr: str) -> Column:
        a, b = expr.split(" / ")
        return F.when(F.col(own[b]) > 0, F.col(own[a]) / F.col(own[b]))

    return df.withColumns({PRE + m: value(e) for m, (e, _, _) in MEASURES.items()})


def thresholds(measured: DataFrame, lang: str = "lang", source: str = "source", reach: float = REACH, blend: int = BLEND) -> DataFrame:
    """Fences of each measure by (lang, source): `<measure>_low`, `<measure>_high`.

    A sketch is a count by logarithmic bucket (DDSketch: relative accuracy ACCURACY); sketches merge by adding counts, so tasks
    count their own rows and only buckets are shuffled, and those of sources add up to those of a language and of everything.
    Deterministic however rows are dealt out. A group's quartiles weigh as many as it has documents, against `blend` for those of its
    language, so that no size changes the rule. Rows without words take no part. Null languages and sources are groups of their own.
    """
    gamma = (1 + ACCURACY) / (1 - ACCURACY)
    long = _measures(measured).select(
        F.col(lang).alias("lang"), F.col(source).alias("source"),
        F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(PRE + m).alias("x")) for m in MEASURES])).alias("s"),
    ).where("s.x IS NOT NULL")
    bucket = F.when(F.col("s.x") > 0, F.ceil(F.log(F.col("s.x")) / F.lit(math.log(gamma)))).otherwise(F.lit(-(10**9)))
    own = cut(long.groupBy("lang", "source", F.col("s.m").alias("m"), bucket.cast("int").alias("b")).agg(F.count("*").alias("n")))
    levels = (
        own.select(F.lit(0).alias("level"), "lang", "source", "m", "b", "n")
        .unionByName(own.groupBy("lang", "m", "b").agg(F.sum("n").alias("n")).select(F.lit(1).alias("level"), "lang", F.lit(None).cast("string").alias("source"), "m", "b", "n"))
        .unionByName(own.groupBy("m", "b").agg(F.sum("n").alias("n")).select(F.lit(2).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "m", "b", "n"))
    )
    group = ["level", "lang", "source", "m"]
    over = Window.partitionBy(*group)
    ranked = levels.withColumns({"below": F.sum("n").over(over.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(over)})
    value = F.when(F.col("b") > -(10**9), F.pow(F.lit(gamma), F.col("b")) * (2 / (1 + gamma))).otherwise(F.lit(0.0))
    at = {q: F.min(F.when(F.col("below") >= F.ceil(F.col("total") * q), F.struct("b", value.alias("v")))).getField("v") for q in (0.25, 0.75)}
    found = ranked.groupBy(*group).agg(at[0.25].alias("q1"), at[0.75].alias("q3"), F.max("total").alias("total"))
    wider = lambda level, *names: found.where(F.col("level") == level).select(*names, *[F.col(c).alias(f"wide_{c}") for c in ("q1", "q3", "m")])
    mixed = lambda c: ((F.col("total") * F.col(c) + blend * F.col(f"wide_{c}")) / (F.col("total") + blend)).alias(c)
    every = F.broadcast(wider(2))  # one row a measure
    by_lang = found.where("level = 1").join(every, F.col("m") == F.col("wide_m")).select(F.col("lang").alias("wide_lang"), F.col("m").alias("wide_m"), mixed("q1").alias("wide_q1"), mixed("q3").alias("wide_q3"))
    same = F.col("lang").eqNullSafe(F.col("wide_lang")) & (F.col("m") == F.col("wide_m"))
    blended = found.where("level = 0").join(by_lang, same).select("lang", "source", "m", mixed("q1"), mixed("q3"))
    least = F.element_at(F.create_map(*[F.lit(x) for m, (_, _, d) in MEASURES.items() for x in (m, d)]), F.col("m"))
    reached = F.greatest(least, reach * (F.col("q3") - F.col("q1")))
    fences = blended.select("lang", "source", "m", (F.col("q1") - reached).alias("low"), (F.col("q3") + reached).alias("high"))
    return fences.groupBy("lang", "source").agg(*[F.max(F.when(F.col("m") == m, F.col(e))).alias(f"{m}_{e}") for m in MEASURES for e in ("low", "high")])


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """docs with its counts, `_quality_base_failed` and `_quality_kept`.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated 8-word windows. kept: not base_failed and every measure
    within the fences of the row's language and source. Texts are read twice (once for the thresholds) rather than shuffled.
    Null and empty texts fail; equal rows get equal verdicts; an empty table gives an empty one.
    """
    measured = _measures(measure(docs, text))
    fences = cut(thresholds(measure(docs.select(text, lang, source), text), lang, source)).withColumnsRenamed({"lang": PRE + "l", "source": PRE + "s"})
    if fences.count() <= BROADCAST_GROUPS:
        fences = F.broadcast(fences)
    joined = measured.join(fences, F.col(lang).eqNullSafe(F.col(PRE + "l")) & F.col(source).eqNullSafe(F.col(PRE + "s")), "left")
    words, repeats = F.col(PRE + "n_words"), F.col(PRE + "n_repeat_words")
    failed = (words < 20) | (100 * repeats > 30 * words)
    within = F.lit(True)
    for m, (_, both, _) in MEASURES.items():
        x = F.col(PRE + m)
        within &= F.coalesce(x <= fences[f"{m}_high"], F.lit(True))
        if both:
            within &= F.coalesce(x >= fences[f"{m}_low"], F.lit(True))
    return joined.select(*[measured[c] for c in measured.columns], failed.alias(PRE + "base_failed"), (~failed & within).alias(PRE + "kept"))


def keep(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that `judge` keeps, with the columns of docs."""
    return judge(docs, text, lang, source).where(F.col(PRE + "kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """One row per document: the counts, base_failed and kept."""
    judged = judge(docs.select("doc_id", "text", "lang", "source"))
    return judged.select("doc_id", *[F.col(PRE + c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])
