"""Secret scans: base patterns, and spans that look random under character Markov models. DataFrame functions only."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The base kinds in listed order, their patterns, the group whose length counts, the least length.
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
KINDS = (*BASE, "markov")
#: What the models look at: runs of these characters, of this length at least.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Words that count as ordinary identifiers in training.
IDENTIFIER = r"[A-Za-z][A-Za-z0-9_]{7,}"
#: Characters the models tell apart; any other is one more.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Mean log-likelihood ratio (nats a character) above which a run counts as random.
LEAST_RATIO = 0.7
#: Documents from which labelled samples are taken: those with the least hashed ids.
SAMPLE_DOCS = 20_000
#: Beyond any text; code points of the pages that a text is cut into where pieces of it are read.
END = (1 << 31) - 1
PAGE = 1024


def _texts(docs: DataFrame, text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _higher(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _lower(a: Column, b: Column) -> Column:
    return F.least(a, b)


#: Numbers that a running combination takes at once, and levels of such blocks.
RUN, RUN_LEVELS = 64, 2


def _running(values: Column, combine: Callable[[Column, Column], Column], start: int, levels: int = RUN_LEVELS) -> Column:
    """For each of an array's integers, the combination of those before it. Blocks of RUN are combined by themselves and then with
    what stands before them, so that time is linear in the array's length."""
    none = F.expr("cast(array() AS array<int>)")
    if not levels:
        grown = lambda a, x: F.struct(combine(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(values, F.struct(F.lit(start).alias("at"), none.alias("out")), grown, lambda a: a["out"])
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")), lambda b: F.slice(values, b * RUN + 1, F.lit(RUN)))

    def joined(cut: Column) -> Column:
        totals = F.transform(cut, lambda b: F.aggregate(b, F.lit(start), combine))
        before = _bind(totals, lambda t: _running(t, combine, start, levels - 1))
        both = F.transform(F.arrays_zip(cut.alias("block"), before.alias("before")), lambda z: F.transform(_running(z["block"], combine, start, 0), lambda x: combine(z["before"], x)))
        return F.flatten(both)

    return F.when(F.size(values) > 0, _bind(blocks, joined)).otherwise(none)


def _places(text: Column, pattern: str, kind: str, group: int, least: int) -> Column:
    """All leftmost non-overlapping matches as structs of start, stop (code points, end exclusive), kind and value, failing ones dropped."""
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    values = F.regexp_extract_all(text, p, F.lit(group)) if group else found
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), found.alias("hits"), values.alias("values"))

    def placed(x: Column) -> Column:
        steps = F.transform(F.arrays_zip(x["gaps"].alias("gap"), x["hits"].alias("hit")), lambda z: F.length(z["gap"]) + F.coalesce(F.length(z["hit"]), F.lit(0)))
        before = _bind(steps, lambda s: _running(s, lambda a, b: a + b, 0))
        rows = F.filter(F.arrays_zip(x["gaps"].alias("gap"), x["hits"].alias("hit"), x["values"].alias("value"), before.alias("before")), lambda z: F.length(z["value"]) >= least)
        start = lambda z: z["before"] + F.length(z["gap"])
        return F.transform(rows, lambda z: F.struct(start(z).alias("start"), (start(z) + F.length(z["hit"])).alias("stop"), F.lit(kind).alias("kind"), z["value"].alias("value")))

    none = F.expr("cast(array() AS array<struct<start:int,stop:int,kind:string,value:string>>)")
    return F.when(text.rlike(pattern), _bind(parts, placed)).otherwise(none)


def base_spans(docs: DataFrame, text: str = "text", into: str = "_secret_base") -> DataFrame:
    """docs with an array of base spans per text, by start and then kind as listed."""
    t = _texts(docs, text)
    every = F.concat(*[_places(t, p, k, g, n) for k, (p, g, n) in BASE.items()])
    return docs.withColumn(into, _ordered(every))


def _ordered(spans: Column) -> Column:
    rank = {k: i for i, k in enumerate(KINDS)}

    def key(x: Column) -> Column:
        place = F.lit(len(KINDS))
        for k, i in rank.items():
            place = F.when(x["kind"] == k, i).otherwise(place)
        return F.struct(x["start"].alias("start"), place.alias("place"), x["stop"].alias("stop"), x["kind"].alias("kind"), x["value"].alias("value"))

    return F.transform(F.array_sort(F.transform(spans, key)), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"), x["value"].alias("value")))


def samples(docs: DataFrame, id_column: str = "doc_id", text: str = "text", most_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(value, random) from the documents of least hashed id: values that base rules catch, also written as upper-case hex and base64,
    are random; distinct words of eight characters or more without a base span in their text are ordinary."""
    pick = docs.select(F.col(id_column).alias("_pick")).distinct().orderBy(F.xxhash64("_pick"), "_pick").limit(most_docs)
    texts = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(pick), F.col("_id").eqNullSafe(F.col("_pick")), "left_semi")
    spans = base_spans(texts, "_text", "_secret_base")
    value = spans.select(F.explode("_secret_base").alias("s")).select(F.col("s.value").alias("v")).distinct()
    hexed = F.when(F.col("v").rlike("^[0-9a-f]{16,}$") & (F.length("v") % 2 == 0), F.col("v"))
    forms = F.array("v", F.upper(hexed), F.base64(F.unhex(hexed)))
    random = value.select(F.explode(forms).alias("value")).where("value IS NOT NULL").select("value", F.lit(True).alias("random"))
    plain = spans.where("size(_secret_base) = 0").select(F.explode(F.regexp_extract_all("_text", F.lit(IDENTIFIER), F.lit(0))).alias("value")).distinct()
    return random.unionByName(plain.select("value", F.lit(False).alias("random")))


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratios of character pairs (random against ordinary), row by row over ALPHABET and one more; add-one smoothed.

    The result has (len(ALPHABET) + 1) squared numbers whatever the size of the sample; counting is a grouped aggregation.
    """
    size = len(ALPHABET) + 1
    pairs = labelled.select("random", F.explode(F.expr("transform(sequence(1, greatest(length(value) - 1, 1)), i -> substring(value, i, 2))")).alias("p")).where("length(p) = 2")
    coded = pairs.select("random", *[F.expr(f"locate(substring(p, {i}, 1), '{ALPHABET}')").alias(c) for i, c in ((1, "a"), (2, "b"))])
    counted = coded.groupBy("random", "a", "b").agg(F.count("*").alias("n"))
    total = Window.partitionBy("random", "a")
    rows = counted.withColumn("of", F.sum("n").over(total)).collect()  # 2 * size * size rows at most
    table = {r: [[math.log(1 / size)] * size for _ in range(size)] for r in (True, False)}
    for r, a, b, n, of in rows:
        table[r][a][b] = math.log((n + 1) / (of + size))
    for r in (True, False):
        seen = {a: of for x, a, _, _, of in rows if x == r}
        for a, of in seen.items():
            have = {b for x, y, b, _, _ in rows if x == r and y == a}
            for b in range(size):
                if b not in have:
                    table[r][a][b] = math.log(1 / (of + size))
    return [round(table[True][a][b] - table[False][a][b], 4) for a in range(size) for b in range(size)]


def ratio(value: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a string's character pairs."""
    size = len(ALPHABET) + 1
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.call_function("locate", c, F.lit(ALPHABET)))
    total = F.aggregate(
        codes,
        F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("sum")),
        lambda a, c: F.struct(c.alias("before"), F.when(a["before"] < 0, a["sum"]).otherwise(a["sum"] + F.element_at(table, a["before"] * size + c + 1)).alias("sum")),
        lambda a: a["sum"],
    )
    return F.when(F.length(value) > 1, total / (F.length(value) - 1)).otherwise(F.lit(0.0))


def scan(docs: DataFrame, model: list[float], text: str = "text", least_ratio: float = LEAST_RATIO, into: str = "_secret_spans") -> DataFrame:
    """docs with `into`: base spans and those that the models add, by start and then kind. Added spans overlap no base span.

    Null and empty texts have none; spans that start together stand in the order of kinds; rows that repeat each get theirs; an empty
    table gives an empty one. One pass over whole texts, no shuffle, no Python; other columns pass through.
    """
    t = _texts(docs, text)
    based = base_spans(docs, text, "_secret_base")
    base, runs = F.col("_secret_base"), _places(t, CANDIDATE, "markov", 0, 20)
    kind = "struct<start:int,run:int,stop:int,value:string>"
    marked = lambda spans, run: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(run).alias("run"), x["stop"].alias("stop"), F.when(F.lit(bool(run)), x["value"]).alias("value")))
    every = F.array_sort(F.concat(marked(base, 0), marked(runs, 1))).cast(f"array<{kind}>")

    def apart(e: Column) -> Column:
        """Runs that no base span overlaps: those before, as far as they reach, end before the run; the next one starts after it."""
        reach = _bind(F.transform(e, lambda x: F.when(x["run"] == 0, x["stop"]).otherwise(0)), lambda v: _running(v, _higher, 0))
        beyond = _bind(F.transform(F.reverse(e), lambda x: F.when(x["run"] == 0, x["start"]).otherwise(END)), lambda v: _running(v, _lower, END))
        zipped = F.arrays_zip(e.alias("x"), reach.alias("reach"), F.reverse(beyond).alias("next"))
        free = F.filter(zipped, lambda z: (z["x"]["run"] == 1) & (z["reach"] <= z["x"]["start"]) & (z["next"] >= z["x"]["stop"]))
        return F.transform(free, lambda z: F.struct(z["x"]["start"].alias("start"), z["x"]["stop"].alias("stop"), F.lit("markov").alias("kind"), z["x"]["value"].alias("value")))

    added = F.filter(_bind(every, apart), lambda x: x["value"].rlike("[0-9]") & (ratio(x["value"], model) >= least_ratio))
    return based.withColumn(into, F.when(F.size("_secret_base") + F.when(t.rlike(CANDIDATE), 1).otherwise(0) > 0, _ordered(F.concat(base, added))).otherwise(base))


def redact(docs: DataFrame, model: list[float], text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of `scan` replaced by `mark`; overlapping spans are replaced together. Texts without spans stay as they are."""
    scanned = scan(docs, model, text)
    t = F.col(text)

    def piece(pages: Column, low: Column, high: Column) -> Column:
        a, b = F.floor(low / PAGE).cast("int"), F.floor(high / PAGE).cast("int")
        page = lambda i: F.coalesce(F.get(pages, i), F.lit(""))
        ends = F.concat(F.substring(page(a), low - a * PAGE + 1, F.lit(PAGE)), F.array_join(F.slice(pages, a + 2, b - a - 1), ""), F.substring(page(b), F.lit(1), high - b * PAGE))
        return F.when(a == b, F.substring(page(a), low - a * PAGE + 1, high - low)).otherwise(ends)

    def replaced(x: Column) -> Column:
        spans = F.filter(F.arrays_zip(x["spans"].alias("span"), x["reach"].alias("reach")), lambda z: z["span"]["start"] >= z["reach"])
        gaps = F.transform(spans, lambda z: piece(x["pages"], z["reach"], z["span"]["start"]))
        return F.array_join(F.concat(gaps, F.array(piece(x["pages"], F.array_max(x["spans"]["stop"]), F.length(t)))), mark)

    reach = _bind(F.transform("_secret_spans", lambda x: x["stop"]), lambda v: _running(v, _higher, 0))
    walked = _bind(F.struct(F.col("_secret_spans").alias("spans"), reach.alias("reach"), F.regexp_extract_all(t, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0)).alias("pages")), replaced)
    return scanned.withColumn(text, F.when(F.size("_secret_spans") > 0, walked).otherwise(t)).select(*[F.col(f"`{c}`") for c in docs.columns])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    source = docs.select("doc_id", "text")
    scanned = scan(source, train(samples(source)))
    count = lambda kind: F.size(F.filter("_secret_base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(F.col("_secret_base")), 256).alias("base_sha256"), joined(F.col("_secret_spans")).alias("spans"))
