"""Reports with samples: chunk quality, review categories, detectors, multiple-choice answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions import text as X

# --- fixed values ---
SAMPLES, PREVIEW_CHARS = 3, 120
MOST_CHUNK_CHARS, LEAST_CHUNK_CHARS, REPEATED_SENTENCES = 2000, 30, 3
LETTER_CHARS, WRONG, QUESTION_CHARS, RESPONSE_CHARS = 20, 5, 60, 150
# --- end of fixed values ---


def preview(c: Column, most: int = PREVIEW_CHARS) -> Column:
    """A text on one line, cut with an ellipsis."""
    line = F.regexp_replace(X.strip(F.coalesce(c, F.lit(""))), "\n", " ")
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def samples(df: DataFrame, by: list[str], order: list, n: int = SAMPLES) -> DataFrame:
    """The first n rows of each group by order. Each task passes on n rows a group (Spark limits groups before their shuffle), so no
    group is gathered; `order` should name each row once."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def chunk_flags(chunks: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """chunks with a boolean column a fault: too_short, too_long, meaningless, mid_cut, repetition, no_metadata."""
    t = F.col(text)
    # sorted, a sentence that comes so often is equal to the one so many places on; bound to a variable, the split is made once a text
    repeated = F.exists(F.array(F.sort_array(X.split_sentences(t))), lambda s: F.exists(F.zip_with(s, F.slice(s, REPEATED_SENTENCES, F.size(s)), lambda x, y: x.eqNullSafe(y)), lambda same: same))
    return chunks.withColumns({
        "too_short": F.length(X.strip(t)) < LEAST_CHUNK_CHARS, "too_long": F.length(t) > MOST_CHUNK_CHARS, "meaningless": X.junk_ratio(t) > X.JUNK_RATIO,
        "mid_cut": (X.strip(t) != "") & ~X.ends_with_any(F.rtrim(t, F.lit(X.WHITE)), X.FINAL_ENDINGS), "repetition": repeated, "no_metadata": F.coalesce(X.strip(F.col(source)), F.lit("")) == "",
    })


CHUNK_FLAGS = ("too_short", "too_long", "meaningless", "mid_cut", "repetition", "no_metadata")


def chunk_quality(flagged: DataFrame, order: str, text: str = "text", flags: tuple[str, ...] = CHUNK_FLAGS, most: int = SAMPLES) -> DataFrame:
    """(flag, n, percent, samples): how many chunks have each flag, their share in per cent (four places), and previews of the first
    `most` by order. Flags that no chunk has are rows of 0."""
    one = flagged.agg(F.count("*").alias("of"), *[F.count_if(F.col(f)).alias(f) for f in flags])
    counted = one.select("of", F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("n")) for f in flags])).alias("c")).select("c.*", "of")
    marks = F.filter(F.array(*[F.when(F.col(f), F.lit(f)) for f in flags]), lambda x: x.isNotNull())
    first = samples(flagged.select(F.explode(marks).alias("flag"), F.col(order).alias("_order"), preview(F.col(text)).alias("preview")), ["flag"], ["_order", "preview"], most)
    listed = first.groupBy("flag").agg(F.transform(F.array_sort(F.collect_list(F.struct("_order", "preview"))), lambda x: x["preview"]).alias("samples"))
    share = F.coalesce(F.round(100.0 * F.col("n") / F.nullif(F.col("of"), F.lit(0)), 4), F.lit(0.0))
    return counted.join(listed, "flag", "left").select("flag", "n", share.alias("percent"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def review_categories(docs: DataFrame, text: str = "text", categories: dict[str, str] = X.REVIEW_CATEGORIES) -> DataFrame:
    """(category, n, share): texts that match each category's pattern, by count; a text counts for every category that it matches,
    shares are of all texts. One aggregation over the texts, one row a category with a match."""
    one = docs.agg(F.count("*").alias("_of"), *[F.count_if(F.coalesce(F.col(text).rlike(X.UNICODE + p), F.lit(False))).alias(f"_{i}") for i, p in enumerate(categories.values())])
    rows = F.array(*[F.struct(F.lit(k).alias("category"), F.col(f"_{i}").alias("n")) for i, k in enumerate(categories)])
    return one.select("_of", F.explode(rows).alias("c")).where("c.n > 0").select("c.*", F.round(F.col("c.n") / F.col("_of"), 6).alias("share")).orderBy(F.desc("n"), "category")


def distributions(records: DataFrame, columns: list[str], unknown: str = "unknown") -> DataFrame:
    """(part, name, n): how many records have each value of each column (its reason, tier, verification status); null is `unknown`.
    One pass: each record counts once in every part."""
    rows = F.array(*[F.struct(F.lit(c).alias("part"), F.coalesce(F.col(c).cast("string"), F.lit(unknown)).alias("name")) for c in columns])
    return records.select(F.explode(rows).alias("r")).groupBy("r.part", "r.name").agg(F.count("*").alias("n"))


def detector(cases: DataFrame, flag: str = "flag", truth: str = "truth") -> DataFrame:
    """tp, fn, fp, tn of booleans flag and truth, recall and false-positive rate (null where there is nothing to divide by)."""
    f, t = F.coalesce(F.col(flag), F.lit(False)), F.col(truth)
    one = cases.agg(F.count_if(t & f).alias("tp"), F.count_if(t & ~f).alias("fn"), F.count_if(~t & f).alias("fp"), F.count_if(~t & ~f).alias("tn"))
    return one.withColumns({"recall": F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), 6), "fpr": F.round(F.col("fp") / F.nullif(F.col("fp") + F.col("tn"), F.lit(0)), 6)})


def detector_faults(cases: DataFrame, flag: str = "flag", truth: str = "truth") -> DataFrame:
    """The rows that a detector got wrong, with `fault`: missed or false_alarm."""
    f, t = F.coalesce(F.col(flag), F.lit(False)), F.col(truth)
    return cases.withColumn("fault", F.when(t & ~f, "missed").when(~t & f, "false_alarm")).where("fault IS NOT NULL")


def gold_letter(answer: Column, keys: str = "ABCDE") -> Column:
    """The letter that an answer names: itself, or by its number from 1; null for anything else."""
    told, letters = F.upper(X.strip(answer.cast("string"))), F.array(*map(F.lit, keys))
    by_number = F.get(letters, F.when(told.rlike(r"^\d{1,3}$"), told).try_cast("int") - 1)
    return F.when(F.array_contains(letters, told), told).otherwise(by_number)


def mcq_graded(answers: DataFrame, keys: str = "ABCDE", answer: str = "answer", response: str = "response") -> DataFrame:
    """answers with gold_letter, gold_text and correct: the response has the letter as a word among its first characters, or holds the
    gold text. Answers without a letter are graded wrong; a null response is empty."""
    letter, said = gold_letter(F.col(answer), keys), F.coalesce(F.col(response), F.lit(""))
    gold = F.coalesce(*[F.when(letter == k, X.normalize_ws(F.col(k))) for k in keys], F.lit(""))
    graded = answers.withColumns({"gold_letter": letter, "gold_text": gold})
    head = F.substring(said, 1, LETTER_CHARS)
    named = F.coalesce(*[F.when(F.col("gold_letter") == k, head.rlike(rf"{X.UNICODE}\b{k}\b")) for k in keys], F.lit(False))
    return graded.withColumn("correct", named | ((F.col("gold_text") != "") & F.contains(said, F.col("gold_text"))))


def mcq_accuracy(graded: DataFrame) -> DataFrame:
    """One row: of, correct, accuracy (null without answers)."""
    one = graded.agg(F.count("*").alias("of"), F.count_if("correct").alias("correct"))
    return one.withColumn("accuracy", F.round(F.col("correct") / F.nullif(F.col("of"), F.lit(0)), 6))


def mcq_wrong(graded: DataFrame, order: str, most: int = WRONG, question: str = "question", response: str = "response") -> DataFrame:
    """(order, question, gold, response) of the first `most` wrong answers, shortened."""
    told = graded.where("NOT correct").select(
        order, F.substring(question, 1, QUESTION_CHARS).alias("question"), F.concat(F.coalesce("gold_letter", F.lit("")), F.lit(". "), "gold_text").alias("gold"), F.substring(F.coalesce(response, F.lit("")), 1, RESPONSE_CHARS).alias("response")
    )
    return told.orderBy(order, "question", "gold", "response").limit(most)
