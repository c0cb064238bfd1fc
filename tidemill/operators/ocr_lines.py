"""Recognised lines (doc, page, line_no, text, confidence, y, x) as page and document texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions import text as X

LEAST_CONFIDENCE = 0.5


def reading_order(lines: DataFrame) -> DataFrame:
    """lines with `place` on their page: from top to bottom, then from left to right; lines without a box first."""
    return lines.withColumn("place", F.row_number().over(Window.partitionBy("doc", "page").orderBy(F.coalesce("y", F.lit(0.0)), F.coalesce("x", F.lit(0.0)), "line_no")))


def drop_repeats(lines: DataFrame) -> DataFrame:
    """Without lines whose text is that of the line before on their page."""
    own = Window.partitionBy("doc", "page").orderBy("place")
    return lines.withColumn("_last", F.lag(X.strip(F.col("text"))).over(own)).where(F.col("_last").isNull() | (F.col("_last") != X.strip(F.col("text")))).drop("_last")


def page_text(lines: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """(doc, text): sure lines in reading order, pages under headers where a document has several."""
    kept = drop_repeats(reading_order(lines.where(F.col("confidence") >= least)))
    pages = kept.groupBy("doc", "page").agg(X.clean_document_text(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n"), collapse_blanks=True).alias("t"))
    whole = pages.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "t"))).alias("p"))
    several = F.transform("p", lambda x: F.concat(F.lit("--- 페이지 "), (x["page"] + 1).cast("string"), F.lit(" ---\n"), x["t"]))
    return whole.select("doc", F.when(F.size("p") > 1, F.array_join(several, "\n\n")).otherwise(F.get("p", F.lit(0))["t"]).alias("text"))


def document_confidence(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc").agg(F.round(F.avg("confidence"), 6).alias("confidence"), F.count("*").alias("lines"))


def archive_confidence(members: DataFrame, by: str = "archive") -> DataFrame:
    """Mean confidence weighted by text length, one at least; 0 for none."""
    weight = F.greatest(F.length(F.coalesce("text", F.lit(""))), F.lit(1))
    return members.groupBy(by).agg(F.round(F.coalesce(F.sum(F.col("confidence") * weight) / F.sum(weight), F.lit(0.0)), 6).alias("confidence"))


def document_kind(pages: DataFrame, by: str = "doc", source: str = "source") -> DataFrame:
    scanned = F.bool_and(F.col(source).isin("ocr", "empty"))
    return pages.groupBy(by).agg(F.when(scanned, "scanned").when(F.bool_or(F.col(source).isin("ocr", "hybrid")), "hybrid").otherwise("digital").alias("kind"))
