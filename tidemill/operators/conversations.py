"""Conversation tables: search, counts, remapping, erasure, pairing, history, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions import text as X

# --- fixed values ---
PAIRS, HISTORY_CHARS, LOOK_BACK, TITLE_CHARS = 6, 6000, 3, 40
OTHER = "기타"
# --- end of fixed values ---


def search(conversations: DataFrame, messages: DataFrame, asked: str | None, order: str = "updated_at") -> DataFrame:
    """Conversations whose title, category or any message matches, newest first; a blank question lists all without reading messages.

    Matching is ILIKE, with the caller's % and _ as wildcards. Messages are reduced to distinct ids before the semi-join.
    """
    listed = conversations
    if asked and asked.strip():
        like = f"%{asked.strip()}%"
        said = messages.where(F.col("text").ilike(like)).select("conv_id").distinct().withColumn("_said", F.lit(True))
        own = F.coalesce(F.col("title").ilike(like), F.lit(False)) | F.coalesce(F.col("category").ilike(like), F.lit(False))
        listed = conversations.join(said, "conv_id", "left").where(own | F.col("_said").isNotNull()).drop("_said")
    return listed.orderBy(F.desc(order), "conv_id")


def message_counts(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """(user_id, role, n): messages are counted by conversation before they meet its owner."""
    counted = messages.groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    return conversations.select("conv_id", "user_id").join(counted, "conv_id").groupBy("user_id", "role").agg(F.sum("n").alias("n"))


def attachment_counts(conversations: DataFrame, messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """(user_id, n) of owners with attachments (message_id): counted by message, then by conversation, before they meet their owner."""
    by_message = attachments.groupBy("message_id").agg(F.count("*").alias("n"))
    by_conversation = messages.select("message_id", "conv_id").join(by_message, "message_id").groupBy("conv_id").agg(F.sum("n").alias("n"))
    return conversations.select("conv_id", "user_id").join(by_conversation, "conv_id").groupBy("user_id").agg(F.sum("n").alias("n"))


def remap_owner(df: DataFrame, mapping: DataFrame, column: str = "user_id") -> DataFrame:
    """df with owners replaced where mapping (old_id, new_id) has them, and `remapped` to count by."""
    kept = [c for c in df.columns if c != column]
    return df.join(mapping, F.col(column) == F.col("old_id"), "left").select(*kept, F.coalesce("new_id", column).alias(column), F.col("new_id").isNotNull().alias("remapped"))


def _blank(c: str) -> Column:
    return X.strip(F.coalesce(c, F.lit(""))) == ""


def pairs(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): a user turn directly followed by an assistant's, other roles not counting, neither blank."""
    own = Window.partitionBy("conv_id").orderBy("turn")
    two = messages.where(F.col("role").isin("user", "assistant")).withColumns({"_role": F.lag("role").over(own), "question": F.lag("text").over(own)})
    return two.where((F.col("role") == "assistant") & (F.col("_role") == "user") & ~_blank("text") & ~_blank("question")).select("conv_id", "turn", "question", F.col("text").alias("answer"))


def history(paired: DataFrame, most: int = PAIRS, chars: int = HISTORY_CHARS) -> DataFrame:
    """The last `most` pairs of each conversation, cut to the newest whose characters sum to `chars` at most, whole pairs only."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    numbered = paired.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= most)
    sized = numbered.withColumn("sum_chars", F.sum(F.length("question") + F.length("answer")).over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    return sized.where(F.col("sum_chars") <= chars)


def expanded_queries(turns: DataFrame, look_back: int = LOOK_BACK) -> DataFrame:
    """(conv_id, turn, query) of user turns (conv_id, turn, text, department): a turn without a department looks back over up to
    `look_back` user turns to the first with one, and is searched as those turns, oldest first, and itself."""
    own = Window.partitionBy("conv_id").orderBy("turn")
    behind = F.reverse(F.collect_list(F.struct("text", "department")).over(own.rowsBetween(-look_back, -1)))
    first = F.array_position(F.transform("behind", lambda x: x["department"].isNotNull()), True)
    parts = F.reverse(F.transform(F.slice("behind", 1, F.greatest(first, F.lit(1)).cast("int")), lambda x: x["text"]))
    told = turns.withColumn("behind", behind)
    return told.select("conv_id", "turn", F.when(F.col("department").isNull() & (first > 0), F.concat_ws(" ", parts, "text")).otherwise(F.col("text")).alias("query"))


def titles(messages: DataFrame, custom: DataFrame | None = None, most: int = TITLE_CHARS) -> DataFrame:
    """(conv_id, title): the first user message on one line, cut with an ellipsis; custom titles (conv_id, title) stay."""
    first = messages.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    line = X.strip(F.regexp_replace("t", "\n", " "))
    made = first.select("conv_id", F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line).alias("title"))
    if custom is None:
        return made
    return made.join(custom.withColumnRenamed("title", "_own"), "conv_id", "left").select("conv_id", F.coalesce("_own", "title").alias("title"))


def sticky_category(answers: DataFrame) -> DataFrame:
    """(conv_id, category): the department of the first answer that isn't a fallback, once and for all."""
    return answers.where("NOT is_fallback").groupBy("conv_id").agg(F.min_by(F.coalesce("department", F.lit(OTHER)), "turn").alias("category"))


def by_category(conversations: DataFrame) -> DataFrame:
    """(category, conv_id, n): each conversation under its category, with how many that has. Categories are few, conversations aren't:
    ids stay rows, and only the counts are joined."""
    named = conversations.select(F.coalesce("category", F.lit(OTHER)).alias("category"), "conv_id")
    return named.join(named.groupBy("category").agg(F.count("*").alias("n")), "category")
