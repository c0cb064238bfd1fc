"""Fine-tuning corpora: format adapters to messages, deduplication, mixing, splits, reports.

A message list is array<struct<role,content>>. Adapters give null where a row can't be used.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions import text as X
from tidemill.operators.ingest import first_by

# --- fixed values ---
QA_CANDIDATES = (("question", None, "answer"), ("instruction", "input", "output"), ("prompt", None, "response"))
ASSISTANT_NAMES = ("doctor", "assistant", "gpt", "bot")
TURN_COLUMNS = ("conversations", "messages", "CoD_conversations", "dialogue", "conversation")
RATIOS = {"medical_knowledge": 0.60, "medical_reasoning": 0.25, "conversation_style": 0.15}
SPLIT = 0.2
# --- end of fixed values ---

MESSAGES = "array<struct<role:string,content:string>>"


def _said(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _clean(c: Column) -> Column:
    return X.clean_text(c.cast("string"))


def qa_messages(df: DataFrame, columns: tuple[str, str | None, str] | None = None, into: str = "messages") -> DataFrame:
    """df with messages of the first candidate columns that have both a question and an answer, cleaned and masked."""
    found = F.lit(None).cast(MESSAGES)
    for q, extra, a in reversed([columns] if columns else [c for c in QA_CANDIDATES if c[0] in df.columns and c[2] in df.columns]):
        question, answer = _clean(F.col(q)), _clean(F.col(a))
        more = _clean(F.when(F.col(extra) != "<noinput>", F.col(extra))) if extra and extra in df.columns else F.lit("")
        asked = F.when(more == "", question).otherwise(F.concat(question, F.lit("\n\n"), more))
        found = F.when((question != "") & (answer != ""), F.array(_said("user", X.mask_pii(asked)), _said("assistant", X.mask_pii(answer)))).otherwise(found)
    return df.withColumn(into, found)


def _exam(question: Column, options: Column, heading: str, letter: Column, answer: Column, tail: Column | None = None) -> Column:
    """options: array<struct<key,text>> of the choices that have a text."""
    listed = F.array_join(F.transform(options, lambda o: F.concat(o["key"], F.lit(". "), o["text"])), "\n")
    asked = F.concat(F.lit("다음 의학 문제에 답하세요.\n\n질문:\n"), question, F.lit(heading), listed)
    told = F.when(letter.isNotNull(), F.concat(F.lit("정답은 "), letter, F.lit("입니다.\n\n"), letter, F.lit(". "), answer)).otherwise(F.concat(F.lit("정답: "), answer))
    if tail is not None:
        told = F.concat(told, F.when(tail != "", F.concat(F.lit("\n\n해설: "), tail)).otherwise(""))
    return F.when((question != "") & (F.size(options) > 0) & (answer != ""), F.array(_said("user", X.mask_pii(asked)), _said("assistant", X.mask_pii(told))))


def mcq_columns(df: DataFrame, keys: str = "ABCD", index: str = "answer_idx", answer: str = "answer", into: str = "messages") -> DataFrame:
    """Choices in columns named by letter; the right one by index, else by letter, else as text."""
    options = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), _clean(F.col(k)).alias("text")) for k in keys]), lambda o: o["text"] != "")
    letters = F.array(*map(F.lit, keys))
    by_index = F.get(letters, F.col(index).try_cast("int")) if index in df.columns else F.lit(None).cast("string")
    named = F.upper(X.strip(F.col(answer).cast("string")))
    letter = F.coalesce(by_index, F.when(F.array_contains(letters, named), named))
    chosen = F.filter(options, lambda o: o["key"] == letter)
    return df.withColumn(into, _exam(_clean(F.col("question")), options, "\n\n", letter, F.coalesce(F.get(chosen, F.lit(0))["text"], _clean(F.col(answer)))))


def mcq_map(df: DataFrame, options: str = "options", answer: str = "answer", explanation: str | None = "explanation", into: str = "messages") -> DataFrame:
    """Choices in a map option_A -> text, the right one by letter; an explanation follows."""
    entries = F.transform(F.array_sort(F.map_entries(F.col(options))), lambda e: F.struct(F.upper(F.replace(e["key"], F.lit("option_"), F.lit(""))).alias("key"), _clean(e["value"]).alias("text")))
    letter = F.upper(X.strip(F.col(answer)))
    chosen = F.try_element_at(F.col(options), F.concat(F.lit("option_"), letter))
    tail = _clean(F.col(explanation)) if explanation else None
    return df.withColumn(into, _exam(_clean(F.col("question")), F.filter(entries, lambda o: o["text"] != ""), "\n\n선택지:\n", F.when(letter != "", letter), F.coalesce(_clean(chosen), F.lit("")), tail))


def mcq_numbered(df: DataFrame, keys: str = "ABCDE", answer: str = "answer", prefix: str = "", into: str = "messages") -> DataFrame:
    """Choices in lettered columns, the right one as a letter or a number from 1; an optional reasoning column `cot` follows."""
    letters = F.array(*map(F.lit, keys))
    told = F.upper(X.strip(F.col(answer).cast("string")))
    letter = F.when(told.rlike(r"^\d+$"), F.get(letters, told.try_cast("int") - 1)).otherwise(F.when(F.array_contains(letters, told), told))
    options = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), _clean(F.col(k)).alias("text")) for k in keys]), lambda o: o["text"] != "")
    chosen = F.get(F.filter(options, lambda o: o["key"] == letter), F.lit(0))["text"]
    asked = F.concat(F.lit(prefix), _clean(F.col("question")), F.lit("\n"), F.array_join(F.transform(options, lambda o: F.concat(o["key"], F.lit(") "), o["text"])), "\n"))
    reason = _clean(F.col("cot")) if "cot" in df.columns else F.lit("")
    reply = F.concat(letter, F.lit(") "), chosen, F.when(reason != "", F.concat(F.lit("\n"), reason)).otherwise(""))
    return df.withColumn(into, F.when(mcq_valid("question", keys, answer) & chosen.isNotNull(), F.array(_said("user", asked), _said("assistant", reply))))


def mcq_valid(question: str, keys: str, answer: str) -> Column:
    """A question, two choices or more, an answer."""
    texts = F.filter(F.array(*[_clean(F.col(k)) for k in keys]), lambda t: t != "")
    return (_clean(F.col(question)) != "") & (F.size(texts) >= 2) & F.col(answer).isNotNull()


def standard_turns(turns: Column) -> Column:
    """Any array<struct<role,content>> with roles user and assistant, blank turns dropped; null unless it has two turns or more, opens
    with a user and ends with an assistant."""
    role = lambda t: F.when(F.lower(t["role"]).isin(*ASSISTANT_NAMES), "assistant").otherwise("user")
    told = F.filter(F.transform(turns, lambda t: F.struct(role(t).alias("role"), X.mask_pii(_clean(t["content"])).alias("content"))), lambda t: t["content"] != "")
    return F.when((F.size(told) >= 2) & (F.get(told, F.lit(0))["role"] == "user") & (F.element_at(told, -1)["role"] == "assistant"), told)


def turn_column(df: DataFrame) -> str | None:
    return next((c for c in TURN_COLUMNS if c in df.columns), None)


def conversation_messages(rows: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """(id, messages) from one row a turn (turn, role, text); system turns count as the user's, as any unknown role does."""
    held = rows.groupBy(id_column).agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("t"))
    return held.select(id_column, standard_turns(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))).alias("messages"))


def merge_turns(rows: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """Consecutive turns of one role as one, their texts joined by a space: (id, run, role, content)."""
    own = Window.partitionBy(id_column).orderBy("turn")
    runs = rows.withColumn("_new", F.coalesce((F.lag("role").over(own) != F.col("role")).cast("int"), F.lit(1))).withColumn("run", F.sum("_new").over(own))
    return runs.groupBy(id_column, "run").agg(F.first("role").alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("content"))


def strip_reasoning(messages: Column) -> Column:
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == "assistant", X.strip_reasoning(m["content"])).otherwise(m["content"]).alias("content")))


def by_path(df: DataFrame, question: str | None = None, answer: str | None = None, dialogue: str | None = None, into: str = "messages") -> DataFrame:
    """Messages from dotted paths into nested columns. Without any path the source isn't configured: an error names it."""
    if question and answer:
        q, a = _clean(F.col(question)), _clean(F.col(answer))
        return df.withColumn(into, F.when((q != "") & (a != ""), F.array(_said("user", X.mask_pii(q)), _said("assistant", X.mask_pii(a)))))
    if dialogue:
        return df.withColumn(into, standard_turns(F.col(dialogue)))
    raise ValueError("the source has neither question and answer paths nor a dialogue path")


def prompt_completion(messages: Column) -> tuple[Column, Column]:
    return F.slice(messages, F.lit(1), F.size(messages) - 1), F.element_at(messages, -1)


def rendered(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<"), m["role"], F.lit(">\n"), m["content"], F.lit("\n</"), m["role"], F.lit(">"))), "\n")


def structure_ok(messages: Column) -> Column:
    return (F.get(messages, F.lit(0))["role"] == "user") & (F.element_at(messages, -1)["role"] == "assistant") & ~F.exists(messages, lambda m: X.strip(m["content"]) == "")


def priority_of(source: Column, order: list[str]) -> Column:
    """The place of a source in an ordered list; unlisted ones come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), source), F.lit(0)), F.lit(len(order) + 1))


def first_of(df: DataFrame, key: Column, *order: Column | str) -> DataFrame:
    """The first row of each key by order, which names a key's rows once; rows with a null key are one key."""
    keyed = df.withColumn("_key", F.coalesce(F.sha2(key, 256), F.lit("")))
    return first_by(keyed, "_key", list(order)).drop("_key")


def first_question(messages: Column) -> Column:
    users = F.filter(messages, lambda m: m["role"] == "user")
    return F.lower(X.normalize_ws(F.get(users, F.lit(0))["content"]))


def _shuffled(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _numbered(df: DataFrame, kind: str, key: str, seed: int) -> DataFrame:
    """df with `_n`, a row's place in its kind by hashed key, and `_of`, how many the kind has.

    Places are counted within 4,096 ranges of the hash, whose counts add up to the places before them: no kind is one task's to sort.
    """
    placed = df.withColumn("_hash", _shuffled(key, seed)).withColumn("_range", F.substring("_hash", 1, 3))
    sizes = placed.groupBy(F.col(kind).alias("_kind"), F.col("_range").alias("_r")).agg(F.count("*").alias("_size"))
    own = Window.partitionBy("_kind")
    before = sizes.select("_kind", "_r", (F.sum("_size").over(own.orderBy("_r")) - F.col("_size")).alias("_before"), F.sum("_size").over(own).alias("_of"))
    ranked = placed.withColumn("_in", F.row_number().over(Window.partitionBy(kind, "_range").orderBy("_hash", key)))
    met = ranked.join(before, F.col(kind).eqNullSafe(F.col("_kind")) & (F.col("_range") == F.col("_r")))
    return met.withColumn("_n", F.col("_before") + F.col("_in")).select(*[F.col(f"`{c}`") for c in df.columns], "_n", "_of")


def cap_per_source(df: DataFrame, source: str, key: str, cap: int | None, seed: int = 42) -> DataFrame:
    """`cap` random rows of each source, by hashed keys; None keeps all. Spark cuts each task's rows to the cap before the shuffle."""
    if cap is None:
        return df
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(source).orderBy(_shuffled(key, seed), key))).where(F.col("_n") <= cap).drop("_n")


def mix(df: DataFrame, kind: str, key: str, ratios: dict[str, float] = RATIOS, seed: int = 42) -> DataFrame:
    """Rows down-sampled so that kinds stand in the given ratios; kinds without a ratio are left out."""
    counts = {r[kind]: r["n"] for r in df.groupBy(kind).agg(F.count("*").alias("n")).collect()}  # one number a kind
    feasible = min((counts.get(k, 0) / r for k, r in ratios.items() if r > 0), default=0)
    target = F.lit(0)
    for k, r in ratios.items():
        target = F.when(F.col(kind) == k, int(feasible * r)).otherwise(target)
    return _numbered(df.where(F.col(kind).isin(*ratios)), kind, key, seed).where(F.col("_n") <= target).drop("_n", "_of")


def split(df: DataFrame, kind: str, key: str, held: float = SPLIT, seed: int = 42) -> DataFrame:
    """df with `split`: within each kind a share of `held` rows leaves train, halved into validation and test."""
    ranked = _numbered(df, kind, key, seed)
    out = F.ceil(F.col("_of") * held)
    test = F.floor(out / 2)
    return ranked.withColumn("split", F.when(F.col("_n") <= test, "test").when(F.col("_n") <= out, "validation").otherwise("train")).drop("_n", "_of")


def shares(df: DataFrame, by: str) -> DataFrame:
    """(by, n, share): the total is a sum over the few grouped rows."""
    counted = df.groupBy(by).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def conversion_report(df: DataFrame, by: str, messages: str = "messages", explanation: str | None = None) -> DataFrame:
    """By source: rows, how many were kept and their share, turns and characters of those; with an explanation column also how many
    rows have one."""
    size = F.size(messages)
    chars = F.aggregate(messages, F.lit(0), lambda a, m: a + F.length(m["content"]))
    ok = F.col(messages).isNotNull()
    more = [F.count_if(X.strip(F.coalesce(F.col(explanation).cast("string"), F.lit(""))) != "").alias("explained")] if explanation else []
    return df.groupBy(by).agg(
        F.count("*").alias("total"), F.count_if(ok).alias("kept"), F.round(F.count_if(ok) / F.count("*"), 6).alias("ratio"), F.round(F.avg(F.when(ok, size)), 6).alias("avg_turns"), F.min(F.when(ok, size)).alias("min_turns"), F.max(F.when(ok, size)).alias("max_turns"),
        F.round(F.avg(F.when(ok, chars)), 6).alias("avg_chars"), F.max(F.when(ok, chars)).alias("max_chars"), *more,
    )


def conversion_reasons(df: DataFrame, by: str, reason: str = "reason") -> DataFrame:
    """(by, reason, n, total): rows that a conversion has dropped, by source and reason, and by reason over all sources."""
    counted = df.where(F.col(reason).isNotNull()).groupBy(by, reason).agg(F.count("*").alias("n"))
    return counted.withColumn("total", F.sum("n").over(Window.partitionBy(reason)))


def mcq_reason(question: str, keys: str, answer: str, messages: str = "messages") -> Column:
    """Why a multiple-choice row gave no messages, or null where it did."""
    texts = F.filter(F.array(*[_clean(F.col(k)) for k in keys]), lambda t: t != "")
    why = F.when(F.coalesce(_clean(F.col(question)), F.lit("")) == "", "no_question").when(F.size(texts) < 2, "few_choices").when(F.col(answer).isNull(), "no_answer").otherwise("unknown_answer")
    return F.when(F.col(messages).isNull(), why)


def write(df: DataFrame, path: str, config: dict | None = None) -> None:
    """Splits as partitions of one Parquet table; beside it their statistics, a log of this and earlier writes, and the configuration
    as JSON. Statistics are counted from what was written."""
    spark = df.sparkSession
    df.write.mode("overwrite").partitionBy("split").parquet(f"{path}/messages")
    written = spark.read.parquet(f"{path}/messages").groupBy("split").agg(F.count("*").alias("n"))
    written.write.mode("overwrite").parquet(f"{path}/statistics")
    spark.read.parquet(f"{path}/statistics").withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{path}/log")
    spark.createDataFrame([(json.dumps(config or {}, ensure_ascii=False, sort_keys=True),)], "value string").write.mode("overwrite").text(f"{path}/config")
