"""Source adapters: raw question-answer, article, dialogue and page tables as normalised records.

An adapter takes a DataFrame whose columns are those of its source and gives one row per usable record:
source, source_type, content, original_id, original_dataset, title, question, answer, category, department, disease, symptoms, metadata.
Rows without a required field are dropped, never an error. `idx` is the arrival order, given before any row is filtered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions import text as X
from tidemill.functions import udfs

# --- fixed values ---
DEPARTMENT_OF_CATEGORY = {
    "gastroenterology": "소화기내과", "cardiology": "순환기내과", "pulmonology": "호흡기내과", "nephrology": "신장내과", "endocrinology": "내분비내과", "neurology": "신경과", "dermatology": "피부과",
    "orthopedics": "정형외과", "psychiatry": "정신건강의학과", "ophthalmology": "안과", "otolaryngology": "이비인후과", "urology": "비뇨의학과", "obstetrics and gynecology": "산부인과", "pediatrics": "소아청소년과",
}
MCQ_SIGNALS = ("다음 중", "가능성이 높은", "가장 적절한", "가장 흔한")
NO_INPUT = ("<noinput>", "<no input>", "")
DEPARTMENTS = ("내과", "순환기내과", "이비인후과", "피부과", "정형외과", "신경과", "안과", "산부인과", "비뇨의학과", "정신건강의학과", "소아청소년과")
EXCLUDED_SECTIONS = ("참고문헌",)
# --- end of fixed values ---

#: Trust that each source's metadata states: content type, reliability, tier, verification.
TRUST = {
    "article": ("disease_information", "verified_official", 1, "official_source"),
    "clinical_qa": ("clinical_reasoning", "expert_reviewed_ai_generated", 2, "clinician_reviewed"),
    "consumer_qa": ("consumer_qa", "ai_generated_unverified", 3, "llm_generated_unverified"),
    "instruct": ("instruction_explanation", "ai_generated_unverified", 4, "translated_synthetic_unverified"),
    "dialogue": ("doctor_patient_dialogue", "ai_generated_unverified", 3, "llm_generated_unverified"),
    "government": ("disease_information", "verified_official", 1, "official_source"),
}


def numbered(raw: DataFrame, *order: str) -> DataFrame:
    """raw with idx, its place by `order`, from 0: sorted ranges, each numbered by itself and moved by what comes before it.

    A global window would put every row in one task; here only the ranges' sizes meet.
    """
    ranged = raw.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    marked = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    sizes = marked.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))  # one row a partition
    return marked.join(F.broadcast(before), "_part").withColumn("idx", F.col("_before") + F.col("_n")).drop("_part", "_n", "_before")


def _text(c: str) -> Column:
    return X.strip(F.coalesce(F.col(c).cast("string"), F.lit("")))


def _has(*cs: Column) -> Column:
    out = F.lit(True)
    for c in cs:
        out = out & (c != "")
    return out


def _or_null(c: Column) -> Column:
    return F.when(c != "", c)


def _strings() -> Column:
    return F.array().cast("array<string>")


def _record(raw: DataFrame, keep: Column, kind: str, content: Column, original_id: Column, dataset: str, department: Column | None = None, generated: Column | None = None, extras: dict | None = None, **fields: Column) -> DataFrame:
    content_type, reliability, tier, verified = TRUST[kind]
    null = F.lit(None).cast("string")
    extra = F.create_map(*[x for k, v in (extras or {}).items() for x in (F.lit(k), v)]) if extras else F.create_map().cast("map<string,string>")
    metadata = F.struct(
        F.lit("ko").alias("language"), F.lit(content_type).alias("content_type"), F.lit(reliability).alias("reliability"), F.lit(None).cast("string").alias("reliability_tier"), F.lit(tier).alias("source_tier"),
        F.lit(verified).alias("verification_status"), (generated if generated is not None else F.lit(None)).cast("boolean").alias("generated_metadata"), F.map_filter(extra, lambda k, v: v.isNotNull()).alias("extras"),
    )
    return raw.where(keep).select(
        F.lit(dataset).alias("source"), F.lit(kind).alias("source_type"), content.alias("content"), original_id.cast("string").alias("original_id"), F.lit(dataset).alias("original_dataset"),
        *[fields.get(f, null).cast("string").alias(f) for f in ("title", "question", "answer", "category")], (department if department is not None else _strings()).alias("department"),
        _strings().alias("disease"), _strings().alias("symptoms"), metadata.alias("metadata"),
    )


def _joined(*parts: Column) -> Column:
    return F.concat_ws("\n\n", *[F.nullif(p, F.lit("")) for p in parts])


def article(raw: DataFrame, dataset: str = "article") -> DataFrame:
    """instruction, output, input?: the three joined; the id is idx."""
    a, b, c = _text("instruction"), _text("output"), _text("input")
    return _record(raw, _has(a, b), "article", _joined(a, b, c), F.col("idx"), dataset, title=a, answer=b)


def drop_trailing_questions(question: Column) -> Column:
    """Without the last sentences that end in ? and hold an exam phrase; the question itself where nothing would be left."""
    sentences = X.split_sentences(question)
    asks = F.transform(sentences, lambda s: s.endswith("?") & X.contains_any(s, MCQ_SIGNALS))
    # how many of the last sentences all ask
    tail = F.aggregate(F.reverse(asks), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda a, x: F.struct((a["on"] & x).alias("on"), F.when(a["on"] & x, a["n"] + 1).otherwise(a["n"]).alias("n")), lambda a: a["n"])
    left = F.array_join(F.slice(sentences, F.lit(1), F.size(sentences) - tail), " ")
    return F.when(left == "", question).otherwise(left)


def clinical_qa(raw: DataFrame, dataset: str = "clinical_qa") -> DataFrame:
    """question, exam?, explanation, question_id?, category?, chief_complaint?, source?: exam questions and their reasoning."""
    q, e, exam = _text("question"), _text("explanation"), _text("exam")
    category = _or_null(_text("category"))
    found = F.element_at(F.create_map(*[F.lit(x) for kv in DEPARTMENT_OF_CATEGORY.items() for x in kv]), F.lower(category))
    department = F.when(found.isNull(), _strings()).otherwise(F.array(found))
    return _record(
        raw, _has(q, e), "clinical_qa", _joined(drop_trailing_questions(q), exam, e), F.coalesce(_or_null(_text("question_id")), F.col("idx").cast("string")), dataset, department,
        F.when(found.isNotNull(), True), {"reference": _or_null(_text("source"))}, title=_or_null(_text("chief_complaint")), question=q, answer=e, category=category,
    )


def consumer_qa(raw: DataFrame, dataset: str = "consumer_qa") -> DataFrame:
    """question_ko, answer_ko, id?, question?: both translated fields are needed."""
    q, a = _text("question_ko"), _text("answer_ko")
    return _record(raw, _has(q, a), "consumer_qa", _joined(q, a), F.coalesce(_or_null(_text("id")), F.col("idx").cast("string")), dataset, extras={"question_en": _or_null(_text("question"))}, title=q, question=q, answer=a)


def instruct_reasons(raw: DataFrame, refusals=X.REFUSALS, least: float = X.LEAKAGE) -> DataFrame:
    """raw with `reason`: missing, rejected_ai_refusal, rejected_input_output_leakage, stripped_answer_restatement, or null.

    The quadratic matcher sees only rows that the cheap tests and the length bound leave.
    """
    texts = raw.withColumns({"_a": _text("instruction"), "_b": _text("output"), "_extra": _text("input")})
    a, b = F.col("_a"), F.col("_b")
    cheap = texts.withColumns({
        "_extra": F.when(F.lower("_extra").isin(*NO_INPUT), "").otherwise(F.col("_extra")), "_cut": X.strip_restatement(b), "_cheap": F.when((a == "") | (b == ""), "missing").when(X.contains_any(b, refusals), "rejected_ai_refusal"),
    })
    against = F.when(F.col("_cheap").isNull(), F.when(F.col("_extra") != "", F.col("_extra")).otherwise(a))
    leaks = cheap.withColumn("_leak", udfs.similar(against, F.when(F.col("_cheap").isNull(), b), least))
    return leaks.withColumn("reason", F.coalesce("_cheap", F.when(F.col("_leak"), "rejected_input_output_leakage").when(F.col("_cut") != b, "stripped_answer_restatement"))).drop("_cheap", "_leak")


def instruct(raw: DataFrame, dataset: str = "instruct", refusals=X.REFUSALS, least: float = X.LEAKAGE) -> DataFrame:
    """instruction, input?, output, question_idx?: refusals and copies dropped, restated answers cut."""
    judged = instruct_reasons(raw, refusals, least).where("reason IS NULL OR reason = 'stripped_answer_restatement'")
    a, b = F.col("_a"), F.col("_cut")
    return _record(judged, F.lit(True), "instruct", _joined(a, F.col("_extra"), b), F.coalesce(F.col("row_id").cast("string"), F.col("idx").cast("string")) if "row_id" in raw.columns else F.col("idx"), dataset, title=a, answer=b)


def single_department(text: Column, names=DEPARTMENTS) -> Column:
    """The one department that a text names, longer names hiding those they hold; null for none or several."""
    named = F.filter(F.array(*map(F.lit, names)), lambda n: F.contains(text, n))
    own = F.filter(named, lambda n: ~F.exists(named, lambda m: (m != n) & F.contains(m, n)))
    return F.when(F.size(own) == 1, own[0])


def dialogue(raw: DataFrame, dataset: str = "dialogue", names=DEPARTMENTS) -> DataFrame:
    """input (the patient), output (the doctor): the department is the single one that the answer names."""
    q, a = _text("input"), _text("output")
    found = single_department(a, names)
    return _record(raw, _has(q, a), "dialogue", _joined(q, a), F.col("idx"), dataset, F.when(found.isNull(), _strings()).otherwise(F.array(found)), F.when(found.isNotNull(), True), question=q, answer=a)


def government(pages: DataFrame, dataset: str = "government") -> DataFrame:
    """serial, title, sections array<struct<name,text>>: a page's sections under headings."""
    content = F.array_join(F.transform("sections", lambda s: F.concat(F.lit("## "), s["name"], F.lit("\n"), s["text"])), "\n\n")
    return _record(pages, (F.coalesce("title", F.lit("")) != "") & (F.size("sections") > 0), "government", content, F.col("serial"), dataset, title=F.col("title"))


def gated(raw: DataFrame, dataset: str = "gated") -> DataFrame:
    raise PermissionError(f"{dataset} needs access that this job doesn't have")


ADAPTERS: dict[str, Callable[..., DataFrame]] = {"article": article, "clinical_qa": clinical_qa, "consumer_qa": consumer_qa, "instruct": instruct, "dialogue": dialogue, "government": government, "gated": gated}


def adapter(name: str) -> Callable[..., DataFrame]:
    if name not in ADAPTERS:
        raise KeyError(f"no adapter {name!r}; there are {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[name]


def document_metadata(records: DataFrame, review: str = X.REVIEW) -> DataFrame:
    """records with metadata filled where it is missing; needs_review is always set anew."""
    m = F.col("metadata")
    return records.withColumn(
        "metadata",
        F.struct(
            "source", "source_type", F.coalesce(m["language"], F.lit("ko")).alias("language"), "category", "department", "disease", "symptoms", F.coalesce(m["reliability"], F.lit("unspecified")).alias("reliability"),
            F.coalesce(m["reliability_tier"], F.lit("확인 필요")).alias("reliability_tier"), "original_dataset", "original_id", F.coalesce(m["generated_metadata"], F.lit(False)).alias("generated_metadata"),
            X.needs_review(F.col("content"), review).alias("needs_review"), m["content_type"].alias("content_type"), m["source_tier"].alias("source_tier"), m["verification_status"].alias("verification_status"), m["extras"].alias("extras"),
        ),
    )


def upload_metadata(uploads: DataFrame, review: str = X.REVIEW) -> DataFrame:
    """uploads (url?, file_name, text) with source and needs_review of the whole text."""
    return uploads.withColumns({"source": F.coalesce(F.nullif(F.col("url"), F.lit("")), F.col("file_name")), "needs_review": X.needs_review(F.col("text"), review)})
