"""File sources: record files, ground-truth files, encoded text, zip members, XML pages; and the gate at their door."""

from __future__ import annotations

import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions import text as X
from tidemill.functions import udfs
from tidemill.sources.adapters import EXCLUDED_SECTIONS

# --- fixed values ---
QUESTION_NAMES = ("question", "query", "질문")
ANSWER_NAMES = ("expected_answer", "expectedAnswer", "ground_truth", "answer", "정답")
DEFAULT_QUESTION, PLAIN_QUESTION = "항목 ", "직접 입력 항목"
QUESTION_MARK, ANSWER_MARK = r"(?i)^\s*(질문|question):", r"(?i)^\s*(정답|answer):"
EXTENSIONS = ("png", "jpg", "jpeg", "docx", "pptx", "json", "jsonl", "csv", "txt", "zip", "pdf")
TEXT_EXTENSIONS = ("txt", "md", "csv", "json", "jsonl", "xml", "html")
IMAGE_PREFIX = "http"
REVIEW_WARNINGS = ("실패", "제외", "건너뛰", "읽지 못", "완전하게", "다를 수", "만 추출")
# --- end of fixed values ---


def read_jsonl(spark: SparkSession, path: str, required: list[str], schema: str | None = None) -> DataFrame:
    """One JSON object a line; blank lines and rows without a required field are passed over."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.option("mode", "PERMISSIVE").json(path)
    for c in required:
        df = df.where(F.coalesce(X.strip(F.col(c).cast("string")), F.lit("")) != "")
    return df


def read_records(spark: SparkSession, path: str, kind: str, root: str | None = None, pattern: str | None = None) -> DataFrame:
    """A folder, to any depth, of json, jsonl, csv or parquet files, known by their ending or by a pattern. A JSON root is a dotted
    path to a list of records or to one."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern or f"*.{kind}")
    if kind == "csv":
        return reader.option("header", "true").csv(path)
    if kind == "parquet":
        return reader.parquet(path)
    df = reader.option("multiLine", str(kind == "json").lower()).json(path)
    if not root:
        return df
    found = df.select(F.col(root).alias("r"))
    if found.schema["r"].dataType.typeName() == "array":
        found = found.select(F.explode("r").alias("r"))
    return found.select("r.*")


def _first(df: DataFrame, names: tuple[str, ...]) -> Column:
    have = [X.strip(F.col(f"`{n}`").cast("string")) for n in names if n in df.columns]
    return F.coalesce(*have, F.lit(""))


def ground_truth(records: DataFrame, order: str = "idx") -> DataFrame:
    """(idx, question, expected_answer, error) of records under any of the known names; idx counts from 1 in file order."""
    q, a = _first(records, QUESTION_NAMES), _first(records, ANSWER_NAMES)
    return records.select(F.col(order).alias("idx"), F.when(q == "", F.concat(F.lit(DEFAULT_QUESTION), F.col(order))).otherwise(q).alias("question"), a.alias("expected_answer")).withColumn("error", F.when(F.col("expected_answer") == "", "empty_answer"))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """QA cases from a .json (a list, one object or {"cases": [...]}), .jsonl, .csv (comma, tab or semicolon) or .txt file."""
    if path.endswith(".txt"):
        return ground_truth_text(spark.read.text(path, wholetext=True).select("value"))
    if path.endswith(".csv"):
        head = spark.read.text(path).first()[0]  # the header line
        mark = max(",\t;", key=head.count)
        df = spark.read.option("header", "true").option("sep", mark).option("multiLine", "true").csv(path)
    else:
        df = spark.read.option("multiLine", str(path.endswith(".json")).lower()).json(path)
        if "cases" in df.columns:
            df = df.select(F.explode("cases").alias("c")).select("c.*")
    # a ground-truth file is small by contract: one task numbers its rows in file order
    numbered = df.coalesce(1).withColumn("_at", F.monotonically_increasing_id())
    return ground_truth(numbered.withColumn("idx", F.row_number().over(Window.orderBy("_at"))))


def ground_truth_text(texts: DataFrame, column: str = "value") -> DataFrame:
    """(idx, question, expected_answer, error) of whole texts: labelled blocks, else a separated line each, else one plain answer.

    Blocks are numbered by posexplode; within a block a line belongs to the last label above it, as a running count says.
    """
    text = F.regexp_replace(F.col(column), "\r\n", "\n")
    lower = F.lower(text)
    mode = F.when(text.contains("정답:") | lower.contains("answer:"), "labelled").when(text.contains("\t"), "tab").when(text.contains("|"), "bar").otherwise("plain")
    source = texts.select(F.monotonically_increasing_id().alias("file"), text.alias("t"), mode.alias("mode"))

    blocks = source.where("mode = 'labelled'").select("file", F.posexplode(F.filter(F.transform(F.split("t", "\n---\n"), X.strip), lambda b: b != "")).alias("b", "block"))
    lines = blocks.select("file", "b", F.posexplode(F.split("block", "\n")).alias("n", "line"))
    label = F.when(F.col("line").rlike(QUESTION_MARK), "q").when(F.col("line").rlike(ANSWER_MARK), "a")
    own = Window.partitionBy("file", "b").orderBy("n")
    labelled = lines.withColumn("of", F.last(label, ignorenulls=True).over(own)).withColumn("said", F.when(label.isNotNull(), F.regexp_replace("line", r"^[^:]*:", "")).otherwise(F.col("line")))
    told = labelled.groupBy("file", "b").agg(
        F.max_by(F.when(F.col("of") == "q", X.strip(F.col("said"))), F.when(label == "q", F.col("n"))).alias("question"),
        X.strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("of") == "a", F.struct("n", X.strip(F.col("said")).alias("said"))))), lambda x: x["said"]), "\n")).alias("expected_answer"),
    )
    cases = told.select((F.col("b") + 1).alias("idx"), F.when(F.coalesce("question", F.lit("")) == "", F.concat(F.lit(DEFAULT_QUESTION), F.col("b") + 1)).otherwise(F.col("question")).alias("question"), "expected_answer")

    mark = F.when(F.col("mode") == "tab", "\t").otherwise("|")
    rows = source.where("mode IN ('tab', 'bar')").select(mark.alias("mark"), F.posexplode(F.filter(F.transform(F.split("t", "\n"), X.strip), lambda x: x != "")).alias("n", "line"))
    parted = rows.select((F.col("n") + 1).alias("idx"), X.strip(F.expr("substring_index(line, mark, 1)")).alias("question"), X.strip(F.expr("substring(line, length(substring_index(line, mark, 1)) + 2)")).alias("expected_answer"))
    plain = source.where("mode = 'plain'").select(F.lit(1).alias("idx"), F.lit(PLAIN_QUESTION).alias("question"), X.strip(F.col("t")).alias("expected_answer"))
    return cases.unionByName(parted).unionByName(plain).withColumn("error", F.when(F.coalesce("expected_answer", F.lit("")) == "", "empty_answer"))


def decoded_files(files: DataFrame) -> DataFrame:
    """(path, text, error) of binaryFile rows. Strict UTF-8 and UTF-16 by their marks, then CP949, in one Arrow pass."""
    return files.select("path", udfs.decoded(F.col("content")).alias("text")).withColumn("error", F.when(F.col("text").isNull(), "undecodable"))


#: Characters of members that a task gives on at once.
MEMBER_CHARS = 4 << 20
_MEMBER = pa.schema([(c, pa.string()) for c in ("archive", "member", "status", "text")])


def zip_members(files: DataFrame) -> DataFrame:
    """(archive, member, status, text) of every member of (path, content) zip rows, such as binaryFile gives: text, unsupported, or
    undecodable; an archive with an encrypted member, or one that can't be read, gives the one row of that status. Members are opened
    one after the other and given on in runs, so an archive's texts are never held together."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                held, size = [], 0
                for row in _members(path, content.as_buffer() if content.is_valid else b""):
                    held.append(row)
                    size += len(row["text"] or "")
                    if size >= MEMBER_CHARS:
                        yield pa.RecordBatch.from_pylist(held, schema=_MEMBER)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=_MEMBER)

    return files.select("path", "content").mapInArrow(run, "archive string, member string, status string, text string")


def _members(path: str, content):
    try:
        archive = zipfile.ZipFile(pa.BufferReader(content))
    except zipfile.BadZipFile:
        yield {"archive": path, "member": None, "status": "unreadable", "text": None}
        return
    files = [i for i in archive.infolist() if not i.is_dir()]
    if any(i.flag_bits & 1 for i in files):
        yield {"archive": path, "member": None, "status": "encrypted", "text": None}
        return
    for i in files:
        known = i.filename.rpartition(".")[2].lower() in TEXT_EXTENSIONS
        text = udfs.decode_text(archive.read(i)) if known else None
        yield {"archive": path, "member": i.filename, "status": "unsupported" if not known else "text" if text is not None else "undecodable", "text": text}


def member_counts(members: DataFrame) -> DataFrame:
    return members.groupBy("archive", "status").agg(F.count("*").alias("n"))


def xml_pages(pages: DataFrame, serial: str = "serial", xml: str = "xml", excluded=EXCLUDED_SECTIONS, image_prefix: str = IMAGE_PREFIX) -> DataFrame:
    """(serial, title, sections array<struct<name,text>>) of XML bodies; entities are resolved, image-only, unnamed and excluded
    sections dropped; a page without a title or a section gives no row."""
    schema = "svc struct<CNTNTSSJ:string, cntntsClList:struct<cntntsCl:array<struct<CNTNTS_CL_NM:string, CNTNTS_CL_CN:string>>>>"
    read = pages.select(serial, F.from_xml(F.col(xml), schema, {"rowTag": "response"}).alias("x"))
    unescaped = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(F.replace(X.strip(F.coalesce(c, F.lit(""))), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&#39;"), F.lit("'")), F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    raw = F.coalesce(F.col("x.svc.cntntsClList.cntntsCl"), F.array().cast("array<struct<CNTNTS_CL_NM:string,CNTNTS_CL_CN:string>>"))
    sections = F.transform(raw, lambda s: F.struct(X.strip(F.coalesce(s["CNTNTS_CL_NM"], F.lit(""))).alias("name"), unescaped(s["CNTNTS_CL_CN"]).alias("text")))
    kept = F.filter(sections, lambda s: (s["name"] != "") & (s["text"] != "") & ~s["text"].startswith(image_prefix) & ~s["name"].isin(*excluded))
    return read.select(serial, unescaped(F.col("x.svc.CNTNTSSJ")).alias("title"), kept.alias("sections")).where((F.col("title") != "") & (F.size("sections") > 0))


def source_profile(sources: dict[str, DataFrame], expected: list[str]) -> DataFrame:
    """(source, rows, present, missing, sample): columns come from the schemas, rows from one count each."""
    out = None
    for name, df in sources.items():
        present, missing = [c for c in expected if c in df.columns], [c for c in expected if c not in df.columns]
        one = df.agg(F.count("*").alias("rows"), F.first(F.to_json(F.struct(*df.columns))).alias("sample")).select(F.lit(name).alias("source"), "rows", F.array_join(F.array(*map(F.lit, present)), ",").alias("present"), F.array_join(F.array(*map(F.lit, missing)), ",").alias("missing"), "sample")
        out = one if out is None else out.unionByName(one)
    return out


def intake_gate(files: DataFrame, extensions=EXTENSIONS, most_bytes: int = 50 << 20) -> DataFrame:
    """(path, name, reason) of (path, length) rows: why a file is refused, or null. Contents aren't read."""
    name = F.regexp_extract(F.replace("path", F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return files.select("path", name.alias("name"), F.when((name == "") | ~extension.isin(*extensions), "unsupported").when(F.col("length") == 0, "empty").when(F.col("length") > most_bytes, "too_large").alias("reason"))


def readiness(text: Column, percent: Column, warnings: Column, words=REVIEW_WARNINGS) -> Column:
    bad = F.exists(warnings, lambda w: X.contains_any(w, words))
    return F.when((F.coalesce(text, F.lit("")) == "") | (percent < 80) | bad, "review").otherwise("ready")
