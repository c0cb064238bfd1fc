"""WEB1-WEB3, OCR1, OCR2, WIN5, WIN13, AGG19, AGG20, FLT21, FLT22, SRC1, SRC4, SRC8, SRC9 over pages and documents."""

from pyspark.sql import functions as F

from tidemill.operators import ocr_lines as O
from tidemill.plans.tables import benchmark, conversations, documents, pages
from tidemill.sources import files as S
from tidemill.sources import web as W


def _unit(c):
    """A number in [0, 1) of a string, the same in SQL."""
    return F.conv(F.substring(F.md5(c), 1, 6), 16, 10).cast("long") / F.lit(16777216.0)


def _lines(s, d):
    """Lines of documents as recognised lines: ten a page, confidence and place by hash."""
    e = documents(s, d).select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    key = F.concat("doc", F.lit(":"), "line_no")
    return e.select("doc", F.floor(F.col("line_no") / 10).cast("int").alias("page"), "line_no", "text", _unit(key).alias("confidence"), F.floor(_unit(F.concat(F.lit("y"), key)) * 4).alias("y"), F.col("line_no").cast("double").alias("x"))


_LINES = r"""raw AS (SELECT doc_id AS doc, i - 1 AS line_no, l[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
lines AS (SELECT doc, (line_no // 10)::INT AS page, line_no, text, ('0x' || md5(doc || ':' || line_no)[1:6])::BIGINT / 16777216.0::DOUBLE AS confidence, floor(('0x' || md5('y' || doc || ':' || line_no)[1:6])::BIGINT / 16777216.0::DOUBLE * 4) AS y FROM raw),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY y, line_no) AS place FROM lines WHERE confidence >= 0.5),
once AS (SELECT * FROM (SELECT *, lag(trim(text)) OVER (PARTITION BY doc, page ORDER BY place) AS last FROM placed) WHERE last IS NULL OR last <> trim(text))"""
_TIDY = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '[ \t]+', ' ', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
_PAGES = f"p AS (SELECT doc, page, {_TIDY.replace('{}', 'string_agg(text, chr(10) ORDER BY place)', 1)} AS t FROM once GROUP BY doc, page)"


def _kinds(s, d):
    source = F.element_at(F.array(*map(F.lit, ("ocr", "digital", "empty", "ocr", "hybrid"))), (F.col("doc") * 7 + F.floor(F.col("page") / 2)).cast("int") % 5 + 1)
    return O.document_kind(_lines(s, d).select("doc", "page").distinct().withColumn("source", source))


def _files(s, d):
    return pages(s, d).select(F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.element_at(F.array(F.lit(".html"), F.lit(".txt"), F.lit(".PDF")), (F.col("page_id") % 3 + 1).cast("int"))).alias("path"), (F.col("page_id") % 50).alias("length"))


QUERIES = {
    "web1_main_content": lambda s, d: W.parsed(pages(s, d)).select("id", "title", "text"),
    "web2_images": lambda s, d: W.image_table(W.parsed(pages(s, d).withColumn("html", F.regexp_replace("html", "</article>", '<img src="/a.png"><img data-src="b.jpg" alt="B"><img src="/a.png"><img src="/logo.png"></article>')))),
    "web3_page_gate": lambda s, d: W.parsed(pages(s, d)).select("id", W.gate(F.col("text"), F.col("images")).alias("reason")),
    "flt21_decorative": lambda s, d: W.parsed(pages(s, d).withColumn("html", F.regexp_replace("html", "</article>", '<img src="/x.png"><img src="/site_icon.png"></article>'))).select(F.explode("images").alias("i")).groupBy("i.decorative").agg(F.count("*").alias("n")),
    "flt22_readiness": lambda s, d: O.document_confidence(_lines(s, d)).select("doc", S.readiness(F.lit("text"), 100 * F.col("confidence"), F.when(F.col("doc") % 5 == 0, F.array(F.lit("이미지 실패"))).otherwise(F.array().cast("array<string>"))).alias("readiness")),
    "ocr1_page_text": lambda s, d: O.page_text(_lines(s, d)),
    "ocr2_document_confidence": lambda s, d: O.document_confidence(_lines(s, d)),
    "win5_drop_repeats": lambda s, d: O.drop_repeats(O.reading_order(_lines(s, d).where("confidence >= 0.5"))).select("doc", "line_no"),
    "win13_reading_order": lambda s, d: O.reading_order(_lines(s, d).where("confidence >= 0.5")).select("doc", "line_no", "place"),
    "agg19_archive_confidence": lambda s, d: O.archive_confidence(_lines(s, d).withColumn("archive", F.col("doc") % 20)),
    "agg20_document_kind": _kinds,
    "src8_source_profile": lambda s, d: S.source_profile({"documents": documents(s, d), "benchmark": benchmark(s, d), "conversations": conversations(s, d)}, ["doc_id", "text", "role"]).select("source", "rows", "present", "missing"),
    "src9_intake_gate": lambda s, d: S.intake_gate(_files(s, d), most_bytes=40),
}

SQL = {
    "flt22_readiness": f"WITH {_LINES} SELECT doc, CASE WHEN round(avg(confidence), 6) * 100 < 80 OR doc % 5 = 0 THEN 'review' ELSE 'ready' END AS readiness FROM lines GROUP BY doc",
    "ocr1_page_text": f"WITH {_LINES}, {_PAGES} SELECT doc, CASE WHEN count(*) > 1 THEN string_agg('--- 페이지 ' || (page + 1) || ' ---' || chr(10) || t, chr(10) || chr(10) ORDER BY page) ELSE any_value(t) END AS text FROM p GROUP BY doc",
    "ocr2_document_confidence": f"WITH {_LINES} SELECT doc, round(avg(confidence), 6) AS confidence, count(*) AS lines FROM lines GROUP BY doc",
    "win5_drop_repeats": f"WITH {_LINES} SELECT doc, line_no FROM once",
    "win13_reading_order": f"WITH {_LINES} SELECT doc, line_no, place FROM placed",
    "agg19_archive_confidence": f"WITH {_LINES} SELECT doc % 20 AS archive, round(sum(confidence * greatest(length(text), 1)) / sum(greatest(length(text), 1)), 6) AS confidence FROM lines GROUP BY 1",
    "agg20_document_kind": f"""WITH {_LINES}, k AS (SELECT DISTINCT doc, page FROM lines), s AS (SELECT doc, ['ocr', 'digital', 'empty', 'ocr', 'hybrid'][(doc * 7 + page // 2) % 5 + 1] AS source FROM k)
SELECT doc, CASE WHEN bool_and(source IN ('ocr', 'empty')) THEN 'scanned' WHEN bool_or(source IN ('ocr', 'hybrid')) THEN 'hybrid' ELSE 'digital' END AS kind FROM s GROUP BY doc""",
    "src8_source_profile": "SELECT 'documents' AS source, count(*) AS rows, 'doc_id,text' AS present, 'role' AS missing FROM documents UNION ALL SELECT 'benchmark', count(*), 'text', 'doc_id,role' FROM benchmark UNION ALL SELECT 'conversations', count(*), 'text,role', 'doc_id' FROM conversations",
    "src9_intake_gate": r"""WITH f AS (SELECT regexp_replace(url, '[?#].*$', '') || ['.html', '.txt', '.PDF'][page_id % 3 + 1] AS path, page_id % 50 AS length FROM pages), n AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name FROM f)
SELECT path, name, CASE WHEN lower(regexp_extract(name, '\.([^.]+)$', 1)) NOT IN ('txt', 'pdf') THEN 'unsupported' WHEN length = 0 THEN 'empty' WHEN length > 40 THEN 'too_large' END AS reason FROM n""",
}
