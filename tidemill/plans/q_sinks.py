"""SRC1, SRC2, SRC3, SRC5-SRC7, SNK1-SNK3, SNK5-SNK7, HOOK1: what is written is read back."""

import io
import zipfile

import pandas as pd
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidemill.functions import text as X
from tidemill.operators import ingest as I
from tidemill.operators import sft as S
from tidemill.plans.q_ingest import _INGEST, _REPORT, _records
from tidemill.plans.q_sft import SQL as _SFT_SQL
from tidemill.plans.q_sft import _typed
from tidemill.plans.tables import benchmark, conversations, documents, pages, scratch
from tidemill.sources import files as L
from tidemill.sources.stores import HashIndex, Store, write_stages


def _jsonl(s, d):
    path = scratch(s, "jsonl")
    benchmark(s, d).select("item_id", F.when(F.col("item_id") % 5 > 0, F.col("text")).alias("text")).write.json(path)
    return L.read_jsonl(s, path, ["text"], "item_id long, text string")


def _records_of(kind):
    def run(s, d):
        path = scratch(s, kind)
        df = conversations(s, d).select("conv_id", "turn", "role")
        out = df.groupBy("conv_id").agg(F.collect_list(F.struct("conv_id", "turn", "role")).alias("rows")).select(F.struct("rows").alias("data")) if kind == "jsonl" else df
        writer = out.write.option("header", "true")
        getattr(writer, "json" if kind == "jsonl" else kind)(f"{path}/deep/er")
        if kind == "jsonl":
            return L.read_records(s, path, kind, "data.rows", "*.json").select("conv_id", "turn", "role")
        return L.read_records(s, path, kind).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role")

    return run


def _truth(s, d):
    b = benchmark(s, d)
    return L.ground_truth(b.select(F.col("item_id").alias("idx"), F.when(F.col("item_id") % 2 == 0, F.col("text")).alias("query"), F.when(F.col("item_id") % 7 > 0, F.col("text")).alias("ground_truth")))


def _decoded(s, d):
    path = scratch(s, "text")
    benchmark(s, d).select("text").repartition(4, "text").write.text(path, lineSep="\x1e")
    files = s.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    return L.decoded_files(files).select(F.explode(F.split("text", "\x1e")).alias("text")).where("text <> ''")


def _xml(s, d):
    """Pages as XML bodies: the whole page as one section, an empty one and an excluded one."""
    escaped = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    section = lambda n, c: F.concat(F.lit(f"<cntntsCl><CNTNTS_CL_NM>{n}</CNTNTS_CL_NM><CNTNTS_CL_CN>"), c, F.lit("</CNTNTS_CL_CN></cntntsCl>"))
    body = F.concat(F.lit("<response><svc><CNTNTSSJ>"), escaped(F.col("url")), F.lit("</CNTNTSSJ><cntntsClList>"), section("a", F.concat(F.lit("page "), F.col("page_id").cast("string"), F.lit(" "), escaped(F.col("html")))), section("b", F.lit("")), section("참고문헌", F.lit("x")), F.lit("</cntntsClList></svc></response>"))
    return L.xml_pages(pages(s, d).select(F.col("page_id").alias("serial"), body.alias("xml"))).select("serial", "title", F.size("sections").alias("n"), F.get("sections", F.lit(0))["text"].alias("text"))


def _archives(s, d):
    """Pages in zip archives of sixteen; every fifth member is no text, every seventh can't be decoded."""
    kind = F.when(F.col("page_id") % 5 == 0, "png").when(F.col("page_id") % 7 == 0, "txt").otherwise("html")

    def packed(key, rows):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
            for r in rows.sort_values("page_id").itertuples():
                archive.writestr(f"{r.page_id}.{r.kind}", b"\xff\x00\xff" if r.kind == "txt" else (r.html or "").encode())
        return pd.DataFrame({"path": [f"a{key[0]}.zip"], "content": [held.getvalue()]})

    own = pages(s, d).select("page_id", "html", kind.alias("kind"), F.floor(F.col("page_id") / 16).cast("long").alias("archive"))
    return own.groupBy("archive").applyInPandas(packed, "path string, content binary")


def _stages(s, d):
    path = scratch(s, "stages")
    r = _records(s, d)
    write_stages({"raw": r, "processed": I.ingest(r).where("reason IS NULL").select("idx", "source", "cleaned")}, path)
    return s.read.parquet(f"{path}/raw").groupBy("source").agg(F.count("*").alias("raw")).join(s.read.parquet(f"{path}/processed").groupBy("source").agg(F.count("*").alias("processed")), "source")


def _store(s, d):
    """Three batches, one of which fails half way: readers see the documents and chunks of the other two."""
    store = Store(s, scratch(s, "store"))
    r = _records(s, d).select("document_key", "idx", "content")

    def tables(k):
        own = r.where(F.col("idx") % 3 == k)
        chunks = own.select("document_key", F.posexplode(F.split("content", "\n")).alias("chunk_index", "chunk"))
        return {"documents": own.select("document_key", "idx"), "chunks": chunks.withColumn("chunk", F.raise_error(F.lit("lost")).cast("string")) if k == 2 else chunks}

    store.write_batches([(f"b{k}", lambda k=k: tables(k)) for k in range(3)], lambda b: r.where(F.col("idx") % 3 == int(b[1:])))
    return store


def _visible(s, d):
    store = _store(s, d)
    return store.visible("documents").select("document_key", F.col("idx")).join(store.visible("chunks").groupBy("document_key").agg(F.count("*").alias("chunks")), "document_key")


def _errors(s, d):
    store = _store(s, d)
    return s.read.parquet(f"{store.path}/errors").select("document_key", F.contains("error", F.lit("lost")).alias("lost"))


def _index(s, d):
    index = HashIndex(s, scratch(s, "index"))
    r = _records(s, d).withColumn("content_hash", X.content_hash(F.col("content")))
    index.append(r.where("idx < 600"))
    index.append(r.where("idx >= 300"))
    return index.read()


def _sft_outputs(s, d):
    """Every row of the outputs as read back, with what statistics, log and configuration say of its split."""
    path = scratch(s, "sft")
    S.write(S.split(_typed(s, d), "data_type", "doc_id"), path, {"seed": 42, "held": S.SPLIT})
    statistics = s.read.parquet(f"{path}/statistics").join(s.read.parquet(f"{path}/log").groupBy("split").agg(F.max("n").alias("logged")), "split")
    config = s.read.json(f"{path}/config").select(F.col("seed").alias("seed"), "held")
    return s.read.parquet(f"{path}/messages").join(F.broadcast(statistics), "split").crossJoin(F.broadcast(config)).select("doc_id", "data_type", "split", "n", "logged", "seed", "held")


def _hooks(s, d):
    """The stages' counts, observed by the job that writes the records."""
    seen, path = Observation("stages"), scratch(s, "observed")
    I.observed(I.ingest(_records(s, d)), seen).select("idx", "status").write.parquet(path)
    stages = s.createDataFrame(list(seen.get.items()), "stage string, n long")
    return stages.withColumn("written", F.lit(s.read.parquet(path).count()).cast("long"))


QUERIES = {
    "src1_read_jsonl": _jsonl,
    "src2_read_csv": _records_of("csv"),
    "src2_read_parquet": _records_of("parquet"),
    "src2_read_jsonl_root": _records_of("jsonl"),
    "src3_ground_truth": _truth,
    "src4_labelled_text": lambda s, d: L.ground_truth_text(benchmark(s, d).select(F.concat(F.lit("question: q\nanswer: "), F.regexp_replace("text", "\n", " "), F.lit("\nmore\n---\nanswer: b")).alias("value"))).select("idx", "question", "expected_answer"),
    "src5_decoded_files": _decoded,
    "src6_zip_members": lambda s, d: L.zip_members(_archives(s, d)),
    "src6_member_counts": lambda s, d: L.member_counts(L.zip_members(_archives(s, d))),
    "src7_xml_pages": _xml,
    "snk1_stage_writers": _stages,
    "snk2_store": _visible,
    "snk3_staged_publish": lambda s, d: _visible(s, d).select("document_key"),
    "snk5_hash_index": _index,
    "snk6_sft_outputs": _sft_outputs,
    "snk7_quarantine": _errors,
    "hook1_observers": _hooks,
}

_KEY = "'hf-dataset://' || source || '/' || doc_id"
_TRIM = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_UNESCAPED = r"""regexp_replace('page ' || page_id || ' ' || coalesce(html, ''), '^\s+|\s+$', '', 'g')"""
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _UNESCAPED = f"replace({_UNESCAPED}, '{_a}', '{_b}')"
_ZIPPED = """z AS (SELECT 'a' || page_id // 16 || '.zip' AS archive, page_id || CASE WHEN page_id % 5 = 0 THEN '.png' WHEN page_id % 7 = 0 THEN '.txt' ELSE '.html' END AS member,
CASE WHEN page_id % 5 = 0 THEN 'unsupported' WHEN page_id % 7 = 0 THEN 'undecodable' ELSE 'text' END AS status, CASE WHEN page_id % 5 > 0 AND page_id % 7 > 0 THEN coalesce(html, '') END AS text FROM pages)"""
SQL = {
    "src6_zip_members": f"WITH {_ZIPPED} SELECT * FROM z",
    "src6_member_counts": f"WITH {_ZIPPED} SELECT archive, status, count(*) AS n FROM z GROUP BY ALL",
    "src1_read_jsonl": "SELECT item_id, text FROM benchmark WHERE item_id % 5 > 0",
    "src2_read_csv": "SELECT conv_id, turn, role FROM conversations",
    "src2_read_parquet": "SELECT conv_id, turn, role FROM conversations",
    "src2_read_jsonl_root": "SELECT conv_id, turn, role FROM conversations",
    "src3_ground_truth": "SELECT item_id AS idx, CASE WHEN item_id % 2 = 0 THEN trim(text) ELSE '항목 ' || item_id END AS question, CASE WHEN item_id % 7 > 0 THEN text ELSE '' END AS expected_answer, CASE WHEN item_id % 7 = 0 THEN 'empty_answer' END AS error FROM benchmark",
    "src4_labelled_text": "SELECT 1 AS idx, 'q' AS question, replace(text, chr(10), ' ') || chr(10) || 'more' AS expected_answer FROM benchmark UNION ALL SELECT 2, '항목 2', 'b' FROM benchmark",
    "src5_decoded_files": "SELECT text FROM benchmark",
    "src7_xml_pages": rf"""SELECT page_id AS serial, url AS title, 1 AS n, {_UNESCAPED} AS text FROM pages""",
    "snk6_sft_outputs": f"""WITH s AS ({_SFT_SQL['top10_split']}), n AS (SELECT split, count(*) AS n FROM s GROUP BY split) SELECT doc_id, data_type, split, n, n AS logged, 42::BIGINT AS seed, 0.2::DOUBLE AS held FROM s JOIN n USING (split)""",
    "hook1_observers": f"""{_INGEST}, r AS ({_REPORT}) SELECT stage, n::BIGINT AS n, (SELECT count(*) FROM documents) AS written
FROM (SELECT 'raw' AS stage, sum(raw) AS n FROM r UNION ALL SELECT 'processed', sum(after_clean) FROM r UNION ALL SELECT 'duplicate', sum(duplicate) FROM r UNION ALL SELECT 'record', sum(after_dedup) FROM r)""",
    "snk2_store": f"SELECT {_KEY} AS document_key, doc_id AS idx, len(string_split(text, chr(10)))::BIGINT AS chunks FROM documents WHERE doc_id % 3 < 2",
    "snk3_staged_publish": f"SELECT {_KEY} AS document_key FROM documents WHERE doc_id % 3 < 2",
    "snk5_hash_index": f"SELECT DISTINCT sha256({_TRIM}) AS content_hash FROM documents",
    "snk7_quarantine": f"SELECT {_KEY} AS document_key, true AS lost FROM documents WHERE doc_id % 3 = 2",
}
