"""Golden cases of the library's rules, and invariants of its jobs."""

import json
import math
import zipfile

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidemill.functions import text as X
from tidemill.functions import udfs
from tidemill.operators import conversations as V
from tidemill.operators import dashboard as D
from tidemill.operators import embedding as E
from tidemill.operators import evaluation, ingest, retrieval, sft
from tidemill.sources import adapters as A
from tidemill.sources import files, web
from tidemill.sources.stores import HashIndex, Store

SF = "/root/testdata/sf0.001"


def values(spark, texts, expression):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[1] for r in df.select("i", expression(F.col("t"))).orderBy("i").collect()]


def test_cleaning_gates(spark):
    texts = ["정상적인 의료 문장이 여기에 있습니다.", "혈압은 120/80, 38.5% 입니다 그리고 10mg", "짧음", "", "깨진 문자 � 가 들어 있는 문장입니다", "<b>태그</b>가 남아 있는 문장입니다", "Assistant: 이 문장은 새어 나온 형식", "☃☃☃☃☃☃☃☃☃☃☃☃☃☃☃☃☃☃", "γ-GT 와 α 차단제에 대한 설명 문장입니다"]
    assert values(spark, texts, X.reject_reason) == [None, None, "too_short", "too_short", "broken_unicode", "html_residue", "prompt_wrapper", "junk_ratio", None]
    assert values(spark, ["  정상적인 의료 문장이 여기 있습니다. \n"], X.clean_content) == ["정상적인 의료 문장이 여기 있습니다."]
    assert values(spark, ["권장 용량은 하루 500mg", "응급 상황", "수술  적응증", "물을 드세요"], X.needs_review) == [True, True, True, False]


def test_sentences_and_blocks(spark):
    assert values(spark, ["하나. 둘! 셋? 넷"], X.split_sentences) == [["하나.", "둘!", "셋?", "넷"]]
    assert values(spark, ["가\n\n나\n제 1 조 다\n제2조 라"], lambda c: F.size(X.hard_blocks(c))) == [4]
    assert values(spark, ["   ", "---***///", "두통"], X.garbage) == [True, True, False]


def test_emergency_and_dosage(spark):
    asked = ["숨쉬기가 너무 힘들어요", "가슴 한가운데가 쥐어짜듯이 아파요", "의식을 잃었어요", "감기 기운이 있어요", "가슴\n통증"]
    assert values(spark, asked, X.emergency) == [True, True, True, False, False]
    assert values(spark, ["하루 3정씩", "3정도 쉬세요", "500 mg", "5ML", "물 많이"], X.risky_dosage) == [True, False, True, True, False]


def test_scalar_rules(spark):
    assert values(spark, ["설명입니다.\n정답은: 감기", "\n정답은 감기"], X.strip_restatement) == ["설명입니다.", "\n정답은 감기"]
    assert values(spark, ["a@b.co 010-1234-5678"], X.mask_pii) == ["[이메일] [전화번호]"]
    assert values(spark, ["<think>x\ny</think>\nStep 1: 확인\n결론"], X.strip_reasoning) == ["확인 결론"]
    assert values(spark, ["ｆｕｌｌ  Width"], lambda c: X.normalize_answer(c, udfs.nfkc)) == ["full width"]
    assert values(spark, ["한글 MRI", "ひらがな", "漢字", "english", "123"], X.input_language) == ["ko", "ja", "zh", "en", "ko"]
    assert values(spark, ["HTTP://Ex.com:80/a#x", "https://a@b.c/", "ftp://x", "https://h.org:8443/", "https://h.org?q=1"], X.canonical_url) == ["http://ex.com/a", None, None, None, "https://h.org/?q=1"]


def test_answer_metrics(spark):
    df = spark.createDataFrame([("충분한 휴식", "충분한 휴식"), ("고혈압 관리", "고혈압 약물 관리"), ("", ""), ("가", "")], "a string, b string")
    rows = df.select(X.exact_match(F.col("a"), F.col("b")), X.token_f1(F.col("a"), F.col("b")), udfs.sequence_ratio(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in rows] == [1, 0, 1, 0] and [round(r[1], 3) for r in rows] == [1, 0.8, 1, 0]
    assert rows[2][2] == 1 and 0 < rows[1][2] < 1


def test_retrieval_metrics(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "rank int")
    rows = df.select(X.ndcg_at(F.col("rank"), 5), X.precision_at(F.col("rank"), 5), X.recall_at(F.col("rank"), 1), X.reciprocal_rank(F.col("rank")), X.precision_at(F.col("rank"), 0)).collect()
    assert [tuple(round(x, 6) for x in r) for r in rows] == [(1, 0.2, 1, 1, 0), (round(1 / math.log2(3), 6), 0.2, 0, 0.5, 0), (0, 0, 0, 0, 0)]


def test_fusion_and_boosts(spark):
    lists = [("q", 0, "A", 1), ("q", 0, "B", 2), ("q", 0, "C", 3), ("q", 1, "B", 1), ("q", 1, "C", 2), ("q", 1, "A", 3)]
    fused = retrieval.fuse(spark.createDataFrame(lists, "query_id string, list_no int, id string, rank int"))
    assert [r.id for r in fused.orderBy(F.desc("score"), "first_list", "first_rank").collect()] == ["B", "A", "C"]
    assert retrieval.candidates_per_provider(5) == 20 and retrieval.candidates_per_provider(10) == 40
    df = spark.createDataFrame([(1 / 61, 4, ["피부과"]), (1 / 62, 1, ["정형외과"]), (1 / 62, None, None)], "s double, tier int, d array<string>")
    got = [r[0] for r in df.select(retrieval.boosted(F.col("s"), F.col("tier"), F.col("d"), F.lit("정형외과"))).collect()]
    assert got[1] > got[0] and got[2] == 1 / 62


def test_vector_search(spark):
    corpus = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("c", [0.0, 0.0, 1.0]), ("n", None)], "id string, vector array<double>")
    asked = spark.createDataFrame([("qa", [0.9, 0.1, 0.0]), ("qb", [0.1, 0.9, 0.0])], "query_id string, vector array<double>")
    found = retrieval.vector_topk(asked, corpus, 3).withColumn("config", F.lit("x"))
    relevant = spark.createDataFrame([("qa", "a"), ("qb", "b"), ("none", "a")], "query_id string, relevant_id string")
    one = evaluation.retrieval_metrics(evaluation.relevant_ranks(found, relevant, ["x"]), (1, 3)).first()
    assert one.queries == 3 and one.recall_1 == round(2 / 3, 6) == one.mrr
    assert retrieval.vector_topk(asked.limit(0), corpus, 3).count() == 0


def test_ties_at_the_cut_go_to_the_smaller_id(spark):
    corpus = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)], "id long, vector array<double>").repartition(5)
    found = retrieval.vector_topk(spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<double>"), corpus, 7)
    assert sorted(r.id for r in found.collect()) == list(range(7))


def test_hashing_embedding(spark):
    df = spark.createDataFrame([(1, "머리가 아파요 머리"), (2, ""), (3, "무릎이 아파요")], "id int, text string")
    native = {r.id: r.vector for r in E.hashing_embedding(df, 32).collect()}
    vectors = E.HashingProvider("h", 32).embed_texts(["머리가 아파요 머리", "", "무릎이 아파요"])
    for i, v in zip((1, 2, 3), vectors):
        assert native[i] == pytest.approx(v)
    assert sum(native[2]) == 0 and sum(x * x for x in native[1]) == pytest.approx(1)


def test_provider_retries(spark):
    class Flaky(E.HashingProvider):
        calls = 0

        def embed_texts(self, texts):
            Flaky.calls += 1
            if Flaky.calls == 1:
                raise E.Transient
            return super().embed_texts(texts)

    df = spark.createDataFrame([(1, "a"), (2, "  "), (3, "b")], "id int, text string").coalesce(1)
    assert E.embed(df, lambda: Flaky("f", 8), pause=0.01).count() == 2


def test_adapters(spark):
    q = "증례 설명입니다. 다음 중 가장 가능성이 높은 질환은?"
    raw = spark.createDataFrame([(0, q, None, "해설", "q1", "Cardiology", None, "책"), (1, "다음 중 옳은 것은?", "검사", "해설", None, "unknown", "흉통", None), (2, "", None, "해설", None, None, None, None)], "idx long, question string, exam string, explanation string, question_id string, category string, chief_complaint string, source string")
    rows = A.clinical_qa(raw).orderBy("original_id").collect()
    assert [(r.original_id, r.content, r.department) for r in rows] == [("1", "다음 중 옳은 것은?\n\n검사\n\n해설", []), ("q1", "증례 설명입니다.\n\n해설", ["순환기내과"])]
    raw = spark.createDataFrame([(0, "질문 하나", "<noinput>", "설명입니다\n정답은: 감기"), (1, "질문", None, "인공지능인 저는 모릅니다"), (2, "같은 문장을 그대로 복사합니다", "", "같은 문장을 그대로 복사합니다"), (3, "지시", "입력", "완전히 새로운 설명")], "idx long, instruction string, input string, output string")
    assert [(r.original_id, r.content) for r in A.instruct(raw).orderBy("original_id").collect()] == [("0", "질문 하나\n\n설명입니다"), ("3", "지시\n\n입력\n\n완전히 새로운 설명")]
    with pytest.raises(KeyError, match="there are"):
        A.adapter("nothing")
    with pytest.raises(PermissionError):
        A.adapter("gated")(raw)


def test_metadata_defaults(spark):
    raw = spark.createDataFrame([(0, "질문", "권장 용량은 500mg", None, None)], "idx long, question_ko string, answer_ko string, id string, question string")
    m = A.document_metadata(A.consumer_qa(raw)).first().metadata
    assert (m.language, m.reliability_tier, m.needs_review, m.source_tier, m.generated_metadata) == ("ko", "확인 필요", True, 3, False)


def test_chunking(spark):
    words = ingest.Words()
    pieces = ingest.pack_block(["a b c d e.", "f g h i j.", "k l m n o."], words, 8, 2)
    assert pieces == ["a b c d e.", "e. f g h i j.", "j. k l m n o."] and all(len(words.spans(p)) <= 8 for p in pieces)
    long = ingest.pack_block([" ".join("abcdefghij")], words, 4, 1)
    assert long == ["a b c d", "d e f g", "g h i j"]
    df = spark.createDataFrame([(1, "첫 문단입니다.\n\n둘째 문단입니다."), (2, "   ...---   "), (3, None)], "id int, t string")
    assert [(r.id, r.chunk_index, r.chunk) for r in ingest.chunk_documents(df, "id", "t").orderBy("id", "chunk_index").collect()] == [(1, 0, "첫 문단입니다."), (1, 1, "둘째 문단입니다.")]
    text = "".join(p for p in ["one two. three four\n\nfive six seven eight nine ten"])
    got = ingest.character_chunks(text, 20, 5)
    assert "".join(dict.fromkeys(text)) and got[0] == (0, "one two. three four") and got[-1][1].endswith("ten")
    with pytest.raises(ValueError):
        ingest.character_chunks("abc", 5, 5)


def test_pipeline_counts_and_observers(spark):
    long = "정상적인 의료 문장이 여기에 있습니다."
    rows = [(0, "s", 1, long), (1, "s", 1, "짧음"), (2, "s", 1, long), (3, "s", 1, long + " 한 문장 더 있습니다.")]
    df = spark.createDataFrame(rows, "idx long, source string, priority int, content string")
    seen = {}
    out = ingest.ingest(df, observers={k: (lambda d, k=k: seen.__setitem__(k, d.count())) for k in ("raw", "processed", "duplicate", "record")})
    r = ingest.report(out).first()
    assert (r.raw, r.after_clean, r.duplicate, r.after_dedup) == (4, 3, 1, 2) and seen == {"raw": 4, "processed": 3, "duplicate": 1, "record": 2}
    observation = Observation("stages")
    assert ingest.observed(ingest.ingest(df), observation).count() == 4 and observation.get == seen
    more = ingest.report(out, skipped=df.limit(1), failed=df.limit(0)).first()
    assert (more.skipped, more.failed) == (1, 0)


def test_store_publishes_whole_batches(spark, tmp_path):
    store, index = Store(spark, f"{tmp_path}/store"), HashIndex(spark, f"{tmp_path}/index")
    docs = spark.createDataFrame([("k1", "h1"), ("k2", "h2")], "document_key string, content_hash string")
    assert store.visible("documents") is None and index.read().count() == 0
    store.write("b1", {"documents": docs})
    index.append(docs)
    bad = docs.withColumn("x", F.raise_error(F.lit("no")))
    with pytest.raises(Exception, match="no"):
        store.write("b2", {"documents": docs.withColumn("document_key", F.lit("k9")), "chunks": bad})
    assert {r.document_key for r in store.visible("documents").collect()} == {"k1", "k2"}
    store.write_batches([("b3", lambda: {"chunks": bad}), ("b4", lambda: {"documents": docs})], lambda b: docs)
    assert spark.read.parquet(f"{store.path}/errors").count() == 2 and store.visible("documents").count() == 4
    index.append(docs.unionByName(spark.createDataFrame([("k3", "h3")], "document_key string, content_hash string")))
    assert sorted(r[0] for r in index.read().collect()) == ["h1", "h2", "h3"]


def test_streams_equal_their_batch_twins(spark, tmp_path):
    from tidemill.streaming import jobs as J

    long = "정상적인 의료 문장이 여기에 있습니다."
    rows = [(f"k{i}", "s", 1, i, t) for i, t in enumerate([long, "짧음", long, long + " 더 있습니다.", "또 다른 정상적인 의료 문장이 있습니다."])]
    schema = "document_key string, source string, priority int, idx long, content string"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    store, index = Store(spark, f"{tmp_path}/store"), HashIndex(spark, f"{tmp_path}/index")

    def run():
        J.ingest_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), store, index, f"{tmp_path}/checkpoint").awaitTermination()
        return store.visible("documents")

    batch = ingest.ingest(spark.createDataFrame(rows, schema)).where("status = 'kept'")
    assert {r.content_hash for r in run().collect()} == {r.content_hash for r in batch.collect()}
    n = store.visible("documents").count()
    assert run().count() == n == index.read().count()


def test_throttle_stream(spark, tmp_path):
    from tidemill.streaming import jobs as J

    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    want = {r.event_id: r.allowed for r in J.throttle(events, 3, 48).collect()}
    J.use_rocksdb(spark)
    events.coalesce(1).write.parquet(f"{tmp_path}/events")
    q = J.throttle_stream(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events"), 3, 48).writeStream.format("memory").queryName("throttled").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.event_id: r.allowed for r in spark.table("throttled").collect()} == want


def test_history(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(16)]
    rows += [(2, 0, "system", "s"), (2, 1, "assistant", "orphan"), (2, 2, "user", "failed"), (2, 3, "user", " "), (2, 4, "assistant", "a"), (2, 5, "user", "q"), (2, 6, "assistant", "r"), (2, 7, "user", "last")]
    p = V.pairs(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    h = V.history(p)
    assert [r.turn for r in h.where("conv_id = 1").orderBy("turn").collect()] == [5, 7, 9, 11, 13, 15]
    assert [(r.question, r.answer) for r in h.where("conv_id = 2").collect()] == [("q", "r")]
    big = spark.createDataFrame([(3, 1, "x" * 6000, "y"), (3, 3, "q", "a")], "conv_id int, turn int, question string, answer string")
    assert [r.turn for r in V.history(big).collect()] == [3]


def test_usage_buckets(spark):
    rows = [(f"u{i}", n) for i, n in enumerate((3, 7, 15, 25, 30))]
    log = spark.createDataFrame(rows, "user_id string, n int").select("user_id", F.explode(F.sequence(F.lit(1), "n")), F.lit("2024-01-30 10:00:00").cast("timestamp").alias("created_at"))
    assert {r.bucket: r.users for r in D.usage_histogram(log, "2024-01-30").collect()} == {"1-5": 1, "6-10": 1, "11-20": 1, "21+": 2}
    assert [D.clamp_days(x) for x in (None, 0, 500)] == [14, 1, 90]


def test_mcq_and_dialogue(spark):
    df = spark.createDataFrame([("두통의 원인은?", "감기", "암", "", None, 1, "B", "설명")], "question string, A string, B string, C string, D string, answer_idx int, answer string, cot string")
    m = sft.mcq_columns(df).first().messages
    assert m[1].content == "정답은 B입니다. B. 암" or m[1].content == "정답은 B입니다.\n\nB. 암"
    assert sft.mcq_numbered(df.withColumn("E", F.lit(None).cast("string")).withColumn("answer", F.lit("1"))).first().messages[1].content == "A) 감기\n설명"
    turns = spark.createDataFrame([([("human", "안녕"), ("gpt", "네"), ("human", " ")],), ([("doctor", "네")],)], "conversations array<struct<role:string,content:string>>")
    assert sft.turn_column(turns) == "conversations"
    got = [r[0] for r in turns.select(sft.standard_turns(F.col("conversations"))).collect()]
    assert [m.role for m in got[0]] == ["user", "assistant"] and got[1] is None
    with pytest.raises(ValueError):
        sft.by_path(turns)


def test_split_is_disjoint_and_mix_keeps_ratios(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.element_at(F.array(*map(F.lit, sft.RATIOS)), (F.col("id") % 3 + 1).cast("int")).alias("kind"))
    s = sft.split(df, "kind", "k")
    assert s.count() == 1000 and {(r.split, r["count"]) for r in s.where("kind = 'medical_knowledge'").groupBy("split").count().collect()} == {("train", 267), ("validation", 34), ("test", 33)}
    kept = {r.kind: r["count"] for r in sft.mix(df, "kind", "k").groupBy("kind").count().collect()}
    assert kept["medical_knowledge"] == 334 and abs(kept["medical_reasoning"] / kept["medical_knowledge"] - 25 / 60) < 0.01


def test_web_page(spark):
    html = """<html><head><title> A &amp; B </title></head><body><nav>menu</nav><div class="sidebar"><p>short</p></div><div id="post-content"><h2>Head</h2><p>Long paragraph of text, long enough.</p><ul><li>one <p>inner</p></li></ul>
    <img src="/a.png" alt="Pic"><img data-src="b.jpg"><div class="site_logo"><img src="c.png"></div><img src="data:x"></div><footer>foot</footer></body></html>"""
    page = web.parse(html, "https://h.org/x/")
    assert page["title"] == "A & B" and page["text"] == "## Head\n\nLong paragraph of text, long enough.\n\none  inner"
    assert [(i["url"], i["decorative"]) for i in page["images"]] == [("https://h.org/a.png", False), ("https://h.org/x/b.jpg", False), ("https://h.org/x/c.png", True)]
    df = spark.createDataFrame([(1, "https://h.org/x/", html), (2, None, None), (3, "https://t.org", "<p>only")], "page_id int, url string, html string")
    parsed = web.parsed(df)
    assert [(r.place, r.label) for r in web.image_table(parsed).orderBy("place").collect()] == [(1, "Pic"), (2, "웹페이지 이미지 2")]
    assert [r[0] for r in parsed.orderBy("id").select(web.gate(F.col("text"), F.col("images"))).collect()] == [None, "empty", None]


def test_ground_truth_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"cases": [{"question": "Q", "answer": " A "}, {"질문": "큐", "정답": ""}]}))
    (tmp_path / "b.jsonl").write_text('{"query": "Q1", "ground_truth": "G"}\n\n{"answer": "only"}\n')
    (tmp_path / "c.csv").write_text("question;expected_answer\nQ;A\nR;B\n")
    (tmp_path / "d.txt").write_text("질문: 하나\n정답: 첫 줄\n둘째 줄\n---\nanswer: 끝")
    (tmp_path / "e.txt").write_text("q1\ta1\nq2\ta2")
    (tmp_path / "f.txt").write_text("그냥 정답")
    read = lambda n: [(r.idx, r.question, r.expected_answer, r.error) for r in files.read_ground_truth(spark, str(tmp_path / n)).orderBy("idx").collect()]
    assert read("a.json") == [(1, "Q", "A", None), (2, "큐", "", "empty_answer")]
    assert [x[1:3] for x in read("b.jsonl") if x[2]] == [("Q1", "G"), (read("b.jsonl")[-1][1], "only")]
    assert read("c.csv") == [(1, "Q", "A", None), (2, "R", "B", None)]
    assert read("d.txt") == [(1, "하나", "첫 줄\n둘째 줄", None), (2, "항목 2", "끝", None)]
    assert read("e.txt") == [(1, "q1", "a1", None), (2, "q2", "a2", None)]
    assert read("f.txt") == [(1, "직접 입력 항목", "그냥 정답", None)]


def test_records_zip_and_encodings(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/deep/x.json").write_text(json.dumps({"data": {"rows": [{"a": 1}, {"a": 2}]}}))
    assert [r.a for r in files.read_records(spark, str(tmp_path / "in"), "json", "data.rows").orderBy("a").collect()] == [1, 2]
    (tmp_path / "t").mkdir()
    for n, b in {"u8": "가".encode("utf-8-sig"), "u16": "가".encode("utf-16"), "cp": "가나".encode("cp949"), "nul": b"a\0b", "bad": b"\xff\xff\xff"}.items():
        (tmp_path / f"t/{n}.txt").write_bytes(b)
    got = {r.path.rsplit("/", 1)[-1]: r.text for r in files.decoded_files(spark.read.format("binaryFile").load(str(tmp_path / "t"))).collect()}
    assert got == {"u8.txt": "가", "u16.txt": "가", "cp.txt": "가나", "nul.txt": None, "bad.txt": None}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.txt", "글")
        z.writestr("b.exe", b"\0")
    (tmp_path / "y.zip").write_bytes(b"no zip")
    members = files.zip_members(spark.read.format("binaryFile").load(str(tmp_path / "*.zip")))
    assert sorted((r.member, r.status, r.text) for r in members.where("member IS NOT NULL").collect()) == [("a.txt", "text", "글"), ("b.exe", "unsupported", None)]
    assert {r.status for r in files.member_counts(members).collect()} == {"text", "unsupported", "unreadable"}


def test_xml_pages(spark):
    body = "<response><svc><CNTNTSSJ>제목</CNTNTSSJ><cntntsClList><cntntsCl><CNTNTS_CL_NM>개요</CNTNTS_CL_NM><CNTNTS_CL_CN><![CDATA[a &amp; b]]></CNTNTS_CL_CN></cntntsCl><cntntsCl><CNTNTS_CL_NM>참고문헌</CNTNTS_CL_NM><CNTNTS_CL_CN>x</CNTNTS_CL_CN></cntntsCl></cntntsClList></svc></response>"
    df = spark.createDataFrame([(1, body), (2, "<response><svc><CNTNTSSJ>빈</CNTNTSSJ></svc></response>")], "serial int, xml string")
    rows = files.xml_pages(df).collect()
    assert [(r.serial, r.title, [tuple(s) for s in r.sections]) for r in rows] == [(1, "제목", [("개요", "a & b")])]
    assert A.government(files.xml_pages(df)).first().content == "## 개요\na & b"


def test_queries_are_registered_without_a_session():
    import subprocess
    import sys

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q))"], capture_output=True, text=True, cwd=str(__import__("pathlib").Path(__file__).parent.parent))
    assert int(said.stdout) > 150, said.stderr


def test_a_batch_written_again_is_seen_once(spark, tmp_path):
    """A batch that fails half way and is run again under its name, and one that is written twice, show their last attempt alone."""
    store = Store(spark, f"{tmp_path}/again")
    docs = spark.createDataFrame([("k1",), ("k2",)], "document_key string")
    lost = docs.withColumn("chunk", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.write("stream-0", {"documents": docs, "chunks": lost})
    assert store.visible("documents").count() == 0
    for _ in range(2):
        store.write("stream-0", {"documents": docs, "chunks": docs.withColumn("chunk", F.lit("c"))})
        assert store.visible("documents").count() == store.visible("chunks").count() == 2
    vectors = docs.select("document_key", F.lit("p").alias("provider"), F.array(F.lit(1.0)).alias("vector"))
    store.write("stream-1", {"embeddings": vectors})
    assert {r.provider for r in store.visible("embeddings").collect()} == {"p"}


def test_the_newest_version_of_a_document_is_the_last_completed(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/versions")
    for n in (8, 9, 10, 11):
        seen = store.replace_document(f"stream-{n}", spark.createDataFrame([("a", f"v{n}"), *([("b", "only")] if n == 8 else [])], "document_key string, chunk string"))
        assert {(r.document_key, r.chunk) for r in seen.collect()} == {("a", f"v{n}"), ("b", "only")}


def test_first_by_and_numbered_places(spark):
    """The first row of each key with null places and exact ties, and places within kinds, against plain sorting."""
    rows = [("a", None, 1), ("a", 2, 2), ("a", None, 1), ("b", 1, 3), (None, 5, 4), ("c", 1, None)] + [("hot", i % 50, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, p int, n int")
    found = {(r.k, r.p, r.n) for r in sft.first_of(df, F.col("k"), "p", "n").collect()}
    assert found == {("a", None, 1), ("b", 1, 3), (None, 5, 4), ("c", 1, None), ("hot", 0, 0)}
    kinds = spark.createDataFrame([(i, ("x", "y", None)[i % 3]) for i in range(3000)], "id long, kind string")
    placed = sft._numbered(kinds, "kind", "id", 42).withColumn("h", sft._shuffled("id", 42)).collect()
    for kind in ("x", "y", None):
        own = sorted((r for r in placed if r.kind == kind), key=lambda r: (r.h, r.id))
        assert [r["_n"] for r in own] == list(range(1, 1001)) and {r["_of"] for r in own} == {1000}


def test_chunk_counts_follow_their_sql_on_odd_blocks(spark, tmp_path):
    """Blocks whose sentences have a character each, other white space between lines, articles of a law."""
    import duckdb

    from tidemill.plans import q_ingest

    texts = ["A. b. c.\n\nwhole block", "one\n \ntwo", "one\n \n\ntwo", "one\n\x0b\ntwo", "one\n\t \r\n\ntwo\n\n\n", "법\n제 1 조 하나\n제2조 둘", "x\n\n1!\n\n?", "", None, "\n\n", "1. 2. 3. 4.", "ab. ? cd"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(q_ingest.SQL["chk1_chunk_counts"]).fetchall())
    assert sorted(map(tuple, q_ingest.QUERIES["chk1_chunk_counts"](spark, str(tmp_path)).collect())) == want


def test_a_packer_asks_only_the_last_sentences_of_a_piece_for_their_places():
    from tidemill.operators import ingest

    class Counted(ingest.Words):
        asked = 0

        def spans(self, text):
            self.asked += 1
            return super().spans(text)

    words = Counted()
    pieces = ingest.packed([f"Sentence number {i} ends." for i in range(600)], words, 300, 60)
    assert all(n == len(ingest.Words().spans(p)) <= 300 for p, n in pieces) and words.asked <= 14 * len(pieces) < 600


def test_normal_forms_hold_a_run_of_a_batch(spark):
    """a batch comes back in runs, and rows keep their places."""
    import unicodedata

    import pyarrow as pa
    from pyspark.sql import functions as F

    from tidemill.functions import udfs

    texts = [None if i % 7 == 0 else "" if i % 11 == 0 else f"ﬁ {i} é ㎏ ①" * (i % 5) for i in range(1500)]
    want = [t and unicodedata.normalize("NFKC", t) for t in texts]
    parts = list(udfs._normalized("NFKC", iter([pa.array(texts, pa.string())])))
    assert max(map(len, parts)) <= udfs.RUN and [x for p in parts for x in p.to_pylist()] == want
    found = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2).select("i", udfs.nfkc("t").alias("c"), udfs.nfc(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.c for r in found] == want and [r.n for r in found] == [t and unicodedata.normalize("NFC", t) for t in texts]
