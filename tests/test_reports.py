"""Lexicons, reports with samples, erasure along references, quotas as state, versions of documents: against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemill.operators import cascade, dashboard, lexicon, reports
from tidemill.operators.cascade import Reference
from tidemill.sources.stores import Store
from tidemill.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_lexicon_of_thousands_of_words(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abcé한_1", k=n))
    words = [(f"l{i % 3}", word(rng.randint(1, 5))) for i in range(3000)] + [("l0", "ab ab"), ("l1", ""), (None, "a"), ("l2", None)]
    texts = [None, "", "ab ab ab", "a-a", "ß", *("".join(rng.choice([word(rng.randint(1, 4)), " ", "-", "ab"]) for _ in range(200)) for _ in range(30))]
    docs, table = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), spark.createDataFrame(words, "lexicon string, word string")
    for whole in (True, False):
        want = Counter()
        for i, t in enumerate(texts):
            for name, w in {x for x in words if x[1]}:
                for m in re.finditer(f"(?={re.escape(w)})", t or ""):
                    a, b = m.start(), m.start() + len(w)
                    if not whole or not (re.match(r"\w", t[a - 1 : a] or " ") or re.match(r"\w", t[b : b + 1] or " ")):
                        want[i, name, w] += 1
        for most in (lexicon.LEXICON_BYTES, 9000):  # in one part, and in several
            found = lexicon.match(docs, table, whole_words=whole, most_bytes=most).collect()
            assert Counter({(r.id, r.lexicon, r.word): r.n for r in found}) == want and len(found) == len(want)
    assert lexicon.match(docs, table.limit(0)).count() == lexicon.match(docs.limit(0), table).count() == 0


def test_samples_are_limited_before_their_shuffle(spark):
    rows = [(i, "hot" if i % 10 else None, f"line\n{i} " + "x" * (i % 200)) for i in range(2000)]
    df = spark.createDataFrame(rows, "i int, g string, t string").repartition(4)
    first = reports.samples(df, ["g"], ["i"], 3)
    assert "WindowGroupLimit" in first._jdf.queryExecution().executedPlan().toString()
    assert sorted((str(r.g), r.i) for r in first.collect()) == [("None", 0), ("None", 10), ("None", 20), ("hot", 1), ("hot", 2), ("hot", 3)]
    shown = [r[0] for r in spark.createDataFrame([(None,), ("  a\nb ",), ("y" * 121,)], "t string").select(reports.preview(F.col("t"))).collect()]
    assert shown == ["", "a b", "y" * 120 + "…"]
    empty = reports.chunk_quality(reports.chunk_flags(df.limit(0).withColumnRenamed("t", "text").withColumn("source", F.lit("s"))), "i")
    assert {(r.flag, r.n, r.percent, len(r.samples)) for r in empty.collect()} == {(f, 0, 0.0, 0) for f in reports.CHUNK_FLAGS}
    assert reports.review_categories(df.limit(0), "t").count() == 0


def test_detectors_and_answers(spark):
    cases = spark.createDataFrame([(1, True, True), (2, None, True), (3, True, False), (4, False, False)], "id int, flag boolean, truth boolean")
    assert tuple(reports.detector(cases).first()) == (1, 1, 1, 1, 0.5, 0.5)
    assert sorted((r.id, r.fault) for r in reports.detector_faults(cases).collect()) == [(2, "missed"), (3, "false_alarm")]
    assert tuple(reports.detector(cases.limit(0)).first()) == (0, 0, 0, 0, None, None)
    rows = [(1, "q", "감기", "폐 렴", "a", "B입니다"), (2, "q", "감기", "폐  렴", "2", "답은 B"), (3, "q", "x", "y", "9", "y"), (4, "q", "x", "y", None, "x"), (5, "q", "감기", "", "1", "이것은 감기"), (6, "q", "x", "zz", "b", "A" * 30 + " B zz"), (7, "q" * 99, "x", None, "B", None)]
    graded = reports.mcq_graded(spark.createDataFrame(rows, "id int, question string, A string, B string, answer string, response string"), "AB")
    # a letter followed by a letter of another script is no word of its own
    assert [(r.id, r.gold_letter, r.correct) for r in graded.orderBy("id").collect()] == [(1, "A", False), (2, "B", True), (3, None, False), (4, None, False), (5, "A", True), (6, "B", True), (7, "B", False)]
    assert tuple(reports.mcq_accuracy(graded).first()) == (7, 3, 0.428571) and tuple(reports.mcq_accuracy(graded.limit(0)).first()) == (0, 0, None)
    assert [(r.id, len(r.question), r.gold) for r in reports.mcq_wrong(graded, "id").collect()] == [(1, 1, "A. 감기"), (3, 1, ". "), (4, 1, ". "), (7, 60, "B. ")]


def test_erasure_follows_references(spark):
    rng = random.Random(7)
    refs = [Reference("b", "a1", "a", "id"), Reference("b", "a2", "a", "id", "null"), Reference("c", "b1", "b", "id"), Reference("c", "a1", "a", "id", "null"), Reference("d", "c1", "c", "id", "null"), Reference("e", "x1", "x", "id")]
    data = {"a": [(i,) for i in range(20)], "b": [(i, rng.choice([None, *range(25)]), rng.randrange(25)) for i in range(60)], "c": [(i, rng.randrange(70), rng.randrange(25)) for i in range(200)], "d": [(i, rng.randrange(200)) for i in range(200)], "e": [(1, 2)], "x": [(2,)]}
    data["b"] += data["b"][:5]  # repeated rows
    names = {"a": "id", "b": "id, a1, a2", "c": "id, b1, a1", "d": "id, c1", "e": "id, x1", "x": "id"}
    tables = {k: spark.createDataFrame(v, ", ".join(f"{c.strip()} int" for c in names[k].split(","))) for k, v in data.items()}
    gone, lost = [1, 2, 3, 3, 99], {"a": {1, 2, 3}}
    want = {"a": [r for r in data["a"] if r[0] not in lost["a"]], "e": data["e"], "x": data["x"]}
    want["b"] = [(i, p, None if q in lost["a"] else q) for i, p, q in data["b"] if p not in lost["a"]]
    lost["b"] = {i for i, p, _ in data["b"] if p in lost["a"]}
    want["c"] = [(i, p, None if q in lost["a"] else q) for i, p, q in data["c"] if p not in lost["b"]]
    lost["c"] = {i for i, p, _ in data["c"] if p in lost["b"]}
    want["d"] = [(i, None if p in lost["c"] else p) for i, p in data["d"]]
    kept = cascade.erase(tables, refs, "a", spark.createDataFrame([(g,) for g in gone], "id int"))
    for k in data:
        assert sorted(map(tuple, kept[k].collect()), key=repr) == sorted(want[k], key=repr) and kept[k].columns == tables[k].columns
    assert {k: v.count() for k, v in cascade.erase(tables, refs, "a", spark.createDataFrame([], "id int")).items()} == {k: len(v) for k, v in data.items()}
    with pytest.raises(ValueError, match="circles"):
        cascade.erase(tables, [*refs, Reference("b", "a2", "c", "id")], "a", spark.createDataFrame([(1,)], "id int"))
    with pytest.raises(ValueError, match="neither"):
        Reference("a", "b", "c", "d", "forget")


def test_lifetime_quota(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot", "hot", "hot", f"k{i % 40}", None]), rng.randrange(50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "event_id long, k string, ts int").repartition(4)
    for limit in (0, 1, 20, 10_000):
        seen, want = defaultdict(int), {}
        for i, k, ts in sorted(rows, key=lambda r: (r[2], r[0])):
            want[i], seen[k] = seen[k] < limit, seen[k] + 1
        assert {r.event_id: r.allowed for r in dashboard.lifetime_quota(df, "k", ["ts", "event_id"], limit).collect()} == want
    assert dashboard.lifetime_quota(df.limit(0), "k", ["ts"], 3).count() == 0


def test_quota_stream_begins_with_the_history_and_survives_a_restart(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    want = {r.event_id: r.allowed for r in dashboard.lifetime_quota(events, "key", ["ts", "event_id"], 40).collect()}
    cuts = events.select(F.percentile_approx("ts", F.array(F.lit(0.3), F.lit(0.6), F.lit(0.8)))).first()[0]
    parts = [events.where((F.col("ts") > a if a else F.lit(True)) & (F.col("ts") <= b if b else F.lit(True))) for a, b in zip([None, *cuts], [*cuts, None])]
    jobs.use_rocksdb(spark)
    used, path, found = dashboard.quota_used(parts[0], "key"), str(tmp_path), {}
    for part in parts[1:]:  # the stream stops and starts again for each
        part.coalesce(2).write.mode("append").parquet(f"{path}/in")
        stream = jobs.quota_stream(spark.readStream.schema(events.schema).parquet(f"{path}/in"), 40, used)
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = {r.event_id: r.allowed for r in spark.read.parquet(f"{path}/out").collect()}
    later = {r.event_id for part in parts[1:] for r in part.collect()}
    assert found == {i: want[i] for i in later} and set(found.values()) == {True, False}


def test_versions_of_documents(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    rows = lambda *r: spark.createDataFrame(list(r), "document_key string, chunk string")
    vectors = lambda df: df.select("document_key", F.lit("p").alias("provider"), F.length("chunk").alias("v"))
    first = rows(("a", "one"), ("a", "two"), ("b", "only"), (None, "nobody's"))
    store.write("b1", {"chunks": first, "embeddings": vectors(first), "documents": first.select("document_key").distinct()})
    store.replace_document("b2", rows(("a", "three+")), vectors(rows(("a", "three+"))))
    known = lambda t, c: sorted((r.document_key, r[c]) for r in store.visible(t).where("document_key IS NOT NULL").collect())
    assert known("chunks", "chunk") == [("a", "three+"), ("b", "only")] and known("embeddings", "v") == [("a", 6), ("b", 4)]
    store.replace_document("b3", rows(("x", "y")).limit(0), keys=spark.createDataFrame([("b",)], "document_key string"))
    assert known("chunks", "chunk") == [("a", "three+")] and known("embeddings", "v") == [("a", 6)]
    with pytest.raises(Exception, match="lost"):
        store.replace_document("b4", rows(("a", "x")).withColumn("chunk", F.raise_error(F.lit("lost")).cast("string")))
    assert known("chunks", "chunk") == [("a", "three+")]  # a failed replacement replaces nothing
    store.write("b5", {"chunks": rows(("b", "again"))})
    assert known("chunks", "chunk") == [("a", "three+"), ("b", "again")] and store.visible("documents").count() == 3
    store.write("b6", {"documents": spark.createDataFrame([("b",)], "document_key string")}, spark.createDataFrame([("b",)], "document_key string"))
    assert store.visible("documents").count() == 3 and known("chunks", "chunk") == [("a", "three+")]


def test_flags_of_a_text_of_very_many_sentences(spark):
    """Repetition is told in one split and one sort: the square of 20,000 sentences takes minutes."""
    import time

    many = [f"Sentence {i} ends." for i in range(20_000)]
    texts = [" ".join(many), " ".join([*many, many[7], many[19_000]]), " ".join([many[7], *many, many[7]]), "a. b. a. b. ", "a. a. b. a.\x1c", "a? a? a?", "", None]
    flagged = reports.chunk_flags(spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("source", F.lit("s")))
    began = time.time()
    found = {r.i: r for r in flagged.select("i", "repetition", "mid_cut").collect()}
    assert time.time() - began < 30
    assert [found[i].repetition for i in range(8)] == [False, False, True, False, True, True, False, None]
    # the no-break space is white space, the separator 1C is not
    assert [found[i].mid_cut for i in range(8)] == [False, False, False, False, True, False, False, None]
