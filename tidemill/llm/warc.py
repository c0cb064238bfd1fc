"""WARC archives: written with revisit records, read back by boundary-chain verification."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._spark import bloom, cut, gathered, in_bloom, lookup, new_path

MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
#: Records of one file at most; a file is read by one task. Where files could exceed FILE_BYTES, payloads of LARGE bytes and more have
#: files of their own, of so few records that they stay below it, or of one.
FILE_RECORDS = 2_000
LARGE = 1 << 17
FILE_BYTES = 1 << 28
#: Keys that are broadcast themselves (8 MB); more are filtered and joined.
EXACT_KEYS = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _sha(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, list[bytes]]:
    raw = data.tobytes()
    return raw, [hashlib.sha1(raw[i:j]).digest() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _digests(batches):
    """page_id, url, digest and payload_bytes of each page."""
    for rows, data, offsets in _text.text_slices(batches, "html"):
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(_sha(data, offsets)[1], pa.binary()), pa.array(np.diff(offsets))], names=["page_id", "url", "digest", "payload_bytes"])


def _header(lines: list[tuple[str, str]], block: bytes, http: bytes) -> bytes:
    told = "".join(f"{k}: {v}\r\n" for k, v in [*lines, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + len(block)))])
    return MAGIC + told.encode() + b"\r\n" + http + block


def _clean(url: str | None) -> str:
    return re.sub(r"[\s<>]", lambda m: "%" + m[0].encode().hex().upper() if ord(m[0]) < 128 else "", url or "")


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, repr(page_id))}>"


def _record(page_id, url: str | None, digest: bytes, payload: bytes | int, first=None) -> bytes:
    """A record without its end mark, which the sink writes. A revisit has the page it refers to and only the length of its payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    revisit = isinstance(payload, int)
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Target-URI", _clean(url)), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()),
    ]
    if page_id is not None:
        lines.append(("WARC-Page-ID", str(page_id)))
    if revisit:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(first)), ("WARC-Refers-To-Page-ID", str(first)), ("WARC-Payload-Length", str(payload))]
    return _header(lines, b"" if revisit else payload, http)


def decided(digests: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The rows of digests (page_id, url, digest, payload_bytes) that are revisits, with first_id, the smallest page_id of their payload.

    Payloads of fewer than least_bytes, pages with a null id (nothing could refer to them) and rows that repeat the smallest page are
    no revisits. No html takes part, and a payload that many pages share is looked up by a broadcast.
    """
    found = digests.where(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id"))
    again = cut(found.where("n > 1 AND first_id IS NOT NULL").select("digest", "first_id"))
    return lookup(digests, again, "digest").where("page_id <> first_id")


def write(pages: DataFrame, path: str, least_bytes: int = 0, file_records: int = FILE_RECORDS) -> None:
    """Writes a WARC record per row of pages (page_id, url, html) under path, by Spark's own text sink: lost tasks leave no part behind.

    Pages of equal payloads: that of the smallest page_id is a response, others are revisits of it without a payload; rows that
    repeat that page are responses too, and so are pages with a null id. Null html is an empty payload; an empty table writes nothing.
    Revisits are written from their digests. All other pages are written where they are read, but for those few that a filter of the
    revisits' keys mistakes for one: only these are shuffled.
    """
    spark = pages.sparkSession
    source = pages.select("page_id", "url", "html")
    kind = source.schema["page_id"].dataType.simpleString()
    key = F.xxhash64("page_id", "digest").alias("key")
    digests = cut(source.mapInArrow(_digests, f"page_id {kind}, url string, digest binary, payload_bytes bigint"))
    revisits = cut(decided(digests, least_bytes).select("*", key))
    shared = spark.sparkContext.broadcast(bloom(revisits.select("key").distinct(), "key"))

    def mistaken_for(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_bloom(shared.value, batch.column(0).to_numpy().view(np.uint64))))

    mistaken = cut(digests.select(key).mapInArrow(mistaken_for, "key bigint").distinct().join(revisits.select("key").distinct(), "key", "left_anti"))
    few = mistaken.count() <= EXACT_KEYS
    also = spark.sparkContext.broadcast(np.sort(mistaken.toPandas()["key"].to_numpy(np.int64)) if few else bloom(mistaken, "key"))

    def is_mistaken(keys):
        if not few:
            return in_bloom(also.value, keys)
        at = np.searchsorted(also.value, keys.view(np.int64))
        return np.append(also.value, 0)[at] == keys.view(np.int64) if len(also.value) else np.zeros(len(keys), bool)

    def marked(batches):
        for batch in batches:
            for rows, data, offsets in _text.text_slices([batch], "html"):
                keys = rows.column(3).to_numpy().view(np.uint64)
                maybe = in_bloom(shared.value, keys)
                kept = np.flatnonzero(~maybe | is_mistaken(keys))
                raw, columns = data.tobytes(), [rows.column(i).to_pylist() for i in (0, 1, 4)]
                out = [_record(columns[0][i], columns[1][i], columns[2][i], raw[offsets[i] : offsets[i + 1]]) for i in kept.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(keys[kept].view(np.int64)), pa.array(maybe[kept] & (not few)), pa.array(np.diff(offsets)[kept] >= LARGE), pa.array(out, pa.binary())], names=["key", "maybe", "large", "record"])

    def revisit(batches):
        for batch in batches:
            out = [_record(p, u, d, n, f) for p, u, d, n, f in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    hashed = source.withColumn("html", F.coalesce("html", F.lit(""))).withColumn("digest", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    half = hashed.select("page_id", "url", "html", key, "digest").mapInArrow(marked, "key bigint, maybe boolean, large boolean, record binary")
    again = revisits.select("page_id", "url", "digest", "payload_bytes", "first_id").mapInArrow(revisit, "record binary")
    if not few:
        half = half.where("NOT maybe").unionByName(half.where("maybe").join(mistaken, "key", "left_semi").select(half.columns))
    both = half.select("large", "record").unionByName(again.select(F.lit(False).alias("large"), "record"))
    most = digests.agg(F.max("payload_bytes")).first()[0] or 0
    apart = most * file_records > FILE_BYTES
    for large in (False, True) if apart else (False,):
        records = max(1, FILE_BYTES // most) if large else file_records
        own = (both.where(F.col("large") == large) if apart else both).select(F.col("record").cast("string").alias("value"))
        own.write.mode("append").option("lineSep", END).option("maxRecordsPerFile", records).text(path)


def _heads(raw: memoryview, places=None):
    """Places of the magic that a whole record may follow, with its fields, and where its block begins and ends."""
    head = re.compile(rb"(?:[A-Za-z0-9-]+:[^\r\n]*\r\n)+\r\n")
    for at in (m.start() for m in re.finditer(re.escape(MAGIC), raw)):
        if places is not None and at not in places:
            continue
        h = head.match(raw, at + len(MAGIC))
        if not h:
            continue
        fields = dict(line.split(": ", 1) for line in bytes(h[0]).decode("utf-8", "replace").split("\r\n") if ": " in line)
        if fields.get("Content-Length", "").isdigit() and h.end() + int(fields["Content-Length"]) <= len(raw):
            yield at, fields, h.end(), h.end() + int(fields["Content-Length"])


def _candidates(batches):
    """Every place of the magic with the place its record would end; what follows the magic in a payload is told apart later."""
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = [(at, end + len(END)) for at, _, _, end in _heads(memoryview(content.as_buffer()))]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.int64()), pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["file", "at", "next"])


def _place(name: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit key of places in files."""
    with np.errstate(over="ignore"):
        return _text.mixed(at.view(np.uint64) + name.view(np.uint64))


def _records(batches, shared):
    """The records at places that the filter lets through."""
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw, out = memoryview(content.as_buffer()), []
            at = np.array([m.start() for m in re.finditer(re.escape(MAGIC), raw)], np.int64)
            for at, fields, block, end in _heads(raw, set(at[in_bloom(shared.value, _place(np.array([name]), at))].tolist())):
                digest, revisit = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:"), fields.get("WARC-Type") == "revisit"
                body = bytes(raw[block:end])
                payload = body[body.find(b"\r\n\r\n") + 4 :]
                out.append(
                    {
                        "file": name, "at": at, "record_type": fields.get("WARC-Type"), "page_id": fields.get("WARC-Page-ID"), "refers_to": fields.get("WARC-Refers-To-Page-ID"),
                        "payload_bytes": int(fields.get("WARC-Payload-Length", -1)) if revisit else len(payload),
                        "payload_digest": digest if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                    }
                )
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)


_SCHEMA = pa.schema([("file", pa.int64()), ("at", pa.int64()), ("record_type", pa.string()), ("page_id", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def reachable(links: DataFrame) -> DataFrame:
    """(file, at) of the records that a chain of successors (file, at, next) leads to from offset 0 of their file.

    Pointer jumping: each round doubles the jumps and adds what the records reached so far jump to, so a file of n records takes
    log2(n) rounds of equality joins; every round is cut by a checkpoint. Candidates inside payloads are never jumped to.
    """
    rows = links.count()
    small = lambda df: cut(gathered(df, rows))
    places = small(links.select("file", "at", "next"))
    jump, reached = places, small(places.where("at = 0").select("file", "at"))
    n = reached.count()
    while True:
        step = reached.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        more = step.join(places.select("file", "at"), ["file", "at"], "left_semi")
        reached = small(reached.unionByName(more).distinct())
        now = reached.count()
        if now == n:
            return reached
        n = now
        jump = small(jump.join(jump.select("file", F.col("at").alias("next"), F.col("next").alias("then")), ["file", "next"]).select("file", "at", F.col("then").alias("next")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, record_type, page_id, refers_to, payload_bytes, payload_digest) of the verified records of the archives under path.

    Tasks emit every candidate of their files with its successor; those that are reachable from a file's start are records. Only
    these (and the few that a filter of their places takes for one) have their payloads read and hashed, so a payload full of false
    heads costs no more than its length. An empty folder, or one without records, gives no rows.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0").select(F.xxhash64("path").alias("file"), "content")
    links = cut(files.mapInArrow(_candidates, "file bigint, at bigint, next bigint"))
    reached = reachable(links)

    def keys(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_place(*(c.to_numpy() for c in batch.columns)).view(np.int64))], names=["key"])

    shared = spark.sparkContext.broadcast(bloom(cut(reached.select("file", "at").mapInArrow(keys, "key bigint")), "key"))
    found = files.mapInArrow(lambda b: _records(b, shared), "file bigint, at bigint, record_type string, page_id string, refers_to string, payload_bytes bigint, payload_digest string")
    return found.join(reached, ["file", "at"], "left_semi")


def report(pages: DataFrame) -> DataFrame:
    """Writes pages as archives into the shared folder and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path)
    kind = pages.schema["page_id"].dataType
    return read(spark, path).select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))
