"""WARC archives as chunked record tables.

Writing: a payload of more than CHUNK bytes becomes a first record and continuation records (the format's own
segmentation), so no archive line holds more than a chunk. Every segment carries its digest, the
first the payload's. Spark's text writer puts the records into files, with the format's record end as its
line end; so any store that Spark writes to will do.

Reading: a record's end and the next one's first line delimit the records of a file, which lets Spark split large
archives. A payload that holds this very delimiter, or makes it with its header's end, is cut inside it when written. Segments are rows
(record, segment number, bytes). Whole payloads are digested where they are read; the segments of others are
brought together in order, and a digest takes in one segment at a time.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm.session import delete, durable, parts, shared_dir

#: Bytes of a segment, bytes from which on equal payloads are revisited, and characters of records in a batch.
CHUNK, SAME, BATCH = 1 << 16, 1000, 1 << 22
#: Payloads with copies (of some 60 bytes each) up to which they are broadcast.
FEW = 100_000
_SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION, _END = "WARC/1.1\r\n", "\r\n\r\n"
_TRAP = (_END + _VERSION).encode()[:-2]
_FIELDS = "page_id long, record string, segment long, total long, data binary, payload_digest string, payload_bytes long, record_type string, refers_to long"


def segments(payload: bytes | memoryview, chunk: int = CHUNK) -> list[memoryview]:
    """Views of at most chunk bytes (a few less where a character would be cut), none of which holds the delimiter."""
    payload = memoryview(payload)
    cuts, start = [], 0
    while len(payload) - start > chunk:
        end = start + chunk
        while end > start + 1 and payload[end] & 0xC0 == 0x80:
            end -= 1
        cuts.append(end)
        start = end
    cuts += [m.start() + 6 for m in re.finditer(re.escape(_TRAP), payload)]
    for at in [0, *cuts]:  # a part's start makes the delimiter with the blank line that closes the header
        cuts += [at + n - 6 for n in (8, 10) if payload[at : at + n] == _TRAP[12 - n :]]
    bounds = [0, *sorted(set(cuts)), len(payload)]
    return [payload[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _header(fields: list[tuple[str, object]]) -> str:
    return _VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"


def _record_id(page: int | None, digest: str, number: int) -> str:
    """The same for a page wherever it is written; number tells rows of one page apart."""
    return f"<urn:page:{'' if page is None else page}:{digest}" + (f":{number}>" if number else ">")


def _records(chunk: int, date: str):
    """A payload stays where Arrow has it: its digest takes in a segment at a time, and only a segment is copied into a record."""

    def run(batches):
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "last_id", "number")]
            for i in range(batch.num_rows):
                page, url, last, number = (columns[k][i].as_py() for k in (0, 1, 3, 4))
                cuts, whole, size = segments(columns[2][i].as_buffer(), chunk), hashlib.sha1(), 0
                for part in cuts:
                    whole.update(part)
                    size += len(part)
                digest = whole.hexdigest()
                uri = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
                name = _record_id(page, digest, number)
                common = [("X-Page-Id", page), ("WARC-Date", date), ("WARC-Target-URI", uri)]
                if last is not None and last != page:
                    own = [("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, ("WARC-Profile", _SAME_PAYLOAD), ("WARC-Refers-To", _record_id(last, digest, 0)), ("X-Refers-To-Page-Id", last)]
                    yield _header([*own, ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", size), ("Content-Length", 0)])
                    continue
                for k, part in enumerate(cuts):
                    own = [("WARC-Type", "continuation" if k else "response"), ("WARC-Record-ID", f"{name[:-1]}:segment-{k + 1}>" if k else name), *common]
                    if len(cuts) > 1:
                        own += [("WARC-Segment-Number", k + 1), ("WARC-Segment-Origin-ID", name if k else None), ("X-Segment-Total", len(cuts))]
                    own += [("WARC-Block-Digest", f"sha1:{hashlib.sha1(part).hexdigest()}"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Length", len(part))]
                    yield _header(own) + str(part, "utf-8")

    def batched(batches):
        held, size = [], 0
        for line in run(batches):
            held.append(line)
            if (size := size + len(line)) >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])

    return batched


def write_archives(pages: DataFrame, path: str, chunk: int = CHUNK, date: str | None = None) -> None:
    """Writes a record for each row of pages (page_id, url, html) below path, with the html in UTF-8 (null: empty) as payload.

    Of equal payloads of SAME bytes or more, those of the largest page_id are responses and the others
    revisit it; smaller ones, and rows without a page_id, are responses. date: WARC-Date of all records, by default now.
    A record's id follows from page and payload; only rows that repeat a page_id have a number that is the layout's.
    """
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    long = F.octet_length("html") >= SAME
    rows = rows.withColumn("digest", F.when(long & F.col("page_id").isNotNull(), F.sha1("html")))
    copies = durable(rows.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("last_id"), F.count("*").alias("n")).where("n > 1").drop("n"))
    if copies.count() <= FEW:
        copies = F.broadcast(copies)
    else:
        rows = rows.withColumn("digest", F.coalesce("digest", F.concat(F.lit("-"), F.rand(0))))  # rows without copies go to as many places
    again = durable(rows.groupBy("page_id").count().where("count > 1 or page_id is null").select(F.col("page_id").alias("again")))
    if again.count() <= FEW:
        again = F.broadcast(again)
    sent = rows.join(copies, "digest", "left").join(again, F.col("page_id").eqNullSafe(F.col("again")), "left")
    repeats = F.col("again").isNotNull() | F.col("page_id").isNull()
    sent = sent.withColumn("number", F.when(repeats, F.monotonically_increasing_id() + 1).otherwise(F.lit(0)))
    sent.select("page_id", "url", "html", "last_id", "number").mapInArrow(_records(chunk, date), "value string").write.option("lineSep", _END).text(path)


def parse_record(text: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-cased name, and the block."""
    text = text.removeprefix(_VERSION.encode())
    at = text.find(_END.encode())
    fields = dict(line.split(": ", 1) for line in text[:at].decode().split("\r\n") if ": " in line)
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, text[at + 4 : at + 4 + int(fields["content-length"])]


def _read(batches):
    names = [x.split()[0] for x in _FIELDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    for batch in parts(batches):
        out = []
        for text in batch.column("value").cast(pa.binary()):
            f, block = parse_record(text.as_py())
            if (d := f.get("warc-block-digest")) and d != f"sha1:{hashlib.sha1(block).hexdigest()}":
                raise ValueError(f"{f['warc-record-id']}: the block is not what its digest says")
            page = int(f["x-page-id"]) if "x-page-id" in f else None
            number, total = int(f.get("warc-segment-number", 1)), int(f.get("x-segment-total", 1))
            name = f.get("warc-segment-origin-id", f["warc-record-id"])
            if f["warc-type"] == "revisit":
                out.append((page, name, 1, 1, None, f["warc-payload-digest"].removeprefix("sha1:"), int(f["x-payload-length"]), "revisit", int(f["x-refers-to-page-id"])))
            elif total == 1:
                out.append((page, name, 1, 1, None, hashlib.sha1(block).hexdigest(), len(block), "response", None))
            else:
                out.append((page, name, number, total, block, None, len(block), "response", None))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)


def _gather(batches):
    """Segments come sorted by record and number; the digest and the length are all that is kept of those before."""
    at, sha, size, last, total, page = None, None, 0, 0, 0, None
    for batch in batches:
        out = []
        for record, number, of, data, who in zip(*(batch.column(c) for c in ("record", "segment", "total", "data", "page_id")), strict=True):
            if record.as_py() != at:
                if at is not None and last != total:
                    raise ValueError(f"{at}: {last} of {total} segments")
                at, sha, size, last = record.as_py(), hashlib.sha1(), 0, 0
            total, page = of.as_py(), who.as_py()
            if number.as_py() != last + 1:
                raise ValueError(f"{at}: segment {last + 1} is missing")
            part = data.as_buffer()
            sha.update(part)
            size, last = size + part.size, last + 1
            if last == total:
                out.append((page, size, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))], ["page_id", "payload_bytes", "payload_digest"])
    if at is not None and last != total:
        raise ValueError(f"{at}: {last} of {total} segments")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table: a row for each segment; data is null where the payload was whole and is digested."""
    lines = spark.read.option("lineSep", _END + _VERSION).schema("value string").text(path)
    return lines.mapInArrow(_read, _FIELDS)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) for each record that isn't a continuation."""
    found = durable(read_segments(spark, path))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    parts = found.where("data is not null").select("record", "segment", "total", "data", "page_id")
    parts = parts.repartition("record").sortWithinPartitions("record", "segment")
    joined = parts.mapInArrow(_gather, "page_id long, payload_bytes long, payload_digest string")
    joined = joined.withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast("long"))
    return found.where("data is null").select(*columns).unionByName(joined.select(*columns))


def round_trip(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """What read_archives gives of pages once written; the archives are deleted after.

    Null html is an empty payload; payloads of any size go in chunks; rows that repeat are records each; an empty table gives no
    records; a null page_id stays null and is never a revisit; other columns are passed over.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, chunk)
    out = durable(read_archives(spark, path))
    delete(spark, path)
    return out


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS n, sha1(h) AS d, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM q
"""
