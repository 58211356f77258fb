"""Web archives: write pages as WARC records, read records back, put segments together and decode chunked bodies.

Writing: payloads that occur more than once and have MIN_REVISIT_BYTES at least are written once, by the smallest page;
the others revisit that record. Bodies are framed in chunks; a block above `segment_bytes` goes on in continuation
records. Chunk and segment ends keep to whole characters, and no block holds the text "WARC/1.1", so records can be
told apart wherever an archive is cut; Spark's text writer and reader move the bytes, to and from any store.

Reading: each record's block must have its stated length. Segments are grouped by their origin record, ordered by number,
checked to be gapless and to have the stated total length, and the joined block's chunks are decoded. What doesn't fit
comes out with a text in `error`, not silently.

Defined cases: null html is an empty payload; pages with the same id and payload are all written, as responses if theirs
is the smallest id; a null page id is written and read back as null and others don't refer to it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.llm.common import narrow

VERSION = "WARC/1.1"
MIN_REVISIT_BYTES = 100
CHUNK_BYTES = 4096
SEGMENT_BYTES = 32_768
RECORDS_PER_FILE = 2000
DATE = "2024-01-01T00:00:00Z"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def _whole(data: bytes, at: int) -> int:
    """The largest character boundary up to `at`."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def framed(payload: bytes, chunk_bytes: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing; no chunk holds the text that starts a record."""
    cuts = [m.start() + 4 for m in re.finditer(VERSION.encode(), payload)] + [len(payload)]
    out, start = [], 0
    for cut in cuts:
        while start < cut:
            end = min(cut, _whole(payload, min(start + chunk_bytes, cut)))
            end = end if end > start else min(cut, start + chunk_bytes)
            out.append(b"%x\r\n%b\r\n" % (end - start, payload[start:end]))
            start = end
    return b"".join(out) + b"0\r\n\r\n"


def unframed(body: bytes) -> bytes:
    """Payload of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk has not its stated size")
        out.append(body[at : at + size])
        at += size + 2


def _record(kind: str, name: str, block: bytes, **headers) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items() if v is not None]
    lines += [f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records_of(row: dict, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page: {page, url, url_hash, html, digest, first, first_url}. Names follow from page, payload and url."""
    payload = (row["html"] or "").encode()
    named = lambda page, url: f"urn:page:{'' if page is None else page}:{row['digest'][:32]}:{url & (1 << 64) - 1:x}"
    name = named(row["page"], row["url_hash"])
    url = re.sub(r"[\r\n]+", "%0D%0A", row["url"] or "").replace(VERSION, VERSION.replace("/", "%2F"))
    common = {"WARC_Target_URI": url, "WARC_Payload_Digest": f"sha256:{row['digest']}", "Content_Type": "application/http;msgtype=response"}
    if row["first"] is not None and row["page"] != row["first"]:
        yield _record(
            "revisit", name, f"{_HTTP}Content-Length: {len(payload)}\r\n\r\n".encode(), WARC_Refers_To=f"<{named(row['first'], row['first_url'])}>",
            WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", **common,
        )
        return
    block = f"{_HTTP}Transfer-Encoding: chunked\r\n\r\n".encode() + framed(payload)
    if len(block) <= segment_bytes:
        yield _record("response", name, block, **common)
        return
    start, number = 0, 1
    while start < len(block):
        end = len(block) if start + segment_bytes >= len(block) else max(_whole(block, start + segment_bytes), start + 1)
        total = len(block) if end == len(block) else None
        if number == 1:
            yield _record("response", name, block[:end], WARC_Segment_Number=1, **common)
        else:
            yield _record(
                "continuation", f"{name}:{number}", block[start:end], WARC_Segment_Origin_ID=f"<{name}>", WARC_Segment_Number=number,
                WARC_Segment_Total_Length=total,
            )
        start, number = end, number + 1


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Write one archive or more per partition below `folder`, gzip-compressed."""
    text = F.coalesce("html", F.lit(""))
    rows = narrow(pages, page=id_col, url=url_col, html=html_col).withColumn("page", F.col("page").cast("long"))
    named = rows.withColumn("digest", F.sha2(text, 256)).withColumn("url_hash", F.xxhash64("url"))
    least = F.min(F.when(F.col("page").isNotNull(), F.struct("page", "url_hash"))).alias("least")
    firsts = (
        named.filter(F.octet_length(text) >= MIN_REVISIT_BYTES).groupBy("digest").agg(least, F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and least is not null")
        .select("digest", F.col("least.page").alias("first"), F.col("least.url_hash").alias("first_url"))
    )
    marked = named.join(firsts, "digest", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows = batch.slice(start, 500).to_pylist()
                # the writer ends each row with the record's last line end
                values = [r[:-2].decode() for row in rows for r in records_of(row, segment_bytes)]
                yield pa.record_batch([pa.array(values, pa.string())], names=["value"])

    marked.select("page", "url", "url_hash", "html", "digest", "first", "first_url").mapInArrow(run, "value string").write.option(
        "lineSep", "\r\n"
    ).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(folder)


def _parsed(text: str) -> dict:
    """Fields of one record without its version line."""
    data = text.encode()
    head, gap, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode().split("\r\n"):
        key, _, value = line.partition(":")
        fields[key.strip().lower()] = value.strip()
    bare = lambda k: fields[k].strip("<>") if k in fields else None
    number = lambda k: int(fields[k]) if fields.get(k, "").isdigit() else None
    size = number("content-length")
    error = None
    if not gap or size is None:
        error, size = "no length", 0
    elif rest[size:] not in (b"\r\n\r\n", b"\r\n", b""):
        error = "the block has not its stated length"
    elif len(rest) < size:
        error = "the block is cut off"
    return {
        "record": bare("warc-record-id"), "kind": fields.get("warc-type"), "origin": bare("warc-segment-origin-id"),
        "number": number("warc-segment-number"), "total": number("warc-segment-total-length"), "url": fields.get("warc-target-uri"),
        "digest": fields.get("warc-payload-digest"), "refers": bare("warc-refers-to"), "block": rest[:size], "error": error,
    }


RECORD = (
    "record string, kind string, origin string, number int, total long, url string, digest string, refers string, "
    "block binary, error string"
)
_RECORD = pa.schema([
    *((c, pa.string()) for c in ("record", "kind", "origin")), ("number", pa.int32()), ("total", pa.int64()),
    *((c, pa.string()) for c in ("url", "digest", "refers")), ("block", pa.binary()), ("error", pa.string()),
])


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the archives below `folder`."""
    parts = spark.read.option("lineSep", f"{VERSION}\r\n").text(folder).filter("value <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows = [_parsed(t) for t in batch.column(0).slice(start, 500).to_pylist()]
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    return parts.mapInArrow(run, RECORD)


def _payload(block: bytes) -> tuple[int, str | None]:
    """Length and digest of the payload in an HTTP message; a length alone if there is no body."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = head.lower().split(b"\r\n")
    if any(f.startswith(b"transfer-encoding:") and b"chunked" in f for f in fields):
        body = unframed(body)
    elif not body:
        sizes = [int(f.split(b":")[1]) for f in fields if f.startswith(b"content-length:")]
        if sizes and sizes[0]:
            return sizes[0], None
    return len(body), hashlib.sha256(body).hexdigest()


def _whole_record(row: dict) -> dict:
    error = next((p["error"] for p in row["parts"] if p["error"]), None)
    parts = sorted(row["parts"], key=lambda p: p["number"] or 1)
    block = b"".join(p["block"] for p in parts)
    first, size, digest = parts[0], None, None
    stated = [p["total"] for p in parts if p["total"] is not None]
    if not error and [p["number"] or 1 for p in parts] != list(range(1, len(parts) + 1)):
        error = "a segment is missing"
    if not error and (first["number"] is not None and stated != [len(block)]):
        error = "the segments have not the stated total length"
    if not error:
        try:
            size, digest = _payload(block)
        except ValueError as e:
            error = str(e)
    said = (first["digest"] or "").removeprefix("sha256:") or None
    if not error and digest is not None and said not in (None, digest):
        error = "the payload has not its stated digest"
    page = lambda name: int(m[1]) if name and (m := re.match(r"urn:page:(-?\d+)", name)) else None
    return {
        "page_id": page(first["record"]), "payload_bytes": size, "payload_digest": digest or said, "record_type": first["kind"],
        "refers_to": page(first["refers"]), "url": first["url"], "error": error,
    }


_PAGE = pa.schema([
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("url", pa.string()), ("error", pa.string()),
])


def reassemble(records: DataFrame) -> DataFrame:
    """One row per page record: continuations are joined to their origin; records in one piece aren't shuffled."""
    fields = ("record", "kind", "number", "total", "url", "digest", "refers", "block", "error")
    piece = F.struct(*fields)
    single = records.filter("number is null").select(F.array(piece).alias("parts"))
    # a record that is there several times has each segment as often: one copy is put together, and comes out for each
    segments = (
        records.filter("number is not null").groupBy(F.coalesce("origin", "record").alias("name"), piece.alias("piece"))
        .agg(F.count(F.lit(1)).alias("times")).groupBy("name")
        .agg(F.collect_list("piece").alias("parts"), F.max("times").alias("times"))
        .select("parts", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("parts")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows = [_whole_record(r) for r in batch.slice(start, 500).to_pylist()]
                yield pa.RecordBatch.from_pylist(rows, schema=_PAGE)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, error string"
    return single.mapInArrow(run, schema).union(segments.mapInArrow(run, schema))
