"""WARC archives of pages: writing with segmentation and revisits, and segment reassembly.

Writing: each page is a ``response`` record whose block is an HTTP response with a chunked
body, or, if a page with an equal payload of at least ``REVISIT_BYTES`` is the response, a
``revisit`` record without a body. A block longer than ``SEGMENT`` bytes is split: the
first segment and its ``continuation`` records carry the origin's id and their segment
number, and the last one the total length. Records are bounded by segmentation and files by
``RECORDS_PER_FILE`` records, so a reader that takes whole files stays bounded; segments of
one record may well lie in different files.

Reading: whole records come straight from the parser; segments are grouped by origin id,
ordered by number and checked (numbers 1..n without a gap, total length, block digest),
chunk framing is decoded and the payload digest verified. A group is one page's own bytes.

Scale: equal payloads are found by digest with a ``max`` that combines before the shuffle;
only narrow rows are joined to it, and AQE splits the hot digests of that join. Bodies move
once, from the page to its archive file, and segments once more to their origin.

Defined results: null html is an empty payload; null page_ids are archived and returned, and
never are the response of others that have an id; null urls are written as an empty target;
of repeated rows of the largest page_id each is a response; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from adlens.llm.common import shared_path, written

REVISIT_BYTES = 1000
SEGMENT = 1 << 14
CHUNK = 4096
RECORDS_PER_FILE = 1024
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- records ------------------------------------------------------------------------------

def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """``body`` in HTTP/1.1 chunked transfer framing."""
    parts = []
    for s in range(0, len(body), size):
        some = body[s:s + size]
        parts.append(b"%x\r\n%b\r\n" % (len(some), some))
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(raw: bytes) -> bytes:
    """The body of chunked transfer framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        eol = raw.index(b"\r\n", at)
        n = int(raw[at:eol].split(b";")[0], 16)
        at = eol + 2
        if not n:
            return b"".join(out)
        if len(raw) < at + n + 2 or raw[at + n:at + n + 2] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(raw[at:at + n])
        at += n + 2


def base32_sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return b"WARC/1.1\r\n%bContent-Length: %d\r\n\r\n%b%b" % (lines.encode(), len(block), block, END)


def _one_line(value: str | None) -> str:
    return re.sub(r"[\r\n]+", " ", value or "").strip()


def page_records(page_id, url, html, refers_to, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page: a response (segmented if long) or a revisit of page ``refers_to``."""
    body = (html or "").encode("utf-8")
    kind = "response" if refers_to is None else "revisit"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is None:
        block += chunked(body)
    origin = f"<urn:uuid:{uuid.uuid4()}>"
    common = [("WARC-Target-URI", _one_line(url)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    about = [("WARC-Payload-Digest", base32_sha1(body)), ("WARC-Block-Digest", base32_sha1(block)),
             ("X-Payload-Length", str(len(body)))]
    if page_id is not None:
        about.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        about += [("WARC-Profile", PROFILE), ("X-Refers-To-Page", str(refers_to))]
    pieces = [block[s:s + segment] for s in range(0, len(block), segment)]
    out = []
    for number, piece in enumerate(pieces, 1):
        headers = [("WARC-Type", kind if number == 1 else "continuation"),
                   ("WARC-Record-ID", origin if number == 1 else f"<urn:uuid:{uuid.uuid4()}>"), *common]
        if number == 1:
            headers += [("Content-Type", "application/http; msgtype=response"), *about]
        else:
            headers.append(("WARC-Segment-Origin-ID", origin))
        if len(pieces) > 1:
            headers.append(("WARC-Segment-Number", str(number)))
            if number == len(pieces):
                headers.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_record(headers, piece))
    return out


def parse(content: bytes):
    """(headers, block) of every record of an archive's bytes (whole-file or per-record gzip, or plain)."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at = 0
    while at < len(content):
        if content[at:at + 2] == b"\r\n" or content[at:at + 1] == b"\n":  # blank lines between records
            at += 2 if content[at:at + 1] == b"\r" else 1
            continue
        if content[at:at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        head = content.index(END, at)
        headers = {}
        for line in content[at:head].decode("utf-8").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            headers[k.strip().lower()] = v.strip()
        n = int(headers["content-length"])
        start = head + 4
        if start + n > len(content):
            raise ValueError("cut-off record")
        yield headers, content[start:start + n]
        at = start + n


# --- writing ------------------------------------------------------------------------------

def revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of the pages that revisit another: narrow rows only."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("digest"),
                        F.octet_length(payload).alias("n")).filter(F.col("n") >= REVISIT_BYTES)
    last = rows.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).filter("copies > 1")
    return rows.select("page_id", "digest").join(last.select("digest", "refers_to"), "digest").filter(
        F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()


def write_archive(pages: DataFrame, path: str, segment: int = SEGMENT, compression: str = "gzip") -> None:
    """Archive ``pages`` (page_id, url, html) as WARC files under ``path``."""
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                          F.col("html").cast("string").alias("html"))
    digest = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    again = written(revisits(pages), "revisits").select(
        F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "refers_to")
    rows = narrow.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (digest == F.col("again_digest")), "left")

    def run(batches):
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(4)]
            out, size = [], 0
            for row in zip(*cols):
                # the text sink ends each record with what a WARC record ends with
                new = [r[:-len(END)] for r in page_records(*row, segment=segment)]
                out += new
                size += sum(map(len, new))
                if size > 1 << 22:
                    yield pa.record_batch([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            if out:
                yield pa.record_batch([pa.array(out, pa.binary())], ["record"])

    records = rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, "record binary")
    (records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END.decode())
     .option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", compression).text(path))


# --- reading ------------------------------------------------------------------------------

_RECORDS = {
    "type": pa.string(), "record_id": pa.string(), "origin": pa.string(), "number": pa.int32(), "total": pa.int64(),
    "page_id": pa.int64(), "url": pa.string(), "refers_to": pa.int64(), "payload_digest": pa.string(),
    "payload_bytes": pa.int64(), "block_digest": pa.string(), "block": pa.binary()}
_RECORD_TYPES = ("type string, record_id string, origin string, number int, total long, page_id long, url string, "
                 "refers_to long, payload_digest string, payload_bytes long, block_digest string, block binary")
_PAGE = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
_PAGE_TYPES = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def bare_hex(digest: str | None) -> str | None:
    """The hex digits of a labelled base32 SHA-1."""
    return base64.b32decode(digest.partition(":")[2]).hex() if digest else None


def _fields(h: dict, block: bytes | None) -> dict:
    number = lambda key: int(h[key]) if key in h else None
    return {"type": h["warc-type"], "record_id": h["warc-record-id"],
            "origin": h.get("warc-segment-origin-id", h["warc-record-id"]),
            "number": number("warc-segment-number"), "total": number("warc-segment-total-length"),
            "page_id": number("x-page-id"), "url": h.get("warc-target-uri"), "refers_to": number("x-refers-to-page"),
            "payload_digest": bare_hex(h.get("warc-payload-digest")), "payload_bytes": number("x-payload-length"),
            "block_digest": h.get("warc-block-digest"), "block": block}


def verified(r: dict, block: bytes) -> bytes | None:
    """The payload of a record's whole block (None for a revisit); raises where a digest or length is off."""
    if r["block_digest"] and base32_sha1(block) != r["block_digest"]:
        raise ValueError(f"block of {r['record_id']} fails its digest")
    if r["type"] != "response":
        return None
    body = payload_of(block)
    if hashlib.sha1(body).hexdigest() != r["payload_digest"] or len(body) != r["payload_bytes"]:
        raise ValueError(f"payload of {r['record_id']} fails its digest")
    return body


def parsed(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record under ``path``, written once: segments with their bytes, whole records verified.

    Of a whole record the decoded payload is kept in ``block`` only if asked for.
    """
    def run(batches):
        for b in batches:
            for content in b.column("content"):
                rows, size = [], 0
                for h, block in parse(content.as_py()):
                    r = _fields(h, block)
                    if r["number"] is None:
                        body = verified(r, block)
                        r["block"] = body if with_payload else None
                    size += len(r["block"] or b"")
                    rows.append(r)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(_RECORDS))
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(_RECORDS))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return written(files.select("content").mapInArrow(run, _RECORD_TYPES), "records")


def assemble(segments: list[dict]) -> bytes:
    """The block of one origin from its segments in any order; raises if one is missing or the length is off."""
    order = sorted(segments, key=lambda s: s["number"])
    if [s["number"] for s in order] != list(range(1, len(order) + 1)):
        raise ValueError("segments are missing or repeated")
    block = b"".join(s["block"] for s in order)
    if order[-1]["total"] != len(block):
        raise ValueError(f"segments hold {len(block)} bytes of {order[-1]['total']}")
    return block


def payload_of(block: bytes) -> bytes:
    """The entity body of an HTTP response block."""
    head, _, body = block.partition(END)
    if re.search(rb"^transfer-encoding:\s*chunked\s*$", head, re.I | re.M):
        return dechunked(body)
    return body


def reassembled(records: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per origin of :func:`parsed` records: page_id, url, payload_bytes, payload_digest (bare hex), record_type, refers_to."""
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                body = verified(r, assemble(r["segments"]))
                row = [pa.array([r[c]], _RECORDS[c]) for c in ("page_id", "url", "payload_bytes", "payload_digest", "type", "refers_to")]
                yield pa.record_batch(row + [pa.array([body if with_payload else None], pa.binary())], [*_PAGE, "payload"])

    own = ("page_id", "url", "payload_bytes", "payload_digest", "type", "refers_to")
    whole = records.filter("number is null").select(
        *(F.col(c).alias(n) for c, n in zip(own, _PAGE)), F.col("block").alias("payload"))
    first = (*own, "record_id", "block_digest")
    split = records.filter("number is not null").groupBy("origin").agg(
        F.collect_list(F.struct("number", "total", "block")).alias("segments"),  # one page's own bytes
        *(F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in first))
    out = whole.unionByName(split.mapInArrow(run, _PAGE_TYPES + ", payload binary"))
    return out if with_payload else out.drop("payload")


def round_trip(pages: DataFrame, path: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """Write an archive of ``pages`` and read it back."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write_archive(pages, path, segment)
    return reassembled(parsed(spark, path))
