"""WARC archives: records are written, segmented, read back and reassembled.

Writing: pages with equal payloads keep one response, that of the largest id; the others become revisits.
A response block is an HTTP answer in chunked transfer framing. A block longer than SEGMENT bytes is cut at
character borders into a first record and continuation records with an origin id and a segment number; the
last one states the total length. Spark's text writer with the record separator as its line end makes gzip
WARC files in the shared folder, with the usual commit protocol, so a lost task leaves no half file behind.

Reading: Spark's text reader streams gzip files, cut at the record separator, and a parser joins the pieces and holds one
record at a time, so that a file may have any size. Plain files, which that reader would split, are read whole.
Whole records are decoded at once. Segments are grouped by origin, ordered by number, checked for gaps and for the
total length, and decoded; a group is one page. Payloads must have the digests that their records state.

Only page ids, digests and lengths are compared across pages; a payload is moved once, to its page's verdict.

Nulls and edge cases: a null html is an empty payload, and empty payloads equal one another; a null page_id is a
response where no row with an id has its payload, else a revisit; rows repeating a page_id and payload are the same record and each a response
(or revisit) like the first, with a record id of its own, so that a revisit's reference to a repeated response names none of the
copies; a null url is written as an empty target; line ends in a url are percent-encoded;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from functools import partial
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, table

CRLF = "\r\n"
SEPARATOR = CRLF * 2
SEGMENT = 32 << 10
CHUNK = 8 << 10
PER_FILE = 20_000
_HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Transfer-Encoding: chunked{CRLF}{CRLF}"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _cut(text: str, size: int) -> Iterator[str]:
    """Pieces of at most `size` UTF-8 bytes (one character at least)."""
    raw, at = text.encode("utf-8"), 0
    while at < len(raw):
        end = min(len(raw), at + size)
        while end < len(raw) and raw[end] & 0xC0 == 0x80 and end > at + 1:
            end -= 1
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        yield raw[at:end].decode("utf-8")
        at = end


def chunked(payload: str, size: int = CHUNK) -> str:
    framed = [f"{len(piece.encode('utf-8')):x}{CRLF}{piece}{CRLF}" for piece in _cut(payload, size)]
    return "".join(framed) + f"0{CRLF}{CRLF}"


def unchunked(body: bytes) -> bytes:
    """The payload in chunked transfer framing, extensions and trailers ignored."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is not closed")
        out.append(body[at : at + size])
        at += size + 2


def _record(headers: list[tuple[str, str]], block: str) -> str:
    lines = [f"{k}: {v}" for k, v in [*headers, ("Content-Length", str(len(block.encode("utf-8"))))]]
    return CRLF.join(["WARC/1.1", *lines, "", block])


def _name(page_id: int | None, digest: str, unique: str) -> str:
    """A page's record id: its number and payload; copies of a row and rows without a number are told apart by `unique`."""
    return f"urn:page:{'' if page_id is None else page_id}:{digest}{unique and ':' + unique}"


def records(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, unique: str, date: str, segment: int = SEGMENT) -> Iterator[str]:
    """The records of one page, without the two line ends that close each."""
    payload = html or ""
    raw = payload.encode("utf-8")
    digest = base32_sha1(raw)
    name = _name(page_id, digest, unique)
    common = [
        ("WARC-Date", date), ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(raw))),
    ]
    if refers_to is not None:
        headers = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{name}>"), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{_name(refers_to, digest, '')}>")]
        yield _record(headers, "HTTP/1.1 200 OK" + CRLF + CRLF)
        return
    pieces = list(_cut(_HTTP + chunked(payload), segment))
    total = sum(len(p.encode("utf-8")) for p in pieces)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{name}>"), *common, ("Content-Type", "application/http;msgtype=response")]
    if len(pieces) > 1:
        first.append(("WARC-Segment-Number", "1"))
    yield _record(first, pieces[0])
    for number, piece in enumerate(pieces[1:], 2):
        headers = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{name}.{number}>"), ("WARC-Date", date), ("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", str(number))]
        if number == len(pieces):
            headers.append(("WARC-Segment-Total-Length", str(total)))
        yield _record(headers, piece)


def _written(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    part, n, date = TaskContext.get().partitionId(), 0, datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    for batch in batches:
        out = []
        for page_id, url, html, refers, lone in zip(*(batch.column(i) for i in range(5))):
            out += records(page_id.as_py(), url.as_py(), html.as_py(), refers.as_py(), "" if lone.as_py() else f"{part}.{n}", date, segment)
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, segment: int = SEGMENT) -> None:
    """Write a record per row of page_id, url, html to gzip WARC files under path.

    Payloads of fewer than min_bytes bytes are never revisits.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    # Rows of a page and payload: one, but for repeated rows. Counting them first leaves one row per page in the joins.
    counted = keyed.groupBy("page_id", "sha1").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("html")).alias("size"))
    keepers = counted.filter(F.col("size") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("keeper"))
    # Where no row of a payload has an id, the keeper is null and all are responses.
    facts = counted.join(keepers, "sha1", "left").withColumn("keeper", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")))
    odd = facts.filter("keeper IS NOT NULL OR n > 1").select(F.col("page_id").alias("p"), F.col("sha1").alias("s"), "keeper", "n")
    judged = keyed.join(odd, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha1") == F.col("s")), "left")
    lone = F.col("page_id").isNotNull() & (F.coalesce("n", F.lit(1)) == 1)
    lines = judged.select("page_id", "url", "html", "keeper", lone.alias("lone")).mapInArrow(partial(_written, segment=segment), "value string")
    lines.write.option("lineSep", SEPARATOR).option("compression", "gzip").option("maxRecordsPerFile", PER_FILE).text(path)


def inflated(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip file's members, or of a plain file as they are."""
    inflate, first = None, True
    for piece in pieces:
        if first and piece:
            first = False
            inflate = zlib.decompressobj(31) if piece[:2] == b"\x1f\x8b" else None
        while inflate and piece:
            yield inflate.decompress(piece)
            piece = inflate.unused_data if inflate.eof else b""
            if inflate.eof:
                inflate = zlib.decompressobj(31)
        if piece:
            yield piece


def parse(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of every record of WARC files given in pieces, one at a time."""
    source, buffer, at = inflated(pieces), bytearray(), 0

    def more() -> bool:
        nonlocal buffer, at
        if at > 1 << 20:
            del buffer[:at]
            at = 0
        piece = next(source, None)
        if piece is None:
            return False
        buffer += piece
        return True

    while True:
        searched = 0
        while (end := buffer.find(b"\r\n\r\n", at + searched)) < 0:
            searched = max(0, len(buffer) - at - 3)
            if not more():
                if bytes(buffer[at:]).strip():
                    raise ValueError("a record's header is cut off")
                return
        head = bytes(buffer[at:end])
        if not head.strip():
            at = end + 2
            continue
        version, *lines = head.lstrip(b"\r\n").decode("utf-8").split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        need = int(headers["content-length"])
        at = end + 4
        while len(buffer) - at < need:
            if not more():
                raise ValueError("a record's block is cut off")
        yield headers, bytes(buffer[at : at + need])
        at += need


_PARSED = "page_id long, origin string, number int, total long, block binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _page(name: str) -> int | None:
    part = name.strip("<>").split(":")[2]
    return int(part) if part else None


def _payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _checked(payload: bytes, stated: str | None) -> str:
    """The payload's digest, which must be the one stated."""
    digest = base32_sha1(payload)
    if stated and stated != digest:
        raise ValueError(f"a payload has the digest {digest}, {stated} stated")
    return digest


def _parsed(batches: Iterator[pa.RecordBatch], whole_files: bool) -> Iterator[pa.RecordBatch]:
    """Rows of whole files, or of a file's pieces in order, each without the separator after it."""
    schema = pa.schema([("page_id", pa.int64()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    values = (v.as_py() for batch in batches for v in batch.column(0).cast(pa.binary()))
    sources = (parse([v]) for v in values) if whole_files else [parse(v + SEPARATOR.encode() for v in values)]
    rows, held = [], 0
    for headers, block in chain.from_iterable(sources):
        kind = headers["warc-type"]
        number = int(headers.get("warc-segment-number", 0))
        name = headers["warc-record-id"]
        stated = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if kind == "revisit":
            rows.append((_page(name), None, None, None, None, int(headers["x-payload-length"]), stated, kind, _page(headers["warc-refers-to"])))
        elif number:
            origin = headers.get("warc-segment-origin-id", name)
            total = headers.get("warc-segment-total-length")
            rows.append((_page(origin), origin, number, total and int(total), block, None, stated, "response", None))
            held += len(block)
        elif kind == "response":
            payload = _payload(block)
            rows.append((_page(name), None, None, None, None, len(payload), _checked(payload, stated), kind, None))
        if len(rows) >= 5000 or held > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def reassemble(numbers: list[int], totals: list[int | None], blocks: list[bytes]) -> bytes:
    """The block that segments make up; raises if one is missing or the total length differs."""
    order = sorted(range(len(numbers)), key=lambda i: numbers[i])
    if [numbers[i] for i in order] != list(range(1, len(numbers) + 1)):
        raise ValueError(f"segments {sorted(numbers)} are not complete")
    stated = totals[order[-1]]
    block = b"".join(blocks[i] for i in order)
    if stated != len(block):
        raise ValueError(f"{len(block)} bytes in segments, {stated} stated")
    return block


def _joined(key: tuple, group: pa.Table) -> pa.Table:
    block = reassemble(group["number"].to_pylist(), group["total"].to_pylist(), group["block"].to_pylist())
    payload = _payload(block)
    digest = _checked(payload, next((d for d in group["payload_digest"].to_pylist() if d), None))
    return pa.table({"page_id": pa.array([group["page_id"][0].as_py()], pa.int64()), "payload_bytes": pa.array([len(payload)], pa.int64()), "payload_digest": pa.array([digest]), "record_type": pa.array(["response"]), "refers_to": pa.array([None], pa.int64())})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page in the *.gz and *.warc files at path."""
    pieces = spark.read.option("lineSep", SEPARATOR).option("pathGlobFilter", "*.gz").text(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").load(path).select("content")
    found = pieces.mapInArrow(partial(_parsed, whole_files=False), _PARSED).unionByName(files.mapInArrow(partial(_parsed, whole_files=True), _PARSED))
    parsed = materialize(found, "warc-parsed")
    shape = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    whole = parsed.filter("origin IS NULL").select(*shape)
    cut = parsed.filter("origin IS NOT NULL").select("page_id", "origin", "number", "total", "block", "payload_digest")
    joined = cut.groupBy("origin").applyInArrow(_joined, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return whole.unionByName(joined)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/graphspark-scratch/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)
