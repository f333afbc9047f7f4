"""WARC archives: a writer with identical-payload revisits, and a reader that salvages damaged files.

Archives are files of gzip members, one record each.  Spark's own text writer stores them, so any file system that Spark
writes to will do: a gzip member ends with the high byte of its length, which is zero for records under 16 MB, and zero is
the line separator used; after a larger record an empty member follows, which ends in zero as well.

The reader checks each member (CRC and length by gzip, block length and payload digest by WARC).  After a failed check it
searches for the next valid member or version line, goes on from there, and logs the bytes between as a gap.  A member
may hold many records: what inflates of a damaged or cut one is kept, and searched in the same way.

A null html is an empty payload; a null url gives no target header; a null page_id gives a record id made from the
content, and reads back as null.  Of equal payloads of at least ``min_bytes``, rows with the smallest page_id are
responses, others (null included) are revisits; if all are null, all are responses.  An empty table gives no record.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.llm.common import cut, table, work_folder

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of members that make one row of the writer, and rows per archive file: files stay near 32 MB.
ROW_BYTES, FILE_ROWS = 4 << 20, 8
RECORD = ("archive string, start long, end long, kind string, page_id long, url string, record_type string, "
          "refers_to long, payload_bytes long, payload_digest string, payload binary, reason string")


def gzip_member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record_uri(page_id: int | None, url: str | None, digest: str) -> str:
    return f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {digest}')}"


def warc_record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record; a revisit keeps the HTTP headers, which tell the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <{record_uri(page_id, url, digest)}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20%]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
             "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int] | str:
    """(fields, end) of the record that starts at ``at``, or what is wrong with it."""
    head_end = data.find(b"\r\n\r\n", at)
    if not data.startswith(b"WARC/1.", at) or head_end < 0:
        return "no header"
    head = {}
    for line in data[at:head_end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return "bad header line"
        head[name.strip().lower()] = value.strip()
    if not head.get("content-length", "").isdigit():
        return "no length"
    start, end = head_end + 4, head_end + 4 + int(head["content-length"])
    if data[end:end + 4] != b"\r\n\r\n":
        return "wrong length"
    block = data[start:end]
    http, _, payload = block.partition(b"\r\n\r\n")
    whole = head.get("warc-block-digest", "")
    if whole.startswith("sha256:") and hashlib.sha256(block).hexdigest() != whole[7:]:
        return "wrong block digest"
    revisit = head.get("warc-type") == "revisit"
    digest = head.get("warc-payload-digest", "").removeprefix("sha256:")
    if not revisit and digest and hashlib.sha256(payload).hexdigest() != digest:
        return "wrong digest"
    full = re.search(rb"(?i)\ncontent-length:[ ]*([0-9]+)", http)
    page = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?[0-9]+)>", head.get(name, ""))) else None
    url = head.get("warc-target-uri")
    return {
        "page_id": page("warc-record-id"), "refers_to": page("warc-refers-to"), "record_type": head.get("warc-type"),
        "url": url and re.sub(r"%(0[0-9A-F]|1[0-9A-F]|20|25)", lambda m: chr(int(m[1], 16)), url),
        "payload_bytes": int(full[1]) if revisit and full else len(payload), "payload_digest": digest,
        "payload": None if revisit else payload,
    }, end + 4


def inflate(data: memoryview, at: int) -> tuple[bytes, int | None, str]:
    """(content, end, "") of the gzip member at ``at``; of a damaged or cut one what inflates, None and the reason."""
    unpack, parts, size = zlib.decompressobj(31), [], 1 << 16
    while not unpack.eof and at < len(data):
        piece = data[at:at + size]
        before = unpack.copy() if parts else zlib.decompressobj(31)
        try:
            parts.append(unpack.decompress(piece))
        except zlib.error:
            # The failed call keeps its output to itself; single bytes give all that comes before the fault.
            for i in range(len(piece)):
                try:
                    parts.append(before.decompress(piece[i:i + 1]))
                except zlib.error:
                    break
            return b"".join(parts), None, "damaged member"
        at += len(piece) - len(unpack.unused_data)
    return b"".join(parts), at if unpack.eof else None, "" if unpack.eof else "cut member"


def inside(content: bytes, whole: bool) -> Iterator[tuple[int, int, dict | str]]:
    """Like salvage(), for the content of a member, with offsets in it.

    Where the member is not ``whole``, what inflates may be wrong: records without a digest that could be checked are gaps.
    """
    at, gap, reason = 0, None, ""
    while at < len(content):
        one = parse_record(content, at)
        if not isinstance(one, str) and not whole:
            head = content[at:content.find(b"\r\n\r\n", at)].lower()
            held = rb"\nwarc-block-digest:\s*sha256:" if one[0]["payload"] is None else rb"\nwarc-(block|payload)-digest:\s*sha256:"
            one = one if re.search(held, head) else "unverified record"
        if isinstance(one, str):
            if gap is None:
                gap, reason = at, one
            at = place if (place := content.find(b"WARC/1.", at + 1)) >= 0 else len(content)
            continue
        if gap is not None:
            yield gap, at, reason
            gap = None
        yield at, one[1], one[0]
        at = one[1]
    if gap is not None:
        yield gap, len(content), reason


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | str]]:
    """(start, end, fields) of each good record and (start, end, reason) of each gap, in file order.

    Gaps within a member that has good records have the member's place, and their own in its content in the reason.
    """
    view, at, gap, reason = memoryview(data), 0, None, ""

    def read(at):
        """(records and gaps, end) at this place, or the reason why there is no record; no end if it is not known."""
        if data.startswith(b"\x1f\x8b", at):
            content, end, why = inflate(view, at)
            found = list(inside(content, why != "damaged member"))
            if why == "cut member" and found and found[-1][1] == len(content):
                # The record that the cut goes through: its member's end is missing, even if all its bytes are there.
                found[-1] = *found[-1][:2], found[-1][2] if isinstance(found[-1][2], str) else "cut record"
            good = [f for *_, f in found if isinstance(f, dict)]
            if not good and (why or found):
                return why or found[0][2]
            got = [f if isinstance(f, dict) else f"{f} at {a}-{b} of the member" for a, b, f in found]
            if why:
                got.append(f"{why} after {len(content)} bytes of content")
            return got, end
        one = parse_record(data, at)
        return one if isinstance(one, str) else ([one[0]], one[1])

    def next_place(at):
        places = [p for p in (data.find(b"\x1f\x8b\x08", at + 1), data.find(b"WARC/1.", at + 1)) if p >= 0]
        return min(places, default=len(data))

    while at < len(data):
        found = read(at)
        if isinstance(found, str):
            if gap is None:
                gap, reason = at, found
            at = next_place(at)
            continue
        if gap is not None:
            yield gap, at, reason
            gap = None
        end = found[1]
        if end is None:
            # The end of a bad member is where something readable starts.
            end = next_place(at)
            while end < len(data) and isinstance(read(end), str):
                end = next_place(end)
        for fields in found[0]:
            yield at, end, fields
        at = end
    if gap is not None:
        yield gap, len(data), reason


def with_revisits(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """pages (page_id, url, html) as (page_id, url, payload, digest, refers_to)."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url",
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    firsts = (
        rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    # Only payloads that occur again are listed; a payload with a third of the pages is a skewed join key.
    firsts = cut(firsts.select(F.col("digest").alias("d"), "first"), "warc-firsts")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(firsts, F.col("digest") == F.col("d"), "left").select(
        "page_id", "url", "payload", "digest", F.when(again, F.col("first")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, level: int = 3, date: str = "2000-01-01T00:00:00Z") -> None:
    """Archives of ``rows`` (page_id, url, payload, digest, refers_to) in a new folder."""
    empty = gzip_member(b"", level)

    def members(batches):
        def row(parts):
            data = b"".join(parts)
            data += b"" if data.endswith(b"\0") else empty
            return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], names=["members"])

        held, size = [], 0
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(gzip_member(warc_record(page_id, url, payload, digest, refers_to, date), level))
                size += len(held[-1])
                if size >= ROW_BYTES:
                    yield row(held)
                    held, size = [], 0
        if held:
            yield row(held)

    packed = rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(members, "members binary")
    packed.select(F.col("members").cast("string")).write.option("lineSep", "\0").option("compression", "none").option(
        "maxRecordsPerFile", FILE_ROWS).text(folder)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records (kind 'record') and quarantined byte ranges (kind 'gap') of all archives in a folder."""
    schema = spark.createDataFrame([], RECORD).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def records(batches):
        def flush(rows):
            return pa.RecordBatch.from_pylist(rows, schema=arrow)

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for start, end, found in salvage(content.as_py()):
                    row = {"archive": path, "start": start, "end": end}
                    if isinstance(found, str):
                        rows.append(row | {"kind": "gap", "reason": found})
                        continue
                    if not payloads:
                        found = found | {"payload": None}
                    size += len(found["payload"] or b"")
                    rows.append(row | {"kind": "record"} | found)
                    if size >= ROW_BYTES or len(rows) >= 5000:
                        yield flush(rows)
                        rows, size = [], 0
                if rows:
                    yield flush(rows)

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(records, schema)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{work_folder(spark)}/llm/warc-{uuid.uuid4().hex}"
    write_archives(with_revisits(table(spark, sf_dir, "pages")), folder)
    return read_archives(spark, folder, payloads=False).where("kind = 'record'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE octet_length(payload) >= 100 GROUP BY digest)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest
"""
