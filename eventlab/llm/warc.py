"""WARC archives: a writer, and a reader that salvages damaged ones.

Archives are rows (path, content), as Spark's ``binaryFile`` source reads them; the
writer makes such rows of ``ARCHIVE`` bytes or one record each, in a table in
the shared folder.  Records are gzip members.  Of equal payloads one is a response
and the others are revisits that refer to it; the SHA-1 of payloads decides, and
the largest page of each digest is found by partial aggregation before the shuffle.

The reader checks each member (gzip checksum, version line, header, length, payload
digest).  After a failed check it looks for the next gzip magic or version line from
which a record passes all checks, carries on there, and logs the bytes between as
a gap.  A member whose first bytes aren't a version line is left at once, so that bytes
which only look like members cost little.  ``quarantine`` writes the log of gaps as a table.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlab.llm.tables import cut

ARCHIVE = 4 << 20
_MAGIC = b"\x1f\x8b\x08"
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.\d\r\n")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def record(page_id: int | None, url: str | None, digest: str, size: int, payload: bytes | None, refers_to: int | None) -> bytes:
    """One WARC record, not compressed; without payload a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}"]
    head += [f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {_uri(url)}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if payload is None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def write_archives(pages: DataFrame) -> DataFrame:
    """(path, content): a record for each row of (page_id, url, html), html in UTF-8 (null: empty).

    Of rows with equal payloads those of the largest page_id are responses (null
    page_ids only where there is no other), the others revisit it.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("sha1", F.sha1("html"))
    holders = cut(rows.groupBy("sha1").agg(F.max("page_id").alias("holder")), "holders")
    both = rows.join(holders, "sha1")
    response = F.col("page_id").eqNullSafe(F.col("holder"))
    both = both.select("page_id", "url", "sha1", F.octet_length("html").alias("size"), F.when(response, F.col("html")).alias("html"), F.when(~response, F.col("holder")).alias("refers_to"))
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{n:05d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], schema=schema)

        for batch in batches:
            ids, urls, digests, sizes, refs = (batch.column(k).to_pylist() for k in (0, 1, 2, 3, 5))
            for i, html in enumerate(batch.column(4)):
                digest = base64.b32encode(bytes.fromhex(digests[i])).decode()
                held.append(member(record(ids[i], urls[i], digest, sizes[i], html.as_py(), refs[i])))
                size += len(held[-1])
                if size >= ARCHIVE:
                    yield archive()
                    n, held, size = n + 1, [], 0
        if held:
            yield archive()

    return both.mapInArrow(run, "path string, content binary")


def _parse(data: bytes, at: int, whole: bool) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``; ``whole``: it must fill ``data``.  ValueError if a check fails."""
    if not re.match(rb"WARC/1\.\d\r\n", data[at : at + 10]):
        raise ValueError("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise ValueError("header without end")
    try:
        lines = data[at:stop].decode().split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        length = int(head["content-length"])
    except (ValueError, KeyError):
        raise ValueError("bad header") from None
    begin, end = stop + 4, stop + 4 + length
    if length < 0 or end > len(data):
        raise ValueError("truncated block")
    if data[end : end + 4] != b"\r\n\r\n" or (whole and end + 4 != len(data)):
        raise ValueError("wrong length")
    if not {"warc-type", "warc-record-id", "warc-date"} <= head.keys():
        raise ValueError("missing field")
    block = data[begin:end]
    for name, body in (("warc-block-digest", block), ("warc-payload-digest", block.partition(b"\r\n\r\n")[2] if head["warc-type"] == "response" else None)):
        if body is not None and head.get(name, "").startswith("sha1:") and head[name][5:] != base32_sha1(body):
            raise ValueError("digest differs")
    return head, block, end + 4


def _record_at(content: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    if content[at : at + 3] != _MAGIC:
        return _parse(content, at, False)
    unpack = zlib.decompressobj(31)
    out, view = [], memoryview(content)
    pos = at
    try:
        while not unpack.eof and pos < len(content):
            step = 256 if pos == at else 1 << 16
            out.append(unpack.decompress(view[pos : pos + step]))
            pos += step
            if not b"WARC/1.".startswith((first := b"".join(out[:2])[:7])) and first != b"WARC/1.":
                raise ValueError("no version line")
    except zlib.error:
        raise ValueError("damaged member") from None
    if not unpack.eof:
        raise ValueError("truncated member")
    head, block, _ = _parse(b"".join(out), 0, True)
    return head, block, min(pos, len(content)) - len(unpack.unused_data)


def salvage(content: bytes) -> Iterator[tuple[str, int, int, str | None, dict[str, str], bytes]]:
    """("record", start, end, None, headers, block) and ("gap", start, end, reason, {}, b"") in order; together they cover the content."""
    at = 0
    while at < len(content):
        try:
            head, block, end = _record_at(content, at)
        except ValueError as e:
            reason, end = str(e), len(content)
            for m in _START.finditer(content, at + 1):
                try:
                    _record_at(content, m.start())
                except ValueError:
                    continue
                end = m.start()
                break
            yield "gap", at, end, reason, {}, b""
        else:
            yield "record", at, end, None, head, block
        at = end


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """What salvage finds in rows (path, content): records and gaps.

    kind, path, start, end, reason (of gaps), page_id, record_type, target_uri, payload_digest,
    payload_bytes (of the full payload, for revisits as their HTTP header has it),
    refers_to, and payload (of responses, if asked for).  Null or empty contents have no rows.
    """
    names = ["kind", "path", "start", "end", "reason", "page_id", "record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip(names + ["payload"] * payloads, types + [pa.binary()] * payloads)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for kind, start, end, reason, head, block in salvage(content.as_py() or b""):
                    http, _, body = block.partition(b"\r\n\r\n")
                    size = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
                    revisit = head.get("warc-type") == "revisit"
                    row = [kind, path, start, end, reason, _page(head.get("warc-record-id")), head.get("warc-type"), head.get("warc-target-uri")]
                    row += [head.get("warc-payload-digest", "").removeprefix("sha1:") or None, (int(size[1]) if size else None) if revisit else len(body) if head else None, _page(head.get("warc-refers-to"))]
                    rows.append(row + ([body if head and not revisit else None] if payloads else []))
                    if len(rows) == 1000:
                        yield made(rows)
                        rows = []
                yield made(rows)

    def made(rows: list[list]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)

    return archives.select("path", F.col("content").cast("binary")).mapInArrow(run, "kind string, path string, start long, end long, reason string, page_id long, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to long" + ", payload binary" * payloads)


def quarantine(found: DataFrame, path: str) -> DataFrame:
    """Write the gaps of ``found`` (what ``read_archives`` gives) to the table at ``path`` and return it: path, start, end, reason.

    An archive without gaps has no rows there.
    """
    found.where("kind = 'gap'").select("path", "start", "end", "reason").write.mode("append").parquet(path)
    return found.sparkSession.read.schema("path string, start long, end long, reason string").parquet(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives and read these back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Takes page_id, url and html; other columns are ignored.  One row for each
    row: rows that repeat the largest page_id of a payload are all responses; null
    page_ids come out as null.  An empty table gives an empty table.  A gap in an archive
    just written raises, so no page is lost unseen.
    """
    found = read_archives(cut(write_archives(pages), "archives"), payloads=False)
    lost = F.raise_error(F.concat_ws(" ", F.lit("gap in"), "path", "start", "end", "reason"))
    kind = F.when(F.col("kind") == "gap", lost).otherwise(F.col("record_type"))
    return found.select("page_id", "payload_bytes", "payload_digest", kind.alias("record_type"), "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS holder FROM p)
SELECT page_id, strlen(html) AS payload_bytes,
       list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * i + 1, 5))::INT >> s) & 31)::INT + 1, 1)), 'string_agg', '')),
           'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM holder THEN holder END AS refers_to
FROM q
"""
