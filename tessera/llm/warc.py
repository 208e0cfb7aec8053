"""WARC archives: pages written as segmented, chunk-framed records, read back by putting segments together again."""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, batch, read_table, shared_dir, stored

#: Fixed values of the WARC 1.1 standard.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SEGMENT_BYTES, CHUNK_BYTES, RECORDS_A_FILE, LEAST_SHARED = 1 << 16, 1 << 13, 2048, 100
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_OUT = pa.schema([
    ("page", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("problem", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary()),
])
_OUT_SQL = "page string, url string, record_type string, refers string, payload binary, payload_bytes long, payload_digest string, problem string, origin string, segment int, total long, block binary"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[k : k + size] for k in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of chunked framing; chunk extensions and trailers are passed over, broken framing is a ValueError."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size missing")
        size = int(body[at:end].partition(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk cut short")
        out.append(body[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One WARC record; headers whose value is None are left out."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return b"%b\r\n%bContent-Length: %d\r\n\r\n%b\r\n\r\n" % (VERSION, head.encode(), len(block), block)


def page_records(seed: str, page: str | None, url: str | None, payload: bytes, digest: str, refers: str | None, date: str, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page: a revisit without a block, or a response, cut into segments where it is longer than one.

    The first segment is the response itself (segment 1), the others are continuations that name it; the last one carries
    the total length of the block.
    """
    name = lambda k: f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{seed}|{k}'.encode()).hexdigest())}>"
    common = [("WARC-Date", date), ("WARC-Target-URI", None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]"))]
    about = [("X-Page-ID", page), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if refers is not None:
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", name(1)), *common, *about, ("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", refers)], b"")
        return
    block = _HTTP + chunked(payload)
    blocks = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)]
    last = len(blocks)
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", name(1)), *common, *about, ("WARC-Segment-Number", 1 if last > 1 else None)], blocks[0])
    for k, b in enumerate(blocks[1:], 2):
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", name(k)), *common, ("WARC-Segment-Origin-ID", name(1)), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", len(block) if k == last else None)], b)


def with_revisits(pages: DataFrame, page_id: str = "page_id", html: str = "html", least: int = LEAST_SHARED) -> DataFrame:
    """pages (their id as __page, url as __url) with __payload, __digest and __refers: the smallest id of the rows with an
    equal payload of at least `least` bytes, null for rows that hold it themselves.

    Rows that repeat the smallest id all hold their payload; a row with a null id revisits, and never is revisited. Groups
    of copies are counted in the tasks first, and only digests that come twice meet the pages.
    """
    own = pages.withColumns({"__payload": F.coalesce(F.col(html), F.lit("")).cast("binary")}).withColumn("__digest", F.sha2("__payload", 256))
    long = own.where(F.octet_length("__payload") >= least)
    first = long.groupBy("__digest").agg(F.min(page_id).alias("__first"), F.count("*").alias("__n")).where("__n > 1 and __first is not null")
    joined = own.join(first.select("__digest", "__first"), "__digest", "left")
    return joined.withColumn("__refers", F.when(~F.col("__first").eqNullSafe(F.col(page_id)), F.col("__first"))).drop("__first")


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z", segment_bytes: int = SEGMENT_BYTES, records_a_file: int = RECORDS_A_FILE) -> None:
    """Writes gzipped archives of one or more records a page into the folder `path`, through Spark's own writer, so that it
    may lie in any store that Spark writes to.

    Null and empty pages have an empty payload. A file holds at most records_a_file records of at most segment_bytes and a
    header, whatever the length of pages; segments of a page may lie in several files.
    """
    rows = with_revisits(pages.select(page_id, url, html), page_id, html).select(F.col(page_id).cast("string"), F.col(url), "__payload", "__digest", F.col("__refers").cast("string"))
    out = pa.schema([("record", pa.binary())])

    def run(batches):
        import pyspark

        task, n = pyspark.TaskContext.get().partitionId(), 0
        for b in batches:
            held, size = [], 0
            for page, link, payload, digest, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n += 1
                for r in page_records(f"{task}|{n}|{page}", page, link, payload, digest, refers, date, segment_bytes):
                    held.append(r[:-1])  # the writer's line end is a record's last byte
                    size += len(r)
                    if size > 1 << 23:
                        yield batch(out, held)
                        held, size = [], 0
            if held:
                yield batch(out, held)

    lines = arrow_map(rows, run, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", records_a_file).text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of an archive; a record that ends early is a ValueError."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        if head < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        lines = data[at:head].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(headers.get("content-length", "0"))
        block = data[head + 4 : head + 4 + size]
        if len(block) < size:
            raise ValueError(f"record at byte {at} is cut short")
        yield headers, block
        at = head + 8 + size


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    framing = any(k.strip().lower() == b"transfer-encoding" and b"chunked" in v.lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:]))
    return unchunked(body) if framing else body


def _decoded(row: dict, block: bytes, with_payload: bool) -> dict:
    try:
        payload = payload_of(block)
    except ValueError as e:
        return row | {"problem": str(e)}
    digest = hashlib.sha256(payload).hexdigest()
    problem = None if row["payload_digest"] in (None, digest) else f"payload has digest {digest}"
    return row | {"payload": payload if with_payload else None, "payload_bytes": len(payload), "payload_digest": digest, "problem": problem}


def assembled(segments: list[tuple[int, int | None, bytes]]) -> tuple[bytes | None, str | None]:
    """(block, None) of segments (number, total length or null, bytes) in order, or (None, what is wrong with them)."""
    numbers = [n for n, _, _ in segments]
    if numbers != list(range(1, len(numbers) + 1)):
        return None, f"segments are {numbers[:20]}"
    block = b"".join(b for _, _, b in segments)
    total = segments[-1][1]
    return (block, None) if total == len(block) else (None, f"segments have {len(block)} bytes of {total}")


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_OUT)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """(page, url, record_type, refers, payload, payload_bytes, payload_digest, problem) of each response and revisit.

    Whole records are decoded where they are read. Segments are dealt by their origin's identifier, sorted by number, put
    together one page at a time, and their total length is verified before the chunked framing is taken off; the digest
    follows from the payload. What cannot be put together or does not have its recorded digest keeps its row, without a
    payload in the first case, and says so in problem. A revisit has the payload that its page has, and a problem if
    there is none with its digest.
    """

    def parse(batches):
        for b in batches:
            for content in b.column(0):
                data = content.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows, size = [], 0
                for h, block in parse_records(data):
                    kind, digest = h.get("warc-type"), (h.get("warc-payload-digest") or "").removeprefix("sha256:") or None
                    row = dict.fromkeys(_OUT.names) | {"page": h.get("x-page-id"), "url": h.get("warc-target-uri"), "record_type": kind, "payload_digest": digest}
                    number = h.get("warc-segment-number")
                    if kind == "revisit":
                        row["refers"] = h.get("x-refers-to-page-id")
                    elif kind not in ("response", "continuation"):
                        continue
                    elif number is None:
                        row = _decoded(row, block, with_payload)
                    else:
                        row |= {"origin": h.get("warc-segment-origin-id") or h.get("warc-record-id"), "segment": int(number), "total": int(x) if (x := h.get("warc-segment-total-length")) else None, "block": block}
                    rows.append(row)
                    size += len(row["block"] or b"") + len(row["payload"] or b"")
                    if size > 1 << 23:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    def together(batches):
        origin, own, first = None, [], None

        def done():
            if first is None:
                return dict.fromkeys(_OUT.names) | {"record_type": "response", "problem": "first segment missing", "origin": origin}
            block, problem = assembled(own)
            return first | {"problem": problem} if problem else _decoded(first, block, with_payload)

        for b in batches:
            for r in b.to_pylist():
                if r["origin"] != origin:
                    if origin is not None:
                        yield _batch([done()])
                    origin, own, first = r["origin"], [], None
                own.append((r["segment"], r["total"], r.pop("block")))
                if r["segment"] == 1:
                    first = r | {"block": None, "segment": None, "total": None}
        if origin is not None:
            yield _batch([done()])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    parsed = stored(arrow_map(files, parse, _OUT_SQL), "records")
    cut = parsed.where("origin is not null").repartition("origin").sortWithinPartitions("origin", "segment")
    columns = _OUT.names[: _OUT.names.index("origin")]
    responses = parsed.where("origin is null").unionByName(arrow_map(cut, together, _OUT_SQL)).select(*columns)
    # one row a page and digest, so that repeated pages do not repeat what refers to them
    held = responses.where("record_type = 'response' and problem is null and page is not null").groupBy(F.col("page").alias("__page"), F.col("payload_digest").alias("__digest"))
    held = held.agg(F.max("payload_bytes").alias("__bytes"), *([F.max("payload").alias("__payload")] if with_payload else []))
    again = responses.where("record_type = 'revisit'").join(held, (F.col("refers") == F.col("__page")) & (F.col("payload_digest") == F.col("__digest")), "left")
    problem = F.when(F.col("__bytes").isNull(), F.lit("no response with this digest"))
    filled = again.withColumns({"payload_bytes": F.col("__bytes"), "problem": problem} | ({"payload": F.col("__payload")} if with_payload else {}))
    return responses.where("record_type = 'response'").unionByName(filled.select(*columns))


def op13_warc(spark, sf_dir: str) -> DataFrame:
    """Per page, from archives that are written and read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null and empty pages have 0 bytes and are responses; for repeated rows and null ids see with_revisits; no pages, no rows.
    """
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = f"{shared_dir(spark)}/tessera-warc-{uuid.uuid4().hex}"
    write_warc(pages, path)
    kind = pages.schema["page_id"].dataType
    return read_warc(spark, path, with_payload=False).select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(kind).alias("refers_to"))


OP13_SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= {LEAST_SHARED} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""
