"""WARC archives: writing with revisits and segments, reading with reassembly (operator 6).

`write` turns rows of (id, url, payload) into WARC/1.1 records. Of rows with equal payloads of at
least `least_revisit` bytes the one with the largest id is a response and the others are revisits
without payload. The payload travels as an HTTP response with chunked transfer framing. A block of
more than `segment_bytes` is split: the first segment is the response, the others are continuation
records with the identifier of the first and a segment number, the last with the total length.
Records go through Spark's text writer, whose line separator is the separator of WARC records, so
any store works, tasks can be retried, and no file exceeds `records_per_file` records.

`read` parses the archives record by record. Continuations are grouped by the identifier of their
origin, ordered by segment number, checked for gaps and for the total length, and joined; then the
transfer framing is decoded and the payload digest is computed anew and compared.

Equal payloads may be a third of all rows: their class is a partial aggregate of digests, and it
meets the rows under a salt, so no task gets all copies.

Defined results: a null payload is empty; a null id stays null and is never the target of a revisit;
rows with one id and equal payloads are all responses if that id is the largest; an empty table
gives an archive without records and no rows; a truncated or inconsistent record is returned with
`problem` set and without payload; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow

CRLF = b"\r\n"
RECORD_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = (
    "source_id string, record_type string, record_id string, uri string, payload_digest string, payload_length long, "
    "refers_to string, segment int, total_length long, block binary, problem string"
)
RESULT = "source_id string, record_type string, record_id string, uri string, payload binary, payload_bytes long, payload_digest string, refers_to string, segments int, problem string"


def chunked(body: bytes, size: int) -> bytes:
    """Chunked transfer framing."""
    out = []
    for at in range(0, len(body), size):
        part = body[at : at + size]
        out += [f"{len(part):x}".encode(), CRLF, part, CRLF]
    return b"".join([*out, b"0", CRLF, CRLF])


def dechunk(body: bytes) -> bytes:
    """The body behind chunked transfer framing; chunk extensions and trailers are allowed. Raises ValueError on broken framing."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            raise ValueError("chunk size is missing")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if size < 0 or body[at + size : at + size + 2] != CRLF:
            raise ValueError("chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the separator behind it."""
    lines = [b"WARC/1.1"] + [f"{k}: {v}".encode() for k, v in headers if v is not None] + [f"Content-Length: {len(block)}".encode()]
    return CRLF.join(lines) + CRLF + CRLF + block


def _clean(value: str | None) -> str | None:
    return None if value is None else " ".join(value.split())


def _records(row: dict, unique: str, segment_bytes: int, chunk_bytes: int, date: str) -> Iterator[bytes]:
    payload = row["payload"] or b""
    name = lambda k: f"<urn:uuid:{uuid.UUID(hashlib.sha1(f'{unique}/{k}'.encode()).hexdigest()[:32])}>"
    common = [("WARC-Date", date), ("WARC-Target-URI", _clean(row["url"])), ("WARC-Source-ID", row["id"])]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    about = [("WARC-Payload-Digest", f"sha1:{row['digest']}"), ("WARC-Source-Payload-Length", len(payload)), ("Content-Type", "application/http; msgtype=response")]
    if row["target"] is not None:
        refers = [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", _clean(row["target_url"])), ("WARC-Source-Refers-To", row["target"])]
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", name(1)), *common, *about, *refers], http)
        return
    block = http + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield record([("WARC-Type", "response"), ("WARC-Record-ID", name(1)), *common, *about], block)
        return
    cuts = range(0, len(block), segment_bytes)
    for k, at in enumerate(cuts, 1):
        part = block[at : at + segment_bytes]
        if k == 1:
            yield record([("WARC-Type", "response"), ("WARC-Record-ID", name(1)), *common, *about, ("WARC-Segment-Number", 1)], part)
        else:
            total = len(block) if k == len(cuts) else None
            yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", name(k)), *common, ("WARC-Segment-Origin-ID", name(1)), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total)], part)


def write(
    pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit: int = 1000,
    segment_bytes: int = 8192, chunk_bytes: int = 4096, records_per_file: int = 4000, salts: int = 16, date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Write the rows as gzipped WARC files into the folder `path`."""
    rows = pages.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit("").cast("binary")).alias("payload")
    ).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    classes = rows.where(F.col("size") >= least_revisit).groupBy("digest", "size").agg(F.max(F.when(F.col("id").isNotNull(), F.struct("id", "url"))).alias("target"), F.count(F.lit(1)).alias("n"))
    classes = classes.where((F.col("n") > 1) & F.col("target").isNotNull()).drop("n").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(classes, ["digest", "size", "salt"], "left")
    again = ~F.col("target.id").eqNullSafe(F.col("id"))
    rows = rows.select(
        F.col("id").cast("string").alias("id"), "url", "payload", "digest",
        F.when(F.col("target").isNotNull() & again, F.col("target.id")).cast("string").alias("target"), F.col("target.url").alias("target_url"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            made, size = [], 0
            for row in batch.to_pylist():
                for r in _records(row, f"{row['id']}/{row['digest']}/{part}/{n}", segment_bytes, chunk_bytes, date):
                    made.append(r)
                    size += len(r)
                n += 1
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])
                    made, size = [], 0
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])

    out = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("record"))
    out.write.mode("overwrite").option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse(data: bytes) -> Iterator[dict]:
    """Records of an archive file; the rest of a damaged file is one record with `problem`."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == CRLF:
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        try:
            if data[at : at + 5] != b"WARC/" or end < 0:
                raise ValueError("no record header")
            lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            size = int(head["content-length"])
            block = data[end + 4 : end + 4 + size]
            if size < 0 or len(block) < size:
                raise ValueError("block is cut short")
            number = lambda k: int(head[k]) if k in head else None
            found = {
                "source_id": head.get("warc-source-id"), "record_type": head["warc-type"], "record_id": head.get("warc-segment-origin-id") or head["warc-record-id"], "uri": head.get("warc-target-uri"),
                "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None, "payload_length": number("warc-source-payload-length"), "refers_to": head.get("warc-source-refers-to"),
                "segment": number("warc-segment-number"), "total_length": number("warc-segment-total-length"), "block": block, "problem": None,
            }
        except (KeyError, ValueError) as e:
            yield dict.fromkeys(("source_id", "record_id", "uri", "payload_digest", "payload_length", "refers_to", "segment", "total_length", "block")) | {"record_type": "damaged", "problem": str(e)}
            return
        yield found
        at = end + 4 + size


def join_segments(parts: list[dict]) -> tuple[bytes, str | None]:
    """Blocks in the order of their segment numbers, and what is wrong with them."""
    parts = sorted(parts, key=lambda p: p["segment"])
    block = b"".join(p["block"] for p in parts)
    total = parts[-1]["total_length"]
    if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
        return block, "segments are missing or repeated"
    if total is None:
        return block, "the last segment is missing"
    if total != len(block):
        return block, f"total length is {len(block)} instead of {total}"
    return block, None


def payload_of(block: bytes) -> bytes:
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("no HTTP header")
    names = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:])}
    return dechunk(body) if names.get(b"transfer-encoding") == b"chunked" else body


def finish(first: dict, block: bytes | None, segments: int, problem: str | None) -> dict:
    """The result of a record from its joined block."""
    out = {k: first[k] for k in ("source_id", "record_type", "record_id", "uri", "refers_to")} | {"segments": segments, "payload": None, "payload_bytes": first["payload_length"], "payload_digest": first["payload_digest"], "problem": problem}
    if problem is None and first["record_type"] == "response":
        try:
            payload = payload_of(block)
            digest = hashlib.sha1(payload).hexdigest()
            if first["payload_digest"] not in (None, digest):
                raise ValueError("digest differs")
            out |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest}
        except ValueError as e:
            out["problem"] = str(e)
    return out


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each response and revisit of the archives in the folder `path`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields, result = (to_arrow_schema(_parse_datatype_string(s)) for s in (FIELDS, RESULT))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def records(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for content in batch.column(0):
            rows, size = [], 0
            for r in parse(gzip.decompress(content.as_py())):
                rows.append(r)
                size += len(r["block"] or b"")
                if size > 8 << 20:
                    yield _batch(rows, fields)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, fields)

    def whole(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield _batch([finish(r, r["block"], 1, r["problem"]) for r in batch.to_pylist()], result)

    def joined(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, 256):
            out = []
            for row in batch.slice(at, 256).to_pylist():
                parts = row["parts"]
                block, problem = join_segments(parts)
                out.append(finish(min(parts, key=lambda p: p["segment"]), block, len(parts), problem))
            yield _batch(out, result)

    found = in_arrow(files, records, FIELDS)
    single = in_arrow(found.where(F.col("segment").isNull()), whole, RESULT)
    parts = found.where(F.col("segment").isNotNull()).groupBy("record_id").agg(F.collect_list(F.struct(*[f.name for f in fields])).alias("parts"))
    return single.unionByName(in_arrow(parts.select("parts"), joined, RESULT))
