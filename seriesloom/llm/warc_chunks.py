"""WARC archives as tables of chunks: no step holds more of a payload than one chunk.

Writing: a payload becomes records of bounded size, ``response`` first and ``continuation`` records after it, each of one chunk with
its number and the running digest of all chunks so far. A record is a line of Spark's text writer, whose line end is the record's end.
Reading: the text reader splits the archives at record starts, also within a file, and gives one row (record id, chunk number,
bytes) per record. Digests of payloads of several chunks are recomputed over the chunks in order, one chunk at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from seriesloom.llm.shared import in_arrow, stored
from seriesloom.session import shared_dir

_START = "WARC/1.1\r\n"
_END = "\r\n\r\n"
#: What the reader splits at; no chunk may hold it, so chunks also end inside it. Its first byte does not come again before its last: the
#: reader forgets the part of a failed match that lies before its 64 KB buffer, so no other match may begin there.
_MARK = (_END[-1] + _START).encode()
CHUNKS = "record_id string, number long, chunk int, record_type string, uri string, refers_to string, digest string, payload_bytes long, running string, last boolean, data binary"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def cut(payload: memoryview, size: int) -> Iterator[memoryview]:
    """Chunks of at most ``size`` bytes, none of which holds the reader's mark; at least one."""
    at, whole, edge = 0, len(payload), _END.encode()
    while True:
        end = min(at + size, whole)
        found = b"".join((edge, payload[at:end], edge)).find(_MARK)  # as it will stand in the file
        if found >= 0:
            end = at + found + len(_MARK) // 2 - len(edge)
        yield payload[at:end]
        at = end
        if at >= whole:
            return


def record_id(page: int | None) -> str:
    """The page's number as an id; a null id has one of its own."""
    return f"<urn:uuid:{uuid.UUID(int=((page is None) << 64) | ((page or 0) & (1 << 64) - 1))}>"


def page_of(record: str) -> int | None:
    value = int(record[len("<urn:uuid:") : -1].replace("-", ""), 16)
    low = value & (1 << 64) - 1
    return None if value >> 64 & 1 else low - (1 << 64 if low >> 63 else 0)


def record_lines(page: int | None, number: int, uri: str | None, payload: bytes, refers_to: int | None, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page, without the end that the writer adds."""
    own, digest = record_id(page), hashlib.sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = "".join(c for c in uri or "" if c > " " and c != "\x7f")
    common = f"WARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: {uri or 'about:blank'}\r\nWARC-Payload-Digest: sha1:{base32(digest.digest())}\r\nWARC-Row-Number: {number}\r\n"
    if refers_to is not None:
        yield (
            f"{_START}WARC-Type: revisit\r\nWARC-Record-ID: {own}\r\n{common}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
            f"WARC-Refers-To: {record_id(refers_to)}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n"
        ).encode() + http
        return
    running, sent = hashlib.sha1(), 0
    for n, part in enumerate(cut(memoryview(payload), chunk_bytes), 1):
        running.update(part)
        sent += len(part)
        last, block = sent == len(payload), (http if n == 1 else b"") + bytes(part)
        head = f"{_START}WARC-Type: {'response' if n == 1 else 'continuation'}\r\nWARC-Record-ID: {own if n == 1 else f'<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f"{own}/{n}")}>'}\r\n{common}"
        if n > 1:
            head += f"WARC-Segment-Origin-ID: {own}\r\n"
        if n > 1 or not last:
            head += f"WARC-Segment-Number: {n}\r\n" + (f"WARC-Segment-Total-Length: {len(http) + sent}\r\n" if last else "")
        head += f"WARC-Running-Digest: sha1:{base32(running.digest())}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
        yield head.encode() + block


def first_copies(pages: DataFrame, page: str, payload: str, least: int) -> DataFrame:
    """(digest, first): payload digests of at least ``least`` bytes that occur more than once, with their smallest page."""
    rows = pages.select(F.col(page).alias("page"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("body"))
    rows = rows.select("page", F.sha1("body").alias("digest"), F.octet_length("body").alias("n"))
    return rows.where(F.col("n") >= least).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")


def write_archives(pages: DataFrame, page: str = "page_id", uri: str = "url", payload: str = "html", least: int = 0, chunk_bytes: int = 1 << 18) -> str:
    """Write one WARC record per row, which carries the number of its row (several where the payload outgrows a chunk) and give the folder.

    Rows whose payload, of ``least`` bytes or more, also belongs to a smaller page become revisits of the smallest; rows with that page's id are
    responses, repeated rows too. A null payload is empty. A null id is a page of its own that is never referred to unless all
    copies have null ids, which are then responses. A null address is written as about:blank. An empty table gives an empty folder.
    """
    spark = pages.sparkSession
    # written first, so that its size tells the planner whether it can be broadcast; pages are then not shuffled
    first = stored(first_copies(pages, page, payload, least), "first").withColumnsRenamed({"digest": "of", "first": "first_page"})
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page).alias("page"), F.col(uri).alias("uri"), body.alias("body"))
    rows = rows.join(first, F.sha1("body") == F.col("of"), "left").select("page", "uri", "body", F.when(~F.col("page").eqNullSafe(F.col("first_page")), F.col("first_page")).alias("refers_to"), F.monotonically_increasing_id().alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, uris, bodies, refers, numbers = batch.columns
            held, size = [], 0
            for i in range(len(batch)):
                for line in record_lines(ids[i].as_py(), numbers[i].as_py(), uris[i].as_py(), bodies[i].as_py(), refers[i].as_py(), chunk_bytes):
                    held.append(line)
                    size += len(line)
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])

    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    # the writer takes strings, and writes their bytes as they are
    in_arrow(rows, run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", _END).text(folder)
    return folder


def _parsed(line: bytes) -> dict:
    """One row of CHUNKS from a record; the record may have lost its start mark to the reader."""
    head, _, block = line.removeprefix(_START.encode()).partition(_END.encode())
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n"))
    block = block[: int(fields["Content-Length"])]
    kind, n = fields["WARC-Type"], int(fields.get("WARC-Segment-Number", 1))
    total = None
    if n == 1:
        http, _, block = block.partition(_END.encode())
        total = int(http.rpartition(b"Content-Length: ")[2])
    refers = fields.get("WARC-Refers-To")
    return {
        "record_id": fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"]), "number": int(fields["WARC-Row-Number"]), "chunk": n, "record_type": None if kind == "continuation" else kind, "uri": fields["WARC-Target-URI"], "refers_to": refers,
        "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": total, "running": fields.get("WARC-Running-Digest", "").removeprefix("sha1:") or None,
        "last": kind == "revisit" or "WARC-Segment-Number" not in fields or "WARC-Segment-Total-Length" in fields, "data": None if kind == "revisit" else block,
    }


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of CHUNKS of all archives in a folder; a revisit is one chunk without data."""
    kind = pa.schema([("record_id", pa.string()), ("number", pa.int64()), ("chunk", pa.int32()), ("record_type", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("running", pa.string()), ("last", pa.bool_()), ("data", pa.binary())])
    lines = spark.read.option("lineSep", _MARK.decode()).text(folder).select(F.col("value").cast("binary").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0)
            rows = [_parsed(v) for v in (values[i].as_py() for i in range(len(values))) if v.strip()]
            yield pa.RecordBatch.from_pylist(rows, kind)

    return in_arrow(lines, run, CHUNKS)


RECORDS = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("record_type", T.StringType()), T.StructField("uri", T.StringType()),
    T.StructField("refers_to", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("chunks", T.IntegerType()), T.StructField("intact", T.BooleanType()),
])


def records(chunks: DataFrame) -> DataFrame:
    """One row per page of an archive; ``intact`` tells whether the bytes read have the digests and length that the headers state.

    Payloads of one chunk are checked where they are read. Only chunks of longer ones are shuffled, by record, and pass the digest one
    by one. A revisit carries no payload and counts as intact.
    """
    names = RECORDS.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest, size, n, good = None, hashlib.sha1(), 0, 0, True
        for batch in batches:
            out = []
            columns = {c: batch.column(c) for c in batch.schema.names}
            for i in range(len(batch)):
                row = {c: x[i].as_py() for c, x in columns.items()}
                if row["chunk"] == 1 or head is None or (head["record_id"], head["number"]) != (row["record_id"], row["number"]):
                    head, digest, size, n, good = row, hashlib.sha1(), 0, 0, row["chunk"] == 1
                n += 1
                if row["data"] is not None:
                    digest.update(row["data"])
                    size += len(row["data"])
                    good &= base32(digest.digest()) == row["running"] and row["chunk"] == n
                if row["last"]:
                    if row["data"] is not None:
                        good &= size == head["payload_bytes"] and row["running"] == head["digest"]
                    refers = head["refers_to"]
                    out.append([head["record_id"], page_of(head["record_id"]), head["record_type"], head["uri"], None if refers is None else page_of(refers), head["digest"], head["payload_bytes"], n, bool(good)])
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(names), kinds)], names)

    single = F.col("last") & (F.col("chunk") == 1)
    long = chunks.where(~single).repartition("record_id", "number").sortWithinPartitions("record_id", "number", "chunk")
    return in_arrow(chunks.where(single), run, RECORDS).unionByName(in_arrow(long, run, RECORDS))
