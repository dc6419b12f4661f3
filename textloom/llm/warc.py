"""WARC archives: an index of offset, length, URL and digest per record, then coalesced reads of byte ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shared_dir

#: A new archive begins at FILE_BYTES; ranges are read together if they are at most GAP apart, up to RUN bytes.
FILE_BYTES, GAP, RUN = 1 << 30, 1 << 16, 1 << 23
#: Archives are read in pieces of about PIECE bytes, and a task gets about two of them.
PIECE = 1 << 26
DATE = "1970-01-01T00:00:00Z"
INDEX = "page_id long, url string, digest string, record_type string, file string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column."""
    sha = F.sha1(payload)
    letters = []
    for group in range(4):
        bits = F.conv(F.substring(sha, 10 * group + 1, 10), 16, 10).cast("long")
        letters += [F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), (F.shiftright(bits, 35 - 5 * i).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for i in range(8)]
    return F.concat(*letters)


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, length: int) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        out, name, offset = None, "", 0
        try:
            for batch in (whole.slice(lo, 100) for whole in batches for lo in range(0, len(whole), 100)):
                rows = []
                for r in batch.to_pylist():
                    if out is None or offset >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        # a task that runs again writes files of its own; the index names those of the one that counted
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{base}/{name}", compression=None)
                    payload = r["payload"] or b""
                    member = gzip.compress(_record(r["page_id"], r["url"], payload, r["digest"], r["refers_to"], r["record_type"] == "revisit", r["n"]), 1, mtime=0)
                    out.write(member)
                    rows.append((r["page_id"], r["url"], r["digest"], r["record_type"], name, offset, len(member)))
                    offset += len(member)
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate([pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()])], names=["page_id", "url", "digest", "record_type", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str, scratch: Scratch, least_bytes: int = 0, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record per page into gzip archives below folder (a URI that pyarrow can write), and gives their index.

    Of equal payloads of at least least_bytes, that of the largest page_id is a response and the others revisit it;
    rows that share this page_id are all responses, and without any id all are. Smaller payloads are all responses.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": payload_digest(F.col("payload")), "n": F.octet_length("payload")})
    # the digests of single pages stay out, so that the join meets copies only
    first = rows.filter(F.col("n") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("copies")).filter("copies > 1").select(F.col("digest").alias("same"), "top")
    first = scratch.keep(first)
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")) & (F.col("n") >= least_bytes)
    typed = rows.join(first, rows.digest == first.same, "left").select("page_id", "url", F.when(revisit, None).otherwise(F.col("payload")).alias("payload"), "digest", "n", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("top")).alias("refers_to"))
    return scratch.keep(typed.mapInArrow(_write(folder), INDEX))


def parse_record(member: bytes) -> dict:
    """Fields of one gzip member. A response's length and digest are taken from its payload; a digest that differs from
    the header's raises ValueError."""
    data = zlib.decompress(member, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    out = {"page_id": int(fields["X-Page-Id"]) if "X-Page-Id" in fields else None, "url": fields.get("WARC-Target-URI"), "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": None, "payload": None}
    if fields["WARC-Type"] == "revisit":
        out |= {"payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]), "refers_to": int(fields["X-Refers-To-Page-Id"])}
    else:
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} has another digest")
        out |= {"payload_bytes": len(payload), "payload": payload}
    return out


def _runs(rows: Iterator[tuple[str, int, int]]) -> Iterator[list[tuple[str, int, int]]]:
    """Neighbours in one file, together as long as the gaps are small and the run is short."""
    run: list[tuple[str, int, int]] = []
    for row in rows:
        if run and (row[0] != run[0][0] or row[1] - run[-1][1] - run[-1][2] > GAP or row[1] + row[2] - run[0][1] > RUN):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def _read(folder: str, with_payload: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        types = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
        rows = ((f, o, n) for b in batches for f, o, n in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
        name, source = None, None
        for part in _runs(rows):
            if part[0][0] != name:
                if source is not None:
                    source.close()
                name = part[0][0]
                source = system.open_input_file(f"{base}/{name}")
            first = part[0][1]
            data = source.read_at(part[-1][1] + part[-1][2] - first, first)
            found = [parse_record(data[o - first : o - first + n]) for _, o, n in part]
            if not with_payload:
                for x in found:
                    x["payload"] = None
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], t) for c, t in types.items()], names=list(types))
        if source is not None:
            source.close()

    return run


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records that the rows of index name, by reads of their byte ranges alone: sorted by file and offset, and
    near ones together.

    A record belongs to the piece of its file in which it starts. Pieces are dealt out to as many tasks as the bytes of
    the selected records ask for, so a task reads about 2 * PIECE bytes, however many records that are.
    """
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-size // (2 * PIECE)))
    piece = F.floor(F.col("offset") / min(PIECE, max(1, size // tasks)))
    ranges = index.select("file", "offset", "length").repartition(int(tasks), "file", piece).sortWithinPartitions("file", "offset")
    return ranges.mapInArrow(_read(folder, with_payload), RECORD)


def archive_report(pages: DataFrame) -> DataFrame:
    """Writes all pages as archives, reads them back; page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload; a null url leaves out its header; an empty table writes nothing.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    index = write_archives(pages, folder, scratch)
    return read_records(index, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
