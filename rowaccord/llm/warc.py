"""WARC archives: writing records, normalising monolithic gzip files, and reading by an offset index.

Spark's text writer makes each archive one gzip stream over many records, as many tools do; no record in it can be
reached without inflating all before it. The normaliser inflates each such stream once, from its first byte to its
last, writes every record again as a gzip member of its own, and keeps a sidecar index with the offset and length of
each member. Reading then opens any record by itself, and the records of one archive can be dealt to many tasks.

Payloads that several records share are stored once: the others are revisits that name the stored one.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowaccord.functions.storage import new_path

CRLF = "\r\n"
#: Records in one archive at most; an archive is read by one task when it is normalised.
RECORDS_PER_FILE = 5000
#: Records that one task reads in a row.
RECORDS_PER_READ = 500
URN = "urn:page:"
STEP = 1 << 20
# Digits of base 32 as Java counts, and as RFC 4648 writes them.
DIGITS, RFC4648 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


# ---- writing ---------------------------------------------------------------------------


def payload_digest(text: Column) -> Column:
    """Base 32 of the SHA-1 of the text's UTF-8 bytes, eight digits for each forty bits."""
    sha = F.sha1(text.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(sha, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), DIGITS, RFC4648)


def with_roles(rows: DataFrame, least_bytes: int) -> DataFrame:
    """Add ``response``: the largest id among equal payloads of at least ``least_bytes``, null where there is one only."""
    groups = rows.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("id").alias("response"), F.count("*").alias("n"))
    return rows.join(groups.where("n > 1").drop("n"), "digest", "left")


def record(url: str = "url", date: str = "date") -> Column:
    """The text of one WARC record without the line end that closes it."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise("")
    revisit = F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response"))
    urn = lambda c: F.concat(F.lit(f"<{URN}"), c.cast("string"), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit(CRLF),
        line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Target-URI", F.regexp_replace(F.col(url), r"[\x00-\x20\x7F]", "%20")),
        line("WARC-Date", F.col(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Refers-To", F.when(revisit, urn(F.col("response")))),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
        F.lit(CRLF),
    )


def write_monolithic(
    pages: DataFrame,
    folder: str,
    least_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> str:
    """Write one record per row into gzip files of many records each; returns ``folder``.

    The payload is the HTML in UTF-8, null as the empty one. Of equal payloads of at least ``least_bytes`` bytes
    the row with the largest id is the response and others revisit it; repeated rows of that id are all responses.
    A null id has no record id and revisits, or responds where its payload is the only one.
    """
    payload = F.coalesce(pages[html_col].cast("string"), F.lit(""))
    rows = pages.select(pages[id_col].cast("bigint").alias("id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", payload_digest(F.col("payload"))).withColumn("bytes", F.octet_length("payload").cast("bigint"))
    text = with_roles(rows, least_bytes).withColumn("date", F.lit(date)).select(record().alias("value"))
    text.write.option("compression", "gzip").option("lineSep", CRLF).option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)
    return folder


# ---- records in bytes ------------------------------------------------------------------


def inflated(data: bytes) -> Iterator[bytes]:
    """The contents of a gzip file of any number of members, a piece at a time."""
    view = memoryview(data)
    while len(view):
        stream, used = zlib.decompressobj(31), 0
        while used < len(view) and not stream.eof:
            chunk = view[used : used + STEP]
            used += len(chunk)
            yield stream.decompress(chunk, STEP)
            # At the end of a member the tail is what follows it, which belongs to the next one.
            while not stream.eof and stream.unconsumed_tail:
                yield stream.decompress(stream.unconsumed_tail, STEP)
        while not stream.eof and (rest := stream.decompress(b"", STEP)):
            yield rest
        if not stream.eof:
            raise ValueError("a gzip stream ends too early")
        view = view[used - len(stream.unused_data) :]


def header_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split(CRLF)[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and the bytes of each record, the closing line ends included; holds one record at a time."""
    buffer, ended = bytearray(), False

    def more() -> bool:
        nonlocal ended
        piece = next(pieces, None)
        ended = piece is None
        if not ended:
            buffer.extend(piece)
        return not ended

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer.strip():
                    raise ValueError("a WARC record ends within its header")
                return
        fields = header_fields(bytes(buffer[:end]))
        size = end + 4 + int(fields["content-length"]) + 4
        while len(buffer) < size:
            if not more():
                raise ValueError("a WARC record ends within its block")
        yield fields, bytes(buffer[:size])
        del buffer[:size]


def payload_of(record_bytes: bytes) -> bytes:
    """The payload of a response: what follows the header of its HTTP message."""
    block = record_bytes[record_bytes.index(b"\r\n\r\n") + 4 : -4]
    return block[block.index(b"\r\n\r\n") + 4 :]


# ---- normalising -----------------------------------------------------------------------


@functools.lru_cache(maxsize=16)
def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    """A file system that tasks can write, for a folder given as a path or as a URI."""
    return fs.FileSystem.from_uri(folder) if "://" in folder else fs.FileSystem.from_uri(f"file://{folder}")


def _as_uri(folder: str) -> str:
    return folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder


def normalise(spark: SparkSession, source: str, target: str, level: int = 6) -> DataFrame:
    """Rewrite the gzip files in ``source`` record by record; returns the index as a table.

    ``target`` gets for each file one archive in which every record is its own gzip member, and beside it
    ``<archive>.idx.json`` with a line per member. Both are written under another name and renamed when whole, so a
    task that runs again after a lost executor replaces equal files. ``target`` must be a folder that all machines
    share. Empty folders give an empty index. Spark's reader holds one compressed file at a time in memory.
    """
    target = _as_uri(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _filesystem(target)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                name = posixpath.basename(path).removesuffix(".gz").removesuffix(".txt") + ".warc.gz"
                attempt = f"{folder}/.{name}-{uuid.uuid4().hex}"
                offset, lines = 0, []
                with system.open_output_stream(attempt, compression=None) as out:
                    for fields, data in split_records(inflated(content.as_buffer().to_pybytes())):
                        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = packer.compress(data) + packer.flush()
                        out.write(member)
                        lines.append({"archive": name, "n": len(lines), "offset": offset, "length": len(member), "type": fields.get("warc-type"), "record": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest")})
                        offset += len(member)
                with system.open_output_stream(f"{attempt}.idx", compression=None) as out:
                    out.write("".join(json.dumps(x) + "\n" for x in lines).encode())
                system.move(attempt, f"{folder}/{name}")
                system.move(f"{attempt}.idx", f"{folder}/{name}.idx.json")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(lines)], pa.int64()), pa.array([offset], pa.int64())], names=["archive", "records", "bytes"])

    system, folder = _filesystem(target)
    system.create_dir(folder, recursive=True)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path", "content")
    made = files.mapInArrow(run, "archive string, records bigint, bytes bigint")
    # The manifest is written, so that the files are made once.
    made.write.parquet(f"{target}/_manifest")
    return read_index(spark, target)


INDEX = "archive string, n bigint, offset bigint, length bigint, type string, record string, uri string, digest string"


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, n, offset, length, type, record, uri, digest) of every record in a normalised folder."""
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.idx.json").json(folder)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """One row (page_id, url, type, refers_to, payload_bytes, payload_digest, payload) per indexed record.

    Each record is opened by its offset. A response's payload is digested again and must agree with its header;
    a revisit has a null payload and the length and digest that its header gives for the full one.
    """
    folder = _as_uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _filesystem(folder)
        name, archive = None, None
        for batch in batches:
            rows = []
            for own, offset, length in sorted(zip(*(c.to_pylist() for c in batch.columns))):
                if own != name:
                    if archive is not None:
                        archive.close()
                    name, archive = own, system.open_input_file(f"{base}/{own}")
                archive.seek(offset)
                rows.append(_row(zlib.decompress(archive.read(length), 31)))
                if len(rows) == RECORDS_PER_READ:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ROW)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ROW)

    # A fixed number of tasks, since the index says nothing about the size of what it points to.
    tasks = max(1, min(20_000, -(-index.count() // (4 * RECORDS_PER_READ))))
    block = F.floor(F.col("n") / RECORDS_PER_READ)
    dealt = index.select("archive", "offset", "length", "n").repartition(tasks, "archive", block).select("archive", "offset", "length")
    return dealt.mapInArrow(run, "page_id bigint, url string, type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary")


_ROW = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
)


def _id(urn: str | None) -> int | None:
    return int(urn.strip("<>").removeprefix(URN)) if urn else None


def _row(data: bytes) -> dict:
    head = data.index(b"\r\n\r\n")
    fields = header_fields(data[:head])
    http = header_fields(data[head + 4 : data.index(b"\r\n\r\n", head + 4)])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    size, payload = int(http["content-length"]), None
    if fields["warc-type"] == "response":
        payload = payload_of(data)
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if len(payload) != size or found != digest:
            raise ValueError(f"the payload of {fields.get('warc-record-id')} is damaged")
    return {
        "page_id": _id(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "type": fields["warc-type"],
        "refers_to": _id(fields.get("warc-refers-to")),
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": payload,
    }


def archived(pages: DataFrame, least_bytes: int = 0, **columns: str) -> DataFrame:
    """Write the pages as archives in the shared folder, normalise them, and read all records back."""
    spark = pages.sparkSession
    mixed, single = new_path(spark, "llm-warc-mixed"), new_path(spark, "llm-warc")
    write_monolithic(pages, mixed, least_bytes, **columns)
    return read_records(normalise(spark, mixed, single), single)
