"""WARC archives: writing, normalising whole-file gzip streams into one member per record with an index, reading back.

Spark writes the records of each partition as one gzip stream. The normaliser inflates such a stream once, front to
back, rewrites every record as a gzip member of its own and writes a sidecar index of the members beside the archive.
Readers then inflate single members at the offsets of the index.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

#: Payloads from this many bytes on may be revisits of an equal one.
LEAST_REVISIT_BYTES = 100
#: Records of one archive, which is read as a stream whatever its bytes, and distinct repeated payloads that are sent to
#: every executor; more are joined by a shuffle.
MAX_RECORDS_PER_FILE = 20_000
MAX_BROADCAST_PAYLOADS = 200_000
CHUNK = 1 << 20
_END = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """page_id, record: the WARC record of every page without its closing blank lines.

    pages has page_id, url and html. Null html is an empty payload, a null url an empty target. Of equal payloads of
    LEAST_REVISIT_BYTES and more, the one with the smallest page_id (all of them, if that id repeats) is a response,
    the others are revisits that name it and hold no payload. Payloads whose page_ids are all null are responses.
    """
    shared_dir(pages.sparkSession)  # the checkpoint needs it
    full = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns({"digest": F.sha2("html", 256), "n": F.octet_length("html")})
    repeated = full.where(F.col("n") >= LEAST_REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("times")).where("times > 1").select("digest", "first_id").checkpoint()
    small = repeated.limit(MAX_BROADCAST_PAYLOADS + 1).count() <= MAX_BROADCAST_PAYLOADS
    typed = full.join(F.broadcast(repeated) if small else repeated, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    block = F.concat(F.lit(_HTTP), F.when(revisit, "").otherwise(F.col("html")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    return typed.select(
        "page_id",
        F.concat(
            F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), text(F.col("page_id")), F.lit(">"))),
            line("WARC-Date", F.lit(date)), line("WARC-Target-URI", F.regexp_replace(text(F.col("url")), r"[\r\n]+", " ")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), line("WARC-Payload-Length", F.col("n").cast("string")),
            F.when(revisit, F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), text(F.col("first_id")), F.lit(">"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
            line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")),
            F.lit("\r\n"), block,
        ).alias("record"),
    )


def write_streams(df: DataFrame, path: str) -> None:
    """Each partition's records as whole gzip streams under path, a stream for every MAX_RECORDS_PER_FILE of them."""
    df.select(F.col("record").alias("value")).write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).text(path)


class _Stream:
    """Reads a gzip stream of one or more members front to back, holding little more than a chunk of it."""

    def __init__(self, source):
        self.source, self.rest, self.held, self.inflate = source, b"", bytearray(), zlib.decompressobj(31)

    def more(self) -> bool:
        while True:
            if self.inflate.eof:
                self.rest = self.inflate.unused_data or self.source.read(CHUNK)
                if not self.rest:
                    return False
                self.inflate = zlib.decompressobj(31)
            given, self.rest = self.inflate.unconsumed_tail or self.rest or self.source.read(CHUNK), b""
            if not given:
                return False
            if out := self.inflate.decompress(given, CHUNK):
                self.held += out
                return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (k := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                if self.held.strip():
                    raise ValueError("a WARC header without its end")
                return None
        head = bytes(self.held[: k + len(mark)])
        del self.held[: k + len(mark)]
        return head

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise ValueError("a WARC record shorter than its Content-Length")
            part = bytes(self.held[:n])
            del self.held[: len(part)]
            n -= len(part)
            yield part


def members(stream) -> Iterator[Iterable[bytes]]:
    """For each record of a whole-file gzip stream (an open file or bytes), the parts of its own gzip member."""
    source = _Stream(stream if hasattr(stream, "read") else io.BytesIO(stream))
    while (head := source.until(b"\r\n\r\n")) is not None:
        length = int(re.search(rb"(?im)^Content-Length:[ ]*([0-9]+)", head)[1])

        def parts(head=head, length=length):
            deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
            yield deflate.compress(head)
            for part in source.exactly(length + len(_END)):
                yield deflate.compress(part)
            yield deflate.flush()

        yield parts()


def normalise(streams: DataFrame, out: str) -> DataFrame:
    """Rewrite every whole-file stream (path) under out; archive, records and bytes of each. A stream is read in chunks.

    An archive and its index get their names by a move once they are complete, so a repeated task does no harm.
    """
    schema = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(out)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                name = hashlib.sha256(source.encode()).hexdigest()[:32]
                draft = f"{base}/.{name}-{uuid.uuid4().hex}"
                at, count = 0, 0
                own, path = pafs.FileSystem.from_uri(source if "://" in source else "file://" + source.removeprefix("file:"))
                with own.open_input_stream(path, compression=None) as stream, fs.open_output_stream(f"{draft}.warc") as archive, fs.open_output_stream(f"{draft}.idx") as index:
                    for member in members(stream):
                        start = at
                        for part in member:
                            archive.write(part)
                            at += len(part)
                        index.write((json.dumps({"archive": f"{name}.warc.gz", "offset": start, "length": at - start}) + "\n").encode())
                        count += 1
                fs.move(f"{draft}.idx", f"{base}/{name}.idx")
                fs.move(f"{draft}.warc", f"{base}/{name}.warc.gz")
                yield pa.RecordBatch.from_pylist([{"archive": f"{name}.warc.gz", "records": count, "bytes": at}], schema=schema)

    return streams.select("path").mapInArrow(run, "archive string, records bigint, bytes bigint")


def parse_member(member: bytes) -> dict:
    """What a member's record says: page_id, payload_bytes, payload_digest, record_type, refers_to, payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    number = lambda key: int(m[1]) if (m := re.search(r"<urn:page:(-?\d+)>", fields.get(key, ""))) else None
    kind = fields["warc-type"]
    if kind == "response":
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if (size, f"sha256:{digest}") != (int(fields["warc-payload-length"]), fields["warc-payload-digest"]):
            raise ValueError(f"the payload of {fields['warc-record-id']} is not the one its header tells of")
    else:
        size, digest = int(fields["warc-payload-length"]), fields["warc-payload-digest"].removeprefix("sha256:")
    return {"page_id": number("warc-record-id"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("warc-refers-to"), "payload": payload}


READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_archives(index: DataFrame, out: str) -> DataFrame:
    """Every record at the offsets of the index (archive, offset, length), each inflated by itself."""
    names = [c.split()[0] for c in READ.split(", ")]
    schema = pa.schema([(n, pa.string() if n in ("payload_digest", "record_type") else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(out)
        name, archive = None, None
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if row["archive"] != name:
                    if archive is not None:
                        archive.close()
                    name, archive = row["archive"], fs.open_input_file(f"{base}/{row['archive']}")
                record = parse_member(archive.read_at(row["length"], row["offset"]))
                found.append({n: record[n] for n in names})
            yield pa.RecordBatch.from_pylist(found, schema=schema)
        if archive is not None:
            archive.close()

    return index.select("archive", "offset", "length").mapInArrow(run, READ)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write every page into archives in the shared folder and read them back; see records. No pages, no records."""
    spark = pages.sparkSession
    root = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    if "://" not in root:
        root = "file://" + root.removeprefix("file:")
    write_streams(records(pages), f"{root}/streams")
    streams = spark.read.schema("path string, modificationTime timestamp, length bigint, content binary").format("binaryFile").option("pathGlobFilter", "*.gz").load(f"{root}/streams")
    counts = normalise(streams, f"{root}/archives")
    counts.agg(F.sum("records")).collect()  # runs the normaliser
    index = spark.read.schema("archive string, offset bigint, length bigint").option("pathGlobFilter", "*.idx").json(f"{root}/archives")
    return read_archives(index, f"{root}/archives")
