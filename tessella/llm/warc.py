"""WARC archives: writing, and the normaliser for monolithic gzip files.

Many tools gzip a whole archive as one stream, which can't be entered in the middle. The
normaliser inflates such a stream once, piece by piece, writes every record as a gzip member
of its own, and beside the archive an index of offsets, from which any record is read alone.

Records: a response holds an HTTP header and the payload; a page whose payload another page
has too is a revisit, the HTTP header alone, and names the response (the largest page_id of
that payload). Payloads of under ``min_revisit_bytes`` are always responses.

Files are written through ``pyarrow.fs`` into the shared folder under a name of the attempt and
then moved, so a repeated task replaces a file by an equal one and a lost one leaves none; the
list of files is a written table, so nothing is archived twice.

Defined cases: null html is an empty payload; null url leaves out the target line, line breaks
in it are percent-encoded; of repeated page_ids with an equal payload one row is the response
and the others revisit it; a null page_id is the smallest; without pages there are no archives and the result is empty.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import materialise, scratch_path

DATE = "2024-01-01T00:00:00Z"
INDEX_ROWS = 10_000
PIECE = 1 << 20
INDEX = "path string, offset long, length long, page_id long, record_type string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, intact boolean"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uuid(page: int | None, digest: str) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page}/{digest}"))


def build_record(page: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if revisit else http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{_uuid(page, digest)}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page is not None:
        head.append(f"X-Page-Id: {page}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:uuid:{_uuid(refers_to, digest)}>")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page: {refers_to}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def parse_record(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of one inflated record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = parse_head(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    return fields, parse_head(http), payload


def records_of(stream) -> Iterator[bytes]:
    """Whole records of a gzip stream, whether one member or many, inflated once and in pieces."""
    inflate, ready = zlib.decompressobj(31), bytearray()
    need = -1

    def take() -> Iterator[bytes]:
        nonlocal need
        at = 0
        while True:
            if need < 0:
                end = ready.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                need = end - at + 4 + int(parse_head(bytes(ready[at:end]))["content-length"]) + 4
            if len(ready) - at < need:
                break
            yield bytes(ready[at : at + need])
            at, need = at + need, -1
        del ready[:at]

    while chunk := stream.read(PIECE):
        while chunk:
            ready += inflate.decompress(chunk)
            yield from take()
            chunk = inflate.unused_data
            if inflate.eof and chunk:
                inflate = zlib.decompressobj(31)
    ready += inflate.flush()
    yield from take()
    if ready or need >= 0:
        raise ValueError("the archive ends inside a record")


class SafeFile:
    """A file that has its name only once it is whole."""

    def __init__(self, uri: str):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"

    def __enter__(self):
        self.stream = self.fs.open_output_stream(self.part, compression=None)
        return self.stream

    def __exit__(self, kind, *_):
        self.stream.close()
        if kind is None:
            self.fs.move(self.part, self.path)
        else:
            self.fs.delete_file(self.part)


def open_archive(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def _write_monolithic(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        uri = f"{folder}/raw-{TaskContext.get().partitionId():06d}.warc.gz"
        with SafeFile(uri) as out:
            deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
            while first is not None:
                for i in range(first.num_rows):
                    page, url, html, sha1, size, refers, revisit = (first.column(k)[i].as_py() for k in range(7))
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    out.write(deflate.compress(build_record(page, url, (html or "").encode(), size, digest, refers, revisit)))
                first = next(batches, None)
            out.write(deflate.flush())
        yield pa.RecordBatch.from_pydict({"path": [uri]})

    return run


def archive(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, level: int = 5) -> DataFrame:
    """Write monolithic archives into ``folder``, one a task; returns their paths, a written table.

    Html crosses one shuffle, keyed by payload and page, so a payload that a third of all pages
    share is not one task's; revisits are made from digests and never carry the html.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).cast("long").alias("size"), html.alias("html"))
    shared, short = keyed.where(F.col("size") >= min_revisit_bytes), keyed.where(F.col("size") < min_revisit_bytes)
    small = materialise(shared.drop("html"), "digests")
    firsts = small.groupBy("sha1").agg(F.max("page_id").alias("winner"))
    # Rows of the winning page; of repeated ones the first by url carries the payload.
    nth = F.row_number().over(Window.partitionBy("sha1", "page_id").orderBy("url"))
    known, unknown = firsts.where("winner is not null"), firsts.where("winner is null")
    # Joined by plain equality so that the window needs no second shuffle of the html.
    winning = shared.join(known.select("sha1", F.col("winner").alias("page_id")), ["sha1", "page_id"]).withColumn("again", nth > 1)
    nameless = shared.where("page_id is null").join(unknown.select("sha1"), "sha1").withColumn("again", F.row_number().over(Window.partitionBy("sha1").orderBy("url")) > 1)
    winners = winning.unionByName(nameless).select("page_id", "url", F.when(~F.col("again"), F.col("html")).alias("html"), "sha1", "size", F.when(F.col("again"), F.col("page_id")).alias("refers_to"), F.col("again").alias("revisit"))
    others = (
        small.join(firsts, "sha1").where(~F.col("page_id").eqNullSafe(F.col("winner")))
        .select("page_id", "url", F.lit(None).cast("string").alias("html"), "sha1", "size", F.col("winner").alias("refers_to"), F.lit(True).alias("revisit"))
    )
    alone = short.select("page_id", "url", "html", "sha1", "size", F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit"))
    rows = winners.unionByName(others).unionByName(alone) if min_revisit_bytes > 0 else winners.unionByName(others)
    return materialise(rows.mapInArrow(_write_monolithic(folder, level), "path string"), "archives")


def normalise(paths: DataFrame, level: int = 5) -> DataFrame:
    """Rewrite monolithic archives, one task a file and record by record; returns the index of all records, a written table.

    Beside ``raw-n.warc.gz`` come ``n.warc.gz``, a gzip member for every record, and its
    sidecar ``n.idx``, a JSON line for each: offset, length, page and type.
    """

    names, kinds = ["path", "offset", "length", "page_id", "record_type"], (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())

    def rewritten(uri: str) -> Iterator[tuple]:
        target = uri.replace("/raw-", "/")
        with open_archive(uri) as source, SafeFile(target) as out, SafeFile(target.removesuffix(".warc.gz") + ".idx") as sidecar:
            at = 0
            for record in records_of(source):
                fields = parse_head(record[: record.index(b"\r\n\r\n")])
                deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = deflate.compress(record) + deflate.flush()
                out.write(member)
                page = fields.get("x-page-id")
                page = int(page) if page else None
                sidecar.write((json.dumps({"offset": at, "length": len(member), "page_id": page, "type": fields["warc-type"]}) + "\n").encode())
                yield target, at, len(member), page, fields["warc-type"]
                at += len(member)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows = rewritten(uri)
                while some := list(itertools.islice(rows, INDEX_ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names=names)

    files = max(1, paths.count())
    numbered = paths.select("path", (F.row_number().over(Window.orderBy("path")) - 1).alias("n"))  # one row an archive
    return materialise(numbered.repartitionById(files, "n").select("path").mapInArrow(run, INDEX), "index")


def read_back(index: DataFrame) -> DataFrame:
    """One row per record, each member found by its offset alone and inflated on its own.

    ``intact`` tells that a response's payload has the digest and length it was written with.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stream = None, None
        for batch in batches:
            rows = []
            for path, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if path != name:
                    name, stream = path, open_archive(path)
                stream.seek(offset)
                fields, http, payload = parse_record(zlib.decompress(stream.read(length), 31))
                kind = fields["warc-type"]
                digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
                intact = kind != "response" or (base32_sha1(payload) == digest and len(payload) == size)
                page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page")
                rows.append((int(page) if page else None, size, digest, kind, int(refers) if refers else None, fields.get("warc-target-uri"), intact))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])

    return index.select("path", "offset", "length").mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Archive all pages, normalise the archives and read every record from them."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_back(normalise(archive(pages, folder, min_revisit_bytes)))
