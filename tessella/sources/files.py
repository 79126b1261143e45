"""Uploaded files: bytes to text, sheets and images.

Files are read by Spark's own readers, so any store it knows will do. The functions that open a
format are small helpers on one file's bytes; a damaged file gives an empty result, not an error.
"""

from __future__ import annotations

import csv
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text

SPACE_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Embedded JPEGs of fewer bytes are decoration.
LEAST_JPEG = 8192
#: What a damaged, encrypted or strange archive raises; no error of the job.
DAMAGED = (zipfile.BadZipFile, zlib.error, KeyError, ElementTree.ParseError, ValueError, RuntimeError, NotImplementedError, EOFError, OSError)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, filename, route, size, content)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("filename"), text.file_route(name).alias("route"), F.col("length").alias("size"), "content")


def docx_text(data: bytes) -> str:
    """Paragraphs of a Word file, a blank line between them."""
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    except DAMAGED:
        return ""
    mark = {f"{SPACE_W}t": lambda e: e.text or "", f"{SPACE_W}tab": lambda _: "\t", f"{SPACE_W}br": lambda _: "\n"}
    return "".join("".join(mark[e.tag](e) for e in p.iter() if e.tag in mark) + "\n\n" for p in root.iter(f"{SPACE_W}p"))


def pdf_text(data: bytes) -> str:
    """Text of a PDF where a PDF library is installed; else empty, which sends the file to OCR."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return ""
    try:
        return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)
    except Exception:  # a damaged file is no error of the job
        return ""


def carved_jpegs(data: bytes, least: int = LEAST_JPEG) -> list[bytes]:
    """JPEG streams inside a file, from start to end marker, without small ones."""
    out, at = [], 0
    while (start := data.find(b"\xff\xd8\xff", at)) >= 0 and (end := data.find(b"\xff\xd9", start + 3)) >= 0:
        at = end + 2
        if at - start > least:
            out.append(data[start:at])
    return out


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from a PNG or JPEG header."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data):
        kind, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + length
    return None


def docx_media(data: bytes) -> list[tuple[str, bytes]]:
    """Images of a Word file by the number in their name, without vector formats."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except DAMAGED:
        return []

    def read(member: str) -> bytes:
        try:
            return archive.read(member)
        except DAMAGED:
            return b""

    number = lambda n: int("".join(c for c in n.rpartition("/")[2].rpartition(".")[0] if c.isdigit()) or 0)
    names = [n for n in archive.namelist() if n.startswith("word/media/") and n.rpartition(".")[2].lower() in text.IMAGE_TYPES]
    return [(n, image) for n in sorted(names, key=number) if (image := read(n))]


SPACE_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
SPACE_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column(reference: str) -> int:
    """Place of a cell's column, from 0: A, B, ..., Z, AA."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _cell(cell: ElementTree.Element, shared: list[str]) -> str:
    kind, value = cell.get("t"), cell.findtext(f"{SPACE_S}v") or ""
    if kind == "s":
        return shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{SPACE_S}t"))
    return {"1": "TRUE", "0": "FALSE"}.get(value, value) if kind == "b" else value


def workbook_sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows) of a workbook's sheets in their order; rows without a value are left out, cells without one are ""."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        shared = []
        if "xl/sharedStrings.xml" in archive.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{SPACE_S}t")) for item in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).iter(f"{SPACE_S}si")]
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{SPACE_S}sheet"):
            target = targets.get(sheet.get(f"{SPACE_R}id"), "")
            rows = []
            for row in ElementTree.fromstring(archive.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{SPACE_S}row"):
                cells: dict[int, str] = {}
                for k, cell in enumerate(row.iter(f"{SPACE_S}c")):
                    cells[_column(cell.get("r", "")) if cell.get("r") else k] = _cell(cell, shared)
                if any(cells.values()):
                    rows.append([cells.get(k, "") for k in range(max(cells) + 1)])
            width = max(map(len, rows), default=0)
            out.append((sheet.get("name", ""), [r + [""] * (width - len(r)) for r in rows]))
        return out
    except DAMAGED:
        return []


def sheets_of(name: str, data: bytes) -> list[tuple[str, list[list[str]]]]:
    """Sheets of an uploaded workbook or CSV file, which is one sheet."""
    if not name.lower().endswith(".csv"):
        return workbook_sheets(data)
    try:
        rows = [r for r in csv.reader(io.StringIO(data.decode("utf-8-sig", "replace"), newline="")) if any(r)]
    except csv.Error:
        return []
    width = max(map(len, rows), default=0)
    return [("Sheet1", [r + [""] * (width - len(r)) for r in rows])]


def sheets(files: DataFrame) -> DataFrame:
    """(path, filename, place, sheet, row, values) of all sheets; row 1 is the header.

    A file is opened by one task; uploads are limited to some megabytes.
    """
    schema = "path string, filename string, place int, sheet string, row int, values array<string>"

    def opened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, name, data in zip(f["path"], f["filename"], f["content"], strict=True):
                rows = [(path, name, k, sheet, n, values) for k, (sheet, body) in enumerate(sheets_of(name, bytes(data))) for n, values in enumerate(body, 1)]
                yield pd.DataFrame(rows, columns=["path", "filename", "place", "sheet", "row", "values"])

    return files.where("route = 'spreadsheet'").select("path", "filename", "content").mapInPandas(opened, schema)


#: Fixed value: the first bytes of the compound files that old Office formats are.
COMPOUND = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"


def unreadable(route: str, name: str, data: bytes) -> str | None:
    """Why nothing can be read of an upload; null if something can."""
    if route not in ("docx", "spreadsheet") or name.lower().endswith(".csv"):
        return None
    if not data:
        return "the file is empty"
    if data.startswith(COMPOUND):
        return "an old binary or encrypted Office file, which is not read"
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        bad = archive.testzip()
        if bad:
            return f"damaged: {bad}"
        main = "word/document.xml" if route == "docx" else "xl/workbook.xml"
        return None if main in archive.namelist() else f"no {main} inside"
    except DAMAGED as error:
        return f"damaged or encrypted: {error}"


def failures(files: DataFrame) -> DataFrame:
    """(path, filename, failed_stage, last_error) of the uploads that nothing can be read of, such as .xls; they end as failures, not as empty texts."""

    def tried(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [(p, n, unreadable(r, n, bytes(c))) for p, n, r, c in zip(f["path"], f["filename"], f["route"], f["content"], strict=True)]
            yield pd.DataFrame([(p, n, "extract", why[:2000]) for p, n, why in found if why], columns=["path", "filename", "failed_stage", "last_error"])

    return files.where("route in ('docx', 'spreadsheet')").select("path", "filename", "route", "content").mapInPandas(tried, "path string, filename string, failed_stage string, last_error string")


def workbook_text(name: str, data: bytes) -> str:
    """What a search sees of a workbook: every sheet's name, columns and rows."""
    parts = []
    for sheet, rows in sheets_of(name, data):
        if rows:
            headers = [h.strip() for h in rows[0]]
            parts.append(f"## Sheet: {sheet}\nColumns: {', '.join(headers)}")
            parts += ["\n".join(" | ".join(f"{h or f'Col{k + 1}'}: {v}" for k, (h, v) in enumerate(zip(headers, r, strict=True))) for r in rows[1:])] * (len(rows) > 1)
    return "\n\n".join(parts)


def with_text(files: DataFrame) -> DataFrame:
    """(path, filename, route, content_text, needs_ocr): text files are decoded by Spark, documents by a helper.

    Bytes that are no UTF-8 become replacement characters. Fewer than fifty characters of a PDF mean
    that it was scanned.
    """

    def opened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            readers = {"docx": lambda _, c: docx_text(c), "pdf": lambda _, c: pdf_text(c), "spreadsheet": workbook_text}
            f["content_text"] = [readers[r](n, bytes(c)) for n, r, c in zip(f["filename"], f["route"], f["content"], strict=True)]
            yield f[["path", "filename", "route", "content_text"]]

    plain = files.where("route = 'text'").select("path", "filename", "route", F.make_valid_utf8(F.col("content").cast("string")).alias("content_text"))
    packed = files.where("route in ('docx', 'pdf', 'spreadsheet')").select("path", "filename", "route", "content").mapInPandas(opened, "path string, filename string, route string, content_text string")
    images = files.where("route = 'image'").select("path", "filename", "route", F.lit("").alias("content_text"))
    every = plain.unionByName(packed).unionByName(images)
    return every.withColumn("needs_ocr", (F.col("route") == "image") | ((F.col("route") == "pdf") & (F.length(F.trim("content_text")) < 50)))


PDF_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
PDF_REFERENCE = re.compile(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R")


def pdf_images(data: bytes, least: int = LEAST_JPEG) -> list[tuple[int, bytes]]:
    """(page, JPEG) of a PDF's images in page order, then in the order of their names in the page's resources.

    Pages come in the order of their objects in the file. Only plain objects are read; where
    none names an image, the JPEG streams of the whole file are taken as of page 1.
    """
    objects = {int(m[1]): m[2] for m in PDF_OBJECT.finditer(data)}
    out, page = [], 0
    for body in objects.values():
        if not re.search(rb"/Type\s*/Page\b(?!s)", body):
            continue
        page += 1
        resources = re.search(rb"/Resources\s+(\d+)\s+\d+\s+R", body)
        known = objects.get(int(resources[1]), b"") if resources else body
        names = re.search(rb"/XObject\s*<<(.*?)>>", known, re.S)
        for _, number in dict(PDF_REFERENCE.findall(names[1])).items() if names else ():
            image = objects.get(int(number), b"")
            if re.search(rb"/Subtype\s*/Image\b", image) and b"/DCTDecode" in image:
                out += [(page, x) for x in carved_jpegs(image, least)[:1]]
    return out or [(1, x) for x in carved_jpegs(data, least)]


def ocr_text(images: DataFrame) -> DataFrame:
    """(path, content) of scanned files from what was read on their images (path, page, place, width, height, text).

    Of a page the largest image counts, the first of equals; empty pages are left out.
    """
    largest = images.groupBy("path", "page").agg(F.max_by("text", F.struct((F.col("width") * F.col("height")).alias("size"), F.struct(*[(-F.col(f"place.{c}")).alias(c) for c in images.schema["place"].dataType.names]))).alias("text"))
    pages = largest.select("path", F.struct("page", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text")).alias("p"))
    found = pages.groupBy("path").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return found.select("path", F.array_join(F.transform(F.filter("p", lambda x: x["text"] != ""), lambda x: x["text"]), "\n\n").alias("content"))


def into_folder(folder: str) -> Callable[[str, bytes | None], None]:
    """A put that writes objects under a folder of any file system that pyarrow knows; what has no bytes is refused."""

    def put(key: str, data: bytes | None) -> None:
        if not data:
            raise ValueError(f"nothing to put at {key}")
        system, base = pyarrow.fs.FileSystem.from_uri(folder)
        path = f"{base}/{key}"
        system.create_dir(path.rpartition("/")[0], recursive=True)
        with system.open_output_stream(path) as out:
            out.write(bytes(data))

    return put


def put_all(rows: DataFrame, row: str, key: str, data: str, put: Callable[[str, bytes], None]) -> DataFrame:
    """(row, result): every object is put by its task; one that fails is skipped and the others go on.

    A task that runs again puts the same objects at the same keys.
    """
    schema = rows.select(row, F.lit("").alias("result")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            results = []
            for k, x in zip(f[key], f[data], strict=True):
                try:
                    put(k, x)
                    results.append("put")
                except Exception:  # one bad object must not lose the rest
                    results.append("skipped")
            yield pd.DataFrame({row: f[row], "result": results})

    return rows.select(row, key, data).mapInPandas(run, schema)


def figures(files: DataFrame, width: int = 100, height: int = 100, most: int = 40) -> DataFrame:
    """(path, figure, size): images of a file, big enough, each content once, the first ``most``."""

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, route, data in zip(f["path"], f["route"], f["content"], strict=True):
                images = docx_media(data) if route == "docx" else pdf_images(bytes(data)) if route == "pdf" else [("", data)]
                rows = [(path, k, *(image_size(x) or (0, 0)), x) for k, (_, x) in enumerate(images)]
                yield pd.DataFrame(rows, columns=["path", "place", "width", "height", "image"])

    rows = files.where("route in ('docx', 'pdf', 'image')").select("path", "route", "content").mapInPandas(found, "path string, place int, width int, height int, image binary")
    big = rows.where((F.col("width") >= width) & (F.col("height") >= height)).withColumn("sha", F.sha2("image", 256))
    once = big.withColumn("nth", F.row_number().over(Window.partitionBy("path", "sha").orderBy("place"))).where("nth = 1")
    return once.withColumn("figure", F.row_number().over(Window.partitionBy("path").orderBy("place"))).where(F.col("figure") <= most).select("path", "figure", "width", "height", "sha")


def record(header: Column, values: Column) -> Column:
    """A map from header to value; of equal headers the later counts."""
    last = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    put = lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["h"]), F.create_map(x["h"], x["v"]))
    pairs = F.arrays_zip(F.transform(header, lambda h: h.cast("string")).alias("h"), F.transform(values, lambda v: v.cast("string")).alias("v"))
    return F.aggregate(pairs, last, put)


def preview(rows: DataFrame, sheet: str, row: str, limit: int = 1000) -> DataFrame:
    """The first rows of each sheet, with total_rows, how many it has.

    Rows past the limit are dropped by the window as it goes, and counts come from a partial aggregate.
    """
    totals = rows.groupBy(sheet).agg(F.count("*").alias("total_rows"))
    first = rows.withColumn("__k", F.row_number().over(Window.partitionBy(sheet).orderBy(row))).where(F.col("__k") <= limit).drop("__k")
    return first.join(totals, sheet)


def sheet_preview(rows: DataFrame, limit: int = 1000) -> DataFrame:
    """(path, place, sheet, row, record, total_rows) of the first ``limit`` data rows of ``sheets``, as maps from header to value."""
    key = ["path", "place"]
    header = rows.where("row = 1").select(*key, F.col("values").alias("header"))
    totals = rows.groupBy(*key).agg((F.count("*") - 1).alias("total_rows"))
    body = rows.where((F.col("row") > 1) & (F.col("row") <= limit + 1))
    return body.join(header, key).join(totals, key).select(*key, "sheet", "row", record(F.col("header"), F.col("values")).alias("record"), "total_rows")
