"""Intake of files: read bytes, tell the format by content, quarantine what is unsafe, parse Office containers to observations."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.operators.governance import number_cases

#: First bytes of formats, in hexadecimal (fixed values).
SIGNATURES = [("255044462D", "PDF"), ("89504E470D0A1A0A", "IMAGE"), ("FFD8FF", "IMAGE"), ("49492A00", "IMAGE"), ("4D4D002A", "IMAGE"), ("504B", "OOXML"), ("D0CF11E0A1B11AE1", "OLE")]
#: Formats that a file's extension and media type lead one to expect (fixed values).
EXTENSIONS = {
    "txt": "PLAIN_TEXT", "pdf": "PDF", "docx": "DOCX", "xlsx": "XLSX", "pptx": "PPTX", "doc": "LEGACY_DOC", "xls": "LEGACY_XLS",
    "jpg": "IMAGE", "jpeg": "IMAGE", "png": "IMAGE", "tif": "IMAGE", "tiff": "IMAGE", "webp": "IMAGE",
}
LIMITS = {"bytes": 25 << 20, "pages": 200, "entries": 2000, "expanded": 250 << 20, "ratio": 100.0, "cells": 1_000_000}
PARSED = "doc_id string, seq int, kind string, text string, sheet string, row_index int, column_index int, value_type string"


def read(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, filename, length, content) of the files below a folder. Filters on length reach the source, before contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.regexp_extract("path", "[^/]*$", 0).alias("filename"), "length", "content")


def arriving(spark: SparkSession, path: str, glob: str = "*", most: int = 1000) -> DataFrame:
    """The same rows as a stream, so many new files a batch: what has been read is in the stream's own log, and each file comes once."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = stream.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("maxFilesPerTrigger", most).load(path)
    return files.select("path", F.regexp_extract("path", "[^/]*$", 0).alias("filename"), "length", "content")


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"\.([^.]+)$", 1))


#: Media types and the formats that they lead one to expect (fixed values).
MEDIA = {
    "text/plain": "PLAIN_TEXT", "application/pdf": "PDF", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "DOCX", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "XLSX",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "PPTX", "application/msword": "LEGACY_DOC", "application/vnd.ms-excel": "LEGACY_XLS", "image/jpeg": "IMAGE", "image/png": "IMAGE", "image/tiff": "IMAGE", "image/webp": "IMAGE",
}


def warnings(kind: Column, ext: Column, media: Column) -> Column:
    """EXTENSION_MISMATCH and MEDIA_TYPE_MISMATCH of a detected format; a media type's parameters do not count."""
    table = lambda t: F.create_map(*(F.lit(x) for kv in t.items() for x in kv))
    plain = F.lower(F.trim(F.substring_index(media, ";", 1)))
    odd = lambda want: F.coalesce(~kind.startswith(want), F.lit(False))
    return F.array_compact(F.array(F.when(odd(F.element_at(table(EXTENSIONS), ext)), "EXTENSION_MISMATCH"), F.when(odd(F.element_at(table(MEDIA), plain)), "MEDIA_TYPE_MISMATCH")))


def _members(content: bytes | None) -> list[zipfile.ZipInfo] | None:
    try:
        return zipfile.ZipFile(io.BytesIO(content or b"")).infolist()
    except (zipfile.BadZipFile, NotImplementedError, ValueError):
        return None


def _container(content: bytes | None) -> tuple:
    """(format, entries, expanded, ratio, encrypted, macros, unsafe) of a ZIP container; the format is null if it is broken."""
    infos = _members(content)
    if infos is None:
        return None, 0, 0, 0.0, False, False, False
    names = [i.filename for i in infos]
    kind = next((k for p, k in (("word/", "DOCX"), ("xl/", "XLSX"), ("ppt/", "PPTX")) if any(n.startswith(p) for n in names)), "UNKNOWN")
    packed, expanded = sum(i.compress_size for i in infos), sum(i.file_size for i in infos)
    ratio = max([expanded / packed if packed else 0.0, *(i.file_size / i.compress_size if i.compress_size else 0.0 for i in infos)], default=0.0)
    unsafe = any(n.startswith(("/", "\\")) or ":" in n or ".." in re.split(r"[/\\]", n) for n in names)
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        small = expanded <= LIMITS["expanded"] and len(infos) <= LIMITS["entries"] and ratio <= LIMITS["ratio"]
        # Members are read for their checksums only where the limits allow it.
        try:
            broken = small and not any(i.flag_bits & 1 for i in infos) and z.testzip() is not None
        except (zipfile.BadZipFile, zlib.error, EOFError, OSError, NotImplementedError):
            broken = True
    if broken:
        return None, 0, 0, 0.0, False, False, False
    return kind, len(infos), expanded, ratio, any(i.flag_bits & 1 for i in infos), any(n.lower().endswith("vbaproject.bin") for n in names), unsafe


CONTAINER = "kind string, entries long, expanded long, ratio double, encrypted boolean, macros boolean, unsafe boolean"


def containers(files: DataFrame) -> DataFrame:
    """Adds container facts to the ZIP files; other rows pass with nulls, and their contents never reach Python."""
    zips = F.hex(F.substring("content", 1, 2)) == "504B"
    names = [c.split()[0] for c in CONTAINER.split(", ")]

    def look(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(p, *_container(c)) for p, c in zip(pdf["path"], pdf["content"], strict=True)], columns=["path", *names])

    facts = files.where(zips).select("path", "content").mapInPandas(look, f"path string, {CONTAINER}")
    return files.join(facts, "path", "left")


def detect(files: DataFrame, pdf_profile: Column | None = None) -> DataFrame:
    """Adds format and mismatch to files with container facts. The first signature that fits decides; text needs the extension txt, valid UTF-8 and no zero byte."""
    ext = extension(F.col("filename"))
    head = F.hex(F.substring("content", 1, 16))
    text = (ext == "txt") & F.is_valid_utf8(F.try_to_binary(F.hex("content"), F.lit("hex")).cast("string")) & ~F.hex("content").rlike("^(..)*00")
    native = (pdf_profile if pdf_profile is not None else F.lit("native")) == "native"
    kind = F.lit(None).cast("string")
    for sign, name in reversed(SIGNATURES):
        to = {
            "PDF": F.when(native, "PDF_TEXT").otherwise("PDF_SCAN"),
            "OOXML": F.coalesce("kind", F.lit("CORRUPTED")),
            "OLE": F.when(ext == "xls", "LEGACY_XLS").when(ext == "doc", "LEGACY_DOC").otherwise("UNKNOWN"),
        }.get(name, F.lit(name))
        kind = F.when(head.startswith(sign), to).otherwise(kind)
    webp = head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")
    kind = F.coalesce(F.when(webp, "IMAGE"), kind, F.when(text, "PLAIN_TEXT"), F.lit("UNKNOWN"))
    wanted = F.element_at(F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv)), ext)
    return files.withColumn("format", kind).withColumn("mismatch", F.coalesce(~F.col("format").startswith(wanted), F.lit(False)))


#: Codes that a caller may try again (fixed values); all others are the document's own fault.
RETRYABLE = ["TIMEOUT", "STORAGE_FAILED"]


def quarantine(files: DataFrame, reject_mismatch: bool = False, limits: dict[str, float] = LIMITS) -> DataFrame:
    """Adds error, error_kind and retryable: the first safety rule that a detected file breaks; null if it is fit to parse.

    With reject_mismatch a file whose extension names another format is refused, as uploads are. Files may bring pages (a
    count) and corrupted (a flag) from an inspector of PDFs and images; without them those rules hold nothing against a file.
    """
    ext, c = extension(F.col("filename")), F.col
    pages = c("pages") if "pages" in files.columns else F.lit(None).cast("int")
    corrupted = c("corrupted") if "corrupted" in files.columns else F.lit(False)
    pdf = c("format").isin("PDF_TEXT", "PDF_SCAN")
    name = c("filename")
    rules = [
        (name.rlike(r"^([/\\]|[A-Za-z]:)") | name.rlike(r"(^|[/\\])\.\.([/\\]|$)"), "INVALID_SOURCE"),
        (c("length") > limits["bytes"], "FILE_TOO_LARGE"),
        (c("format") == "CORRUPTED", "CORRUPTED_FILE"),
        (F.hex(F.substring("content", 1, 8)).eqNullSafe("D0CF11E0A1B11AE1") & ext.isin("docx", "xlsx", "pptx", "docm", "xlsm", "pptm"), "ENCRYPTED_DOCUMENT"),
        (c("format").isin("LEGACY_DOC", "LEGACY_XLS"), "CONVERSION_REQUIRED"),
        (c("format") == "UNKNOWN", "UNSUPPORTED_FORMAT"),
        (c("mismatch") & F.lit(reject_mismatch), "FORMAT_MISMATCH"),
        (corrupted & (pdf | (c("format") == "IMAGE")), "CORRUPTED_FILE"),
        (pdf & (pages > limits["pages"]), "PDF_PAGE_LIMIT_EXCEEDED"),
        (c("encrypted"), "ENCRYPTED_DOCUMENT"),
        (c("entries") > limits["entries"], "ARCHIVE_LIMIT_EXCEEDED"),
        (c("unsafe"), "DANGEROUS_ARCHIVE_PATH"),
        (c("macros") | ext.isin("docm", "xlsm", "pptm"), "MACRO_ENABLED_DOCUMENT"),
        (c("expanded") > limits["expanded"], "ARCHIVE_LIMIT_EXCEEDED"),
        (c("ratio") > limits["ratio"], "ARCHIVE_LIMIT_EXCEEDED"),
    ]
    rows = files.withColumn("error", F.coalesce(*(F.when(F.coalesce(r, F.lit(False)), code) for r, code in rules)))
    return rows.withColumns({"error_kind": F.when(F.col("error").isin(*RETRYABLE), "TECHNICAL").when(F.col("error").isNotNull(), "BUSINESS"), "retryable": F.col("error").isin(*RETRYABLE)})


def inspected(pages: DataFrame, key: str, least: int = 8) -> DataFrame:
    """(key, pages, usable, profile) of page texts (key, text): native if each page has so many signs that are no space, scan if none has, else mixed."""
    enough = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "")) >= least
    n, good = F.count("*"), F.count_if(enough)
    return pages.groupBy(key).agg(n.alias("pages"), (good > 0).alias("usable"), F.when(good == n, "native").when(good == 0, "scan").otherwise("mixed").alias("profile"))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(node: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) == "t").strip()


def column_number(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Za-z]*", reference)[0].upper():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _place(reference: str) -> tuple[int, int]:
    """(row, column) of a cell reference, from 0."""
    return int(re.sub(r"[^0-9]", "", reference) or 1) - 1, column_number(reference)


def _corners(reference: str) -> tuple[int, int, int, int]:
    """(first row, first column, last row, last column) of a range."""
    first, _, last = reference.partition(":")
    return *_place(first), *_place(last or first)


def _merged(spans: list[tuple[int, int, int, int]], rows: list[int]) -> dict[int, list[tuple[int, int, tuple[int, int]]]]:
    """Of each row that has cells, the merged columns and their first cell."""
    out: dict[int, list[tuple[int, int, tuple[int, int]]]] = {}
    for a, c, b, d in spans:
        for row in rows[bisect_left(rows, a) : bisect_right(rows, b)]:
            out.setdefault(row, []).append((c, d, (a, c)))
    return out


#: Parts of a document around its body, and properties that come out (fixed values).
AROUND, PROPERTIES = ("header", "footer"), ("title", "subject", "creator", "keywords", "description", "lastModifiedBy", "created", "modified")


def _docx(z: zipfile.ZipFile) -> Iterator[tuple]:
    """Core properties by name, then headers, headings by style, runs of numbered paragraphs as list items, table cells in the body's order, then footers."""
    if "docProps/core.xml" in z.namelist():
        found = {_local(x.tag): (x.text or "").strip() for x in ElementTree.fromstring(z.read("docProps/core.xml"))}
        yield from (("property", found[name], name, None, None) for name in PROPERTIES if found.get(name))
    yield from _around(z, AROUND[0])
    yield from _body(z)
    yield from _around(z, AROUND[1])


def _around(z: zipfile.ZipFile, part: str) -> Iterator[tuple]:
    for name in sorted(n for n in z.namelist() if re.fullmatch(rf"word/{part}[0-9]*\.xml", n)):
        for p in ElementTree.fromstring(z.read(name)).iter():
            if _local(p.tag) == "p" and _text(p):
                yield part, _text(p), None, None, None


def _body(z: zipfile.ZipFile) -> Iterator[tuple]:
    body = ElementTree.fromstring(z.read("word/document.xml")).find("{*}body")
    for node in body if body is not None else ():
        if _local(node.tag) == "p":
            style = node.find("{*}pPr/{*}pStyle")
            name = next((v for k, v in style.attrib.items() if _local(k) == "val"), "") if style is not None else ""
            if node.find(".//{*}drawing") is not None or node.find(".//{*}pict") is not None:
                yield "image", "[image]", None, None, None
            kind = "heading" if name.lower().startswith("heading") else "list_item" if node.find("{*}pPr/{*}numPr") is not None else "paragraph"
            yield kind, _text(node), None, None, None
        elif _local(node.tag) == "tbl":
            for i, row in enumerate(node.findall("{*}tr")):
                for j, cell in enumerate(row.findall("{*}tc")):
                    yield "cell", _text(cell), None, i, j


def _xlsx(z: zipfile.ZipFile) -> Iterator[tuple]:
    """Filled cells of the sheets in order, with the type of their values; formulas keep their text, and of merged cells only the first is one."""
    names = z.namelist()
    shared = [_text(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet[0-9]+\.xml", n)), key=lambda n: int(re.search(r"[0-9]+", n)[0]))
    titles = [s.attrib.get("name", "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).findall("{*}sheets/{*}sheet")] if "xl/workbook.xml" in names else []
    for k, name in enumerate(sheets):
        title = titles[k] if k < len(titles) else name
        yield "sheet", title, title, None, None, None
        root = ElementTree.fromstring(z.read(name))
        cells = [(*_place(x.attrib.get("r", "")), x) for x in root.iter() if _local(x.tag) == "c"]
        # The limit is each sheet's own, by its rows times its columns.
        if max((r + 1 for r, _, _ in cells), default=0) * max((c + 1 for _, c, _ in cells), default=0) > LIMITS["cells"]:
            raise ValueError("too many cells")
        merged = _merged([_corners(x.attrib["ref"]) for x in root.iter() if _local(x.tag) == "mergeCell" and "ref" in x.attrib], sorted({r for r, _, _ in cells}))
        for row, column, cell in cells:
            if any(c <= column <= d and (row, column) != first for c, d, first in merged.get(row, ())):
                continue
            formula, value, kind = cell.find("{*}f"), cell.find("{*}v"), {"s": "text", "str": "text", "inlineStr": "text", "b": "boolean", "e": "error", "d": "date"}.get(cell.attrib.get("t", ""), "number")
            if formula is not None:
                text, kind = f"={formula.text or ''}", "formula"
            elif cell.attrib.get("t") == "inlineStr":
                text = _text(cell)
            elif value is None or value.text is None:
                continue
            else:
                text = shared[int(value.text)] if cell.attrib.get("t") == "s" else value.text
            yield "cell", text, title, row, column, kind


def _pptx(z: zipfile.ZipFile) -> Iterator[tuple]:
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide[0-9]+\.xml", n)), key=lambda n: int(re.search(r"[0-9]+", n)[0]))
    for name in slides:
        for p in ElementTree.fromstring(z.read(name)).iter():
            if _local(p.tag) == "p":
                yield "paragraph", _text(p), name, None, None


def _plain(content: bytes) -> Iterator[tuple]:
    for line in content.decode("utf-8").splitlines():
        yield "paragraph", line.strip(), None, None, None


def parse(files: DataFrame) -> DataFrame:
    """(doc_id, seq, kind, text, ...) observations of accepted files (path, format, content); blank texts are dropped.

    A file that does not parse gives one row of kind `error`, so that one bad file fails no job.
    """
    parsers = {"DOCX": _docx, "XLSX": _xlsx, "PPTX": _pptx}

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, kind, content in zip(pdf["path"], pdf["format"], pdf["content"], strict=True):
                try:
                    rows = _plain(content) if kind == "PLAIN_TEXT" else parsers[kind](zipfile.ZipFile(io.BytesIO(content)))
                    rows = [r for r in rows if r[1]]
                except Exception as e:  # noqa: BLE001  any broken file is data here
                    rows = [("error", type(e).__name__, None, None, None)]
                out = pd.DataFrame([(path, i, *r, *[None] * (6 - len(r))) for i, r in enumerate(rows)], columns=[c.split()[0] for c in PARSED.split(", ")])
                for c in ("row_index", "column_index"):
                    out[c] = out[c].astype("Int32")
                yield out

    return files.where(F.col("format").isin("PLAIN_TEXT", *parsers)).select("path", "format", "content").mapInPandas(run, PARSED)


def sheet_facts(parsed: DataFrame) -> DataFrame:
    """(doc_id, sheet, cells, formulas, rows, columns) of the sheets of parsed workbooks."""
    cells = parsed.where("kind = 'cell' AND sheet IS NOT NULL")
    return cells.groupBy("doc_id", "sheet").agg(F.count("*").alias("cells"), F.count_if(F.col("value_type") == "formula").alias("formulas"), (F.max("row_index") + 1).alias("rows"), (F.max("column_index") + 1).alias("columns"))


def dense_rows(parsed: DataFrame) -> DataFrame:
    """(doc_id, sheet, row_index, values): each row of a sheet from its first column to the sheet's last, cells that are not there empty."""
    wide = sheet_facts(parsed).select("doc_id", "sheet", "columns")
    rows = parsed.where("kind = 'cell' AND sheet IS NOT NULL").groupBy("doc_id", "sheet", "row_index").agg(F.map_from_entries(F.collect_list(F.struct("column_index", "text"))).alias("m"))
    values = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda i: F.coalesce(F.element_at("m", i.cast("int")), F.lit("")))
    return rows.join(wide, ["doc_id", "sheet"]).select("doc_id", "sheet", "row_index", values.alias("values"))


def list_blocks(parsed: DataFrame) -> DataFrame:
    """(doc_id, seq, kind, items): list items that follow one another are one block, all else a block of one."""
    by = Window.partitionBy("doc_id").orderBy("seq")
    item = F.col("kind") == "list_item"
    starts = ~(item & F.coalesce(F.lag("kind").over(by) == "list_item", F.lit(False)))
    rows = parsed.withColumn("_block", F.sum(starts.cast("int")).over(by))
    items = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    return rows.groupBy("doc_id", "_block").agg(F.min("seq").alias("seq"), F.when(F.first("kind") == "list_item", "list").otherwise(F.first("kind")).alias("kind"), items.alias("items")).drop("_block")


def parse_status(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """(path, parse_status, warning) of accepted files: slides are read for their text alone, so they are PARTIAL, as is a file without any text; a broken one FAILED."""
    found = parsed.groupBy(F.col("doc_id").alias("path")).agg(F.bool_or(F.col("kind") == "error").alias("broken"))
    rows = files.where("error IS NULL").select("path", "format").join(found, "path", "left")
    warning = F.when(F.col("broken"), "PARSE_FAILED").when(F.col("format") == "PPTX", "PPTX_TEXT_ONLY").when(F.col("broken").isNull(), "NO_TEXT")
    status = F.when(F.col("broken"), "FAILED").when(warning.isNotNull(), "PARTIAL").otherwise("PARSED")
    return rows.select("path", status.alias("parse_status"), warning.alias("warning"))


def inventory(spark: SparkSession, path: str, suffixes: list[str], pages: DataFrame | None = None) -> DataFrame:
    """(path, category, case_id, digest, size, format, pages) of a folder's files with these suffixes, numbered within their folder in order of path.

    pages (path, pages) comes from an inspector; without it the number is null.
    """
    found = read(spark, path).where(extension(F.col("filename")).isin(*suffixes))
    rows = detect(containers(found)).select("path", F.regexp_extract("path", "([^/]*)/[^/]*$", 1).alias("category"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("digest"), F.col("length").alias("size"), "format")
    rows = rows.join(pages, "path", "left") if pages is not None else rows.withColumn("pages", F.lit(None).cast("int"))
    return number_cases(rows, "category", "path").select("path", "category", "case_id", "digest", "size", "format", "pages")


def intake(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(observations, rejected): the parsed contents of a folder's fit files, and (path, format, error) of the others."""
    files = quarantine(detect(containers(read(spark, path))))
    return parse(files.where("error IS NULL")), files.where("error IS NOT NULL").select("path", "format", "error")
