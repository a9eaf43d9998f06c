"""Files made in code: formats by content, unsafe containers, Office parsers, strict JSON, stores that take a result once."""

import io
import os
import zipfile

import pytest

from quirefold.sources import files, tables

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = f"""<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Contract</w:t></w:r></w:p><w:p><w:r><w:t>Party </w:t></w:r><w:r><w:t>A</w:t></w:r></w:p><w:p/>
<w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>one</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>k</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>v</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"""
SHEET = '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1"><v>4.5</v></c></row><row r="2"><c r="B2"><f>SUM(A1:A2)</f><v>9</v></c><c r="C2"/></row></sheetData></worksheet>'


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members.items():
            z.writestr(name.replace("__", "/"), content)
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("in")
    contents = {
        "a.txt": "line one\n\n line two ".encode(), "b.docx": zipped(**{"word/document.xml": DOCX}), "c.xlsx": zipped(**{"xl/worksheets/sheet1.xml": SHEET, "xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>", "xl/workbook.xml": '<workbook><sheets><sheet name="S"/></sheets></workbook>'}),
        "d.pptx": zipped(**{"ppt/slides/slide10.xml": "<p><t>ten</t></p>", "ppt/slides/slide2.xml": "<p><t>two</t></p>"}), "e.docx": b"PK broken", "f.doc": bytes.fromhex("D0CF11E0A1B11AE1"), "g.docx": bytes.fromhex("D0CF11E0A1B11AE1"),
        "h.docx": zipped(**{"word/x.xml": "0" * 3_000_000}), "i.docx": zipped(**{"word/vbaProject.bin": "x"}), "j.docx": zipped(**{"word/document.xml": DOCX, "../evil": "x"}), "k.bin": b"\x00\x01", "l.png": b"\x89PNG\r\n\x1a\n", "m.txt": b"\xff\xfe", "n.pdf": b"%PDF-1.7", "o.jpg": b"\x89PNG\r\n\x1a\n", "p.docx": zipped(**{"word/document.xml": "<broken"}),
    }
    for name, content in contents.items():
        (top / name).write_bytes(content)
    return str(top)


def test_intake(spark, folder):
    seen, rejected = files.intake(spark, folder)
    short = lambda p: p.rpartition("/")[2]
    got = {short(r.path): r.error for r in rejected.collect()}
    assert got == {
        "e.docx": "CORRUPTED_FILE", "f.doc": "CONVERSION_REQUIRED", "g.docx": "ENCRYPTED_DOCUMENT", "h.docx": "ARCHIVE_LIMIT_EXCEEDED",
        "i.docx": "MACRO_ENABLED_DOCUMENT", "j.docx": "DANGEROUS_ARCHIVE_PATH", "k.bin": "UNSUPPORTED_FORMAT", "m.txt": "UNSUPPORTED_FORMAT",
    }
    rows = {}
    for r in seen.orderBy("doc_id", "seq").collect():
        rows.setdefault(short(r.doc_id), []).append((r.kind, r.text, r.row_index, r.column_index))
    assert [x[1] for x in rows["a.txt"]] == ["line one", "line two"]
    assert rows["b.docx"] == [("heading", "Contract", None, None), ("paragraph", "Party A", None, None), ("list_item", "one", None, None), ("cell", "k", 0, 0), ("cell", "v", 0, 1)]
    assert rows["c.xlsx"] == [("sheet", "S", None, None), ("cell", "name", 0, 0), ("cell", "4.5", 0, 27), ("cell", "=SUM(A1:A2)", 1, 1)]
    assert [x[1] for x in rows["d.pptx"]] == ["two", "ten"]
    assert rows["p.docx"][0][0] == "error"


def test_workbooks_lists_and_inventory(spark, folder, tmp_path):
    sheet = '<worksheet><sheetData><row r="1"><c r="A1" t="str"><v>a</v></c><c r="B1" t="b"><v>1</v></c><c r="D1"><v>2</v></c></row><row r="3"><c r="A3"><f>A1</f><v>1</v></c><c r="B3"><v>7</v></c></row></sheetData><mergeCells><mergeCell ref="A3:B4"/></mergeCells></worksheet>'
    doc = DOCX.replace("<w:tbl>", "<w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>two</w:t></w:r></w:p><w:p><w:r><w:drawing/></w:r></w:p><w:tbl>", 1)
    for name, content in {"x/a.xlsx": zipped(**{"xl/worksheets/sheet1.xml": sheet}), "x/b.docx": zipped(**{"word/document.xml": doc}), "y/c.pptx": zipped(**{"ppt/slides/slide1.xml": "<p><t>t</t></p>"}), "y/d.txt": b" ", "y/e.bin": b"1"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    found = files.quarantine(files.detect(files.containers(files.read(spark, str(tmp_path)))))
    parsed = files.parse(found.where("error IS NULL")).cache()
    short = lambda p: p.rpartition("/")[2]
    cells = parsed.where("sheet IS NOT NULL AND kind = 'cell'").orderBy("seq").collect()
    assert [(r.text, r.value_type, r.row_index, r.column_index) for r in cells] == [("a", "text", 0, 0), ("1", "boolean", 0, 1), ("2", "number", 0, 3), ("=A1", "formula", 2, 0)]
    assert [(r["cells"], r.formulas, r.rows, r["columns"]) for r in files.sheet_facts(parsed).collect()] == [(4, 1, 3, 4)]
    assert {r.row_index: r["values"] for r in files.dense_rows(parsed).collect()} == {0: ["a", "1", "", "2"], 2: ["=A1", "", "", ""]}
    blocks = files.list_blocks(parsed).where("doc_id LIKE '%b.docx'").orderBy("seq").collect()
    assert [(r.kind, r["items"]) for r in blocks] == [("heading", ["Contract"]), ("paragraph", ["Party A"]), ("list", ["one", "two"]), ("image", ["[image]"]), ("cell", ["k"]), ("cell", ["v"])]
    assert {short(r.path): (r.parse_status, r.warning) for r in files.parse_status(found, parsed).collect()} == {"a.xlsx": ("PARSED", None), "b.docx": ("PARSED", None), "c.pptx": ("PARTIAL", "PPTX_TEXT_ONLY"), "d.txt": ("PARTIAL", "NO_TEXT")}
    got = files.inventory(spark, str(tmp_path), ["xlsx", "docx", "pptx", "txt"]).collect()
    assert sorted((r.case_id, short(r.path), r.format) for r in got) == [("x-0001", "a.xlsx", "XLSX"), ("x-0002", "b.docx", "DOCX"), ("y-0001", "c.pptx", "PPTX"), ("y-0002", "d.txt", "PLAIN_TEXT")]
    assert all(r.digest.startswith("sha256:") and len(r.digest) == 71 for r in got)


def test_warnings_by_extension_and_media_type(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("DOCX", "docx", "application/pdf; x=1"), ("PDF_SCAN", "pdf", "application/pdf"), ("IMAGE", "pdf", None), ("UNKNOWN", "zip", "x/y")], "f string, e string, m string")
    got = [r.w for r in rows.select(files.warnings(F.col("f"), F.col("e"), F.col("m")).alias("w")).collect()]
    assert got == [["MEDIA_TYPE_MISMATCH"], [], ["EXTENSION_MISMATCH"], []]


def test_mismatch(spark, folder):
    got = {r.filename: (r.format, r.mismatch) for r in files.detect(files.containers(files.read(spark, folder))).collect()}
    assert got["l.png"] == ("IMAGE", False) and got["o.jpg"] == ("IMAGE", False) and got["n.pdf"] == ("PDF_TEXT", False) and got["g.docx"] == ("UNKNOWN", True)


def test_upload_rules(spark, folder):
    c = "path string, filename string, length long, format string, mismatch boolean, entries long, expanded long, ratio double, encrypted boolean, macros boolean, unsafe boolean, content binary, pages int, corrupted boolean"
    row = lambda name, size=1, kind="PDF_TEXT", odd=False, pages=1, bad=False: (name, name, size, kind, odd, None, None, None, None, None, None, b"x", pages, bad)
    rows = spark.createDataFrame([row("a.pdf"), row("../a.pdf"), row("b.pdf", 26 << 20), row("c.pdf", pages=201), row("d.pdf", bad=True), row("e.jpg", kind="PDF_SCAN", odd=True), row("C:\\x.pdf"), row("f.png", kind="IMAGE", bad=True)], c)
    got = {r.filename: (r.error, r.error_kind, r.retryable) for r in files.quarantine(rows, reject_mismatch=True).collect()}
    assert {k: v[0] for k, v in got.items()} == {
        "a.pdf": None, "../a.pdf": "INVALID_SOURCE", "b.pdf": "FILE_TOO_LARGE", "c.pdf": "PDF_PAGE_LIMIT_EXCEEDED", "d.pdf": "CORRUPTED_FILE", "e.jpg": "FORMAT_MISMATCH", "C:\\x.pdf": "INVALID_SOURCE", "f.png": "CORRUPTED_FILE",
    }
    assert got["a.pdf"][1] is None and got["b.pdf"][1:] == ("BUSINESS", False)
    assert files.quarantine(rows).where("filename = 'e.jpg' AND error IS NOT NULL").count() == 0


def test_broken_checksum_and_inspection(spark):
    good = zipped(**{"word/document.xml": "abcdefgh" * 40})
    at = good.index(b"document.xml") + 14
    assert files._container(good)[0] == "DOCX" and files._container(good[:at] + bytes([good[at] ^ 255]) + good[at + 1 :])[0] is None
    pages = spark.createDataFrame([("a", "enough text here"), ("a", "x  y"), ("b", "enough text here"), ("c", None)], "doc string, text string")
    assert {r.doc: (r.pages, r.usable, r.profile) for r in files.inspected(pages, "doc").collect()} == {"a": (2, True, "mixed"), "b": (1, True, "native"), "c": (1, False, "scan")}


def test_strict_json(spark, tmp_path):
    (tmp_path / "ok.json").write_text('{"a": 1, "b": "x"}\n{"a": 2}\n')
    (tmp_path / "bad.json").write_text('{"a": 1, "c": 2}\n')
    assert [tuple(r) for r in tables.read_json(spark, str(tmp_path / "ok.json"), "a int, b string").orderBy("a").collect()] == [(1, "x"), (2, None)]
    with pytest.raises(Exception, match="unexpected or broken JSON"):
        tables.read_json(spark, str(tmp_path / "bad.json"), "a int, b string").collect()


def test_store_takes_each_result_once(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("k1", 1), ("k1", 1), ("k2", None)], "k string, v int")
    assert tables.store(rows, path, "k") == 2
    assert tables.store(rows, path, "k") == 0
    got = {r.k: r.json for r in spark.read.parquet(path).collect()}
    assert got == {"k1": '{"k":"k1","v":1}', "k2": '{"k":"k2"}'}
    more = spark.createDataFrame([("k2", 5), ("k3", 3)], "k string, v int")
    assert [tables.store(more, path, "k", "b1"), tables.store(more, path, "k", "b1")] == [1, 1]
    assert spark.read.option("recursiveFileLookup", True).parquet(path).groupBy("k").count().where("count > 1").count() == 0
    (tmp_path / "store.lock").write_text("")
    with pytest.raises(RuntimeError, match="being written"):
        tables.store(more, path, "k")
    # A lock that nobody renews is a dead writer's.
    os.utime(tmp_path / "store.lock", (1, 1))
    assert tables.store(spark.createDataFrame([("k9", 1)], "k string, v int"), path, "k", "b2") == 1
    assert not [x for x in os.listdir(tmp_path) if x.startswith("store.lock")]


def test_arriving_files_are_the_folder(spark, folder, tmp_path):
    run = files.arriving(spark, folder, most=3).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    run.awaitTermination()
    key = lambda rows: sorted((r.path, r.filename, r.length, bytes(r.content)) for r in rows)
    assert key(spark.read.parquet(f"{tmp_path}/out").collect()) == key(files.read(spark, folder).collect()) and len(run.recentProgress) > 3


def test_document_around_its_body_and_sheet_limits(spark, tmp_path, monkeypatch):
    around = {"word/document.xml": DOCX, "word/header1.xml": f"<w:hdr {W}><w:p><w:r><w:t>Top</w:t></w:r></w:p></w:hdr>", "word/footer1.xml": f"<w:ftr {W}><w:p><w:r><w:t>Page</w:t></w:r></w:p></w:ftr>",
              "docProps/core.xml": '<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:title>Deal</dc:title><dc:creator>An</dc:creator><cp:other>x</cp:other></cp:coreProperties>'}
    (tmp_path / "a.docx").write_bytes(zipped(**around))
    two = '<worksheet><sheetData><row r="1"><c r="A1"><v>1</v></c><c r="B1"><v>2</v></c></row><row r="3"><c r="A3"><v>3</v></c><c r="B3"><v>4</v></c><c r="C3"><v>5</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B2"/><mergeCell ref="B3:C9"/></mergeCells></worksheet>'
    (tmp_path / "b.xlsx").write_bytes(zipped(**{"xl/worksheets/sheet1.xml": two, "xl/worksheets/sheet2.xml": two}))
    seen, _ = files.intake(spark, str(tmp_path))
    rows = [(r.kind, r.text, r.sheet) for r in seen.where("doc_id LIKE '%a.docx'").orderBy("seq").collect()]
    assert rows[:3] == [("property", "Deal", "title"), ("property", "An", "creator"), ("header", "Top", None)] and rows[-1] == ("footer", "Page", None)
    cells = [r.text for r in seen.where("doc_id LIKE '%b.xlsx' AND kind = 'cell'").orderBy("seq").collect()]
    assert cells == ["1", "3", "4"] * 2
    z = zipfile.ZipFile(tmp_path / "b.xlsx")
    monkeypatch.setitem(files.LIMITS, "cells", 9)
    assert len([x for x in files._xlsx(z) if x[0] == "cell"]) == 6
    monkeypatch.setitem(files.LIMITS, "cells", 8)
    with pytest.raises(ValueError, match="too many"):
        list(files._xlsx(z))


def test_flat_export_and_aggregates(spark, tmp_path):
    docs = spark.sql("SELECT 'c1' AS caseId, 'ACTIVE' AS scopeStatus, 2 AS pageCount, array(named_struct('fieldName', 'salary', 'value', 1.5D), named_struct('fieldName', 'note', 'value', NULL)) AS fields UNION ALL SELECT 'c2', 'EXCLUDED', 1, array()")
    rows = [r.asDict() for r in tables.typed_export(docs).orderBy("fieldName").collect()]
    assert list(rows[0]) == tables.EXPORT and [(r["caseId"], r["pageCount"], r["fieldName"], r["value"], r["unit"]) for r in rows] == [("c1", "2", "note", "", ""), ("c1", "2", "salary", "1.5", "")]
    report = spark.createDataFrame([(0.5, 3)], "rate double, cases int")
    tables.write_aggregates(report, str(tmp_path / "r"), ["rate", "cases"])
    assert next((tmp_path / "r").glob("part-*")).read_text() == '{"cases":3,"rate":0.5}\n'
    with pytest.raises(ValueError, match="raw_text"):
        tables.write_aggregates(report.withColumn("raw_text", report.rate), str(tmp_path / "s"), ["rate", "cases"])
    (tmp_path / "dict.txt").write_text("a\nă\nđ\n")
    (tmp_path / "dict.yml").write_text("character:\n - 'a'\n - 'ế'\n")
    letters = lambda n: {r.letter for r in tables.read_letters(spark, str(tmp_path / n)).collect()}
    assert letters("dict.txt") == {"a", "ă", "đ"} and letters("dict.yml") == {"a", "ế"}


def test_csv_export(spark, tmp_path):
    tables.write_csv(spark.createDataFrame([(1, None, [1, 2])], "a int, b string, c array<int>").coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*")).read_text()
    assert text == 'a,b,c\n1,,"[1,2]"\n'
