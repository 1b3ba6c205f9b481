import datetime
import os

import pytest
from pyspark.sql import functions as F

from cuadra.sources import files, sheets
from cuadra.sources.files import usable_folder, write_files
from cuadra.sources.sheets import Workbook, sheet_rows, xlsx


def _rows(df):
    return sorted((r.file, r.sheet_name, r.row_no, tuple(r.cells), tuple(r.nums)) for r in df.collect())


def _book(tmp_path, name, content):
    (tmp_path / name).write_bytes(content)


HEAD = ["Fecha", "Comprobante", "Concepto", "Importe"]


def test_workbook_reads_texts_numbers_and_gaps(spark, tmp_path):
    _book(tmp_path, "a.xlsx", xlsx({"One & <two>": [(1, [" x ", 1, 2.5, None, "é"]), (4, [None, None, 45000])], "Second": [(2, ["y"])], "Empty": []}))
    _book(tmp_path, "_skipped.xlsx", b"x")
    got = _rows(sheet_rows(spark, str(tmp_path)))
    assert got == [("a.xlsx", "One & <two>", 1, ("x", "1", "2.5", "", "é"), (None, 1.0, 2.5, None, None)), ("a.xlsx", "One & <two>", 4, ("", "", "45000"), (None, None, 45000.0)), ("a.xlsx", "Second", 2, ("y",), (None,))]
    assert _rows(sheet_rows(spark, str(tmp_path / "a.xlsx"), sheets="first", cells=1)) == [("a.xlsx", "One & <two>", 1, ("x",), (None,)), ("a.xlsx", "One & <two>", 4, ("",), (None,))]


def test_shared_strings_and_cell_places():
    import io
    import zipfile

    first = xlsx({"S": [(1, ["a"])]})
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(first)) as old, zipfile.ZipFile(out, "w") as new:
        for n in old.namelist():
            new.writestr(n, old.read(n)) if "sheet0" not in n else None
        main = sheets._MAIN[1:-1]
        new.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>one</t></si><si><r><t>two</t></r><r><t>!</t></r></si></sst>')
        new.writestr("xl/worksheets/sheet0.xml", f'<worksheet xmlns="{main}"><sheetData><row r="3"><c r="B3" t="s"><v>1</v></c><c r="AA3" t="b"><v>1</v></c></row><row><c t="str"><v>f</v></c><c t="e"><v>#N/A</v></c><c><v>-1.5e3</v></c></row></sheetData></worksheet>')
    rows = list(Workbook(out.getvalue()).rows("S"))
    assert rows[0] == (3, [None, "two!", *[None] * 24, "True"]) and rows[1] == (4, ["f", "#N/A", -1500.0])


def test_window_around_the_header(spark, tmp_path):
    day = (datetime.date(2024, 5, 1) - datetime.date(1899, 12, 30)).days
    body = [(12 + k, [day, k, "c", 1.5, *["z"] * 20]) for k in range(300)]
    _book(tmp_path, "a.xlsx", xlsx({"Hoja1": [(1, ["junk"]), (3, ["above"]), (9, HEAD), *body, (312 + 119, ["near"]), (312 + 119 + 121, ["far"])], "Other": [(1, HEAD)]}))
    _book(tmp_path, "b.xlsx", xlsx({"Hoja1": [(1, ["no header"]), (2, ["x"]), (101, ["y"]), (5600, ["z"])]}))
    _book(tmp_path, "c.xlsx", xlsx({"Hoja1": [(2, ["Fecha", "Descripción"]), *[(k, ["x"]) for k in range(3, 5700)]]}))
    rows = sheet_rows(spark, str(tmp_path), window=True)
    a = [r for r in _rows(rows) if r[0] == "a.xlsx"]
    assert a[0][2:4] == (3, ("above",)) and max(len(r[3]) for r in a) == 12 and {r[1] for r in a} == {"Hoja1"}
    assert [r[2] for r in a if r[3] and r[3][0] not in ("", str(day))] == [3, 9, 431] and a[-1][2] == 431 + 120
    b = [r for r in _rows(rows) if r[0] == "b.xlsx"]
    assert [r[2] for r in b if any(r[3])] == [1, 2, 101] and b[-1][2] == 221
    c = [r[2] for r in _rows(rows) if r[0] == "c.xlsx"]
    assert (c[0], c[-1]) == (1, 2 + 5500)  # row 1 was left out, so it is a blank one


def test_files_and_rows_are_pruned(spark, tmp_path, monkeypatch):
    for k in range(4):
        _book(tmp_path, f"f{k}.xlsx", xlsx({"s": [(n, [n]) for n in range(1, 50)]}))
    _book(tmp_path, "broken.xlsx", b"not a workbook")  # never opened by the filtered reads
    df = sheet_rows(spark, str(tmp_path)).where("file = 'f2.xlsx' and row_no > 10 and row_no <= 12")
    assert [r.row_no for r in df.collect()] == [11, 12]
    with pytest.raises(Exception, match="BadZipFile|not a zip"):
        sheet_rows(spark, str(tmp_path)).count()


def test_large_workbooks_are_cut_by_sheet_and_rows(tmp_path, monkeypatch):
    monkeypatch.setattr(sheets, "TASK_BYTES", 10)
    monkeypatch.setattr(sheets, "TASK_ROWS", 20)
    _book(tmp_path, "a.xlsx", xlsx({"one": [(n, [n]) for n in range(1, 46)], "two": [(1, ["x"])]}))
    reader = sheets.SheetReader({"path": str(tmp_path)}, None)
    parts = reader.partitions()
    assert [(p.sheet, p.first, p.last) for p in parts] == [("one", 1, 20), ("one", 21, 40), ("one", 41, None), ("two", 1, None)]
    got = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert [r["row_no"] for r in got] == [*range(1, 46), 1]


def test_other_formats_by_a_reader(spark, tmp_path):
    (tmp_path / "a.txt").write_text("r1\tx\nr2\ty")
    read = lambda data: (("only", k, line.split("\t")) for k, line in enumerate(data.decode().split("\n"), 1))
    assert [r[2:4] for r in _rows(sheet_rows(spark, str(tmp_path), read=read))] == [(1, ("r1", "x")), (2, ("r2", "y"))]


def test_a_thousand_documents_read_back_equal(spark, tmp_path):
    docs = spark.range(1000).select(F.concat(F.lit("d ñ"), "id", F.lit(".json")).alias("name"), F.when(F.col("id") % 7 != 0, F.repeat(F.concat(F.lit("é\n"), "id"), (F.col("id") % 50).cast("int"))).alias("content"))
    at = write_files(docs.repartition(7), str(tmp_path / "out"))
    want = {r.name: (r.content or "").encode() for r in docs.collect()}
    assert {n: open(os.path.join(at, n), "rb").read() for n in os.listdir(at)} == want
    write_files(docs.limit(1).select("name", F.lit("new").alias("content")), at)
    assert open(os.path.join(at, "d ñ0.json")).read() == "new" and len(os.listdir(at)) == 1000


def test_nothing_is_left_where_a_task_fails(spark, tmp_path):
    at = str(tmp_path / "out")
    docs = spark.range(100).select(F.concat(F.lit("d"), "id").alias("name"), F.when(F.col("id") == 99, F.raise_error(F.lit("disk"))).otherwise("x").cast("string").alias("content"))
    with pytest.raises(Exception, match="disk"):
        write_files(docs.repartition(5), at)
    assert os.listdir(at) == []
    for name in ("../a", "", None, "a/b"):
        with pytest.raises(Exception, match="file's name"):
            write_files(spark.createDataFrame([(name, "x")], "name string, content string"), at)
    for parts in (1, 2):
        with pytest.raises(Exception, match="two documents"):
            write_files(spark.createDataFrame([("a", "x"), ("a", "y")], "name string, content string").repartition(parts), at)
    assert os.listdir(at) == []


def test_folders_fall_back(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    bad, good = str(tmp_path / "file" / "below"), str(tmp_path / "good")
    assert usable_folder(["", bad, bad, good]) == good
    with pytest.raises(OSError, match="below"):
        usable_folder([bad, good], strict=True)
    with pytest.raises(OSError, match="none is given"):
        usable_folder([])
    docs = spark.createDataFrame([("a.txt", b"x")], "name string, content binary")
    assert write_files(docs, [bad, good]) == good and os.listdir(good) == ["a.txt"]
    assert files.DocumentFiles.name() == "document_files"


def test_files_that_cannot_be_read_are_told(spark, tmp_path):
    from cuadra.sources.documents import page_texts, unread

    (tmp_path / "a.pdf").write_bytes(b"one two")
    (tmp_path / "b.pdf").write_bytes(b"!")

    def read(data):
        if data == b"!":
            raise ValueError("no pages")
        return data.decode().split()

    assert [tuple(r) for r in unread(spark, str(tmp_path), read).collect()] == [("b.pdf", "ValueError: no pages")]
    assert page_texts(spark, str(tmp_path), read).count() == 2
