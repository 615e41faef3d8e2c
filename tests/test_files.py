"""File readers on small files made here."""

import io
import json
import zipfile

import pytest

from ledgerline.sources import files, tables


def test_csv_keeps_codes_and_letters(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("01234567;Орёл;x\n00000001;Псков;y\n".encode("cp1251"))
    rows = files.csv(spark, str(tmp_path / "a.csv"), ["code", "name", "k"]).orderBy("code").collect()
    assert [tuple(r) for r in rows] == [("00000001", "Псков", "y"), ("01234567", "Орёл", "x")]


def test_series_json_and_day_characters(spark, tmp_path):
    doc = {"dataset": "d", "headers": [{"id": 1, "name": "rate"}], "units": [{"id": 2, "name": "%"}], "RawData": [{"series": 1, "unit": 2, "period": "2024-01", "value": 1.5}, {"series": 9, "unit": 2, "period": "2024-02", "value": 2.5}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    rows = files.series_json(spark, str(tmp_path / "a.json")).orderBy("series_id").collect()
    assert [(r.series_name, r.unit, r.value) for r in rows] == [("rate", "%", 1.5), (None, "%", 2.5)]
    (tmp_path / "s.txt").write_text("k1 2023 " + "A" * 364 + "B\nk2 2024 AB\n")
    rows = files.day_statuses(spark, str(tmp_path / "s.txt")).collect()
    assert len(rows) == 367 and {(r.key, r.valid) for r in rows} == {("k1", True), ("k2", False)}
    assert [str(r.day) for r in rows if r.key == "k1" and r.status == "B"] == ["2023-12-31"]


def test_office_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="s"><si><t>one</t></si><si><r><t>t</t></r><r><t>wo</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="s"><sheetData><row r="1"><c r="A1" t="s"><v>1</v></c><c r="B1"><v>2.5</v></c><c r="C1" t="inlineStr"><is><t>in</t></is></c><c r="D1"><f>A1</f><v>7</v></c></row></sheetData></worksheet>')
    cells = {(r.row, r.col): r.text for r in files.workbook_cells(spark, str(tmp_path / "b.xlsx")).collect()}
    assert cells == {(1, "A"): "two", (1, "B"): "2.5", (1, "C"): "in", (1, "D"): "7"}
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>')
    parts = [(r.kind, r.table, r.row, r.col, r.text) for r in files.document_parts(spark, str(tmp_path / "c.docx")).collect()]
    assert parts == [("paragraph", -1, 0, 0, "hello"), ("cell", 0, 0, 0, "x"), ("cell", 0, 0, 1, "")]


def test_archive_members(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "hi")
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("ok.txt", "abc")
        z.writestr("../evil.txt", "abc")
        z.writestr("in.zip", inner.getvalue())
        z.writestr("broken.zip", b"no archive")
    rows = {r.member: (r.status, r.reason) for r in files.archive_members(spark, str(tmp_path / "d.zip")).collect()}
    assert rows["ok.txt"] == ("ok", None) and rows["in.zip!deep.txt"] == ("ok", None)
    assert rows["../evil.txt"] == ("quarantined", "unsafe path") and rows["broken.zip!"] == ("quarantined", "not an archive")


def test_output_is_never_overwritten(spark, tmp_path):
    df = spark.range(3)
    tables.write_new(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tables.write_new(df, str(tmp_path / "out"))
    assert tables.markdown(df.limit(1)) == "| id |\n| --- |\n| 0 |"
