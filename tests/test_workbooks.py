"""Workbooks: what is written is read back, as are books of other programs; contracts hold."""

import io
import zipfile
from xml.etree import ElementTree

import pytest

from tidemark.sources import workbooks as W
from tidemark.sources.files import ContractError

COLUMNS = ["gold_id", "text_clean", "label", "notes"]
SCHEMA = "gold_id string, text_clean string, label string, notes string"
HARD = ["", " ", "=1+1", "+x", "-x", "@x", "a\tb\nc\rd\r\ne", "\x00\x07\x1f", "_x0007_ _x005F_ _x", "<&>\"'", chr(0x1F621) + chr(0x3000), "]]>", "x" * W.CELL, "G" * 5, chr(0xFFFE), "1.0", "TRUE"]


def test_round_trip(spark, tmp_path):
    rows = [(f"G{i}", t, " Negative " if i % 2 else "  ", None) for i, t in enumerate(HARD)] + [(None, None, None, None), ("G0", "", "x", None), ("G0", "", "x", None)]
    path = f"{tmp_path}/books"
    W.write_workbooks(spark.createDataFrame(rows, SCHEMA).repartition(3), path, allowed={"label": ["negative", "positive"]}, widths={"text_clean": 80}, rows=4)
    found = [tuple(r) for r in W.read_workbooks(spark, path, COLUMNS).collect()]
    want = [(a, b, c.strip().lower() or None, d) for a, b, c, d in rows if a is not None]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert len(list((tmp_path / "books").glob("book-*.xlsx"))) >= len(rows) // 4 and not list(tmp_path.glob("*.part"))
    with pytest.raises(ContractError, match="there already"):
        W.write_workbooks(spark.createDataFrame(rows, SCHEMA), path)


def test_empty_table_and_long_cells(spark, tmp_path):
    W.write_workbooks(spark.createDataFrame([], SCHEMA), f"{tmp_path}/none")
    assert W.read_workbooks(spark, f"{tmp_path}/none", COLUMNS).collect() == []
    with pytest.raises(Exception, match="at most"):
        W.write_workbooks(spark.createDataFrame([("a", "x" * (W.CELL + 1), None, None)], SCHEMA), f"{tmp_path}/long")
    assert not list(tmp_path.glob("long*"))


def test_layout(tmp_path):
    out = io.BytesIO()
    layout = W.Layout("a & b", {"label": ["x", "y"]}, {"text_clean": 80})
    W.write_book(out, COLUMNS, [("1", "=cmd()", None, None), ("2", "t", None, None)], layout)
    sheet = ElementTree.fromstring(zipfile.ZipFile(out).read("xl/worksheets/sheet1.xml"))
    name = lambda n: f"{{http://schemas.openxmlformats.org/spreadsheetml/2006/main}}{n}"
    assert [c.tag for c in sheet] == [name(n) for n in ("sheetViews", "cols", "sheetData", "dataValidations")]
    rule = next(sheet.iter(name("dataValidation")))
    assert rule.get("sqref") == "C2:C3" and rule[0].text == '"x,y"' and next(sheet.iter(name("pane"))).get("state") == "frozen"
    cells = {c.get("r"): c for c in sheet.iter(name("c"))}
    assert not list(sheet.iter(name("f"))) and cells["B2"].get("s") == "3" and cells["B3"].get("s") == "2" and cells["A1"].get("s") == "1"
    assert list(W.read_book(out, COLUMNS, "a & b")) == [("1", "=cmd()", None, None), ("2", "t", None, None)]
    for wrong in (W.Layout("s", {"label": ["a,b"]}, {}), W.Layout("s", {"other": ["a"]}, {}), W.Layout("s", {"label": ["a" * 300]}, {})):
        with pytest.raises(ContractError):
            wrong.check(COLUMNS)
    for sheet_name, columns in (("labels", COLUMNS), ("a & b", ["gold_id", "notes"])):
        with pytest.raises(ContractError):
            list(W.read_book(out, columns, sheet_name))
    assert [W.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"] and all(W.column_place(W.column_name(i) + "7") == i for i in range(2000))


def test_books_of_other_programs():
    """Shared strings with runs and readings, numbers, booleans, gaps, a second sheet, columns to the right."""
    main, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="other" sheetId="1" r:id="r1"/><sheet name="labels" sheetId="2" r:id="r2"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="/xl/worksheets/b.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>id</t></si><si><t>label</t></si><si><r><t>po</t></r><r><rPr><b/></rPr><t>sitive</t></r><rPh sb='0' eb='1'><t>no</t></rPh></si><si><t/></si></sst>")
        cells = '<row r="1"><c r="A1" t="s"><v>0</v></c><c t="s"><v>1</v></c><c r="D1" t="s"><v>2</v></c></row><row r="5"><c r="B5" t="s"><v>2</v></c></row><row r="6"><c r="A6"><v>7</v></c><c r="B6" t="b"><v>1</v></c></row><row r="7"><c r="A7" s="2"/><c r="C7"><v>1</v></c></row><row r="8"><c r="A8" t="s"><v>3</v></c><c r="B8" t="str"><f>A1</f><v>x_x0041_</v></c></row>'
        book.writestr("xl/worksheets/b.xml", f"<worksheet {main}><sheetData>{cells}</sheetData></worksheet>")
    assert list(W.read_book(out, ["id", "label"], "labels")) == [(None, "positive"), ("7", "TRUE"), ("", "xA")]
