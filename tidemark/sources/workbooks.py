"""Workbooks of label sheets, as a Spark data source.

A table becomes a folder of workbooks (zipped XML, as spreadsheet programs open
it) with a sheet of at most `rows` rows each. Tasks write books beside the place,
the commit puts the folder there by one rename; books of failed attempts are left
out. Every cell is text: one that begins with `=`, `+`, `-` or `@` is marked so
that editing doesn't make it a formula. A column may have a list of allowed
values, columns have widths, and the header stays in sight.

Reading takes a folder or one book, a task each, also as spreadsheet programs
save them again (shared strings, numbers, other sheets, columns to the right).
The first columns must be the ones asked for.

Defined results: null is a cell that isn't there, empty text stays empty; rows
whose cells are all absent go; characters that XML can't hold are escaped and
come back; a text over CELL characters is refused, as the format can't hold it;
an empty table is one book with a header.
"""

from __future__ import annotations

import json
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tidemark.plans.storage import exists, new_path
from tidemark.plans.views import duck, view
from tidemark.sources.files import ContractError

QUERIES, ORACLES = {}, {}
#: Limits of the format. Fixed values.
CELL, ROWS, LIST = 32_767, 1_048_575, 255

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: Cell styles by place: plain, header, wrapped text, wrapped text that is never a formula.
_STYLES = (
    f'{_HEAD}<styleSheet xmlns="{_MAIN}"><fonts count="2"><font/><font><b/></font></fonts>'
    '<fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills>'
    '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="4"><xf/><xf fontId="1" applyFont="1"/>'
    '<xf applyAlignment="1"><alignment wrapText="1" vertical="top"/></xf><xf quotePrefix="1" applyAlignment="1"><alignment wrapText="1" vertical="top"/></xf></cellXfs></styleSheet>'
)
_UNSAFE = re.compile(r"_(?=x[0-9A-Fa-f]{4}_)|[\x00-\x08\x0b-\x1f\ud800-\udfff\ufffe\uffff]")
_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")


@dataclass
class Layout:
    """How sheets look: the sheet's name, allowed values by column, widths by column."""

    sheet: str
    allowed: dict[str, list[str]]
    widths: dict[str, float]

    def check(self, columns: list[str]) -> None:
        if unknown := (self.allowed.keys() | self.widths.keys()) - set(columns):
            raise ContractError(f"no columns {sorted(unknown)}")
        for column, values in self.allowed.items():
            if any("," in v or '"' in v for v in values) or len(",".join(values)) > LIST:
                raise ContractError(f"the allowed values of {column} can't be a list in a sheet")


def column_name(place: int) -> str:
    """A, B, ... Z, AA, ... of 0, 1, ..."""
    name, place = "", place + 1
    while place:
        place, digit = divmod(place - 1, 26)
        name = chr(65 + digit) + name
    return name


def column_place(reference: str) -> int:
    place = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        place = place * 26 + ord(letter) - 64
    return place - 1


def _row(number: int, values: Iterable[str | None], header: bool = False) -> str:
    cells = []
    for i, value in enumerate(values):
        if value is None:
            continue
        if len(value.encode("utf-16-le", "surrogatepass")) // 2 > CELL:
            raise ContractError(f"a cell holds at most {CELL} characters")
        style = 1 if header else 3 if value[:1] in ("=", "+", "-", "@") and value else 2
        text = escape(_UNSAFE.sub(lambda m: f"_x{ord(m[0]):04X}_", value))
        cells.append(f'<c r="{column_name(i)}{number}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>')
    return f'<row r="{number}">{"".join(cells)}</row>'


def write_book(out, columns: list[str], rows: Iterable, layout: Layout) -> None:
    """One book to a binary stream, row by row."""
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{_TYPE}.styles+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_TYPE}.worksheet+xml"/></Types>')
        book.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets><sheet name={quoteattr(layout.sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{_REL}/styles" Target="styles.xml"/></Relationships>')
        book.writestr("xl/styles.xml", _STYLES)
        with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
            put = lambda text: sheet.write(text.encode())
            widths = "".join(f'<col min="{i + 1}" max="{i + 1}" width="{layout.widths[c]}" customWidth="1"/>' for i, c in enumerate(columns) if c in layout.widths)
            put(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>')
            put(f"<cols>{widths}</cols><sheetData>" if widths else "<sheetData>")
            put(_row(1, columns, header=True))
            number = 1
            for number, row in enumerate(rows, 2):
                put(_row(number, row))
            put("</sheetData>")
            if layout.allowed:
                lists = "".join(f'<dataValidation type="list" allowBlank="1" showErrorMessage="1" sqref="{(a := column_name(columns.index(c)))}2:{a}{max(number, 2)}"><formula1>{escape(chr(34) + ",".join(v) + chr(34))}</formula1></dataValidation>' for c, v in layout.allowed.items())
                put(f'<dataValidations count="{len(layout.allowed)}">{lists}</dataValidations>')
            put("</worksheet>")


def _plain(text: str) -> str:
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)


def _text(element) -> str:
    """A string's text: its own or its runs', without readings set beside it."""
    parts = [t.text or "" for part in element for t in ([part] if part.tag == f"{{{_MAIN}}}t" else part if part.tag == f"{{{_MAIN}}}r" else ()) if t.tag == f"{{{_MAIN}}}t"]
    return _plain("".join(parts))


def _elements(stream, name: str) -> Iterator:
    """Elements of one name; each is dropped when the next is asked for, so a sheet is never whole in memory."""
    events = ElementTree.iterparse(stream, events=("start", "end"))
    _, root = next(events)
    parents = [root]
    for event, element in events:
        if event == "start":
            parents.append(element)
            continue
        parents.pop()
        if element.tag == f"{{{_MAIN}}}{name}":
            yield element
            if parents:
                parents[-1].remove(element)


def _sheet_part(book: zipfile.ZipFile, sheet: str) -> str:
    names = {s.get("name"): s.get(f"{{{_REL}}}id") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{{{_MAIN}}}sheet")}
    if sheet not in names:
        raise ContractError(f"no sheet {sheet}")
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = targets[names[sheet]]
    return target[1:] if target.startswith("/") else f"xl/{target}"


def read_book(stream, columns: list[str], sheet: str) -> Iterator[tuple[str | None, ...]]:
    """The rows of a book's sheet below its header."""
    with zipfile.ZipFile(stream) as book:
        part, shared = _sheet_part(book, sheet), []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as strings:
                shared = [_text(si) for si in _elements(strings, "si")]  # a book's
        header = None
        with book.open(part) as found:
            for row in _elements(found, "row"):
                values, place = [None] * len(columns), -1
                for cell in row:
                    place = column_place(cell.get("r")) if cell.get("r") else place + 1
                    if place >= len(columns):
                        continue
                    kind, inner, value = cell.get("t"), cell.find(f"{{{_MAIN}}}is"), cell.find(f"{{{_MAIN}}}v")
                    if kind == "inlineStr":
                        values[place] = None if inner is None else _text(inner)
                    elif value is not None:
                        raw = value.text or ""
                        values[place] = shared[int(raw)] if kind == "s" else ("TRUE" if raw == "1" else "FALSE") if kind == "b" else _plain(raw) if kind == "str" else raw
                if header is None:
                    header = values
                    if header != columns:
                        raise ContractError(f"sheet {sheet} begins with {header}, not {columns}")
                elif any(v is not None for v in values):
                    yield tuple(values)
        if header is None:
            raise ContractError(f"sheet {sheet} has no header")


def _open(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


@dataclass
class Book(InputPartition):
    uri: str


class WorkbookWriter(DataSourceWriter):
    def __init__(self, columns: list[str], path: str, part: str, rows: int, layout: Layout):
        self.columns, self.path, self.part, self.rows, self.layout = columns, path, part, rows, layout

    def _book(self, rows: Iterable) -> str:
        fs, folder = _open(self.part)
        fs.create_dir(folder, recursive=True)
        name = f"book-{uuid.uuid4().hex}.xlsx"
        with fs.open_output_stream(f"{folder}/{name}") as out:
            write_book(out, self.columns, rows, self.layout)
        return name

    def write(self, iterator: Iterator) -> Written:
        names, held = [], next(iterator, None)

        def some():
            nonlocal held
            for _ in range(self.rows):
                if held is None:
                    return
                yield held
                held = next(iterator, None)

        while held is not None:
            names.append(self._book(some()))
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        names = {n for m in messages if m for n in m.names} or {self._book([])}
        fs, folder = _open(self.part)
        from pyarrow.fs import FileSelector

        for found in fs.get_file_info(FileSelector(folder)):
            if found.base_name not in names:  # of an attempt that didn't count
                fs.delete_file(found.path)
        fs.move(folder, _open(self.path)[1])

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = _open(self.part)
        if fs.get_file_info(folder).type.name == "Directory":
            fs.delete_dir(folder)


class WorkbookReader(DataSourceReader):
    def __init__(self, columns: list[str], path: str, sheet: str):
        self.columns, self.path, self.sheet = columns, path, sheet

    def partitions(self) -> list[Book]:
        from pyarrow.fs import FileSelector

        fs, path = _open(self.path)
        info = fs.get_file_info(path)
        if info.type.name == "File":
            return [Book(self.path)]
        books = sorted(f.base_name for f in fs.get_file_info(FileSelector(path)) if f.base_name.endswith(".xlsx") and f.base_name[0] not in "._~")
        return [Book(f"{self.path}/{name}") for name in books]

    def read(self, partition: Book | None) -> Iterator[tuple]:
        if partition is None:  # a folder without books
            return
        fs, path = _open(partition.uri)
        with fs.open_input_file(path) as stream:
            yield from read_book(stream, self.columns, self.sheet)


class WorkbookSource(DataSource):
    """Options: path, sheet, columns (JSON list, to read), rows, allowed and widths (JSON, to write), part (where tasks write)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        return _text_schema(json.loads(self.options["columns"]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return WorkbookReader(schema.names, self.options["path"], self.options.get("sheet", "labels"))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        layout = Layout(self.options.get("sheet", "labels"), json.loads(self.options.get("allowed", "{}")), json.loads(self.options.get("widths", "{}")))
        return WorkbookWriter(schema.names, self.options["path"], self.options["part"], int(self.options["rows"]), layout)


def _text_schema(columns: list[str]) -> StructType:
    schema = StructType()
    for c in columns:
        schema.add(c, "string")
    return schema


def _uri(path: str) -> str:
    path = path.rstrip("/")
    if "://" in path:
        return path
    return "file://" + path.removeprefix("file:") if path.startswith(("/", "file:/")) else path


def write_workbooks(df: DataFrame, path: str, sheet: str = "labels", allowed: dict[str, list[str]] | None = None, widths: dict[str, float] | None = None, rows: int = 5_000) -> None:
    """df as a folder of workbooks, all cells as text; refuses a place that is taken: labelled work is never overwritten."""
    layout = Layout(sheet, allowed or {}, widths or {})
    layout.check(df.columns)
    if not 1 <= rows <= ROWS:
        raise ContractError(f"a sheet has 1 to {ROWS} rows below its header")
    spark, path = df.sparkSession, _uri(path)
    if exists(spark, path):
        raise ContractError(f"{path} is there already")
    spark.dataSource.register(WorkbookSource)
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    text.write.format("workbook").mode("append").options(path=path, part=f"{path}.{uuid.uuid4().hex}.part", sheet=sheet, rows=rows, allowed=json.dumps(layout.allowed), widths=json.dumps(layout.widths)).save()


def read_workbooks(spark: SparkSession, path: str, columns: list[str], sheet: str = "labels", label_col: str | None = "label") -> DataFrame:
    """The rows of all books as text; labels are trimmed and lower-cased, and null where blank."""
    spark.dataSource.register(WorkbookSource)
    found = spark.read.format("workbook").schema(_text_schema(columns)).options(path=_uri(path), sheet=sheet).load()
    return found.select(*[F.nullif(F.lower(F.trim(F.col(c))), F.lit("")).alias(c) if c == label_col else F.col(c) for c in columns])


def workbook_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reviews as workbooks to label, half of them labelled in capitals and with blanks, some texts like formulas, and read back."""
    i = F.col("review_id")
    mark = F.element_at(F.array(*[F.lit(m) for m in ("=", "+", "-", "@", "")]), (i % 5 + 1).cast("int"))
    label = F.when(i % 2 == 0, F.concat(F.lit(" "), F.upper("pred_label"))).when(i % 3 == 0, "  ")
    rows = view(spark, sf_dir, "reviews").select(F.concat(F.lit("G"), i.cast("string")).alias("gold_id"), F.concat(mark, F.col("text_clean")).alias("text_clean"), label.alias("label"), F.when(i % 7 == 0, "line\none, <two> & \"three\"").alias("notes"))
    path = new_path(spark, "books")
    write_workbooks(rows, path, allowed={"label": ["negative", "neutral", "positive"]}, widths={"text_clean": 80, "label": 12})
    return read_workbooks(spark, path, ["gold_id", "text_clean", "label", "notes"])


QUERIES["workbook_labels"] = workbook_labels
ORACLES["workbook_labels"] = duck(
    "SELECT 'G' || CAST(review_id AS STRING) AS gold_id, CASE review_id % 5 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' ELSE '' END || text_clean AS text_clean, "
    "CASE WHEN review_id % 2 = 0 THEN pred_label END AS label, CASE WHEN review_id % 7 = 0 THEN 'line' || chr(10) || 'one, <two> & \"three\"' END AS notes FROM {reviews}"
)
