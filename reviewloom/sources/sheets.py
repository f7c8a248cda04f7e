"""Cells of spreadsheet workbooks (zip archives of XML parts): read by as many tasks as there are workbooks, and written."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import ship

# Names of the format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
CONTENT = "http://schemas.openxmlformats.org/package/2006/content-types"
TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml."

#: cells of a batch
CELLS = 1 << 14


def _elements(part, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a name in an XML part, one at a time; what has been read is dropped."""
    above = []
    for event, e in ElementTree.iterparse(part, ("start", "end")):
        if event == "start":
            above.append(e)
            continue
        above.pop()
        if e.tag == tag:
            yield e
            e.clear()
            if above:
                above[-1].remove(e)


def _text(e: ElementTree.Element) -> str:
    """The text of an entry: its own, or that of its formatted runs (phonetic hints left out)."""
    runs = [t.text or "" for r in e if r.tag in (f"{{{MAIN}}}t", f"{{{MAIN}}}r") for t in ([r] if r.tag.endswith("}t") else r.findall(f"{{{MAIN}}}t"))]
    return "".join(runs)


def column_number(reference: str) -> int:
    """The column of a cell such as B7, from 0."""
    n = 0
    for ch in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def column_name(number: int) -> str:
    out, n = "", number + 1
    while n:
        n, digit = divmod(n - 1, 26)
        out = chr(65 + digit) + out
    return out


def read_workbook(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, value as text) of all cells with a value, rows and columns from 0, sheets in their order.

    Shared and inline strings, numbers, formula results and errors are given as they stand, booleans as TRUE and FALSE. Rows and
    cells without a reference follow the one before. Sheets are streamed; the table of shared strings is held.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with z.open("xl/sharedStrings.xml") as part:
                shared = [_text(e) for e in _elements(part, f"{{{MAIN}}}si")]
        with z.open("xl/_rels/workbook.xml.rels") as part:
            target = {e.get("Id"): e.get("Target") for e in _elements(part, f"{{{PACKAGE}}}Relationship")}
        with z.open("xl/workbook.xml") as part:
            sheets = [(e.get("name"), target[e.get(f"{{{OFFICE}}}id")]) for e in _elements(part, f"{{{MAIN}}}sheet")]
        for name, at in sheets:
            row = -1
            with z.open(at.lstrip("/") if at.startswith("/") else f"xl/{at}") as part:
                for r in _elements(part, f"{{{MAIN}}}row"):
                    row, column = int(r.get("r")) - 1 if r.get("r") else row + 1, -1
                    for c in r.findall(f"{{{MAIN}}}c"):
                        column = column_number(c.get("r")) if c.get("r") else column + 1
                        kind, v = c.get("t"), c.find(f"{{{MAIN}}}v")
                        if kind == "inlineStr":
                            inline = c.find(f"{{{MAIN}}}is")
                            value = None if inline is None else _text(inline)
                        elif v is None or v.text is None:
                            value = None
                        else:
                            value = shared[int(v.text)] if kind == "s" else {"0": "FALSE", "1": "TRUE"}[v.text] if kind == "b" else v.text
                        if value is not None:
                            yield name, row, column, value


def cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row_idx, col_idx, value) of all workbooks (*.xlsx) of a folder, or of one; a task reads a workbook at a time."""
    ship(spark)

    def run(batches):
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1)):
                held = []
                for cell in read_workbook(content.as_py()):
                    held.append((file, *cell))
                    if len(held) == CELLS:
                        yield _batch(held)
                        held = []
                if held:
                    yield _batch(held)

    def _batch(rows):
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "sheet", "row_idx", "col_idx", "value"])

    books = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    return books.mapInArrow(run, "file string, sheet string, row_idx long, col_idx int, value string")


def report_cells(cells: DataFrame, columns: int = 7) -> DataFrame:
    """Cells as rows of report sheets: (sheet, row_idx, c0 ... c6), null where a cell is empty; further columns are left out."""
    value = lambda i: F.max(F.when(F.col("col_idx") == i, F.col("value"))).alias(f"c{i}")
    return cells.groupBy("file", "sheet", "row_idx").agg(*[value(i) for i in range(columns)]).drop("file")


def workbook(sheets: list[tuple[str, list[tuple[int, list[str | float | None]]]]]) -> bytes:
    """A workbook of sheets (name, rows of (row number from 0, values)): texts as shared strings, numbers as numbers."""
    shared: dict[str, int] = {}

    def cell(row: int, column: int, v) -> str:
        if v is None:
            return ""
        at = f"{column_name(column)}{row + 1}"
        if isinstance(v, str):
            return f'<c r="{at}" t="s"><v>{shared.setdefault(v, len(shared))}</v></c>'
        return f'<c r="{at}"><v>{v!r}</v></c>'

    head, out = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n', io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        put = lambda name, body: z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), head + body)
        for i, (_, rows) in enumerate(sheets, 1):
            body = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(values)) + "</row>" for r, values in rows)
            put(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>')
        put("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(f'<si><t xml:space="preserve">{escape(t)}</t></si>' for t in shared) + "</sst>")
        names = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, (n, _) in enumerate(sheets, 1))
        put("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}">{links}<Relationship Id="rId0" Type="{OFFICE}/sharedStrings" Target="sharedStrings.xml"/></Relationships>')
        put("_rels/.rels", f'<Relationships xmlns="{PACKAGE}"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{TYPE}worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        put("[Content_Types].xml", f'<Types xmlns="{CONTENT}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{TYPE}sheet.main+xml"/><Override PartName="/xl/sharedStrings.xml" ContentType="{TYPE}sharedStrings+xml"/>{parts}</Types>')
    return out.getvalue()


def write_workbooks(rows: DataFrame, book: Column, path: str, columns: int = 7) -> None:
    """rows (sheet, row_idx, c0 ...) as one workbook for each value of `book`, `path`/<book>.xlsx: built by tasks, streamed into files one by one.

    A text that reads as a number is written as one. The rows of a workbook are held by the task that builds it.
    """
    spark = rows.sparkSession
    ship(spark)
    names = [f"c{i}" for i in range(columns)]

    def number(v):
        try:
            return float(v) if v is not None and v.strip() == v and "_" not in v and float(v) - float(v) == 0 else v
        except ValueError:
            return v

    def build(table: pa.Table) -> pa.Table:
        sheets: dict[str, list] = {}
        for r in table.sort_by([("sheet", "ascending"), ("row_idx", "ascending")]).to_pylist():
            sheets.setdefault(r["sheet"], []).append((r["row_idx"], [number(r[c]) for c in names]))
        return pa.table({"book": table.column("book")[:1], "content": pa.array([workbook(list(sheets.items()))], pa.binary())})

    books = rows.select(book.cast("string").alias("book"), "sheet", "row_idx", *[F.col(c).cast("string").alias(c) for c in names]).groupBy("book").applyInArrow(build, "book string, content binary")
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in books.toLocalIterator():
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/{r['book']}.xlsx")
        out = target.getFileSystem(conf).create(target, True)
        try:
            out.write(bytearray(r["content"]))
        finally:
            out.close()
