"""Workbooks (.xlsx) as a source and a sink of Spark, without a spreadsheet library.

``spark.read.format("workbook")`` takes a file or a folder; each workbook is a partition, and its sheet
is parsed as a stream, so a task holds the workbook's shared strings and one row. Every value
is text, as the quote rows want it; row_idx rises by file and row. ``df.write.format("workbook")``
streams each partition into a workbook of its own, in further sheets beyond the rows that a sheet can hold.

Paths must be mounted on all executors, or be URIs that pyarrow knows.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterator
from typing import IO
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StringType, StructField, StructType

# Fixed values of the file format: name spaces, the parts of a package, and the rows of a sheet.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINKS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
TYPES = """<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>%s</Types>"""
SHEET_TYPE = """<Override PartName="/xl/worksheets/sheet%d.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>"""
RELATIONS = """<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">%s</Relationships>"""
RELATION = """<Relationship Id="%s" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/%s" Target="%s"/>"""
WORKBOOK = """<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>%s</sheets></workbook>"""
SHEET = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>"""
SHEET_ROWS = 1_048_576


def _files(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def listed(path: str) -> list[str]:
    """The workbooks at a path, by name; FileNotFoundError if there is nothing."""
    from pyarrow import fs

    system, at = _files(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    found = sorted(f.path for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and f.base_name.lower().endswith(".xlsx") and not f.base_name.startswith(("~", ".")))
    prefix = path.split("://")[0] + "://" if "://" in path else ""
    return [prefix + f for f in found]


def _column(reference: str) -> int:
    """The number from 0 of a cell's column: A, B, ..., Z, AA."""
    at = 0
    for c in reference:
        if not c.isalpha():
            break
        at = at * 26 + ord(c.upper()) - 64
    return at - 1


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as part:
        for _, item in ElementTree.iterparse(part):
            if item.tag == f"{MAIN}si":
                # phonetic hints (rPh) are no part of the text
                runs = [t for child in item if child.tag != f"{MAIN}rPh" for t in child.iter(f"{MAIN}t")]
                out.append("".join(t.text or "" for t in runs))
                item.clear()
    return out


def _sheet_part(book: zipfile.ZipFile, sheet: str | None) -> str:
    """The part of a sheet by its name; the first sheet's if there is none of the name."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheets = [(s.get("name"), s.get(f"{LINKS}id")) for s in root.iter(f"{MAIN}sheet")]
    links = {r.get("Id"): r.get("Target") or "" for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = links[dict(sheets).get(sheet, sheets[0][1])]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _value(cell: ElementTree.Element, strings: list[str]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    value = cell.findtext(f"{MAIN}v")
    if value is None or kind == "e":
        return None
    if kind == "s":
        return strings[int(value)]
    if kind == "b":
        return "true" if value == "1" else "false"
    # numbers as a spreadsheet shows them: 5 and not 5.0
    return str(int(float(value))) if kind in (None, "n") and re.fullmatch(r"-?\d{1,15}(\.0+)?", value) else value


def rows_of(stream: IO[bytes], sheet: str | None = None) -> Iterator[list[str | None]]:
    """The rows of a workbook's sheet in order, the header first; empty rows are left out."""
    with zipfile.ZipFile(stream) as book:
        strings = _shared(book)
        with book.open(_sheet_part(book, sheet)) as part:
            data = None
            for event, item in ElementTree.iterparse(part, ("start", "end")):
                if item.tag == f"{MAIN}sheetData":
                    data = item
                if event != "end" or item.tag != f"{MAIN}row":
                    continue
                row: list[str | None] = []
                for cell in item.iter(f"{MAIN}c"):
                    at = _column(cell.get("r") or "") if cell.get("r") else len(row)
                    row.extend([None] * (at + 1 - len(row)))
                    row[at] = _value(cell, strings)
                if any(v is not None for v in row):
                    yield row
                data.clear()  # rows that were read are let go


class _Book(InputPartition):
    def __init__(self, number: int, path: str):
        self.number, self.path = number, path


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns = schema.fieldNames()
        self.sheet, self.path = options.get("sheet"), options["path"]

    def partitions(self) -> list[InputPartition]:
        return [_Book(k, path) for k, path in enumerate(listed(self.path))]

    def read(self, partition: _Book) -> Iterator[tuple]:
        system, at = _files(partition.path)
        with system.open_input_file(at) as stream:
            rows = rows_of(stream, self.sheet)
            header = next(rows, [])
            places = {}
            for k, name in enumerate(header):
                places.setdefault(name, k)
            # row_idx of a later file is higher than any of an earlier one
            for number, row in enumerate(rows):
                cell = lambda c, row=row: row[places[c]] if c in places and places[c] < len(row) else None
                yield tuple(partition.number * SHEET_ROWS + number if c == "row_idx" else partition.path if c == "_file" else cell(c) for c in self.columns)


class _Done(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class _Writer(DataSourceWriter):
    """Tasks write aside; the commit gives the files their names, so a reader sees none that is half written."""

    def __init__(self, schema: StructType, options: dict):
        self.columns, self.folder, self.sheet = schema.fieldNames(), options["path"].rstrip("/"), options.get("sheet", "Sheet1")

    def write(self, iterator: Iterator) -> _Done:
        first = next(iterator, None)
        if first is None:
            return _Done(None)
        system, folder = _files(self.folder)
        system.create_dir(folder)
        path = f"{folder}/.{uuid.uuid4().hex}.xlsx"

        def rows() -> Iterator[list]:
            yield list(first)
            yield from map(list, iterator)

        with system.open_output_stream(path) as out:
            write_workbook(out, {self.sheet: (self.columns, rows())})
        return _Done(path)

    def commit(self, messages: list) -> None:
        system, folder = _files(self.folder)
        for k, path in enumerate(m.path for m in messages if m and m.path):
            system.move(path, f"{folder}/part-{k:05d}-{uuid.uuid4().hex[:8]}.xlsx")

    def abort(self, messages: list) -> None:
        system, _ = _files(self.folder)
        for m in messages:
            if m and m.path:
                system.delete_file(m.path)


class Workbook(DataSource):
    """The format ``workbook``. Columns are the header of the first workbook unless a schema is given; options: path, sheet."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        system, at = _files(listed(self.options["path"])[0])
        with system.open_input_file(at) as stream:
            header = next(rows_of(stream, self.options.get("sheet")), [])
        names = list(dict.fromkeys(h for h in header if h))
        return StructType([StructField("row_idx", LongType()), *[StructField(n, StringType()) for n in names]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(schema, dict(self.options))


def _cell(value: object) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float):
        return f"<c><v>{value!r}</v></c>"
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value))  # what XML can't hold
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write_workbook(out: IO[bytes], sheets: dict[str, tuple[list[str], Iterator[list]]]) -> None:
    """Streams named sheets (header, rows) into a workbook; a sheet that is full goes on in another one."""
    names: list[str] = []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, (header, rows) in sheets.items():
            rows, more = iter(rows), True
            while more:
                names.append(name if name not in names else f"{name} {len(names) + 1}")
                more = False
                with book.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as part:
                    part.write(SHEET.encode())
                    part.write(("<row>" + "".join(map(_cell, header)) + "</row>").encode())
                    for k, row in enumerate(rows, 2):
                        part.write(("<row>" + "".join(map(_cell, row)) + "</row>").encode())
                        if k == SHEET_ROWS:
                            more = True
                            break
                    part.write(b"</sheetData></worksheet>")
        book.writestr("[Content_Types].xml", TYPES % "".join(SHEET_TYPE % (k + 1) for k in range(len(names))))
        book.writestr("_rels/.rels", RELATIONS % (RELATION % ("rId1", "officeDocument", "xl/workbook.xml")))
        listed_sheets = "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1))
        book.writestr("xl/workbook.xml", WORKBOOK % listed_sheets)
        book.writestr("xl/_rels/workbook.xml.rels", RELATIONS % "".join(RELATION % (f"rId{k}", "worksheet", f"worksheets/sheet{k}.xml") for k in range(1, len(names) + 1)))


def read_workbooks(spark: SparkSession, path: str, columns: dict[str, str], sheet: str | None = None) -> DataFrame:
    """Quote rows of the workbooks at a path: row_idx and the columns, renamed; a column that a workbook lacks is null.

    A sheet that a workbook lacks is replaced by its first one; a path with nothing is an error.
    """
    listed(path)
    spark.dataSource.register(Workbook)
    schema = StructType([StructField("row_idx", LongType()), *[StructField(c, StringType()) for c in columns]])
    reader = spark.read.format("workbook").schema(schema)
    rows = (reader.option("sheet", sheet) if sheet else reader).load(path)
    return rows.select("row_idx", *[F.col(f"`{old}`").alias(new) for old, new in columns.items()])


def write_workbooks(df: DataFrame, path: str, sheet: str = "Sheet1") -> None:
    """A workbook for each partition of ``df`` that has rows."""
    df.sparkSession.dataSource.register(Workbook)
    df.write.format("workbook").option("sheet", sheet).mode("append").save(path)


def write_cart(lines: DataFrame, summary: DataFrame, path: str) -> None:
    """One user's cart as a workbook of two sheets: the key figures, and a row for each unit. A cart is small by its nature."""
    rows = lines.toLocalIterator()
    figures = summary.first()
    system, at = _files(path)
    with system.open_output_stream(at) as out:
        write_workbook(out, {"Resumo": (list(figures.asDict()), iter([list(figures)])), "Itens": (lines.columns, map(list, rows))})
