"""Spreadsheets (.xlsx) as a data source of Spark: spark.read.format("xlsx").load(path), df.write.format("xlsx").

A workbook is a zip of XML files: its sheets, and the table of strings that their cells refer to by number. The driver reads
only a workbook's directory, its sheet's first rows and the strings of its headings; ranges of rows are the partitions, and
small workbooks, which the driver does not open, share one with their neighbours, in order. A task inflates the sheet up to its range, parses that range alone, and then keeps of the strings only those that it met, so
its memory follows the range. Files are opened through pyarrow's file systems (local, HDFS, S3, GCS).

Reading, options: path (a file or a folder of .xlsx files), sheet (name or number from 0; "0"), header ("true": the first row
has the headings, taken from the first file; else columns are _c0, _c1, ...), rowNumber (name of a column for the row's number,
the first data row being 0; none by default), rows (rows of a partition). All columns are strings, as of a CSV file: numbers
in their shortest form, dates (by the cell's format) as ISO text, booleans as true and false; empty cells and texts and
error values are null. Repeated headings get .1, .2, ... appended, blank ones are _c<place>. A file without a heading has nulls there.

Writing (append or overwrite): each task writes workbooks of one sheet, Sheet1, with headings, of at most `rows` rows; they
appear when the job commits. Numbers are written as numbers, booleans as booleans, everything else as text, nulls as no cell.
"""

from __future__ import annotations

import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from xml.etree.ElementTree import XMLPullParser, iterparse
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Rows of a partition, and rows that a sheet can have.
ROWS, SHEET_ROWS = 20_000, 1_048_576
#: Bytes of neighbouring workbooks that make a partition; of one workbook that is not opened to be cut.
TOGETHER_BYTES, SMALL_BYTES = 1 << 20, 1 << 18
_CHUNK = 1 << 18
#: Longest beginning of a tag that is looked for.
_TAG = 64
_ROOT = re.compile(rb"<(?:\w+:)?worksheet\b[^>]*>")
_DECLARED = re.compile(rb"xmlns(?::\w+)?=(?:\"[^\"]*\"|'[^']*')")
_ROW = re.compile(rb"<(?:\w+:)?row(?=[\s/>])")
_STOP = re.compile(rb"</(?:\w+:)?sheetData")
_CONTROL = re.compile(r"[\x00-\x08\x0b-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
# Numbers of the built-in formats that show dates or times.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path):
        return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pa.fs.LocalFileSystem(), path


def _sizes(path: str) -> list[tuple[str, int]]:
    """The workbooks of a folder in order of name, without hidden ones and those being written, or the one file; and bytes."""
    fs, at = _file_system(path)
    (info,) = fs.get_file_info([at])
    if info.type == pa.fs.FileType.File:
        return [(at, info.size)]
    found = [(f.path, f.size) for f in fs.get_file_info(pa.fs.FileSelector(at, recursive=False)) if f.is_file]
    return sorted(f for f in found if f[0].endswith(".xlsx") and posixpath.basename(f[0])[0] not in "._~")


def _files(path: str) -> list[str]:
    return [f for f, _ in _sizes(path)]


def _tag(element) -> str:
    return element.tag.rpartition("}")[2]


def _plain(text: str) -> str:
    """Text with _xHHHH_, which stands for characters that XML cannot hold, resolved."""
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def _held(text: str) -> str:
    return escape(_CONTROL.sub(lambda m: f"_x{ord(m[0]):04X}_", text))


def _string(element) -> str:
    """Text of a string: its own, or that of its runs; reading aids (rPh) are no part of it."""
    parts = []
    for child in element:
        if _tag(child) == "t":
            parts.append(child.text or "")
        elif _tag(child) == "r":
            parts += [x.text or "" for x in child if _tag(x) == "t"]
    return _plain("".join(parts))


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _letters(column: int) -> str:
    out = ""
    column += 1
    while column:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


def _number(text: str) -> str:
    """A number in its shortest form."""
    try:
        x = float(text)
    except ValueError:
        return text
    if x == int(x) if abs(x) < 1e15 else False:
        return str(int(x))
    return repr(x)


def _date(text: str, from_1904: bool) -> str:
    """A day number as ISO text; a fraction of a day alone is a time."""
    try:
        days = float(text)
    except ValueError:
        return text
    # days up to 59 are counted from the 31st, later ones past a 29 February 1900 that never was
    start = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 31 if days < 60 else 30)
    at = start + timedelta(seconds=round(days * 86400))
    if days < 1 and not from_1904:
        return at.time().isoformat()
    return at.date().isoformat() if at.time().isoformat() == "00:00:00" else at.isoformat(" ")


class Workbook:
    """One open workbook: its sheets, strings and formats, each read from its part of the zip as a stream."""

    def __init__(self, fs: pa.fs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        self.zip = zipfile.ZipFile(self.file)
        names = {n.lower(): n for n in self.zip.namelist()}
        book = names.get("xl/workbook.xml", "xl/workbook.xml")
        self.sheets, self.from_1904 = [], False
        for e in self._parts(book):
            if _tag(e) == "sheet":
                self.sheets.append((e.get("name"), next(v for k, v in e.attrib.items() if k.rpartition("}")[2] == "id")))
            elif _tag(e) == "workbookPr":
                self.from_1904 = e.get("date1904") in ("1", "true")
        targets = {e.get("Id"): e.get("Target") for e in self._parts("xl/_rels/workbook.xml.rels") if _tag(e) == "Relationship"}
        inside = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(f"xl/{t}")
        self.sheets = [(n, inside(targets[i])) for n, i in self.sheets]
        self.strings = names.get("xl/sharedstrings.xml")
        self.styles = names.get("xl/styles.xml")
        self._dates: list[bool] | None = None

    def __enter__(self) -> Workbook:
        return self

    def __exit__(self, *_) -> None:
        self.zip.close()
        self.file.close()

    def _parts(self, name: str):
        """Every element of a part when it is complete; what its user is done with is dropped."""
        with self.zip.open(name) as f:
            for _, e in iterparse(f):
                yield e

    def sheet(self, wanted: str) -> str:
        """The part of a sheet by name or else by number."""
        for name, part in self.sheets:
            if name == wanted:
                return part
        if wanted.isdigit() and int(wanted) < len(self.sheets):
            return self.sheets[int(wanted)][1]
        raise ValueError(f"no sheet {wanted!r}; there are {[n for n, _ in self.sheets]}")

    def shown_as_dates(self) -> list[bool]:
        """For each cell style, whether its number format shows a date or a time."""
        if self._dates is None:
            own, styles = {}, []
            if self.styles:
                for e in self._parts(self.styles):
                    if _tag(e) == "numFmt":
                        code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", e.get("formatCode") or "")
                        own[int(e.get("numFmtId"))] = bool(re.search("[ymdhs]", code, re.I)) and code.lower() != "general"
                    elif _tag(e) == "cellXfs":
                        styles = [int(x.get("numFmtId") or 0) for x in e if _tag(x) == "xf"]
            self._dates = [own.get(k, k in _DATE_FORMATS) for k in styles]
        return self._dates

    def rows(self, part: str, first: int, end: int | None) -> Iterator[list[tuple[int, str, str]]]:
        """(column, kind, value) of the cells of rows first to end - 1, by their place among the sheet's row elements.

        Rows before the range are only looked for in the inflated bytes. Kinds: s (number of a shared string), b, d (shown as
        a date), n, str.
        """
        seen, held = 0, b""
        parser, root, done = None, None, 0
        with self.zip.open(part) as f:
            while parser is None:
                chunk = f.read(_CHUNK)
                held += chunk
                # the range becomes a document of its own, whose root declares what the sheet's root declares
                root = root or b"<rows " + b" ".join(_DECLARED.findall(_ROOT.search(held)[0])) + b">"
                at = 0
                for m in _ROW.finditer(held, 0, max(0, len(held) - _TAG) if chunk else len(held)):
                    if seen == first:
                        parser = XMLPullParser()
                        parser.feed(root)
                        held = held[m.start() :]
                        break
                    seen, at = seen + 1, m.end()
                else:
                    if not chunk:
                        return
                    held = held[max(at, len(held) - 2 * _TAG) :]
            while True:
                # what follows the last row belongs to other elements
                stop = _STOP.search(held)
                parser.feed(held[: stop.start()] if stop else held[:-_TAG])
                held = b"" if stop else held[-_TAG:]
                for _, e in parser.read_events():
                    if _tag(e) == "row":
                        if end is not None and first + done >= end:
                            return
                        yield self._cells(e)
                        e.clear()
                        done += 1
                if stop:
                    return
                chunk = f.read(_CHUNK)
                if not chunk:
                    return
                held += chunk

    def _cells(self, row) -> list[tuple[int, str, str]]:
        out, at = [], 0
        for c in row:
            if _tag(c) != "c":
                continue
            at = _column(c.get("r")) if c.get("r") else at
            kind, value = c.get("t") or "n", None
            for x in c:
                if _tag(x) == "v":
                    value = x.text
                elif _tag(x) == "is":
                    kind, value = "str", _string(x)
            if value is not None and kind != "e":
                if kind == "n" and c.get("s"):
                    dates, style = self.shown_as_dates(), int(c.get("s"))
                    kind = "d" if style < len(dates) and dates[style] else "n"
                elif kind == "d":  # already ISO text
                    kind = "str"
                out.append((at, kind, _plain(value) if kind == "str" and c.get("t") == "str" else value))
            at += 1
        return out

    def named(self, wanted: set[int]) -> dict[int, str]:
        """The shared strings of these numbers."""
        found: dict[int, str] = {}
        if not wanted or not self.strings:
            return found
        n, last = 0, max(wanted)
        for e in self._parts(self.strings):
            if _tag(e) == "si":
                if n in wanted:
                    found[n] = _string(e)
                n += 1
                e.clear()
                if n > last:
                    break
        return found

    def texts(self, rows: list[list[tuple[int, str, str]]]) -> list[dict[int, str | None]]:
        """Each row's cells as text by column."""
        strings = self.named({int(v) for r in rows for _, k, v in r if k == "s"})
        said = {"s": lambda v: strings.get(int(v)), "b": lambda v: "true" if v.strip() in ("1", "true") else "false", "n": _number, "d": lambda v: _date(v, self.from_1904), "str": str}
        return [{c: said.get(k, str)(v) or None for c, k, v in r} for r in rows]

    def size(self, part: str) -> int | None:
        """Rows by the sheet's own word, which need not be right; None if it says nothing."""
        with self.zip.open(part) as f:
            m = re.search(rb"<(?:\w+:)?dimension\b[^>]*\bref=\"[A-Z]+\d+:[A-Z]+(\d+)\"", f.read(1 << 14))
        return int(m[1]) if m else None

    def first(self, part: str) -> dict[int, str | None]:
        for r in self.rows(part, 0, 1):
            return self.texts([r])[0]
        return {}


def _headings(first: dict[int, str | None], header: bool) -> list[str]:
    out: list[str] = []
    for i in range(max(first, default=-1) + 1):
        name = (first.get(i) or f"_c{i}") if header else f"_c{i}"
        unique, n = name, 0
        while unique in out:
            n += 1
            unique = f"{name}.{n}"
        out.append(unique)
    return out


@dataclass
class _Range:
    file: str
    first: int
    end: int | None


@dataclass
class _Ranges(InputPartition):
    ranges: list[_Range]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.sheet = options["path"], options.get("sheet", "0")
        self.header = options.get("header", "true").lower() == "true"
        self.number = options.get("rownumber")
        self.size = int(options.get("rows", ROWS))
        self.cut = "rows" in options
        self.schema = schema

    def partitions(self) -> list[_Ranges]:
        fs, _ = _file_system(self.path)
        out: list[_Ranges] = []
        held = TOGETHER_BYTES
        for file, size in _sizes(self.path):
            if size <= SMALL_BYTES and not self.cut:
                if held + size > TOGETHER_BYTES:
                    out.append(_Ranges([]))
                    held = 0
                out[-1].ranges.append(_Range(file, int(self.header), None))
                held += size
                continue
            with Workbook(fs, file) as w:
                rows = w.size(w.sheet(self.sheet))
            # the last range has no end, whatever the sheet says of its size
            starts = list(range(int(self.header), max(rows or 0, int(self.header) + 1), self.size))
            out += [_Ranges([_Range(file, a, b)]) for a, b in zip(starts, [*starts[1:], None], strict=True)]
            held = TOGETHER_BYTES
        return out

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        for some in partition.ranges:
            yield from self._range(some)

    def _range(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        fs, _ = _file_system(self.path)
        names = [f.name for f in self.schema.fields if f.name != self.number]
        with Workbook(fs, partition.file) as w:
            part = w.sheet(self.sheet)
            headings = _headings(w.first(part), self.header)
            place = [headings.index(n) if n in headings else int(n[2:]) if not self.header else None for n in names]
            first, rows = partition.first, []

            def batch() -> pa.RecordBatch:
                texts = w.texts(rows)
                columns = {n: pa.array([t.get(i) for t in texts], pa.string()) for n, i in zip(names, place, strict=True)}
                if self.number:
                    columns[self.number] = pa.array(range(first - self.header, first - self.header + len(rows)), pa.int64())
                return pa.RecordBatch.from_pydict({f.name: columns[f.name] for f in self.schema.fields})

            for r in w.rows(part, partition.first, partition.end):
                rows.append(r)
                if len(rows) == self.size:
                    yield batch()
                    first, rows = first + len(rows), []
            if rows:
                yield batch()


# The parts of a workbook with one sheet.
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def _cell(column: int, row: int, value) -> str:
    if value is None:
        return ""
    at = f'r="{_letters(column)}{row}"'
    if isinstance(value, bool):
        return f'<c {at} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int) or (isinstance(value, float) and value - value == 0):
        return f"<c {at}><v>{value!r}</v></c>"
    return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{_held(str(value))}</t></is></c>'


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.size = min(int(options.get("rows", SHEET_ROWS - 1)), SHEET_ROWS - 1)
        self.names = schema.names
        self.staging = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        fs, at = _file_system(self.path)
        fs.create_dir(f"{at}/{self.staging}", recursive=True)
        task, files = TaskContext.get(), []

        def rows():
            for b in iterator:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        left = rows()
        while (following := next(left, None)) is not None:
            # a task that is run again writes names of its own; those of the run that counts are moved. Names sort as rows do
            name = f"part-{task.partitionId():07d}-{len(files):09d}-{task.taskAttemptId()}.xlsx"
            with fs.open_output_stream(f"{at}/{self.staging}/{name}") as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
                for part, text in _PARTS.items():
                    z.writestr(part, text)
                with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
                    f.write(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
                    n, row = 1, tuple(self.names)
                    while row is not None:
                        f.write(f'<row r="{n}">{"".join(_cell(i, n, v) for i, v in enumerate(row))}</row>'.encode())
                        row, following = following, None
                        n += 1
                        if row is None and n <= self.size + 1:
                            row = next(left, None)
                    f.write(b"</sheetData></worksheet>")
            files.append(name)
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, at = _file_system(self.path)
        fs.create_dir(at, recursive=True)
        if self.overwrite:
            for f in _files(self.path):
                fs.delete_file(f)
        for m in messages:
            for name in m.files if m else []:
                fs.move(f"{at}/{self.staging}/{name}", f"{at}/{name}")
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        fs, at = _file_system(self.path)
        if fs.get_file_info([f"{at}/{self.staging}"])[0].type == pa.fs.FileType.Directory:
            fs.delete_dir(f"{at}/{self.staging}")


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> StructType:
        """Headings of the first file, all strings."""
        options = {k.lower(): v for k, v in self.options.items()}
        files = _files(options["path"])
        if not files:
            raise ValueError(f"no .xlsx file at {options['path']}")
        fs, _ = _file_system(options["path"])
        with Workbook(fs, files[0]) as w:
            names = _headings(w.first(w.sheet(options.get("sheet", "0"))), options.get("header", "true").lower() == "true")
        fields = [StructField(n, StringType()) for n in names]
        if options.get("rownumber"):
            fields.append(StructField(options["rownumber"], LongType()))
        return StructType(fields)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()}, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer({k.lower(): v for k, v in self.options.items()}, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxSource)


def read_xlsx(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("xlsx").options(**options).load(path)


def write_xlsx(df: DataFrame, path: str, overwrite: bool = False, **options: str) -> None:
    register(df.sparkSession)
    df.write.format("xlsx").options(**options).mode("overwrite" if overwrite else "append").save(path)
