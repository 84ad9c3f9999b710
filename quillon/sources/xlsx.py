"""Workbooks as tables of cells: a Python data source that reads by byte range, and pulls cells from the XML.

``register(spark)`` then ``spark.read.format("xlsx_cells").load(path)`` reads a file, folder or glob of any file system
that pyarrow knows (file:, hdfs:, s3:, gs:): file, sheet_ix, sheet, part, row_ix, col_ix, ref, value, is_num. The driver
reads the directory of each workbook, a few kilobytes from its end and its list of sheets, and each sheet is a partition; of up to
``DIRECTORIES`` files, beyond which a partition is a file and workers read the directories. A sheet is unpacked and parsed as it is
read, row by row, and shared strings are spooled to the worker's disk, so a workbook may be larger than memory.

Equality and IN filters on file, sheet, sheet_ix, part and col_ix are pushed down: sheets that don't match
aren't opened, cells of other columns not made. ``from_binary`` gives the same rows over Spark's own binaryFile reader, for stores that only Spark reads; there a file's bytes are in memory.

``order``: "workbook" (as listed) or "part" (by part name, as text). A dump by part keeps raw text.
"""

from __future__ import annotations

import array
import fnmatch
import io
import os
import re
import tempfile
import zipfile
from functools import lru_cache
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from quillon import storage

# The XML names of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
RELATION = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
STRINGS = "xl/sharedStrings.xml"
SCHEMA = "file string, sheet_ix int, sheet string, part string, row_ix int, col_ix int, ref string, value string, is_num boolean"
#: Files whose directories the driver reads; cells of a batch.
DIRECTORIES = 10_000
BATCH = 10_000
#: Tasks for each core that sheets of files in memory are dealt to.
SHEETS = 4


def _inner_text(node) -> str:
    return "".join(t.text or "" for t in node.iter(MAIN + "t"))


def ordinal(ref: str) -> int:
    n = 0
    for c in re.match("[A-Za-z]*", ref)[0].upper():
        n = n * 26 + ord(c) - 64
    return max(n - 1, 0)


def _part(target: str) -> str:
    target = target.replace("\\", "/") if target.startswith(("/", "xl/")) else "xl/" + target.replace("\\", "/").lstrip("/")
    return target.lstrip("/")


def _shown(kind: str | None, cell, strings) -> tuple[str, bool]:
    """(text of a cell, whether it is a number)."""
    if kind == "inlineStr":
        return _inner_text(cell), False
    v = cell.find(MAIN + "v")
    raw = "" if v is None else v.text or ""
    if v is None or kind in ("str", "e"):
        return raw, False
    if kind == "s":
        known = raw.strip().lstrip("-").isdigit() and -len(strings) <= int(raw) < len(strings)
        return (strings[int(raw)] if known else raw), False
    try:
        x = float(raw.strip().replace(",", "."))
    except ValueError:
        return raw, False
    if x != x or x in (float("inf"), float("-inf")):
        return raw, False
    return (str(int(x)) if x.is_integer() else repr(x)), True


class _Strings:
    """Shared strings by number, on disk: eight bytes of each are in memory."""

    def __init__(self, book: zipfile.ZipFile):
        self.file, self.ends, at = tempfile.TemporaryFile(), array.array("q"), 0
        if STRINGS in book.NameToInfo:
            with book.open(STRINGS) as f:
                for node in _children(f, MAIN + "si", 1):
                    data = _inner_text(node).encode("utf-8", "surrogatepass")
                    self.file.write(data)
                    at += len(data)
                    self.ends.append(at)
        self.known = lru_cache(maxsize=10_000)(self._read)

    def __len__(self) -> int:
        return len(self.ends)

    def __getitem__(self, k: int) -> str:
        return self.known(k + len(self.ends) if k < 0 else k)

    def _read(self, k: int) -> str:
        start = self.ends[k - 1] if k else 0
        self.file.seek(start)
        return self.file.read(self.ends[k] - start).decode("utf-8", "surrogatepass")


def _children(stream, tag: str, depth: int):
    """Elements ``tag`` at a depth below the root, each dropped when the next is asked for; nothing else is kept either."""
    stack: list = []
    for event, node in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            stack.append(node)
            continue
        stack.pop()
        if len(stack) == depth and node.tag == tag:
            yield node
            stack[-1].clear()
        elif 0 < len(stack) < depth:
            stack[-1].clear()


def sheets_of(book: zipfile.ZipFile, order: str = "workbook") -> list[tuple[int, str, str]]:
    """(sheet_ix, name, part) of the sheets that are there."""
    parts = set(book.namelist())
    targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(RELATION)}
    sheets = []
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).findall(f"{MAIN}sheets/{MAIN}sheet"):
        part = _part(targets.get(s.get(LINK), ""))
        sheets.append((s.get("name", part), part))
    if order == "part":
        names = {os.path.basename(p): n for n, p in sheets}
        listed = sorted(p for p in parts if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", p))
        sheets = [(names.get(os.path.basename(p), p), p) for p in listed]
    return [(k, name, part) for k, (name, part) in enumerate(x for x in sheets if x[1] in parts)]


def sheet_cells(book: zipfile.ZipFile, part: str, strings=None, columns: set[int] | None = None):
    """(row_ix, col_ix, ref, value, is_num) of a sheet's cells; rows without cells have no number, holes are not rows."""
    row_ix = 0
    with book.open(part) as f:
        for row in _children(f, MAIN + "row", 2):
            cells = row.findall(MAIN + "c")
            for c in cells:
                ref = c.get("r", "A1")
                col = ordinal(ref)
                if columns is None or col in columns:
                    if strings is None and c.get("t") == "s":
                        strings = _Strings(book)
                    yield row_ix, col, ref, *_shown(c.get("t"), c, strings)
            row_ix += bool(cells)


def cells_of(data, order: str = "workbook"):
    """(sheet_ix, sheet, part, row_ix, col_ix, ref, value, is_num) of the cells of a workbook: bytes or an open file."""
    with zipfile.ZipFile(io.BytesIO(data) if isinstance(data, bytes) else data) as book:
        strings = _Strings(book)
        for sheet_ix, name, part in sheets_of(book, order):
            for cell in sheet_cells(book, part, strings):
                yield sheet_ix, name, part, *cell


def _arrow(rows):
    """Batches of rows of ``SCHEMA``."""
    import pyarrow as pa

    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    batch: list = []
    for row in rows:
        batch.append(row)
        if len(batch) >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in batch], kinds[k]) for k in range(9)], names=names)
            batch = []
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in batch], kinds[k]) for k in range(9)], names=names)


class _Part(InputPartition):
    """A sheet of a file, or a whole file if ``sheet`` is None."""

    def __init__(self, path: str, sheet: tuple[int, str, str] | None = None):
        self.path, self.sheet = path, sheet


def _fs(path: str):
    return storage.filesystem(path if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", path) else "file://" + os.path.abspath(path))


def _listed(path: str) -> list[str]:
    """Files of a path, folder (``*.xlsx``) or glob in its last part, with the path's own prefix."""
    from pyarrow import fs as pafs

    fs, base = _fs(path)
    prefix = path[: path.index(base)] if base in path else path[: len(path) - len(path.split(":", 1)[-1].lstrip("/"))]
    info = fs.get_file_info(base)
    if info.type == pafs.FileType.File:
        return [prefix + base if base in path else path]
    folder, pattern = (base, "*.xlsx") if info.type == pafs.FileType.Directory else os.path.split(base)
    inside = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted(prefix + i.path for i in inside if i.type == pafs.FileType.File and fnmatch.fnmatchcase(i.base_name, pattern))


class _Reader(DataSourceReader):
    PUSHED = ("file", "sheet", "sheet_ix", "part", "col_ix")

    def __init__(self, options):
        self.path, self.order, self.wanted = options["path"], options.get("order", "workbook"), {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute[0] in self.PUSHED and len(f.attribute) == 1:
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values
            else:
                yield f

    def _wants(self, name: str, value) -> bool:
        return name not in self.wanted or value in self.wanted[name]

    def _sheets(self, book: zipfile.ZipFile):
        return [s for s in sheets_of(book, self.order) if all(map(self._wants, ("sheet_ix", "sheet", "part"), s))]

    def partitions(self):
        found = _listed(self.path)
        if not found:
            raise FileNotFoundError(self.path)
        found = [p for p in found if self._wants("file", p)]
        if len(found) > DIRECTORIES:
            return [_Part(p) for p in found]
        out = []
        for path in found:
            with _open(path) as f, zipfile.ZipFile(f) as book:
                out += [_Part(path, s) for s in self._sheets(book)]
        return out

    def read(self, partition):
        return _arrow(self._rows(partition))

    def _rows(self, partition):
        with _open(partition.path) as f, zipfile.ZipFile(f) as book:
            strings = None
            for sheet in self._sheets(book) if partition.sheet is None else [partition.sheet]:
                if strings is None and partition.sheet is None:
                    strings = _Strings(book)
                for cell in sheet_cells(book, sheet[2], strings, self.wanted.get("col_ix")):
                    yield (partition.path, *sheet, *cell)


def _open(path: str):
    """The file for reads at any place: only what is asked for is fetched."""
    fs, base = _fs(path)
    return fs.open_input_file(base)


class XlsxCells(DataSource):
    @classmethod
    def name(cls):
        return "xlsx_cells"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and turn on the setting without which Spark refuses sources that take filters."""
    storage.ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(XlsxCells)


def from_binary(files: DataFrame, order: str = "workbook") -> DataFrame:
    """Cells of the workbooks in ``files`` (path, content), as binaryFile reads them; a sheet is parsed by a task of its own."""
    spark = files.sparkSession
    storage.ship(spark)

    def listed(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                one, content = batch.slice(k, 1), batch.column(1)[k].as_py()
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    for sheet in sheets_of(book, order):
                        yield pa.RecordBatch.from_arrays([*one.columns, *[pa.array([x], t) for x, t in zip(sheet, (pa.int32(), pa.string(), pa.string()), strict=True)]], names=["path", "content", "sheet_ix", "sheet", "part"])

    def work(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                path, content, *sheet = (c[k].as_py() for c in batch.columns)
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    yield from _arrow((path, *sheet, *cell) for cell in sheet_cells(book, sheet[2]))

    sheets = files.select("path", "content").mapInArrow(listed, "path string, content binary, sheet_ix int, sheet string, part string")
    return sheets.repartition(SHEETS * spark.sparkContext.defaultParallelism, "path", "sheet_ix").mapInArrow(work, SCHEMA)


def written(files: DataFrame, folder: str) -> DataFrame:
    """Write ``files`` (path, content) as ``folder``/path.xlsx; the paths written. A task that runs again overwrites its files."""
    storage.ship(files.sparkSession)

    def work(batches):
        import pyarrow as pa

        fs, base = storage.filesystem(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_output_stream(f"{base}/{name}.xlsx", compression=None) as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}.xlsx" for n in batch.column(0).to_pylist()], pa.string())], names=["file"])

    return storage.stored(files.select("path", "content").mapInArrow(work, "file string"), "written")


def dump(cells: DataFrame) -> DataFrame:
    """(file, sheet_ix, row_ix, line): the cells as lines of A1=value, each sheet under its heading."""
    rows = cells.groupBy("file", "sheet_ix", "row_ix").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_ix", "ref", "value"))), lambda c: F.concat(c.ref, F.lit("="), c.value)), "\t").alias("line"))
    heads = cells.select("file", "sheet_ix", F.lit(-1).alias("row_ix"), F.concat(F.lit("SHEET "), "sheet", F.lit(" ("), "part", F.lit(")")).alias("line")).distinct()
    top = cells.select("file", F.lit(-1).alias("sheet_ix"), F.lit(-1).alias("row_ix"), F.concat(F.lit("FILE "), F.col("file")).alias("line")).distinct()
    return top.unionByName(heads).unionByName(rows.select("file", "sheet_ix", "row_ix", "line"))
