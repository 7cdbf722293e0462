"""Workbooks as a Spark data source: one unit of work per (file, sheet).

    from stratum.sources.workbook import read_workbooks
    read_workbooks(spark, root).filter("dataset = 'content_posts'")

A task opens a workbook where it lies, reads the zip directory and then only the parts that it
needs, so no file is held as a whole (``xlsx.scan_cells`` decodes the bytes that Spark's
``binaryFile`` hands over and serves stores that only Spark can open). Tests on ``dataset``,
``sheet_pos`` and ``source_file`` are pushed down: other sheets are never planned, and the
other workbooks never opened.

Planning: a workbook below ``ALONE_BYTES`` shares a task with others, up to ``PLAN_BYTES``; a
larger one has a task for each sheet. Shared strings, which a sheet refers to by number, are
written to a temporary file of the task once they pass ``SPILL_BYTES`` (eight bytes of memory a
string); sheets are parsed row by row. So memory is bounded by ``CHUNK_ROWS`` rows and the
index of the strings, whatever the size of a workbook.

Rows are those of ``xlsx.scan_cells``: a workbook that can't be decoded gives one row with the
error in each task that met it.
"""

from __future__ import annotations

import array
import tempfile
import zipfile
from functools import lru_cache
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from stratum.registry import CATEGORY_ORDER, SPECS
from stratum.sources.xlsx import CELLS_SCHEMA, read_sheet_rows, sheet_paths

PLAN_BYTES, ALONE_BYTES, SPILL_BYTES, CHUNK_ROWS = 32 << 20, 16 << 20, 64 << 20, 10_000
_SI = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}si"
_T = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}t"
_SST = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}sst"
_ARROW = pa.schema([("source_file", pa.string()), ("dataset", pa.string()), ("sheet_pos", pa.int32()), ("sheet_row", pa.int64()), ("cells", pa.list_(pa.string())), ("error", pa.string())])


class SharedStrings:
    """The shared strings of a workbook by number, on disk beyond ``SPILL_BYTES``."""

    def __init__(self, zf: zipfile.ZipFile, spill_bytes: int | None = None):
        self.file = tempfile.SpooledTemporaryFile(max_size=SPILL_BYTES if spill_bytes is None else spill_bytes)  # noqa: SIM115 -- closed by the reader
        self.starts = array.array("Q", [0])
        if "xl/sharedStrings.xml" in zf.namelist():
            with zf.open("xl/sharedStrings.xml") as f:
                top = None
                for event, el in ET.iterparse(f, events=("start", "end")):
                    if event == "start":
                        top = el if el.tag == _SST else top
                    elif el.tag == _SI:
                        text = "".join(t.text or "" for t in el.iter(_T)).encode()
                        self.file.write(text)
                        self.starts.append(self.starts[-1] + len(text))
                        top.clear()
        self._get = lru_cache(maxsize=65536)(self._read)

    def _read(self, i: int) -> str:
        self.file.seek(self.starts[i])
        return self.file.read(self.starts[i + 1] - self.starts[i]).decode()

    def __getitem__(self, i: int) -> str:
        if not 0 <= i < len(self.starts) - 1:
            raise IndexError(f"shared string {i} of {len(self.starts) - 1}")
        return self._get(i)

    def close(self) -> None:
        self.file.close()


class Sheets(InputPartition):
    """[(path as listed, path to open, [(sheet position, dataset)])]"""

    def __init__(self, work: list):
        self.work = work


def category(name: str) -> str | None:
    return next((c for c in CATEGORY_ORDER if c in name), None)


class WorkbookReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.recursive = options.get("recursive", "true") == "true"
        self.only: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in ("dataset", "sheet_pos", "source_file") and isinstance(f, EqualTo | In):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.only[column] = self.only.get(column, values) & values
            else:
                yield f

    def sheets(self, path: str) -> list[tuple[int, str]]:
        """The sheets of a workbook that are asked for."""
        name = path.rsplit("/", 1)[-1]
        own = [(s.sheet_pos, s.name) for s in SPECS.values() if s.category == category(name)]
        if path not in self.only.get("source_file", {path}):
            return []
        return sorted((p, d) for p, d in own if d in self.only.get("dataset", {d}) and p in self.only.get("sheet_pos", {p}))

    def partitions(self):
        from pyarrow import fs as pafs

        fs, p = pafs.FileSystem.from_uri(self.root)
        scheme = self.root[: self.root.index(p)] if p in self.root else "file:"
        found = fs.get_file_info(pafs.FileSelector(p, recursive=self.recursive))
        groups, held, size = [], [], 0
        for x in sorted((x for x in found if x.type == pafs.FileType.File), key=lambda x: x.path):
            path = f"{scheme}{x.path}"
            if not (sheets := self.sheets(path)):
                continue
            if x.size >= ALONE_BYTES:
                groups += [[(path, x.path, [s])] for s in sheets]
                continue
            if held and size + x.size > PLAN_BYTES:
                groups.append(held)
                held, size = [], 0
            held.append((path, x.path, sheets))
            size += x.size
        return [Sheets(g) for g in [*groups, held] if g]

    def read(self, partition):
        from pyarrow import fs as pafs

        fs, _ = pafs.FileSystem.from_uri(self.root)
        rows: list[tuple] = []
        for path, place, sheets in partition.work if partition else ():  # None: nothing was planned
            try:
                with fs.open_input_file(place) as f, _open(f) as zf:
                    parts, shared = sheet_paths(zf), SharedStrings(zf)
                    try:
                        for pos, dataset in sheets:
                            if pos >= len(parts):
                                raise ValueError(f"workbook has {len(parts)} sheets, sheet {pos} requested")
                            last = -1
                            for at, cells in read_sheet_rows(zf, parts[pos], shared):
                                last = at if at is not None else last + 1
                                rows.append((path, dataset, pos, last, cells, None))
                                if len(rows) >= CHUNK_ROWS:
                                    yield _batch(rows)
                                    rows = []
                    finally:
                        shared.close()
            except Exception as exc:  # noqa: BLE001 -- a bad file becomes a reject row
                rows.append((path, None, None, None, None, f"{type(exc).__name__}: {exc}"))
        if rows:
            yield _batch(rows)


def _open(f) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(f)
    except pa.ArrowInvalid as exc:  # shorter than the end of any zip file
        raise zipfile.BadZipFile("File is not a zip file") from exc


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls):
        return "workbook"

    def schema(self):
        return CELLS_SCHEMA

    def reader(self, schema):
        return WorkbookReader(self.options)


def read_workbooks(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Every row of every registered sheet of the workbooks under the folder ``root`` (a path
    or a URI): (source_file, dataset, sheet_pos, sheet_row, cells, error)."""
    from stratum.session import ship_code

    ship_code(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkbookSource)
    uri = root if "://" in root or root.startswith("file:") else f"file://{root if root.startswith('/') else '/' + root}"
    return spark.read.format("workbook").option("path", uri).option("recursive", str(recursive).lower()).load()
