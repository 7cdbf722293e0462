"""Workbook scan as a Spark job.

``binaryFile`` hands each executor the bytes of its files; ``mapInArrow``
decodes the XLSX container (a zip of XML parts) with the standard library and
emits one row per sheet row:

    source_file, dataset, sheet_pos, sheet_row, cells array<string>

Everything after that -- header skipping, positional naming, typing, date
parsing -- is ordinary Column expressions on that long table.

Workbooks are dealt to tasks of about ``TASK_BYTES`` (or one workbook), so the bytes one Arrow
batch carries are bounded. The cells table is written once to the staging area and every
dataset reads its own partition back (partition pruning), so no workbook is
decoded more than once.
"""

from __future__ import annotations

import functools
import io
import math
import posixpath
import zipfile
from xml.etree import ElementTree as ET
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.registry import SPECS

CELLS_SCHEMA = ("source_file string, dataset string, sheet_pos int, sheet_row long, "
                "cells array<string>, error string")

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "rel": "http://schemas.openxmlformats.org/package/2006/relationships"}


@functools.lru_cache(maxsize=4096)
def _ref_col(ref: str) -> int:
    """0-based column of a cell reference such as ``AB12``."""
    n = 0
    for ch in ref:
        if ch <= "9":
            break
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _text(el) -> str:
    return "".join(t.text or "" for t in el.iter(f"{{{_NS['m']}}}t"))


def _number_text(v: str) -> str:
    if v.isdigit() or (v[:1] == "-" and v[1:].isdigit()):
        return v.lstrip("0") or "0" if v[:1] != "-" else "-" + (v[1:].lstrip("0") or "0")
    try:
        x = float(v)
    except ValueError:
        return v
    if math.isfinite(x) and x.is_integer() and abs(x) < 2**53:
        return str(int(x))
    return repr(x)


def sheet_paths(zf: zipfile.ZipFile) -> list[str]:
    """Worksheet part names in workbook (tab) order."""
    wb = ET.fromstring(zf.read("xl/workbook.xml"))
    rels = ET.fromstring(zf.read("xl/_rels/workbook.xml.rels"))
    target = {r.get("Id"): r.get("Target") for r in rels.findall("rel:Relationship", _NS)}
    out = []
    for s in wb.find("m:sheets", _NS).findall("m:sheet", _NS):
        t = target[s.get(f"{{{_NS['r']}}}id")]
        out.append(t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join("xl", t)))
    return out


_ROW, _C, _V, _IS, _T = (f"{_NS['m']}}}{t}" for t in ("row", "c", "v", "is", "t"))


def _cell_value(kind: str, v: str | None, inline: list | None, shared: list[str]) -> str | None:
    if kind == "n":
        return _number_text(v) if v is not None else None
    if kind == "inlineStr":
        return "".join(inline) if inline is not None else None
    if kind == "s":
        return shared[int(v)] if v is not None else None
    if kind == "b":
        return None if v is None else ("TRUE" if v == "1" else "FALSE")
    if kind == "e":
        return None
    if kind == "str":
        return v
    return _number_text(v) if v is not None else None


class _Rows:
    """Rows of a worksheet from the parser's events; ``done`` holds the finished ones."""

    def __init__(self, shared: list[str]):
        self.shared, self.done = shared, []
        self.row = self.kind = self.text = None  # cells of the open row, type of the open cell, open text

    def start(self, tag: str, a: dict) -> None:
        if tag == _C:
            if self.row is not None and self.kind is None:
                ref = a.get("r")
                self.pos = _ref_col(ref.rstrip("0123456789")) if ref else self.pos + 1
                self.kind, self.v, self.inline = a.get("t", "n"), None, None
        elif tag == _V or tag == _T:
            self.text = []
        elif tag == _IS:
            self.inline = []
        elif tag == _ROW:
            self.row, self.kind, self.pos, self.number = {}, None, -1, a.get("r")

    def chars(self, data: str) -> None:
        if self.text is not None:
            self.text.append(data)

    def end(self, tag: str) -> None:
        if tag == _C:
            if self.kind is not None:
                self.row[self.pos] = _cell_value(self.kind, self.v, self.inline, self.shared)
                self.kind = None
        elif tag == _V:
            self.v, self.text = "".join(self.text or ()) or None, None
        elif tag == _T:
            if self.kind is not None and self.inline is not None:
                self.inline.append("".join(self.text or ()))
            self.text = None
        elif tag == _ROW:
            width = max(self.row) + 1 if self.row else 0
            self.done.append((int(self.number) - 1 if self.number else None, list(map(self.row.get, range(width)))))
            self.row = None


def read_sheet_rows(zf: zipfile.ZipFile, part: str, shared: list[str]):
    """Yield (0-based sheet row or None, list of cell strings) for one worksheet. Rows are made
    as the parser meets them, so memory is bounded by a piece of the part."""
    rows = _Rows(shared)
    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = rows.start, rows.end, rows.chars
    with zf.open(part) as fh:
        last = False
        while not last:
            piece = fh.read(1 << 16)
            last = not piece
            failed = None
            try:
                parser.Parse(piece, last)
            except expat.ExpatError as exc:
                failed = ET.ParseError(str(exc))
            yield from rows.done
            rows.done.clear()
            if failed:
                raise failed


def decode_workbook(data: bytes, positions: list[int]):
    """Decode the requested sheet positions of one XLSX workbook."""
    zf = zipfile.ZipFile(io.BytesIO(data))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in zf.namelist():
        root = ET.fromstring(zf.read("xl/sharedStrings.xml"))
        shared = [_text(si) for si in root.findall("m:si", _NS)]
    parts = sheet_paths(zf)
    for pos in positions:
        if pos >= len(parts):
            raise ValueError(f"workbook has {len(parts)} sheets, sheet {pos} requested")
        last = -1
        for row_no, cells in read_sheet_rows(zf, parts[pos], shared):
            last = row_no if row_no is not None else last + 1
            yield pos, last, cells


def _by_category():
    out: dict[str, list] = {}
    for s in SPECS.values():
        out.setdefault(s.category, []).append((s.sheet_pos, s.name))
    return out


_COLS = ["source_file", "dataset", "sheet_pos", "sheet_row", "cells", "error"]
_TYPES = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.string()]
_CHUNK_ROWS = 20_000
TASKS_PER_CORE, TASK_BYTES = 4, 32 << 20  # tasks that decode, and packed bytes of one


def _decode_batches(batches):
    """mapInArrow body: decode each file, emit bounded chunks of rows."""
    sheets = _by_category()

    def chunk(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _COLS)

    for batch in batches:
        for path, category, content in zip(*(batch.column(c) for c in ("path", "category", "content"))):
            path = path.as_py()
            wanted = dict(sheets.get(category.as_py(), []))
            rows = []
            try:
                for pos, row_no, cells in decode_workbook(content.as_py(), sorted(wanted)):
                    rows.append((path, wanted[pos], pos, row_no, cells, None))
                    if len(rows) >= _CHUNK_ROWS:
                        yield chunk(rows)
                        rows = []
            except Exception as exc:  # noqa: BLE001 -- a bad file becomes a reject row
                rows.append((path, None, None, None, None, f"{type(exc).__name__}: {exc}"))
            if rows:
                yield chunk(rows)


def decode_files(spark, raw: DataFrame) -> DataFrame:
    """Decode the workbooks of a ``binaryFile`` scan; one output row per sheet row.

    The category needed to pick sheets is derived from the file name inside
    the scan. The scan puts the largest files into one task, so the packed bytes are dealt by
    path to tasks of equal size first (unpacked cells are many times larger and never shuffled).
    Files of unknown category are not decoded (they are reported by ``files.rejected_files``).
    """
    from stratum.functions.columns import classify_category, file_name
    from stratum.session import ship_code

    ship_code(spark)  # the decoder runs in executor Python workers
    listed = (raw.select("path", classify_category(file_name("path")).alias("category"), "content")
              .filter(F.col("category").isNotNull()))
    size = raw.agg(F.count("*").alias("n"), F.sum("length").alias("bytes")).first()
    tasks = max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, -(-(size["bytes"] or 0) // TASK_BYTES))
    return listed.repartition(max(1, min(tasks, size["n"])), "path").mapInArrow(_decode_batches, CELLS_SCHEMA)


def scan_cells(spark, location: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """Decode every workbook under ``location``."""
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return decode_files(spark, reader.load(location))
