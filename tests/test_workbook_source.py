"""The workbook data source against the binaryFile scan; push-down; shared strings on disk."""

import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F
from xlsx_fixture import build_raw_tree

from stratum.registry import SPECS
from stratum.sources import workbook
from stratum.sources.xlsx import scan_cells

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def _shared_workbook(path, rows):
    """A content workbook (two sheets) whose texts are all shared strings."""
    texts = list(dict.fromkeys(c for r in rows for c in r))
    at = {t: i for i, t in enumerate(texts)}
    sheet = f"<worksheet {NS}><sheetData>" + "".join("<row>" + "".join(f'<c t="s"><v>{at[c]}</v></c>' for c in r) + "</row>" for r in rows) + "</sheetData></worksheet>"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{rel}"><sheets><sheet name="a" sheetId="1" r:id="r1"/><sheet name="b" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", sheet)
        z.writestr("xl/worksheets/s2.xml", sheet)
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><t>{t}</t></si>" for t in texts) + "</sst>")


def _rows(df):
    return sorted(map(str, df.withColumn("source_file", F.regexp_replace("source_file", "^file:/+", "/")).collect()))


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("workbooks") / "raw")
    build_raw_tree(root, months=((2024, 1),), extra_files=True)
    with open(os.path.join(root, "content_broken.xlsx"), "wb") as f:
        f.write(b"not a zip")
    return root


def test_rows_are_those_of_the_scan(spark, raw):
    assert _rows(workbook.read_workbooks(spark, raw)) == _rows(scan_cells(spark, raw))
    assert workbook.read_workbooks(spark, raw, recursive=False).filter("error is null").count() == 0


def test_only_the_sheets_asked_for_are_planned(spark, raw):
    whole = scan_cells(spark, raw)
    for name in ("content_posts", "followers_new", "nothing"):
        assert _rows(workbook.read_workbooks(spark, raw).filter(F.col("dataset") == name)) == _rows(whole.filter(F.col("dataset") == name))
    reader = workbook.WorkbookReader({"path": f"file://{raw}"})
    left = list(reader.pushFilters([workbook.EqualTo(("dataset",), "followers_location"), workbook.EqualTo(("sheet_row",), 3)]))
    assert [f.attribute for f in left] == [("sheet_row",)]
    work = [w for p in reader.partitions() for w in p.work]
    assert work and all("followers" in path and sheets == [(SPECS["followers_location"].sheet_pos, "followers_location")] for path, _, sheets in work)
    some = work[0][0]
    picked = workbook.read_workbooks(spark, raw).filter((F.col("source_file") == some) & F.col("dataset").isin("followers_new", "followers_industry"))
    assert {r.dataset for r in picked.select("dataset").distinct().collect()} == {"followers_new", "followers_industry"}


def test_a_large_workbook_has_a_task_per_sheet(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = [[f"text {rng.randint(0, 900)} é" for _ in range(5)] for _ in range(400)]
    _shared_workbook(tmp_path / "content_a.xlsx", rows)
    got = workbook.read_workbooks(spark, str(tmp_path))
    assert _rows(got) == _rows(scan_cells(spark, str(tmp_path)))
    assert [r.cells for r in got.filter("sheet_pos = 1").orderBy("sheet_row").collect()] == rows
    reader = workbook.WorkbookReader({"path": f"file://{tmp_path}"})
    assert len(reader.partitions()) == 1
    monkeypatch.setattr(workbook, "ALONE_BYTES", 1000)
    assert [p.work[0][2] for p in reader.partitions()] == [[(0, "content_metrics")], [(1, "content_posts")]]


def test_shared_strings_on_disk(tmp_path):
    rows = [[f"é{i}" * (i % 7)] for i in range(3000)]
    _shared_workbook(tmp_path / "a.xlsx", rows)
    with zipfile.ZipFile(tmp_path / "a.xlsx") as zf:
        own, disk = workbook.SharedStrings(zf), workbook.SharedStrings(zf, spill_bytes=100)
        texts = list(dict.fromkeys(r[0] for r in rows))
        assert not own.file._rolled and disk.file._rolled
        for s in (own, disk):
            assert [s[i] for i in (0, 5, 2999 % len(texts), len(texts) - 1, 1)] == [texts[i] for i in (0, 5, 2999 % len(texts), len(texts) - 1, 1)]
            with pytest.raises(IndexError):
                s[len(texts)]
            s.close()
