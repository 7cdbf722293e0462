"""Incremental rebuilds: what is decoded, what is touched, and that the result is a fresh rebuild's."""

import os
import shutil
import time

import pytest
from xlsx_fixture import build_raw_tree

from stratum.plans import ledger
from stratum.plans.rebuild import rebuild
from stratum.registry import SPECS
from stratum.sources.clean import read_dataset


def _rows(spark, clean, level="extractions"):
    return {n: sorted(map(str, read_dataset(spark, clean, n, level=level).collect())) for n in SPECS}


def _files(raw, part):
    return sorted(os.path.join(d, f) for d, _, files in os.walk(raw) for f in files if part in f and f.endswith(".xlsx"))


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("ledger")
    raw, clean = str(root / "raw"), str(root / "clean")
    build_raw_tree(raw, months=((2024, 1), (2024, 2)))
    first = ledger.refresh(spark, raw, clean, levels=("month", "all"))
    return root, raw, clean, first


def _as_fresh(spark, root, raw, clean):
    fresh = str(root / f"fresh-{time.time_ns()}")
    rebuild(spark, raw, fresh, levels=("month", "all"))
    want = _rows(spark, fresh)
    for level in ("extractions", "monthly", "all_extractions"):
        assert _rows(spark, clean, level) == (want if level == "extractions" else _rows(spark, fresh, level)), level
    bad = lambda c: sorted(map(tuple, spark.read.parquet(os.path.join(c, "_rejects")).collect()))
    assert bad(clean) == bad(fresh)


def test_first_run_equals_a_rebuild(spark, tree):
    root, raw, clean, first = tree
    assert first["decoded"] == len(_files(raw, "competitor") + _files(raw, "content") + _files(raw, "followers") + _files(raw, "visitors"))
    _as_fresh(spark, root, raw, clean)


def test_second_run_decodes_nothing(spark, tree):
    root, raw, clean, _ = tree
    again = ledger.refresh(spark, raw, clean, levels=("month", "all"))
    assert (again["decoded"], again["touched"]) == (0, 0)
    os.utime(_files(raw, "content")[0])  # another time, the same bytes
    again = ledger.refresh(spark, raw, clean, levels=("month", "all"))
    assert (again["decoded"], again["touched"]) == (0, 0)


def test_changed_and_deleted_files(spark, tree):
    root, raw, clean, _ = tree
    a, b = _files(raw, "followers")[:2]
    shutil.copy(b, a)  # one file with other bytes
    run = ledger.refresh(spark, raw, clean, levels=("month", "all"))
    assert (run["decoded"], run["touched"]) == (1, 1)
    _as_fresh(spark, root, raw, clean)
    os.unlink(_files(raw, "visitors")[0])  # the next file of the month moves up to its period
    run = ledger.refresh(spark, raw, clean, levels=("month", "all"))
    assert run["decoded"] == 0 and run["touched"] >= 2
    _as_fresh(spark, root, raw, clean)
    with open(_files(raw, "competitor")[0], "wb") as f:
        f.write(b"no workbook")
    run = ledger.refresh(spark, raw, clean, levels=("month", "all"))
    assert run["decoded"] == 1
    _as_fresh(spark, root, raw, clean)


def test_a_stopped_run_is_done_again(spark, tree, monkeypatch):
    root, raw, clean, _ = tree
    a, b = _files(raw, "content")[:2]
    shutil.copy(a, b)

    def stop(*args, **kw):
        raise KeyboardInterrupt

    monkeypatch.setattr(ledger, "report_failures", stop)
    with pytest.raises(KeyboardInterrupt):
        ledger.refresh(spark, raw, clean, levels=("month", "all"))
    monkeypatch.undo()
    run = ledger.refresh(spark, raw, clean, levels=("month", "all"))
    assert run["decoded"] == 1
    _as_fresh(spark, root, raw, clean)
