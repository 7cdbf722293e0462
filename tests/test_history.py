"""The whole-history level: manifest, O(new) appends, merges; dates settled by column."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from xlsx_fixture import build_raw_tree, build_single_extraction

from stratum.functions import dates
from stratum.functions.columns import parse_date
from stratum.plans import history as whole_history
from stratum.plans.append import append_extraction
from stratum.plans.rebuild import rebuild
from stratum.registry import LINEAGE_COLS, SPECS
from stratum.sources import history
from stratum.sources.clean import read_dataset
from tools.xlsx_writer import write_xlsx


def _sizes(root):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(root) for f in files if f.startswith("part-")}


def _same(spark, clean, fmt="parquet", dialect="quoted"):
    """The levels hold the same rows."""
    for n in SPECS:
        rows = [sorted(map(str, read_dataset(spark, clean, n, fmt, dialect, level=level).drop(*LINEAGE_COLS).select("*").collect())) for level in ("extractions", "all_extractions")]
        assert rows[0] == rows[1], n


@pytest.fixture(scope="module")
def layer(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("history")
    raw, clean = str(root / "raw"), str(root / "clean")
    build_raw_tree(raw, months=((2024, 1),), extra_files=False)
    rebuild(spark, raw, clean, levels=("month", "all"))
    return root, clean


def test_append_writes_new_rows_and_a_manifest(spark, layer):
    root, clean = layer
    _same(spark, clean)
    level = os.path.join(clean, history.LEVEL)
    written = []
    for period in (1, 2):
        incoming = str(root / f"in-{period}")
        build_single_extraction(incoming, 2024, 2, period)
        before, old = _sizes(level), history.manifest(spark, clean)
        append_extraction(spark, incoming, clean, 2024, 2, period)
        after = _sizes(level)
        assert all(after[f] == n for f, n in before.items())  # nothing rewritten
        written.append(sum(n for f, n in after.items() if f not in before))
        assert history.manifest(spark, clean)["version"] == old["version"] + 1
        _same(spark, clean)
    assert written[1] < 1.5 * written[0]  # although the history has grown
    # the same extraction again replaces its rows
    append_extraction(spark, str(root / "in-1"), clean, 2024, 2, 1)
    _same(spark, clean)


def test_readers_see_the_old_or_the_new_state(spark, layer, monkeypatch):
    root, clean = layer
    incoming = str(root / "in-3")
    build_single_extraction(incoming, 2024, 3, 1)
    count = lambda: {n: read_dataset(spark, clean, n, level=history.LEVEL).count() for n in SPECS}
    before, seen, publish = count(), [], history.publish

    def watched(*args, **kw):
        seen.append(count())  # all rows are written, none is listed
        return publish(*args, **kw)

    monkeypatch.setattr(history, "publish", watched)
    append_extraction(spark, incoming, clean, 2024, 3, 1)
    monkeypatch.undo()
    assert seen == [before] and all(count()[n] > before[n] for n in SPECS)

    def killed(*args, **kw):
        raise KeyboardInterrupt

    now = count()
    monkeypatch.setattr(history, "publish", killed)
    build_single_extraction(str(root / "in-4"), 2024, 3, 2)
    with pytest.raises(KeyboardInterrupt):
        append_extraction(spark, str(root / "in-4"), clean, 2024, 3, 2)
    monkeypatch.undo()
    assert count() == now
    # a version whose writer was stopped half way is no version
    with open(os.path.join(clean, history.LEVEL, "_manifest", "000000000999.json"), "w") as f:
        f.write('{"version": 999, "sets"')
    assert count() == now
    append_extraction(spark, str(root / "in-4"), clean, 2024, 3, 2)
    _same(spark, clean)


def test_merges_by_tier_and_vacuum(spark, layer):
    root, clean = layer
    level = os.path.join(clean, history.LEVEL)
    sets = {n: len(x) for n, x in history.manifest(spark, clean)["sets"].items()}
    assert whole_history.merge_tiers(spark, clean, fanout=3) > 0
    _same(spark, clean)
    after = history.manifest(spark, clean)["sets"]
    assert all(len(after[n]) < sets[n] for n in SPECS) and any(x["tier"] == 1 for x in after["competitor"])
    stale = len(_sizes(level))
    assert whole_history.vacuum(spark, clean) > 0 and len(_sizes(level)) < stale
    _same(spark, clean)
    assert {os.path.join(clean, x["path"]) for own in after.values() for x in own} == {os.path.join(level, n, s) for n in SPECS for s in os.listdir(os.path.join(level, n))}


def test_two_writers_both_count(spark, tmp_path):
    clean = str(tmp_path)
    history.publish(spark, clean, lambda sets: {"a": [{"path": "x", "tier": 0, "dropped": []}]})
    calls = []

    def slow(sets):
        if not calls:  # another writer comes first
            calls.append(1)
            history.publish(spark, clean, lambda s: {**s, "b": []})
        return {**sets, "c": []}

    history.publish(spark, clean, slow)
    assert set(history.manifest(spark, clean)["sets"]) == {"a", "b", "c"}


def test_day_and_month_are_settled_by_the_column(spark):
    rows = [("us", "1/2/2024"), ("us", "12/31/2024"), ("us", "2024-03-04"), ("eu", "1/2/2024"), ("eu", "31/12/2024 9:05"), ("eu", "31/31/2024"), ("eu", "junk"),
            ("open", "1/2/2024"), ("open", "02/30/2024"), ("mix", "13/1/2024"), ("mix", "1/13/2024"), ("mix", "1/2/2024"), ("iso", "2024/01/02"), ("iso", "2 Jan 2024"), ("iso", "45293.5"), ("iso", "")]
    df = spark.createDataFrame(rows, "f string, s string")
    masks = df.groupBy("f").agg(F.bit_and(dates.order_mask(F.trim("s"))).alias("m"))
    assert {r.f: dates.ORDERS.get(r.m) for r in masks.collect()} == {"us": "month first", "eu": "day first", "open": "ambiguous", "mix": "mixed", "iso": None}
    got = {(r.f, r.s): r.d for r in df.join(masks, "f").select("f", "s", parse_date("s", F.col("m")).alias("d")).collect()}
    d = dt.date
    assert got == {("us", "1/2/2024"): d(2024, 1, 2), ("us", "12/31/2024"): d(2024, 12, 31), ("us", "2024-03-04"): d(2024, 3, 4),
                   ("eu", "1/2/2024"): d(2024, 2, 1), ("eu", "31/12/2024 9:05"): d(2024, 12, 31), ("eu", "31/31/2024"): None, ("eu", "junk"): None,
                   ("open", "1/2/2024"): d(2024, 1, 2), ("open", "02/30/2024"): None, ("mix", "13/1/2024"): d(2024, 1, 13), ("mix", "1/13/2024"): d(2024, 1, 13), ("mix", "1/2/2024"): d(2024, 1, 2),
                   ("iso", "2024/01/02"): d(2024, 1, 2), ("iso", "2 Jan 2024"): d(2024, 1, 2), ("iso", "45293.5"): d(2024, 1, 2), ("iso", ""): None}


def test_load_reads_each_file_in_its_own_order(spark, scratch):
    s = SPECS["followers_new"]
    folder, clean = os.path.join(scratch, "in"), os.path.join(scratch, "clean")
    os.makedirs(folder)
    for name, cells in (("followers_eu.xlsx", ["3/4/2024", "25/4/2024"]), ("followers_us.xlsx", ["3/4/2024", "4/25/2024"])):
        rows = [list(s.names), *[[c, "1", "2", "x" if i and "us" in name else "3"] for i, c in enumerate(cells)]]
        others = [[list(SPECS[n].names), ["a", "1"]] for n in SPECS if SPECS[n].category == "followers" and n != "followers_new"]
        write_xlsx(os.path.join(folder, name), [("s0", rows), *((f"s{i}", o) for i, o in enumerate(others, 1))])
    append_extraction(spark, folder, clean, 2024, 4, 1)
    got = sorted((os.path.basename(r.source_file), str(r.Date)) for r in read_dataset(spark, clean, "followers_new").collect())
    assert got == [("followers_eu.xlsx", "2024-04-03"), ("followers_eu.xlsx", "2024-04-25"), ("followers_us.xlsx", "2024-03-04"), ("followers_us.xlsx", "2024-04-25")]
    bad = spark.read.parquet(os.path.join(clean, "_rejects_cells_append", "2024_4_1")).collect()
    assert [(r.dataset, r.column, r.text) for r in bad] == [("followers_new", "Total Followers", "x")]
