"""Derive a raw workbook tree from the benchmark tables (benchmark input only).

Every half month of order dates becomes one extraction with the four
workbooks (competitor, content, followers, visitors) and their 15 sheets.
Sheet rows are computed with Spark aggregates over ``orders``/``customer``/
``nation``; each workbook is then written by one ``applyInPandas`` group
(a group is one workbook, so its size is bounded by one extraction).

Layout: ``<root>/<category dir>/<year>/<month pt>/page_<category>_<yyyymm>_<period>.xlsx``;
``holdout`` extractions go to ``<incoming>/<yyyy>_<mm>_<p>/`` flat folders instead.
"""

from __future__ import annotations

import functools
import os
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions.columns import half_month_period
from stratum.plans.tables import load
from stratum.registry import MONTH_NAMES_PT, SPECS

CATEGORY_DIRS = {"competitor": "Concorrentes", "content": "Conteudo", "followers": "Seguidores",
                 "visitors": "Visitantes"}
_KEYS = ["y", "m", "p"]


def _s(c):
    return F.coalesce(c.cast("string"), F.lit(""))


def _mdy(c):
    return F.date_format(c, "M/d/yyyy")


def _sheet(df: DataFrame, *sheets) -> DataFrame:
    """Rows of several sheets from one pass over ``df``: (dataset, row key, cells) each; a dataset
    may be chosen by a column, as (column, {value: dataset})."""
    rows = []
    for dataset, order_col, cells in sheets:
        col, names = dataset if isinstance(dataset, tuple) else (F.lit(dataset), {dataset: dataset})
        specs = {k: SPECS[n] for k, n in names.items()}
        assert all(len(cells) == len(s.columns) for s in specs.values()), (names, len(cells))
        pos = F.create_map(*[F.lit(x) for k, s in specs.items() for x in (k, s.sheet_pos)])
        (category,) = {s.category for s in specs.values()}
        rows.append(F.struct(F.lit(category).alias("category"), pos[col].alias("sheet_pos"),
                             order_col.cast("string").alias("row_key"), F.array(*[_s(c) for c in cells]).alias("cells")))
    return df.select(*_KEYS, F.explode(F.array(*rows)).alias("r")).select(*_KEYS, "r.*")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their half month; every sheet has rows of each of them."""
    o = load(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
        F.to_date("o_orderdate").alias("d"))
    return o.withColumns({"y": F.year("d"), "m": F.month("d"), "p": half_month_period("d")})


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    cust = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    oc = o.join(cust, o.o_custkey == cust.c_custkey, "left").join(
        F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left")

    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")

    def cnt(cond):
        return F.sum(F.when(cond, 1).otherwise(0))

    daily = o.groupBy(*_KEYS, "d").agg(
        F.count(F.lit(1)).alias("n"), cnt(st == "F").alias("nf"), cnt(st == "O").alias("no"),
        cnt(st == "P").alias("np"), *[cnt(pr.startswith(str(i))).alias(f"n{i}") for i in range(1, 6)],
        F.sum("o_totalprice").alias("rev"))
    c = F.col
    day_key = F.date_format("d", "yyyyMMdd")
    parts = [
        _sheet(daily, ("content_metrics", day_key, [
            _mdy(c("d")), c("n") * 7, c("n") * 3, c("n") * 10, c("n") * 5,
            c("nf"), c("no"), c("nf") - c("np"), c("n1"), c("n2"), c("no") - c("np"),
            c("n3"), c("n4"), c("n1") - c("n5"), c("n2"), c("n3"), c("n2") - c("n4"),
            F.round(c("nf") / (c("n") * 7), 4), F.round(c("no") / (c("n") * 3), 4),
            F.round((c("nf") + c("no")) / (c("n") * 10), 4)]),
            ("followers_new", day_key, [_mdy(c("d")), c("np"), c("nf") + c("no"), c("n")]),
            ("visitors_metrics", day_key,
               [_mdy(c("d"))] + [c(k) * (j // 6 + 1) for j, k in
                                 enumerate(["n", "nf", "no", "np", "n1", "n2", "n3", "n4", "n5", "n", "nf", "no",
                                            "np", "n1", "n2", "n3", "n4", "n5", "n", "nf", "no", "np", "n1",
                                            "n2"])])),
    ]
    urgent = o.filter(pr.startswith("1"))
    parts.append(_sheet(urgent, ("content_posts", F.col("o_orderkey"), [
        F.format_string("Order %d: \"%s\", status %s\nsecond line; priority", c("o_orderkey"), pr, st),
        F.format_string("https://example.org/posts/%d", c("o_orderkey")), st, pr,
        F.format_string("customer %d", c("o_custkey")), _mdy(c("d")),
        F.when(st != "P", _mdy(c("d"))), F.lit(None), F.lit("all"),
        F.floor(c("o_totalprice")), F.floor(c("o_totalprice") / 2), F.lit(0), F.floor(c("o_totalprice") / 100),
        F.round(F.lit(1.0) / 100, 4), F.floor(c("o_totalprice") / 1000), F.lit(1), F.lit(0), F.lit(0),
        F.round(c("o_totalprice") / 1e6, 6), F.lit("Text")])))
    size_bucket = F.format_string("%d+", F.pow(F.lit(10), F.floor(F.log10(c("o_totalprice")))).cast("long"))
    breakdowns = {"location": c("n_name"), "function": c("c_mktsegment"), "experience": pr,
                  "industry": st, "company_size": size_bucket}
    # all breakdowns in one pass over the joined orders
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("dim"), F.coalesce(x, F.lit("unknown")).alias("label"))
                               for k, x in breakdowns.items()]))
    g = (oc.select(*_KEYS, "o_totalprice", each.alias("b")).groupBy(*_KEYS, "b.dim", "b.label")
         .agg(F.count(F.lit(1)).alias("n"), F.floor(F.sum("o_totalprice") / 1000).alias("views")))
    parts.append(_sheet(g, *[((c("dim"), {k: f"{kind}_{k}" for k in breakdowns}), c("label"), [c("label"), c(value)])
                             for kind, value in (("followers", "n"), ("visitors", "views"))]))
    comp = oc.groupBy(*_KEYS, F.coalesce(c("n_name"), F.lit("unknown")).alias("nation")).agg(
        F.countDistinct("o_custkey").alias("cust"), F.count(F.lit(1)).alias("n"),
        F.round(F.sum("o_totalprice") / 1000, 2).alias("eng"), cnt(st == "F").alias("nf"))
    parts.append(_sheet(comp, ("competitor", c("nation"), [
        F.concat(c("nation"), F.lit(" page")), c("cust"), c("n"), c("eng"), c("nf")])))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_INT = re.compile(r"^-?\d+$")
_FLOAT = re.compile(r"^-?\d+\.\d+$")


@functools.lru_cache(maxsize=1 << 16)
def _cell(v):
    if v is None or v == "":
        return None
    if _INT.match(v):
        return int(v)
    if _FLOAT.match(v):
        return float(v)
    return v


def _writer(root: str, incoming: str, holdout: set):
    from tools.xlsx_writer import write_xlsx

    by_cat = {}
    for s in SPECS.values():
        by_cat.setdefault(s.category, []).append(s)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        cat, y, m, p = pdf["category"].iloc[0], int(pdf["y"].iloc[0]), int(pdf["m"].iloc[0]), int(pdf["p"].iloc[0])
        sheets = []
        n = 0
        for s in sorted(by_cat[cat], key=lambda x: x.sheet_pos):
            rows = pdf[pdf["sheet_pos"] == s.sheet_pos].sort_values("row_key")
            lead = [[f"{s.name} export"]] * s.skip_rows
            header = [f"col {i}" for i in range(len(s.columns))]
            body = [[_cell(v) for v in cells] for cells in rows["cells"]]
            n += len(body)
            sheets.append((s.name[:31], lead + [header] + body))
        fname = f"page_{cat}_{y}{m:02d}_{p}.xlsx"
        if (y, m, p) in holdout:
            path = os.path.join(incoming, f"{y}_{m:02d}_{p}", fname)
        else:
            path = os.path.join(root, CATEGORY_DIRS[cat], str(y), MONTH_NAMES_PT[m - 1], fname)
        write_xlsx(path, sheets)
        return pd.DataFrame({"path": [path], "n_rows": [n], "hold": [(y, m, p) in holdout]})

    return write


def derive_raw_tree(spark: SparkSession, sf_dir: str, root: str, incoming: str, holdout_last: int = 1,
                    categories=None) -> dict:
    """Write the tree; the last ``holdout_last`` extractions go to ``incoming`` instead."""
    from stratum.session import ship_code

    ship_code(spark)  # the workbook writer runs in executor Python workers
    rows = sheet_rows(spark, sf_dir)
    if categories:
        rows = rows.filter(F.col("category").isin(list(categories)))
    # the held-out extractions are the last half months (a handful of rows collected); each
    # category has sheets of every half month, so the orders alone tell them
    halves = _orders(spark, sf_dir).select(*_KEYS)
    last = (halves.distinct().orderBy(*[F.col(k).desc() for k in _KEYS]).limit(holdout_last).collect()
            if holdout_last else [])
    holdout = {tuple(r) for r in last}
    written = (rows.groupBy("category", *_KEYS)
               .applyInPandas(_writer(root, incoming, holdout), "path string, n_rows long, hold boolean"))
    # one summary row back to the driver, not one row per workbook
    summary = (written.filter(~F.col("hold"))
               .agg(F.count(F.lit(1)).alias("files"), F.sum("n_rows").alias("rows"),
                    F.countDistinct("path").alias("distinct_files"))
               .collect()[0])
    n_ext = halves.filter(~F.struct(*_KEYS).isin([F.struct(*[F.lit(v) for v in k]) for k in holdout])
                        if holdout else F.lit(True)).distinct().count()
    return {"files": int(summary["files"]), "rows": int(summary["rows"] or 0),
            "holdout": [dict(year=k[0], month=k[1], period=k[2],
                             folder=os.path.join(incoming, f"{k[0]}_{k[1]:02d}_{k[2]}")) for k in sorted(holdout)],
            "extractions": int(n_ext)}


if __name__ == "__main__":  # pragma: no cover
    import sys
    import tempfile

    from stratum.session import get_spark

    spark = get_spark("local[8]", 16)
    base = tempfile.mkdtemp(prefix="stratum-raw-")
    print(derive_raw_tree(spark, sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01",
                          os.path.join(base, "raw"), os.path.join(base, "incoming")))
    print(base)
