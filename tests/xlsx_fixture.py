"""Minimal XLSX writer (stdlib zipfile) and a generated raw extraction tree.

Cells are written as inline strings or numbers; dates are written as
``M/d/yyyy`` text (as the exports deliver them) or as day serials.
"""

from __future__ import annotations

import calendar
import datetime as dt
import os
import random

from stratum.registry import MONTH_NAMES_PT, SPECS, sheets_for
from tools.xlsx_writer import write_xlsx  # noqa: F401

CATEGORY_DIRS = {"competitor": "Concorrentes", "content": "Conteudo", "followers": "Seguidores",
                 "visitors": "Visitantes"}


def _fmt_date(d: dt.date) -> str:
    return f"{d.month}/{d.day}/{d.year}"


def dataset_rows(name: str, days: list[dt.date], rng: random.Random) -> list[list]:
    """Data rows (no header) for one dataset of one extraction."""
    s = SPECS[name]
    rows = []
    if s.date_columns and "Date" in s.names:
        for d in days:
            row = []
            for col, t in s.columns:
                if col == "Date":
                    row.append(_fmt_date(d))
                elif t == "t":
                    row.append(_fmt_date(d) if rng.random() < 0.5 else None)
                elif t == "l":
                    v = rng.randint(0, 40)
                    if name == "content_metrics" and col.endswith("(total)") and rng.random() < 0.25:
                        v = -rng.randint(1, 5)
                    row.append(v)
                elif t == "d":
                    row.append(round(rng.random(), 4))
                else:
                    title = f"Post {d.isoformat()} \"launch\"; part, one\nsecond line"
                    row.append(title if col == "Post Title" else f"{col} {rng.randint(1, 9)}")
            rows.append(row)
        return rows
    for k in range(rng.randint(3, 6)):
        row = []
        for col, t in s.columns:
            if t == "s":
                row.append(f"{col} {k}")
            elif t == "l":
                row.append(rng.randint(0, 500))
            else:
                row.append(round(rng.random() * 100, 2))
        rows.append(row)
    return rows


def workbook_sheets(category: str, days, rng) -> list[tuple[str, list[list]]]:
    sheets = []
    for s in sorted(sheets_for(category), key=lambda x: x.sheet_pos):
        header = [f"col_{i}" for i in range(len(s.columns))]  # localized headers are ignored
        lead = [[f"{s.name} export"]] * s.skip_rows
        sheets.append((s.name[:31], lead + [header] + dataset_rows(s.name, days, rng)))
    return sheets


def half_month_days(year: int, month: int, period: int) -> list[dt.date]:
    last = calendar.monthrange(year, month)[1]
    first, end = (1, 15) if period == 1 else (16, last)
    return [dt.date(year, month, d) for d in range(first, end + 1)]


def build_raw_tree(root: str, months=((2024, 1), (2024, 2)), seed: int = 7, extra_files: bool = True) -> dict:
    """raw/<category dir>/<year>/<month pt>/<file>.xlsx; two extractions per month."""
    rng = random.Random(seed)
    n = 0
    for year, month in months:
        for period in (1, 2):
            days = half_month_days(year, month, period)
            for cat, cat_dir in CATEGORY_DIRS.items():
                folder = os.path.join(root, cat_dir, str(year), MONTH_NAMES_PT[month - 1])
                fname = f"page_{cat}_{year}{month:02d}_{period}.xlsx"
                write_xlsx(os.path.join(folder, fname), workbook_sheets(cat, days, rng))
                n += 1
    if extra_files:
        os.makedirs(os.path.join(root, "Conteudo", "2024", "Mar"), exist_ok=True)  # empty month folder
        write_xlsx(os.path.join(root, "Conteudo", "2023", "Dez", "notes_misc.xlsx"), [("x", [["a"], ["1"]])])
    return {"files": n}


def build_single_extraction(folder: str, year: int, month: int, period: int, seed: int = 11) -> None:
    rng = random.Random(seed)
    days = half_month_days(year, month, period)
    for cat in CATEGORY_DIRS:
        write_xlsx(os.path.join(folder, f"page_{cat}_new.xlsx"), workbook_sheets(cat, days, rng))
