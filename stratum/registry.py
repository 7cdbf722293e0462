"""Dataset registry: which sheet of which workbook category holds which dataset,
its positional English column names, declared types and date columns.

The registry is a tiny constant; it is turned into a DataFrame only to be
broadcast-joined (15 rows, fixed size).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES -- must equal the source exports' layout for results to match.
# Category detection order, sheet positions, rows to skip, the English column
# names in sheet order, and the Portuguese month folder names (in month order).
# ---------------------------------------------------------------------------
CATEGORY_ORDER = ["competitor", "content", "followers", "visitors"]

MONTH_NAMES_PT = ["Jan", "Fev", "Mar", "Abr", "Maio", "Jun", "Jul", "Ago", "Set", "Out", "Nov", "Dez"]

# (dataset, category, sheet position (0-based), rows to skip before the header)
SHEETS = [
    ("competitor", "competitor", 0, 1),
    ("content_metrics", "content", 0, 1),
    ("content_posts", "content", 1, 1),
    ("followers_new", "followers", 0, 0),
    ("followers_location", "followers", 1, 0),
    ("followers_function", "followers", 2, 0),
    ("followers_experience", "followers", 3, 0),
    ("followers_industry", "followers", 4, 0),
    ("followers_company_size", "followers", 5, 0),
    ("visitors_metrics", "visitors", 0, 0),
    ("visitors_location", "visitors", 1, 0),
    ("visitors_function", "visitors", 2, 0),
    ("visitors_experience", "visitors", 3, 0),
    ("visitors_industry", "visitors", 4, 0),
    ("visitors_company_size", "visitors", 5, 0),
]

# Column name -> type code ("s" string, "l" long, "d" double, "t" date), sheet order.
COLUMNS = {
    "competitor": [
        ("Page", "s"), ("Total Followers", "l"), ("New Followers", "l"),
        ("Total Post Engagements", "d"), ("Total Posts", "l"),
    ],
    "content_metrics": [
        ("Date", "t"),
        ("Impressions (organic)", "l"), ("Impressions (sponsored)", "l"), ("Impressions (total)", "l"),
        ("Unique impressions (organic)", "l"),
        ("Clicks (organic)", "l"), ("Clicks (sponsored)", "l"), ("Clicks (total)", "l"),
        ("Reactions (organic)", "l"), ("Reactions (sponsored)", "l"), ("Reactions (total)", "l"),
        ("Comments (organic)", "l"), ("Comments (sponsored)", "l"), ("Comments (total)", "l"),
        ("Shares (organic)", "l"), ("Shares (sponsored)", "l"), ("Shares (total)", "l"),
        ("Engagement rate (organic)", "d"), ("Engagement rate (sponsored)", "d"),
        ("Engagement rate (total)", "d"),
    ],
    "content_posts": [
        ("Post Title", "s"), ("Post Link", "s"), ("Post Type", "s"), ("Campaign Name", "s"),
        ("Published by", "s"), ("Date", "t"), ("Campaign Start Date", "t"), ("Campaign End Date", "t"),
        ("Audience", "s"), ("Impressions", "l"), ("Views (excluding off-site video views)", "l"),
        ("Off-site Views", "l"), ("Clicks", "l"), ("Click-Through Rate (CTR)", "d"), ("Likes", "l"),
        ("Comments", "l"), ("Shares", "l"), ("Followers", "l"), ("Engagement Rate", "d"),
        ("Content Type", "s"),
    ],
    "followers_new": [
        ("Date", "t"), ("Followers Sponsored", "l"), ("Followers Organic", "l"), ("Total Followers", "l"),
    ],
    "followers_location": [("Location", "s"), ("Total Followers", "l")],
    "followers_function": [("Function", "s"), ("Total Followers", "l")],
    "followers_experience": [("Experience Level", "s"), ("Total Followers", "l")],
    "followers_industry": [("Industry", "s"), ("Total Followers", "l")],
    "followers_company_size": [("Company Size", "s"), ("Total Followers", "l")],
    "visitors_metrics": [
        ("Date", "t"),
        ("Page Views Overview (Desktop)", "l"), ("Page Views Overview (Mobile Devices)", "l"),
        ("Page Views Overview (Total)", "l"),
        ("Unique Visitors Overview (Desktop)", "l"), ("Unique Visitors Overview (Mobile Devices)", "l"),
        ("Unique Visitors Overview (Total)", "l"),
        ("Page Views Day by Day (Desktop)", "l"), ("Page Views Day by Day (Mobile Devices)", "l"),
        ("Page Views Day by Day (Total)", "l"),
        ("Unique Visitors Day by Day (Desktop)", "l"), ("Unique Visitors Day by Day (Mobile Devices)", "l"),
        ("Unique Visitors Day by Day (Total)", "l"),
        ("Page Views Jobs (Desktop)", "l"), ("Page Views Jobs (Mobile Devices)", "l"),
        ("Page Views Jobs (Total)", "l"),
        ("Unique Visitors Jobs (Desktop)", "l"), ("Unique Visitors Jobs (Mobile Devices)", "l"),
        ("Unique Visitors Jobs (Total)", "l"),
        ("Total Page Views (Desktop)", "l"), ("Total Page Views (Mobile Devices)", "l"),
        ("Total Page Views (Total)", "l"),
        ("Total Unique Visitors (Desktop)", "l"), ("Total Unique Visitors (Mobile Devices)", "l"),
        ("Total Unique Visitors (Total)", "l"),
    ],
    "visitors_location": [("Location", "s"), ("Total Views", "l")],
    "visitors_function": [("Function", "s"), ("Total Views", "l")],
    "visitors_experience": [("Experience Level", "s"), ("Total Views", "l")],
    "visitors_industry": [("Industry", "s"), ("Total Views", "l")],
    "visitors_company_size": [("Company Size", "s"), ("Total Views", "l")],
}

# Datasets whose rows are repaired by the moving-average kernel.
REPAIRED = {"content_metrics"}

# Output columns of the repaired content_metrics dataset, in order.
CONTENT_METRICS_CLEAN = [
    "Date", "Impressions (total)", "Clicks (total)", "Reactions (total)", "Comments (total)",
    "Shares (total)", "Engagement Rate (total)", "Extraction Range",
]
CONTENT_METRICS_REPAIRED = ["Reactions (total)", "Comments (total)", "Shares (total)", "Clicks (total)"]
# ---------------------------------------------------------------------------

EXTRACTION_RANGE = "Extraction Range"
PARTITION_COLS = ["year", "month", "period"]
LINEAGE_COLS = ["source_file", "row_idx"]

_SPARK_TYPES = {"s": T.StringType(), "l": T.LongType(), "d": T.DoubleType(), "t": T.DateType()}


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    category: str
    sheet_pos: int
    skip_rows: int
    columns: tuple = field(default_factory=tuple)

    @property
    def names(self) -> list[str]:
        return [c for c, _ in self.columns]

    @property
    def date_columns(self) -> list[str]:
        return [c for c, t in self.columns if t == "t"]

    @property
    def repair(self) -> bool:
        return self.name in REPAIRED

    @property
    def schema(self) -> T.StructType:
        """Raw (typed) schema in sheet order."""
        return T.StructType([T.StructField(c, _SPARK_TYPES[t], True) for c, t in self.columns])

    def spark_type(self, column: str) -> T.DataType:
        return _SPARK_TYPES[dict(self.columns)[column]]


SPECS: dict[str, DatasetSpec] = {
    name: DatasetSpec(name, cat, pos, skip, tuple(COLUMNS[name])) for name, cat, pos, skip in SHEETS
}


def spec(name: str) -> DatasetSpec:
    try:
        return SPECS[name]
    except KeyError as exc:  # pragma: no cover - defensive
        raise KeyError(f"unknown dataset {name!r}; known: {sorted(SPECS)}") from exc


def sheets_for(category: str) -> list[DatasetSpec]:
    return [s for s in SPECS.values() if s.category == category]


def clean_schema(name: str) -> T.StructType:
    """Schema of a dataset in the clean layer (without partition/lineage columns)."""
    s = spec(name)
    if s.repair:
        fields = [T.StructField("Date", T.DateType(), True),
                  T.StructField("Impressions (total)", T.LongType(), True)]
        fields += [T.StructField(c, T.DoubleType(), True)
                   for c in ["Clicks (total)", "Reactions (total)", "Comments (total)", "Shares (total)",
                             "Engagement Rate (total)"]]
        fields.append(T.StructField(EXTRACTION_RANGE, T.DateType(), True))
        return T.StructType(fields)
    return T.StructType(list(s.schema.fields) + [T.StructField(EXTRACTION_RANGE, T.DateType(), True)])


def registry_df(spark):
    """The sheet registry as a 15-row DataFrame (dataset, category, sheet_pos, skip_rows, n_columns)."""
    rows = [(s.name, s.category, s.sheet_pos, s.skip_rows, len(s.columns)) for s in SPECS.values()]
    return spark.createDataFrame(
        rows, "dataset string, category string, sheet_pos int, skip_rows int, n_columns int"
    )


def month_dim_df(spark):
    """12-row dimension: month number <-> Portuguese folder name."""
    return spark.createDataFrame(
        [(i + 1, m) for i, m in enumerate(MONTH_NAMES_PT)], "month_num int, month_pt string"
    )
