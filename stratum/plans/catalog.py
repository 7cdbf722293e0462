"""Registered queries over the benchmark tables, each with a DuckDB-runnable
oracle statement that must produce the same rows, column names and values.

Every query reads whole tables. Computed integers are BIGINT on both sides;
fractional results are rounded where two engines could sum in a different
order (the digits are chosen so that exact ties cannot occur).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions import columns as C
from stratum.operators import columns as COL
from stratum.operators import joins as J
from stratum.operators import profile as P
from stratum.operators import setops as U
from stratum.operators.repair import repair_metrics
from stratum.operators.windows import rolling_mean_days, rolling_mean_rows, row_ordinal
from stratum.plans.tables import TABLES, load
from stratum.registry import MONTH_NAMES_PT, SPECS, month_dim_df, registry_df

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle.strip()
        return fn
    return deco


# ---------------------------------------------------------------------------
# X1 / P7 -- flagship: repair daily content metrics derived from events
# ---------------------------------------------------------------------------

def _daily_content_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily content metrics from the event stream (map-side partial aggregate).

    impressions = views; clicks/reactions/comments = click/purchase/signup
    events, each minus that day's error events (which produces the negative
    days the repair kernel exists for).
    """
    ev = load(spark, sf_dir, "events").select("ts", "event_type")
    t = F.col("event_type")
    err = F.when(t == "error", -1).otherwise(0)

    def signed(kind):
        return F.sum(F.when(t == kind, 1).otherwise(err)).cast("long")

    daily = ev.groupBy(F.to_date("ts").alias("day")).agg(
        F.sum(F.when(t == "view", 1).otherwise(0)).cast("long").alias("impressions"),
        signed("click").alias("clicks"),
        signed("purchase").alias("reactions"),
        signed("signup").alias("comments"),
    )
    return daily.withColumns({
        "year": F.year("day"), "month": F.month("day"), "period": C.half_month_period("day")})


@query("content_metrics_clean", """
WITH d AS (
  SELECT CAST(ts AS DATE) AS day,
         CAST(SUM(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS impressions,
         SUM(CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END) AS clicks,
         SUM(CASE WHEN event_type = 'purchase' THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END) AS reactions,
         SUM(CASE WHEN event_type = 'signup' THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END) AS comments
  FROM events GROUP BY 1),
p AS (
  SELECT *, year(day) AS y, month(day) AS m, CASE WHEN day(day) <= 15 THEN 1 ELSE 2 END AS period FROM d),
m AS (
  SELECT *,
    CASE WHEN COUNT(*) OVER w = 3 THEN AVG(CASE WHEN clicks >= 0 THEN clicks ELSE 0 END) OVER w END AS c_ma,
    CASE WHEN COUNT(*) OVER w = 3 THEN AVG(CASE WHEN reactions >= 0 THEN reactions ELSE 0 END) OVER w END AS r_ma,
    CASE WHEN COUNT(*) OVER w = 3 THEN AVG(CASE WHEN comments >= 0 THEN comments ELSE 0 END) OVER w END AS m_ma
  FROM p WINDOW w AS (PARTITION BY y, m, period ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
f AS (
  SELECT day, y, m, period, impressions,
    CASE WHEN clicks < 0 THEN c_ma ELSE CAST(clicks AS DOUBLE) END AS clicks,
    CASE WHEN reactions < 0 THEN r_ma ELSE CAST(reactions AS DOUBLE) END AS reactions,
    CASE WHEN comments < 0 THEN m_ma ELSE CAST(comments AS DOUBLE) END AS comments
  FROM m)
SELECT day, impressions,
  ROUND(clicks, 4) AS clicks, ROUND(reactions, 4) AS reactions, ROUND(comments, 4) AS comments,
  ROUND((reactions + comments + clicks) / CAST(NULLIF(impressions, 0) AS DOUBLE), 6) AS engagement_rate,
  CASE WHEN period = 2 THEN last_day(day) ELSE make_date(y, m, 15) END AS extraction_range
FROM f
""")
def content_metrics_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _daily_content_metrics(spark, sf_dir)
    metrics = ["clicks", "reactions", "comments"]
    # One row per day: a (year, month, period) window partition holds at most 16 rows.
    fixed = repair_metrics(daily, ["year", "month", "period"], "day", metrics, skew_guard=False)
    return fixed.select(
        "day", "impressions",
        *[F.round(m, 4).alias(m) for m in metrics],
        F.round(C.engagement_rate(["reactions", "comments", "clicks"], "impressions"), 6).alias("engagement_rate"),
        C.period_end_date("year", "month", "period").alias("extraction_range"),
    )


@query("content_metrics_clean_days", """
WITH d AS (
  SELECT CAST(ts AS DATE) AS day,
         CAST(SUM(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS impressions,
         SUM(CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END) AS clicks,
         SUM(CASE WHEN event_type = 'purchase' THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END) AS reactions,
         SUM(CASE WHEN event_type = 'signup' THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END) AS comments
  FROM events GROUP BY 1),
p AS (SELECT *, year(day) AS y, month(day) AS m, CASE WHEN day(day) <= 15 THEN 1 ELSE 2 END AS period FROM d),
m AS (
  SELECT *,
    AVG(CASE WHEN clicks >= 0 THEN clicks ELSE 0 END) OVER w AS c_ma,
    AVG(CASE WHEN reactions >= 0 THEN reactions ELSE 0 END) OVER w AS r_ma,
    AVG(CASE WHEN comments >= 0 THEN comments ELSE 0 END) OVER w AS m_ma
  FROM p WINDOW w AS (PARTITION BY y, m, period ORDER BY day
                      RANGE BETWEEN INTERVAL 2 DAYS PRECEDING AND CURRENT ROW))
SELECT day, impressions,
  ROUND(CASE WHEN clicks < 0 THEN c_ma ELSE clicks END, 4) AS clicks,
  ROUND(CASE WHEN reactions < 0 THEN r_ma ELSE reactions END, 4) AS reactions,
  ROUND(CASE WHEN comments < 0 THEN m_ma ELSE comments END, 4) AS comments
FROM m
""")
def content_metrics_clean_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar-day frame flavour of the kernel (2 preceding days, partial frames)."""
    daily = _daily_content_metrics(spark, sf_dir)
    metrics = ["clicks", "reactions", "comments"]
    # one row per day: a (year, month, period) partition holds at most 16 rows
    fixed = repair_metrics(daily, ["year", "month", "period"], None, metrics, frame="days", date_col="day",
                           skew_guard=False)
    return fixed.select("day", "impressions", *[F.round(m, 4).alias(m) for m in metrics])


# ---------------------------------------------------------------------------
# Windows
# ---------------------------------------------------------------------------

_W_ACCTBAL = "WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"


@query("moving_avg_rows", f"""
SELECT c_custkey, c_nationkey, c_acctbal,
  CASE WHEN c_acctbal >= 0 THEN c_acctbal ELSE 0 END AS acctbal_pos,
  ROUND(CASE WHEN COUNT(*) OVER w = 3 THEN AVG(CASE WHEN c_acctbal >= 0 THEN c_acctbal ELSE 0 END) OVER w END, 4)
    AS acctbal_ma
FROM customer {_W_ACCTBAL}
""")
def moving_avg_rows(spark, sf_dir):
    cust = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    cust = cust.withColumn("acctbal_pos", C.clamp_nonneg("c_acctbal").cast("double"))
    out = rolling_mean_rows(cust, "c_nationkey", "c_custkey", {"acctbal_ma": "acctbal_pos"})
    return out.withColumn("acctbal_ma", F.round("acctbal_ma", 4))


@query("repair_negative", f"""
SELECT c_custkey, c_nationkey,
  ROUND(CASE WHEN c_acctbal < 0
        THEN CASE WHEN COUNT(*) OVER w = 3 THEN AVG(CASE WHEN c_acctbal >= 0 THEN c_acctbal ELSE 0 END) OVER w END
        ELSE c_acctbal END, 4) AS acctbal_repaired
FROM customer {_W_ACCTBAL}
""")
def repair_negative(spark, sf_dir):
    cust = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    fixed = repair_metrics(cust, "c_nationkey", "c_custkey", ["c_acctbal"])
    return fixed.select("c_custkey", "c_nationkey", F.round("c_acctbal", 4).alias("acctbal_repaired"))


_DAILY_BY_TYPE_SQL = "SELECT event_type, CAST(ts AS DATE) AS day, COUNT(*) AS n FROM events GROUP BY 1, 2"


def _daily_by_type(spark, sf_dir):
    return (load(spark, sf_dir, "events")
            .groupBy("event_type", F.to_date("ts").alias("day"))
            .agg(F.count(F.lit(1)).cast("long").alias("n")))


_MA_DAYS_SQL = f"""
WITH d AS ({_DAILY_BY_TYPE_SQL})
SELECT event_type, day, n,
  ROUND(AVG(n) OVER (PARTITION BY event_type ORDER BY day
                     RANGE BETWEEN INTERVAL 2 DAYS PRECEDING AND CURRENT ROW), 4) AS ma_3d
FROM d
"""


@query("moving_avg_days", _MA_DAYS_SQL)
def moving_avg_days(spark, sf_dir):
    daily = _daily_by_type(spark, sf_dir)
    # the daily aggregate leaves one row per (event_type, day): partitions are bounded by the calendar
    out = rolling_mean_days(daily, "event_type", "day", {"ma_3d": "n"}, preceding_days=2, bounded=True)
    return out.withColumn("ma_3d", F.round("ma_3d", 4))


@query("band_self_join", _MA_DAYS_SQL)
def band_self_join(spark, sf_dir):
    """Same answer as moving_avg_days through an equi-join after a 3-way fan-out."""
    daily = _daily_by_type(spark, sf_dir)
    out = J.band_self_join_mean(daily, "event_type", "day", "n", preceding_days=2, out="ma_3d")
    return out.withColumn("ma_3d", F.round("ma_3d", 4))


@query("period_ordinal", """
SELECT o_orderkey, o_custkey,
  CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS ym,
  CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey, year(o_orderdate), month(o_orderdate)
                          ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS ordinal
FROM orders
""")
def period_ordinal(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    o = o.withColumn("ym", (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long"))
    out = row_ordinal(o, ["o_custkey", "ym"], ["o_orderdate", "o_orderkey"], out="ordinal")
    return out.select("o_orderkey", "o_custkey", "ym", "ordinal")


@query("skip_rows", """
SELECT conv_id, turn, role FROM (
  SELECT conv_id, turn, role, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)
WHERE rn > 1
""")
def skip_rows(spark, sf_dir):
    conv = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return J.skip_leading_rows(conv, "conv_id", "turn", n=1)


@query("first_value_by_order", """
SELECT conv_id, arg_min(role, turn) AS first_role, arg_min(text, turn) AS first_text,
  CAST(COUNT(*) AS BIGINT) AS n_turns
FROM conversations GROUP BY conv_id
""")
def first_value_by_order(spark, sf_dir):
    conv = load(spark, sf_dir, "conversations")
    return J.first_by_order(conv, "conv_id", "turn", ["role", "text"],
                            extra_aggs=[F.count(F.lit(1)).cast("long").alias("n_turns")])


# ---------------------------------------------------------------------------
# Scalar expressions
# ---------------------------------------------------------------------------

@query("clamp_negative", """
SELECT 'customer' AS src, c_custkey AS id, c_acctbal AS acctbal,
       CASE WHEN c_acctbal >= 0 THEN c_acctbal ELSE 0 END AS acctbal_pos FROM customer
UNION ALL
SELECT 'supplier' AS src, s_suppkey AS id, s_acctbal AS acctbal,
       CASE WHEN s_acctbal >= 0 THEN s_acctbal ELSE 0 END AS acctbal_pos FROM supplier
""")
def clamp_negative(spark, sf_dir):
    cust = load(spark, sf_dir, "customer").select(
        F.lit("customer").alias("src"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acctbal"))
    supp = load(spark, sf_dir, "supplier").select(
        F.lit("supplier").alias("src"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("acctbal"))
    both = U.union_by_name([cust, supp])
    return both.withColumn("acctbal_pos", C.clamp_nonneg("acctbal").cast("double"))


@query("mask_nonneg", """
SELECT c_custkey,
  CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS acctbal_masked,
  COALESCE(CASE WHEN c_acctbal >= 0 THEN c_acctbal END, 0) AS acctbal_filled
FROM customer
""")
def mask_nonneg(spark, sf_dir):
    cust = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return cust.select("c_custkey", C.mask_nonneg("c_acctbal").alias("acctbal_masked"),
                       C.fill_zero(C.mask_nonneg("c_acctbal")).cast("double").alias("acctbal_filled"))


@query("engagement_rate", """
SELECT user_id, CAST(ts AS DATE) AS day,
  CAST(SUM(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS impressions,
  CAST(SUM(CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 1 ELSE 0 END) AS BIGINT) AS interactions,
  ROUND(SUM(CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 1 ELSE 0 END)
        / CAST(NULLIF(SUM(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END), 0) AS DOUBLE), 6) AS rate
FROM events GROUP BY 1, 2
""")
def engagement_rate(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    t = F.col("event_type")
    agg = ev.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.sum(F.when(t == "view", 1).otherwise(0)).cast("long").alias("impressions"),
        F.sum(F.when(t.isin("click", "purchase", "signup"), 1).otherwise(0)).cast("long").alias("interactions"))
    return agg.withColumn("rate", F.round(C.ratio("interactions", "impressions"), 6))


@query("stamp_extraction", """
SELECT o_orderkey, y AS year, m AS month, period,
  CASE WHEN period = 2 THEN last_day(d) ELSE make_date(y, m, 15) END AS extraction_range
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d,
        CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m,
        CAST(CASE WHEN day(o_orderdate) <= 15 THEN 1 ELSE 2 END AS BIGINT) AS period FROM orders)
""")
def stamp_extraction(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    o = o.select("o_orderkey", F.year("d").cast("long").alias("year"), F.month("d").cast("long").alias("month"),
                 C.half_month_period("d").cast("long").alias("period"))
    return o.withColumn("extraction_range", C.period_end_date("year", "month", "period"))


_MONTH_VALUES = ", ".join(f"({i + 1}, '{m}')" for i, m in enumerate(MONTH_NAMES_PT))


@query("month_lookup", f"""
WITH dim(month_num, month_pt) AS (VALUES {_MONTH_VALUES}),
labeled AS (SELECT d.month_pt FROM orders o JOIN dim d ON d.month_num = month(o.o_orderdate))
SELECT l.month_pt, CAST(d.month_num AS BIGINT) AS month_num, CAST(COUNT(*) AS BIGINT) AS n_orders
FROM labeled l JOIN dim d ON d.month_pt = l.month_pt
GROUP BY 1, 2
""")
def month_lookup(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(C.month_name(F.month("o_orderdate")).alias("month_pt"))
    # aggregate first (12 groups), then resolve the label through the fixed 12-row dimension
    counts = o.groupBy("month_pt").agg(F.count(F.lit(1)).cast("long").alias("n_orders"))
    dim = month_dim_df(spark).select("month_pt", F.col("month_num").cast("long").alias("month_num"))
    return J.lookup(counts, dim, "month_pt").select("month_pt", "month_num", "n_orders")


def _registry_values_sql():
    return ", ".join(f"('{s.name}', '{s.category}', {s.sheet_pos}, {s.skip_rows}, {len(s.columns)})"
                     for s in SPECS.values())


_EVENT_CATEGORY_SQL = ("CASE WHEN event_type = 'view' THEN 'visitors' WHEN event_type IN ('click', 'purchase') "
                       "THEN 'content' WHEN event_type = 'signup' THEN 'followers' ELSE 'competitor' END")


@query("sheet_registry", f"""
WITH reg(dataset, category, sheet_pos, skip_rows, n_columns) AS (VALUES {_registry_values_sql()}),
e AS (SELECT {_EVENT_CATEGORY_SQL} AS category, COUNT(*) AS n FROM events GROUP BY 1)
SELECT r.dataset, r.category, CAST(r.sheet_pos AS INTEGER) AS sheet_pos, CAST(r.skip_rows AS INTEGER) AS skip_rows,
  CAST(e.n AS BIGINT) AS n_events
FROM e JOIN reg r ON r.category = e.category
""")
def sheet_registry(spark, sf_dir):
    """Route each event to the datasets of its category (1:N through the 15-row registry)."""
    t = F.col("event_type")
    cat = (F.when(t == "view", "visitors").when(t.isin("click", "purchase"), "content")
           .when(t == "signup", "followers").otherwise("competitor"))
    counts = (load(spark, sf_dir, "events").groupBy(cat.alias("category"))
              .agg(F.count(F.lit(1)).cast("long").alias("n_events")))
    reg = registry_df(spark).select("dataset", "category", "sheet_pos", "skip_rows")
    return J.lookup(counts, reg, "category").select("dataset", "category", "sheet_pos", "skip_rows", "n_events")


_URL_RULES = [("spam", "spam"), ("://blog.", "blog"), ("://m.", "mobile"),
              ("/en/", "en"), ("/fr/", "fr"), ("/de/", "de")]


@query("classify", """
SELECT page_id,
  CASE WHEN contains(url, 'spam') THEN 'spam' WHEN contains(url, '://blog.') THEN 'blog'
       WHEN contains(url, '://m.') THEN 'mobile' WHEN contains(url, '/en/') THEN 'en'
       WHEN contains(url, '/fr/') THEN 'fr' WHEN contains(url, '/de/') THEN 'de' ELSE 'other' END AS category,
  CASE WHEN contains(f, 'competitor') THEN 'competitor' WHEN contains(f, 'content') THEN 'content'
       WHEN contains(f, 'followers') THEN 'followers' WHEN contains(f, 'visitors') THEN 'visitors'
       ELSE 'unclassified' END AS file_category
FROM (SELECT page_id, url, concat(url, '/', ['competitor_content', 'page_content', 'my followers', 'visitors', 'summary'][page_id % 5 + 1], '.xlsx') AS f FROM pages)
""")
def classify(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    u = F.col("url")
    expr = None
    for needle, label in _URL_RULES:
        expr = F.when(u.contains(needle), label) if expr is None else expr.when(u.contains(needle), label)
    names = F.array(*map(F.lit, ["competitor_content", "page_content", "my followers", "visitors", "summary"]))
    file = F.concat("url", F.lit("/"), F.get(names, (F.col("page_id") % 5).cast("int")), F.lit(".xlsx"))
    return pages.select("page_id", expr.otherwise("other").alias("category"),
                        C.classify_category(file, "unclassified").alias("file_category"))


@query("dataset_name", r"""
SELECT p_partkey, path,
  regexp_replace(regexp_extract(path, '[^/]*$'), '^all_extractions_|\.csv$', '', 'g') AS dataset
FROM (SELECT p_partkey,
        '/clean/all/all_extractions_' || lower(replace(p_type, ' ', '_')) || '_' || CAST(p_size AS VARCHAR) || '.csv'
          AS path FROM part)
""")
def dataset_name(spark, sf_dir):
    part = load(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(F.lit("/clean/all/all_extractions_"), F.lower(F.replace(F.col("p_type"), F.lit(" "), F.lit("_"))),
                 F.lit("_"), F.col("p_size").cast("string"), F.lit(".csv")).alias("path"))
    return part.withColumn("dataset", C.dataset_name_from_file("path"))


@query("string_tags", r"""
SELECT p_partkey,
  string_split(p_name, ' ')[1] AS first_word,
  string_split(p_name, ' ')[-1] AS last_word,
  concat_ws('-', p_brand, p_type, CAST(p_size AS VARCHAR)) AS tag,
  regexp_matches(p_brand, '^Brand#\d{1,2}$') AS brand_ok,
  upper(substring(p_type, 1, 1)) || lower(substring(p_type, 2)) AS type_cap
FROM part
""")
def string_tags(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    return part.select(
        "p_partkey", F.element_at(words, 1).alias("first_word"), F.element_at(words, -1).alias("last_word"),
        F.concat_ws("-", "p_brand", "p_type", F.col("p_size").cast("string")).alias("tag"),
        F.col("p_brand").rlike(r"^Brand#\d{1,2}$").alias("brand_ok"),
        C.capitalize("p_type").alias("type_cap"))


@query("string_tags_docs", r"""
SELECT doc_id,
  upper(substring(lang, 1, 1)) || lower(substring(lang, 2)) || '/' || source AS tag,
  CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS n_lines,
  regexp_matches(text, '(?i)licen[cs]e') AS mentions_license
FROM documents
""")
def string_tags_docs(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return docs.select(
        "doc_id", F.concat(C.capitalize("lang"), F.lit("/"), F.col("source")).alias("tag"),
        (F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).cast("long")
        .alias("n_lines"),
        F.col("text").rlike("(?i)licen[cs]e").alias("mentions_license"))


@query("try_cast_cols", """
SELECT p_partkey, TRY_CAST(p_type AS BIGINT) AS type_as_long,
  TRY_CAST(CAST(p_size AS VARCHAR) AS BIGINT) AS size_as_long,
  TRY_CAST(p_brand AS DOUBLE) AS brand_as_double
FROM part
""")
def try_cast_cols(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    return part.select("p_partkey", C.try_cast("p_type", "bigint").alias("type_as_long"),
                       C.try_cast(F.col("p_size").cast("string"), "bigint").alias("size_as_long"),
                       C.try_cast("p_brand", "double").alias("brand_as_double"))


@query("parse_date_guarded", """
SELECT o_orderkey, txt AS date_text,
  CASE WHEN txt IS NULL OR txt = '' THEN NULL ELSE CAST(strptime(txt, '%m/%d/%Y') AS DATE) END AS parsed
FROM (SELECT o_orderkey,
        CASE WHEN o_orderpriority LIKE '5%' THEN '' ELSE strftime(o_orderdate, '%m/%d/%Y') END AS txt FROM orders)
""")
def parse_date_guarded(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderpriority").startswith("5"), F.lit(""))
        .otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("date_text"))
    return o.withColumn("parsed", C.parse_date_strict("date_text", "M/d/yyyy"))


@query("parse_date_multi", """
SELECT o_orderkey, txt AS date_text,
  COALESCE(CAST(try_strptime(txt, '%m/%d/%Y') AS DATE), CAST(try_strptime(txt, '%Y-%m-%d') AS DATE)) AS parsed
FROM (SELECT o_orderkey,
        CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%-m/%-d/%Y')
             WHEN o_orderstatus = 'O' THEN strftime(o_orderdate, '%Y-%m-%d')
             ELSE 'n/a' END AS txt FROM orders)
""")
def parse_date_multi(spark, sf_dir):
    s = F.col("o_orderstatus")
    o = load(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(s == "F", F.date_format("o_orderdate", "M/d/yyyy"))
        .when(s == "O", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.lit("n/a")).alias("date_text"))
    return o.withColumn("parsed", C.parse_date("date_text", excel_serial=False))


@query("round_half_even", """
SELECT l_orderkey, l_linenumber, l_quantity + 0.5 AS half,
  CAST(l_quantity + 0.5 AS BIGINT) AS half_rounded,
  CAST(l_extendedprice AS BIGINT) AS price_rounded
FROM lineitem
""")
def round_half_even(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_quantity") + 0.5).alias("half"),
                     C.round_half_even_long(F.col("l_quantity") + 0.5).alias("half_rounded"),
                     C.round_half_even_long("l_extendedprice").alias("price_rounded"))


# ---------------------------------------------------------------------------
# Projections / table definition
# ---------------------------------------------------------------------------

@query("positional_rename", """
SELECT c_custkey AS customer_key, c_name AS customer_name, c_nationkey AS nation_key, c_acctbal AS balance,
  c_mktsegment AS segment FROM customer
""")
def positional_rename(spark, sf_dir):
    return COL.positional_rename(load(spark, sf_dir, "customer"),
                                 ["customer_key", "customer_name", "nation_key", "balance", "segment"])


@query("project_subset", """
SELECT l_orderkey AS order_key, l_linenumber AS line, l_quantity AS qty, l_extendedprice AS price_total,
  l_shipdate AS ship_date FROM lineitem
""")
def project_subset(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return COL.select_renamed(li, {"l_orderkey": "order_key", "l_linenumber": "line", "l_quantity": "qty",
                                   "l_extendedprice": "price_total", "l_shipdate": "ship_date"})


@query("add_column", """
SELECT s_suppkey, s_name, s_nationkey, s_acctbal, CAST(NULL AS DOUBLE) AS score,
  CAST(NULL AS DATE) AS extraction_range, CAST(DATE '2024-01-31' AS DATE) AS stamped
FROM supplier
""")
def add_column(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    s = COL.add_column(s, "score", "double")
    s = COL.add_column(s, "extraction_range", "date")
    s = COL.add_column(s, "s_name", "string")  # already present: IF NOT EXISTS -> unchanged
    return COL.add_column(s, "stamped", "date", "2024-01-31")


@query("typed_insert_select", """
SELECT CAST(CAST(o_orderkey AS VARCHAR) AS BIGINT) AS o_orderkey,
  CAST(CAST(o_custkey AS VARCHAR) AS BIGINT) AS o_custkey,
  CAST(o_orderstatus AS VARCHAR) AS o_orderstatus,
  CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE) AS o_totalprice,
  CAST(strftime(o_orderdate, '%m/%d/%Y') AS VARCHAR) AS o_orderdate_text,
  CAST(o_orderdate AS DATE) AS o_orderdate,
  CAST(o_orderpriority AS VARCHAR) AS o_orderpriority
FROM orders
""")
def typed_insert_select(spark, sf_dir):
    """Stringify every column (as a workbook reader delivers it), then convert to a declared schema."""
    from pyspark.sql import types as T

    o = load(spark, sf_dir, "orders")
    raw = o.select(*[F.col(c).cast("string").alias(c) for c in
                     ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]],
                   F.date_format("o_orderdate", "MM/dd/yyyy").alias("o_orderdate_text"),
                   F.date_format("o_orderdate", "M/d/yyyy").alias("o_orderdate"),
                   F.col("o_orderpriority").cast("string"))
    schema = T.StructType([
        T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderdate_text", T.StringType()), T.StructField("o_orderdate", T.DateType()),
        T.StructField("o_orderpriority", T.StringType())])
    return COL.typed_select(raw, schema, strict=True)


@query("update_from_join", """
WITH latest AS (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS last_price FROM orders GROUP BY o_custkey)
SELECT c.c_custkey, c.c_nationkey, CASE WHEN l.o_custkey IS NULL THEN c.c_acctbal
  WHEN l.last_price < 100000 THEN NULL ELSE l.last_price END AS c_acctbal
FROM customer c LEFT JOIN latest l ON c.c_custkey = l.o_custkey
""")
def update_from_join(spark, sf_dir):
    """UPDATE customer SET acctbal = last order price FROM (one row per customer); small prices
    are unknown, so a match can bring NULL."""
    cust = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    latest = (load(spark, sf_dir, "orders").groupBy("o_custkey")
              .agg(F.max_by("o_totalprice", "o_orderkey").alias("c_acctbal"))
              .withColumnRenamed("o_custkey", "c_custkey")
              .withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 100000, F.col("c_acctbal"))))
    return COL.update_from(cust, latest, "c_custkey", "c_acctbal")


# ---------------------------------------------------------------------------
# Filters / aggregates / profiles
# ---------------------------------------------------------------------------

@query("filter_eq", """
SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'
""")
def filter_eq(spark, sf_dir):
    return (load(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
            .select("event_id", "user_id", "value"))


@query("groupby_mean", """
SELECT event_type, user_id, ROUND(AVG(value), 9) AS mean_value, CAST(COUNT(*) AS BIGINT) AS n
FROM events GROUP BY 1, 2
""")
def groupby_mean(spark, sf_dir):
    means = P.group_mean(load(spark, sf_dir, "events"), ["event_type", "user_id"], "value", out="mean_value", count="n")
    return means.withColumn("mean_value", F.round("mean_value", 9))


@query("distinct_values", """
SELECT DISTINCT event_type FROM events
""")
def distinct_values(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_type").distinct()


@query("profile_tables")
def profile_tables(spark, sf_dir):
    return P.table_profile({t: load(spark, sf_dir, t) for t in TABLES})


@query("profile_size", r"""
SELECT lang, ROUND(SUM(n_chars) / 1e6, 2) AS size_mb, CAST(COUNT(*) AS BIGINT) AS num_docs,
  CAST(SUM(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS num_lines
FROM documents GROUP BY lang
""")
def profile_size(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("lang", "n_chars", "text")
    lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    return docs.groupBy("lang").agg(C.bytes_to_mb(F.sum("n_chars")).alias("size_mb"),
                                    F.count(F.lit(1)).cast("long").alias("num_docs"),
                                    F.sum(lines).cast("long").alias("num_lines"))


@query("profile_unpivot", """
WITH a AS (SELECT c_mktsegment, CAST(COUNT(*) AS BIGINT) AS num_customers,
             CAST(SUM(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS num_negative,
             CAST(COUNT(DISTINCT c_nationkey) AS BIGINT) AS num_nations
           FROM customer GROUP BY 1)
SELECT c_mktsegment, 'num_customers' AS attribute, num_customers AS qty FROM a
UNION ALL SELECT c_mktsegment, 'num_negative', num_negative FROM a
""")
def profile_unpivot(spark, sf_dir):
    cust = load(spark, sf_dir, "customer")
    wide = cust.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).cast("long").alias("num_customers"),
        F.sum(F.when(F.col("c_acctbal") < 0, 1).otherwise(0)).cast("long").alias("num_negative"),
        F.countDistinct("c_nationkey").cast("long").alias("num_nations"))
    return P.unpivot_metrics(wide, "c_mktsegment", ["num_customers", "num_negative", "num_nations"],
                             "attribute", "qty", exclude=["num_nations"])


@query("group_members", """
WITH per_nation AS (SELECT c_nationkey, COUNT(*) AS n_customers FROM customer GROUP BY c_nationkey)
SELECT n.n_regionkey, string_agg(n.n_name, ',' ORDER BY n.n_name) AS members, CAST(COUNT(*) AS BIGINT) AS n_members,
  CAST(SUM(p.n_customers) AS BIGINT) AS n_customers
FROM nation n JOIN per_nation p ON p.c_nationkey = n.n_nationkey
GROUP BY n.n_regionkey
""")
def group_members(spark, sf_dir):
    """Nations with customers, listed per region. The list members come from the
    25-row nation dimension, so each list is bounded at every scale; the work
    (customers per nation) grows with the data and is pre-aggregated first."""
    per_nation = (load(spark, sf_dir, "customer").groupBy("c_nationkey")
                  .agg(F.count(F.lit(1)).alias("n_customers")))
    nation = load(spark, sf_dir, "nation")
    joined = J.lookup(per_nation, nation, per_nation.c_nationkey == nation.n_nationkey)
    return P.group_members(joined, "n_regionkey", "n_name",
                           extra_aggs=[F.sum("n_customers").cast("long").alias("n_customers")])


# ---------------------------------------------------------------------------
# Set operations and clean-layer rollups
# ---------------------------------------------------------------------------

@query("union_by_name", """
SELECT 'customer' AS src, c_custkey AS key, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal,
  c_mktsegment AS mktsegment FROM customer
UNION ALL
SELECT 'supplier', s_suppkey, s_name, s_nationkey, s_acctbal, CAST(NULL AS VARCHAR) FROM supplier
""")
def union_by_name(spark, sf_dir):
    cust = load(spark, sf_dir, "customer").select(
        F.lit("customer").alias("src"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"),
        F.col("c_mktsegment").alias("mktsegment"))
    supp = load(spark, sf_dir, "supplier").select(
        F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").alias("nationkey"),
        F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"), F.lit("supplier").alias("src"))
    return U.union_by_name([cust, supp])


@query("union_pairwise", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'
UNION ALL
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F'
""")
def union_pairwise(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    a = o.filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey", "o_totalprice")
    b = o.filter(~F.col("o_orderstatus").eqNullSafe("F")).select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_totalprice").alias("p"))
    return U.union_positional([a, b])


@query("append_aligned", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders
""")
def append_aligned(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    cutoff = F.lit("1998-01-01").cast("timestamp_ntz")
    base = o.filter(F.col("o_orderdate") < cutoff)
    new = o.filter(~(F.col("o_orderdate") < cutoff) | F.col("o_orderdate").isNull())
    new = new.select(*reversed(new.columns))
    return U.append_aligned(base, new)


_EVENTS_PARTITIONED_SQL = """SELECT *, CAST(year(ts) AS BIGINT) AS y, CAST(month(ts) AS BIGINT) AS m,
  CAST(CASE WHEN day(ts) <= 15 THEN 1 ELSE 2 END AS BIGINT) AS period FROM events"""


def _events_partitioned(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    return ev.withColumns({"year": F.year("ts").cast("long"), "month": F.month("ts").cast("long"),
                           "period": C.half_month_period("ts").cast("long")})


@query("monthly_concat", f"""
WITH e AS ({_EVENTS_PARTITIONED_SQL})
SELECT y AS year, m AS month, CAST(COUNT(*) AS BIGINT) AS n_events,
  CAST(COUNT(DISTINCT period) AS BIGINT) AS n_extractions, ROUND(SUM(value), 2) AS total_value
FROM e GROUP BY 1, 2
""")
def monthly_concat(spark, sf_dir):
    """Month rollup: the union of a month's extractions is a partition-column filter;
    here every month at once (one aggregate with map-side partial sums)."""
    ev = _events_partitioned(spark, sf_dir)
    return ev.groupBy("year", "month").agg(
        F.count(F.lit(1)).cast("long").alias("n_events"),
        F.countDistinct("period").cast("long").alias("n_extractions"),
        F.round(F.sum("value"), 2).alias("total_value"))


@query("category_concat", f"""
WITH e AS ({_EVENTS_PARTITIONED_SQL})
SELECT event_type, CAST(COUNT(*) AS BIGINT) AS n_events,
  CAST(COUNT(DISTINCT (y * 100 + m) * 10 + period) AS BIGINT) AS n_extractions,
  ROUND(SUM(value), 2) AS total_value
FROM e GROUP BY 1
""")
def category_concat(spark, sf_dir):
    ev = _events_partitioned(spark, sf_dir)
    ext = (F.col("year") * 100 + F.col("month")) * 10 + F.col("period")
    return ev.groupBy("event_type").agg(
        F.count(F.lit(1)).cast("long").alias("n_events"),
        F.countDistinct(ext).cast("long").alias("n_extractions"),
        F.round(F.sum("value"), 2).alias("total_value"))


@query("incremental_append", """
SELECT o_orderkey, o_custkey, o_totalprice, y AS year, m AS month, period,
  CASE WHEN period = 2 THEN last_day(d) ELSE make_date(y, m, 15) END AS extraction_range
FROM (SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS d,
        CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m,
        CAST(CASE WHEN day(o_orderdate) <= 15 THEN 1 ELSE 2 END AS BIGINT) AS period FROM orders)
""")
def incremental_append(spark, sf_dir):
    """Existing clean rows (before the cutoff) plus one new batch transformed on its own."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    cutoff = F.lit("2000-01-01").cast("timestamp_ntz")

    def transform(df):
        d = F.to_date("o_orderdate")
        df = df.withColumns({"year": F.year(d).cast("long"), "month": F.month(d).cast("long"),
                             "period": C.half_month_period(d).cast("long")})
        return df.withColumn("extraction_range", C.period_end_date("year", "month", "period")).drop("o_orderdate")

    existing = transform(o.filter(F.col("o_orderdate") < cutoff))
    new = transform(o.filter(~(F.col("o_orderdate") < cutoff) | F.col("o_orderdate").isNull()))
    return U.append_aligned(existing, new)


@query("temp_view_sql", """
SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, CAST(COUNT(*) AS BIGINT) AS n_lines
FROM lineitem GROUP BY 1, 2
""")
def temp_view_sql(spark, sf_dir):
    load(spark, sf_dir, "lineitem").createOrReplaceTempView("stratum_lineitem")
    return spark.sql("""
        SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, CAST(COUNT(*) AS BIGINT) AS n_lines
        FROM stratum_lineitem GROUP BY l_returnflag, l_linestatus""")


def _profile_tables_oracle():
    from stratum.plans.tables import TABLES as names

    widths = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11,
              "events": 6, "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3,
              "conversations": 4}
    return "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, CAST(COUNT(*) AS BIGINT) AS num_rows, CAST({widths[t]} AS BIGINT) AS num_columns "
        f"FROM {t}" for t in names)


ORACLE["profile_tables"] = _profile_tables_oracle()


# ---------------------------------------------------------------------------
# End to end through workbooks: tables -> derived XLSX tree -> clean layer
# ---------------------------------------------------------------------------

_CM_ORACLE = """
WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d, o_orderstatus AS st, o_orderpriority AS pr FROM orders),
daily AS (
  SELECT d, year(d) AS y, month(d) AS m, CASE WHEN day(d) <= 15 THEN 1 ELSE 2 END AS p, COUNT(*) AS n,
    SUM(CASE WHEN st = 'F' THEN 1 ELSE 0 END) AS nf, SUM(CASE WHEN st = 'O' THEN 1 ELSE 0 END) AS no_,
    SUM(CASE WHEN st = 'P' THEN 1 ELSE 0 END) AS np,
    SUM(CASE WHEN pr LIKE '1%' THEN 1 ELSE 0 END) AS n1, SUM(CASE WHEN pr LIKE '2%' THEN 1 ELSE 0 END) AS n2,
    SUM(CASE WHEN pr LIKE '4%' THEN 1 ELSE 0 END) AS n4, SUM(CASE WHEN pr LIKE '5%' THEN 1 ELSE 0 END) AS n5
  FROM o GROUP BY d),
r AS (SELECT d, y, m, p, n * 10 AS imp, nf - np AS clicks, no_ - np AS reactions, n1 - n5 AS comments,
        n2 - n4 AS shares FROM daily),
w AS (
  SELECT *,
    CASE WHEN COUNT(*) OVER win = 3 THEN AVG(CASE WHEN clicks >= 0 THEN clicks ELSE 0 END) OVER win END AS k_ma,
    CASE WHEN COUNT(*) OVER win = 3 THEN AVG(CASE WHEN reactions >= 0 THEN reactions ELSE 0 END) OVER win END AS r_ma,
    CASE WHEN COUNT(*) OVER win = 3 THEN AVG(CASE WHEN comments >= 0 THEN comments ELSE 0 END) OVER win END AS c_ma,
    CASE WHEN COUNT(*) OVER win = 3 THEN AVG(CASE WHEN shares >= 0 THEN shares ELSE 0 END) OVER win END AS s_ma
  FROM r WINDOW win AS (PARTITION BY y, m, p ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
f AS (
  SELECT d, y, m, p, imp,
    CASE WHEN clicks < 0 THEN k_ma ELSE CAST(clicks AS DOUBLE) END AS clicks,
    CASE WHEN reactions < 0 THEN r_ma ELSE CAST(reactions AS DOUBLE) END AS reactions,
    CASE WHEN comments < 0 THEN c_ma ELSE CAST(comments AS DOUBLE) END AS comments,
    CASE WHEN shares < 0 THEN s_ma ELSE CAST(shares AS DOUBLE) END AS shares
  FROM w)
SELECT d AS "Date", CAST(imp AS BIGINT) AS "Impressions (total)",
  ROUND(clicks, 4) AS "Clicks (total)", ROUND(reactions, 4) AS "Reactions (total)",
  ROUND(comments, 4) AS "Comments (total)", ROUND(shares, 4) AS "Shares (total)",
  ROUND((reactions + comments + clicks + shares) / CAST(NULLIF(imp, 0) AS DOUBLE), 6) AS "Engagement Rate (total)",
  CASE WHEN p = 2 THEN last_day(d) ELSE make_date(y, m, 15) END AS "Extraction Range"
FROM f
"""


@query("workbook_content_metrics", _CM_ORACLE)
def workbook_content_metrics(spark, sf_dir):
    """The reference's own dataflow on workbooks Spark derives from ``orders``.

    One content workbook per half month of order dates is written under the
    session's checkpoint folder (shared storage on a cluster); the tree is
    discovered and its workbooks decoded once; the returned plan skips the lead rows,
    names and types the columns by position, stamps the extraction and
    repairs the metrics -- the same path ``plans.rebuild`` writes to the
    clean layer.
    """
    import os
    import uuid

    from stratum.plans.rebuild import stage_cells
    from stratum.plans.transform import transform_dataset
    from stratum.session import checkpoint_dir
    from stratum.sources.files import accepted_files, discover_extractions
    from stratum.sources.xlsx import scan_cells
    from tools.derive_raw_tree import derive_raw_tree

    base = os.path.join(checkpoint_dir(spark), f"workbooks-{uuid.uuid4().hex}")
    raw = os.path.join(base, "raw")
    derive_raw_tree(spark, sf_dir, raw, os.path.join(base, "incoming"), holdout_last=0, categories=["content"])
    files = accepted_files(discover_extractions(spark, raw))
    staged = stage_cells(spark, scan_cells(spark, raw), files, os.path.join(base, "cells"))
    cm = transform_dataset(staged, "content_metrics")
    metrics = ["Clicks (total)", "Reactions (total)", "Comments (total)", "Shares (total)"]
    return cm.select("Date", "Impressions (total)", *[F.round(F.col(f"`{m}`"), 4).alias(m) for m in metrics],
                     F.round("`Engagement Rate (total)`", 6).alias("Engagement Rate (total)"), "Extraction Range")


# ---------------------------------------------------------------------------
# Storage: rebuild, append and copies of the whole layer; flat files; line counts
# ---------------------------------------------------------------------------

_LAYER_ORACLE = """
WITH o AS (
  SELECT o_orderstatus AS st, o_orderpriority AS pr, o_totalprice AS price, o_custkey,
    CAST(o_orderdate AS DATE) AS d, year(o_orderdate) AS y, month(o_orderdate) AS m,
    CASE WHEN day(o_orderdate) <= 15 THEN 1 ELSE 2 END AS p FROM orders),
j AS (SELECT o.*, coalesce(n_name, 'unknown') AS nation, coalesce(c_mktsegment, 'unknown') AS segment,
    coalesce(CAST(floor(log10(price)) AS VARCHAR), 'unknown') AS size
  FROM o LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey),
days AS (SELECT count(DISTINCT d) AS n FROM o),
labels AS (
  SELECT 'location' AS k, count(DISTINCT (y, m, p, nation)) AS n FROM j
  UNION ALL SELECT 'function', count(DISTINCT (y, m, p, segment)) FROM j
  UNION ALL SELECT 'experience', count(DISTINCT (y, m, p, pr)) FROM j
  UNION ALL SELECT 'industry', count(DISTINCT (y, m, p, st)) FROM j
  UNION ALL SELECT 'company_size', count(DISTINCT (y, m, p, size)) FROM j),
c AS (
  SELECT 'content_metrics' AS dataset, n FROM days UNION ALL SELECT 'followers_new', n FROM days
  UNION ALL SELECT 'visitors_metrics', n FROM days
  UNION ALL SELECT 'content_posts', count(*) FROM o WHERE pr LIKE '1%'
  UNION ALL SELECT 'followers_' || k, n FROM labels UNION ALL SELECT 'visitors_' || k, n FROM labels
  UNION ALL SELECT 'competitor', n FROM labels WHERE k = 'location')
SELECT dataset, n AS n_layer, n AS n_monthly, n AS n_all, CAST(0 AS BIGINT) AS n_rejected FROM c
"""


@query("rebuild_and_append", _LAYER_ORACLE)
def rebuild_and_append(spark, sf_dir):
    """All 15 datasets through files: a workbook tree derived from ``orders`` is rebuilt with
    month and whole-history copies, its last extraction, held out, is appended, and the rows of
    every level are counted."""
    import os

    from stratum.sources.clean import read_dataset

    clean = _written_layer(spark, sf_dir)
    rejected = spark.read.schema("path string, reason string").parquet(os.path.join(clean, "_rejects")).count()
    levels = (("extractions", "n_layer"), ("monthly", "n_monthly"), ("all_extractions", "n_all"))
    counted = [read_dataset(spark, clean, name, level=level).agg(F.count("*").alias("n"))
               .select(F.lit(name).alias("dataset"), F.lit(out).alias("level"), "n") for name in SPECS for level, out in levels]
    rows = reduce(DataFrame.unionByName, counted)
    cells = [F.sum(F.when(F.col("level") == out, F.col("n"))).alias(out) for _, out in levels]
    return rows.groupBy("dataset").agg(*cells).withColumn("n_rejected", F.lit(rejected).cast("long"))


@query("flat_layer_roundtrip", """
SELECT c.c_name || chr(10) || '"' || coalesce(n_name, '') || '"; x' AS "Location", CAST(count(o_orderkey) AS BIGINT) AS "Total Followers",
  CAST(max(o_orderdate) AS DATE) AS "Extraction Range"
FROM customer c LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name, n_name
""")
def flat_layer_roundtrip(spark, sf_dir):
    """One CSV per dataset, separator ``;``, texts with quotes, separators and line breaks."""
    import os
    import uuid

    from stratum.session import checkpoint_dir
    from stratum.sinks.writers import write_flat
    from stratum.sources.clean import read_flat_clean

    cust = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    orders = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last"))
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = (cust.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
            .select(F.concat("c_name", F.lit('\n"'), F.coalesce("n_name", F.lit("")), F.lit('"; x')).alias("Location"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("Total Followers"), F.to_date("last").alias("Extraction Range")))
    folder = os.path.join(checkpoint_dir(spark), f"flat-{uuid.uuid4().hex}")
    write_flat({"followers_location": rows}, folder, dialect="semicolon")
    return read_flat_clean(spark, folder, dialect="semicolon")["followers_location"]


@query("text_lines", """
SELECT event_type, CAST(count(*) AS BIGINT) AS num_lines FROM events GROUP BY event_type
""")
def text_lines(spark, sf_dir):
    """Lines of every file of a partitioned text export, by partition."""
    import os
    import uuid

    from stratum.session import checkpoint_dir
    from stratum.sources.files import text_line_profile

    folder = os.path.join(checkpoint_dir(spark), f"lines-{uuid.uuid4().hex}")
    load(spark, sf_dir, "events").select("event_id", "event_type").write.partitionBy("event_type").csv(folder)
    lines = text_line_profile(spark, folder)
    return (lines.withColumn("event_type", F.regexp_extract("path", "event_type=([^/]+)/", 1))
            .groupBy("event_type").agg(F.sum("num_lines").cast("long").alias("num_lines")))


# ---------------------------------------------------------------------------
# Values of the written layer, quoted CSV, run metrics, re-runs
# ---------------------------------------------------------------------------

def _written_layer(spark, sf_dir, fmt: str = "parquet", dialect: str = "quoted", categories=None) -> str:
    """A clean layer with all levels: a workbook tree derived from ``orders`` is rebuilt, and its
    last extraction, held out, is appended."""
    import os
    import uuid

    from stratum.plans.append import append_extraction
    from stratum.plans.rebuild import rebuild
    from stratum.session import checkpoint_dir
    from tools.derive_raw_tree import derive_raw_tree

    base = os.path.join(checkpoint_dir(spark), f"layer-{uuid.uuid4().hex}")
    raw, clean = os.path.join(base, "raw"), os.path.join(base, "clean")
    info = derive_raw_tree(spark, sf_dir, raw, os.path.join(base, "incoming"), holdout_last=1, categories=categories)
    rebuild(spark, raw, clean, fmt=fmt, dialect=dialect, levels=("month", "all"))
    for x in info["holdout"]:
        append_extraction(spark, x["folder"], clean, x["year"], x["month"], x["period"], fmt=fmt, dialect=dialect)
    return clean


_POST_TITLE = "'Order ' || o_orderkey || ': \"' || pr || '\", status ' || st || chr(10) || 'second line; priority'"
_LEVEL_VALUES_ORACLE = f"""
WITH o AS (
  SELECT o_orderkey, o_orderstatus AS st, o_orderpriority AS pr, o_totalprice AS price, o_custkey,
    CAST(o_orderdate AS DATE) AS d, year(o_orderdate) AS y, month(o_orderdate) AS m,
    CASE WHEN day(o_orderdate) <= 15 THEN 1 ELSE 2 END AS p FROM orders),
j AS (SELECT o.*, coalesce(n_name, 'unknown') AS nation, coalesce(c_mktsegment, 'unknown') AS segment,
    coalesce(CAST(CAST(pow(10, floor(log10(price))) AS BIGINT) AS VARCHAR) || '+', 'unknown') AS size
  FROM o LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey),
g AS (
  SELECT 'location' AS k, nation AS label, count(*) AS n, count(DISTINCT o_custkey) AS cust, sum(CASE WHEN st = 'F' THEN 1 ELSE 0 END) AS nf FROM j GROUP BY y, m, p, nation
  UNION ALL SELECT 'function', segment, count(*), 0, 0 FROM j GROUP BY y, m, p, segment
  UNION ALL SELECT 'experience', pr, count(*), 0, 0 FROM j GROUP BY y, m, p, pr
  UNION ALL SELECT 'industry', st, count(*), 0, 0 FROM j GROUP BY y, m, p, st
  UNION ALL SELECT 'company_size', size, count(*), 0, 0 FROM j GROUP BY y, m, p, size),
v AS (
  SELECT 'content_metrics' AS dataset, count(DISTINCT d) AS n_rows, 10 * count(*) AS total, 0 AS chars FROM o
  UNION ALL SELECT 'followers_new', count(DISTINCT d), sum(1 + CASE WHEN st IN ('F', 'O', 'P') THEN 1 ELSE 0 END), 0 FROM o
  UNION ALL SELECT 'visitors_metrics', count(DISTINCT d), sum(7 + CASE st WHEN 'F' THEN 7 WHEN 'O' THEN 7 WHEN 'P' THEN 8 ELSE 0 END
    + CASE left(pr, 1) WHEN '1' THEN 8 WHEN '2' THEN 8 WHEN '3' THEN 5 WHEN '4' THEN 5 WHEN '5' THEN 5 ELSE 0 END), 0 FROM o
  UNION ALL SELECT 'content_posts', count(*), sum(CAST(floor(price) + floor(price / 2) + floor(price / 100) + floor(price / 1000) AS BIGINT) + 1),
    sum(length({_POST_TITLE})) FROM o WHERE pr LIKE '1%'
  UNION ALL SELECT 'followers_' || k, count(*), sum(n), sum(length(label)) FROM g GROUP BY k
  UNION ALL SELECT 'visitors_' || k, count(*), count(*), sum(length(label)) FROM g GROUP BY k
  UNION ALL SELECT 'competitor', count(*), sum(cust + n + nf), sum(length(label || ' page')) FROM g WHERE k = 'location')
SELECT dataset, level, CAST(n_rows AS BIGINT) AS n_rows, CAST(total AS BIGINT) AS total, CAST(chars AS BIGINT) AS chars
FROM v, (VALUES ('extractions'), ('monthly'), ('all_extractions')) AS t(level)
"""


@query("layer_values", _LEVEL_VALUES_ORACLE)
def layer_values(spark, sf_dir):
    """What the 15 datasets hold at every level after a rebuild and an append: rows, the sum of
    their whole numbers and the characters of their texts, so that a shifted column or a lost
    line shows."""
    from pyspark.sql import types as T

    from stratum.sources.clean import read_dataset

    clean = _written_layer(spark, sf_dir)
    parts = []
    for name, s in SPECS.items():
        for level in ("extractions", "monthly", "all_extractions"):
            df = read_dataset(spark, clean, name, level=level)
            own = [f for f in df.schema.fields if f.name in s.names]
            longs = [F.coalesce(F.col(f"`{f.name}`"), F.lit(0)) for f in own if isinstance(f.dataType, T.LongType)]
            total = reduce(lambda a, b: a + b, longs)
            if name.startswith("visitors_") and name != "visitors_metrics":
                total = (F.col("`Total Views`") >= 0).cast("long")  # sums of fractions, cut: counted
            texts = [f.name for f in own if isinstance(f.dataType, T.StringType)][:1]
            chars = F.sum(F.length(f"`{texts[0]}`")) if texts else F.lit(0)
            parts.append(df.agg(F.count("*").alias("n_rows"), F.sum(total).alias("total"), chars.cast("long").alias("chars"))
                         .select(F.lit(name).alias("dataset"), F.lit(level).alias("level"), "n_rows", "total", "chars"))
    return reduce(DataFrame.unionByName, parts)


@query("quoted_csv_layer", f"""
WITH o AS (SELECT o_orderkey, o_orderstatus AS st, o_orderpriority AS pr, o_totalprice AS price, o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT {_POST_TITLE} AS title, 'https://example.org/posts/' || o_orderkey AS link, st AS post_type, pr AS campaign, 'customer ' || o_custkey AS author,
  d AS posted, CASE WHEN st <> 'P' THEN d END AS campaign_start, CAST(NULL AS DATE) AS campaign_end, CAST(floor(price) AS BIGINT) AS impressions,
  CAST(floor(price / 1000) AS BIGINT) AS likes, CAST(0.01 AS DOUBLE) AS ctr,
  CASE WHEN day(d) > 15 THEN last_day(d) ELSE make_date(year(d), month(d), 15) END AS extraction_range
FROM o WHERE pr LIKE '1%'
""")
def quoted_csv_layer(spark, sf_dir):
    """Every post through the per-extraction layer as fully quoted CSV: titles with quotes,
    separators and line breaks, dates, NULLs, whole and fractional numbers."""
    from stratum.sources.clean import read_dataset

    clean = _written_layer(spark, sf_dir, fmt="csv", categories=["content"])
    posts = read_dataset(spark, clean, "content_posts", fmt="csv")
    names = {"Post Title": "title", "Post Link": "link", "Post Type": "post_type", "Campaign Name": "campaign", "Published by": "author", "Date": "posted",
             "Campaign Start Date": "campaign_start", "Campaign End Date": "campaign_end", "Impressions": "impressions", "Likes": "likes",
             "Click-Through Rate (CTR)": "ctr", "Extraction Range": "extraction_range"}
    return posts.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])


@query("run_metrics", """
SELECT o_orderpriority AS environment, 'append' AS engine, CAST(count(*) AS DOUBLE) AS extract_data,
  CAST(count(DISTINCT o_custkey) AS DOUBLE) AS transform_data, CAST(count(*) + count(DISTINCT o_custkey) AS DOUBLE) AS total_etl_time
FROM orders GROUP BY o_orderpriority
""")
def run_metrics(spark, sf_dir):
    """A metrics table that grows by one appended row a run and is read back as CSV."""
    import os
    import uuid

    from stratum.session import checkpoint_dir
    from stratum.sinks.writers import append_row
    from stratum.sources.clean import METRICS_M1, read_metrics_csv

    path = os.path.join(checkpoint_dir(spark), f"metrics-{uuid.uuid4().hex}")
    runs = load(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("c"))
    for r in runs.collect():  # one row a run
        row = {"environment": r["o_orderpriority"], "engine": "append", "extract_data": float(r["n"]), "transform_data": float(r["c"]), "total_etl_time": float(r["n"] + r["c"])}
        append_row(spark, path, row, METRICS_M1, fmt="csv")
    return read_metrics_csv(spark, path, METRICS_M1).select("environment", "engine", "extract_data", "transform_data", "total_etl_time")


@query("partition_rerun", """
SELECT event_type, CAST(count(*) AS BIGINT) AS n_events, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type
""")
def partition_rerun(spark, sf_dir):
    """Writing a partition again, or nothing at all, leaves one copy of every row."""
    import os
    import uuid

    from stratum.session import checkpoint_dir
    from stratum.sinks.writers import write_table

    path = os.path.join(checkpoint_dir(spark), f"rerun-{uuid.uuid4().hex}")
    events = load(spark, sf_dir, "events").select("event_id", "event_type")
    for rows in (events, events.filter("event_type = 'purchase'"), events.filter("event_type = 'no such type'"), events.filter("event_type = 'purchase'")):
        write_table(rows, path, partition_by=["event_type"])
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n_events"), F.sum("event_id").alias("ids"))


# ---------------------------------------------------------------------------
# Groups in pages, widening unions, dates by column, day means of single rows
# ---------------------------------------------------------------------------

@query("group_pages", """
SELECT c_nationkey, CAST((rn - 1) // 100 AS BIGINT) AS page, CAST(count(*) AS BIGINT) AS n_members,
  string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS members
FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer)
GROUP BY 1, 2
""")
def group_pages(spark, sf_dir):
    """The customers of each nation, a hundred a row."""
    pages = P.group_pages(load(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", page_size=100)
    return pages.withColumn("members", F.array_join("members", ","))


@query("first_seen_pages", """
WITH f AS (SELECT user_id, event_type, min(event_id) AS seen FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY seen, user_id) AS rn FROM f)
SELECT event_type, CAST((rn - 1) // 50 AS BIGINT) AS page, CAST(count(*) AS BIGINT) AS n_members,
  string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY rn) AS members FROM r GROUP BY 1, 2
""")
def first_seen_pages(spark, sf_dir):
    """The users of each event type in the order in which they are first seen."""
    pages = P.group_pages(load(spark, sf_dir, "events"), "event_type", "user_id", page_size=50, first_seen="event_id")
    return pages.withColumn("members", F.array_join("members", ","))


@query("union_widened", """
SELECT o_orderkey AS id, o_totalprice AS amount, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS at, CAST(NULL AS VARCHAR) AS note FROM orders
UNION ALL SELECT event_id, value, ts, NULL FROM events
UNION ALL SELECT p_partkey, CAST(p_size AS DOUBLE), NULL, p_name FROM part
""")
def union_widened(spark, sf_dir):
    """Tables of other columns and types, by name: whole numbers and doubles, dates and timestamps."""
    o, e, p = (load(spark, sf_dir, t) for t in ("orders", "events", "part"))
    rows, _ = U.union_widened([
        o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.to_date("o_orderdate").alias("at")),
        e.select(F.col("ts").alias("AT"), F.col("event_id").alias("id"), F.col("value").alias("Amount")),
        p.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("int").alias("amount"), F.col("p_name").alias("note"))])
    return rows


@query("dates_by_column", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed, CASE WHEN o_orderpriority < '3' THEN 'day first' ELSE 'month first' END AS day_month_order FROM orders
""")
def dates_by_column(spark, sf_dir):
    """Dates as text, one column of cells per order priority: which of day and month stands
    first is found from the whole column, then each cell is parsed once."""
    from stratum.functions import dates as D

    d = F.to_date("o_orderdate")
    text = F.when(F.col("o_orderpriority") < "3", F.date_format(d, "d/M/yyyy")).otherwise(F.date_format(d, "M/d/yyyy"))
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", text.alias("cell"))
    masks = o.groupBy("o_orderpriority").agg(F.bit_and(D.order_mask(F.col("cell"))).alias("mask"))
    label = F.when(F.col("mask") == D.DAY_FIRST, "day first").when(F.col("mask") == D.MONTH_FIRST, "month first")
    return o.join(masks, "o_orderpriority").select("o_orderkey", C.parse_date("cell", F.col("mask")).alias("parsed"), label.alias("day_month_order"))


@query("moving_avg_days_rows", """
SELECT event_id, event_type, ROUND(AVG(value) OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE)
  RANGE BETWEEN INTERVAL 2 DAYS PRECEDING AND CURRENT ROW), 6) AS ma_3d FROM events
""")
def moving_avg_days_rows(spark, sf_dir):
    """The 3-day mean of single events, many to a day: a window over daily partials."""
    ev = load(spark, sf_dir, "events").select("event_id", "event_type", F.to_date("ts").alias("day"), "value")
    return rolling_mean_days(ev, "event_type", "day", {"ma_3d": "value"}).select("event_id", "event_type", F.round("ma_3d", 6).alias("ma_3d"))
