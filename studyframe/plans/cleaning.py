"""Ingest, typing, derivation and missing-flag studies on the test tables.

Planted variants (null tokens, bad numbers and dates, drifting headers) are made
inside each query from the table's own columns and mirrored in the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean
from ..sources import ingest
from ..spec import ColumnSpec
from .tables import table

# ---------------------------------------------------------------- S3/S4/U1/P1–P3

PARTY_MAP = {
    "party_key": ["Key", "key"],
    "party_name": "Name",
    "nation_key": ["nation", "NationKey"],
    "acct_balance": ["Balance", "acct bal"],
    "segment": ["Segment"],
}

PARTY_SPECS = (
    ColumnSpec(name="party_key", kind="numeric"),
    ColumnSpec(name="party_name", kind="text"),
    ColumnSpec(name="nation_key", kind="categorical"),
    ColumnSpec(name="acct_balance", kind="numeric"),
    ColumnSpec(name="segment", kind="categorical"),
)


def _raw_parties(spark, sf_dir):
    """customer and supplier as two 'files' whose headers drift (all strings)."""
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("Key "), F.col("c_name").cast("string").alias(" Name"),
        F.col("c_nationkey").cast("string").alias("nation"), F.col("c_acctbal").cast("string").alias("Balance"),
        F.col("c_mktsegment").alias("Segment"), F.lit("x").alias("comment"))
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("key"), F.col("s_name").alias("Name"),
        F.col("s_nationkey").cast("string").alias("NationKey"), F.col("s_acctbal").cast("string").alias("acct bal"))
    return [c.toDF(*[x.strip() for x in c.columns]), s]


def party_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = ingest.harmonize_all(_raw_parties(spark, sf_dir), PARTY_MAP)
    typed = clean.apply_schema(merged, PARTY_SPECS, PARTY_MAP)
    return clean.reorder(typed, ["segment", "party_key"])


PARTY_SQL = """
SELECT segment, TRY_CAST(party_key AS DOUBLE) AS party_key, trim(party_name) AS party_name,
       nation_key, TRY_CAST(acct_balance AS DOUBLE) AS acct_balance
FROM (
  SELECT CAST(c_custkey AS VARCHAR) AS party_key, c_name AS party_name, CAST(c_nationkey AS VARCHAR) AS nation_key,
         CAST(c_acctbal AS VARCHAR) AS acct_balance, c_mktsegment AS segment FROM customer
  UNION ALL BY NAME
  SELECT CAST(s_suppkey AS VARCHAR) AS party_key, s_name AS party_name, CAST(s_nationkey AS VARCHAR) AS nation_key,
         CAST(s_acctbal AS VARCHAR) AS acct_balance FROM supplier
)
"""


# ----------------------------------------------------------------- P5–P7, P11

PRIORITY_SPECS = (
    ColumnSpec(name="priority", kind="categorical", nulls=("4-NOT SPECIFIED",),
               replace={"1-URGENT": "2-HIGH", "2-HIGH": "HIGH"}),
    ColumnSpec(name="status", kind="categorical", ordered=("F", "O")),
    ColumnSpec(name="priority_rank", kind="categorical", ordered=(1, 2, 3, 5)),
)


def _raw_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        F.substring("o_orderpriority", 1, 1).alias("priority_rank"),
    )


def priority_clean_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = clean.apply_schema(_raw_orders(spark, sf_dir), PRIORITY_SPECS)
    return typed.groupBy("priority", "status", "priority_rank").agg(F.count(F.lit(1)).alias("n"))


PRIORITY_SQL = """
WITH r AS (
  SELECT CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END AS p0,
         CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus END AS status,
         CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '3', '5') THEN substr(o_orderpriority, 1, 1) END AS rk
  FROM orders
), s AS (
  SELECT CASE WHEN p1 = '2-HIGH' THEN 'HIGH' ELSE p1 END AS priority, status, TRY_CAST(rk AS INTEGER) AS priority_rank
  FROM (SELECT CASE WHEN p0 = '1-URGENT' THEN '2-HIGH' ELSE p0 END AS p1, status, rk FROM r)
)
SELECT priority, status, priority_rank, count(*) AS n FROM s GROUP BY ALL
"""


def priority_schema_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.schema_audit(_raw_orders(spark, sf_dir), PRIORITY_SPECS)


PRIORITY_AUDIT_SQL = """
WITH r AS (SELECT o_orderpriority AS priority, o_orderstatus AS status, substr(o_orderpriority, 1, 1) AS rk FROM orders),
n AS (SELECT count(*) AS n FROM r)
SELECT 'priority' AS "column", n AS n_rows, 0::BIGINT AS null_raw,
       (SELECT count(*) FROM r WHERE priority = '4-NOT SPECIFIED') AS null_after_tokens,
       (SELECT count(*) FROM r WHERE priority = '4-NOT SPECIFIED') AS null_after_cast,
       (SELECT count(*) FROM r WHERE priority = '4-NOT SPECIFIED') AS new_null_tokens, 0::BIGINT AS new_null_cast FROM n
UNION ALL
SELECT 'status', n, 0, (SELECT count(*) FROM r WHERE status NOT IN ('F', 'O')), (SELECT count(*) FROM r WHERE status NOT IN ('F', 'O')),
       (SELECT count(*) FROM r WHERE status NOT IN ('F', 'O')), 0 FROM n
UNION ALL
SELECT 'priority_rank', n, 0, (SELECT count(*) FROM r WHERE rk NOT IN ('1', '2', '3', '5')),
       (SELECT count(*) FROM r WHERE rk NOT IN ('1', '2', '3', '5')), (SELECT count(*) FROM r WHERE rk NOT IN ('1', '2', '3', '5')), 0 FROM n
"""


# ----------------------------------------------------------------- P8–P10, P13

EVENT_SPECS = (
    ColumnSpec(name="value_raw", kind="numeric", nulls=("n/a",)),
    ColumnSpec(name="ts_raw", kind="datetime"),
    ColumnSpec(name="wait_raw", kind="timedelta"),
    ColumnSpec(name="event_type", kind="text"),
)


def _raw_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    value_raw = (F.when(eid % 11 == 0, F.lit("n/a")).when(eid % 13 == 0, F.lit("abc"))
                 .otherwise(F.format_string("%.2f", F.col("value"))))
    ts_raw = (F.when(eid % 17 == 0, F.lit("thirty first december 2025"))
              .when(eid % 3 == 0, F.date_format("ts", "dd.MM.yyyy HH:mm"))
              .when(eid % 3 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
              .otherwise(F.date_format("ts", "dd/MM/yyyy")))
    wait_raw = (F.when(eid % 19 == 0, F.lit("soon"))
                .otherwise(F.format_string("%d %02d:%02d:%02d", eid % 4, F.hour("ts"), F.minute("ts"), F.second("ts"))))
    return e.select("event_id", value_raw.alias("value_raw"), ts_raw.alias("ts_raw"), wait_raw.alias("wait_raw"),
                    F.concat(F.lit("  "), F.col("event_type"), F.lit(" ")).alias("event_type"))


def events_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = clean.apply_schema(_raw_events(spark, sf_dir), EVENT_SPECS)
    base = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    return t.select(
        "event_id", F.col("value_raw").alias("value_num"),
        F.date_format("ts_raw", "yyyy-MM-dd HH:mm:ss").alias("ts_text"),
        F.timestamp_diff("SECOND", base, base + F.col("wait_raw")).alias("wait_seconds"),
        "event_type",
    )


EVENTS_TYPED_SQL = r"""
WITH r AS (
  SELECT event_id,
    CASE WHEN event_id % 11 = 0 THEN 'n/a' WHEN event_id % 13 = 0 THEN 'abc' ELSE printf('%.2f', value) END AS value_raw,
    CASE WHEN event_id % 17 = 0 THEN 'thirty first december 2025'
         WHEN event_id % 3 = 0 THEN strftime(ts, '%d.%m.%Y %H:%M')
         WHEN event_id % 3 = 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
         ELSE strftime(ts, '%d/%m/%Y') END AS ts_raw,
    CASE WHEN event_id % 19 = 0 THEN 'soon'
         ELSE printf('%d %02d:%02d:%02d', event_id % 4, hour(ts), minute(ts), CAST(floor(second(ts)) AS INTEGER)) END AS wait_raw,
    trim('  ' || event_type || ' ') AS event_type
  FROM events
)
SELECT event_id,
  CASE WHEN value_raw = 'n/a' THEN NULL ELSE TRY_CAST(value_raw AS DOUBLE) END AS value_num,
  strftime(coalesce(try_strptime(ts_raw, '%Y-%m-%d %H:%M:%S'), try_strptime(ts_raw, '%d.%m.%Y %H:%M'),
                    try_strptime(ts_raw, '%d/%m/%Y')), '%Y-%m-%d %H:%M:%S') AS ts_text,
  CASE WHEN regexp_matches(wait_raw, '^\d+ \d\d:\d\d:\d\d$')
       THEN CAST(split_part(wait_raw, ' ', 1) AS BIGINT) * 86400
          + CAST(substr(split_part(wait_raw, ' ', 2), 1, 2) AS BIGINT) * 3600
          + CAST(substr(split_part(wait_raw, ' ', 2), 4, 2) AS BIGINT) * 60
          + CAST(substr(split_part(wait_raw, ' ', 2), 7, 2) AS BIGINT) END AS wait_seconds,
  event_type
FROM r
"""


def events_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct raw values the casts rejected, with counts."""
    return clean.rejected_values(_raw_events(spark, sf_dir), EVENT_SPECS)


EVENTS_REJECTED_SQL = r"""
WITH r AS (
  SELECT event_id,
    CASE WHEN event_id % 11 = 0 THEN 'n/a' WHEN event_id % 13 = 0 THEN 'abc' ELSE printf('%.2f', value) END AS value_raw,
    CASE WHEN event_id % 17 = 0 THEN 'thirty first december 2025' ELSE 'ok' END AS ts_bad,
    CASE WHEN event_id % 19 = 0 THEN 'soon' ELSE 'ok' END AS wait_bad
  FROM events
)
SELECT "column", raw_value, count(*) AS n FROM (
  SELECT 'value_raw' AS "column", value_raw AS raw_value FROM r WHERE value_raw = 'abc'
  UNION ALL SELECT 'ts_raw', ts_bad FROM r WHERE ts_bad <> 'ok'
  UNION ALL SELECT 'wait_raw', wait_bad FROM r WHERE wait_bad <> 'ok'
) GROUP BY ALL
"""


# ----------------------------------------------------------------- D3–D7

CALENDAR_SPECS = tuple(
    ColumnSpec(name=f"ts_{u}", kind="datetime", derive_from=("ts",), datetime_units=u)
    for u in ("hour", "dow", "workday_bool", "month_name", "year")
)


def calendar_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("ts")
    d = clean.apply_derived(e, CALENDAR_SPECS)
    return d.groupBy(*[s.name for s in CALENDAR_SPECS]).agg(F.count(F.lit(1)).alias("n"))


CALENDAR_SQL = """
SELECT hour(ts) AS ts_hour, dayname(ts) AS ts_dow, coalesce(isodow(ts) < 6, false) AS ts_workday_bool,
       monthname(ts) AS ts_month_name, CASE WHEN year(ts) >= 0 THEN year(ts) END AS ts_year, count(*) AS n
FROM events GROUP BY ALL
"""


# ----------------------------------------------------------------- P15, P14

def _customers_with_nulls(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(
        "c_custkey", "c_name", "c_nationkey",
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")).alias("c_mktsegment"),
    )


def customer_missing_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = (ColumnSpec(name="c_name", kind="text", keep=False),)
    flagged = clean.missing_flags(_customers_with_nulls(spark, sf_dir), specs)
    return clean.drop_unkept(flagged, specs)


CUSTOMER_FLAGS_SQL = """
SELECT c_custkey, c_nationkey, acct AS c_acctbal, seg AS c_mktsegment,
       acct IS NULL AS c_acctbal_missing, seg IS NULL AS c_mktsegment_missing
FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS acct,
             nullif(c_mktsegment, 'MACHINERY') AS seg FROM customer)
"""


def customer_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: shape and null cells of the planted-null customer frame."""
    return clean.frame_shape(_customers_with_nulls(spark, sf_dir))


CUSTOMER_SHAPE_SQL = """
SELECT count(*) AS n_rows, 5 AS n_cols,
       count_if(c_custkey % 7 = 0) + count_if(c_mktsegment = 'MACHINERY') AS null_cells,
       round((count_if(c_custkey % 7 = 0) + count_if(c_mktsegment = 'MACHINERY')) * 100.0 / (count(*) * 5), 2) AS null_pct
FROM customer
"""


def party_csv_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1–S5, U1, U3, P1–P4 on files: customer and supplier are written by Spark as
    CSV (their own drifting headers, several part files each) under the shared
    scratch folder, then discovered, header-checked and merged back by name."""
    import uuid

    from ..session import shared_path
    root = shared_path(spark, f"csv-{uuid.uuid4().hex}")
    raw = _raw_parties(spark, sf_dir)
    for i, f in enumerate(raw):
        f.write.option("header", True).mode("overwrite").csv(f"{root}/part{i}")
    paths = ingest.discover(spark, f"{root}/*", pattern="*.csv")
    diff = ingest.header_diff(spark, paths)
    if diff.where(F.size("missing") + F.size("extra") > 0).count() == 0:
        raise ValueError("expected drifting headers")
    merged = ingest.merge(spark, paths, PARTY_MAP)
    typed = clean.apply_schema(merged, PARTY_SPECS, PARTY_MAP)
    return clean.reorder(typed, ["segment", "party_key"]).drop("_src_file", "_src_order")


def _party_files(spark, sf_dir):
    """Customer and supplier as CSV files with drifting headers, under part0 and part1."""
    import uuid

    from ..session import shared_path
    root = shared_path(spark, f"csv-{uuid.uuid4().hex}")
    for i, f in enumerate(_raw_parties(spark, sf_dir)):
        f.write.option("header", True).mode("overwrite").csv(f"{root}/part{i}")
    return ingest.discover(spark, f"{root}/*", pattern="*.csv")


def _part_of(path):
    return F.when(path.contains("/part0/"), 0).otherwise(1)


def party_header_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the headers of each part lack and add against the first file, and the union of all headers."""
    paths = _party_files(spark, sf_dir)
    union = ingest.union_header(spark, paths)
    return ingest.header_diff(spark, paths).select(
        _part_of(F.col("file")).alias("part"), F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"),
        F.lit(",".join(union)).alias("union_header")).distinct()


PARTY_DIFF_SQL = """
SELECT * FROM (VALUES
  (0, '', '', 'Key,Name,nation,Balance,Segment,comment,key,NationKey,acct bal'),
  (1, 'Key,nation,Balance,Segment,comment', 'key,NationKey,acct bal', 'Key,Name,nation,Balance,Segment,comment,key,NationKey,acct bal')
) v(part, missing, extra, union_header)
"""


def party_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most rows shown of a file of each part, over the columns of the union header (Key and key share one)."""
    shown = ingest.preview(spark, _party_files(spark, sf_dir), n=3)
    by_file = shown.groupBy("_src_file").agg(F.count(F.lit(1)).alias("n"))
    return by_file.groupBy(_part_of(F.col("_src_file")).alias("part")).agg(
        F.max("n").alias("n_rows"), F.first(F.lit(len(shown.columns) - 1)).alias("n_cols"))


PARTY_PREVIEW_SQL = """
SELECT 0 AS part, least(3, count(*)) AS n_rows, 8 AS n_cols FROM customer
UNION ALL SELECT 1, least(3, count(*)), 8 FROM supplier
"""


def events_stream_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3–D7 on a stream: the events table is read with ``readStream``, calendar
    parts are derived per row inside the stream, written with an available-now
    trigger (checkpointed in the shared folder), and the sink is counted."""
    import uuid

    from ..session import shared_path
    from ..streaming import stateless
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").schema
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
              .parquet(sf_dir.rstrip("/")))
    rows = clean.apply_derived(stream.select("ts"), CALENDAR_SPECS)
    base = shared_path(spark, f"stream-{uuid.uuid4().hex}")
    stateless.run_available(rows, f"{base}/sink", f"{base}/checkpoint")
    out = spark.read.parquet(f"{base}/sink")
    return out.groupBy(*[s.name for s in CALENDAR_SPECS]).agg(F.count(F.lit(1)).alias("n"))
