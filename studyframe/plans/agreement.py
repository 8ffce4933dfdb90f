"""Flagship study on the order tables: status-family agreement between an order and
its lines, by ship weekday, workday and ship delay (D1, D2, D4, D5, D8, C1–C5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import clean, cohort
from ..spec import ColumnSpec, TaskSpec
from .tables import table

AGREEMENT_SPECS = (
    ColumnSpec(name="status_agree", kind="match", derive_from=("o_orderstatus", "l_linestatus"), match_by=("F",)),
    ColumnSpec(name="ship_delay_days", kind="timedelta", derive_from=("o_orderdate", "l_shipdate"),
               timedelta_units="days"),
    ColumnSpec(name="ship_dow", kind="datetime", derive_from=("l_shipdate",), datetime_units="dow"),
    ColumnSpec(name="ship_workday", kind="datetime", derive_from=("l_shipdate",), datetime_units="workday_bool"),
)

AGREEMENT_TASK = TaskSpec(name="status family agreement", target_column="status_agree", positive_class=True,
                          inclusion_criteria={"status_agree": "non-NaN"})


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⋈ orders on the order key, only the columns the study uses.

    Both sides grow with the data, so this stays a shuffle join (Catalyst/AQE may
    still switch to a broadcast at run time when the orders side measures small).
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus", "l_shipdate")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return li.join(od, li.l_orderkey == od.o_orderkey)


def derived_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.apply_derived(order_lines(spark, sf_dir), AGREEMENT_SPECS)


def agreement_by_ship_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Only evaluable rows enter the cohort, and a row is evaluable only when the
    # order's status is in the family: applying that before the join lets the
    # predicate reach the orders scan and shrinks the join input.
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus", "l_shipdate")
    od = (table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
          .where(X.any_prefix("o_orderstatus", X.normalise_prefixes(AGREEMENT_SPECS[0].match_by))))
    d = clean.apply_derived(li.join(od, li.l_orderkey == od.o_orderkey), AGREEMENT_SPECS)
    c = cohort.attach_target(cohort.flag(d, AGREEMENT_TASK), AGREEMENT_TASK).where(F.col(cohort.INCLUDED))
    return c.groupBy(
        "ship_dow", "ship_workday", F.floor(F.col("ship_delay_days") / 7).cast("long").alias("delay_weeks")
    ).agg(
        F.count(F.lit(1)).alias("n_evaluable"),
        F.count_if(F.col("target")).alias("n_match"),
        F.round(F.count_if(F.col("target")) * 100.0 / F.count(F.lit(1)), 2).alias("match_rate_pct"),
    )


AGREEMENT_SQL = """
WITH j AS (
  SELECT o.o_orderstatus, l.l_linestatus, o.o_orderdate, l.l_shipdate
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
), d AS (
  SELECT
    CASE WHEN o_orderstatus IS NOT NULL AND l_linestatus IS NOT NULL AND starts_with(o_orderstatus, 'F')
         THEN starts_with(l_linestatus, 'F') END AS status_agree,
    CASE WHEN floor(date_diff('microsecond', o_orderdate, l_shipdate) / 86400000000) >= 0
         THEN CAST(floor(date_diff('microsecond', o_orderdate, l_shipdate) / 86400000000) AS BIGINT) END AS ship_delay_days,
    dayname(l_shipdate) AS ship_dow,
    coalesce(isodow(l_shipdate) < 6, false) AS ship_workday
  FROM j
)
SELECT ship_dow, ship_workday, CAST(floor(ship_delay_days / 7) AS BIGINT) AS delay_weeks,
       count(*) AS n_evaluable, count_if(status_agree) AS n_match,
       round(count_if(status_agree) * 100.0 / count(*), 2) AS match_rate_pct
FROM d WHERE status_agree IS NOT NULL
GROUP BY ALL
"""


def match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluable count and match rate of the agreement column."""
    return clean.match_summary(derived_lines(spark, sf_dir), AGREEMENT_SPECS)


MATCH_RATES_SQL = """
WITH d AS (
  SELECT CASE WHEN o.o_orderstatus IS NOT NULL AND l.l_linestatus IS NOT NULL AND starts_with(o.o_orderstatus, 'F')
              THEN starts_with(l.l_linestatus, 'F') END AS m
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
)
SELECT 'status_agree' AS "column", count(m) AS n_evaluable,
       coalesce(round(count_if(m) * 100.0 / nullif(count(m), 0), 2), 0.0) AS match_rate_pct
FROM d
"""
