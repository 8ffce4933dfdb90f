"""Profile studies on the test tables (A2–A20) with generated SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import clean, profile
from ..spec import ColumnSpec
from .tables import table

SIG = 10  # significant digits kept in floating results compared against the oracle


def sig(c, digits: int = SIG):
    """Round to ``digits`` significant digits with plain IEEE operations, so that
    two engines that differ only in summation order agree (no decimal ties)."""
    x = F.col(c) if isinstance(c, str) else c
    p = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    finite = ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.when(x == 0, F.lit(0.0)).when(finite, F.round(x * p, 0) / p).otherwise(x)


def rounded(df: DataFrame, digits: int = SIG) -> DataFrame:
    return df.select(*[sig(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f.name) for f in df.schema.fields])


def sig_sql(e: str, digits: int = SIG) -> str:
    p = f"pow(10.0, {digits - 1} - floor(log10(abs({e}))))"
    return (f"CASE WHEN ({e}) = 0 THEN 0.0::DOUBLE WHEN isinf(({e})::DOUBLE) OR isnan(({e})::DOUBLE) THEN ({e})::DOUBLE "
            f"ELSE round(({e}) * {p}) / {p} END")


def sig_wrap(sql: str, cols) -> str:
    """Apply ``sig_sql`` to the named double columns of a query."""
    rep = ", ".join(f'{sig_sql(chr(34) + c + chr(34))} AS "{c}"' for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) _q"


def union_all(parts) -> str:
    return "\nUNION ALL\n".join(f"SELECT * FROM ({q}) _u{i}" for i, q in enumerate(parts))


def _band_sql(x, spec):
    edges, labels, last = spec
    parts = " ".join(f"WHEN {x} < {e} THEN '{lab}'" for e, lab in zip(edges, labels))
    return f"CASE WHEN {x} IS NULL THEN NULL {parts} ELSE '{last}' END"


# ----------------------------------------------------------------- numeric

LINEITEM_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def lineitem_numeric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(*LINEITEM_NUMERIC, "l_linestatus")
    return rounded(profile.numeric_profile(li, profile.numeric_candidates(li), skip_two_level=True))


def events_value_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return rounded(profile.numeric_profile(ev, ["value"]))


def numeric_profile_sql(tab: str, col: str) -> str:
    x = f"({col} + 0.0)"
    return f"""
SELECT '{col}' AS "column", n, n_unique, missing_pct, "max", "min", median, mean, mode, n_modes, std_pop, cv,
  trimmed_mean, iqrange, p_5th, p_95th, skewness, kurtosis,
  {_band_sql('cv', profile.CV_BANDS)} AS cv_band,
  {_band_sql('skewness', profile.SKEW_BANDS)} AS skew_band,
  {_band_sql('kurtosis', profile.KURT_BANDS)} AS kurtosis_band
FROM (
  SELECT count(x) AS n, count(DISTINCT x) AS n_unique, (count(*) - count(x)) * 100.0 / count(*) AS missing_pct,
    max(x) AS "max", min(x) AS "min", quantile_cont(x, 0.5) AS median,
    avg(x) AS mean, stddev_pop(x) AS std_pop, stddev_pop(x) / avg(x) AS cv,
    quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqrange,
    quantile_cont(x, 0.05) AS p_5th, quantile_cont(x, 0.95) AS p_95th,
    skewness(x) AS skewness, kurtosis(x) AS kurtosis
  FROM (SELECT {x} AS x FROM {tab})
) a, (
  SELECT min(x) AS mode, count(*) AS n_modes FROM (SELECT x, count(*) AS c FROM (SELECT {x} AS x FROM {tab}) WHERE x IS NOT NULL GROUP BY x)
  WHERE c = (SELECT max(c) FROM (SELECT count(*) AS c FROM (SELECT {x} AS x FROM {tab}) WHERE x IS NOT NULL GROUP BY x))
) b, (
  SELECT avg(x) AS trimmed_mean FROM (
    SELECT x, row_number() OVER (ORDER BY x) AS rn, count(*) OVER () AS n FROM (SELECT {x} AS x FROM {tab}) WHERE x IS NOT NULL)
  WHERE rn > floor(0.1 * n) AND rn <= n - floor(0.1 * n)
) c
"""


_NUM_DOUBLES = ['missing_pct', 'max', 'min', 'median', 'mean', 'mode', 'std_pop', 'cv', 'trimmed_mean', 'iqrange', 'p_5th', 'p_95th', 'skewness', 'kurtosis']
LINEITEM_NUMERIC_SQL = sig_wrap(union_all(numeric_profile_sql("lineitem", c) for c in LINEITEM_NUMERIC), _NUM_DOUBLES)
EVENTS_VALUE_SQL = sig_wrap(numeric_profile_sql("events", "value"), _NUM_DOUBLES)


def lineitem_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tied modes of the small-domain lineitem numerics."""
    li = table(spark, sf_dir, "lineitem")
    return profile.numeric_modes(li, ["l_quantity", "l_discount", "l_tax"])


def _modes_sql(col):
    return f"""SELECT '{col}' AS "column", x AS value, c AS n FROM (
  SELECT x, count(*) AS c, max(count(*)) OVER () AS m FROM (SELECT {col} + 0.0 AS x FROM lineitem) WHERE x IS NOT NULL GROUP BY x)
WHERE c = m"""


LINEITEM_MODES_SQL = union_all(_modes_sql(c) for c in ("l_quantity", "l_discount", "l_tax"))


# ----------------------------------------------------------------- categorical

PRIORITY_LEVELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def orders_categorical_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", "o_custkey")
    specs = (ColumnSpec(name="o_orderpriority", kind="categorical", ordered=PRIORITY_LEVELS),
             ColumnSpec(name="o_orderstatus", kind="categorical"))
    typed = clean.apply_schema(o, specs).drop("o_custkey")
    return rounded(profile.categorical_profile(typed, profile.categorical_candidates(typed), min_levels=3))


def part_categorical_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return rounded(profile.categorical_profile(p, ["p_brand", "p_type", "p_name"]))


def categorical_profile_sql(tab: str, col: str, levels=None) -> str:
    if levels:
        lv = ", ".join(f"('{v}', {i})" for i, v in enumerate(levels))
        med = f"""(SELECT value FROM (
      SELECT v.value, v.lrank, sum(c.n) OVER (ORDER BY v.lrank) AS cum, sum(c.n) OVER () AS tot
      FROM (VALUES {lv}) v(value, lrank) JOIN c ON c.value = v.value) WHERE cum >= tot * 0.5 ORDER BY lrank LIMIT 1)"""
    else:
        med = "CAST(NULL AS VARCHAR)"
    return f"""
WITH c AS (SELECT CAST({col} AS VARCHAR) AS value, count(*) AS n FROM {tab} WHERE {col} IS NOT NULL GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value ASC) AS rk, row_number() OVER (ORDER BY n ASC, value DESC) AS rr FROM c),
s AS (SELECT sum(n) AS tot, count(*) AS k, -sum(n * 1.0 / (SELECT sum(n) FROM c) * log2(n * 1.0 / (SELECT sum(n) FROM c))) AS h2,
             -sum(n * 1.0 / (SELECT sum(n) FROM c) * ln(n * 1.0 / (SELECT sum(n) FROM c))) AS he FROM c)
SELECT '{col}' AS "column", s.tot AS n, s.k AS n_unique,
  ((SELECT count(*) FROM {tab}) - s.tot) * 100.0 / (SELECT count(*) FROM {tab}) AS missing_pct,
  (SELECT value FROM r WHERE rk = 1) AS first_mode, (SELECT value FROM r WHERE rk = 2) AS second_mode,
  (SELECT value FROM r WHERE rr = 1) AS rarest,
  (SELECT n FROM r WHERE rr = 1) * 100.0 / s.tot AS rarest_pct,
  (SELECT n FROM r WHERE rk = 1) * 100.0 / s.tot AS first_mode_pct,
  (SELECT n FROM r WHERE rk = 2) * 100.0 / s.tot AS second_mode_pct,
  (SELECT n FROM r WHERE rk = 1) * 1.0 / (SELECT n FROM r WHERE rk = 2) AS max_class_imbalance,
  {med} AS median_category,
  CASE WHEN s.k > 1 THEN s.he / ln(s.k) ELSE 0.0 END AS balance,
  s.h2 AS entropy_bin,
  {_band_sql('s.k', profile.CARDINALITY_BANDS)} AS cardinality_band,
  {_band_sql('((SELECT n FROM r WHERE rk = 1) * 1.0 / (SELECT n FROM r WHERE rk = 2))', profile.IMBALANCE_BANDS)} AS imbalance_band,
  {_band_sql('s.h2', profile.CAT_ENTROPY_BANDS)} AS entropy_band,
  {_band_sql('CASE WHEN s.k > 1 THEN s.he / ln(s.k) ELSE 0.0 END', profile.CAT_BALANCE_BANDS)} AS balance_band
FROM s
"""


_CAT_DOUBLES = ['missing_pct', 'rarest_pct', 'first_mode_pct', 'second_mode_pct', 'max_class_imbalance', 'balance', 'entropy_bin']
ORDERS_CATEGORICAL_SQL = sig_wrap(union_all([categorical_profile_sql("orders", "o_orderpriority", PRIORITY_LEVELS),
                                             categorical_profile_sql("orders", "o_orderstatus")]), _CAT_DOUBLES)
PART_CATEGORICAL_SQL = sig_wrap(union_all(categorical_profile_sql("part", c) for c in ("p_brand", "p_type", "p_name")),
                                _CAT_DOUBLES)


# ----------------------------------------------------------------- binary

def _lines_binary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_returnflag", "l_orderkey")
    return li.withColumn("l_orderkey_missing", F.col("l_orderkey") % 9 == 0).drop("l_orderkey")


def lineitem_binary_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lines_binary(spark, sf_dir)
    # Any column with exactly two observed levels; the profile keeps only those
    return rounded(profile.binary_profile(li, li.columns))


def binary_profile_sql(col: str, expr: str, is_flag: bool = False) -> str:
    miss = "CAST(NULL AS DOUBLE)" if is_flag else f"(count(*) - count(v)) * 100.0 / count(*)"
    return f"""
WITH b AS (SELECT CAST({expr} AS VARCHAR) AS v FROM lineitem),
c AS (SELECT v AS value, count(*) AS n FROM b WHERE v IS NOT NULL GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value ASC) AS rk FROM c),
s AS (SELECT (SELECT value FROM r WHERE rk = 1) AS cat1, (SELECT value FROM r WHERE rk = 2) AS cat0,
             (SELECT n FROM r WHERE rk = 1) AS n1, (SELECT n FROM r WHERE rk = 2) AS n0, (SELECT sum(n) FROM c) AS tot),
m AS (SELECT {miss} AS missing_pct {"" if is_flag else "FROM b"})
SELECT '{col}' AS "column", cat1, cat0, tot AS n, missing_pct,
  n1 * 1.0 / tot AS p1, n0 * 1.0 / tot AS p0,
  CASE WHEN n1 * 1.0 / n0 > 1.1 THEN cat1 ELSE 'equal' END AS mode,
  CASE WHEN n1 * 1.0 / n0 > 1.1 THEN n1 * 100.0 / tot ELSE n0 * 100.0 / tot END AS mode_pct,
  2 * least(n1, n0) * 1.0 / tot AS balance,
  -(n1 * 1.0 / tot * log2(n1 * 1.0 / tot) + n0 * 1.0 / tot * log2(n0 * 1.0 / tot)) AS entropy_bin,
  {_band_sql('2 * least(n1, n0) * 1.0 / tot', profile.BIN_BALANCE_BANDS)} AS balance_band,
  {_band_sql('-(n1 * 1.0 / tot * log2(n1 * 1.0 / tot) + n0 * 1.0 / tot * log2(n0 * 1.0 / tot))', profile.BIN_ENTROPY_BANDS)} AS entropy_band
FROM s, m
"""


LINEITEM_BINARY_SQL = sig_wrap(union_all([binary_profile_sql("l_linestatus", "l_linestatus"),
                                          binary_profile_sql("l_orderkey_missing", "l_orderkey % 9 = 0", is_flag=True)]),
                               ['missing_pct', 'p1', 'p0', 'mode_pct', 'balance', 'entropy_bin'])


# ----------------------------------------------------------------- A18, A19, A2, A20

def document_effective_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return profile.effective_unique(d, ["lang", "source"])


DOC_EFFECTIVE_SQL = """
SELECT "column", count_if(n >= tot * 0.01) AS effective_unique FROM (
  SELECT 'lang' AS "column", lang AS v, count(*) AS n, sum(count(*)) OVER () AS tot FROM documents GROUP BY lang
  UNION ALL
  SELECT 'source', source, count(*), sum(count(*)) OVER () FROM documents GROUP BY source
) GROUP BY 1
"""


def lineitem_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return rounded(profile.histogram(li, ["l_quantity", "l_discount"], bins=20))


LINEITEM_HISTOGRAM_SQL = f"""
WITH q AS (SELECT min(l_quantity) AS mn, (max(l_quantity) - min(l_quantity)) / 20 AS w FROM lineitem),
hq AS (
  SELECT 'l_quantity' AS "column", q.mn + least(floor((l_quantity + 0.0 - q.mn) / q.w), 19) * q.w AS lower, q.w AS w
  FROM lineitem, q
), hd AS (
  SELECT 'l_discount' AS "column", l_discount + 0.0 AS lower, CAST(NULL AS DOUBLE) AS w FROM lineitem
), u AS (SELECT * FROM hq UNION ALL SELECT * FROM hd),
c AS (SELECT "column", lower, w, count(*) AS n FROM u GROUP BY ALL)
SELECT "column", lower AS lower, CASE WHEN w IS NULL THEN lower ELSE lower + w END AS upper, n,
       n * 1.0 / sum(n) OVER (PARTITION BY "column") AS share,
       coalesce(n * 1.0 / sum(n) OVER (PARTITION BY "column") / w, n * 1.0 / sum(n) OVER (PARTITION BY "column")) AS density
FROM c
"""
LINEITEM_HISTOGRAM_SQL = sig_wrap(LINEITEM_HISTOGRAM_SQL, ["lower", "upper", "share", "density"])


def part_value_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return profile.value_extremes(p, ["p_brand", "p_type", "p_size"], k=5)


PART_EXTREMES_SQL = """
WITH c AS (
  SELECT 'p_brand' AS "column", p_brand AS value, count(*) AS n FROM part GROUP BY 2
  UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2
  UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY 2
)
SELECT "column", 'common' AS side, rk AS "rank", value, n FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value ASC) AS rk FROM c) WHERE rk <= 5
UNION ALL
SELECT "column", 'rare', rk, value, n FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n ASC, value DESC) AS rk FROM c) WHERE rk <= 5
"""


def lineitem_value_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_returnflag", "l_shipdate")
    return rounded(profile.value_overview(li))


def _overview_sql(col, dtype, numeric):
    if numeric:
        nums = f"min({col}), max({col}), avg({col}), stddev_samp({col})"
    else:
        nums = "NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE"
    return (f"SELECT '{col}' AS \"column\", '{dtype}' AS dtype, count(*) - count({col}) AS n_null, "
            f"count(DISTINCT {col}) AS n_unique, {nums} FROM lineitem")


LINEITEM_OVERVIEW_SQL = ("SELECT \"column\", dtype, n_null, n_unique, c4 AS \"min\", c5 AS \"max\", c6 AS mean, c7 AS std_samp FROM ("
                         + "\nUNION ALL\n".join([
                             _overview_sql("l_quantity", "double", True),
                             _overview_sql("l_discount + 0.0", "double", True).replace("'l_discount + 0.0'", "'l_discount'"),
                             _overview_sql("l_returnflag", "string", False),
                             _overview_sql("l_shipdate", "timestamp_ntz", False),
                         ]) + ") t(\"column\", dtype, n_null, n_unique, c4, c5, c6, c7)")
LINEITEM_OVERVIEW_SQL = sig_wrap(LINEITEM_OVERVIEW_SQL, ["min", "max", "mean", "std_samp"])


def customer_missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cleaning import _customers_with_nulls
    return rounded(profile.missingness_ranking(_customers_with_nulls(spark, sf_dir), top_n=20))


CUSTOMER_MISSINGNESS_SQL = f"""
SELECT * FROM (
  SELECT 'c_acctbal' AS "column", count_if(c_custkey % 7 = 0) AS n_missing, count_if(c_custkey % 7 = 0) * 100.0 / count(*) AS missing_pct FROM customer
  UNION ALL
  SELECT 'c_mktsegment', count_if(c_mktsegment = 'MACHINERY'), count_if(c_mktsegment = 'MACHINERY') * 100.0 / count(*) FROM customer
) WHERE n_missing > 0
"""
CUSTOMER_MISSINGNESS_SQL = sig_wrap(CUSTOMER_MISSINGNESS_SQL, ["missing_pct"])
