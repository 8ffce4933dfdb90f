"""Column-expression builders.  Everything here returns a ``pyspark.sql.Column``
made of built-in functions, so it stays inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens a CSV reader commonly treats as missing, applied right
# after an all-strings read (Spark's reader takes a single nullValue).
DEFAULT_NULL_TOKENS = ("", "NA", "N/A", "n/a", "NaN", "nan", "NULL", "null", "None", "<NA>", "-NaN", "-nan",
                       "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "1.#IND", "1.#QNAN")

# Ordered day-first datetime formats tried after ISO parsing.
DAYFIRST_FORMATS = (
    "dd.MM.yyyy HH:mm:ss",
    "dd.MM.yyyy HH:mm",
    "dd.MM.yyyy",
    "dd/MM/yyyy HH:mm:ss",
    "dd/MM/yyyy HH:mm",
    "dd/MM/yyyy",
    "dd-MM-yyyy HH:mm:ss",
    "dd-MM-yyyy HH:mm",
    "dd-MM-yyyy",
)

# Microseconds per duration unit.
UNIT_MICROS = {
    "seconds": 1_000_000,
    "minutes": 60_000_000,
    "hours": 3_600_000_000,
    "days": 86_400_000_000,
}

# Calendar level orders.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONTHS = ("January", "February", "March", "April", "May", "June", "July",
          "August", "September", "October", "November", "December")


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_tokens(c, tokens) -> Column:
    """Value tokens → NULL (P5).  Compared as strings: the raw frame is all strings."""
    c = col_of(c)
    toks = [str(t) for t in tokens]
    return F.when(c.isin(toks), F.lit(None)).otherwise(c)


def in_domain(c, levels) -> Column:
    """Keep values of a declared ordered domain, everything else → NULL."""
    c = col_of(c)
    return F.when(c.isin([str(v) for v in levels]), c)


def cascade_replace(c, mapping: dict) -> Column:
    """Apply ``old → new`` pairs one after another (P7): a→b then b→c turns a into c."""
    c = col_of(c)
    for old, new in mapping.items():
        c = F.when(c == F.lit(str(old)), F.lit(str(new))).otherwise(c)
    return c


def to_number(c) -> Column:
    """String → double, unparsable → NULL, NaN → NULL."""
    d = col_of(c).try_cast("double")
    return F.when(~F.isnan(d), d)


def to_datetime(c, formats=DAYFIRST_FORMATS) -> Column:
    """Mixed-format, day-first string → timestamp; unparsable → NULL.

    ISO strings go first (``try_to_timestamp`` without a pattern), then each
    day-first pattern in order; the first that parses wins.
    """
    c = F.trim(col_of(c).cast("string"))
    tries = [F.try_to_timestamp(c)] + [F.try_to_timestamp(c, F.lit(f)) for f in formats]
    return F.coalesce(*tries)


def to_interval(c) -> Column:
    """String → day-time interval, unparsable → NULL (P10)."""
    return col_of(c).try_cast("interval day to second")


def norm_text(c) -> Column:
    return F.trim(col_of(c).cast("string"))


def any_prefix(c, prefixes) -> Column:
    c = col_of(c)
    return reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes])


def normalise_prefixes(prefixes) -> list[str]:
    return [str(p).strip().upper() for p in prefixes]


def family_agreement(left, right, prefixes, fold_case: bool = False) -> Column:
    """Three-valued family agreement.

    NULL unless both sides are present and the left side starts with one of the
    prefixes; then whether the right side starts with one of them.  Prefixes are
    trimmed and upper-cased; data is compared as is unless ``fold_case``.
    """
    p = normalise_prefixes(prefixes)
    l, r = col_of(left).cast("string"), col_of(right).cast("string")
    if fold_case:
        l, r = F.upper(l), F.upper(r)
    evaluable = l.isNotNull() & r.isNotNull() & any_prefix(l, p)
    return F.when(evaluable, any_prefix(r, p))


def calendar_part(ts, unit: str) -> Column:
    """Calendar part of a timestamp."""
    ts = col_of(ts)
    if unit == "hour":
        return F.hour(ts)
    if unit == "dow":
        return F.date_format(ts, "EEEE")
    if unit == "workday_bool":
        # A missing timestamp counts as "not a workday".
        return F.coalesce(F.weekday(ts) < 5, F.lit(False))
    if unit == "month_name":
        return F.date_format(ts, "MMMM")
    if unit == "year":
        y = F.year(ts)
        return F.when(y >= 0, y)
    raise ValueError(f"unknown datetime unit {unit!r}")


def calendar_levels(unit: str):
    if unit == "hour":
        return tuple(range(24))
    if unit == "dow":
        return WEEKDAYS
    if unit == "month_name":
        return MONTHS
    return None


def floor_duration(start, end, unit: str) -> Column:
    """Whole ``unit``s from start to end, floored; negative → NULL."""
    if unit not in UNIT_MICROS:
        raise ValueError(f"unknown timedelta unit {unit!r}")
    us = F.timestamp_diff("MICROSECOND", col_of(start), col_of(end))
    v = F.floor(us / F.lit(UNIT_MICROS[unit])).cast("long")
    return F.when(v >= 0, v)


def key_normalise(c, is_text: bool) -> Column:
    """Duplicate-key normalisation (K1): text → trim + lower, blank → NULL."""
    c = col_of(c)
    if not is_text:
        return c
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def band(x, edges, labels, else_label=None) -> Column:
    """``labels[i]`` for the first ``x < edges[i]``; else ``else_label``; NULL x → NULL."""
    x = col_of(x)
    out = None
    for e, lab in zip(edges, labels):
        out = F.when(x < e, lab) if out is None else out.when(x < e, lab)
    out = out.otherwise(else_label) if else_label is not None else out
    return F.when(x.isNotNull(), out)
