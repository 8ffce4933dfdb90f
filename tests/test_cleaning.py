"""Behaviours of ingest, typing, derivation, flags and duplicates on in-line frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from studyframe.operators import clean, dedupe
from studyframe.sources import ingest
from studyframe.spec import ColumnSpec


def _cards(spark, values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "patient_card_no string, src_order long")


def _count(df, col):
    return df.where(F.col(col)).count()


def test_no_id_columns_gives_empty_masks(spark):
    m = dedupe.masks(_cards(spark, ["123", "123"]), [], ["src_order"])
    assert _count(m, "_dup_later") == 0 and _count(m, "_dup_group") == 0


def test_unknown_id_column_raises(spark):
    with pytest.raises(ValueError):
        dedupe.masks(_cards(spark, ["123", "123"]), ["nope"], ["src_order"])


def test_trim_and_case_are_normalised(spark):
    m = dedupe.masks(_cards(spark, ["Anna", "  anna "]), ["patient_card_no"], ["src_order"])
    assert _count(m, "_dup_later") == 1 and _count(m, "_dup_group") == 2


def test_incomplete_ids_are_never_duplicates(spark):
    m = dedupe.masks(_cards(spark, ["1", "", "   ", None, "2", "1", None]), ["patient_card_no"], ["src_order"])
    assert _count(m, "_dup_later") == 1 and _count(m, "_dup_group") == 2


def test_first_is_the_earliest_source_row(spark):
    df = _cards(spark, ["a", "b", "A"])
    later = dedupe.report(df, ["patient_card_no"], ["src_order"], include_first=False).collect()
    assert [r["src_order"] for r in later] == [2]


def test_drop_keeps_first_and_incomplete(spark):
    df = _cards(spark, ["123", "123", None, None])
    assert dedupe.drop_later(df, ["patient_card_no"], ["src_order"]).count() == 3


def test_drop_without_ids_is_a_noop(spark):
    df = _cards(spark, ["123", "123"])
    assert dedupe.drop_later(df, [], ["src_order"]).count() == 2


def test_encounter_overview_counts_nulls_as_equal(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", "x")], "k string, v string")
    r = dedupe.encounter_overview(df, ["k", "v"]).first()
    assert (r["n_rows"], r["n_unique"], r["n_repeat"]) == (3, 2, 1)


# ----------------------------------------------------------------- merge

RENAME = {"patient_card_no": ["Karte"], "bloods": "Bloede pest", "hospital": ["hospital of admission"]}


def _write(tmp_path, name, header, rows):
    p = tmp_path / name
    p.write_text(",".join(header) + "\n" + "\n".join(",".join(r) for r in rows) + "\n")
    return str(p)


def test_merge_empty_list_raises(spark):
    with pytest.raises(ValueError):
        ingest.merge(spark, [], RENAME)


def test_merge_drops_unknown_renames_alias_and_nulls_missing(spark, tmp_path):
    a = _write(tmp_path, "a.csv", ["Karte", "commentarios", "hospital of admission", "Bloede pest"],
               [["k1", "c", "h1", "5"], ["k2", "c", "h2", "6"]])
    b = _write(tmp_path, "b.csv", ["Kartuka", " Bloede pest "], [["x", "7"], ["y", "NA"]])
    df = ingest.merge(spark, [a, b], RENAME)
    assert "commentarios" not in df.columns
    rows = {r["bloods"]: r for r in df.collect()}
    assert rows["5"]["patient_card_no"] == "k1"
    assert rows["7"]["patient_card_no"] is None and rows["7"]["hospital"] is None
    assert None in rows  # "NA" became NULL after the read


def test_header_diff_and_union_header(spark, tmp_path):
    a = _write(tmp_path, "a.csv", ["x", "y"], [["1", "2"]])
    b = _write(tmp_path, "b.csv", ["y", "z"], [["1", "2"]])
    d = {r["file_index"]: r for r in ingest.header_diff(spark, [a, b]).collect()}
    assert d[1]["missing"] == ["x"] and d[1]["extra"] == ["z"]
    assert ingest.union_header(spark, [a, b]) == ["x", "y", "z"]
    assert ingest.preview(spark, [a, b], 1).count() == 2
    assert ingest.discover(spark, str(tmp_path)) == sorted([f"file:{a}", f"file:{b}"]) or \
        [p.split("/")[-1] for p in ingest.discover(spark, str(tmp_path))] == ["a.csv", "b.csv"]


def test_merge_coalesces_two_aliases_in_one_file(spark, tmp_path):
    a = _write(tmp_path, "a.csv", ["Karte", "patient_card_no"], [["", "p1"], ["k2", ""]])
    got = sorted(r["patient_card_no"] for r in ingest.merge(spark, [a], RENAME).collect())
    assert got == ["k2", "p1"]


# ----------------------------------------------------------------- typing

SCHEMA = (
    ColumnSpec(name="diag", kind="categorical", replace={1: "G45.9", 2: "I64"}),
    ColumnSpec(name="age", kind="numeric"),
    ColumnSpec(name="gks", kind="categorical", ordered=tuple(range(3, 16))),
    ColumnSpec(name="fast", kind="categorical", ordered=(1, 3, 4, 2)),
    ColumnSpec(name="call", kind="datetime", keep=False),
    ColumnSpec(name="arrive", kind="datetime", keep=False),
    ColumnSpec(name="card", kind="text"),
    ColumnSpec(name="sex", kind="categorical", nulls=("unknown",)),
)

DERIVED = (
    ColumnSpec(name="delay_timedelta_minutes", kind="timedelta", timedelta_units="minutes", derive_from=("call", "arrive")),
    ColumnSpec(name="tia_match", kind="match", derive_from=("diag", "diag2"), match_by=("G45",)),
    ColumnSpec(name="call_hour", kind="datetime", datetime_units="hour", derive_from=("call",)),
    ColumnSpec(name="call_dow", kind="datetime", datetime_units="dow", derive_from=("call",)),
    ColumnSpec(name="call_workday", kind="datetime", datetime_units="workday_bool", derive_from=("call",)),
    ColumnSpec(name="call_month", kind="datetime", datetime_units="month_name", derive_from=("call",)),
)

RAW = [
    ("1", "G45.1", "abc", "99", "1", "2024-01-05 10:00:00", "2024-01-05 10:30:00", " c1 ", "f"),
    ("2", "I63.9", "70", "15", "2", "31.12.2024 23:10", "01.01.2025 00:05", "c2", "unknown"),
    ("G45.2", "G45", "81.5", "7", "5", "05/01/2024", "05/01/2024 01:00", "c3", "m"),
    ("I64", None, "66", "3", "3", "thirty first december 2025", "2024-01-05 10:00:00", "c4", "m"),
    ("G45", "I61", "55", "12", "4", "2024-01-06 08:00:00", "2024-01-06 07:00:00", "c5", "f"),
]


def _raw(spark):
    return spark.createDataFrame(RAW, "diag string, diag2 string, age string, gks string, fast string, "
                                      "call string, arrive string, card string, sex string")


def test_schema_nulls_domain_replace_and_casts(spark):
    t = {r["card"]: r for r in clean.apply_schema(_raw(spark), SCHEMA).collect()}
    assert t["c1"]["age"] is None and t["c1"]["gks"] is None          # bad number, out of domain
    assert t["c1"]["diag"] == "G45.9" and t["c2"]["diag"] == "I64"    # replace map
    assert t["c3"]["fast"] is None and t["c2"]["fast"] == 2           # ordered domain, int levels
    assert t["c2"]["sex"] is None                                      # null token
    assert t["c2"]["call"] == dt.datetime(2024, 12, 31, 23, 10)       # day-first
    assert t["c4"]["call"] is None                                     # words → NULL
    assert "c1" in t                                                    # text trimmed


def test_unknown_kind_raises():
    with pytest.raises(ValueError):
        ColumnSpec(name="x", kind="delta_time")


def test_required_columns_checked(spark):
    with pytest.raises(ValueError):
        clean.apply_schema(_raw(spark).drop("age"), SCHEMA)


def test_spec_validation_rules():
    with pytest.raises(ValueError):
        ColumnSpec(name="x", kind="numeric", ordered=(1, 2))
    with pytest.raises(ValueError):
        ColumnSpec(name="x", kind="categorical", ordered=(1,))
    with pytest.raises(ValueError):
        ColumnSpec(name="x", kind="timedelta", derive_from=("a", "b"))
    with pytest.raises(ValueError):
        ColumnSpec(name="x", kind="match", derive_from=("a", "b"))
    with pytest.raises(ValueError):
        ColumnSpec(name="x", kind="categorical", ordered=(1, 2), nulls=(3,))
    with pytest.raises(ValueError):
        ColumnSpec(name="x", kind="timedelta", timedelta_units="months", derive_from=("a", "b"))


def test_derived_columns(spark):
    t = clean.apply_schema(_raw(spark), SCHEMA)
    d = {r["card"]: r for r in clean.apply_derived(t, DERIVED).collect()}
    assert d["c1"]["delay_timedelta_minutes"] == 30
    assert d["c2"]["delay_timedelta_minutes"] == 55
    assert d["c4"]["delay_timedelta_minutes"] is None      # unparseable start
    assert d["c5"]["delay_timedelta_minutes"] is None      # negative → NULL
    assert d["c1"]["tia_match"] is True and d["c3"]["tia_match"] is True
    assert d["c2"]["tia_match"] is None                      # left not in family
    assert d["c4"]["tia_match"] is None                      # right missing
    assert d["c5"]["tia_match"] is False
    assert d["c1"]["call_dow"] == "Friday" and d["c1"]["call_month"] == "January" and d["c1"]["call_hour"] == 10
    assert d["c4"]["call_workday"] is False                  # missing timestamp → not a workday


def test_duration_from_non_datetime_raises(spark):
    bad = (ColumnSpec(name="d", kind="timedelta", timedelta_units="minutes", derive_from=("age", "call")),)
    with pytest.raises(ValueError):
        clean.apply_derived(clean.apply_schema(_raw(spark), SCHEMA), bad)


def test_match_summary(spark):
    d = clean.apply_derived(clean.apply_schema(_raw(spark), SCHEMA), DERIVED)
    r = clean.match_summary(d, DERIVED).first()
    assert r["n_evaluable"] == 3 and r["match_rate_pct"] == 66.67


def test_missing_flags_only_for_source_columns_with_nulls(spark):
    d = clean.apply_derived(clean.apply_schema(_raw(spark), SCHEMA), DERIVED)
    f = clean.missing_flags(d, SCHEMA + DERIVED)
    flags = sorted(c for c in f.columns if c.endswith("_missing"))
    assert flags == ["age_missing", "call_missing", "diag2_missing", "fast_missing", "gks_missing", "sex_missing"]


def test_cleanup_drops_unkept(spark):
    d = clean.drop_unkept(clean.apply_schema(_raw(spark), SCHEMA), SCHEMA)
    assert "call" not in d.columns and "arrive" not in d.columns


def test_composed_equals_stepwise(spark):
    specs = SCHEMA + DERIVED
    raw = _raw(spark).withColumn("src_order", F.monotonically_increasing_id())
    composed, rep = clean.janitor(raw, specs, apply_all=True, id_cols=["sex"], order_cols=["src_order"],
                                  drop_dupes=True)
    step = clean.missing_flags(clean.apply_derived(clean.apply_schema(raw, specs), specs), specs)
    step = dedupe.drop_later(step, ["sex"], ["src_order"])
    assert sorted(map(tuple, composed.collect())) == sorted(map(tuple, step.collect()))
    assert rep.count() == 4  # two 'f' and two 'm' rows


def test_schema_audit_and_rejects(spark):
    a = {r["column"]: r for r in clean.schema_audit(_raw(spark), SCHEMA).collect()}
    assert a["age"]["new_null_cast"] == 1 and a["sex"]["new_null_tokens"] == 1
    rej = {(r["column"], r["raw_value"]) for r in clean.rejected_values(_raw(spark), SCHEMA).collect()}
    assert ("age", "abc") in rej and ("call", "thirty first december 2025") in rej


def test_merge_orders_rows_by_sorted_file_then_position(spark, tmp_path):
    b = _write(tmp_path, "b.csv", ["Karte"], [["b1"], ["b2"]])
    a = _write(tmp_path, "a.csv", ["Karte"], [["a1"], ["a2"], ["a3"]])
    df = ingest.merge(spark, sorted([a, b]), RENAME)
    got = [r["patient_card_no"] for r in df.orderBy("_src_order").collect()]
    assert got == ["a1", "a2", "a3", "b1", "b2"]
    assert {r["_src_order"]["file_index"] for r in df.collect()} == {0, 1}
