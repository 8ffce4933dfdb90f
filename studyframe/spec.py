"""Declarative column and task specs.

A ``ColumnSpec`` says how one raw (string) column becomes a typed column, or how a
derived column is computed from others.  A ``TaskSpec`` names the target, its
positive class and the inclusion criteria of one study task.  Both are plain,
frozen dataclasses; every stage compiles them into Spark ``Column`` expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

SOURCE_KINDS = ("numeric", "timedelta", "datetime", "categorical", "text", "boolean")
DERIVED_KINDS = ("match", "timedelta", "datetime")

# Accepted duration units and calendar parts.
TIMEDELTA_UNITS = ("seconds", "minutes", "hours", "days")
DATETIME_UNITS = ("hour", "dow", "workday_bool", "month_name", "year")


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    kind: str
    nulls: tuple | None = None
    replace: dict | None = None
    keep: bool = True
    ordered: tuple | None = None
    derive_from: tuple | None = None
    match_by: tuple | None = None
    timedelta_units: str | None = None
    datetime_units: str | None = None
    # Day-first formats tried in order after ISO parsing (datetime sources only).
    datetime_formats: tuple | None = None

    def __post_init__(self):
        if self.kind not in SOURCE_KINDS + DERIVED_KINDS:
            raise ValueError(f"unknown kind {self.kind!r} for column {self.name!r}")
        if self.kind != "categorical" and self.ordered is not None:
            raise ValueError(f"{self.name}: 'ordered' is only valid for categorical columns")
        if self.ordered is not None and len(self.ordered) <= 1:
            raise ValueError(f"{self.name}: 'ordered' needs at least two levels")
        if self.kind == "timedelta" and self.derive_from and not self.timedelta_units:
            raise ValueError(f"{self.name}: derived timedelta needs timedelta_units")
        if self.timedelta_units is not None and self.timedelta_units not in TIMEDELTA_UNITS:
            raise ValueError(f"{self.name}: unsupported timedelta unit {self.timedelta_units!r}")
        if self.kind == "match" and not self.match_by:
            raise ValueError(f"{self.name}: match columns need match_by")
        if self.kind == "match" and (not self.derive_from or len(self.derive_from) != 2):
            raise ValueError(f"{self.name}: match columns need derive_from=(left, right)")
        if self.ordered is not None and self.nulls is not None:
            raise ValueError(f"{self.name}: 'nulls' is redundant with 'ordered'")
        if self.datetime_units is not None and self.datetime_units not in DATETIME_UNITS:
            raise ValueError(f"{self.name}: unknown datetime unit {self.datetime_units!r}")

    @property
    def is_derived(self) -> bool:
        return self.derive_from is not None


@dataclass(frozen=True)
class TaskSpec:
    name: str
    target_column: str
    positive_class: Any
    task_type: str = "binary"
    inclusion_criteria: dict = field(default_factory=dict)

    def metadata(self) -> dict:
        return {
            "task_name": self.name,
            "target_col": "target",
            "positive_class": self.positive_class,
            "task_type": self.task_type,
        }


def split_specs(specs):
    """(source specs, derived specs) in declaration order."""
    source = [s for s in specs if not s.is_derived]
    derived = [s for s in specs if s.is_derived]
    for s in source:
        if s.kind == "match":
            raise ValueError(f"{s.name}: 'match' is only a derived kind")
    return source, derived
