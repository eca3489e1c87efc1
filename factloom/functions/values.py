"""Typed values: text, int64, double, bool, timestamp."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import VALUE_DDL, EngineError

#: Kinds by code, and the field that each uses.
KINDS = ("text", "int64", "double", "bool", "timestamp")
FIELDS = ("text", "i64", "f64", "b", "ts")
_PYTHON = (str, int, float, bool, int)


@dataclass(frozen=True)
class Value:
    """Equal only if kind and content are equal."""

    kind: str
    value: str | int | float | bool

    def __post_init__(self):
        if self.kind not in KINDS:
            raise EngineError(f"no such kind of value: {self.kind}")
        want = _PYTHON[KINDS.index(self.kind)]
        ok = isinstance(self.value, want) and (want is bool or not isinstance(self.value, bool))
        if want is float and isinstance(self.value, int) and not isinstance(self.value, bool):
            object.__setattr__(self, "value", float(self.value))
        elif not ok:
            raise EngineError(f"a {self.kind} value can't be {self.value!r}")

    @property
    def code(self) -> int:
        return KINDS.index(self.kind)

    @property
    def is_nan(self) -> bool:
        return self.kind == "double" and math.isnan(self.value)

    def fields(self) -> dict:
        """As a row of the value struct."""
        return {"kind": self.code, **{f: (self.value if i == self.code else None) for i, f in enumerate(FIELDS)}}

    def to_json(self) -> dict:
        return {"kind": self.kind, "value": self.value}

    @staticmethod
    def from_json(node: dict) -> Value:
        try:
            return Value(node["kind"], node["value"])
        except (KeyError, TypeError) as error:
            raise EngineError(f"malformed value: {node!r}") from error

    @staticmethod
    def from_row(row) -> Value | None:
        return None if row is None else Value(KINDS[row["kind"]], row[FIELDS[row["kind"]]])


def text(x: str) -> Value:
    return Value("text", x)


def literal(value: Value) -> Column:
    """The value's own field as a literal of its type."""
    kinds = ("string", "bigint", "double", "boolean", "bigint")
    return F.lit(value.value).cast(kinds[value.code])


def field(value: Column, code: int) -> Column:
    return value[FIELDS[code]]


def numeric(value: Column) -> Column:
    """int64, double and timestamp as double; others null."""
    return F.when(value["kind"] == 1, value["i64"].cast("double")).when(value["kind"] == 2, value["f64"]).when(value["kind"] == 4, value["ts"].cast("double"))


def struct_of(kind: int, column: Column) -> Column:
    """A value struct of one kind."""
    types = [f.split()[1] for f in VALUE_DDL.split(", ")[1:]]
    return F.struct(F.lit(kind).cast("tinyint").alias("kind"), *((column if i == kind else F.lit(None)).cast(t).alias(f) for i, (f, t) in enumerate(zip(FIELDS, types))))
