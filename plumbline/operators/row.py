"""Checks decided row by row: filters on built-in expressions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any, ClassVar

from pyspark.sql import Column, functions as F, types as T

from plumbline.errors import RuleConfigError
from plumbline.functions import patterns, predicates, text
from plumbline.functions.keys import quoted
from plumbline.functions.types import (
    TIMESTAMPS,
    as_timestamp,
    convertible,
    is_datetime,
    is_float,
    is_number,
    is_text,
    normalise_name,
)
from plumbline.operators.base import NUMBER, RowCheck


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


@dataclass(frozen=True)
class Empty(RowCheck):
    """Fails where any listed column is null, NaN or the empty string."""

    method: ClassVar = "EmptyEval"
    kind: ClassVar = "empty"
    result_type: ClassVar = "empty_eval"
    spec: ClassVar = {"columns": (list, True), "trim": (bool, False)}
    columns: tuple[str, ...]
    trim: bool = False

    def __post_init__(self):
        if not self.columns:
            raise RuleConfigError("EmptyEval: 'columns' must name at least one column.")

    def input_columns(self) -> list[str]:
        return list(self.columns)

    def fails(self, schema: T.StructType) -> Column:
        return _any([self._empty(schema[name]) for name in self.columns])

    def _empty(self, column: T.StructField) -> Column:
        value = F.col(quoted(column.name))
        empty = value.isNull()
        if is_float(column.dataType):
            empty = empty | F.isnan(value)
        if is_text(column.dataType):
            empty = empty | (value.rlike(r"(?U)^\s*\z") if self.trim else value == "")
        return empty


@dataclass(frozen=True)
class Range(RowCheck):
    """Fails outside ``min`` to ``max``, both inclusive; a missing value fails."""

    method: ClassVar = "RangeEval"
    kind: ClassVar = "range"
    result_type: ClassVar = "range_eval"
    spec: ClassVar = {
        "column": (str, True), "min": (NUMBER, True), "max": (NUMBER, True),
        "null_policy": (str, False),
    }
    column: str
    min: float
    max: float
    null_policy: str = "fail"

    def input_columns(self) -> list[str]:
        return [self.column]

    def check_types(self, schema: T.StructType) -> None:
        dtype = schema[self.column].dataType
        if not is_number(dtype):
            raise RuleConfigError(f"RangeEval: '{self.column}' is {dtype.simpleString()}, not a number.")

    def fails(self, schema: T.StructType) -> Column:
        value = F.col(quoted(self.column))
        outside = (value < F.lit(self.min)) | (value > F.lit(self.max))
        if self.null_policy == "pass":
            if is_float(schema[self.column].dataType):
                outside = outside & ~F.isnan(value)
            return value.isNotNull() & outside
        # Spark orders NaN above every number, so it is outside already.
        return value.isNull() | outside

    def static_details(self) -> dict[str, Any]:
        return {"column": self.column, "range": {"min": self.min, "max": self.max}}


@dataclass(frozen=True)
class CategoricalValues(RowCheck):
    """Fails where the value is not in the list; null fails unless listed."""

    method: ClassVar = "CategoricalValuesEval"
    kind: ClassVar = "categoricalvalues"
    result_type: ClassVar = "categoricalvalues_eval"
    spec: ClassVar = {
        "column": (str, True), "allowed_values": (list, True), "null_policy": (str, False),
    }
    column: str
    allowed_values: tuple
    null_policy: str = "fail"

    def input_columns(self) -> list[str]:
        return [self.column]

    def fails(self, schema: T.StructType) -> Column:
        value = F.col(quoted(self.column))
        dtype = schema[self.column].dataType
        allowed = self._literals(dtype)
        found = value.isin(*allowed) if allowed else F.lit(False)
        if is_datetime(dtype):  # a listed value may be no date, hence null
            found = F.coalesce(found, F.lit(False))
        outside = ~found
        if None in self.allowed_values or self.null_policy == "pass":
            return value.isNotNull() & outside
        return value.isNull() | outside

    def _literals(self, dtype: T.DataType) -> list[Column]:
        """Listed values a column of this type can equal.

        Comparing across kinds (a word with a number) would be a cast error under
        ANSI rules; such values can never match, so they are left out.
        """
        listed = [v for v in self.allowed_values if v is not None]
        if is_text(dtype):
            return [F.lit(v) for v in listed if isinstance(v, str)]
        if is_number(dtype):
            return [F.lit(int(v) if isinstance(v, bool) else v) for v in listed if isinstance(v, NUMBER)]
        if isinstance(dtype, T.BooleanType):
            return [F.lit(bool(v)) for v in listed if isinstance(v, (bool, *NUMBER)) and v in (0, 1)]
        if is_datetime(dtype):
            return [F.lit(str(v)).try_cast(dtype) for v in listed]
        return []

    def static_details(self) -> dict[str, Any]:
        return {"column": self.column, "allowed_values": list(self.allowed_values)}


@dataclass(frozen=True)
class StringFormat(RowCheck):
    """Fails where the text does not match the pattern from its start; null fails."""

    method: ClassVar = "StringFormatEval"
    kind: ClassVar = "stringformat"
    result_type: ClassVar = "stringformat_eval"
    spec: ClassVar = {"column": (str, True), "pattern": (str, True), "full": (bool, False)}
    column: str
    pattern: str
    full: bool = False

    def __post_init__(self):
        if not self.pattern:
            raise RuleConfigError("StringFormatEval: 'pattern' must not be empty.")
        object.__setattr__(self, "pattern", patterns.resolve(self.pattern))

    def input_columns(self) -> list[str]:
        return [self.column]

    def fails(self, schema: T.StructType) -> Column:
        dtype = schema[self.column].dataType
        matched = patterns.matches(F.col(quoted(self.column)), dtype, self.pattern, self.full)
        return ~F.coalesce(matched, F.lit(False))


@dataclass(frozen=True)
class Dtype(RowCheck):
    """Fails where any listed column holds a value that does not convert to its type."""

    method: ClassVar = "DtypeEval"
    kind: ClassVar = "dtype"
    result_type: ClassVar = "dtype_eval"
    spec: ClassVar = {"columns": (dict, True), "strict": (bool, False)}
    columns: dict = field(hash=False)
    strict: bool = False

    def input_columns(self) -> list[str]:
        return list(self.columns)

    def fails(self, schema: T.StructType) -> Column:
        return _any([F.lit(False)] + [self._bad(schema[c], t) for c, t in self.columns.items()])

    def _bad(self, column: T.StructField, name: object) -> Column:
        value = F.col(quoted(column.name))
        good = convertible(value, column.dataType, normalise_name(name), self.strict)
        if good is None:  # an unknown type fails every row
            return F.lit(True)
        return value.isNotNull() & ~good


@dataclass(frozen=True)
class DateRange(RowCheck):
    """Fails where the date is missing, unreadable or outside the two instants."""

    method: ClassVar = "DateRangeEval"
    kind: ClassVar = "daterange"
    result_type: ClassVar = "daterange_eval"
    spec: ClassVar = {
        "column": (str, True), "min_date": (str, True), "max_date": (str, True),
        "date_format": (str, False),
    }
    column: str
    min_date: str
    max_date: str
    date_format: str = "%Y-%m-%d"

    def __post_init__(self):
        for bound in (self.min_date, self.max_date):
            self._parse(bound)

    def _parse(self, bound: str) -> dt.datetime:
        try:
            return dt.datetime.strptime(bound, self.date_format)
        except ValueError as exc:
            raise RuleConfigError(f"DateRangeEval: {exc}") from exc

    def input_columns(self) -> list[str]:
        return [self.column]

    def fails(self, schema: T.StructType) -> Column:
        dtype = schema[self.column].dataType
        column = F.col(quoted(self.column))
        bounds = [self._parse(b) for b in (self.min_date, self.max_date)]
        whole_days = all(b.time() == dt.time() for b in bounds)
        # A date or timestamp column is compared as it is, so the test reaches the scan.
        if isinstance(dtype, TIMESTAMPS) or (isinstance(dtype, T.DateType) and whole_days):
            value, kind = column, dtype
        else:
            value, kind = as_timestamp(column, dtype), T.TimestampNTZType()
        low, high = [F.lit(str(b)).cast(kind) for b in bounds]
        return value.isNull() | (value < low) | (value > high)

    def static_details(self) -> dict[str, Any]:
        return {
            "column": self.column,
            "date_range": {"min_date": self.min_date, "max_date": self.max_date},
            "date_format": self.date_format,
        }


@dataclass(frozen=True)
class Mojibake(RowCheck):
    """Fails where text holds U+FFFD or UTF-8 bytes read as Latin-1; non-text passes."""

    method: ClassVar = "MojibakeEval"
    kind: ClassVar = "mojibake"
    result_type: ClassVar = "mojibake_eval"
    spec: ClassVar = {"column": (str, True)}
    column: str

    def input_columns(self) -> list[str]:
        return [self.column]

    def fails(self, schema: T.StructType) -> Column:
        if not is_text(schema[self.column].dataType):
            return F.lit(False)
        value = F.col(quoted(self.column))
        return text.has_replacement_char(value) | text.has_mojibake(value)

    def static_details(self) -> dict[str, Any]:
        return {"column": self.column}


@dataclass(frozen=True)
class Custom(RowCheck):
    """Fails where the user's predicate is not true, on one value or on the row.

    ``func`` is a SQL predicate, a simple lambda as text, a function from a Column
    (or, for a row predicate, from the DataFrame's schema) marked with
    ``returns_column``, or a plain Python callable.
    """

    method: ClassVar = "CustomEval"
    kind: ClassVar = "custom"
    result_type: ClassVar = "custom_eval"
    spec: ClassVar = {"column": (str, False), "func": ((str, Callable), True)}
    func: Any = field(hash=False)
    column: str | None = None

    def __post_init__(self):
        if isinstance(self.func, str) and predicates.is_lambda(self.func):
            predicates.lambda_to_column(self.func, self.column)

    def input_columns(self) -> list[str]:
        named = {self.column} if self.column else set()
        if isinstance(self.func, str) and predicates.is_lambda(self.func):
            named |= predicates.lambda_to_column(self.func, self.column)[1]
        return sorted(named)

    def runs_python(self) -> bool:
        return callable(self.func) and not getattr(self.func, "returns_column", False)

    def fails(self, schema: T.StructType) -> Column:
        return ~F.coalesce(self._holds(schema).cast("boolean"), F.lit(False))

    def _holds(self, schema: T.StructType) -> Column:
        if isinstance(self.func, str):
            if predicates.is_lambda(self.func):
                return predicates.lambda_to_column(self.func, self.column)[0]
            return F.expr(self.func)
        if not self.runs_python():
            return self.func(F.col(quoted(self.column)) if self.column else schema)
        numeric = {f.name for f in schema if is_number(f.dataType)}
        columns = [self.column] if self.column else schema.names
        return predicates.callable_to_column(self.func, columns, numeric, row=not self.column)

    def result_name(self) -> str:
        return "custom_eval_column" if self.column else "custom_eval_row"

    def static_details(self) -> dict[str, Any]:
        return {"column": self.column}


def returns_column(func: Callable) -> Callable:
    """Mark a function as building a Column, not as a per-value Python predicate."""
    func.returns_column = True
    return func
