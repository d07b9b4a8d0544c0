"""Checks that judge the table as a whole, from aggregates of one pass."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.errors import RuleConfigError
from plumbline.functions.durations import parse_duration
from plumbline.functions.keys import quoted
from plumbline.functions.types import (
    is_datetime,
    is_number,
    nan_as_null,
    normalise_name,
    schema_type_matches,
)
from plumbline.operators.base import NUMBER, TableCheck, Verdict, details_json, no_failures


@dataclass(frozen=True)
class RowCount(TableCheck):
    """Passes where the number of rows is within the given bounds, both inclusive."""

    method: ClassVar = "RowCountEval"
    kind: ClassVar = "rowcount"
    result_type: ClassVar = "rowcount_eval"
    spec: ClassVar = {"min": (int, False), "max": (int, False)}
    min: int | None = None
    max: int | None = None

    def __post_init__(self):
        if self.min is None and self.max is None:
            raise RuleConfigError("RowCountEval: at least one of 'min' or 'max' is needed.")

    def verdict(self, total: Column, measured: dict[str, Column]) -> Verdict:
        passed = F.lit(True)
        if self.min is not None:
            passed = passed & (total >= F.lit(self.min))
        if self.max is not None:
            passed = passed & (total <= F.lit(self.max))
        details = details_json(
            min_required=F.lit(self.min).cast("long"),
            max_allowed=F.lit(self.max).cast("long"),
            passed=passed,
        )
        return Verdict(passed, *no_failures(), details)


@dataclass(frozen=True)
class FeatureDrift(TableCheck):
    """Passes where mean and sample deviation stay within ``tolerance`` of the reference."""

    method: ClassVar = "StatisticalDistributionEval"
    kind: ClassVar = "statisticaldistribution"
    result_type: ClassVar = "statisticaldistribution_eval"
    spec: ClassVar = {
        "column": (str, True), "mode": (str, True), "reference_stats": (dict, True),
        "tolerance": (NUMBER, False),
    }
    column: str
    reference_stats: dict = field(hash=False)
    tolerance: float = 0.05

    def __post_init__(self):
        for name in ("mean", "std"):
            if not isinstance(self.reference_stats.get(name), NUMBER):
                raise RuleConfigError(f"{self.method}: 'reference_stats' needs a number '{name}'.")

    def input_columns(self) -> list[str]:
        return [self.column]

    def check_types(self, schema: T.StructType) -> None:
        dtype = schema[self.column].dataType
        if not (is_number(dtype) or isinstance(dtype, T.BooleanType)):
            raise RuleConfigError(f"{self.method}: '{self.column}' is {dtype.simpleString()}, not a number.")

    def _value(self, schema: T.StructType) -> Column:
        value = F.col(quoted(self.column))
        dtype = schema[self.column].dataType
        if isinstance(dtype, T.BooleanType):
            value = value.cast("int")
        return nan_as_null(value, dtype).cast("double")

    def measures(self, schema: T.StructType) -> dict[str, Column]:
        value = self._value(schema)
        return {"mean": F.avg(value), "std": F.stddev_samp(value)}

    def parts(self, schema: T.StructType) -> dict[str, Column]:
        measured = self.measures(schema)
        value = self._value(schema)
        return {"n": F.count(value), "mean": measured["mean"], "squares": F.var_pop(value) * F.count(value)}

    def merged(self, part: dict[str, Column]) -> dict[str, Column]:
        # Deviations are taken from the reference's mean, near which rounding matters, not from nought.
        centre = F.lit(float(self.reference_stats["mean"]))
        n = F.sum(part["n"])
        off = F.sum(part["n"] * (part["mean"] - centre)) / F.nullif(n, F.lit(0))
        around = F.sum(part["squares"] + part["n"] * (part["mean"] - centre) * (part["mean"] - centre))
        squares = F.greatest(around - n * off * off, F.lit(0.0))
        return {"mean": off + centre, "std": F.sqrt(squares / F.when(n > 1, n - 1))}

    def verdict(self, total: Column, measured: dict[str, Column]) -> Verdict:
        drift_mean = F.abs(measured["mean"] - F.lit(float(self.reference_stats["mean"])))
        drift_std = F.abs(measured["std"] - F.lit(float(self.reference_stats["std"])))
        within = (drift_mean <= F.lit(float(self.tolerance))) & (drift_std <= F.lit(float(self.tolerance)))
        passed = F.coalesce(within, F.lit(False))
        details = details_json(
            mode=F.lit("feature_drift"),
            column=F.lit(self.column),
            drift_mean=drift_mean,
            drift_std=drift_std,
            passed=passed,
        )
        return Verdict(passed, *no_failures(), details)


def _in_utc(text: str) -> dt.datetime:
    """An ISO timestamp without zone; one with an offset is turned into UTC."""
    given = dt.datetime.fromisoformat(text)
    return given.astimezone(dt.timezone.utc).replace(tzinfo=None) if given.tzinfo else given


@dataclass(frozen=True)
class DataFreshness(TableCheck):
    """Passes where the latest timestamp is after ``as_of`` less the threshold.

    A negative threshold is taken literally: it puts the cutoff in the future.
    """

    method: ClassVar = "DataFreshnessEval"
    kind: ClassVar = "datafreshness"
    result_type: ClassVar = "datafreshness_eval"
    spec: ClassVar = {
        "column": (str, True), "freshness_threshold": (str, False), "as_of": (str, False),
    }
    column: str
    freshness_threshold: str = "1d"
    as_of: str | None = None

    def __post_init__(self):
        parse_duration(self.freshness_threshold)
        if self.as_of is not None:
            try:
                dt.datetime.fromisoformat(self.as_of)
            except ValueError as exc:
                raise RuleConfigError(f"{self.method}: 'as_of' is no ISO timestamp.") from exc

    def input_columns(self) -> list[str]:
        return [self.column]

    def check_types(self, schema: T.StructType) -> None:
        dtype = schema[self.column].dataType
        if not is_datetime(dtype):
            raise RuleConfigError(f"{self.method}: '{self.column}' is {dtype.simpleString()}, not a timestamp.")

    def measures(self, schema: T.StructType) -> dict[str, Column]:
        # The cast goes outside the aggregate, so max stays on the raw column.
        return {"latest": F.max(F.col(quoted(self.column))).cast("timestamp_ntz")}

    def merged(self, part: dict[str, Column]) -> dict[str, Column]:
        return {"latest": F.max(part["latest"])}

    def verdict(self, total: Column, measured: dict[str, Column]) -> Verdict:
        now = F.lit(_in_utc(self.as_of)) if self.as_of else F.localtimestamp()
        seconds = int(parse_duration(self.freshness_threshold).total_seconds())
        cutoff = now - F.make_dt_interval(secs=F.lit(seconds))
        passed = F.coalesce(measured["latest"] > cutoff, F.lit(False))
        details = details_json(
            column=F.lit(self.column),
            latest_timestamp=measured["latest"].cast("string"),
            cutoff_timestamp=cutoff.cast("string"),
            passed=passed,
        )
        return Verdict(passed, *no_failures(), details)


@dataclass(frozen=True)
class SchemaValidation(TableCheck):
    """Passes where every expected column exists with its type; others are ignored.

    Metadata only: the failed count counts columns, the total counts rows.
    """

    method: ClassVar = "SchemaValidationEval"
    kind: ClassVar = "schemavalidation"
    result_type: ClassVar = "schemavalidation_eval"
    spec: ClassVar = {"expected_schema": (dict, True)}
    expected_schema: dict = field(hash=False)
    actual: T.StructType | None = field(default=None, hash=False)

    def __post_init__(self):
        if not self.expected_schema:
            raise RuleConfigError("SchemaValidationEval: 'expected_schema' must not be empty.")

    def problems(self, schema: T.StructType) -> list[dict[str, Any]]:
        """One entry per missing or mistyped column."""
        found = []
        for column, expected in self.expected_schema.items():
            name = normalise_name(expected)
            if column not in schema.names:
                found.append({"column": column, "expected": name, "actual": None, "problem": "missing"})
            elif not schema_type_matches(schema[column].dataType, name):
                actual = schema[column].dataType.simpleString()
                found.append({"column": column, "expected": name, "actual": actual, "problem": "type"})
        return found

    def guard(self, df: DataFrame) -> None:
        self.problems(df.schema)

    def bound(self, schema: T.StructType) -> "SchemaValidation":
        return SchemaValidation(self.expected_schema, schema)

    def verdict(self, total: Column, measured: dict[str, Column]) -> Verdict:
        problems = self.problems(self.actual)
        missing = [p["column"] for p in problems if p["problem"] == "missing"]
        mistyped = [p for p in problems if p["problem"] == "type"]
        details = details_json(
            missing_columns=F.array(*[F.lit(c) for c in missing]).cast("array<string>"),
            type_mismatches=F.array(
                *[F.struct(*[F.lit(p[k]).alias(k) for k in ("column", "expected", "actual")]) for p in mistyped]
            ),
        )
        failed = len(problems)
        return Verdict(
            F.lit(failed == 0),
            F.lit(failed).cast("long"),
            F.lit(len(self.expected_schema) - failed).cast("long"),
            details,
        )

    def report(self, df: DataFrame) -> DataFrame:
        """One row per expected column: what was asked for, what is there."""
        problems = {p["column"]: p["problem"] for p in self.problems(df.schema)}
        rows = [
            (c, normalise_name(t), df.schema[c].dataType.simpleString() if c in df.columns else None,
             problems.get(c, "ok"))
            for c, t in self.expected_schema.items()
        ]
        return df.sparkSession.createDataFrame(
            rows, "column string, expected string, actual string, problem string"
        )
