"""What every check has in common: configuration, label, guards, verdict."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.errors import MissingColumnError, RuleConfigError

NUMBER = (int, float)


@dataclass(frozen=True)
class Check:
    """A rule's check with its validated configuration.

    ``spec`` maps a configuration key to (accepted type, required).  Keys outside
    it are ignored, so a configuration may carry extra notes.
    """

    method: ClassVar[str]
    kind: ClassVar[str]
    result_type: ClassVar[str]
    spec: ClassVar[dict[str, tuple[Any, bool]]]

    @classmethod
    def from_config(cls, config: Mapping[str, Any]) -> "Check":
        given = {}
        for key, (accepted, required) in cls.spec.items():
            value = config.get(key)
            if value is None:
                if required:
                    raise RuleConfigError(f"{cls.method}: missing required config key '{key}'.")
                continue
            if not isinstance(value, accepted) or (isinstance(value, bool) and accepted is not bool):
                names = accepted if isinstance(accepted, tuple) else (accepted,)
                wanted = " or ".join(t.__name__ for t in names)
                raise RuleConfigError(
                    f"{cls.method}: '{key}' must be {wanted}, got {type(value).__name__}."
                )
            given[key] = tuple(value) if isinstance(value, list) else value
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in given.items() if k in known})

    def input_columns(self) -> list[str]:
        """The table's columns the check reads."""
        return []

    def label(self) -> str:
        """The text in the result's ``col`` field."""
        columns = getattr(self, "columns", None)
        if columns:
            return str(columns) if isinstance(columns, dict) else ",".join(columns)
        return getattr(self, "column", None) or "N/A"

    def guard(self, df: DataFrame) -> None:
        """Raise unless the table has what the check needs; runs no job."""
        for name in self.input_columns():
            if name not in df.columns:
                raise MissingColumnError(name)
        self.check_types(df.schema)

    def check_types(self, schema: T.StructType) -> None:
        """Raise if a column's type makes no sense for the check."""

    def static_details(self) -> dict[str, Any]:
        """Check-specific summary fields that do not depend on the data."""
        return {}

    def result_name(self) -> str:
        return self.result_type

    def failing(self, df: DataFrame) -> DataFrame | None:
        """The failing rows, source columns only; None where there is no such notion."""
        return None

    def same_failures(self) -> Any:
        """Equal for checks that fail the same rows, so that these are fetched once."""
        return self


class RowCheck(Check):
    """Decided from one row at a time."""

    def fails(self, schema: T.StructType) -> Column:
        """True for a failing row; never null."""
        raise NotImplementedError

    def failing(self, df: DataFrame) -> DataFrame:
        return df.filter(self.fails(df.schema))

    def details(self) -> Column:
        return F.lit(json.dumps(self.static_details(), default=str))


@dataclass(frozen=True)
class Verdict:
    """What a check over the whole table concludes, as columns."""

    passed: Column
    failed_count: Column
    passed_count: Column
    details: Column


class TableCheck(Check):
    """Decided from aggregates that share one pass with all other such checks."""

    def measures(self, schema: T.StructType) -> dict[str, Column]:
        """Aggregates by name, computed over the whole table."""
        return {}

    def parts(self, schema: T.StructType) -> dict[str, Column]:
        """Aggregates over a part of the table, from which ``merged`` makes the whole's measures."""
        return self.measures(schema)

    def merged(self, part: dict[str, Column]) -> dict[str, Column]:
        """``measures`` as aggregates over the parts' rows."""
        return {}

    def verdict(self, total: Column, measured: dict[str, Column]) -> Verdict:
        raise NotImplementedError


class KeyedCheck(Check):
    """Needs rows brought together by key: a shuffle of its own."""

    def facts(self, df: DataFrame) -> DataFrame | None:
        """What verdict and failing rows are both made from, computed and stored now.

        Worth it when both are wanted: the table is then shuffled once, not twice.
        """
        return None

    def tally(self, df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
        """One row: ``passed, total_count, failed_count, passed_count, details``."""
        raise NotImplementedError

    def failing(self, df: DataFrame, facts: DataFrame | None = None) -> DataFrame | None:
        return None

    def key_counts(self, df: DataFrame) -> DataFrame | None:
        """Rows per key as ``n``, which can be added up over parts of the table; None if it takes more."""
        return None

    def judged(self, counts: DataFrame) -> DataFrame:
        """As ``tally``, from the table's ``key_counts`` with one row for each key."""
        raise NotImplementedError


def details_json(**parts: Column) -> Column:
    """Check-specific fields of a summary as a JSON object, nulls kept."""
    return F.to_json(
        F.struct(*[c.alias(n) for n, c in parts.items()]), {"ignoreNullFields": "false"}
    )


def no_failures() -> tuple[Column, Column]:
    """Counts of a check that judges the table as a whole: no failing rows, no passing ones."""
    return F.lit(0).cast("long"), F.lit(None).cast("long")
