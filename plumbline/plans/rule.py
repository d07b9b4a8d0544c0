"""A rule, the run it belongs to, and the shape of what a run yields."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.errors import RuleConfigError

# How a table or a reference table is found: (schema, table) -> DataFrame.
TableSource = Callable[[str, str], DataFrame]

RESULT_SCHEMA = (
    "run_id string, schema_name string, table_name string, rule_seq long, dqmethod string, "
    "col string, check_type string, status string, run_timestamp timestamp_ntz, "
    "total_count long, failed_count long, passed_count long, details string"
)
RECORD_SCHEMA = (
    "run_id string, schema_name string, table_name string, rule_seq long, dqmethod string, "
    "col string, failed_row string"
)
DISTRIBUTION_SCHEMA = (
    "run_id string, schema_name string, table_name string, rule_seq long, col string, "
    "label string, n long, ratio double"
)
ROWS_SCHEMA = (
    "run_id string, schema_name string, table_name string, "
    "rules array<struct<rule_seq: long, dqmethod: string, col: string>>, failed_row string"
)


@dataclass(frozen=True)
class Rule:
    """One row of the rule catalogue.  ``rule_seq`` tells equal-looking rules apart."""

    dqmethod: str
    config: Mapping[str, Any] = field(hash=False)
    table_name: str = "table"
    schema_name: str = "default"
    rule_seq: int = 0

    @classmethod
    def of(cls, dqmethod: str, config: Any, **where: Any) -> "Rule":
        """``config`` may be a mapping or JSON text."""
        if isinstance(config, str):
            try:
                config = json.loads(config)
            except json.JSONDecodeError as exc:
                raise RuleConfigError(f"{dqmethod}: config is not JSON: {exc}") from exc
        return cls(dqmethod, dict(config or {}), **where)


@dataclass(frozen=True)
class Run:
    """What all results of one execution share."""

    run_id: str
    run_timestamp: dt.datetime

    @classmethod
    def start(cls, run_id: str | None = None, run_timestamp: dt.datetime | None = None) -> "Run":
        if run_id is None:
            run_id = str(uuid.uuid4())
        else:
            try:
                run_id = str(uuid.UUID(str(run_id)))
            except ValueError as exc:
                raise RuleConfigError(f"'{run_id}' is no UUID; leave it out to get a new one") from exc
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        return cls(run_id, run_timestamp or now)

    def timestamp(self) -> Column:
        return F.lit(self.run_timestamp.isoformat(sep=" ")).cast("timestamp_ntz")


def resolve_tables(rule: Rule, source: TableSource | None) -> dict[str, Any]:
    """The rule's configuration with table names replaced by DataFrames."""
    config = dict(rule.config)
    for key in ("reference_df", "target_df"):
        name = config.get(key)
        if isinstance(name, str):
            if source is None:
                raise RuleConfigError(f"{rule.dqmethod}: no table source to look up '{name}'.")
            schema = config.get(key.replace("_df", "_schema"), rule.schema_name)
            config[key] = source(schema, name)
    return config
