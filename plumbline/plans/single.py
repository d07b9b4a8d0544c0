"""Running one check, or a YAML list of checks, on a DataFrame."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, Row

from plumbline.errors import RuleConfigError
from plumbline.operators import Check, build_check
from plumbline.plans.rule import Rule, Run
from plumbline.plans.ruleset import Compiled, TableRun, message_of


def summary(df: DataFrame, check: Check, run: Run | None = None, table_name: str = "table") -> DataFrame:
    """The check's result row, lazily."""
    check.guard(df)
    compiled = Compiled(Rule(check.method, {}, table_name), check)
    return TableRun(df, run or Run.start(), "default", table_name, (compiled,)).results()


def run_check(
    df: DataFrame,
    method: str,
    config: Mapping[str, Any],
    run_id: str | None = None,
    advanced: bool = False,
    prefix: str = "",
) -> dict[str, Any] | tuple[dict[str, Any], DataFrame | None]:
    """Run one check now: its summary, and with ``advanced`` its failing rows too."""
    check = build_check(method, config)
    found = payload(summary(df, check, Run.start(run_id)).first(), prefix)
    return (found, check.failing(df)) if advanced else found


# Summary fields that may carry a prefix.
PREFIXED = (
    "type", "total_count", "failed_count", "passed_count", "passed", "drift_mean", "drift_std",
    "matched_count", "mojibake_count", "replacement_char_count", "config", "engine",
)


def payload(row: Row, prefix: str = "") -> dict[str, Any]:
    """A result row as the check's summary object.

    Checks that judge the whole table report no passing rows, hence no counts.
    ``prefix`` goes before the generic field names, for consumers that expect one.
    """
    out: dict[str, Any] = {"status": row["status"], "type": row["check_type"]}
    out |= json.loads(row["details"] or "{}")
    if row["passed_count"] is not None:
        out["total_count"] = row["total_count"]
        out["failed_count"] = row["failed_count"]
        out["passed_count"] = row["passed_count"]
    elif row["check_type"] == "rowcount_eval":
        out["total_count"] = row["total_count"]
    if isinstance(out.get("type_mismatches"), list):
        out["type_mismatches"] = {m.pop("column"): m for m in out["type_mismatches"]}
    out |= {"run_timestamp": row["run_timestamp"].isoformat(), "run_id": row["run_id"]}
    return _prefixed(out, prefix)


def _prefixed(fields: Mapping[str, Any], prefix: str) -> dict[str, Any]:
    return {prefix + k if k in PREFIXED else k: v for k, v in fields.items()}


def run_yaml(
    df: DataFrame,
    yaml_text: str,
    frames: Mapping[str, DataFrame] | None = None,
    functions: Mapping[str, Any] | None = None,
    prefix: str = "",
) -> list[dict[str, Any]]:
    """Run a YAML rule list on ``df``: one summary per entry, in order.

    ``frames`` holds the reference and target tables the entries name; ``functions``
    holds Python callables for custom entries whose ``func`` is one of its names.
    An entry that cannot be run is reported with its index and the message.
    """
    from plumbline.sources.rules import yaml_entries

    run_id, entries = yaml_entries(yaml_text)
    run = Run.start(run_id)
    planned: list[Compiled] = []
    problems: dict[int, str] = {}
    for i, entry in enumerate(entries):
        try:
            method = entry.get("type")
            if not method:
                raise RuleConfigError("entry has no 'type'")
            check = build_check(method, _with_objects(entry, frames or {}, functions or {}))
            check.guard(df)
            planned.append(Compiled(Rule(check.method, entry, rule_seq=i), check))
        except Exception as exc:
            problems[i] = message_of(exc)
    table = TableRun(df, run, "default", "table", tuple(planned))
    rows, settled = table.settled() if planned else ([], table)
    problems |= {rule.rule_seq: message for rule, message in settled.errors}
    found = {r["rule_seq"]: r for r in rows if r["check_type"] != "error"}
    report = []
    for i, entry in enumerate(entries):
        if i in problems:
            report.append({
                "status": "Error", "check_index": i, "check_config": entry,
                "error_message": problems[i], "run_id": run.run_id,
            })
        else:
            report.append(payload(found[i], prefix) | _prefixed({"config": entry, "engine": "spark"}, prefix))
    return report


def _with_objects(entry: Mapping[str, Any], frames, functions) -> dict[str, Any]:
    config = dict(entry)
    for key in ("reference_df", "target_df"):
        if config.get(key) in frames:
            config[key] = frames[config[key]]
    if isinstance(config.get("func"), str) and config["func"] in functions:
        config["func"] = functions[config["func"]]
    return config
