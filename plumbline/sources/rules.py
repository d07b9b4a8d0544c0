"""The rule catalogue: a DataFrame of rules, and what can be done with it."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.errors import RuleConfigError
from plumbline.functions.json import identity_json
from plumbline.plans.rule import Rule

CATALOGUE_SCHEMA = (
    "control_id long, schema_name string, table_name string, dqmethod string, "
    "config string, is_active boolean, created_at timestamp_ntz"
)
IDENTITY = ["schema_name", "table_name", "dqmethod"]


def catalogue(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """A small catalogue given as rows."""
    return spark.createDataFrame(list(rows), CATALOGUE_SCHEMA)


def list_rules(rules: DataFrame, schema: str = "", table: str = "", active_only: bool = False) -> DataFrame:
    """Rules newest first, optionally of one schema, one table, or only active ones."""
    if schema:
        rules = rules.filter(F.col("schema_name") == schema)
    if table:
        rules = rules.filter(F.col("table_name") == table)
    if active_only:
        rules = rules.filter("is_active")
    return rules.orderBy(F.desc("created_at"), F.desc("control_id"))


def active_rules(rules: DataFrame) -> DataFrame:
    """What a run needs of the active rules, in execution order."""
    return (
        rules.filter("is_active")
        .select("schema_name", "table_name", "dqmethod", "config", "control_id")
        .orderBy("schema_name", "table_name", "dqmethod", "control_id")
    )


def load_rules(rules: DataFrame, active_only: bool = True) -> list[Rule]:
    """The rules as objects.  A catalogue is metadata, one row per rule."""
    if active_only and "is_active" in rules.columns:
        rules = active_rules(rules)
    out = []
    for i, row in enumerate(rules.collect(), start=1):
        values = row.asDict()
        table = values.get("table_name") or values.get("tablename")
        schema = values.get("schema_name") or "default"
        where = {"table_name": table, "schema_name": schema, "rule_seq": i}
        try:
            out.append(Rule.of(values["dqmethod"], values.get("config"), **where))
        except RuleConfigError as exc:
            # Kept, so that the run reports it: no check has this configuration.
            out.append(Rule(values["dqmethod"], {"invalid": str(exc)}, **where))
    return out


def _canonical(df: DataFrame) -> DataFrame:
    return df.withColumn("__config", identity_json(F.col("config")))


def _identical_active(new: DataFrame, existing: DataFrame, how: str) -> DataFrame:
    """Join new rules with the active rules that have the same configuration.

    Only active new rules can clash.  Of several identical new ones the first counts.
    """
    known = (
        _canonical(existing.filter("is_active"))
        .groupBy(*IDENTITY, "__config")
        .agg(F.min("control_id").alias("existing_id"))
    )
    return _canonical(new).join(known, [*IDENTITY, "__config"], how)


def rejected_rules(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New active rules that already exist, with the id of the existing one."""
    clashing = _identical_active(new.filter("is_active"), existing, "inner")
    return clashing.select(*new.columns, "existing_id")


def insert_rules(new: DataFrame, existing: DataFrame) -> DataFrame:
    """The catalogue with the new rules added, except active ones it already has."""
    inactive = new.filter(~F.coalesce(F.col("is_active"), F.lit(False)))
    fresh = _identical_active(new.filter("is_active"), existing, "left_anti")
    first = fresh.groupBy(*IDENTITY, "__config").agg(
        F.min_by(F.struct(*new.columns), "control_id").alias("rule")
    )
    return existing.unionByName(inactive).unionByName(first.select("rule.*"))


def set_active(rules: DataFrame, control_ids: list[int], active: bool) -> DataFrame:
    """The catalogue with some rules switched on or off."""
    return _set_active(rules, F.col("control_id").isin(*control_ids), active)


def _set_active(rules: DataFrame, which: Column, active: bool) -> DataFrame:
    return rules.withColumn("is_active", F.when(which, F.lit(active)).otherwise(F.col("is_active")))


def delete_rules(rules: DataFrame, control_ids: list[int]) -> DataFrame:
    """The catalogue without some rules."""
    return rules.filter(~F.col("control_id").isin(*control_ids))


def rule_options(rules: DataFrame) -> DataFrame:
    """Distinct tables that have rules, for pick lists."""
    return rules.select("schema_name", "table_name").distinct().orderBy("schema_name", "table_name")


def yaml_entries(text: str) -> tuple[str | None, list[dict[str, Any]]]:
    """Run id and entries of a YAML rule list."""
    try:
        import yaml
    except ImportError as exc:
        raise RuleConfigError("reading YAML rule lists needs the PyYAML package") from exc
    try:
        content = yaml.safe_load(text) or {}
    except yaml.YAMLError as exc:
        raise RuleConfigError(f"the rule list is no YAML: {exc}") from exc
    return content.get("run_id"), list(content.get("evals") or [])
