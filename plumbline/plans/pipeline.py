"""Running a rule catalogue: every table with its rules, under one run id."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import groupby

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from plumbline.errors import RuleConfigError
from plumbline.plans.rule import DISTRIBUTION_SCHEMA, RECORD_SCHEMA, RESULT_SCHEMA, Rule, Run, TableSource
from plumbline.plans.ruleset import TableRun, compile_table, message_of, number_rules, results_frame, union

logger = logging.getLogger(__name__)


@dataclass(frozen=True)
class Outcome:
    """What a run over several tables yields."""

    run: Run
    results: DataFrame
    tables: tuple[TableRun, ...]
    skipped: tuple[tuple[str, str, str], ...]  # (schema, table, reason)

    def failed_records(self, evened: bool = False) -> DataFrame:
        """The failing rows of all tables; ``evened`` as for one."""
        if not self.tables:
            return self.results.sparkSession.createDataFrame([], RECORD_SCHEMA)
        return union([t.failed_records(evened) for t in self.tables])

    def distributions(self) -> DataFrame:
        """The classes of all label balance rules, one row each."""
        if not self.tables:
            return self.results.sparkSession.createDataFrame([], DISTRIBUTION_SCHEMA)
        return union([t.distributions() for t in self.tables])

    def failing_rows(self, table_name: str, dqmethod: str = "", col: str = "", *, schema_name: str | None = None,
                     rule_seq: int | None = None) -> DataFrame | None:
        """The failing rows of one check, in the table's own columns.

        Rules may share method and label, and tables their name: ``rule_seq`` and
        ``schema_name`` tell them apart, and without them several that fit are refused.
        """
        fits = [
            (t, c) for t in self.tables for c in t.compiled
            if t.table_name == table_name and schema_name in (None, t.schema_name)
            and rule_seq in (None, c.rule.rule_seq) and dqmethod in ("", c.rule.dqmethod)
            and col in ("", c.check.label())
        ]
        if len(fits) > 1:
            raise RuleConfigError(f"{len(fits)} rules of {table_name} fit; name rule_seq and schema_name")
        return fits[0][0].failing_of(fits[0][1]) if fits else None


def by_table(rules: Sequence[Rule]) -> list[tuple[str, str, list[Rule]]]:
    ordered = sorted(rules, key=lambda r: (r.schema_name, r.table_name, r.rule_seq))
    return [
        (schema, table, list(group))
        for (schema, table), group in groupby(ordered, key=lambda r: (r.schema_name, r.table_name))
    ]


def select_rules(rules: Sequence[Rule], schema: str = "", table: str = "") -> list[Rule]:
    """Rules of one schema and/or table; an empty name means any."""
    return [
        r for r in rules
        if (not schema or r.schema_name == schema) and (not table or r.table_name == table)
    ]


def plan_all(
    rules: Sequence[Rule], source: TableSource, run: Run | None = None
) -> tuple[list[TableRun], list[tuple[str, str, str]]]:
    """Compile every table's rules.  A table that cannot be opened is skipped."""
    run = run or Run.start()
    if not any(r.rule_seq for r in rules):
        rules = number_rules(rules)
    tables, skipped = [], []
    for schema, table, group in by_table(rules):
        try:
            tables.append(compile_table(source(schema, table), group, run, source, schema, table))
        except Exception as exc:
            logger.error("%s.%s skipped: %s", schema, table, exc)
            skipped.append((schema, table, message_of(exc)))
    return tables, skipped


def run_all(
    spark: SparkSession,
    rules: Sequence[Rule],
    source: TableSource,
    run: Run | None = None,
    parallel_tables: int = 4,
    keep_rows: bool = True,
) -> Outcome:
    """Run the catalogue now: results are fetched, one row per rule.

    With ``keep_rows`` what the keyed checks find out is stored, so that fetching the
    failing rows afterwards does not repeat it.

    Tables are independent, so a few are submitted at a time to keep the cluster
    busy through the small last stages of each.
    """
    run = run or Run.start()
    tables, skipped = plan_all(rules, source, run)
    settled: list[tuple[list, TableRun]] = []
    if tables:
        with ThreadPoolExecutor(max_workers=parallel_tables) as pool:

            def job(table: TableRun) -> tuple[list, TableRun]:
                return (table.prepared() if keep_rows else table).settled()

            jobs = [(t, pool.submit(inheritable_thread_target(spark)(job), t)) for t in tables]
            for table, job in jobs:
                try:
                    settled.append(job.result())
                except Exception as exc:
                    logger.error("%s.%s skipped: %s", table.schema_name, table.table_name, exc)
                    skipped.append((table.schema_name, table.table_name, message_of(exc)))
    rows = [row for result, _ in settled for row in result]
    results = results_frame(spark, rows) if rows else spark.createDataFrame([], RESULT_SCHEMA)
    return Outcome(run, results, tuple(t for _, t in settled), tuple(skipped))
