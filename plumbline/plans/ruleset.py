"""All rules of one table as one result DataFrame.

Row checks and table checks become expressions of a single aggregate, so the table
is scanned once for all of them and only for the columns they name.  Each keyed
check adds one aggregate of its own over its key columns.  The wide one-row
aggregate is turned into one row per rule with ``inline``.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from plumbline.functions.json import row_json
from plumbline.functions.keys import quoted
from plumbline.operators import Check, Custom, KeyedCheck, LabelBalance, RowCheck, SchemaValidation, TableCheck, build_check
from plumbline.plans.rule import DISTRIBUTION_SCHEMA, RECORD_SCHEMA, RESULT_SCHEMA, ROWS_SCHEMA, Rule, Run, TableSource, resolve_tables

logger = logging.getLogger(__name__)

# Expressions per pass: the compiled code of more would be too long for the JVM to optimise.
EXPRESSIONS_PER_PASS = 32


def union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


#: Types whose values Spark can hash.
_PLAIN = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def evened_out(rows: DataFrame) -> DataFrame:
    """Spread failing rows over tasks, for files of a sensible size and even parsing.

    Failing rows are few in most input partitions and many in some; adaptive execution
    merges the small ones and splits the large ones.  Done while they are still rows: as
    JSON, once for each rule, they would take many times the space in the shuffle.  Dealt
    by the hash of their values, as Spark sorts rows, on disk if need be, to deal them in turn.
    """
    plain = [quoted(f.name) for f in rows.schema if isinstance(f.dataType, _PLAIN)]
    return rows.hint("rebalance", *plain)


@dataclass(frozen=True)
class Compiled:
    """A rule with its check, ready to be planned."""

    rule: Rule
    check: Check

    def runs_python(self) -> bool:
        return isinstance(self.check, Custom) and self.check.runs_python()


@dataclass(frozen=True)
class TableRun:
    """The rules of one table, compiled for one run."""

    df: DataFrame
    run: Run
    schema_name: str
    table_name: str
    compiled: tuple[Compiled, ...]
    errors: tuple[tuple[Rule, str], ...] = ()
    facts: Mapping[object, DataFrame] = field(default_factory=dict, compare=False)

    def prepared(self) -> "TableRun":
        """Compute the keyed checks' facts now, for results and failing rows alike.

        Rules on the same key share them.  A check whose facts cannot be computed is
        left as it is; its error shows when the results are.
        """
        facts = dict(self.facts)
        for c in self.compiled:
            if isinstance(c.check, KeyedCheck) and c.check.same_failures() not in facts:
                try:
                    found = c.check.facts(self.df)
                except Exception as exc:
                    logger.warning("%s.%s, %s: %s", self.schema_name, self.table_name, c.rule.dqmethod, exc)
                    continue
                if found is not None:
                    facts[c.check.same_failures()] = found
        return replace(self, facts=facts)

    def _facts_of(self, check: KeyedCheck) -> DataFrame | None:
        return self.facts.get(check.same_failures())

    # -- results ---------------------------------------------------------------

    def results(self) -> DataFrame:
        """One row per rule, lazily."""
        fused = [c for c in self.compiled if not isinstance(c.check, KeyedCheck) and not c.runs_python()]
        alone = [c for c in self.compiled if c.runs_python()]
        keyed = [c for c in self.compiled if isinstance(c.check, KeyedCheck)]
        # Rules on the same columns go into the same pass, so passes share few columns.
        fused.sort(key=lambda c: (c.check.input_columns(), c.rule.rule_seq))
        frames = [self._one_pass(part) for part in _passes(fused, self.df)]
        frames += [self._one_pass([c]) for c in alone]
        frames += [self._tally(c) for c in keyed]
        if self.errors:
            frames.append(self.error_rows())
        if not frames:
            return self.df.sparkSession.createDataFrame([], RESULT_SCHEMA)
        return union(frames)

    def _one_pass(self, part: list[Compiled]) -> DataFrame:
        schema = self.df.schema
        aggregates = [F.count(F.lit(1)).alias("total")]
        for i, c in enumerate(part):
            if isinstance(c.check, RowCheck):
                aggregates.append(F.count(F.when(c.check.fails(schema), 1)).alias(f"f{i}"))
            else:
                aggregates += [m.alias(f"m{i}_{n}") for n, m in c.check.measures(schema).items()]
        rows = []
        total = F.col("total")
        for i, c in enumerate(part):
            if isinstance(c.check, RowCheck):
                failed = F.col(f"f{i}")
                passed, passing, details = failed == 0, total - failed, c.check.details()
            else:
                check = c.check.bound(schema) if isinstance(c.check, SchemaValidation) else c.check
                verdict = check.verdict(total, {n: F.col(f"m{i}_{n}") for n in check.measures(schema)})
                passed, failed = verdict.passed, verdict.failed_count
                passing, details = verdict.passed_count, verdict.details
            rows.append(verdict_row(c.rule, c.check.label(), c.check.result_name(), passed, total, failed, passing, details))
        return self.finished(self.df.agg(*aggregates).select(F.inline(F.array(*rows))))

    def _tally(self, c: Compiled) -> DataFrame:
        names = ("passed", "total_count", "failed_count", "passed_count", "details")
        columns = verdict_columns(c.rule, c.check.label(), c.check.result_name(), *[F.col(n) for n in names])
        return self.finished(c.check.tally(self.df, self._facts_of(c.check)).select(*columns))

    def error_rows(self) -> DataFrame:
        none = F.lit(None).cast("long")
        rows = [
            verdict_row(rule, "N/A", "error", F.lit(None).cast("boolean"), none, F.lit(0).cast("long"),
                         none, F.to_json(F.struct(F.lit(message).alias("error_message"))))
            for rule, message in self.errors
        ]
        return self.finished(self.df.sparkSession.range(1).select(F.inline(F.array(*rows))))

    def finished(self, verdicts: DataFrame) -> DataFrame:
        passed = F.col("passed")
        status = F.when(passed.isNull(), "Error").when(passed, "Success").otherwise("Failed")
        return verdicts.select(
            F.lit(self.run.run_id).alias("run_id"),
            F.lit(self.schema_name).alias("schema_name"),
            F.lit(self.table_name).alias("table_name"),
            "rule_seq", "dqmethod", "col", "check_type",
            status.alias("status"),
            self.run.timestamp().alias("run_timestamp"),
            "total_count", "failed_count", "passed_count", "details",
        )

    def distributions(self) -> DataFrame:
        """Every class of every label balance rule: ``label``, rows ``n`` and their ``ratio``."""
        frames = [
            c.check.distribution(self.df).select(
                *self._names(), F.lit(c.rule.rule_seq).cast("long").alias("rule_seq"), F.lit(c.check.label()).alias("col"),
                F.col("label").cast("string").alias("label"), "n", "ratio")
            for c in self.compiled if isinstance(c.check, LabelBalance)
        ]
        return union(frames) if frames else self.df.sparkSession.createDataFrame([], DISTRIBUTION_SCHEMA)

    # -- failing rows ----------------------------------------------------------

    def failed_records(self, evened: bool = False) -> DataFrame:
        """Every failing row once per rule that caught it, as JSON, tagged with the rule.

        ``evened`` spreads the rows over tasks, for records that are written or parsed.
        """
        frames = [rows.select("failed_row", F.explode("rules").alias("hit")).filter(F.col("hit").isNotNull())
                  for rows in self._failing(evened)]
        if not frames:
            return self.df.sparkSession.createDataFrame([], RECORD_SCHEMA)
        return union(frames).select(*self._names(), "hit.*", "failed_row")

    def failed_rows(self, evened: bool = False) -> DataFrame:
        """Every failing row as JSON with the list of the row checks that caught it (``rules``:
        ``rule_seq``, ``dqmethod``, ``col``).  Keyed checks find their rows one by one, so a row
        that they caught too occurs once more for each key."""
        frames = list(self._failing(evened))
        if not frames:
            return self.df.sparkSession.createDataFrame([], ROWS_SCHEMA)
        return union(frames).select(*self._names(), F.array_compact("rules").alias("rules"), "failed_row")

    def _names(self) -> list[Column]:
        return [F.lit(self.run.run_id).alias("run_id"), F.lit(self.schema_name).alias("schema_name"),
                F.lit(self.table_name).alias("table_name")]

    def _failing(self, evened: bool = False) -> Iterable[DataFrame]:
        """Failing rows as JSON with their rules, null for those that did not catch them.

        One pass serves all row checks.  Keyed checks first find their failing keys,
        which runs a job each; see ``operators.joins``.
        """
        spread = evened_out if evened else lambda found: found
        rows = [c for c in self.compiled if isinstance(c.check, RowCheck) and not c.runs_python()]
        for part in _passes(rows, self.df):
            fails = [c.check.fails(self.df.schema) for c in part]
            # Written with plain operators, not array functions with a lambda, so that
            # filter, JSON and explode compile into one stage.
            hits = F.array(*[F.when(failed, _tag(c)) for failed, c in zip(fails, part)])
            yield (
                spread(self.df.filter(reduce(lambda a, b: a | b, fails)))
                .withColumn("__json", row_json(self.df.columns))  # once per row, not per hit
                .select(F.col("__json").alias("failed_row"), hits.alias("rules"))
            )
        others = [c for c in self.compiled if c not in rows]
        for same in _grouped(others):
            failing = self.failing_of(same[0])
            if failing is not None:
                yield spread(failing).select(row_json(self.df.columns).alias("failed_row"),
                                             F.array(*[_tag(c) for c in same]).alias("rules"))

    def failing_of(self, c: Compiled) -> DataFrame | None:
        """The failing rows of one rule, from stored facts where there are any."""
        known = [self._facts_of(c.check)] if isinstance(c.check, KeyedCheck) else []
        return c.check.failing(self.df, *known)

    # -- running ---------------------------------------------------------------

    def settled(self) -> tuple[list[Row], "TableRun"]:
        """Run the checks now.  A rule that fails at run time becomes an ``Error`` row.

        One action for all rules inside the JVM and one for each Python callable.  If an
        action over several rules fails, the rule whose SQL Spark names as the error's
        place is set apart and the others run again: an action for each bad rule.  Only
        an error without a place has the rules halved until the offender is alone.  The
        rows fetched are one per rule.
        """
        rows, good, bad = [], [], list(self.errors)
        in_jvm = [c for c in self.compiled if not c.runs_python()]
        pending = [[c] for c in self.compiled if c.runs_python()] + ([in_jvm] if in_jvm else [])
        while pending:
            group = pending.pop()
            try:
                rows += replace(self, compiled=tuple(group), errors=()).results().collect()
                good += group
            except Exception as exc:
                logger.warning("%s.%s, %d rule(s): %s", self.schema_name, self.table_name, len(group), exc)
                blamed = _blamed(exc, group)
                half = len(group) // 2
                if len(blamed) == 1:
                    bad.append((blamed[0].rule, message_of(exc)))
                    if len(group) > 1:
                        pending.append([c for c in group if c is not blamed[0]])
                elif half:
                    pending += [group[:half], group[half:]]
                else:
                    bad.append((group[0].rule, message_of(exc)))
        if bad:
            rows += replace(self, compiled=(), errors=tuple(bad)).results().collect()
        good.sort(key=lambda c: c.rule.rule_seq)
        return rows, replace(self, compiled=tuple(good), errors=tuple(bad))


def _grouped(compiled: Sequence[Compiled]) -> list[list[Compiled]]:
    """Rules that fail the same rows, together."""
    groups: list[tuple[object, list[Compiled]]] = []
    for c in compiled:
        key = c.check.same_failures()
        for known, members in groups:
            if known == key:
                members.append(c)
                break
        else:
            groups.append((key, [c]))
    return [members for _, members in groups]


def message_of(exc: Exception) -> str:
    """The whole message, without the JVM's stack."""
    return (str(exc).split("\n\nJVM stacktrace:")[0] or type(exc).__name__).strip()


def _blamed(exc: Exception, group: Sequence[Compiled]) -> list[Compiled]:
    """The rules whose SQL text holds what Spark names as the place of the error."""
    try:
        places = {place.fragment() for place in exc.getQueryContext() if place.contextType().name == "SQL"}
    except Exception:  # no error of Spark, or none that names a place
        return []
    return [c for c in group if isinstance(c.check, Custom) and any(p and p in str(c.check.func) for p in places)]


def _tag(c: Compiled) -> Column:
    return F.struct(
        F.lit(c.rule.rule_seq).cast("long").alias("rule_seq"),
        F.lit(c.rule.dqmethod).alias("dqmethod"),
        F.lit(c.check.label()).alias("col"),
    )


def verdict_columns(rule, label, check_type, passed, total, failed, passing, details) -> list[Column]:
    return [
        F.lit(rule.rule_seq).cast("long").alias("rule_seq"),
        F.lit(rule.dqmethod).alias("dqmethod"),
        F.lit(label).alias("col"),
        F.lit(check_type).alias("check_type"),
        passed.alias("passed"),
        total.alias("total_count"),
        failed.alias("failed_count"),
        passing.alias("passed_count"),
        details.alias("details"),
    ]


def verdict_row(*parts) -> Column:
    return F.struct(*verdict_columns(*parts))


def _passes(fused: list[Compiled], df: DataFrame) -> Iterable[list[Compiled]]:
    part, used = [], 0
    for c in fused:
        needed = 1 if isinstance(c.check, RowCheck) else len(c.check.measures(df.schema))
        if part and used + needed > EXPRESSIONS_PER_PASS:
            yield part
            part, used = [], 0
        part.append(c)
        used += needed
    if part:
        yield part


def _analyse(df: DataFrame, compiled: Sequence[Compiled]) -> None:
    """Raise if Spark cannot type the checks' expressions; runs no job."""
    rows = [c.check.fails(df.schema) for c in compiled if isinstance(c.check, RowCheck)]
    if rows:
        df.select(*rows)
    measures = [m for c in compiled if isinstance(c.check, TableCheck) for m in c.check.measures(df.schema).values()]
    if measures:
        df.agg(*measures)


def compile_table(
    df: DataFrame,
    rules: Sequence[Rule],
    run: Run | None = None,
    source: TableSource | None = None,
    schema_name: str | None = None,
    table_name: str | None = None,
) -> TableRun:
    """Check the rules against the table's schema; runs no job.

    A rule that cannot be planned is kept as an error and the others go on.
    """
    compiled, errors = [], []

    def refuse(rule: Rule, exc: Exception) -> None:
        logger.warning("%s on %s: %s", rule.dqmethod, rule.table_name, exc)
        errors.append((rule, message_of(exc)))

    for rule in rules:
        try:
            check = build_check(rule.dqmethod, resolve_tables(rule, source))
            check.guard(df)
            compiled.append(Compiled(rule, check))
        except Exception as exc:
            refuse(rule, exc)
    # Expressions are analysed together; only if that fails, one by one.
    try:
        _analyse(df, compiled)
    except Exception:
        together, compiled = compiled, []
        for c in together:
            try:
                _analyse(df, [c])
                compiled.append(c)
            except Exception as exc:
                refuse(c.rule, exc)
    first = rules[0] if rules else Rule("", {})
    return TableRun(
        df, run or Run.start(), schema_name or first.schema_name, table_name or first.table_name,
        tuple(compiled), tuple(errors),
    )


def number_rules(rules: Iterable[Rule]) -> list[Rule]:
    """Give every rule its position as ``rule_seq``."""
    return [replace(r, rule_seq=i) for i, r in enumerate(rules, start=1)]


def results_frame(spark: SparkSession, rows: Sequence[Row]) -> DataFrame:
    """Fetched result rows, one per rule, as a DataFrame again."""
    return spark.createDataFrame(list(rows), RESULT_SCHEMA)
