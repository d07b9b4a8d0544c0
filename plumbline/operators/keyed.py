"""Checks that bring rows together by key: duplicates, class balance, references."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, ClassVar

from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.errors import MissingColumnError, RuleConfigError
from plumbline.functions.keys import compact_key, quoted, with_keys
from plumbline.functions.types import is_number, is_text, nan_as_null
from plumbline.operators.base import NUMBER, KeyedCheck, details_json, no_failures
from plumbline.operators.joins import attach, fits_broadcast
from plumbline.session import cut_lineage


def rows_per_key(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """Rows per key as ``n``; partial counts collapse a hot key before the shuffle."""
    keyed, keys = with_keys(df.select(*[quoted(c) for c in columns]), columns)
    return keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys


def counted_verdict(counts: DataFrame, failed) -> DataFrame:
    """Total and failing rows from one row per key; ``failed`` is the key's share."""
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_count"),
        F.coalesce(F.sum(failed), F.lit(0)).alias("failed_count"),
    ).select(
        (F.col("failed_count") == 0).alias("passed"),
        "total_count",
        "failed_count",
        (F.col("total_count") - F.col("failed_count")).alias("passed_count"),
        F.lit("{}").alias("details"),
    )


def stored_verdict(df: DataFrame, facts: DataFrame) -> DataFrame:
    """As ``counted_verdict`` from the failing keys alone; counting rows reads no column."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return facts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failed_count")).select(
        (F.col("failed_count") == 0).alias("passed"),
        total.alias("total_count"),
        "failed_count",
        (total - F.col("failed_count")).alias("passed_count"),
        F.lit("{}").alias("details"),
    )


@dataclass(frozen=True)
class Duplicate(KeyedCheck):
    """Fails every row whose key combination occurs more than once."""

    method: ClassVar = "DupEval"
    kind: ClassVar = "duplicate"
    result_type: ClassVar = "duplicate_eval"
    spec: ClassVar = {"columns": (list, True)}
    columns: tuple[str, ...]

    def __post_init__(self):
        if not self.columns:
            raise RuleConfigError(f"{self.method}: 'columns' must name at least one column.")

    def input_columns(self) -> list[str]:
        return list(self.columns)

    def facts(self, df: DataFrame) -> DataFrame:
        """The repeated keys with their row counts."""
        counts, _ = rows_per_key(df, list(self.columns))
        return cut_lineage(counts.filter("n > 1"))

    def tally(self, df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
        return self.judged(self.key_counts(df)) if facts is None else stored_verdict(df, facts)

    def key_counts(self, df: DataFrame) -> DataFrame:
        return rows_per_key(df, list(self.columns))[0]

    def judged(self, counts: DataFrame) -> DataFrame:
        return counted_verdict(counts, F.when(F.col("n") > 1, F.col("n")))

    def failing(self, df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
        keyed, keys = with_keys(df, list(self.columns))
        facts = self.facts(df) if facts is None else facts
        repeated = attach(keyed, facts, keys, "left_semi", weight="n", stored=True)
        return repeated.select(*[quoted(c) for c in df.columns])

    def same_failures(self) -> Any:
        return ("repeated keys", self.columns)


@dataclass(frozen=True)
class Unique(Duplicate):
    """As ``Duplicate``, on exactly one column."""

    method: ClassVar = "UniqueEval"
    kind: ClassVar = "unique"
    result_type: ClassVar = "unique_eval"

    def __post_init__(self):
        super().__post_init__()
        if len(self.columns) != 1:
            raise RuleConfigError("UniqueEval: 'columns' must name exactly one column.")


@dataclass(frozen=True)
class LabelBalance(KeyedCheck):
    """Passes where no class holds more than ``threshold`` of the non-null rows."""

    method: ClassVar = "StatisticalDistributionEval"
    kind: ClassVar = "statisticaldistribution"
    result_type: ClassVar = "statisticaldistribution_eval"
    spec: ClassVar = {"column": (str, True), "mode": (str, True), "threshold": (NUMBER, False)}
    column: str
    threshold: float = 0.9

    def input_columns(self) -> list[str]:
        return [self.column]

    def key_counts(self, df: DataFrame) -> DataFrame:
        label = nan_as_null(F.col(quoted(self.column)), df.schema[self.column].dataType)
        return df.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))

    def distribution(self, df: DataFrame) -> DataFrame:
        """Long form, one row per class: ``label, n, ratio``.

        The classes' total comes from a scalar subquery, so no row is moved for it.
        """
        classes = self.key_counts(df).filter(F.col("label").isNotNull())
        total = classes.agg(F.sum("n")).scalar()
        return classes.select("label", "n", (F.col("n") / total).alias("ratio"))

    def tally(self, df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
        return self.judged(self.key_counts(df))

    def judged(self, counts: DataFrame) -> DataFrame:
        counted = F.when(F.col("label").isNotNull(), F.col("n"))
        found = counts.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_count"),
            F.sum(counted).alias("labelled"),
            F.count("label").alias("classes"),
            F.max(F.when(F.col("label").isNotNull(), F.struct("n", "label"))).alias("top"),
        )
        ratio = F.col("top.n") / F.col("labelled")
        passed = ratio <= F.lit(float(self.threshold))  # null, hence Error, without any class
        failed, passing = no_failures()
        details = details_json(
            mode=F.lit("label_balance"),
            column=F.lit(self.column),
            max_class=F.col("top.label").cast("string"),
            max_class_ratio=ratio,
            classes=F.col("classes"),
            passed=passed,
        )
        return found.select(
            passed.alias("passed"), "total_count", failed.alias("failed_count"),
            passing.alias("passed_count"), details.alias("details"),
        )


@dataclass(frozen=True)
class ReferentialIntegrity(KeyedCheck):
    """Fails rows whose value is not in the reference column; null fails."""

    method: ClassVar = "ReferentialIntegrityEval"
    kind: ClassVar = "referentialintegrity"
    result_type: ClassVar = "referentialintegrity_eval"
    spec: ClassVar = {
        "column": (str, True), "reference_df": (DataFrame, True), "reference_column": (str, True),
    }
    column: str
    reference_df: DataFrame = field(hash=False)
    reference_column: str = ""

    def input_columns(self) -> list[str]:
        return [self.column]

    def guard(self, df: DataFrame) -> None:
        super().guard(df)
        if self.reference_column not in self.reference_df.columns:
            raise MissingColumnError(self.reference_column)
        own = df.schema[self.column].dataType
        other = self.reference_df.schema[self.reference_column].dataType
        same_kind = type(own) is type(other) or (is_number(own) and is_number(other))
        if not same_kind and not (is_text(own) and is_text(other)):
            raise RuleConfigError(
                f"{self.method}: cannot compare {own.simpleString()} with {other.simpleString()}."
            )

    def _reference_keys(self) -> DataFrame:
        dtype = self.reference_df.schema[self.reference_column].dataType
        key = compact_key(F.col(quoted(self.reference_column)), dtype)
        return self.reference_df.select(key.alias("__k0")).filter(F.col("__k0").isNotNull())

    def facts(self, df: DataFrame) -> DataFrame:
        """The keys that are not in the reference, with their row counts."""
        counts, keys = rows_per_key(df, [self.column])
        # Distinct, so that a value the reference repeats often is shuffled once per task.
        # Both sides come out of their aggregates partitioned by the key already, so a
        # merge join moves nothing more and needs no broadcast of the reference.
        known = self._reference_keys().distinct().hint("merge")
        return cut_lineage(counts.join(known, keys, "left_anti"))

    def tally(self, df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
        return self.judged(self.key_counts(df)) if facts is None else stored_verdict(df, facts)

    def key_counts(self, df: DataFrame) -> DataFrame:
        return rows_per_key(df, [self.column])[0]

    def judged(self, counts: DataFrame) -> DataFrame:
        known = self._reference_keys().distinct().withColumn("known", F.lit(True)).hint("merge")
        return counted_verdict(counts.join(known, ["__k0"], "left"), F.when(F.col("known").isNull(), F.col("n")))

    def failing(self, df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
        keyed, keys = with_keys(df, [self.column])
        known = self._reference_keys()
        if facts is None and fits_broadcast(known):
            rows = keyed.join(F.broadcast(known), keys, "left_anti")
        else:
            facts = self.facts(df) if facts is None else facts
            rows = attach(keyed, facts, keys, "left_semi", weight="n", stored=True)
        return rows.select(*[quoted(c) for c in df.columns])

    def static_details(self) -> dict[str, Any]:
        return {"column": self.column, "reference_column": self.reference_column}


def statistical_distribution(config) -> Any:
    """Pick the check by ``mode``."""
    from plumbline.operators.table import FeatureDrift

    modes = {"feature_drift": FeatureDrift, "label_balance": LabelBalance}
    if config.get("mode") not in modes:
        raise RuleConfigError(f"StatisticalDistributionEval: 'mode' must be one of {sorted(modes)}.")
    return modes[config["mode"]].from_config(config)
