"""Comparing text columns of a source and a target table, matched by key.

Only keys and 32-byte digests of the normalised text are shuffled, never the text,
and matching pairs are counted, not formed: a key with S source and T target rows
costs S + T, not S x T.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any, ClassVar

from pyspark.sql import DataFrame, functions as F

from plumbline.errors import MissingColumnError, RuleConfigError
from plumbline.functions import text
from plumbline.functions.keys import compact_key, quoted
from plumbline.operators.base import KeyedCheck, details_json
from plumbline.operators.joins import attach
from plumbline.session import cut_lineage

KEY, TEXT = "__k0", "__d"
NOT_FOUND = "NOT FOUND"
# The report's reasons.
REASON_REPLACEMENT = "Replacement char (U+FFFD)"
REASON_MOJIBAKE = "Mojibake detected"
REASON_MISMATCH = "Value mismatch"
REASON_NONE = "—"


@dataclass(frozen=True)
class UnicodeValidation(KeyedCheck):
    """Fails a matched pair where any text differs, or the source text is damaged.

    Rows are matched on the key, null with null; text is compared after Unicode
    normalisation with null as the empty string.  A pair also fails if the source
    holds U+FFFD or mojibake, even where both sides agree.
    """

    method: ClassVar = "UnicodeValidationEval"
    kind: ClassVar = "unicodevalidation"
    result_type: ClassVar = "unicode_validation_eval"
    spec: ClassVar = {
        "key_column": (str, True), "columns": (list, True), "target_df": (DataFrame, True),
        "target_columns": (list, False), "normalization_form": (str, False),
        "batch_size": (int, False),
    }
    key_column: str
    columns: tuple[str, ...]
    target_df: DataFrame = field(hash=False)
    target_columns: tuple[str, ...] = ()
    normalization_form: str = "NFC"
    batch_size: int = 1000  # accepted for old configurations; Arrow sizes its own batches

    def __post_init__(self):
        object.__setattr__(self, "target_columns", self.target_columns or self.columns)
        if self.normalization_form not in text.NORMAL_FORMS:
            raise RuleConfigError(
                f"'{self.normalization_form}' is no normal form; there are {', '.join(text.NORMAL_FORMS)}"
            )
        if not self.columns or len(self.target_columns) != len(self.columns):
            raise RuleConfigError("'columns' and 'target_columns' must be lists of the same length.")

    def input_columns(self) -> list[str]:
        return [self.key_column, *self.columns]

    def guard(self, df: DataFrame) -> None:
        super().guard(df)
        for name in [self.key_column, *self.target_columns]:
            if name not in self.target_df.columns:
                raise MissingColumnError(name)

    def _digest(self, columns) -> Any:
        texts = [F.col(quoted(c)).cast("string") for c in columns]
        return text.row_digest([text.normal_digest(t, self.normalization_form) for t in texts])

    def _source(self, df: DataFrame) -> DataFrame:
        """The source rows with key, digest and damage flags."""
        values = [F.col(quoted(c)).cast("string") for c in self.columns]
        key = compact_key(F.col(quoted(self.key_column)), df.schema[self.key_column].dataType)
        return df.select(
            "*",
            key.alias(KEY),
            self._digest(self.columns).alias(TEXT),
            reduce(lambda a, b: a | b, [text.has_mojibake(v) for v in values]).alias("__mojibake"),
            reduce(lambda a, b: a | b, [text.has_replacement_char(v) for v in values]).alias("__replaced"),
        )

    def _target(self) -> DataFrame:
        dtype = self.target_df.schema[self.key_column].dataType
        return self.target_df.select(
            compact_key(F.col(quoted(self.key_column)), dtype).alias(KEY),
            self._digest(self.target_columns).alias(TEXT),
        )

    def _per_text(self, df: DataFrame) -> DataFrame:
        """Row counts of both sides per (key, text)."""
        one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
        damaged = F.col("__mojibake") | F.col("__replaced")
        source = self._source(df).select(
            KEY, TEXT, one.alias("s"), F.when(damaged, zero).otherwise(one).alias("s_clean"),
            F.col("__mojibake").cast("long").alias("s_mojibake"),
            F.col("__replaced").cast("long").alias("s_replaced"), zero.alias("t"),
        )
        target = self._target().select(
            KEY, TEXT, *[zero.alias(n) for n in ("s", "s_clean", "s_mojibake", "s_replaced")], one.alias("t")
        )
        sums = [F.sum(c).alias(c) for c in ("s", "s_clean", "s_mojibake", "s_replaced", "t")]
        return source.unionByName(target).groupBy(KEY, TEXT).agg(*sums)

    def facts(self, df: DataFrame) -> DataFrame:
        return cut_lineage(self._per_text(df))

    def counts(self, df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
        """One row: source rows, matched pairs, and passed, failed and damaged pairs."""
        per_text = self._per_text(df) if facts is None else facts
        per_key = per_text.groupBy(KEY).agg(
            *[F.sum(c).alias(c) for c in ("s", "s_mojibake", "s_replaced", "t")],
            F.sum(F.col("s_clean") * F.col("t")).alias("equal"),
        )

        def pairs(column: str):
            return F.coalesce(F.sum(F.col(column) * F.col("t")), F.lit(0))

        return per_key.agg(
            F.coalesce(F.sum("s"), F.lit(0)).alias("total_count"),
            pairs("s").alias("matched_count"),
            F.coalesce(F.sum("equal"), F.lit(0)).alias("passed_count"),
            pairs("s_mojibake").alias("mojibake_count"),
            pairs("s_replaced").alias("replacement_char_count"),
        ).withColumn("failed_count", F.col("matched_count") - F.col("passed_count"))

    def tally(self, df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
        details = details_json(
            key_column=F.lit(self.key_column),
            columns_checked=F.array(*[F.lit(c) for c in self.columns]),
            normalization_form=F.lit(self.normalization_form),
            matched_count=F.col("matched_count"),
            mojibake_count=F.col("mojibake_count"),
            replacement_char_count=F.col("replacement_char_count"),
        )
        return self.counts(df, facts).select(
            (F.col("failed_count") == 0).alias("passed"), "total_count", "failed_count",
            "passed_count", details.alias("details"),
        )

    def _failing_texts(self, df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
        """(key, text) groups of the source with at least one failing pair."""
        per_text = self.facts(df) if facts is None else facts
        targets = per_text.groupBy(KEY).agg(F.sum("t").alias("t_all")).filter("t_all > 0")
        groups = per_text.filter("s > 0").withColumnRenamed("t", "t_same")
        matched = attach(groups, targets, [KEY])
        return matched.filter("t_all > t_same OR s_clean < s").select(KEY, TEXT, "s", "t_all", "t_same")

    def failing_once(self, df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
        """Each failing source row once, key first, with its failing pairs counted in ``__pairs``."""
        rows = attach(self._source(df), self._failing_texts(df, facts), [KEY, TEXT], weight="s")
        damaged = F.col("__mojibake") | F.col("__replaced")
        pairs = F.when(damaged, F.col("t_all")).otherwise(F.col("t_all") - F.col("t_same"))
        columns = [self.key_column, *[c for c in df.columns if c != self.key_column]]
        names = [quoted(c) for c in columns]
        return rows.withColumn("__pairs", pairs).filter("__pairs > 0").select(*names, "__pairs")

    def failing(self, df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
        """Source rows, key first, one for each failing pair."""
        counted = self.failing_once(df, facts)
        names = [quoted(c) for c in counted.columns if c != "__pairs"]
        # Repeat a row in two steps, so that no single row holds a long array.
        blocks = counted.select(
            *names, "__pairs", F.explode(F.sequence(F.lit(0), F.floor((F.col("__pairs") - 1) / 1000))).alias("__b")
        )
        last = F.least(F.lit(1000).cast("long"), F.col("__pairs") - F.col("__b") * 1000)
        return blocks.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), last)).alias("__i")).select(*names)

    def compare_report(self, df: DataFrame) -> DataFrame:
        """Every source row with the target's text for the first column, verdict and reason.

        A key with several target rows shows the smallest text; a key with any
        failing pair fails for all its source rows.
        """
        first = F.col(quoted(self.columns[0])).cast("string")
        failed = self._failing_texts(df).groupBy(KEY).agg(F.sum("s").alias("__failed"))
        key = compact_key(F.col(quoted(self.key_column)), self.target_df.schema[self.key_column].dataType)
        shown = self.target_df.groupBy(key.alias(KEY)).agg(
            F.min(F.col(quoted(self.target_columns[0])).cast("string")).alias("__shown"),
            F.lit(True).alias("__found"),
        )
        source = df.select(
            F.col(quoted(self.key_column)),
            first.alias("source_value"),
            compact_key(F.col(quoted(self.key_column)), df.schema[self.key_column].dataType).alias(KEY),
        )
        rows = attach(attach(source, failed, [KEY], "left", counts_of=source), shown, [KEY], "left", counts_of=source)
        fails = F.col("__failed").isNotNull()
        reason = (
            F.when(~fails, F.lit(REASON_NONE))
            .when(text.has_replacement_char(F.col("source_value")), F.lit(REASON_REPLACEMENT))
            .when(text.has_mojibake(F.col("source_value")), F.lit(REASON_MOJIBAKE))
            .otherwise(F.lit(REASON_MISMATCH))
        )
        return rows.select(
            F.col(quoted(self.key_column)),
            "source_value",
            F.when(F.col("__found"), F.col("__shown")).otherwise(F.lit(NOT_FOUND)).alias("target_value"),
            F.when(fails, F.lit("FAIL")).otherwise(F.lit("PASS")).alias("status"),
            reason.alias("reason"),
        )
