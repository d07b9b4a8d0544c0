"""The checks, and how a rule's method name finds its check."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from plumbline.errors import RuleConfigError
from plumbline.operators.base import Check, KeyedCheck, RowCheck, TableCheck
from plumbline.operators.keyed import (
    Duplicate,
    LabelBalance,
    ReferentialIntegrity,
    Unique,
    statistical_distribution,
)
from plumbline.operators.row import (
    CategoricalValues,
    Custom,
    DateRange,
    Dtype,
    Empty,
    Mojibake,
    Range,
    StringFormat,
    returns_column,
)
from plumbline.operators.table import DataFreshness, FeatureDrift, RowCount, SchemaValidation
from plumbline.operators.unicode import UnicodeValidation

_CLASSES = [
    Duplicate, Empty, Unique, Dtype, StringFormat, Range, CategoricalValues, DataFreshness,
    ReferentialIntegrity, RowCount, Custom, SchemaValidation, UnicodeValidation, DateRange, Mojibake,
]

BUILDERS = {c.method: c.from_config for c in _CLASSES}
BUILDERS["StatisticalDistributionEval"] = statistical_distribution
METHODS = sorted(BUILDERS)

# The short names used in YAML rule lists.
KINDS = {c.kind: c.method for c in [*_CLASSES, FeatureDrift]}

# Rules that one increment of a table can be checked against on its own.
ROW_LOCAL = sorted(c.method for c in _CLASSES if issubclass(c, RowCheck))


def build_check(method: str, config: Mapping[str, Any]) -> Check:
    """The check for a rule's method name (``RangeEval``) or short name (``range``)."""
    method = KINDS.get(method.lower(), method)
    if method not in BUILDERS:
        raise RuleConfigError(f"Unknown dqmethod: {method}. Supported: {METHODS}")
    return BUILDERS[method](config)


__all__ = [
    "BUILDERS", "KINDS", "METHODS", "ROW_LOCAL", "Check", "KeyedCheck", "RowCheck", "TableCheck",
    "CategoricalValues", "Custom", "DataFreshness", "DateRange", "Dtype", "Duplicate", "Empty",
    "FeatureDrift", "LabelBalance", "Mojibake", "Range", "ReferentialIntegrity", "RowCount",
    "SchemaValidation", "StringFormat", "UnicodeValidation", "Unique", "build_check", "returns_column",
]
