"""The report of a YAML rule list as JSON."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import SparkSession


def report_json(report: Sequence[dict[str, Any]]) -> str:
    """The report as one JSON array; it has one entry per rule."""
    return json.dumps(list(report), indent=2, default=str)


def write_report(spark: SparkSession, report: Sequence[dict[str, Any]], path: str) -> None:
    """The report as JSON lines on any file system Spark can write to."""
    lines = [(json.dumps(entry, default=str),) for entry in report]
    spark.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(path)
