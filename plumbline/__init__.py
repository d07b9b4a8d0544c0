"""Declarative data-quality rules for Spark DataFrames."""

from plumbline.operators import METHODS, build_check, returns_column
from plumbline.plans.pipeline import Outcome, plan_all, run_all
from plumbline.plans.rule import Rule, Run
from plumbline.plans.ruleset import TableRun, compile_table
from plumbline.plans.single import run_check, run_yaml, summary

__all__ = [
    "METHODS", "Outcome", "Rule", "Run", "TableRun", "build_check", "compile_table", "plan_all",
    "returns_column", "run_all", "run_check", "run_yaml", "summary",
]
