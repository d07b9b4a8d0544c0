"""Predicates of custom rules as Spark expressions.

Stored rules may hold a one-line Python lambda.  It is never evaluated: its syntax
tree, as given by Python's ``ast``, is read into the equivalent Column, so the rule
runs inside the JVM with the others.  Anything beyond comparisons, boolean logic,
arithmetic, membership and null tests is refused; such rules use a SQL predicate or
a real callable.  As in Python, an ordering or equality test on a missing value (null or
NaN) is False and ``!=`` is True, a remainder has the divisor's sign, and a bare value
counts as true by its type.
"""

from __future__ import annotations

import ast
import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F, types as T

from plumbline.errors import RuleConfigError
from plumbline.functions.keys import quoted

_COMPARE = {
    ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt,
    ast.GtE: operator.ge, ast.Eq: operator.eq, ast.NotEq: operator.ne,
}
_ARITHMETIC = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul,
    ast.Div: lambda a, b: F.try_divide(a, b),
    # The remainder has the divisor's sign; by zero it is missing.
    ast.Mod: lambda a, b: F.try_mod(F.try_mod(a, b) + b, b),
}


def _is_nan(x: Column) -> Column:
    """NaN of any column; the type is known when the plan is made, so the test folds away."""
    return F.typeof(x).isin("double", "float") & (x.cast("string") == "NaN")


def _truth(x: Column) -> Column:
    """Python's truth: texts that are not empty, numbers that are not zero."""
    kind, text = F.typeof(x), x.cast("string")
    held = (
        F.when(kind.rlike("^(string|char|varchar)"), text != "")
        .when(kind == "boolean", text == "true")
        .otherwise(F.coalesce(text.try_cast("double") != 0, F.lit(True)))
    )
    return F.when(x.isNull(), F.lit(False)).otherwise(held)


def is_lambda(text: str) -> bool:
    return text.lstrip().startswith("lambda")


def lambda_to_column(text: str, column: str | None) -> tuple[Column, set[str]]:
    """The lambda's condition, and the columns it reads."""
    try:
        body = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as exc:
        raise RuleConfigError(f"Not a valid expression: {text!r}") from exc
    if not isinstance(body, ast.Lambda) or len(body.args.args) != 1:
        raise RuleConfigError(f"Expected a lambda with one argument: {text!r}")
    argument = body.args.args[0].arg
    used: set[str] = set()

    def read(name: str) -> Column:
        used.add(name)
        return F.col(quoted(name))

    def value(node: ast.expr) -> Column:
        match node:
            case ast.Constant(value=constant):
                return F.lit(constant)
            case ast.Name(id=name) if name == argument and column:
                return read(column)
            case ast.Subscript(value=ast.Name(id=name), slice=ast.Constant(value=str(key))) if (
                name == argument and not column
            ):
                return read(key)
            case ast.UnaryOp(op=ast.USub(), operand=inner):
                return -value(inner)
            case ast.BinOp(left=left, op=op, right=right) if type(op) in _ARITHMETIC:
                return _ARITHMETIC[type(op)](value(left), value(right))
            case ast.Call(func=ast.Name(id="len"), args=[inner], keywords=[]):
                return F.length(value(inner))
            case ast.Call(func=ast.Name(id="abs"), args=[inner], keywords=[]):
                return F.abs(value(inner))
        raise RuleConfigError(f"Unsupported expression in {text!r}: write a SQL predicate instead.")

    def compare(left: ast.expr, op: ast.cmpop, right: ast.expr) -> Column:
        nothing = [isinstance(n, ast.Constant) and n.value is None for n in (left, right)]
        if any(nothing) and isinstance(op, (ast.Is, ast.IsNot, ast.Eq, ast.NotEq)):  # only nothing equals nothing
            wanted = F.lit(True) if all(nothing) else value(right if nothing[0] else left).isNull()
            return wanted if isinstance(op, (ast.Is, ast.Eq)) else ~wanted
        if isinstance(op, (ast.In, ast.NotIn)) and isinstance(right, (ast.List, ast.Tuple, ast.Set)):
            found = F.coalesce(value(left).isin(*[value(e) for e in right.elts]), F.lit(False))
            return found if isinstance(op, ast.In) else ~found
        if type(op) not in _COMPARE:
            raise RuleConfigError(f"Unsupported comparison in {text!r}: write a SQL predicate instead.")
        unequal = F.lit(isinstance(op, ast.NotEq))
        sides = [value(left), value(right)]
        found = F.coalesce(_COMPARE[type(op)](*sides), unequal)
        missing = [_is_nan(x) for x, node in zip(sides, (left, right)) if not isinstance(node, ast.Constant)]
        return F.when(reduce(operator.or_, missing), unequal).otherwise(found) if missing else found

    def condition(node: ast.expr) -> Column:
        match node:
            case ast.Constant(value=bool(constant)):
                return F.lit(constant)
            case ast.BoolOp(op=op, values=parts):
                join = operator.and_ if isinstance(op, ast.And) else operator.or_
                return reduce(join, [condition(p) for p in parts])
            case ast.UnaryOp(op=ast.Not(), operand=inner):
                return ~condition(inner)
            case ast.Compare(left=left, ops=ops, comparators=rights):
                lefts = [left, *rights[:-1]]
                return reduce(operator.and_, [compare(*t) for t in zip(lefts, ops, rights)])
        return _truth(value(node))

    return condition(body.body), used


def callable_to_column(func: Callable, columns: list[str], numeric: set[str], row: bool) -> Column:
    """A Python callable as an Arrow-batched UDF over just the columns it needs.

    A missing number reaches the callable as NaN, so that comparing it is False
    rather than an error.
    """

    def missing(name: str, v):
        return float("nan") if v is None and name in numeric else v

    if row:

        def check(record):
            return bool(func({n: missing(n, record[n]) for n in columns}))

        return F.udf(check, T.BooleanType(), useArrow=True)(F.struct(*[F.col(quoted(c)) for c in columns]))

    name = columns[0]

    def check_value(v):
        return bool(func(missing(name, v)))

    return F.udf(check_value, T.BooleanType(), useArrow=True)(F.col(quoted(name)))
