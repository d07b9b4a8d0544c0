"""Regular expressions written for Python's ``re``, run by the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F, types as T

from plumbline.errors import RuleConfigError

# Ready-made patterns, usable as ``pattern: '@email'``.
PRESETS = {
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$",
    "phone": r"^\+?[0-9][\d\-\s().]{6,18}$",
    "url": r"^https?://[^\s]+",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "alphanum": r"^[A-Za-z0-9]+$",
}


def resolve(pattern: str) -> str:
    """Expand a ``@name`` preset and reject patterns Python itself would reject."""
    if pattern.startswith("@") and pattern[1:].lower() in PRESETS:
        pattern = PRESETS[pattern[1:].lower()]
    try:
        re.compile(pattern)
    except re.error as exc:
        raise RuleConfigError(f"Invalid pattern {pattern!r}: {exc}") from exc
    return pattern


def to_java(pattern: str, full: bool = False) -> str:
    """Anchor ``pattern`` as ``re.match`` (or ``re.fullmatch``) would, in Java syntax.

    Only ``\\n`` ends a line in Python, hence the ``d`` flag.  Python's class
    escapes are Unicode-aware, Java's need ``U``; the flag costs time, so it is
    set only where the pattern has such an escape.
    """
    java = pattern.replace("(?P<", "(?<")
    java = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", java)
    java = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", java)
    flags = "dU" if re.search(r"\\[wWdDsSbB]", java) else "d"
    return f"(?{flags})^(?:{java})" + (r"\z" if full else "")


def matches(column: Column, dtype: T.DataType, pattern: str, full: bool = False) -> Column:
    """True where the value's text matches from its start; null for a null value."""
    text = column.cast("string")
    if isinstance(dtype, T.BooleanType):
        text = F.initcap(text)  # Python spells booleans True / False
    return text.rlike(to_java(pattern, full))
