"""Rows and rule configurations as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plumbline.functions.keys import TIMESTAMPS, quoted

#: Reading takes timestamps of any precision that was ever written.
READ_TIMESTAMPS = {k: v.replace(".SSSSSS", "[.SSSSSS][.SSS]") for k, v in TIMESTAMPS.items()}


def row_json(columns: list[str]) -> Column:
    """The row as a JSON object, nulls kept, timestamps as ISO text to the microsecond."""
    return F.to_json(F.struct(*[F.col(quoted(c)) for c in columns]), {"ignoreNullFields": "false", **TIMESTAMPS})


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no spare blanks: equal objects, equal text.

    Text that is no JSON stays as it is and so equals only itself.
    """
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


# Fixed value: strings, numbers and the rest of a JSON text, one after the other.
JSON_TOKEN = r'("(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|[^"0-9-]+|-)'


def _number_text(number: Column) -> Column:
    """A JSON number's digits without outer zeros and its power of ten: equal numbers, equal text.

    Made from the digits as written, so that no length loses precision.
    """
    fraction = F.regexp_extract(number, r"\.([0-9]+)", 1)
    digits = F.concat(F.regexp_extract(number, "^-?([0-9]+)", 1), fraction)
    power = F.coalesce(F.regexp_extract(number, "[eE]([+-]?[0-9]+)", 1).try_cast("decimal(38,0)"), F.lit(0))
    short = F.rtrim(F.translate(digits, "0", " "))  # blanks stand for noughts
    moved = power - F.length(fraction) + F.length(digits) - F.length(short)
    sign = F.when(number.startswith("-"), "-").otherwise("")
    text = F.concat(sign, F.translate(F.ltrim(short), " ", "0"), F.lit("e"), moved.cast("string"))
    return F.when(F.trim(short) == "", "0").otherwise(text)


def identity_json(text: Column) -> Column:
    """As ``canonical_json``, with numbers equal by value at any depth: ``1``, ``1.0`` and ``1e0`` agree.

    For comparing, not for reading: numbers become marked strings.
    """
    token = F.regexp_extract_all(text, F.lit(JSON_TOKEN), F.lit(1))
    marked = F.transform(
        token,
        lambda t: F.when(t.rlike("^-?[0-9]"), F.concat(F.lit('"#'), _number_text(t), F.lit('"')))
        .when(t.startswith('"#'), F.concat(F.lit('"#'), F.substring(t, 2, 2147483647)))  # a real string with the mark
        .otherwise(t),
    )
    valid = F.try_parse_json(text).isNotNull()
    return F.when(valid, canonical_json(F.array_join(marked, ""))).otherwise(text)
