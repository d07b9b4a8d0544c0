"""Type names rules may use, and tests whether a value converts to a type."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F, types as T

from plumbline.errors import RuleConfigError

# Type names by family.
NUMERIC_NAMES = {
    "int", "int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64",
    "integer", "bigint", "long", "smallint", "short", "tinyint", "byte",
    "float", "float16", "float32", "float64", "double", "real",
    "complex", "complex64", "complex128", "numeric", "number",
}
DATETIME_NAMES = {"datetime", "datetime64", "datetime64[ns]", "timestamp", "date"}
TIMEDELTA_NAMES = {"timedelta", "timedelta64", "timedelta64[ns]"}
BOOLEAN_NAMES = {"bool", "boolean"}
STRING_NAMES = {"str", "string", "object"}

# Text forms accepted as a number and as a time span.
NUMBER_TEXT = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"
INFINITY_TEXT = r"^\s*[+-]?(?i:inf|infinity)\s*$"
INTEGER_TEXT = r"^\s*[+-]?[0-9]+\s*$"
TIMEDELTA_TEXT = (
    r"^\s*[+-]?\s*(?:[0-9]+|(?:[0-9]+(?:\.[0-9]+)?\s*"
    r"(?i:days?|d|hours?|hr|h|minutes?|min|m|seconds?|sec|s|millis|ms|micros|us|nanos|ns|weeks?|w)"
    r"[\s,]*)*(?:[0-9]{1,2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?)?)\s*$"
)

# Schema-check names that stand for more than one Spark type.
SCHEMA_ALIASES = {
    "int": (T.IntegerType, T.LongType),
    "integer": (T.IntegerType,),
    "int8": (T.ByteType,),
    "int16": (T.ShortType,),
    "int32": (T.IntegerType,),
    "int64": (T.LongType,),
    "float": (T.FloatType, T.DoubleType),
    "float32": (T.FloatType,),
    "float64": (T.DoubleType,),
    "str": (T.StringType,),
    "object": (T.StringType,),
    "string": (T.StringType,),
    "bool": (T.BooleanType,),
    "datetime": (T.TimestampType, T.TimestampNTZType),
    "datetime64": (T.TimestampType, T.TimestampNTZType),
    "datetime64[ns]": (T.TimestampType, T.TimestampNTZType),
    "timestamp": (T.TimestampType, T.TimestampNTZType),
    "timedelta": (T.DayTimeIntervalType,),
    "timedelta64[ns]": (T.DayTimeIntervalType,),
}

TIMESTAMPS = (T.TimestampType, T.TimestampNTZType)


def normalise_name(name: object) -> str:
    """A type name as written in a rule: ``'Int64'``, ``int`` or ``'decimal(10, 2)'``."""
    if isinstance(name, type):
        name = name.__name__
    return str(name).lower().replace(" ", "")


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, (*TIMESTAMPS, T.DateType))


def nan_as_null(column: Column, dtype: T.DataType) -> Column:
    """NaN counts as a missing value, like null."""
    return F.when(~F.isnan(column), column) if is_float(dtype) else column


def as_timestamp(column: Column, dtype: T.DataType) -> Column:
    """The value as a timestamp; null where it is not one.  Never raises."""
    if is_datetime(dtype):
        return column.cast("timestamp_ntz")
    if is_text(dtype):
        return F.try_to_timestamp(column).cast("timestamp_ntz")
    if isinstance(dtype, T.IntegralType):
        return F.timestamp_micros(F.floor(column / 1000).cast("long")).cast("timestamp_ntz")
    return F.lit(None).cast("timestamp_ntz")


#: What whole-number names mean when a rule is strict.
INTEGER_TARGETS = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "int": "bigint",
                   "integer": "bigint", "long": "bigint", "bigint": "bigint", "smallint": "smallint", "short": "smallint", "tinyint": "tinyint", "byte": "tinyint"}

#: The bits of unsigned ones.
UNSIGNED_BITS = {"uint8": 8, "uint16": 16, "uint32": 32, "uint64": 64}


def convertible(column: Column, dtype: T.DataType, name: str, strict: bool = False) -> Column | None:
    """A boolean for non-null values of ``column``; None if ``name`` is no known type."""
    yes, no = F.lit(True), F.lit(False)
    if name in NUMERIC_NAMES:
        if strict and name in INTEGER_TARGETS and (is_text(dtype) or is_number(dtype)):
            # The value itself must be one of the named type.
            held = column.try_cast(INTEGER_TARGETS[name])
            return held.isNotNull() & (column.rlike(INTEGER_TEXT) if is_text(dtype) else held == column)
        if strict and name in UNSIGNED_BITS and (is_text(dtype) or is_number(dtype)):
            whole = column.try_cast("decimal(38,0)")
            held = F.coalesce(whole.between(F.lit(0), F.lit(Decimal(2 ** UNSIGNED_BITS[name] - 1)).cast("decimal(38,0)")), F.lit(False))
            return held & (column.rlike(INTEGER_TEXT) if is_text(dtype) else whole == column)
        if is_text(dtype):
            if strict and not name.startswith(("float", "complex", "double", "real", "num")):
                return column.rlike(INTEGER_TEXT) & column.try_cast("long").isNotNull()
            return column.rlike(NUMBER_TEXT) | column.rlike(INFINITY_TEXT)
        if is_float(dtype):
            return ~F.isnan(column)
        castable = (T.NumericType, T.BooleanType, T.DayTimeIntervalType, *TIMESTAMPS)
        return yes if isinstance(dtype, castable) else no
    if name in DATETIME_NAMES:
        if is_text(dtype):
            return F.try_to_timestamp(column).isNotNull()
        return yes if is_datetime(dtype) or is_number(dtype) else no
    if name in TIMEDELTA_NAMES:
        if is_text(dtype):
            return column.rlike(TIMEDELTA_TEXT) & column.rlike("[0-9]")
        return yes if isinstance(dtype, T.DayTimeIntervalType) or is_number(dtype) else no
    if name in BOOLEAN_NAMES:
        if is_number(dtype):
            return column.isin(0, 1)
        return yes if isinstance(dtype, T.BooleanType) else no
    if name in STRING_NAMES:
        return yes if is_text(dtype) else no
    if name.startswith("decimal"):
        target = decimal_type(name)
        if target is None or not (is_text(dtype) or is_number(dtype)):
            return no if target is not None else None
        return column.try_cast(target).isNotNull()
    return None


def decimal_type(name: str) -> T.DecimalType | None:
    """``decimal`` or ``decimal(p,s)``; None for anything else."""
    try:
        parsed = T.DataType.fromDDL("decimal(38,18)" if name == "decimal" else name)
    except Exception:  # the parser's own error class differs between releases
        return None
    return parsed if isinstance(parsed, T.DecimalType) else None


def schema_type_matches(actual: T.DataType, name: str) -> bool:
    """Does a column of type ``actual`` satisfy the expected type ``name``?"""
    allowed = SCHEMA_ALIASES.get(name)
    if allowed is not None:
        return isinstance(actual, allowed)
    try:
        expected = T.DataType.fromDDL(name)
    except Exception as exc:
        raise RuleConfigError(f"Unknown type '{name}' in expected schema.") from exc
    if isinstance(expected, T.StringType):
        return isinstance(actual, T.StringType)
    return actual == expected
