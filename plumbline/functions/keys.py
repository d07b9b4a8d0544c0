"""Key columns in a form that is cheap to shuffle and safe to compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions.types import is_float, is_text, nan_as_null

DIGEST_HEX_LENGTH = 64
#: Options of JSON functions that keep timestamps whole.
TIMESTAMPS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def compact_key(column: Column, dtype: T.DataType) -> Column:
    """An equality-preserving stand-in for a key value, at most 64 bytes for text.

    Text of 64 bytes or more is replaced by its SHA-256 hex digest, so grouping a
    table on a document body shuffles digests instead of bodies.  Shorter text is
    kept, and so cannot be mistaken for a digest, which is exactly 64 bytes.
    NaN and null are both "missing" and compare equal.
    """
    if getattr(dtype, "collation", "UTF8_BINARY") != "UTF8_BINARY":
        return column  # equal texts may differ in bytes
    if is_text(dtype):
        return F.when(F.octet_length(column) < DIGEST_HEX_LENGTH, column).otherwise(
            F.sha2(column, 256)
        )
    if isinstance(dtype, T.BinaryType):
        return F.sha2(column, 256)
    if isinstance(dtype, T.MapType):
        column, dtype = F.array_sort(F.map_entries(column)), T.ArrayType(T.StructType())
    if isinstance(dtype, (T.ArrayType, T.StructType)):
        return F.sha2(F.to_json(F.struct(column.alias("v")), {"ignoreNullFields": "false", **TIMESTAMPS}), 256)
    if is_float(dtype):
        return nan_as_null(column, dtype)
    return column


def with_keys(df: DataFrame, columns: list[str], prefix: str = "__k") -> tuple[DataFrame, list[str]]:
    """``df`` plus one compact key column per entry of ``columns``, and their names."""
    names = [f"{prefix}{i}" for i in range(len(columns))]
    keys = [
        compact_key(F.col(quoted(c)), df.schema[c].dataType).alias(n)
        for c, n in zip(columns, names)
    ]
    return df.select("*", *keys), names


def quoted(name: str) -> str:
    """A column name safe to pass to ``F.col`` even with dots in it."""
    return "`" + name.replace("`", "``") + "`"
