"""Garbled-text tests, Unicode normalisation and text digests."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# The replacement character, and UTF-8 lead and continuation bytes
# that were read as Latin-1.
REPLACEMENT_CHAR = "\ufffd"
MOJIBAKE_PAIR = "[\u00c2-\u00ef][\u0080-\u00bf]"
NORMAL_FORMS = ("NFC", "NFD", "NFKC", "NFKD")


def has_replacement_char(text: Column) -> Column:
    return F.coalesce(F.contains(text, F.lit(REPLACEMENT_CHAR)), F.lit(False))


def has_mojibake(text: Column) -> Column:
    # Comparing two lengths is far cheaper than a regex and settles all-ASCII text.
    return F.coalesce(_holds_more_than_ascii(text) & text.rlike(MOJIBAKE_PAIR), F.lit(False))


def _holds_more_than_ascii(text: Column) -> Column:
    return F.octet_length(text) != F.length(text)


def _through_python(form: str, digested: bool):
    # Closures, so that executors need no copy of this package.
    import pandas as pd

    def normalise(values: pd.Series) -> pd.Series:
        import unicodedata

        return values.map(lambda v: v if v is None else unicodedata.normalize(form, v))

    def normalise_and_digest(values: pd.Series) -> pd.Series:
        import hashlib
        import unicodedata

        def digest(v):
            return v if v is None else hashlib.sha256(unicodedata.normalize(form, v).encode()).digest()

        return values.map(digest)

    chosen, kind = (normalise_and_digest, T.BinaryType()) if digested else (normalise, T.StringType())
    chosen.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(chosen, kind)


def _non_ascii(text: Column) -> Column:
    """The text if it holds more than ASCII, else null.

    ASCII text is the same in every normal form.  It is sent to Python as null,
    because a guard around the call would not keep the values from being shipped.
    """
    return F.when(_holds_more_than_ascii(text), text)


def normalised(text: Column, form: str = "NFC") -> Column:
    """``text`` in a Unicode normal form; null becomes the empty string.

    Spark has no built-in for this, so non-ASCII values go through an Arrow UDF.
    """
    return F.coalesce(_through_python(form, digested=False)(_non_ascii(text)), text, F.lit(""))


def normal_digest(text: Column, form: str = "NFC") -> Column:
    """SHA-256 of the normalised text's UTF-8 bytes, as 32 binary bytes.

    Python returns digests, not texts, so only one copy of a text crosses over.
    """
    in_jvm = F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))
    return F.coalesce(_through_python(form, digested=True)(_non_ascii(text)), in_jvm)


def row_digest(digests: list[Column]) -> Column:
    """One 32-byte digest for a list of digests, equal only if all of them are."""
    if len(digests) == 1:
        return digests[0]
    return F.unhex(F.sha2(F.concat(*digests), 256))
