"""Joining a table with facts known per key, whatever the table's skew.

A key may hold a third of all rows, so the table is never simply shuffled by key:

* if the per-key facts are measured to be small they are broadcast, and the table
  is not shuffled at all;
* otherwise the table's most frequent keys, a fixed number of them, are joined by
  broadcast, and only the rows of the remaining keys are shuffled.  Each of those
  keys holds less than 1/``HOT_KEYS`` of the table.

The facts are written to the shared folder first: they are measured and joined from
there instead of being computed twice, and both join inputs are then plain exchanges
over scans, which adaptive execution can split further.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions.keys import quoted
from plumbline.session import cut_lineage

BROADCAST_BYTES = 64 << 20
HOT_KEYS = 1024


def fits_broadcast(df: DataFrame) -> bool:
    """Is the data, as measured, small enough to send to every executor?"""

    def width(f: T.StructField) -> Column:
        value = F.col(quoted(f.name))
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(value), F.lit(0)) + 16
        return F.lit(16)

    row = reduce(lambda a, b: a + b, [width(f) for f in df.schema])
    used = df.agg(F.sum(row.cast("long")).alias("used")).first()["used"]
    return (used or 0) <= BROADCAST_BYTES


def _match(df: DataFrame, facts: DataFrame, keys: list[str], how: str) -> DataFrame:
    renamed = facts.withColumnsRenamed({k: f"{k}__r" for k in keys})
    on = reduce(lambda a, b: a & b, [df[k].eqNullSafe(renamed[f"{k}__r"]) for k in keys])
    return df.join(renamed, on, how).drop(*[f"{k}__r" for k in keys])


def attach(
    df: DataFrame,
    facts: DataFrame,
    keys: list[str],
    how: str = "inner",
    weight: str | None = None,
    counts_of: DataFrame | None = None,
    stored: bool = False,
) -> DataFrame:
    """``df`` joined with ``facts``, which holds one row per key; null matches null.

    ``weight`` names the column of ``facts`` that counts the table's rows per key.
    Without it the rows are counted, in ``counts_of`` if that is cheaper to read.
    ``stored`` facts are read from files already and not written again.
    """
    facts = facts if stored else cut_lineage(facts)
    if fits_broadcast(facts):
        return _match(df, F.broadcast(facts), keys, how)
    if weight:
        counted = facts.select(*keys, F.col(weight).alias("__n"))
    else:
        counted = (counts_of or df).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    # Ties are broken by the keys, so every use of this picks the same ones.
    hot = cut_lineage(counted.orderBy(F.desc("__n"), *keys).limit(HOT_KEYS).select(*keys))
    hot_facts = cut_lineage(_match(facts, F.broadcast(hot), keys, "left_semi"))
    # Measured as too large, yet the planner, going by compressed file sizes, might
    # still broadcast them: the hint rules that out.
    facts = facts.hint("merge")
    if not fits_broadcast(hot_facts):  # wide facts: leave the hot keys to adaptive execution
        return _match(df, facts, keys, how)
    frequent = _match(_match(df, F.broadcast(hot), keys, "left_semi"), F.broadcast(hot_facts), keys, how)
    others = _match(_match(df, F.broadcast(hot), keys, "left_anti"), facts, keys, how)
    return frequent.unionByName(others)
