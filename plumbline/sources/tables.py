"""Opening business tables by name."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.plans.rule import TableSource


def from_mapping(frames: Mapping[str, DataFrame]) -> TableSource:
    """Tables held in a dict, keyed ``'schema.table'`` or just ``'table'``."""

    def open_table(schema: str, table: str) -> DataFrame:
        for name in (f"{schema}.{table}", table):
            if name in frames:
                return frames[name]
        raise KeyError(f"unknown table {schema}.{table}")

    return open_table


def from_catalog(spark: SparkSession) -> TableSource:
    """Tables and views of the session's catalog."""
    return lambda schema, table: spark.table(f"`{schema}`.`{table}`")


def from_files(spark: SparkSession, root: str, layout: str = "{table}.parquet", fmt: str = "parquet") -> TableSource:
    """One file or folder per table below ``root``; ``layout`` may use ``{schema}``."""
    return lambda schema, table: spark.read.format(fmt).load(
        f"{root}/{layout.format(schema=schema, table=table)}"
    )


@dataclass(frozen=True)
class JdbcSplit:
    """How a JDBC table is read in parallel: equal ranges of a numeric or date column."""

    column: str
    lower: Any
    upper: Any
    partitions: int


def from_jdbc(
    spark: SparkSession,
    url: str,
    properties: Mapping[str, str],
    splits: Mapping[str, JdbcSplit] | None = None,
    fetch_size: int = 10_000,
) -> TableSource:
    """Tables of a database.  Column pruning and filters are pushed into its query.

    A large table needs a ``JdbcSplit``, otherwise one task reads all of it.
    """

    def open_table(schema: str, table: str) -> DataFrame:
        reader = spark.read.format("jdbc").options(
            url=url, dbtable=f'"{schema}"."{table}"', fetchsize=str(fetch_size), **properties
        )
        split = (splits or {}).get(table)
        if split:
            reader = reader.options(
                partitionColumn=split.column, lowerBound=str(split.lower),
                upperBound=str(split.upper), numPartitions=str(split.partitions),
            )
        return reader.load()

    return open_table


def read_query(spark: SparkSession, sql: str, params: Mapping[str, Any] | None = None) -> DataFrame:
    """A SQL query with named parameters (``:name``)."""
    return spark.sql(sql, args=dict(params or {}))


# Schemas that hold a database's own tables.
SYSTEM_SCHEMAS = ("information_schema", "pg_catalog", "pg_toast")


def list_schemas(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW SCHEMAS").select(F.col("namespace").alias("schema_name")).filter(
        ~F.col("schema_name").isin(*SYSTEM_SCHEMAS)
    ).orderBy("schema_name")


def list_tables(spark: SparkSession, schema: str = "default") -> DataFrame:
    """Stored tables of a schema; views are left out."""
    names = [(t.name,) for t in spark.catalog.listTables(schema) if t.tableType != "VIEW" and not t.isTemporary]
    return spark.createDataFrame(names, "table_name string").orderBy("table_name")


def list_columns(spark: SparkSession, schema: str, table: str) -> DataFrame:
    """Column names and types in table order."""
    return columns_of(spark.table(f"`{schema}`.`{table}`"))


def columns_of(df: DataFrame) -> DataFrame:
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema, start=1)]
    return df.sparkSession.createDataFrame(
        rows, "ordinal_position int, column_name string, data_type string"
    ).orderBy("ordinal_position")
