"""Reading the log of failing rows back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plumbline.functions.json import READ_TIMESTAMPS
from plumbline.plans.rule import RECORD_SCHEMA

META = ("run_id", "dqmethod", "col")


#: What a log holds: a failing row once, with all rules that caught it together.  Older logs
#: have a line for each rule.
TAG = "struct<rule_seq: long, dqmethod: string, col: string>"
STORED_SCHEMA = RECORD_SCHEMA + f", rules array<{TAG}>"
FOLDERS = ("run_id", "schema_name", "table_name")
MANIFEST_SCHEMA = "run_id string, schema_name string, table_name string, failed_rows long, failed_count long"


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """The log as written: ``run_id``, ``schema_name``, ``table_name``, ``rules``, ``failed_row``."""
    alone = F.array(F.struct("rule_seq", "dqmethod", "col"))
    return spark.read.schema(STORED_SCHEMA).json(path) \
        .select(*FOLDERS, F.coalesce("rules", alone).alias("rules"), "failed_row")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log as records, one for each row and rule.  Filters on run, schema and table skip
    other folders."""
    return read_rows(spark, path).select(*FOLDERS, F.inline("rules"), "failed_row")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Runs in the log with the failing rows of each table and the records they stand for, as
    counted when they were written: no row is read."""
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/_manifest") \
        .select(*FOLDERS, "failed_rows", "failed_count")


def select_records(
    records: DataFrame, run_id: str = "", table: str = "", method: str = "", col: str = "", schema: str = ""
) -> DataFrame:
    """Records of one run, table, method, column and/or schema; an empty text means any."""
    wanted = {"run_id": run_id, "table_name": table, "dqmethod": method, "col": col, "schema_name": schema}
    for name, value in wanted.items():
        if value:
            records = records.filter(F.col(name) == value)
    return records


def page(records: DataFrame, number: int = 1, size: int = 100) -> DataFrame:
    """One page in a stable order.  Equal records are interchangeable, so ties do no harm."""
    return records.orderBy("rule_seq", "failed_row").offset((number - 1) * size).limit(size)


def total(records: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("total"))


def runs(records: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Runs in the log with their tables; newest first if the results tell when they started."""
    found = records.groupBy("run_id").agg(
        F.sort_array(F.collect_set("table_name")).alias("tables"), F.count(F.lit(1)).alias("records")
    )
    if results is None:
        return found.orderBy("run_id")
    starts = results.groupBy("run_id").agg(F.min("run_timestamp").alias("started_at"))
    return found.join(starts, "run_id", "left").orderBy(F.desc_nulls_last("started_at"), "run_id")


def manifest(records: DataFrame) -> DataFrame:
    """Failing-row counts per run and table."""
    return records.groupBy("run_id", "schema_name", "table_name").agg(
        F.count(F.lit(1)).alias("failed_count")
    )


def meta_names(row_schema: T.StructType) -> dict[str, str]:
    """What run, method and column are called beside the row's own columns."""
    own = {f.name.lower() for f in row_schema}
    names = {}
    for name in META:
        names[name] = name
        while names[name] in own:
            names[name] = f"log_{names[name]}"
    return names


def flattened(records: DataFrame, row_schema: T.StructType, meta_first: bool = True) -> DataFrame:
    """Records with the failing row's own columns in place of its JSON."""
    # Rows were written with every column present and timestamps whole, so nothing is lost.
    # Meta columns whose name the row has too get a prefix.
    fields = T.StructType([T.StructField(f.name, f.dataType, True) for f in row_schema])
    parsed = records.withColumn("r", F.from_json("failed_row", fields, READ_TIMESTAMPS))
    meta = {name: F.col(name).alias(shown) for name, shown in meta_names(row_schema).items()}
    if meta_first:
        return parsed.select(*meta.values(), "r.*")
    return parsed.select("r.*", meta["dqmethod"], meta["col"], meta["run_id"])
