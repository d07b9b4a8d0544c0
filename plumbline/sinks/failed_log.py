"""Storing, promoting and exporting failing rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from plumbline.errors import RuleConfigError
from plumbline.functions.keys import TIMESTAMPS, quoted
from plumbline.plans.pipeline import Outcome
from plumbline.sources.failed_log import FOLDERS, MANIFEST_SCHEMA, flattened, meta_names, select_records


#: Lines say much over and over.  Files compressed so are read by one task each, hence their bound.
_LINES = {"compression": "gzip", "maxRecordsPerFile": 1_000_000}


def _tagged(records: DataFrame) -> DataFrame:
    """Records, or failing rows with their rules, in the form they are stored in."""
    if "rules" not in records.columns:
        records = records.withColumn("rules", F.array(F.struct("rule_seq", "dqmethod", "col")))
    return records.select(*FOLDERS, "rules", "failed_row")


def write_log(records: DataFrame, path: str) -> None:
    """Write failing rows as compressed JSON lines, a folder per run, schema and table.

    Records are written where they are: take them ``evened`` from a run.  Only the folders
    present in ``records`` are replaced, so a retry is harmless.
    """
    (
        _tagged(records).write.mode("overwrite").options(**_LINES)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*FOLDERS)
        .json(path)
    )


def log_outcome(outcome: Outcome, path: str) -> DataFrame:
    """Write all failing rows of a run, and what was written to the log's manifest.

    A row is stored once for all row checks that caught it.  Each table's folder is
    replaced, also by no rows at all.  Rows are counted while they are written.  The manifest
    is returned: one row per table.
    """
    spark, run = outcome.results.sparkSession, outcome.run.run_id
    found = []
    for table in outcome.tables:
        counts = Observation()
        rows = table.failed_rows(evened=True).select("rules", "failed_row").observe(
            counts, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("rules")), F.lit(0)).alias("records"))
        place = "/".join(f"{k}={_escaped(v)}" for k, v in zip(FOLDERS, (run, table.schema_name, table.table_name)))
        rows.write.mode("overwrite").options(**_LINES).json(f"{path}/{place}")
        found.append((run, table.schema_name, table.table_name, counts.get["rows"], counts.get["records"]))
    manifest = spark.createDataFrame(found, MANIFEST_SCHEMA)
    manifest.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(*FOLDERS).parquet(f"{path}/_manifest")
    return manifest


def _escaped(name: str) -> str:
    """A partition's value as Spark writes it into a folder's name."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in _UNSAFE else c for c in name)


#: Signs that Spark writes as their code in names of folders.
_UNSAFE = set("\"#%'*/:=?\\\x7f{[]^")


def promote(records: DataFrame, table: str, row_schema: T.StructType, path: str, run_id: str = "",
            schema_name: str = "") -> str:
    """Store one table's failing rows, flattened, as ``<table>_failed_rows``, or with a schema
    as ``<schema>.<table>_failed_rows``.

    Promoting a run a second time replaces it, also by no rows.  Tables of one name in
    several schemas are refused unless the schema is named.  Returns where the rows are.
    """
    mine = select_records(records, run_id=run_id, table=table, schema=schema_name)
    if not schema_name:
        schemas = [r[0] for r in mine.select("schema_name").distinct().limit(2).collect()]
        if len(schemas) > 1:
            raise RuleConfigError(f"'{table}' is in several schemas; name one of them")
    target = f"{path}/{schema_name + '.' if schema_name else ''}{table}_failed_rows"
    rows = flattened(mine, row_schema)
    run = meta_names(row_schema)["run_id"]
    if run_id:
        _delete(records.sparkSession, f"{target}/{run}={_escaped(run_id)}")
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(run)
        .parquet(target)
    )
    return target


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def promote_to_table(records: DataFrame, table: str, row_schema: T.StructType, schema: str = "default",
                     schema_name: str = "") -> str:
    """As ``promote``, into a table of the catalog.  A run's rows replace those it had there.
    ``schema_name`` is that of the checked table, ``schema`` that of the new one."""
    target = f"`{schema}`.`{table}_failed_rows`"
    rows = flattened(select_records(records, table=table, schema=schema_name), row_schema)
    run = meta_names(row_schema)["run_id"]
    if not records.sparkSession.catalog.tableExists(target):
        rows.write.partitionBy(run).saveAsTable(target)
    else:
        names = records.sparkSession.table(target).columns
        rows.select(*[F.col(quoted(n)) for n in names]).write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").insertInto(target)
    return target


def export_csv(records: DataFrame, row_schema: T.StructType, path: str) -> None:
    """Write failing rows as CSV: the row's columns, then method, column and run.

    Blanks are kept, quotes are doubled, and nested values are JSON text.
    """
    rows = flattened(records, row_schema, meta_first=False)
    plain = [
        F.to_json(F.col(quoted(f.name)), TIMESTAMPS).alias(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(quoted(f.name))
        for f in rows.schema
    ]
    rows.select(*plain).write.mode("overwrite").options(**_CSV).csv(path)


#: Standard quoting, nothing trimmed, timestamps whole; \\N is null, so that empty text is not.
_CSV = {"header": True, "escape": '"', "nullValue": "\\N", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, **TIMESTAMPS}


def read_csv_options() -> dict:
    """Options with which Spark reads an export back as it was."""
    return {**_CSV, "multiLine": True}
