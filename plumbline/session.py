"""Session helpers: a configured session, the shared folder, cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "plumbline", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine.

    On a cluster the session comes from ``spark-submit``; nothing in the library
    depends on the settings made here except for speed.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one named by ``spark.checkpoint.dir``.

    Every executor can reach it, so what is written there outlives any of them.  Only
    a local session may fall back to a temporary folder of the machine.
    """
    application = spark.conf.get("spark.app.id")
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the whole cluster")
        folder = _local_dirs.setdefault(application, tempfile.mkdtemp(prefix="plumbline-"))
    return f"{folder.rstrip('/')}/plumbline-{application}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the files.

    Parquet rather than ``checkpoint()``: readers take only the columns they need,
    the planner knows the true size, and joins start from a plain scan.
    """
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
