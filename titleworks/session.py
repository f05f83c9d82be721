"""Session settings and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "titleworks", cores: str = "*", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench. On a cluster, use the session you are given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    return builder.getOrCreate()


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by spark.checkpoint.dir.

    Only a local session may fall back to a folder of its own: on a cluster a machine-local
    folder would be lost with its executor, so a missing setting is an error there.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="titleworks-")
    return _local_folders[context.applicationId]


def working_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, together with the others of this application."""
    root = f"{shared_folder(spark).rstrip('/')}/titleworks-{spark.sparkContext.applicationId}"
    return f"{root}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write the rows to the shared folder and read them back.

    Row positions can then not change when a lost executor is replaced, the lineage is cut, and
    a frame that is used several times is computed once.
    """
    path = working_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unbounded(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the titles, so that it is shuffled and sorted and never sent to the driver.

    Spark judges a file by its packed size, and a frame of sorted ids unpacks to many times that.
    """
    return df.hint("merge")
