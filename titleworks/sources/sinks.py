"""Writing result tables, one-row JSON facts, and checking that a set of tables is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, root: str, name: str) -> str:
    path = f"{root}/{name}"
    df.write.mode("overwrite").parquet(path)
    return path


def write_lookup(df: DataFrame, root: str, name: str, key: str, order: list[str]) -> str:
    """A table for many lookups by key: every key's rows lie in one file, sorted."""
    path = f"{root}/{name}"
    df.repartition(key).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    return path


def write_facts(one_row: DataFrame, root: str, name: str) -> str:
    """A one-row frame as a JSON object, keeping null fields."""
    path = f"{root}/{name}"
    one_row.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path


def load_tables(spark: SparkSession, root: str, names: list[str], facts: str) -> dict[str, DataFrame]:
    """Open the result tables, naming every one that is missing."""
    paths = {name: f"{root}/{name}" for name in [*names, facts]}
    missing = [path for path in paths.values() if not _exists(spark, path)]
    if missing:
        raise FileNotFoundError(f"Missing data files: {', '.join(missing)}")
    tables = {name: spark.read.parquet(paths[name]) for name in names}
    tables[facts] = spark.read.json(paths[facts])
    return tables


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)
