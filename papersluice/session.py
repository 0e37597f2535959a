"""Session helpers: reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its scan has fewer partitions (one small file), for work that costs far more than moving its rows. Large tables stay as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df by its key (distinct, or nearly so) in partitions of about `rows` rows, one a core at least: what a task holds doesn't grow with the table, nor with the row groups of its files."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(n, key)


#: The folder of a process whose Spark has none.
_OWN = f"/tmp/checkpoints/papersluice-{uuid.uuid4().hex}"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a folder of our own only where that is unset and Spark runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return _OWN  # the setting itself is fixed once Spark runs
    return found.rstrip("/")


#: Intermediate tables written so far.
_WRITTEN: list[str] = []


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and return the table read back.

    Cuts the lineage (a lost executor costs no recomputation of what stands
    before) and gives the planner a true size, so that it broadcasts the table
    only when it really is small. keep: the table isn't listed by tables_since().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not keep:
        _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tables_since(n: int = 0) -> list[str]:
    """The intermediate tables written after the first n."""
    return _WRITTEN[n:]


def release(spark: SparkSession, paths: list[str]) -> None:
    """Remove intermediate tables, and empty the list. Only where every result that reads them has been written."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
