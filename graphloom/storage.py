"""Cutting lineage: written tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "graphloom.work.dir"


def work_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a new folder, which is allowed on a local master only."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="graphloom-work-")
    spark.conf.set(SETTING, folder)
    return folder


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """df as a table in the shared folder, perhaps in folders by a column: it survives executors, and later plans start
    from it."""
    path = f"{work_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_at = path
    return back


def forget(df: DataFrame | None) -> None:
    """Delete a table that written() made and no plan reads any longer."""
    path = getattr(df, "written_at", None)
    if path:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Rows that a partition of a graph's edges holds, more or less.
ROWS = 2_000_000


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows, at least as many as spark.sql.shuffle.partitions says."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))


def kept_by(df: DataFrame, key: str, n: int) -> DataFrame:
    """df persisted in n partitions by key, sorted by it. Rounds that join or group by the key then neither move nor sort
    it again: the number is given, as adaptive execution would otherwise choose another one."""
    return df.repartition(n, key).sortWithinPartitions(key).persist()
