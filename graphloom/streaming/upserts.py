"""Continuous ingestion: a stream of changes merged into the latest state, and its versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import named
from graphloom.operators.versions import merged


def latest(changes: DataFrame, key: str, at: str, tie: str | None = None) -> DataFrame:
    """Each key's last change."""
    order = F.struct(*[named(c) for c in ([at, tie] if tie else [at])])
    return changes.groupBy(named(key).alias(key)).agg(F.max_by(F.struct(*[named(c) for c in changes.columns if c != key]), order).alias("x")).select(key, "x.*")


def stream_upserts(changes: DataFrame, folder: str, key: str, at: str, tie: str | None = None):
    """A writer that keeps ``folder`` at the latest state: each batch is merged into the table before it and written
    under the batch's number, so that a repeated batch replaces its own result and readers see whole tables only."""
    spark: SparkSession = changes.sparkSession

    def state(n: int) -> str:
        return f"{folder}/state/{n:010d}"

    def apply(batch: DataFrame, n: int) -> None:
        new = latest(batch, key, at, tie)
        if n == 0:
            out = new.select(F.xxhash64(named(key).cast("string")).alias("id"), "*")
        else:
            old = spark.read.parquet(state(n - 1))
            # A late change doesn't undo a newer one.
            fresh = new.join(old.select(named(key).alias("%k"), named(at).alias("%at")), named(key) == F.col("%k"), "left").where(F.col("%k").isNull() | (named(at) >= F.col("%at"))).drop("%k", "%at")
            out = merged(old, fresh, key).drop("change")
        out.write.mode("overwrite").parquet(state(n))

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", f"{folder}/checkpoint")


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The newest complete state."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = sorted(str(s.getPath()) for s in fs.listStatus(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    return spark.read.parquet(done[-1])


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n) by event time; works on streams and on tables alike. State is dropped behind the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(named(at), width).alias("w"), named(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "kind", "n")
