"""Structured Streaming jobs over edit streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.session import scratch_path


def read_stream(spark: SparkSession, folder: str, pattern: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def run_available(stream: DataFrame, path: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Process what is there, into parquet or through ``each``, and read the result back."""
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    if each is None:
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(each).start()
    query.awaitTermination()
    return spark.read.parquet(path)


def edit_feed(edits: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Edits without repeats, each marked as a change or a deletion; a change and a deletion of one moment both stay."""
    return edits.withWatermark("update_time", delay).select(
        "id", "update_time", F.when(F.col("del_flag") == "1", "deleted").otherwise("changed").alias("feed")).dropDuplicates(["id", "update_time", "feed"])


def dirty_windows(edits: DataFrame, cell: Column, width: str, delay: str = "10 minutes") -> DataFrame:
    """Edits per cell and tumbling window; edits up to ``delay`` late still count.

    In append mode a window comes when it has closed, in update mode each time an edit touches it.
    """
    return edits.withWatermark("update_time", delay).groupBy(F.window("update_time", width), cell.alias("cell")).agg(F.count("*").alias("edits")).select(
        F.col("window.start").alias("start"), "cell", "edits")


def latest_state(edits: DataFrame, order: str = "event_id") -> DataFrame:
    rest = F.struct("del_flag", "update_time", order)
    return edits.groupBy("id").agg(F.max_by(rest, F.struct("update_time", order)).alias("s")).select("id", "s.*")


def last_update(edits: DataFrame, key: str) -> DataFrame:
    return edits.groupBy(key).agg(F.max("update_time").alias("update_time"))


def upsert_batches(path: str, keys: list[str], newer: str) -> Callable[[DataFrame, int], None]:
    """Batch handler that keeps one row per key in a versioned snapshot folder; replaying a batch gives the same rows."""

    def each(batch: DataFrame, number: int) -> None:
        spark, target = batch.sparkSession, f"{path}/version={number}"
        rest = [c for c in batch.columns if c not in keys]
        rows = batch
        if number > 0:
            rows = rows.unionByName(spark.read.parquet(f"{path}/version={number - 1}").select(*batch.columns))
        best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(newer)).alias("_r")).select(*keys, "_r.*")
        best.write.mode("overwrite").parquet(target)

    return each


def newest_version(spark: SparkSession, path: str) -> DataFrame:
    table = spark.read.parquet(path)
    top = table.agg(F.max("version").alias("version"))
    return table.join(top, "version", "left_semi").drop("version")


def incremental_rebuild(edits: DataFrame, rebuild: Callable[[DataFrame], tuple[DataFrame, DataFrame]], path: str, keys: list[str]) -> DataFrame:
    """Rebuild what each micro-batch touched and replace those rows of the stored snapshot.

    ``rebuild`` gives the fresh rows and the touched keys; a touched key without fresh rows is emptied.
    """
    spark = edits.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        fresh, touched = rebuild(batch)
        if number > 0:
            old = spark.read.parquet(f"{path}/version={number - 1}")
            fresh = old.join(touched.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)
        fresh.write.mode("overwrite").parquet(f"{path}/version={number}")

    query = edits.writeStream.option("checkpointLocation", f"{path}-state").trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    return newest_version(spark, path)


def stream_path(spark: SparkSession, label: str) -> str:
    return scratch_path(spark, label)
