"""Structured Streaming over event tables: windows, sessions, first and last seen, dedup."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.shared import shared


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream: a folder of parquet files, or one file, which is picked from its folder by
    name. `ts` becomes a moment with a zone, as watermarks need."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        rows = reader.parquet(path)
    else:
        folder, leaf = os.path.split(path)
        rows = reader.option("pathGlobFilter", leaf).option("recursiveFileLookup", "false").parquet(folder)
    return rows.withColumn("ts", F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))


def drained(df: DataFrame, mode: str) -> DataFrame:
    """What a streaming query gives once all input there is has been read (one available-now run). Each
    batch is written to a folder of its own below spark.checkpoint.dir, a batch that runs again over
    what it left. Complete mode gives the whole result each time, so the last batch has it; else the
    batches add up."""
    spark, at = df.sparkSession, shared(df.sparkSession, "drained")
    batches: set[int] = set()

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")
        batches.add(number)

    df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    if not batches:
        return spark.createDataFrame([], df.schema)
    wanted = [max(batches)] if mode == "complete" else sorted(batches)
    return spark.read.schema(df.schema).parquet(*[f"{at}/out/batch={number}" for number in wanted])


def tumbling(events: DataFrame, key: str, size: str, late: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, key: str, size: str, step: str, late: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"), key).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))


def first_last_seen(events: DataFrame, key: str) -> DataFrame:
    """A running state by key, kept whole: nothing is late, as an earlier date must still win."""
    return events.groupBy(key).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))


def once(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
