"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def base(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session (tests) gets a folder; elsewhere each
    executor would write to a disk of its own, so that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='lodestrata-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def shared(spark: SparkSession, name: str) -> str:
    """A new place below it."""
    return f"{base(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table there: its lineage ends, and files take less room than a checkpoint's."""
    at = shared(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out.written_at = at
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables from written() that nothing reads any more."""
    for t in tables:
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_at)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
