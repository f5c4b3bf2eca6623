"""Tables written once to the shared folder, so that lineage is cut and lost executors cost only a re-read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.pin import checkpoint_dir


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, removed when the driver's JVM ends."""
    context = spark.sparkContext
    base = checkpoint_dir(spark)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    path = context._jvm.org.apache.hadoop.fs.Path(f"{base}/llm-{name}-{uuid.uuid4().hex}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the stored table."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
