"""Readers of the Parquet tables and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data folder ``sf_dir``, by any path Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the one all executors share: ``spark.checkpoint.dir`` of the session.

    Only in tests on one machine, where none is named, one is set here; a cluster without one is an error, as its
    executors could not see each other's files.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not found:
        found = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        context.setCheckpointDir(found)
    return f"{found}/{context.applicationId}"


def drop_scratch(spark: SparkSession) -> bool:
    """Delete what this application has left in the shared folder; nothing built on it can be read afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    This cuts the lineage: what follows survives the loss of executors and the
    work above runs once, however often the result is used.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
