"""The folder of checkpoints."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepared(spark: SparkSession) -> None:
    """Takes the folder that the session names in spark.checkpoint.dir; one of our own where it is unset and the driver is the only machine, as in tests."""
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp())


def kept(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the folder of checkpoints and read again: its lineage ends there, and later reads take the columns they need."""
    spark = df.sparkSession
    prepared(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
