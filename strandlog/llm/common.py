"""Reading tables, and tables written to the shared folder to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own where it is unset and the driver is the only machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="strandlog-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Spark drops an execution's shuffle files at its end where this is set.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: later jobs start from files, whatever executors are lost.

    The shuffle files of the job go with its end: nothing that follows reads them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_path = path
    return found


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that `written` gave; nothing may read it any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)


def pylist(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most_bytes` of the column's data at most, a row at least: long texts don't add up."""
    for batch in batches:
        data = batch.column(batch.schema.get_field_index(column))
        if data.nbytes <= most_bytes or batch.num_rows == 1:
            if batch.num_rows:
                yield batch
            continue
        half = batch.num_rows // 2
        yield from slices(iter((batch.slice(0, half), batch.slice(half))), column, most_bytes)


class Recent(dict):
    """A dict of at most about twice `most` entries: when it is full it becomes the older half, which is looked up next."""

    def __init__(self, most: int):
        self.most, self.older = most, {}

    def find(self, key):
        found = self.get(key)
        if found is None and (found := self.older.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
