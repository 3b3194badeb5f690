"""Several tables written as one: a batch is in all of them or in none, and once, however often it is written.

A batch is written to a staging folder first and then moved to `table/batch=<id>`; a marker says that all tables have it. Readers take batches with a marker only. A
batch with a marker is not written again, one without is replaced, so that a stream's foreachBatch may repeat it after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    @property
    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def done(self) -> list[int]:
        """Batches that all tables have."""
        where = self._path("_done")
        return sorted(int(x.getPath().getName()) for x in self._files.listStatus(where)) if self._files.exists(where) else []

    def write(self, tables: dict[str, DataFrame], batch: int = 0) -> bool:
        """Writes a batch of all tables; false if they have it already."""
        files = self._files
        if files.exists(self._path("_done", str(batch))):
            return False
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/_staging/{batch}/{name}")
        for name in tables:
            target = self._path(name, f"batch={batch}")
            files.delete(target, True)
            files.mkdirs(target.getParent())
            if not files.rename(self._path("_staging", str(batch), name), target):
                raise OSError(f"could not move batch {batch} of {name}")
        files.delete(self._path("_staging", str(batch)), True)
        files.mkdirs(self._path("_done"))
        files.create(self._path("_done", str(batch))).close()
        return True

    def read(self, name: str, schema) -> DataFrame:
        """A table's rows in batches that all tables have; `schema` is the table's."""
        found = [f"{self.root}/{name}/batch={b}" for b in self.done()]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def dropped(self) -> None:
        """Removes all tables, for a run that begins anew."""
        self._files.delete(self._path(), True)


def write_text_tables(tables: dict[str, DataFrame], root: str, separator: str) -> None:
    r"""Each table as separated text with a header: nulls are \N, values with separators, quotes or line ends are quoted, and quotes in them doubled."""
    for name, df in tables.items():
        df.write.mode("overwrite").csv(f"{root.rstrip('/')}/{name}", sep=separator, header=True, nullValue=r"\N", emptyValue="", quote='"', escape='"')


def read_text_table(spark: SparkSession, path: str, schema, separator: str) -> DataFrame:
    """What write_text_tables wrote."""
    return spark.read.schema(schema).csv(path, sep=separator, header=True, nullValue=r"\N", emptyValue="", quote='"', escape='"', multiLine=True)


def counted_by(values: dict[str, object]) -> list:
    """Aggregates of an observation: for each name the rows that its condition holds for."""
    return [F.count(F.when(condition, 1)).alias(name) for name, condition in values.items()]
