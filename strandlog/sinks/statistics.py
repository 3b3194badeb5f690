"""Statistics of a run: durations of its steps, and counts observed while its tables are written, without reading them again."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from strandlog.sinks.tables import counted_by


class Statistics:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._seconds: list[tuple[str, str, float]] = []
        self._observed: list[tuple[str, Observation]] = []

    @contextlib.contextmanager
    def timed(self, step: str, section: str) -> Iterator[None]:
        began = time.monotonic()
        try:
            yield
        finally:
            self._seconds.append((step, section, time.monotonic() - began))

    def observed(self, df: DataFrame, topic: str, **counts: Column) -> DataFrame:
        """`df`, whose rows are counted by conditions as an action runs over it."""
        seen = Observation()
        self._observed.append((topic, seen))
        return df.observe(seen, *counted_by(counts))

    def durations(self) -> DataFrame:
        """step, section, duration: seconds of each timed section, a total for each step, and one for all."""
        steps = dict.fromkeys(step for step, _, _ in self._seconds)
        totals = [(step, "total", sum(s for x, _, s in self._seconds if x == step)) for step in steps]
        every = ("total", "total", float(sum(s for _, _, s in self._seconds)))
        return self.spark.createDataFrame([*self._seconds, *totals, every], "step string, section string, duration double")

    def counts(self) -> DataFrame:
        """topic, param, value of all that was observed. It waits for the actions that haven't run."""
        rows = [(topic, name, int(n)) for topic, seen in self._observed for name, n in seen.get.items()]
        return self.spark.createDataFrame(rows, "topic string, param string, value long")
