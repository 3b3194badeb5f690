"""Structured Streaming over growing traces: decoding, and transactions with keyed state."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from strandlog.operators.machine import Machine
from strandlog.sources.traces import decoded


def trace_stream(spark: SparkSession, directory: str, separator: str = ";", files_at_once: int = 1) -> tuple[DataFrame, DataFrame]:
    """Events and undecodable lines of the files that arrive in a directory. `source` is the file, `seq` the line in it: together they order a trace whose files arrive by name.

    A file is read whole, so that its lines can be numbered; a trace that grows is cut into files that a task can hold.
    """
    files = spark.readStream.option("maxFilesPerTrigger", files_at_once).text(directory, wholetext=True)
    lines = files.select(F.col("_metadata.file_path").alias("source"), F.posexplode(F.split("value", "\n")).alias("seq", "value"))
    return decoded(lines.select("source", F.col("seq").cast("long").alias("seq"), "value"), separator)


STREAMED = "trace long, file string, line long, txn_id long, locks string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Transactions(StatefulProcessor):
    """The exact machine of a trace with its state in maps: the stack of each context, and the contexts that hold each lock.

    An operation needs its own context's stack and those of the contexts that hold its lock; a batch reads these entries once and writes back those it changed, however many
    others there are. Events are numbered as they come, in the order of file and line.
    """

    def init(self, handle) -> None:
        self.count = handle.getValueState("count", "n long")
        self.stacks = handle.getMapState("stacks", "ctx long", "items string")
        self.holders = handle.getMapState("holders", "lock long", "contexts string")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        machine, seq = Machine(), self.count.get()[0] if self.count.exists() else 0
        holders: dict[int, set[int]] = {}

        def known(state, k):
            return json.loads(state.getValue((k,))[0]) if state.containsKey((k,)) else []

        def loaded(ctx: int) -> None:
            if ctx not in machine.stacks:
                machine.stacks[ctx] = known(self.stacks, ctx)

        out = []
        for file, line, ctx, kind, lock, side, again in pd.concat(list(rows)).sort_values(["file", "line"])[["file", "line", "ctx", "kind", "lock", "side", "recursive"]].itertuples(index=False):
            seq += 1
            lock = None if pd.isna(lock) else int(lock)
            loaded(int(ctx))
            if lock is not None:
                if lock not in holders:
                    holders[lock] = set(known(self.holders, lock))
                for other in holders[lock]:
                    loaded(other)
                holders[lock].add(int(ctx))
            if found := machine.step(seq, int(ctx), kind, lock, side, bool(again)):
                out.append((key[0], file, line, *found))
        self.count.update((seq,))
        for ctx, stack in machine.stacks.items():
            if stack:
                self.stacks.updateValue((ctx,), (json.dumps(stack),))
            elif self.stacks.containsKey((ctx,)):
                self.stacks.removeKey((ctx,))
        for lock, contexts in holders.items():
            held = sorted(c for c in contexts if any(x[0] == lock for x in machine.stacks[c]))
            if held:
                self.holders.updateValue((lock,), (json.dumps(held),))
            elif self.holders.containsKey((lock,)):
                self.holders.removeKey((lock,))
        yield pd.DataFrame(out, columns=["trace", "file", "line", "txn_id", "locks"]).astype({"txn_id": "Int64"})

    def close(self) -> None:
        pass


def transactions(events: DataFrame) -> DataFrame:
    """trace, file, line, txn_id, locks of the accesses of a stream of events (trace, file, line, ctx, kind, lock, side, recursive).

    A trace is the unit of parallelism, as its contexts share locks. Events of one batch are put in order, batches are taken as they come; state outlives a restart with the query's checkpoint.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return events.groupBy("trace").transformWithStateInPandas(Transactions(), STREAMED, "append", "none")


def access_counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Accesses by window of event time and kind, for streams whose events carry a timestamp `at`."""
    return events.where("kind in ('r', 'w')").withWatermark("at", late).groupBy(F.window("at", window), "kind").agg(F.count(F.lit(1)).alias("n"))
