"""Trace lines from the `events` table: sixteen objects of four types (one of them unknown) that are allocated, freed, accessed and locked in the events' order.

Signups allocate, errors free, clicks read, purchases write (every ninth place lies beyond the object), views operate locks: two embedded ones, the
read-side pseudo-lock, a global one, and one whose place is unknown or whose type is a sequence lock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions import checkpoints
from strandlog.operators.conversion import Converted
from strandlog.sources.traces import decoded

TYPES = ["node", "buf"]
SECTIONS = [(4096, 200)]
BASE_DIR = "/src/k"


def trace_lines(events: DataFrame) -> DataFrame:
    """source, seq, value: lines as the reader of trace files gives them."""
    e = events.select((F.col("event_id") + 1).alias("seq"), "event_type", F.col("user_id").alias("u"), F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))
    n, is_lock, place = F.col("u") % 16, F.col("event_type") == "view", F.col("k") % 5
    base = 65536 * (n + 1)
    action = F.create_map(*[F.lit(x) for pair in {"signup": "a", "error": "f", "click": "r", "purchase": "w", "view": "l"}.items() for x in pair])[F.col("event_type")]
    lock_address = F.when(place == 0, base + 48).when(place == 1, base + 56).when(place == 2, 66).when(place == 3, 4096 + 16 * n).otherwise(900_000_000 + n)
    lock_type = F.when(place == 0, "rw_semaphore").when(place == 2, "rcu").when((place == 4) & (n % 2 == 0), "seqlock_t").otherwise("mutex")
    address = F.when(is_lock, lock_address).when(F.col("event_type").isin("click", "purchase"), base + 8 * (F.col("k") % 9)).otherwise(base)
    of_object = F.when(n % 4 == 0, "node:ext").when(n % 4 == 1, "node:proc").when(n % 4 == 2, "buf").otherwise("odd")
    columns = [
        F.col("seq"),
        action,
        F.when(is_lock, (F.col("k") % 4).cast("string")).otherwise(""),
        F.lower(F.hex(address.cast("long"))),
        F.when(F.col("event_type") == "signup", 64).when(F.col("event_type") == "error", 32).otherwise(4),
        F.lower(F.hex(base.cast("long"))),
        F.when(is_lock, lock_type).when(F.col("event_type") == "signup", of_object).otherwise(""),
        F.when(place == 2, "static").otherwise(""),
        F.concat(F.lit("/src/k/l"), n.cast("string"), F.lit(".c")),
        place,
        F.lower(F.hex((4096 + F.col("u") % 10).cast("long"))),
        F.concat(F.lower(F.hex((F.col("u") % 3).cast("long"))), F.lit(",20,")),
        F.when(is_lock, (F.col("u") % 2).cast("string")).otherwise("0"),
        F.col("u") % 4,
    ]
    return e.where(action.isNotNull()).select(F.lit("events").alias("source"), "seq", F.concat_ws(";", *[c.cast("string") for c in columns]).alias("value"))


def converted(spark: SparkSession, sf_dir: str) -> Converted:
    # written once, else the reader's filters and columns each put the lines together anew
    events, _ = decoded(checkpoints.kept(trace_lines(spark.read.parquet(f"{sf_dir}/events.parquet")), "trace-lines"))
    variables = spark.createDataFrame([(1, 4096, 20, "table"), (2, 4096, 8, "first"), (3, 4128, 4, "third")], "position int, address long, size int, name string")
    symbols = spark.createDataFrame([(4144, "fourth"), (4128, "hidden")], "address long, name string")
    return Converted(events, spark.createDataFrame([(t,) for t in TYPES], "type_name string"), SECTIONS, variables, symbols, BASE_DIR)
