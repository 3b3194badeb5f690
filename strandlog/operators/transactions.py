"""Lock-scoped transactions from a trace, in closed form.

A context's held locks are a stack of acquisitions. An access belongs to the transaction of the newest acquisition held at its
time; a transaction restarts under a new identity where an older lock is released below it. For well-formed traces both follow from
intervals: held(t) are the acquisitions with a < t < r, the top is the one with the largest a, and the restart is the latest release
between the top and t of an acquisition older than the top.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlog.functions import checkpoints
from strandlog.functions.intervals import points_in_intervals

#: Sequence numbers of one bucket of the range joins.
BUCKET = 256
#: A transaction's id is its begin times this, plus its top acquisition.
ID_FACTOR = 1 << 20


def well_formed(lock_events: DataFrame) -> DataFrame:
    """P events that follow a V or nothing, and V events that follow a P, for each (ctx, slot) in order of seq."""
    before = F.lag("kind").over(Window.partitionBy("ctx", "slot").orderBy("seq"))
    return lock_events.withColumn("before", before).where("(kind = 'P' and coalesce(before, 'V') = 'V') or (kind = 'V' and before = 'P')").drop("before")


def acquisitions(lock_events: DataFrame) -> DataFrame:
    """ctx, slot, lock_id, a, r: one row for each kept P, released at the next kept event of its lock."""
    released = F.lead("seq").over(Window.partitionBy("ctx", "slot").orderBy("seq"))
    return well_formed(lock_events).withColumn("r", released).where("kind = 'P'").select("ctx", "slot", "lock_id", F.col("seq").alias("a"), "r")


def with_transactions(accesses: DataFrame, held: DataFrame, acquired: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`accesses` with txn_id (null where nothing is held), and locks_held: txn_id, lock_id, start.

    `held` has a row for each access (by seq) and acquisition that it lies in. It is gathered by access and written once with the transactions, so that intervals and
    points meet once for both tables. All accesses of a transaction hold the same locks, as the release of one below the top begins another; so one access tells them.
    """
    tops = held.groupBy("ctx", "seq").agg(F.max("a").alias("a_top"), F.collect_list(F.struct("lock_id", F.col("a").alias("start"))).alias("held"))
    older = acquired.where("r is not null").select("ctx", F.col("a").alias("a_old"), F.col("r").alias("cut"))
    cuts = points_in_intervals(older, "cut", acquired.select("ctx", F.col("a").alias("a_top"), "r"), "a_top", "r", "ctx", BUCKET).where("a_old < a_top").select("ctx", "a_top", F.col("cut").alias("seq"))
    # The latest cut before an access under one top: a running maximum over cuts and accesses together.
    both = tops.withColumn("cut", F.lit(None).cast("long")).unionByName(cuts.select("ctx", "a_top", "seq", F.col("seq").alias("cut")), allowMissingColumns=True)
    running = F.max("cut").over(Window.partitionBy("ctx", "a_top").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    keyed = both.withColumn("restart", running).where("cut is null").select("seq", (F.coalesce("restart", "a_top") * ID_FACTOR + F.col("a_top")).alias("txn_id"), "held")
    keyed = checkpoints.kept(keyed, "trace-transactions")
    found = accesses.join(keyed.select("seq", "txn_id"), "seq", "left")
    firsts = keyed.groupBy("txn_id").agg(F.min("seq").alias("seq"))
    locks = keyed.join(firsts, ["seq", "txn_id"], "left_semi").select("txn_id", F.inline("held"))
    return found, locks
