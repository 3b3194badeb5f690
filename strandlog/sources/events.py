"""A trace database from the `events` table: each event is a lock operation or a member access of a small fixed world.

Signups acquire, errors release, purchases write, clicks and views read. The context is the user modulo 4; a context has four locks
(a global mutex, a global read-side lock, and two locks embedded in one of its allocations) and eight allocations of two struct types.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions import checkpoints
from strandlog.operators import flat, layout, mining, observations, transactions
from strandlog.functions.intervals import points_in_intervals


class Trace:
    """The base and derived tables of a trace, each a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def fixed(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    @cached_property
    def events(self) -> DataFrame:
        """Written once: the range joins read their points and the acquisitions among them several times."""
        kind = F.expr("case event_type when 'signup' then 'P' when 'error' then 'V' when 'purchase' then 'w' when 'click' then 'r' when 'view' then 'r' end")
        e = self.table("events").select((F.col("event_id") + 1).alias("seq"), F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"), "user_id", "event_type", kind.alias("kind"))
        e = e.withColumn("ctx", (F.col("user_id") % 4).cast("int")).withColumn("slot", F.col("k") % 4)
        return checkpoints.kept(e.withColumn("lock_id", F.col("ctx") * 4 + F.col("slot") + 1), "trace-events")

    @cached_property
    def data_types(self) -> DataFrame:
        return self.fixed([(1, "node"), (2, "buf")], "id int, name string")

    @cached_property
    def subclasses(self) -> DataFrame:
        return self.fixed([(1, 1, "ext"), (2, 1, "proc"), (3, 2, None)], "id int, data_type_id int, name string")

    @cached_property
    def allocations(self) -> DataFrame:
        i = F.col("id") - 1
        subclass = F.when(i % 2 == 1, 3).when(i % 8 < 4, 1).otherwise(2)
        return self.spark.range(1, 33).select(F.col("id").cast("int")).select("id", subclass.cast("int").alias("subclass_id"), (F.col("id").cast("long") * 65536).alias("base_address"), F.lit(64).alias("size"), F.lit(0).cast("long").alias("start_ts"), F.lit(None).cast("long").alias("end_ts"))

    @cached_property
    def member_names(self) -> DataFrame:
        return self.fixed([*[(m, f"m{m - 1}") for m in range(1, 7)], (7, "m_lock")], "id int, name string")

    @cached_property
    def structs_layout(self) -> DataFrame:
        rows = [(t, "atomic_t" if (t, m) == (2, 6) else "int", m, 8 * (m - 1), 16 if m == 7 else 8) for t in (1, 2) for m in range(1, 8)]
        return self.fixed(rows, "data_type_id int, data_type_name string, member_name_id int, byte_offset int, size int")

    @cached_property
    def stacktraces(self) -> DataFrame:
        s = self.spark.range(1, 11).select(F.col("id").cast("int"), F.explode(F.array(*map(F.lit, range(3)))).alias("sequence"))
        ip = F.lit(4096) + 16 * F.col("id") + F.col("sequence")
        fn = F.concat(F.lit("fn"), ((3 * F.col("id") + F.col("sequence")) % 7).cast("string"))
        return s.select("id", "sequence", ip.cast("long").alias("instruction_ptr"), (ip - F.when(F.col("sequence") > 0, 1).otherwise(0)).cast("long").alias("instruction_ptr_prev"), fn.alias("function"), (F.col("id") + F.col("sequence")).alias("line"), F.concat(fn, F.lit(".c")).alias("file"))

    @cached_property
    def function_blacklist(self) -> DataFrame:
        return self.fixed([(1, None, None, "fn3", 0), (2, 1, None, "fn5", None), (3, 3, 2, "fn1", None)], "id int, subclass_id int, member_name_id int, fn string, sequence int")

    @cached_property
    def member_blacklist(self) -> DataFrame:
        return self.fixed([(2, 3)], "subclass_id int, member_name_id int")

    @cached_property
    def locks(self) -> DataFrame:
        rows = []
        for i in range(16):
            ctx, slot = divmod(i, 4)
            alloc = ctx * 8 + slot + 1
            rows.append(
                [
                    (i + 1, 4096 + i + 1, None, "mutex", "w", f"glock{ctx}", 0),
                    (i + 1, 66, None, "rcu", "r", None, 0),
                    (i + 1, 65536 * alloc + 48, alloc, "spinlock", "w", None, 0),
                    (i + 1, 65536 * alloc + 52, alloc, "rw_semaphore", "r", None, 0),
                ][slot]
            )
        return self.fixed(rows, "id int, address long, embedded_in int, lock_type_name string, sub_lock string, lock_var_name string, flags int")

    @cached_property
    def acquisitions(self) -> DataFrame:
        return checkpoints.kept(transactions.acquisitions(self.events.where("kind in ('P', 'V')")), "trace-acquisitions")

    @cached_property
    def raw_accesses(self) -> DataFrame:
        alloc = F.col("ctx") * 8 + F.col("k") % 8 + 1
        address = alloc.cast("long") * 65536 + 8 * (F.floor(F.col("k") / 8) % 6) + 4 * (F.col("k") % 2)
        return self.events.where("kind in ('r', 'w')").select("seq", "ctx", F.col("seq").alias("id"), alloc.alias("alloc_id"), F.col("seq").alias("ts"), F.col("kind").alias("type"), F.lit(4).alias("size"), address.alias("address"), (F.col("user_id") % 10 + 1).cast("int").alias("stacktrace_id"), F.col("ctx").alias("context"))

    @cached_property
    def _attributed(self) -> tuple[DataFrame, DataFrame]:
        held = points_in_intervals(self.raw_accesses.select("ctx", "seq"), "seq", self.acquisitions, "a", "r", "ctx", transactions.BUCKET)
        return transactions.with_transactions(self.raw_accesses, held, self.acquisitions)

    @cached_property
    def accesses(self) -> DataFrame:
        """Written once, as most tables and queries read them, and more than once."""
        return checkpoints.kept(self._attributed[0].select("id", "alloc_id", "txn_id", "ts", "type", "size", "address", "stacktrace_id", "context"), "trace-accesses")

    @cached_property
    def locks_held(self) -> DataFrame:
        slot = (F.col("lock_id") - 1) % 4
        return checkpoints.kept(self._attributed[1].select("txn_id", "lock_id", "start", F.concat(F.lit("l"), slot.cast("string"), F.lit(".c")).alias("last_file"), (slot + 1).alias("last_line")), "trace-locks-held")

    @cached_property
    def txns(self) -> DataFrame:
        return self.accesses.where("txn_id is not null").groupBy(F.col("txn_id").alias("id")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min("context").alias("start_ctx"), F.count(F.lit(1)).alias("n_accesses"))

    @cached_property
    def layout_flat(self) -> DataFrame:
        return layout.flattened(self.structs_layout)

    @cached_property
    def accesses_flat(self) -> DataFrame:
        return flat.accesses_flat(self)

    @cached_property
    def locks_embedded_flat(self) -> DataFrame:
        return flat.locks_embedded_flat(self)

    @cached_property
    def observed(self) -> DataFrame:
        """The observations that rules are mined from, written once for all that read them."""
        return checkpoints.kept(observations.txn_members_locks(self), "trace-observations")

    @cached_property
    def combinations(self) -> DataFrame:
        return checkpoints.kept(mining.combinations(self.observed), "trace-combinations")
