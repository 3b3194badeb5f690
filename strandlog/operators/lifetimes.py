"""Lifetimes of allocations and locks from decoded trace events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlog.functions.intervals import points_in_intervals
from strandlog.functions.running import last_before, running


def paired_allocations(events: DataFrame) -> DataFrame:
    """source, base, start, end, type, subclass, size, alloc_size: each allocation with the free that ends it.

    An allocation at an address that is in use, or a free at one that isn't, is left out; size is the free event's where there is one.
    """
    w = Window.partitionBy("source", "base").orderBy("seq")
    af = events.where("action in ('a', 'f')").select("source", "base", "seq", "ts", "action", "type", "subclass", "size")
    # Of a run of equal actions the first counts: an open address stays open, a free one stays free.
    legal = af.withColumn("before", F.lag("action").over(w)).where("(action = 'a' and coalesce(before, 'f') = 'f') or (action = 'f' and before = 'a')")
    both = legal.withColumn("end_seq", F.lead("seq").over(w)).withColumn("end", F.lead("ts").over(w)).withColumn("end_size", F.lead("size").over(w))
    return both.where("action = 'a'").select("source", "base", F.col("seq").alias("start_seq"), "end_seq", F.col("ts").alias("start"), "end", "type", "subclass", F.coalesce("end_size", "size").alias("size"), F.col("size").alias("alloc_size"))


def in_live_allocation(points: DataFrame, allocations: DataFrame, page: int = 4096) -> DataFrame:
    """`points` (source, seq, address) with the allocation that covers the address at that time: base and start_seq, null where none does.

    Base addresses, each once, are laid on the pages that their largest allocation covers, so that the join has an equal key; allocations at one address
    follow each other, so that of these the last one before the point is looked up. A lock's epoch is its allocation's start.
    """
    on_page = lambda c: F.floor(c / page).cast("long")
    bases = allocations.groupBy("source", "base").agg(F.max("alloc_size").alias("reach"))
    laid = bases.withColumn("page", F.explode(F.sequence(on_page(F.col("base")), on_page(F.col("base") + F.greatest("reach", F.lit(1)) - 1))))
    near = points.withColumn("page", on_page(F.col("address"))).join(laid, ["source", "page"]).where("address >= base and address < base + reach").select("source", "base", "seq", "address")
    found = last_before(near, allocations.select("source", "base", "start_seq", "end_seq", "alloc_size"), ["source", "base"], "seq", "start_seq").where("address < base + alloc_size and (end_seq is null or seq < end_seq)")
    return points.join(found.select("source", "seq", "base", "start_seq"), ["source", "seq"], "left")


#: The sides that a lock of each type has.
LOCK_SIDES = {
    "w": ("raw_spinlock_t", "mutex", "softirq", "hardirq", "semaphore", "bit_spin_lock", "sleep mutex", "spin mutex", "kmutex_t"),
    "r": ("rcu",),
    "rw": ("rwlock_t", "rw_semaphore", "sx", "rw", "sleepable rm", "rm", "lockmgr", "krwlock_t"),
}


def lock_kinds(lock_events: DataFrame, skip_sequence_locks: bool = True) -> DataFrame:
    """Lock events with `sides`, null for types that aren't known; sequence locks are skipped unless asked for."""
    found = lock_events if not skip_sequence_locks else lock_events.where(~F.col("type").isin("seqlock_t", "seqcount_t"))
    sides = F.create_map(*[F.lit(x) for s, ts in LOCK_SIDES.items() for t in ts for x in (t, s)])
    return found.withColumn("sides", sides[F.col("type")])


def unrolled_stacks(traces: DataFrame, symbols: DataFrame) -> DataFrame:
    """stacktrace_id, sequence, instruction_ptr, function, file, line: frames in order, inlined callers as frames of their own.

    `traces` has stacktrace_id, instruction_ptr and stacktrace (hexadecimal pointers); frames after the first are looked up one byte before.
    `symbols` has instruction_ptr, depth (0 for the innermost inlined function), function, file, line.
    """
    pointers = F.concat(F.array("instruction_ptr"), F.transform(F.filter(F.split("stacktrace", ","), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("decimal(20,0)")))
    frames = traces.select("stacktrace_id", F.posexplode(pointers).alias("frame", "ip")).withColumn("at", F.col("ip") - F.when(F.col("frame") > 0, 1).otherwise(0))
    found = frames.join(symbols.withColumnRenamed("instruction_ptr", "at"), "at", "left")
    order = F.row_number().over(Window.partitionBy("stacktrace_id").orderBy("frame", "depth")) - 1
    return found.select("stacktrace_id", order.alias("sequence"), F.col("ip").alias("instruction_ptr"), "function", "file", "line")


def symbols_at(addresses: DataFrame, scopes: DataFrame, line_table: DataFrame, bucket: int = 256) -> DataFrame:
    """instruction_ptr, depth, function, file, line: what stands at each address, the innermost inlined function first.

    `addresses` has module and instruction_ptr. `scopes` are nested address ranges: module, low, high (exclusive), level (0 for a function's own range, one more for each range inlined in it),
    function, call_file and call_line (the place in the enclosing function that an inlined range stands for). `line_table` has module, address, file, line; a row holds up to the module's
    next address. The innermost function is at the line table's place, each outer one at the call that the range within it stands for. Addresses in no range have a row with a null function.
    """
    asked = addresses.select("module", F.col("instruction_ptr").cast("long").alias("at")).distinct()
    # the join takes what lies between its ends, both left out
    inside = points_in_intervals(asked, "at", scopes.withColumn("before", F.col("low") - 1), "before", "high", "module", bucket)
    inner = Window.partitionBy("module", "at").orderBy(F.desc("level"))
    nested = inside.select("module", "at", "function", (F.row_number().over(inner) - 1).alias("depth"), F.lag("call_file").over(inner).alias("call_file"), F.lag("call_line").over(inner).alias("call_line"))
    starts = line_table.groupBy("module", "address").agg(F.min(F.struct("file", "line")).alias("place"))
    ends = running(starts.withColumn("back", -F.col("address")), ["module"], "back", F.col("address"), "min", "next", before=True)
    lines = points_in_intervals(asked, "at", ends.select("module", (F.col("address") - 1).alias("before"), "next", "place"), "before", "next", "module", bucket).select("module", "at", "place")
    found = asked.join(nested, ["module", "at"], "left").join(lines, ["module", "at"], "left")
    own = F.coalesce("depth", F.lit(0)) == 0
    return found.select("module", F.col("at").alias("instruction_ptr"), F.coalesce("depth", F.lit(0)).alias("depth"), "function", F.when(own, F.col("place.file")).otherwise(F.col("call_file")).alias("file"), F.when(own, F.col("place.line")).otherwise(F.col("call_line")).alias("line"))


def stack_pointers(traces: DataFrame) -> DataFrame:
    """instruction_ptr of all frames of `traces`, those after the first one byte back, as unrolled_stacks looks them up."""
    pointers = F.concat(F.array(F.col("instruction_ptr").cast("decimal(20,0)")), F.transform(F.filter(F.split("stacktrace", ","), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("decimal(20,0)")))
    frames = traces.select(F.posexplode(pointers).alias("frame", "ip"))
    return frames.select((F.col("ip") - F.when(F.col("frame") > 0, 1).otherwise(0)).cast("long").alias("instruction_ptr")).distinct()


def expanded_blacklist(rules: DataFrame, subclasses: DataFrame, members: DataFrame) -> DataFrame:
    """subclass_id, member_name_id, fn, sequence: a type stands for all its subclasses, type:subclass for one, null for any; unknown names are left out."""
    named = subclasses.select(F.col("id").alias("subclass_id"), "type_name", F.concat_ws(":", "type_name", "name").alias("full_name"))
    for_all = rules.where("datatype is null").withColumn("subclass_id", F.lit(None).cast("int"))
    # a subclass goes by its type's name and by its own: one equal key
    names = named.select("subclass_id", F.explode(F.array_distinct(F.array("type_name", "full_name"))).alias("datatype"))
    for_some = rules.where("datatype is not null").join(names, "datatype")
    both = for_all.unionByName(for_some).join(members.select(F.col("id").alias("member_name_id"), F.col("name").alias("datatype_member")), "datatype_member", "left")
    return both.where("datatype_member is null or member_name_id is not null").select("subclass_id", "member_name_id", "fn", "sequence")
