"""From decoded trace events to the tables of a trace: subclasses, allocations, locks, lock operations, accesses, stack traces, and what was rejected.

Numbers follow the order of first appearance within a source; they are counted by blocks of the order, so that no source is one task. Events have source and
seq (no ties). The events and what several tables build on are written once in the folder of checkpoints, so that no plan parses the lines twice. What can't be placed is in `rejected` with its reason. Two departures from a reader that goes line by line: a lock that is first seen outside
all allocations, and later inside one, is two locks; and a subclass name counts as shown even where its first allocation was at an address in use.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.functions.checkpoints import kept as written
from strandlog.functions.running import last_before, running
from strandlog.operators.lifetimes import in_live_allocation, lock_kinds, paired_allocations

#: The addresses that stand for the pseudo-locks, and the member name they come with.
PSEUDO_LOCKS, PSEUDO_MEMBER = (0x42, 0x44, 0x45), "static"
#: Width, in the order's units, of a block of a count.
BLOCK = 1 << 18
PAGE = 4096


def numbered(df: DataFrame, order: str, out: str = "id", step: Column | None = None) -> DataFrame:
    """`df` with the running sum of `step` (1 where it isn't given) in the order, for each source."""
    return running(df, ["source"], order, F.lit(1).cast("long") if step is None else step, "sum", out, width=BLOCK)


def relative_path(path: Column, base_dir: str) -> Column:
    """The path without the source tree's folder, wherever the folder is found: as many characters go from the front as it has."""
    prefix = base_dir.rstrip("/") + "/"
    return F.when(F.instr(path, prefix) > 0, F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


def without_lock_noise(events: DataFrame) -> DataFrame:
    """Without a read and a write of one place and moment that stand directly before an operation of the lock at that place."""
    n = numbered(events.select("source", "seq", "action", "ts", "address", "size"), "seq", "n")
    access = lambda action, by: n.where(F.col("action") == action).select("source", (F.col("n") + by).alias("n"), F.col("seq").alias(action), *[F.col(c).alias(f"{action} {c}") for c in ("ts", "address", "size")])
    found = n.where("action = 'l'").select("source", "n", "address").join(access("w", 1), ["source", "n"]).join(access("r", 2), ["source", "n"])
    noise = found.where("`r ts` = `w ts` and `r address` = `w address` and `r size` = `w size` and `r address` = address")
    return events.join(noise.select("source", F.explode(F.array("r", "w")).alias("seq")), ["source", "seq"], "left_anti")


def variable_names(places: DataFrame, variables: DataFrame, symbols: DataFrame) -> DataFrame:
    """`places` (address) with lock_var_name: of the static variables that cover the address the first by position, else the symbol at exactly that address."""
    on_page = lambda c: F.floor(c / PAGE).cast("long")
    laid = variables.where("size > 0").select("position", F.col("address").alias("low"), "size", "name", F.explode(F.sequence(on_page(F.col("address")), on_page(F.col("address") + F.col("size") - 1))).alias("page"))
    at = places.select("address").distinct()
    inside = at.withColumn("page", on_page(F.col("address"))).join(laid, "page").where("address >= low and address < low + size").groupBy("address").agg(F.min_by("name", "position").alias("variable"))
    exact = symbols.groupBy("address").agg(F.min("name").alias("symbol"))
    return at.join(inside, "address", "left").join(exact, "address", "left").select("address", F.coalesce("variable", "symbol").alias("lock_var_name"))


class Converted:
    """Tables of a trace, each a lazy DataFrame.

    `types` has type_name; `sections` are the (start, size) of the data sections, a list as short as an executable's section table, with both ends inside;
    `variables` has position, address, size, name; `symbols` has address and name.
    """

    def __init__(self, events: DataFrame, types: DataFrame, sections: list[tuple[int, int]], variables: DataFrame, symbols: DataFrame, base_dir: str, all_locks: bool = False, sequence_locks: bool = False, drop_noise: bool = False):
        self.decoded, self.types, self.sections, self.variables, self.symbols, self.base_dir = events, types, sections, variables, symbols, base_dir
        self.all_locks, self.sequence_locks, self.drop_noise = all_locks, sequence_locks, drop_noise

    @cached_property
    def events(self) -> DataFrame:
        return written(self.decoded, "trace-events")

    @cached_property
    def _shown(self) -> DataFrame:
        """Subclass names at their first allocation with a known type; a type without subclasses stands for itself."""
        known = self.events.where("action = 'a'").join(self.types.select(F.col("type_name").alias("type")).distinct(), "type", "left_semi")
        named = known.withColumn("key", F.coalesce("subclass", "type"))
        first = named.groupBy("source", "key").agg(F.min_by(F.struct("seq", "type", "subclass"), "seq").alias("x"))
        # One row for each struct type and subclass of the traced program.
        number = F.row_number().over(Window.partitionBy("source").orderBy("x.seq"))
        return written(first.select("source", number.alias("id"), "key", F.col("x.type").alias("type_name"), F.col("x.subclass").alias("name"), F.col("x.seq").alias("shown")), "trace-subclasses")

    @cached_property
    def subclasses(self) -> DataFrame:
        """source, id, type_name, name; the name is null for a type that has none."""
        return self._shown.select("source", "id", "type_name", "name")

    @cached_property
    def clashes(self) -> DataFrame:
        """Subclasses of a type that was allocated without one before: a trace must give subclasses to all allocations of a type or to none."""
        before = self._shown.select("source", F.col("key").alias("type_name"), F.col("shown").alias("dummy"))
        return self._shown.where("name is not null").join(before, ["source", "type_name"]).where("dummy < shown").select("source", "id", "type_name", "name")

    @cached_property
    def _named(self) -> DataFrame:
        """Allocations and frees; the allocations with the subclass that was shown by then, null for none."""
        events = self.events.where("action in ('a', 'f')").withColumn("key", F.when(F.col("action") == "a", F.coalesce("subclass", "type")))
        return events.join(self._shown.select("source", "key", F.col("id").alias("subclass_id"), "shown"), ["source", "key"], "left").withColumn("subclass_id", F.when(F.col("shown") <= F.col("seq"), F.col("subclass_id"))).drop("shown", "key")

    @cached_property
    def _lives(self) -> DataFrame:
        known = self._named.where("action = 'f' or subclass_id is not null")
        paired = paired_allocations(known)
        return written(numbered(paired.join(known.select("source", F.col("seq").alias("start_seq"), "subclass_id"), ["source", "start_seq"]), "start_seq"), "trace-lives")

    @cached_property
    def allocations(self) -> DataFrame:
        return self._lives.select("source", "id", "subclass_id", F.col("base").alias("base_address"), "size", "start", "end")

    @cached_property
    def _placed(self) -> DataFrame:
        """Reads and writes with the allocation that lives at their base, null where there is none."""
        accesses = self.events.where("action in ('r', 'w')")
        lives = self._lives.select("source", "base", F.col("id").alias("alloc_id"), "start_seq", "end_seq", "alloc_size", F.col("base").alias("low"))
        found = last_before(accesses.where("base is not null").select("source", "base", "seq"), lives, ["source", "base"], "seq", "start_seq").where("end_seq is null or seq < end_seq").select("source", "seq", "alloc_id", "alloc_size", "low")
        inside = (F.col("address") >= F.col("low")) & (F.col("address") + F.col("size") <= F.col("low") + F.col("alloc_size"))
        return written(accesses.join(found, ["source", "seq"], "left").withColumn("inside", inside), "trace-accesses")

    @cached_property
    def accesses(self) -> DataFrame:
        """source, id, seq, alloc_id, ts, type, size, address, context: those within their allocation. Noise at locks keeps its numbers, so that ids have gaps."""
        kept = numbered(self._placed.where("inside"), "seq")
        if self.drop_noise:
            others = self.events.where("action not in ('r', 'w')")
            kept = kept.join(without_lock_noise(kept.select(*others.columns).unionByName(others)).select("source", "seq"), ["source", "seq"], "left_semi")
        return kept.select("source", "id", "seq", "alloc_id", "ts", F.col("action").alias("type"), "size", "address", F.col("ctx").alias("context"))

    @cached_property
    def _operations(self) -> DataFrame:
        """Lock events with the allocation they lie in, whether they may be locks at all, and the first acquisition at their place."""
        events = lock_kinds(self.events.where("action = 'l'"), not self.sequence_locks)
        at = in_live_allocation(events.select("source", "seq", "address"), self._lives, PAGE).select("source", "seq", F.col("start_seq").alias("epoch"))
        in_section = F.lit(False)
        for low, size in self.sections:
            in_section = in_section | F.col("address").between(low, low + size)
        is_static = in_section | ((F.col("lock_member") == PSEUDO_MEMBER) & F.col("address").isin(*PSEUDO_LOCKS))
        placed = events.join(at, ["source", "seq"]).withColumn("static", F.col("epoch").isNull() & F.coalesce(is_static, F.lit(False))).withColumn("usable", F.col("epoch").isNotNull() | F.col("static") | F.lit(self.all_locks))
        # A place counts from its first acquisition that may be a lock; with the epoch as part of the key a lock dies with its allocation.
        first = placed.where("usable and kind = 'P' and sides is not null").groupBy("source", "address", F.coalesce("epoch", F.lit(-1)).alias("life")).agg(F.min_by(F.struct("seq", "type", "sides", "static", "flags"), "seq").alias("first"))
        return written(placed.withColumn("life", F.coalesce("epoch", F.lit(-1))).join(first, ["source", "address", "life"], "left"), "trace-operations")

    @cached_property
    def _found(self) -> DataFrame:
        """One row for each lock, in the order of first acquisition, with the number of its first side."""
        first = self._operations.where("seq = first.seq").select("source", "address", "life", F.col("first.seq").alias("seen"), "first.type", "first.sides", "first.static", "first.flags")
        last = numbered(first, "seen", "last", F.length("sides").cast("long"))
        return written(last.withColumn("id", F.col("last") - F.length("sides") + 1).drop("last"), "trace-locks")

    @cached_property
    def _sides(self) -> DataFrame:
        # The read side has the smaller number.
        return self._found.select("*", F.posexplode(F.split("sides", "")).alias("k", "side")).where("side <> ''").withColumn("lock_id", F.col("id") + F.when((F.col("sides") == "rw") & (F.col("side") == "w"), 1).otherwise(0))

    @cached_property
    def locks(self) -> DataFrame:
        """source, id, address, embedded_in (an allocation; 0 for an unknown one where all locks are taken), lock_type_name, sub_lock, lock_var_name, flags."""
        names = variable_names(self._found.where("static"), self.variables, self.symbols)
        homes = self._lives.select("source", F.col("start_seq").alias("life"), F.col("id").alias("home"))
        found = self._sides.join(homes, ["source", "life"], "left").join(names, "address", "left")
        inside = F.when(F.col("static"), None).otherwise(F.coalesce("home", F.lit(0)))
        return found.select("source", F.col("lock_id").alias("id"), "address", inside.alias("embedded_in"), F.col("type").alias("lock_type_name"), F.col("side").alias("sub_lock"), F.when(F.col("static"), F.col("lock_var_name")).alias("lock_var_name"), "flags")

    @cached_property
    def lock_operations(self) -> DataFrame:
        """source, seq, ctx, kind, lock_id, side, recursive, file (relative to the source tree), line."""
        ids = self._sides.select("source", "address", "life", "side", "lock_id")
        kept = self._operations.where("usable and seq >= first.seq").join(ids, ["source", "address", "life", "side"])
        return kept.select("source", "seq", "ctx", "kind", "lock_id", "side", (F.col("flags").bitwiseAND(1) == 1).alias("recursive"), relative_path(F.col("file"), self.base_dir).alias("file"), "line")

    @cached_property
    def stacktraces(self) -> DataFrame:
        """source, id, instruction_ptr, stacktrace: of the accesses kept, in the order of first appearance."""
        seen = self._placed.where("inside").groupBy("source", "instruction_ptr", "stacktrace").agg(F.min("seq").alias("first"))
        return numbered(seen, "first").select("source", "id", "instruction_ptr", "stacktrace")

    @cached_property
    def rejected(self) -> DataFrame:
        """source, seq, reason of the events that no table holds, but for sequence locks."""
        kept = self._lives.select("source", F.explode(F.array_compact(F.array("start_seq", "end_seq"))).alias("seq"))
        named = self._named.join(kept.withColumn("kept", F.lit(True)), ["source", "seq"], "left").where("kept is null")
        lives = named.select("source", "seq", F.when(F.col("action") == "f", "free of an unused address").when(F.col("subclass_id").isNull(), "unknown type").otherwise("address in use").alias("reason"))
        accesses = self._placed.where("not coalesce(inside, false)").select("source", "seq", F.when(F.col("alloc_id").isNull(), "no allocation at base").otherwise("outside its allocation").alias("reason"))
        why = F.when(~F.col("usable"), "lock of unknown place").when(F.col("sides").isNull() & F.col("first").isNull(), "unknown lock type").when(F.col("first").isNull() | (F.col("seq") < F.col("first.seq")), "release of an unseen lock").when(F.instr("first.sides", F.col("side")) == 0, "side that the lock lacks")
        locks = self._operations.select("source", "seq", why.alias("reason")).where("reason is not null")
        return lives.unionByName(accesses).unionByName(locks)

    @cached_property
    def machine_events(self) -> DataFrame:
        """The lock operations and accesses as events of the exact machine, one trace for each source."""
        locks = self.lock_operations.select("source", "seq", "ctx", "kind", F.col("lock_id").alias("lock"), "side", "recursive")
        accesses = self.accesses.select("source", "seq", F.col("context").alias("ctx"), F.col("type").alias("kind"), F.lit(None).cast("long").alias("lock"), F.lit(None).cast("string").alias("side"), F.lit(False).alias("recursive"))
        return locks.unionByName(accesses).select(F.xxhash64("source").alias("trace"), "seq", "ctx", "kind", "lock", "side", "recursive")
