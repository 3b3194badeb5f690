"""Accesses that confirm or violate a rule, with their stack traces and the locks that were held."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.functions import checkpoints
from strandlog.functions.labels import LockRef, described_locks, joined_in_order, label, parsed


def rule_accesses(db, data_type: str, member: str, access: str, subclass: str | None = None) -> DataFrame:
    """Accesses of the given type to the given member."""
    flat = db.accesses_flat.where(F.col("ac_type") == access)
    flat = flat.join(F.broadcast(db.data_types.where(F.col("name") == data_type).select(F.col("id").alias("data_type_id"))), "data_type_id", "left_semi")
    flat = flat.join(F.broadcast(db.member_names.where(F.col("name") == member).select(F.col("id").alias("member_name_id"))), "member_name_id", "left_semi")
    return flat if subclass is None else flat.join(F.broadcast(db.subclasses.where(F.col("name") == subclass).select(F.col("id").alias("subclass_id"))), "subclass_id", "left_semi")


def candidates(db, ref: LockRef) -> DataFrame:
    """lock_id, owner: the locks that may stand for a rule's lock. A read lock is satisfied by the write side as well."""
    if ref.kind == "id":
        one = db.locks.where(F.col("id") == ref.lock_id)
        if ref.side == "r":  # both sides have ids of their own, at one address
            one = db.locks.join(one.select("address"), "address", "left_semi")
        return one.select(F.col("id").alias("lock_id"), F.lit(None).cast("int").alias("owner"))
    found = db.locks_embedded_flat.where(F.col("sub_lock").isin(["r", "w"] if ref.side == "r" else ["w"]))
    found = found.join(db.data_types.where(F.col("name") == ref.type).select(F.col("id").alias("data_type_id")), "data_type_id", "left_semi")
    found = found.join(db.member_names.where(F.col("name") == ref.member).select(F.col("id").alias("member_name_id")), "member_name_id", "left_semi")
    if ref.subclass is not None:
        found = found.join(db.subclasses.where(F.col("name") == ref.subclass).select(F.col("id").alias("subclass_id")), "subclass_id", "left_semi")
    return found.select("lock_id", F.col("alloc_id").alias("owner"))


def confirming(db, accesses: DataFrame, rule: list[str], in_order: bool) -> DataFrame:
    """ac_id of the accesses whose transaction holds all locks of the rule; in the rule's order where asked.

    Locks in other allocations must be distinct acquisitions, later ones later, whether or not the order counts.
    """
    refs = [LockRef.parse(x) for x in rule]
    good = accesses.where("txn_id is not null").select("ac_id", "txn_id", "alloc_id")
    last_other = None
    for k, ref in enumerate(refs):
        held = db.locks_held.select("txn_id", "lock_id", F.col("start").alias(f"start_{k}")).join(candidates(db, ref), "lock_id").withColumnsRenamed({"owner": f"owner_{k}"}).drop("lock_id")
        good = good.join(held, "txn_id")
        if ref.kind == "same":
            good = good.where(F.col(f"owner_{k}") == F.col("alloc_id"))
        elif ref.kind == "other":
            good = good.where(F.col(f"owner_{k}") != F.col("alloc_id"))
            if last_other is not None:
                good = good.where(F.col(f"start_{k}") > F.col(f"start_{last_other}"))
            last_other = k
        if in_order and k:
            good = good.where(F.col(f"start_{k}") > F.col(f"start_{k - 1}"))
    return good.select("ac_id").distinct()


def traces(db) -> DataFrame:
    """stacktrace_id, stacktrace: 0xIP@function@file:line of each frame, joined by commas."""
    frame = F.concat_ws("", F.lit("0x"), F.hex("instruction_ptr"), F.lit("@"), "function", F.lit("@"), "file", F.lit(":"), F.col("line").cast("string"))
    return db.stacktraces.groupBy(F.col("id").alias("stacktrace_id")).agg(joined_in_order(["sequence"], frame, ",").alias("stacktrace"))


def examples(db, data_type: str, member: str, access: str, rule: list[str], in_order: bool = True, counter: bool = True, subclass: str | None = None, other: str = "EMB") -> DataFrame:
    """data_type, member, accesstype, stacktrace_id, stacktrace, locks_held: the accesses that violate the rule, or with counter=False those that confirm it.

    locks_held lists the sequences of locks that accesses with this trace held, each with its count, the most frequent first.
    """
    accesses = rule_accesses(db, data_type, member, access, subclass)
    good = confirming(db, accesses, rule, in_order)
    chosen = accesses.join(good, "ac_id", "left_anti" if counter else "left_semi")
    name = data_type if subclass is None else f"{data_type}:{subclass}"
    return listed(db, chosen, other).select(F.lit(name).alias("data_type"), F.lit(member).alias("member"), F.lit(access).alias("accesstype"), "stacktrace_id", "stacktrace", "locks_held")


def site(other: str) -> Column:
    """A described lock as seen from alloc_id, with the place where it was taken."""
    return F.concat_ws("", label(F.col("alloc_id"), other), F.lit("@"), "last_file", F.lit(":"), F.col("last_line").cast("string"))


def listed(db, chosen: DataFrame, other: str) -> DataFrame:
    """stacktrace_id, stacktrace, locks_held of chosen accesses (ac_id, alloc_id, txn_id, stacktrace_id)."""
    each = chosen.select("ac_id", "alloc_id", "txn_id")
    held = each.join(db.locks_held, "txn_id").join(described_locks(db, True), "lock_id").groupBy("ac_id").agg(joined_in_order(["start", "lock_id"], site(other), ",").alias("locks"))
    with_locks = chosen.select("ac_id", "stacktrace_id").join(held, "ac_id", "left").select("stacktrace_id", F.coalesce("locks", F.lit("nolocks")).alias("locks"))
    return told(db, with_locks.groupBy("stacktrace_id", "locks").agg(F.count(F.lit(1)).alias("n")), [])


def told(db, counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, stacktrace_id, stacktrace, locks_held of counts (keys, stacktrace_id, locks, n)."""
    # Most frequent first, then the larger text: sorted upwards and reversed.
    texts = F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("n", "locks")))), lambda x: F.concat_ws("#", x["locks"], x["n"].cast("string"))), "+")
    return counts.groupBy(*keys, "stacktrace_id").agg(texts.alias("locks_held")).join(traces(db), "stacktrace_id")


RULE = "type_name string, member string, access string, locks array<string>"


def rule_parts(rules: DataFrame) -> DataFrame:
    """rule, k (from 0), and the parts of each lock of the rules. `rules` has rule and locks."""
    return rules.select("rule", F.posexplode("locks").alias("k", "lock")).select("rule", "k", parsed(F.col("lock")).alias("p")).select("rule", "k", "p.*")


def unread_rules(rules: DataFrame) -> DataFrame:
    """Rules with a lock that isn't a label, or has no exact place: no access can be held against them."""
    read = F.forall("locks", lambda x: parsed(x)["kind"].isNotNull())
    return rules.where(~read)


def stand_ins(db, parts: DataFrame) -> DataFrame:
    """rule, k, kind, lock_id, owner: the locks that may stand for each part, as `candidates` has them for one."""
    sides = parts.withColumn("sub_lock", F.explode(F.when(F.col("side") == "r", F.array(F.lit("r"), F.lit("w"))).otherwise(F.array(F.lit("w")))))
    by_name = sides.where("kind <> 'id'").drop("lock_id").join(db.data_types.select(F.col("id").alias("data_type_id"), F.col("name").alias("type")), "type").join(db.member_names.select(F.col("id").alias("member_name_id"), F.col("name").alias("member")), "member")
    names = db.subclasses.select(F.col("id").alias("subclass_id"), F.col("name").alias("of"))
    found = by_name.join(db.locks_embedded_flat, ["data_type_id", "member_name_id", "sub_lock"]).join(names, "subclass_id").where(F.col("subclass").isNull() | (F.col("subclass") == F.col("of")))
    embedded = found.select("rule", "k", "kind", "lock_id", F.col("alloc_id").alias("owner"))
    # A read lock is satisfied by both sides, which have ids of their own at one address.
    named = parts.where("kind = 'id'").join(db.locks.select(F.col("id").alias("named"), "address"), F.col("named") == F.col("lock_id")).drop("lock_id")
    locks = db.locks.select(F.col("id").alias("lock_id"), "address")
    by_id = named.join(locks, "address").where((F.col("side") == "r") | (F.col("lock_id") == F.col("named")))
    return embedded.unionByName(by_id.select("rule", "k", "kind", "lock_id", F.lit(None).cast("int").alias("owner")))


def situations(db) -> tuple[DataFrame, DataFrame]:
    """What decides about accesses, told once: an allocation and the locks held in the order of their acquisition.

    situation, alloc_id, held: `held` has rank (from 1, the same for locks taken at one time), lock_id, last_file, last_line, and is empty where nothing is held.
    situation, ac_type, data_type_id, member_name_id, subclass_id, stacktrace_id, n: accesses by their situation.
    """
    rank = F.dense_rank().over(Window.partitionBy("txn_id").orderBy("start"))
    held = db.locks_held.withColumn("rank", rank).groupBy("txn_id").agg(F.array_sort(F.collect_list(F.struct("rank", "lock_id", "last_file", "last_line"))).alias("held"))
    kind = ["alloc_id", "ac_type", "data_type_id", "member_name_id", "subclass_id", "stacktrace_id"]
    none = F.array().cast(held.schema["held"].dataType)
    flat = db.accesses_flat.select("txn_id", *kind)
    # Accesses without locks aren't joined: they would have one key.
    inside = flat.where("txn_id is not null").join(held, "txn_id", "left").select(*kind, F.coalesce("held", none).alias("held"))
    every = inside.unionByName(flat.where("txn_id is null").select(*kind, none.alias("held")))
    counts = checkpoints.kept(every.groupBy(*kind, "held").agg(F.count(F.lit(1)).alias("n")), "violations-accesses")
    found = checkpoints.kept(counts.select("alloc_id", "held").distinct().withColumn("situation", F.monotonically_increasing_id()), "violations-situations")
    return found, counts.join(found, ["alloc_id", "held"]).drop("alloc_id", "held")


def examples_of_rules(db, rules: DataFrame, in_order: bool = True, counter: bool = True, other: str = "EMB") -> DataFrame:
    """What `examples` gives for one rule, for a table of them, with the rule's locks as `rule`: one plan, whatever the number of rules.

    `rules` has type_name (type or type:subclass), member, access and locks (labels in the rule's order); repeated ones count once. Rules that `unread_rules` names have no rows, those
    without locks are confirmed by every access. An access meets the locks that its transaction holds in the order of their acquisition and takes each that is next in the rule; taking the
    earliest never closes a way. Where the order doesn't count it holds for locks in other allocations alone, and the rest must only be there. Accesses of one situation are decided once, and counted.
    """
    own = rules.select(*[f.split()[0] for f in RULE.split(", ")]).distinct()
    rules = checkpoints.kept(own.where(F.forall("locks", lambda x: parsed(x)["kind"].isNotNull())).withColumn("rule", F.monotonically_increasing_id()), "violations-rules")
    parts = rule_parts(rules)
    # The place of a part in the sequence that must grow; null where it only has to be there.
    place = F.col("k") if in_order else F.when(F.col("kind") == "other", F.count(F.when(F.col("kind") == "other", 1)).over(Window.partitionBy("rule").orderBy("k")) - 1)
    parts = parts.withColumn("place", place.cast("int"))
    needs = parts.groupBy("rule").agg(F.count("place").alias("steps"), F.count(F.when(F.col("place").isNull(), 1)).alias("others"))
    data_type, subclass = F.substring_index("type_name", ":", 1), F.when(F.instr("type_name", ":") > 0, F.expr("substring(type_name, instr(type_name, ':') + 1)"))
    asked = rules.select("rule", data_type.alias("t"), subclass.alias("s"), F.col("member").alias("m"), F.col("access").alias("ac_type"))
    asked = asked.join(db.data_types.select(F.col("id").alias("data_type_id"), F.col("name").alias("t")), "t").join(db.member_names.select(F.col("id").alias("member_name_id"), F.col("name").alias("m")), "m")
    names = db.subclasses.select(F.col("id").alias("subclass_id"), F.col("name").alias("of"))
    where_, counts = situations(db)
    accesses = counts.join(asked, ["ac_type", "data_type_id", "member_name_id"]).join(names, "subclass_id").where(F.col("s").isNull() | (F.col("s") == F.col("of"))).select("rule", "situation", "stacktrace_id", "n")
    may = stand_ins(db, parts).join(parts.select("rule", "k", "place"), ["rule", "k"])
    owned = F.when(F.col("kind") == "same", F.col("owner") == F.col("alloc_id")).when(F.col("kind") == "other", F.col("owner") != F.col("alloc_id")).otherwise(True)
    locks = where_.select("situation", "alloc_id", F.inline("held"))
    met = accesses.select("rule", "situation").distinct().join(locks, "situation").join(may, ["rule", "lock_id"]).where(owned)
    step = lambda acc, x: F.when((x["place"] == acc["next"]) & (x["rank"] > acc["last"]), F.struct((acc["next"] + 1).alias("next"), x["rank"].alias("last"))).otherwise(acc)
    taken = F.aggregate(F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("rank", "place")))), F.struct(F.lit(0).alias("next"), F.lit(0).alias("last")), step)
    walked = met.groupBy("rule", "situation").agg(taken["next"].alias("taken"), F.count_distinct(F.when(F.col("place").isNull(), F.col("k"))).alias("there"))
    good = walked.join(needs, "rule").where("taken = steps and there = others").select("rule", "situation")
    without = rules.where(F.size("locks") == 0).select("rule")
    if counter:
        chosen = accesses.join(good, ["rule", "situation"], "left_anti").join(without, "rule", "left_anti")
    else:
        chosen = accesses.join(good, ["rule", "situation"], "left_semi").unionByName(accesses.join(without, "rule", "left_semi"))
    texts = locks.join(described_locks(db, True), "lock_id").groupBy("situation").agg(joined_in_order(["rank", "lock_id"], site(other), ",").alias("locks"))
    each = chosen.join(texts, "situation", "left").groupBy("rule", "stacktrace_id", F.coalesce("locks", F.lit("nolocks")).alias("locks")).agg(F.sum("n").alias("n"))
    names = rules.select("rule", F.col("type_name").alias("data_type"), "member", F.col("access").alias("accesstype"), F.array_join("locks", " -> ").alias("locks"))
    return told(db, each, ["rule"]).join(names, "rule").select("data_type", "member", "accesstype", F.col("locks").alias("rule"), "stacktrace_id", "stacktrace", "locks_held")


def all_counterexamples(db, rules: list[tuple[str, str, str, list[str]]], in_order: bool = True) -> DataFrame:
    """Counterexamples of several rules (type, member, access, locks)."""
    return examples_of_rules(db, db.spark.createDataFrame(rules, RULE), in_order).drop("rule")


def rules_of(supported: DataFrame) -> DataFrame:
    """Hypotheses with locks (texts joined by arrows), as a table of rules."""
    return supported.where("locks <> ''").select("type_name", "member", "access", F.split("locks", " -> ").alias("locks"))


def by_lock_member_function(db, data_type: str | None = None, member: str | None = None) -> DataFrame:
    """Accesses by type, member, marked trace and locks, with flags.

    hidden: a write in the same transaction and allocation goes along with a read; flatten: an access of the same kind does. A lock's place is
    never marked as inside a member here.
    """
    from strandlog.operators.flat import with_members

    members = db.member_names.select(F.col("id").alias("member_name_id"), F.col("name").alias("sl_member"))
    names = db.subclasses.select(F.col("id").alias("subclass_id"), "name").join(db.subclasses.select(F.col("id").alias("subclass_id"), "data_type_id"), "subclass_id").join(db.data_types.select(F.col("id").alias("data_type_id"), F.col("name").alias("plain_type")), "data_type_id")
    names = names.select("subclass_id", F.concat_ws(":", "plain_type", "name").alias("dt_name"), "plain_type")
    found = with_members(db).join(members, "member_name_id", "left").join(names, "subclass_id")
    if data_type:
        found = found.where(F.col("plain_type") == data_type)
    if member:
        found = found.where(F.col("sl_member") == member)
    found = found.select("ac_id", "txn_id", "alloc_id", "ac_type", "sl_member", "dt_name", "stacktrace_id", "subclass_id", "member_name_id")
    rules = db.function_blacklist.select(F.col("fn").alias("function"), F.col("subclass_id").alias("bl_subclass"), F.col("member_name_id").alias("bl_member"), F.col("sequence").alias("bl_sequence"), F.lit(1).alias("fn_bl"))
    holds = (F.col("bl_subclass").isNull() & F.col("bl_member").isNull()) | ((F.col("bl_subclass") == F.col("subclass_id")) & (F.col("bl_member").isNull() | (F.col("bl_member") == F.col("member_name_id"))))
    frames = db.stacktraces.select(F.col("id").alias("stacktrace_id"), "sequence", "instruction_ptr", "function", "file", "line")
    # The trace depends on the stack, the subclass and the member alone, so it is built once for each of these.
    kinds = found.select("stacktrace_id", "subclass_id", "member_name_id").distinct()
    marked = kinds.join(frames, "stacktrace_id").alias("x").join(rules.alias("r"), (F.col("x.function") == F.col("r.function")) & holds & (F.col("bl_sequence").isNull() | (F.col("bl_sequence") == F.col("sequence"))), "left").drop(F.col("r.function"))
    marked = marked.join(db.member_blacklist.withColumn("m_bl", F.lit(1)), ["subclass_id", "member_name_id"], "left")
    text = F.concat_ws("", F.lower(F.hex("instruction_ptr")), F.lit("@"), "function", F.lit("@"), "file", F.lit(":"), F.col("line").cast("string"), F.lit("@m_bl:"), F.coalesce("m_bl", F.lit(0)).cast("string"), F.lit("@fn_bl:"), F.coalesce("fn_bl", F.lit(0)).cast("string"))
    trace = marked.groupBy("stacktrace_id", "subclass_id", "member_name_id").agg(joined_in_order(["sequence", "fn_bl"], text, ",").alias("stacktrace"))
    # Whether another flat access of a transaction and allocation reads or writes: from counts, less the access itself.
    flat = db.accesses_flat
    parallel = flat.where("txn_id is not null").groupBy("txn_id", "alloc_id").agg(F.sum((F.col("ac_type") == "r").cast("int")).alias("reads"), F.sum((F.col("ac_type") == "w").cast("int")).alias("writes"))
    own = flat.select("ac_id", F.lit(1).alias("own")).distinct()
    flagged = found.join(parallel, ["txn_id", "alloc_id"], "left").join(own, "ac_id", "left")
    other_reads = F.coalesce("reads", F.lit(0)) - F.when(F.col("ac_type") == "r", F.coalesce("own", F.lit(0))).otherwise(0)
    other_writes = F.coalesce("writes", F.lit(0)) - F.when(F.col("ac_type") == "w", F.coalesce("own", F.lit(0))).otherwise(0)
    flagged = flagged.withColumn("hidden", (F.col("ac_type") == "r") & (other_writes > 0)).withColumn("flatten", F.when(F.col("ac_type") == "r", other_reads > 0).otherwise(other_writes > 0))
    plain = described_locks(db, True).withColumn("place", F.regexp_replace("place", r"\?\[", "["))
    site = F.concat_ws("", label(F.col("alloc_id")), F.lit("@"), "last_file", F.lit(":"), F.col("last_line").cast("string"))
    held = found.select("ac_id", "alloc_id", "txn_id").where("txn_id is not null").join(db.locks_held, "txn_id").join(plain, "lock_id").groupBy("ac_id").agg(joined_in_order(["start", "lock_id"], site, " -> ").alias("locks"))
    same_member = (F.col("f.member_name_id").eqNullSafe(F.col("t.member_name_id"))) & (F.col("f.stacktrace_id") == F.col("t.stacktrace_id")) & (F.col("f.subclass_id") == F.col("t.subclass_id"))
    full = flagged.alias("f").join(trace.alias("t"), same_member).select("ac_id", "dt_name", "sl_member", "ac_type", "stacktrace", "hidden", "flatten").join(held, "ac_id", "left")
    return full.groupBy("dt_name", "sl_member", "ac_type", "stacktrace", F.coalesce("locks", F.lit("nolocks")).alias("locks_held")).agg(F.count(F.lit(1)).alias("total"), F.bool_or("hidden").alias("hidden_access"), F.bool_or("flatten").alias("flatten_accesses"))


def sliced(found: DataFrame, prefix: str) -> DataFrame:
    """Counterexamples of the types that a pattern matches from their start."""
    return found.where(F.col("data_type").rlike(f"^(?:{prefix})"))


def call_tree(found: DataFrame) -> DataFrame:
    """path (frames from the outermost on), parent (empty below the root), depth, locks, n: the locks held at the accesses that end in a node, null and 0 on the way there.

    `found` are examples or counterexamples: stacktrace with the innermost frame first, locks_held as texts with their counts.
    """
    way = lambda n: F.array_join(F.slice("frames", 1, n), " > ")
    rows = found.select(F.reverse(F.split("stacktrace", ",")).alias("frames"), F.explode(F.split("locks_held", r"\+")).alias("held"))
    steps = rows.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size("frames"))))
    ends = F.col("depth") == F.size("frames")
    nodes = steps.select(way(F.col("depth")).alias("path"), way(F.col("depth") - 1).alias("parent"), "depth", F.when(ends, F.regexp_replace("held", "#[0-9]+$", "")).alias("locks"), F.when(ends, F.regexp_extract("held", "#([0-9]+)$", 1).cast("long")).otherwise(0).alias("k"))
    return nodes.groupBy("path", "parent", "depth", "locks").agg(F.sum("k").alias("n"))


HYPOTHESIS = ["data_type", "member", "accesstype"]

#: Fixed value: a tree with more leaves is shown as a graph.
LEAVES = 7


def frame_steps(found: DataFrame) -> DataFrame:
    """The frames of each example from the outermost on (frames), and each of its texts of held locks with their count (locks, n). A trace of one frame has no call, and no row."""
    rows = found.select(*HYPOTHESIS, F.reverse(F.split("stacktrace", ",")).alias("frames"), F.explode(F.split("locks_held", r"\+")).alias("held")).where(F.size("frames") > 1)
    return rows.select(*HYPOTHESIS, "frames", F.regexp_replace("held", "#[0-9]+$", "").alias("locks"), F.regexp_extract("held", "#([0-9]+)$", 1).cast("long").alias("n"))


def called_at(frame: Column) -> Column:
    """Function and line of a frame, which make it a node."""
    return F.concat_ws("_", F.get(F.split(frame, "@"), F.lit(1)), F.substring_index(frame, ":", -1))


def call_graph(found: DataFrame) -> DataFrame:
    """Nodes and edges of each hypothesis's counterexamples, as edges: caller (empty for the entry from outside), callee, locks, n.

    An edge has a row, with null locks and 0, and the innermost frame of accesses one for each text of locks that were held there, with the sum of its counts: null as its caller.
    `found` is written once, as it is read twice.
    """
    found = checkpoints.kept(found, "violations-found")
    steps = frame_steps(found).withColumn("nodes", F.transform("frames", called_at))
    pairs = F.transform(F.sequence(F.lit(1), F.size("nodes")), lambda i: F.struct(F.when(i == 1, "").otherwise(F.get("nodes", i - 2)).alias("caller"), F.get("nodes", i - 1).alias("callee")))
    edges = steps.select(*HYPOTHESIS, "nodes").distinct().select(*HYPOTHESIS, F.explode(pairs).alias("e")).select(*HYPOTHESIS, "e.*").distinct()
    leaves = steps.groupBy(*HYPOTHESIS, F.element_at("nodes", -1).alias("callee"), "locks").agg(F.sum("n").alias("n"))
    none = F.lit(None).cast("string")
    return edges.select(*HYPOTHESIS, "caller", "callee", none.alias("locks"), F.lit(0).cast("long").alias("n")).unionByName(leaves.select(*HYPOTHESIS, none.alias("caller"), "callee", "locks", "n"))


def report_headings(found: DataFrame, rules: DataFrame) -> DataFrame:
    """A row for each hypothesis with counterexamples: the rule's locks, occurrences, total and percentage, the counterexamples' traces and accesses, leaves of their tree, and the form they are shown in.

    `rules` has a rule for each type_name, access and member; hypotheses without one are left out. A leaf is a way from the outermost frame to an access with none on the way there.
    `found` is written once, as it is read four times.
    """
    found = checkpoints.kept(found, "violations-found")
    ways = frame_steps(found).select(*HYPOTHESIS, F.transform("frames", called_at).alias("way")).distinct()
    shorter = F.transform(F.sequence(F.lit(1), F.size("way") - 1), lambda n: F.slice("way", F.lit(1), n))
    beyond = ways.select(*HYPOTHESIS, "way", F.explode(shorter).alias("short")).join(ways.withColumnRenamed("way", "short"), [*HYPOTHESIS, "short"], "left_semi")
    leaves = ways.join(beyond, [*HYPOTHESIS, "way"], "left_anti").groupBy(*HYPOTHESIS).agg(F.count(F.lit(1)).alias("leaves"))
    traces_ = found.groupBy(*HYPOTHESIS).agg(F.count_distinct("stacktrace").alias("traces"), F.sum(F.aggregate(F.transform(F.split("locks_held", r"\+"), lambda x: F.regexp_extract(x, "#([0-9]+)$", 1).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)).alias("violations"))
    rule = rules.select(F.col("type_name").alias("data_type"), "member", F.col("access").alias("accesstype"), F.col("locks").alias("rule"), "occurrences", "total", (100 * F.col("percentage")).alias("percentage"))
    rows = rule.join(traces_, HYPOTHESIS).join(leaves, HYPOTHESIS, "left").withColumn("leaves", F.coalesce("leaves", F.lit(0)))
    return rows.withColumn("form", F.when(F.col("leaves") > LEAVES, "graph").otherwise("tree"))
