"""Names of the trace and coverage queries, with their Spark builders and DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandlog.functions import checkpoints
from strandlog.operators import blacklists, coverage, evaluation, flat, lifetimes, machine, mining, observations, transactions, validation, violations
from strandlog.plans import oracle, oracle_lines
from strandlog.sinks.statistics import Statistics
from strandlog.sinks.tables import Tables
from strandlog.sources import documented
from strandlog.sources import lines as trace_lines
from strandlog.sources.catalog import Catalog
from strandlog.sources.coverage import Coverage
from strandlog.sources.events import Trace


def on_trace(build):
    return lambda spark, sf_dir: build(Trace(spark, sf_dir))


def mined(db, length: int = 0, least: float = 0.0):
    return mining.support(mining.hypotheses(db.combinations, length, least), mining.member_totals(db.combinations))


def over_cutoff(db):
    return mining.reported(mined(db, least=mining.Mining().cutoff))


def winners(strategy: str):
    def build(db):
        how = mining.Mining(strategy)
        found = mining.hypotheses(db.combinations, least=mining.least_share([how], db.combinations))
        return mining.winners(found, mining.member_totals(db.combinations), mining.lock_numbers(db.observed), how)

    return build


def rules(db, winners_only: bool = False):
    return mining.report_rows(over_cutoff(db), winners("lockset")(db), winners_only)


def sweep(db):
    grid = mining.strategy_grid()
    found = mining.hypotheses(db.combinations, least=mining.least_share(grid, db.combinations))
    return mining.swept(found, mining.member_totals(db.combinations), mining.lock_numbers(db.observed), grid)


TRACE = {
    "flagship_top_rules": lambda db: mining.top_rules(mined(db)),
    "acquisitions": lambda db: db.acquisitions,
    "accesses": lambda db: db.accesses.select("id", "alloc_id", "txn_id", "type", "address", "stacktrace_id"),
    "locks_held": lambda db: db.locks_held,
    "transactions": lambda db: db.txns,
    "accesses_flat": lambda db: db.accesses_flat,
    "broken_accesses": flat.broken_accesses,
    "without_atomics": lambda db: flat.without_atomics(db).select("id", "alloc_id", "txn_id", "type"),
    "ignored_accesses": flat.ignored_accesses,
    "txn_members_locks": observations.txn_members_locks,
    "txn_members_locks_wor": lambda db: observations.txn_members_locks(db, write_over_read=True),
    "txn_members_locks_subclasses": lambda db: observations.txn_members_locks(db, subclasses=True),
    "txn_members_locks_one_type": lambda db: observations.txn_members_locks(db, data_type="node"),
    "txn_members_locks_one_member": lambda db: observations.txn_members_locks(db, member="m1"),
    "stack_members_locks": observations.stack_members_locks,
    "most_accessed_types": observations.most_accessed_types,
    "txn_members": observations.txn_members,
    "lock_free_accesses": observations.lock_free_accesses,
    "lock_distribution": observations.lock_distribution,
    "callgraph_traces": observations.callgraph_traces,
    "call_edges": observations.call_edges,
    "totals": observations.totals,
    "event_histogram": observations.event_histogram,
    "context_distribution": observations.context_distribution,
    "lock_combinations": lambda db: db.combinations.withColumn("locks", F.array_join("locks", ",")),
    "member_totals": lambda db: mining.member_totals(db.combinations),
    "hypotheses": mined,
    "hypotheses_over_cutoff": over_cutoff,
    "hypotheses_to_two_locks": lambda db: mined(db, 2).select("type_name", "access", "member", "lock_set", "locks", "occurrences"),
    "hypothesis_lattice": lambda db: mining.lattice(mining.hypotheses(db.combinations)),
    "lock_numbers": lambda db: mining.lock_numbers(db.observed),
    **{f"winners_{s}": winners(s) for s in mining.STRATEGIES},
}

#: The rule that the example queries ask about: reads of node.m0 under the lock of the same object.
RULE = ("node", "m0", "r", [r"EMBSAME(node.m_lock[w])"])


def two_rules(db):
    return violations.all_counterexamples(db, [("node", "m0", "r", ["EMBSAME(node.m_lock[w])"]), ("node", "m1", "w", ["glock0:1(mutex[w])"])])


def machine_events(db):
    """The well-formed lock events and the accesses of the derived trace, as one trace of the exact machine."""
    locks = transactions.well_formed(db.events.where("kind in ('P', 'V')"))
    both = locks.select("seq", "ctx", "kind", F.col("lock_id").alias("lock")).unionByName(db.raw_accesses.select("seq", "ctx", F.col("type").alias("kind"), F.lit(None).cast("int").alias("lock")))
    return both.select(F.lit(0).cast("long").alias("trace"), "seq", "ctx", "kind", "lock", F.lit("w").alias("side"), F.lit(False).alias("recursive"))


def raw_machine_events(db):
    """All lock events, malformed ones too, with the sides of their locks; read-side locks may be acquired again."""
    locks = db.events.where("kind in ('P', 'V')").select("seq", "ctx", "kind", F.col("lock_id").alias("lock"), F.when(F.col("slot") % 2 == 1, "r").otherwise("w").alias("side"))
    accesses = db.raw_accesses.select("seq", "ctx", F.col("type").alias("kind"), F.lit(None).cast("int").alias("lock"), F.lit(None).cast("string").alias("side"))
    return locks.unionByName(accesses).select(F.lit(0).cast("long").alias("trace"), "seq", "ctx", "kind", "lock", "side", F.coalesce(F.col("side") == "r", F.lit(False)).alias("recursive"))


TRACE |= {
    "counterexamples": lambda db: violations.examples(db, *RULE),
    "examples": lambda db: violations.examples(db, *RULE, counter=False),
    "counterexamples_subclass": lambda db: violations.examples(db, "node", "m1", "w", ["EMBSAME(node:ext.m_lock[w])"], subclass="ext", other="EMBOTHER"),
    "counterexamples_by_id": lambda db: violations.examples(db, "node", "m1", "w", ["2(rcu[r])"]),
    "counterexamples_in_order": lambda db: violations.examples(db, "node", "m1", "r", ["glock0:1(mutex[w])", "EMBOTHER(node.m_lock[w])"]),
    "examples_any_order": lambda db: violations.examples(db, "node", "m1", "r", ["glock0:1(mutex[w])", "EMBOTHER(node.m_lock[w])"], in_order=False, counter=False),
    "accesses_by_lock_member_function": violations.by_lock_member_function,
    "violation_stats": lambda db: evaluation.violation_stats(two_rules(db), db.data_types.withColumnRenamed("name", "type_name")),
    "rule_check": lambda db: evaluation.rule_check(documented.rules(db.spark), mined(db)),
    "rule_check_summary": lambda db: evaluation.rule_check_summary(evaluation.rule_check(documented.rules(db.spark), mined(db))),
    "winner_check_sharpen": lambda db: evaluation.winner_check(documented.rules(db.spark), winners("sharpen")(db), mined(db)),
    "strategy_sweep": lambda db: evaluation.strategy_sweep(documented.rules(db.spark), sweep(db), mined(db)),
    "prefix_hits": lambda db: evaluation.prefix_hits(documented.rules(db.spark), mined(db)),
    "mining_stats": lambda db: evaluation.mining_stats(db, winners("sharpen")(db)),
    "protected_members": lambda db: mining.protected_members(winners("sharpen")(db)),
    "atomic_evaluation": lambda db: evaluation.atomic_evaluation(db, winners("topdown")(db)),
    "support_distribution": lambda db: evaluation.support_distribution(mining.top_rules(mined(db))),
    "accepted_share": lambda db: evaluation.accepted_share(mining.top_rules(mined(db))),
    "no_lock_ratio": lambda db: evaluation.no_lock_ratio(mined(db)),
    "support_histogram": lambda db: evaluation.support_histogram(mined(db), 10),
    "confidence_quartiles": lambda db: evaluation.confidence_quartiles(mined(db)),
    "validation": validation.violated,
    "rule_rows": rules,
    "rule_rows_of_winners": lambda db: rules(db, winners_only=True),
    "counterexamples_of_types": lambda db: violations.sliced(two_rules(db), "no"),
    "counterexample_tree": lambda db: violations.call_tree(violations.examples(db, *RULE)),
    "machine_locks": lambda db: machine.run_machine(machine_events(db)).select("seq", "locks"),
    "machine_raw": lambda db: machine.run_machine(raw_machine_events(db)).select("seq", "txn_id", "locks"),
}

COVERAGE = {
    "coverage_unique": lambda c: coverage.unique_blocks(c.maps),
    "coverage_shifted": lambda c: coverage.shifted(coverage.unique_blocks(coverage.well_formed(c.maps))),
    "coverage_union": lambda c: coverage.union(c.maps, [0, 1, 2]),
    "coverage_intersection": lambda c: coverage.intersection(c.maps, [0, 1]),
    "coverage_minus": lambda c: coverage.minus(c.maps, 0, 1),
    "coverage_subsystem": lambda c: coverage.of_subsystem(c.maps, c.maps.select("bb", F.concat(F.lit("/d"), (F.col("number") % 5).cast("string")).alias("file")), "^/d[12]"),
    "coverage_pairs": lambda c: coverage.pairwise_intersections(c.maps),
    "coverage_pairs_all": lambda c: coverage.pairwise_intersections(c.maps),
    "coverage_suite_overlaps": lambda c: coverage.suite_overlaps(c.suites),
    "coverage_series": lambda c: coverage.cumulative(c.maps, F.col("bb") < "0000000000000064"),
    "coverage_set_cover": lambda c: coverage.set_cover(c.maps),
    "coverage_bitmap": lambda c: coverage.bitmap_decoded(c.events.select(F.col("user_id").alias("map"), F.col("seq").alias("i"), F.col("k").cast("long").alias("word")), 4096),
    "coverage_after_calls": lambda c: coverage.blocks_after_calls(c.instructions),
    "coverage_walks": lambda c: coverage.covered_by_walks(c.instructions, c.instructions.where("is_pc")),
    "coverage_share": lambda c: coverage.share_covered(coverage.covered_by_walks(c.instructions, c.instructions.where("is_pc")), c.instructions),
    "coverage_block_of_line": lambda c: coverage.block_of_line(c.lines.where("covered").select("file", "line"), c.lines.where("p_partkey % 3 = 0").select("file", F.col("line").alias("start"))),
    "coverage_blocks_of_hits": lambda c: coverage.blocks_of_lines(c.hits, c.blocks, "^/fs/inc/"),
    "coverage_lines_of_hits": lambda c: coverage.lines_of_found(coverage.blocks_of_lines(c.hits, c.blocks, "^/fs/inc/"), c.blocks),
    "lcov_by_file": lambda c: coverage.lcov_summary(c.lcov, prefix="/fs/"),
    "lcov_by_directory": lambda c: coverage.lcov_summary(c.lcov, by_directory=True),
    "lcov_sums_of_files": lambda c: coverage.lcov_summary(c.lcov, sums=True, pattern="Brand#[12]"),
    "inlined_frames": lambda c: lifetimes.unrolled_stacks(c.traces, lifetimes.symbols_at(lifetimes.stack_pointers(c.traces).withColumn("module", F.lit("k")), c.scopes, c.line_table).drop("module")).withColumn("instruction_ptr", F.col("instruction_ptr").cast("long")),
    "coverage_by_file": lambda c: coverage.line_coverage(c.lines, F.col("file")),
    "coverage_by_directory": lambda c: coverage.line_coverage(c.lines, coverage.directory(F.col("file"))),
    "coverage_compose": lambda c: coverage.composed_suite(c.maps.select("map").distinct().withColumn("command", F.concat(F.lit("run "), F.col("map").cast("string"))), c.maps.where("number < 3").select("map").distinct()),
    "coverage_convert": lambda c: coverage.lines_of_blocks(c.maps, c.lines.select(F.lpad(F.lower(F.hex("p_partkey")), 16, "0").alias("bb"), "file", "line")),
    "coverage_preprocess": lambda c: coverage.preprocessed(c.maps.select(F.concat_ws("/", F.lit("runs"), (F.col("map") % 3).cast("string"), F.concat(F.col("map").cast("string"), F.lit(".map"))).alias("path"), "bb")),
    "coverage_curve_lines": lambda c: coverage.curve_points(c.maps.select(F.col("number").alias("i")).distinct(), 16, "lines"),
    "coverage_curve_hilbert": lambda c: coverage.curve_points(c.maps.select(F.col("number").alias("i")).distinct(), 16),
    "coverage_curve_spiral": lambda c: coverage.curve_points(c.maps.select(F.col("number").alias("i")).distinct(), 16, "spiral"),
}

def run_statistics(db):
    """The trace's tables are written as one batch, and counted as they are."""
    checkpoints.prepared(db.spark)
    run = Statistics(db.spark)
    always = F.lit(True)
    kinds = {"acquire": F.col("kind") == "P", "release": F.col("kind") == "V", "read": F.col("kind") == "r", "write": F.col("kind") == "w", "total": always}
    static = F.col("embedded_in").isNull()
    tables = {
        "events": run.observed(db.events, "events", **kinds),
        "locks": run.observed(db.locks, "locks", static=static, dynamic=~static, total=always),
        "accesses": run.observed(db.accesses, "accesses", total=always),
    }
    with run.timed("import", "tables"):
        Tables(db.spark, f"{db.spark.sparkContext.getCheckpointDir()}/run-{uuid.uuid4().hex}").write(tables)
    return run.counts()


TRACE["run_statistics"] = run_statistics
TRACE["hypotheses_of_chosen"] = lambda db: mining.chosen_members(mined(db), ["no"], ["m0", "w:m1"])
TRACE["read_only_ratio"] = lambda db: evaluation.read_only_ratio(documented.rules(db.spark).withColumn("comment", F.when(F.col("member") != "m2", "ro-member")), winners("bottomup")(db))


def of_top_rules(db):
    return violations.examples_of_rules(db, violations.rules_of(mining.top_rules(mined(db))))


TRACE["counterexamples_of_top_rules"] = of_top_rules
TRACE["counterexamples_of_all_rules"] = lambda db: violations.examples_of_rules(db, violations.rules_of(over_cutoff(db)))
TRACE["examples_of_all_rules_any_order"] = lambda db: violations.examples_of_rules(db, violations.rules_of(over_cutoff(db)), in_order=False, counter=False)
TRACE["counterexample_graph"] = lambda db: violations.call_graph(of_top_rules(db))


def report(db):
    """The rules are written once: they are mined for the counterexamples, and named in the headings."""
    top = checkpoints.kept(mining.top_rules(mined(db)), "report-rules")
    return violations.report_headings(violations.examples_of_rules(db, violations.rules_of(top)), top)


TRACE["counterexample_report"] = report
COVERAGE["coverage_series_beyond"] = lambda c: coverage.cumulative(c.maps, F.col("bb") < "0000000000000064", c.maps.where("map % 7 = 0").select("bb"))
COVERAGE["coverage_unknown_pcs"] = lambda c: coverage.unknown_pcs(c.instructions.where("line % 3 > 0"), c.instructions.where("is_pc"))

CATALOG = {
    "layout_flat": lambda db: db.layout_flat.select("data_type_id", "member_name_id", "byte_offset", "helper_offset"),
    "locks_embedded_flat": lambda db: db.locks_embedded_flat,
    "type_members": observations.type_members,
    "blacklisted_members": observations.blacklisted_members,
    "atomic_members": observations.atomic_members,
    "lock_addresses": observations.lock_addresses,
    "member_blacklist_added": lambda db: blacklists.with_members(db, "economy_11", "a", ["m2", "m4", "m9", "none"]),
    "function_blacklist_added": lambda db: blacklists.with_functions(db, "economy_12", "b", ["fn2"]),
    "function_blacklist_for_any": lambda db: blacklists.with_functions(db, "any", None, ["fn2", "fn4"]),
    "blacklists_expanded": lambda db: lifetimes.expanded_blacklist(rules_of_types(db), named_subclasses(db), db.member_names),
}


def named_subclasses(db):
    return db.subclasses.join(db.data_types.select(F.col("id").alias("data_type_id"), F.col("name").alias("type_name")), "data_type_id").select("id", "type_name", "name")


def rules_of_types(db):
    """Blacklist rules as text: for a type, for a subclass, for anything, and for a member that isn't known."""
    k = F.col("k")
    datatype = F.when(k % 4 == 0, F.col("type_name")).when(k % 4 == 1, F.concat("type_name", F.lit(":a"))).when(k % 4 == 2, F.concat("type_name", F.lit(":none")))
    member = F.when(k % 5 == 0, F.concat(F.lit("m"), k.cast("string"))).when(k % 5 == 1, "unknown")
    return db.parts.where("p_size = 11").select(datatype.alias("datatype"), member.alias("datatype_member"), F.concat(F.lit("fn"), (k % 50).cast("string")).alias("fn"), (k % 4).cast("int").alias("sequence"))


LINES = {
    "lines_subclasses": lambda c: c.subclasses.drop("source"),
    "lines_allocations": lambda c: c.allocations.select("id", "subclass_id", F.col("base_address").cast("long").alias("base_address"), "size", F.col("start").alias("start_ts"), F.col("end").alias("end_ts")),
    "lines_accesses": lambda c: c.accesses.select("id", "alloc_id", "ts", "type", "size", F.col("address").cast("long").alias("address"), "context"),
    "lines_locks": lambda c: c.locks.drop("source").withColumn("address", F.col("address").cast("long")),
    "lines_lock_operations": lambda c: c.lock_operations.drop("source"),
    "lines_stacktraces": lambda c: c.stacktraces.select("id", F.col("instruction_ptr").cast("long").alias("instruction_ptr"), "stacktrace"),
    "lines_rejected": lambda c: c.rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n")),
    "lines_transactions": lambda c: machine.run_machine(c.machine_events).select("seq", "txn_id", "locks"),
}


def queries():
    found = {name: on_trace(build) for name, build in TRACE.items()}
    found |= {name: lambda spark, sf_dir, build=build: build(Coverage(spark, sf_dir)) for name, build in COVERAGE.items()}
    found |= {name: lambda spark, sf_dir, build=build: build(Catalog(spark, sf_dir)) for name, build in CATALOG.items()}
    found |= {name: lambda spark, sf_dir, build=build: build(trace_lines.converted(spark, sf_dir)) for name, build in LINES.items()}
    return found


def oracle_sql():
    return oracle.SQL | oracle_lines.SQL
