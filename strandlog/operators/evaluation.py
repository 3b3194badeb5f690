"""Scoring of hypotheses and winners against documented rules, and statistics of mining and of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEMBER = ["type_name", "access", "member"]


def matches(rule: Column, locks: Column) -> Column:
    """Whether a documented rule, a regular expression, matches the whole text of a hypothesis."""
    return F.regexp_like(locks, F.concat(F.lit("^(?:"), rule, F.lit(")$")))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(100.0 * part / whole)


def rule_check(rules: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """For each documented rule (type_name, access, member, rule): best matching hypothesis' support and a colour.

    green: matched at 100 %, yellow: matched below, red: hypotheses but no match, none: nothing observed.
    """
    seen = hypotheses.select(*MEMBER, "locks", "percentage")
    joined = rules.select(*MEMBER, "rule").join(seen, MEMBER, "left")
    best = joined.groupBy(*MEMBER, "rule").agg(F.count("locks").alias("hypotheses"), F.max(F.when(matches(F.col("rule"), F.col("locks")), F.col("percentage"))).alias("percentage"))
    colour = F.when(F.col("hypotheses") == 0, "none").when(F.col("percentage").isNull(), "red").when(F.col("percentage") == 1, "green").otherwise("yellow")
    return best.withColumn("colour", colour)


def rule_check_summary(checked: DataFrame, writes_only: bool = False) -> DataFrame:
    rows = checked.where("access <> 'r'") if writes_only else checked
    n = lambda c: F.count(F.when(F.col("colour") == c, 1))
    return rows.groupBy("type_name").agg(F.count(F.lit(1)).alias("rules"), n("none").alias("no_observations"), (F.count(F.lit(1)) - n("none")).alias("observed"), n("green").alias("full"), n("yellow").alias("found"), n("red").alias("not_found"))


def winner_check(rules: DataFrame, winners: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Rules observed and matched by a winner or one of its equals, by type and in total, for reads, writes and both."""
    observed = hypotheses.select(*MEMBER).distinct()
    hit = rules.join(winners.select(*MEMBER, "locks"), MEMBER).where(matches(F.col("rule"), F.col("locks"))).select(*MEMBER, "rule").distinct().withColumn("hit", F.lit(1))
    rows = rules.select(*MEMBER, "rule").join(observed, MEMBER, "left_semi").join(hit, [*MEMBER, "rule"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    counts = rows.rollup("type_name").agg(F.count(F.lit(1)).alias("observed"), F.sum("hit").alias("matched"), F.count(F.when(F.col("access") == "r", 1)).alias("observed_r"), F.sum(F.when(F.col("access") == "r", F.col("hit")).otherwise(0)).alias("matched_r"), F.count(F.when(F.col("access") == "w", 1)).alias("observed_w"), F.sum(F.when(F.col("access") == "w", F.col("hit")).otherwise(0)).alias("matched_w"))
    return counts.select(F.coalesce("type_name", F.lit("total")).alias("type_name"), "observed", "matched", percent(F.col("matched"), F.col("observed")).alias("percentage"), "observed_r", "matched_r", "observed_w", "matched_w")


def mining_stats(db, winners: DataFrame) -> DataFrame:
    """By type: members of the layout, members observed, rules for reads and writes, and how many of them need no lock."""
    from strandlog.operators.observations import type_members

    best = winners.where("accepted = 1")
    n = lambda c: F.count(F.when(c, 1))
    r, w, free = F.col("access") == "r", F.col("access") == "w", F.col("locks") == ""
    counts = best.groupBy("type_name").agg(F.countDistinct("member").alias("observed"), n(r).alias("rules_r"), n(w).alias("rules_w"), n(r & free).alias("no_lock_r"), n(w & free).alias("no_lock_w"))
    return type_members(db, False).join(counts, "type_name", "left").fillna(0)


def violation_stats(counterexamples: DataFrame, types: DataFrame) -> DataFrame:
    """By type: violating accesses, distinct members and distinct traces; types without any have zeros."""
    each = counterexamples.select("data_type", "member", "stacktrace", F.explode(F.split("locks_held", r"\+")).alias("one"))
    counts = each.groupBy(F.col("data_type").alias("type_name")).agg(F.sum(F.element_at(F.split("one", "#"), -1).cast("long")).alias("violations"), F.countDistinct("member").alias("members"), F.countDistinct("stacktrace").alias("locations"))
    return types.select("type_name").distinct().join(counts, "type_name", "left").fillna(0)


def support_distribution(winners_with_support: DataFrame, threshold: float = 0.9) -> DataFrame:
    return winners_with_support.groupBy("access").agg(F.avg("percentage").alias("mean"), F.count(F.lit(1)).alias("members"), F.count(F.when(F.col("percentage") < threshold, 1)).alias("below"))


def accepted_share(top: DataFrame) -> DataFrame:
    """Share of members whose best rule reaches each threshold from 0 to 100 % in steps of five."""
    steps = top.withColumn("threshold", F.explode(F.sequence(F.lit(0), F.lit(100), F.lit(5))))
    return steps.groupBy("threshold").agg(F.count(F.when(100 * F.col("percentage") >= F.col("threshold"), 1)).alias("accepted"), F.count(F.lit(1)).alias("members"))


def no_lock_ratio(hypotheses: DataFrame, start: int = 50) -> DataFrame:
    """By threshold: members with any hypothesis at `start` %, and those of them with a locked one at the threshold."""
    steps = hypotheses.select(*MEMBER, "n_locks", "percentage", F.explode(F.sequence(F.lit(start), F.lit(100), F.lit(5))).alias("threshold"))
    key = F.concat_ws(".", *MEMBER)
    return steps.groupBy("threshold").agg(F.countDistinct(F.when(100 * F.col("percentage") >= start, key)).alias("members"), F.countDistinct(F.when((F.col("n_locks") > 0) & (100 * F.col("percentage") >= F.col("threshold")), key)).alias("locked"))


def support_histogram(hypotheses: DataFrame, least: int = 70) -> DataFrame:
    return hypotheses.where((F.col("n_locks") > 0) & (F.col("access") == "w") & (100 * F.col("percentage") >= least)).groupBy(F.floor(100 * F.col("percentage")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def confidence_quartiles(hypotheses: DataFrame) -> DataFrame:
    q = lambda p: F.percentile("confidence", F.lit(p))
    return hypotheses.groupBy("access").agg(F.min("confidence").alias("least"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max("confidence").alias("most"))


def atomic_evaluation(db, winners: DataFrame) -> DataFrame:
    """For members of an atomic type: whether a rule was found and whether it has locks, by access."""
    from strandlog.operators.observations import atomic_members

    best = winners.where("accepted = 1").select(*MEMBER, "locks")
    rows = atomic_members(db).select("type_name", "member").join(best, ["type_name", "member"], "left")
    n = lambda c: F.count(F.when(c, 1))
    return rows.groupBy("type_name").agg(F.countDistinct("member").alias("atomics"), n(F.col("locks").isNotNull()).alias("found"), n(F.col("locks") != "").alias("locked"), n(F.col("locks") == "").alias("not_locked"))


def strategy_sweep(rules: DataFrame, swept: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """By setting: documented rules with observations, and those that a winner or one of its equals matches."""
    observed = rules.select(*MEMBER, "rule").join(hypotheses.select(*MEMBER).distinct(), MEMBER, "left_semi")
    hit = observed.join(swept.select("setting", *MEMBER, "locks"), MEMBER).where(matches(F.col("rule"), F.col("locks"))).select("setting", *MEMBER, "rule").distinct()
    matched = hit.groupBy("setting").agg(F.count(F.lit(1)).alias("matched"))
    every = swept.select("setting").distinct().crossJoin(F.broadcast(observed.agg(F.count(F.lit(1)).alias("observed"))))  # one row
    return every.join(matched, "setting", "left").fillna(0, ["matched"]).withColumn("percentage", percent(F.col("matched"), F.col("observed")))


def prefix_hits(rules: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """By type: rules that the best hypothesis matches from its start (positive), that it doesn't (negative), and without observations."""
    best = hypotheses.groupBy(*MEMBER).agg(F.max(F.struct("occurrences", F.negative("n_locks"), "locks")).alias("b")).select(*MEMBER, F.col("b.locks").alias("locks"))
    rows = rules.select(*MEMBER, "rule").join(best, MEMBER, "left").withColumn("hit", F.regexp_like("locks", F.concat(F.lit("^(?:"), "rule", F.lit(")"))))
    n = lambda c: F.count(F.when(c, 1))
    return rows.groupBy("type_name").agg(n(F.col("hit")).alias("positive"), n(~F.col("hit")).alias("negative"), n(F.col("locks").isNull()).alias("not_found"))


def read_only_ratio(rules: DataFrame, winners: DataFrame) -> DataFrame:
    """By type: reads of members whose documentation calls them read-only, and those of them mined without a lock."""
    rows = rules.where("comment = 'ro-member' and access = 'r'").select(*MEMBER).join(winners.where("accepted = 1").select(*MEMBER, "locks"), MEMBER, "left")
    return rows.groupBy("type_name").agg(F.count(F.lit(1)).alias("read_only"), F.count(F.when(F.col("locks") == "", 1)).alias("no_lock"))
