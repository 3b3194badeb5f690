"""Mining of locking rules: hypotheses with support by order, winners under four strategies, and report rows.

The hypotheses of a member are the subsets of the lock sets observed with it, and an observation supports all subsets of its own
locks; so support is a sum over subsets, without comparing hypotheses with observations. All subsets are made as rows, by masks; where
only those over a share are asked for, they are grown lock by lock, and what falls short is never extended.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.functions import checkpoints


@dataclass(frozen=True)
class Mining:
    strategy: str = "sharpen"
    accept: float = 0.9
    no_lock: float = 0.05
    reduction: float = 0.05
    cutoff: float = 0.1
    confidence: float = 50.0
    #: Greatest number of locks of a hypothesis; 0 for any.
    length: int = 0


MEMBER = ["type_name", "access", "member"]


def combinations(observed: DataFrame) -> DataFrame:
    """type_name, access, member, locks (array in order), occurrences; one row for each member and lock sequence."""
    one = observed.select("type_name", F.explode(F.split("members_accessed", ",")).alias("m"), F.when(F.col("locks_held") == "", F.array().cast("array<string>")).otherwise(F.split("locks_held", ",")).alias("locks"), "occurrences")
    return one.select("type_name", F.substring("m", 1, 1).alias("access"), F.expr("substring(m, 3)").alias("member"), "locks", "occurrences").groupBy(*MEMBER, "locks").agg(F.sum("occurrences").alias("occurrences"))


def chosen_members(found: DataFrame, types: list[str] = (), members: list[str] = ()) -> DataFrame:
    """Rows of types with one of the prefixes, and of members named plainly or as access:member."""
    if types:
        any_type = F.lit(False)
        for t in types:
            any_type = any_type | F.col("type_name").startswith(t)
        found = found.where(any_type)
    return found.where(F.col("member").isin(list(members)) | F.concat_ws(":", "access", "member").isin(list(members))) if members else found


def member_totals(combos: DataFrame) -> DataFrame:
    return combos.groupBy(*MEMBER).agg(F.sum("occurrences").alias("total"), F.sum(F.when(F.size("locks") > 0, F.col("occurrences")).otherwise(0)).alias("with_locks"), F.count(F.lit(1)).alias("combinations"))


#: Locks whose subsets one array of masks stands for.
LOW_BITS = 10


def every_subset(combos: DataFrame, length: int) -> DataFrame:
    """The subsets of each combination's locks, in their order, as rows: by masks of two halves, so that no row holds all of them."""
    n = F.size("locks")
    masks = lambda bits: F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)
    low = combos.select("*", F.explode(masks(F.least(n, F.lit(LOW_BITS)))).alias("low"))
    both = low.select("*", F.explode(masks(F.greatest(n - LOW_BITS, F.lit(0)))).alias("high")).withColumn("mask", F.shiftleft("high", LOW_BITS).bitwiseOR(F.col("low")))
    kept = both.where(F.bit_count("mask") <= length) if length else both
    return kept.withColumn("locks", F.filter("locks", lambda x, i: F.call_function("shiftright", F.col("mask"), i).bitwiseAND(1) == 1)).drop("low", "high", "mask")


def frequent_subsets(combos: DataFrame, least: float, length: int) -> DataFrame:
    """The subsets that at least a share `least` of their member's observations hold, with each combination that holds them: one lock more a level.

    A row is a set and a combination. `rest` are the locks that may still be added: larger ones than the set's, whose addition to the set without its
    last lock reached the share. They are counted within tasks first; a set without enough of them ends there, whatever its combinations hold. A level is written, as
    the next one reads it twice, and the sets of the largest size end the loop.
    """
    totals = combos.groupBy(*MEMBER).agg(F.sum("occurrences").alias("total"))
    now = combos.select(*MEMBER, F.array().cast("array<string>").alias("set"), F.array_sort("locks").alias("rest"), "locks", "occurrences")
    now, levels = checkpoints.kept(now, "mining-level"), []
    while True:
        levels.append(now)
        if length and len(levels) > length:
            break
        counts = now.select(*MEMBER, "set", F.explode("rest").alias("lock"), "occurrences").groupBy(*MEMBER, "set", "lock").agg(F.sum("occurrences").alias("n"))
        enough = counts.join(totals, MEMBER).where(F.col("n") / F.col("total") >= least)
        more = enough.groupBy(*MEMBER, "set").agg(F.collect_set("lock").alias("more"))
        grown = now.join(more, [*MEMBER, "set"]).withColumn("rest", F.array_sort(F.array_intersect("rest", "more"))).where(F.size("rest") > 0)
        grown = grown.select("*", F.explode("rest").alias("lock")).select(*MEMBER, F.array_append("set", F.col("lock")).alias("set"), F.filter("rest", lambda x: x > F.col("lock")).alias("rest"), "locks", "occurrences")
        now = checkpoints.kept(grown, "mining-level")
        if now.isEmpty():
            break
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found.select(*MEMBER, F.filter("locks", lambda x: F.array_contains("set", x)).alias("locks"), "occurrences")


def hypotheses(combos: DataFrame, length: int = 0, least: float = 0.0) -> DataFrame:
    """type_name, access, member, lock_set (sorted), locks (in order of first acquisition), occurrences of that order.

    `length` bounds the locks of a hypothesis (0: any); with `least` only sets that reach this share of their member's observations are made.
    """
    first = combos.withColumn("locks", F.array_distinct("locks"))
    subsets = frequent_subsets(first, least, length) if least > 0 else every_subset(first, length)
    return subsets.groupBy(*MEMBER, "locks").agg(F.sum("occurrences").alias("occurrences")).withColumn("lock_set", F.array_sort("locks"))


def least_share(grid: list[Mining], combos: DataFrame) -> float:
    """A share of a member's observations that no set falls short of which a search with one of the settings could take.

    A winner starts from all observations and either reaches the accepted share, or, by sharpen, loses at most the reduction with each lock more.
    """
    most = combos.agg(F.max(F.size(F.array_distinct("locks")))).first()[0] or 0
    # a little less, as a share may be rounded
    return 0.999_999 * min((1.0 - how.reduction) ** most if how.strategy == "sharpen" else 1.0 if how.strategy == "lockset" else how.accept for how in grid)


def support(found: DataFrame, totals: DataFrame, how: Mining = Mining()) -> DataFrame:
    """Hypotheses with the support of their set and order, and confidence."""
    sets = found.groupBy(*MEMBER, "lock_set").agg(F.sum("occurrences").alias("set_occurrences"))
    x = F.least(F.col("occurrences") / how.confidence, F.lit(1.0))
    steps = x * x * (3 - 2 * x)
    both = found.join(sets, [*MEMBER, "lock_set"]).join(totals.select(*MEMBER, "total"), MEMBER)
    percentage = F.col("occurrences") / F.col("total")
    return both.select(*MEMBER, F.array_join("lock_set", " + ").alias("lock_set"), F.array_join("locks", " -> ").alias("locks"), F.size("locks").alias("n_locks"), "set_occurrences", "occurrences", "total", percentage.alias("percentage"), (percentage * steps).alias("confidence"))


def reported(supported: DataFrame, how: Mining = Mining()) -> DataFrame:
    """Hypotheses whose set reaches the cutoff."""
    return supported.where(F.col("set_occurrences") / F.col("total") >= how.cutoff)


def top_rules(supported: DataFrame) -> DataFrame:
    """For each member the hypothesis with locks that has the most support; more locks win ties, then the smaller text."""
    best = supported.where("n_locks > 0").groupBy(*MEMBER, "total").agg(F.min(F.struct(F.negative("occurrences").alias("o"), F.negative("n_locks").alias("k"), "locks")).alias("best"))
    return best.select(*MEMBER, "best.locks", (-F.col("best.o")).alias("occurrences"), "total", (-F.col("best.o") / F.col("total")).alias("percentage"))


def lattice(found: DataFrame) -> DataFrame:
    """Edges from a set to one with one lock more: where the smaller set is the larger one without its first or last lock, in the locks' numbering."""
    numbered = found.select(*MEMBER, F.col("lock_set")).distinct()
    child = numbered.where(F.size("lock_set") > 0).select(*MEMBER, F.col("lock_set").alias("child"), F.explode(F.array_distinct(F.array(F.expr("slice(lock_set, 1, size(lock_set) - 1)"), F.expr("slice(lock_set, 2, size(lock_set) - 1)")))).alias("parent"))
    return child.select(*MEMBER, F.array_join("parent", " + ").alias("parent"), F.array_join("child", " + ").alias("child"))


def lock_numbers(observed: DataFrame) -> DataFrame:
    """lock, number: in the order in which the observations, by type, occurrences, members and locks, first show them."""
    first = observed.where("locks_held != ''").select(F.struct("type_id", "occurrences", "members_accessed", "locks_held").alias("row"), F.posexplode(F.split("locks_held", ",")).alias("pos", "lock"))
    seen = first.groupBy("lock").agg(F.min(F.struct("row", "pos")).alias("at"))
    from pyspark.sql import Window

    return seen.select("lock", F.row_number().over(Window.orderBy("at")).alias("number"))


# A strategy says of a node whether it equals the winner so far ("same"), beats it ("better"), or neither.
Verdict = Callable[[int, float, int, float, Mining], str | None]


def bottomup(size: int, s: float, best_size: int, best: float, how: Mining) -> str | None:
    if size == best_size and s == best:
        return "same"
    return "better" if how.accept <= s < best or size > best_size and s == best else None


def sharpen(size: int, s: float, best_size: int, best: float, how: Mining) -> str | None:
    if size == best_size:
        return "same" if s == best else "better" if s > best else None
    return "better" if size > best_size and (s == best or 1.0 - s / best <= how.reduction) else None


def lockset(size: int, s: float, best_size: int, best: float, how: Mining) -> str | None:
    if s < 1.0:
        return None
    return "same" if size == best_size else "better" if size > best_size else None


def topdown(size: int, s: float, best_size: int, best: float, how: Mining) -> str | None:
    if size == best_size and s == best:
        return "same"
    return "better" if s >= how.accept and s >= best and size >= best_size else None


STRATEGIES: dict[str, Verdict] = {"bottomup": bottomup, "sharpen": sharpen, "lockset": lockset, "topdown": topdown}


def searched(orders: dict[tuple[int, ...], dict[tuple[int, ...], int]], total: int, with_locks: int, how: Mining) -> list[tuple[int, ...]]:
    """Winner and its equals, as orders of lock numbers; the first is the winner, an empty list stands for no winner.

    Breadth first from the empty set, along edges to sets that the parent is a prefix or suffix of; only nodes that equal or beat
    the winner are opened. A node's representative is its most frequent order, the smallest of equals.
    """
    children: dict[tuple, list[tuple]] = {}
    for node in sorted(orders):
        for parent in {node[:-1], node[1:]} if node else ():
            children.setdefault(parent, []).append(node)
    judge, found = STRATEGIES[how.strategy], [()]
    best_size, best = 0, 1.0
    if how.strategy == "topdown":
        if (total - with_locks) / total >= how.no_lock:
            return [()]
        best, found = 0.0, []
    queue = deque(children.get((), ()))
    while queue:
        node = queue.popleft()
        order = min(orders[node], key=lambda o: (-orders[node][o], o))
        s = orders[node][order] / total
        verdict = judge(len(node), s, best_size, best, how)
        if verdict == "same" and found:
            if order not in found:
                found.append(order)
        elif verdict:
            found, best_size, best = [order], len(node), s
        else:
            continue
        queue.extend(children.get(node, ()))
    return found


def swept(found: DataFrame, totals: DataFrame, numbers: DataFrame, grid: list[Mining]) -> DataFrame:
    """setting (place in the grid), type_name, access, member, locks, accepted (1 winner, 2 equal to it), conflicts (the others, joined by commas).

    All settings of a member are searched in one pass over its hypotheses.
    """
    import pandas as pd

    schema = "setting int, type_name string, access string, member string, locks string, accepted int, conflicts string"
    # The numbers of all locks: a dimension as small as the set of labels, joined by each hypothesis's locks.
    flat = found.select(*MEMBER, "locks", "occurrences", F.posexplode_outer("locks").alias("pos", "lock")).join(numbers, "lock", "left")
    numbered = flat.groupBy(*MEMBER, "locks", "occurrences").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "number"))), lambda x: x["number"]).alias("order"))
    # A set is judged by its most frequent order, the smallest of equals: Python sees one row a set.
    best = numbered.withColumn("set", F.array_sort("order")).groupBy(*MEMBER, "set").agg(F.min(F.struct(F.negative("occurrences").alias("fewer"), "order", "locks")).alias("best"))
    full = best.select(*MEMBER, "best.locks", "best.order", F.negative("best.fewer").alias("occurrences")).join(totals.select(*MEMBER, "total", "with_locks"), MEMBER)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        orders, text = {}, {}
        for locks, order, n in zip(pdf["locks"], pdf["order"], pdf["occurrences"]):
            o = tuple(int(x) for x in order if x == x and x is not None)
            orders.setdefault(tuple(sorted(o)), {})[o] = int(n)
            text[o] = " -> ".join(locks)
        first, rows = pdf.iloc[0], []
        for setting, how in enumerate(grid):
            best = searched(orders, int(first["total"]), int(first["with_locks"]), how)
            rows += [(setting, *first[MEMBER], text.get(o, ""), 1 if k == 0 else 2, ",".join(text.get(x, "") for x in best if x != o)) for k, o in enumerate(best)]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return full.groupBy(*MEMBER).applyInPandas(search, schema)


def winners(found: DataFrame, totals: DataFrame, numbers: DataFrame, how: Mining = Mining()) -> DataFrame:
    """type_name, access, member, locks, accepted, conflicts under one setting."""
    return swept(found, totals, numbers, [how]).drop("setting")


def strategy_grid() -> list[Mining]:
    """sharpen with a reduction of 10 down to 0 %, bottomup and topdown accepting 100 down to 90 % in half steps, lockset once."""
    steps = [100 - k / 2 for k in range(21)]
    return [*[Mining("sharpen", reduction=k / 100) for k in range(10, -1, -1)], *[Mining(s, accept=x / 100) for s in ("bottomup", "topdown") for x in steps], Mining("lockset")]


def protected_members(won: DataFrame) -> DataFrame:
    """For documentation: the members that each winning rule of a type protects."""
    return won.where("accepted = 1").groupBy("type_name", "locks").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "access", "member"))), ",").alias("members"))


NO_LOCKS = "(no locks held)"


def report_rows(supported: DataFrame, won: DataFrame, winners_only: bool = False) -> DataFrame:
    """Rule tables: type, member, accesstype, locks, conflictlist, occurrences, total, percentage, accepted (1 winner, 2 its equal, else 0), confidence, parameters.

    The winner's row lists its equals; `parameters` are what a search for counterexamples of the rule takes, empty where there are none.
    """
    both = supported.join(won, [*MEMBER, "locks"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(0)))
    quoted = F.array_join(F.transform(F.split("locks", " -> "), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), " ")
    asked = F.concat_ws(" ", "type_name", F.concat_ws(":", "access", "member"), F.lit("CEX SEQ"), F.when(F.col("locks") == "", F.lit(NO_LOCKS)).otherwise(quoted))
    rows = both.select(
        F.col("type_name").alias("type"),
        "member",
        F.col("access").alias("accesstype"),
        F.when(F.col("locks") == "", NO_LOCKS).otherwise(F.col("locks")).alias("locks"),
        F.when(F.col("accepted") == 1, F.col("conflicts")).otherwise("").alias("conflictlist"),
        "occurrences",
        "total",
        (100 * F.col("percentage")).alias("percentage"),
        "accepted",
        "confidence",
        F.when(F.col("occurrences") < F.col("total"), asked).otherwise("").alias("parameters"),
    )
    return rows.where("accepted = 1") if winners_only else rows
