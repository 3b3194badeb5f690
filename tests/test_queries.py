"""Every registered trace and coverage query against its DuckDB twin."""

import duckdb
import pytest

from strandlog.plans import registry

from .compare import connection, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"
ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", [n for n in registry.queries() if n in ORACLE])
def test_equals_its_twin(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    names, rows = duck_rows(duck, ORACLE[name])
    assert sorted(df.columns) == names
    assert spark_rows(df) == rows


def test_pairs_of_all_maps_are_brute_forces(spark):
    from strandlog.sources.coverage import Coverage

    sf = "/root/testdata/sf0.01"
    blocks = {}
    for r in Coverage(spark, sf).maps.select("map", "bb").collect():
        blocks.setdefault(r["map"], set()).add(r["bb"])
    want = {(a, b): len(blocks[a] & blocks[b]) for a in blocks for b in blocks if a != b and blocks[a] & blocks[b]}
    assert any(a >= 20 for a, _ in want)
    rows = registry.queries()["coverage_pairs"](spark, sf).collect()
    assert len(rows) == len(want) and {(r["map_a"], r["map_b"]): r["n"] for r in rows} == want


def test_pairs_of_a_block_that_many_maps_share(spark):
    from strandlog.operators.coverage import pairwise_intersections

    maps = spark.createDataFrame([(m, bb) for m in range(150) for bb in ("a", "b")] + [(0, "c"), (149, "c"), (7, None), (8, None)], "map long, bb string")
    found = {(r["map_a"], r["map_b"]): r["n"] for r in pairwise_intersections(maps).collect()}
    assert found == {(a, b): 3 if {a, b} == {0, 149} else 2 for a in range(150) for b in range(150) if a != b}


def test_set_cover_takes_all_blocks(spark):
    rows = registry.queries()["coverage_set_cover"](spark, SF).orderBy("step").collect()
    gains = [r["gain"] for r in rows]
    assert gains == sorted(gains, reverse=True)
    assert rows[-1]["total"] == registry.queries()["coverage_unique"](spark, SF).select("bb").distinct().count()


def test_curves_place_cells_once_and_next_to_each_other(spark):
    from strandlog.operators.coverage import curve_points

    for curve in ("hilbert", "spiral"):
        at = {r["i"]: (r["x"], r["y"]) for r in curve_points(spark.range(225).withColumnRenamed("id", "i"), 16, curve).collect()}
        assert len(set(at.values())) == 225
        assert all(abs(at[i][0] - at[i + 1][0]) + abs(at[i][1] - at[i + 1][1]) == 1 for i in range(224))


def test_winners_follow_their_strategy(spark):
    from strandlog.operators.mining import Mining, searched

    orders = {(): {(): 100}, (1,): {(1,): 97}, (2,): {(2,): 60}, (1, 2): {(1, 2): 50, (2, 1): 9}}
    assert searched(orders, 100, 97, Mining("sharpen")) == [(1,)]
    assert searched(orders, 100, 97, Mining("bottomup")) == [(1,)]
    assert searched(orders, 100, 97, Mining("lockset")) == [()]
    assert searched(orders, 100, 97, Mining("topdown")) == [(1,)]
    assert searched(orders, 100, 90, Mining("topdown")) == [()]
    assert searched({(): {(): 9}, (1,): {(1,): 9}, (2,): {(2,): 9}}, 9, 9, Mining("lockset")) == [(1,), (2,)]
    # {1, 3} isn't a parent of {1, 2, 3}, which is reached through {1, 2} and {2, 3}.
    chain = {(): {(): 9}, (1,): {(1,): 9}, (2,): {(2,): 1}, (3,): {(3,): 1}, (1, 3): {(1, 3): 1}, (1, 2): {(1, 2): 9}, (1, 2, 3): {(1, 2, 3): 9}}
    assert searched(chain, 9, 9, Mining("sharpen")) == [(1, 2, 3)]


def observed_locks(spark, rows):
    schema = "type_name string, access string, member string, locks array<string>, occurrences long"
    return spark.createDataFrame([("t", "r", m, locks, n) for m, locks, n in rows], schema)


def subsets_by_hand(rows, least, length):
    from collections import Counter
    from itertools import combinations

    orders, totals = Counter(), Counter()
    for m, locks, n in rows:
        totals[m] += n
        first = list(dict.fromkeys(locks))
        for k in range(min(len(first), length or 99) + 1):
            for s in combinations(first, k):
                orders[m, s] += n
    sets = Counter()
    for (m, s), n in orders.items():
        sets[m, tuple(sorted(s))] += n
    return {(m, s): n for (m, s), n in orders.items() if sets[m, tuple(sorted(s))] / totals[m] >= least}


@pytest.mark.parametrize("least,length", [(0.0, 0), (0.0, 2), (0.1, 0), (0.3, 2), (0.6, 0), (1.0, 0)])
def test_subsets_by_masks_and_by_levels(spark, least, length):
    import random

    from strandlog.operators.mining import hypotheses

    rng = random.Random(7)
    rows = [(f"m{k % 3}", rng.sample("abcdefghijkl", rng.randrange(13 if k == 1 else 6)) + (["a"] if k % 4 == 0 else []), rng.randrange(1, 30)) for k in range(40)] + [("m0", [], 5)]
    got = {(r["member"], tuple(r["locks"])): r["occurrences"] for r in hypotheses(observed_locks(spark, rows), length, least).collect()}
    assert got == subsets_by_hand(rows, least, length)


def test_forty_locks_in_one_observation(spark):
    from strandlog.operators.mining import hypotheses

    many = [f"l{k:02}" for k in range(40)]
    rows = [("m", many, 9), ("m", ["l01", "l03"], 60), ("m", ["l03", "l01"], 31)]
    got = {tuple(r["locks"]): r["occurrences"] for r in hypotheses(observed_locks(spark, rows), least=0.1).collect()}
    assert got == {(): 100, ("l01",): 100, ("l03",): 100, ("l01", "l03"): 69, ("l03", "l01"): 31}


def test_lazy_cover_picks_as_a_plain_one(spark):
    import random

    from strandlog.operators import coverage

    rng = random.Random(11)
    blocks = {m: set(rng.sample(range(120), rng.choice([3, 3, 8, 20]))) for m in range(60)}
    left, want = {m: set(b) for m, b in blocks.items()}, []
    while any(left.values()):
        m = max(left, key=lambda m: (len(left[m]), -m))
        want.append((m, len(left[m])))
        gone = set(left[m])
        left = {k: b - gone for k, b in left.items()}
    maps = spark.createDataFrame([(m, f"{b:03}") for m, bs in blocks.items() for b in bs], "map long, bb string")
    calls = []
    plain = coverage.picked
    coverage.picked = lambda *a: calls.append(1) or plain(*a)
    try:
        got = [(r["map"], r["gain"]) for r in coverage.set_cover(maps).orderBy("step").collect()]
    finally:
        coverage.picked = plain
    assert got == want and len(calls) < len(want) / 2
    assert [r["map"] for r in coverage.set_cover(maps, most=3).collect()] == [m for m, _ in want[:3]]


@pytest.mark.parametrize("words,part", [(16, 1024), (1, 7), (2, 40)])
def test_pairs_by_small_bitmaps(spark, words, part):
    import random

    from strandlog.operators import coverage

    rng = random.Random(3)
    blocks = {f"m{m}": set(rng.sample(range(500), rng.choice([0, 1, 9, 200]))) for m in range(50)}
    maps = spark.createDataFrame([(m, str(b)) for m, bs in blocks.items() for b in bs for _ in range(1 + b % 2)], "map string, bb string")
    found = {(r["map_a"], r["map_b"]): r["n"] for r in coverage.pairwise_intersections(maps, words, part).collect()}
    assert found == {(a, b): len(x & y) for a, x in blocks.items() for b, y in blocks.items() if a != b and x & y}
    assert coverage.pairwise_intersections(maps.where("false")).collect() == []


def test_labels_as_columns_are_read_as_by_the_parser(spark):
    from pyspark.sql import functions as F

    from strandlog.functions.labels import LockRef, parsed

    texts = ["EMBSAME(node.m_lock[w])", "EMBOTHER(node:ext.m_lock[r])", "EMBSAME(node.m_lock?[w])", "glock0:1(mutex[w])", "2(rcu[r])", "2(rcu[x])", "x(rcu[r])", "EMB:4(node.m[w])", "EMBSAME(node[w])", "EMBSAME(no-de.m[w])", "", "(", "a:b:3(m[w])", "EMBOTHER(a.b.c[w])", "17(odd[name[w])", "EMBSAME(a:.b[r])", ":3(m[w])"]
    got = {r["t"]: r["p"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", parsed(F.col("t")).alias("p")).collect()}
    for t in texts:
        try:
            want = LockRef.parse(t)
        except ValueError:
            assert got[t]["kind"] is None, t
            continue
        assert tuple(got[t][c] for c in ("kind", "side", "type", "subclass", "member", "lock_id")) == (want.kind, want.side, want.type, want.subclass, want.member, want.lock_id), t


def test_a_table_of_rules_is_as_rule_by_rule(spark):
    from strandlog.operators import violations
    from strandlog.sources.events import Trace

    db = Trace(spark, SF)
    rules = [("node", "m0", "r", ["EMBSAME(node.m_lock[w])"]), ("node:ext", "m1", "w", ["EMBSAME(node:ext.m_lock[w])"]), ("node", "m1", "r", ["glock0:1(mutex[w])", "EMBOTHER(node.m_lock[w])"])]
    odd = [rules[0], ("node", "m1", "w", []), ("node", "m1", "w", ["EMBSAME(node.m_lock?[w])"]), ("none", "m1", "w", ["1(mutex[w])"])]
    table = spark.createDataFrame(rules + odd, violations.RULE)
    assert [r["locks"] for r in violations.unread_rules(table).collect()] == [["EMBSAME(node.m_lock?[w])"]]
    for in_order, counter in ((True, True), (False, False)):
        got = violations.examples_of_rules(db, table, in_order, counter)
        want = [(*r, " -> ".join(locks)) for t, m, a, locks in rules for r in violations.examples(db, t.partition(":")[0], m, a, locks, in_order, counter, t.partition(":")[2] or None).collect()]
        of_none = 0 if counter else db.accesses_flat.where("ac_type = 'w' and data_type_id = 1 and member_name_id = 2").select("stacktrace_id").distinct().count()
        rows = got.select("data_type", "member", "accesstype", "stacktrace_id", "stacktrace", "locks_held", "rule").collect()
        assert sorted(tuple(r) for r in rows if r["rule"]) == sorted(want) and len(want) > 3
        assert sum(not r["rule"] for r in rows) == of_none


def test_accesses_of_one_situation_are_decided_once(spark):
    from pyspark.sql import functions as F

    from strandlog.operators import violations
    from strandlog.sources.events import Trace

    db = Trace(spark, SF)
    found, counts = violations.situations(db)
    assert counts.agg(F.sum("n")).first()[0] == db.accesses_flat.count()
    rows = [(r["alloc_id"], tuple(map(tuple, r["held"]))) for r in found.collect()]
    assert len(rows) == len(set(rows)) < db.accesses_flat.count()
    assert any(len(held) > 1 for _, held in rows) and all([x[0] for x in held] == list(range(1, len(held) + 1)) for _, held in rows)


def test_examples_are_made_once_for_a_report_and_a_graph(spark):
    from pyspark.sql import functions as F

    from strandlog.operators import violations

    frame = lambda name: f"0x1@{name}@{name}.c:7"
    found = spark.createDataFrame([("t", "m", "r", ",".join(map(frame, x)), "l#2") for x in ("ba", "ca", "dba")], "data_type string, member string, accesstype string, stacktrace string, locks_held string")
    rules = spark.createDataFrame([("t", "m", "r", "l", 3, 4, 0.75)], "type_name string, member string, access string, locks string, occurrences long, total long, percentage double")
    for read in (lambda x: violations.report_headings(x, rules), violations.call_graph):
        made = spark.sparkContext.accumulator(0)
        mark = F.udf(lambda x: (made.add(1), x)[1], "string").asNondeterministic()
        assert read(found.withColumn("stacktrace", mark("stacktrace"))).count() > 0
        assert made.value == 3


def test_leaves_and_nodes_of_a_report(spark):
    from strandlog.operators import violations

    f = lambda name: f"0x1@{name}@{name}.c:7"
    traces = [("c", "b", "a"), ("d", "c", "b", "a"), ("e", "a"), ("a",), *[(f"x{k}", "y") for k in range(6)]]
    rows = [("t", "m", "r", ",".join(map(f, t)), "l#2+nolocks#1") for t in traces] + [("u", "m", "w", f("a"), "l#1"), ("v", "m", "w", f("a"), "l#1")]
    found = spark.createDataFrame(rows, "data_type string, member string, accesstype string, stacktrace string, locks_held string")
    rules = spark.createDataFrame([("t", "m", "r", "l", 3, 4, 0.75), ("u", "m", "w", "l", 1, 2, 0.5)], "type_name string, member string, access string, locks string, occurrences long, total long, percentage double")
    got = {r["data_type"]: (r["traces"], r["violations"], r["leaves"], r["form"], r["percentage"]) for r in violations.report_headings(found, rules).collect()}
    # d is called below c, which has accesses of its own: the way ends there.
    assert got == {"t": (10, 30, 8, "graph", 75.0), "u": (1, 1, 0, "tree", 50.0)}
    edges = {(r["caller"], r["callee"], r["locks"], r["n"]) for r in violations.call_graph(found).collect()}
    assert {("", "a_7", None, 0), ("a_7", "b_7", None, 0), ("c_7", "d_7", None, 0), (None, "c_7", "l", 2), (None, "c_7", "nolocks", 1)} <= edges and not any(e[0] is None and e[1] == "a_7" for e in edges)


def test_pairs_of_maps_by_parts_send_nothing_by_way_of_the_driver(spark):
    from strandlog.operators import coverage

    maps = [(f"m{m}", f"b{b}") for m in range(40) for b in range(300) if (m * 7 + b * b) % 5 < m % 4]
    found = coverage.pairwise_intersections(spark.createDataFrame(maps, "map string, bb string"), words=1, part=8)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    blocks = {}
    for m, b in maps:
        blocks.setdefault(m, set()).add(b)
    want = {(a, b): len(blocks[a] & blocks[b]) for a in blocks for b in blocks if a != b and blocks[a] & blocks[b]}
    assert {(r["map_a"], r["map_b"]): r["n"] for r in found.collect()} == want


def test_bitmaps_are_sent_in_proportion_to_the_maps(spark):
    """Four times the maps: some four times the rows that move, not sixteen times; and the pairs are whole."""
    from strandlog.operators import coverage

    from .test_traces import shuffled_rows

    sent = []
    for n in (120, 480):
        blocks = {m: {(m * k * k + 3 * k) % 97 for k in range(m % 9)} for m in range(n)}
        maps = spark.createDataFrame([(m, str(b)) for m, bs in blocks.items() for b in bs], "map long, bb string")
        before = shuffled_rows(spark)
        found = {(r["map_a"], r["map_b"]): r["n"] for r in coverage.pairwise_intersections(maps, part=4).collect()}
        sent.append(shuffled_rows(spark) - before)
        assert found == {(a, b): len(x & y) for a, x in blocks.items() for b, y in blocks.items() if a != b and x & y}
    assert sent[1] < 6 * sent[0]


def test_pairs_of_two_parts_go_out_tile_by_tile(monkeypatch):
    import pyarrow as pa

    from strandlog.operators import coverage

    monkeypatch.setattr(coverage, "PAIRS", 5)
    rows = [(m, 0, p, 1 << p | 1 << m, m % 2, g, alone) for g, alone, own in ((0, True, (0,)), (1, False, (0, 1)), (2, False, (1,))) for m in range(20) if m % 2 in own for p in range(1 + m % 3)]
    kinds = [("map", pa.int64()), ("bucket", pa.int64()), ("piece", pa.int32()), ("w0", pa.int64()), ("own", pa.int32()), ("group", pa.int64()), ("alone", pa.bool_())]
    whole = pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*rows), kinds)], [n for n, _ in kinds])
    read = []
    batches = (read.append(k) or whole.slice(k, 7) for k in range(0, whole.num_rows, 7))
    out = coverage.paired(batches, 3)
    found = [next(out)]
    assert len(read) < len(range(0, whole.num_rows, 7))
    found += list(out)
    assert max(x.num_rows for x in found) <= 5
    got = sorted(r for x in found for r in zip(*x.to_pydict().values()))
    bits = {m: {(p, b) for p in range(1 + m % 3) for b in (p, m)} for m in range(20)}
    assert got == sorted((a, b, len(bits[a] & bits[b])) for a in bits for b in bits if a != b and (a % 2 == 0 or b % 2 == 0) and bits[a] & bits[b])


def test_catalog_with_offsets_beyond_a_megabyte(spark, tmp_path):
    con = duckdb.connect()
    for t, rows in {
        "part": "SELECT 40000 * i AS p_partkey, 'Brand#1' || i % 2 AS p_brand, 'ECONOMY' AS p_type, (i * 7)::INT AS p_size FROM range(1, 9) t(i)",
        "supplier": "SELECT i AS s_suppkey FROM range(1, 5) t(i)",
        "lineitem": "SELECT i % 4 + 1 AS l_suppkey, 40000 * (i % 8 + 1) AS l_partkey FROM range(64) t(i)",
    }.items():
        con.execute(f"COPY ({rows}) TO '{tmp_path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    for name in ("layout_flat", "locks_embedded_flat"):
        rows = spark_rows(registry.queries()[name](spark, str(tmp_path)))
        assert rows and rows == duck_rows(con, registry.oracle_sql()[name])[1]
