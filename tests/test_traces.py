"""Hand-made traces: readers, lifetimes, the exact machine, streaming."""

import pytest
from pyspark.sql import functions as F

from strandlog.operators import lifetimes
from strandlog.operators.machine import Machine, run_machine
from strandlog.sources import traces


def line(ts, action, op="", address="0", size="0", base="0", kind="", ctx="0"):
    return ";".join([str(ts), action, op, address, size, base, kind, "", "a.c", "1", "ff", "10,20,", "0", ctx])


def run(events):
    """Transactions of the accesses of (kind, lock, side) events."""
    m, out = Machine(), []
    for seq, (kind, *rest) in enumerate(events):
        lock, side = (*rest, None, None)[:2]
        found = m.step(seq, 0, kind, lock, side)
        if found:
            out.append(found)
    return out


def test_nested_transaction_resumes():
    x = run([("P", 1, "w"), ("r",), ("P", 2, "w"), ("r",), ("V", 2, "w"), ("r",), ("V", 1, "w"), ("r",)])
    assert x[0][0] == x[2][0] != x[1][0] and [l for _, l in x] == ["1", "1,2", "1", ""] and x[3][0] is None


def test_release_below_the_top_restarts():
    x = run([("P", 1, "w"), ("r",), ("P", 2, "w"), ("r",), ("V", 1, "w"), ("r",), ("V", 2, "w")])
    assert len({t for t, _ in x}) == 3 and [l for _, l in x] == ["1", "1,2", "2"]


def test_recursive_reader_is_listed_once():
    x = run([("P", 1, "r"), ("r",), ("P", 1, "r"), ("r",), ("V", 1, "r"), ("r",), ("V", 1, "r")])
    assert x[0][0] == x[2][0] != x[1][0] and [l for _, l in x] == ["1", "1", "1"]


def test_release_in_another_context_takes_the_lock(spark):
    m = Machine()
    m.step(1, 0, "P", 1, "w")
    m.step(2, 1, "V", 1, "w")
    assert m.step(3, 0, "r", None, None) == (None, "")


def test_reader_is_flushed_by_a_writer():
    assert run([("P", 1, "r"), ("P", 1, "w"), ("V", 1, "w"), ("r",)])[0] == (None, "")


@pytest.fixture
def trace_file(tmp_path):
    rows = ["ts;action;...", line(1, "a", address="1000", size="64", kind="node:ext"), line(2, "l", "1", address="1008", kind="mutex"), line(3, "w", address="1010", size="4", base="1000")]
    rows += [line(4, "l", "3", address="1008", kind="mutex"), line(5, "f", address="1000", size="32"), line(6, "f", address="1000"), line(7, "a", address="1000", size="16", kind="node"), line(8, "z"), "9;broken"]
    path = tmp_path / "trace.csv"
    path.write_text("\n".join(rows) + "\n")
    return str(path)


def test_reader_parts_events_from_the_rest(spark, trace_file):
    events, bad = traces.decoded(traces.numbered_lines(spark, trace_file))
    rows = events.orderBy("seq").collect()
    assert [r["ts"] for r in rows] == [1, 2, 3, 4, 5, 6, 7] and rows[0]["subclass"] == "ext" and rows[0]["base"] == 0x1000
    assert (rows[1]["kind"], rows[1]["side"], rows[3]["kind"]) == ("P", "w", "V")
    assert [r["value"][:1] for r in bad.orderBy("seq").collect()] == ["8", "9"]


def test_allocations_pair_with_frees(spark, trace_file):
    events, _ = traces.decoded(traces.numbered_lines(spark, trace_file))
    rows = lifetimes.paired_allocations(events).orderBy("start").collect()
    assert [(r["start"], r["end"], r["size"], r["alloc_size"]) for r in rows] == [(1, 5, 32, 64), (7, None, 16, 16)]
    inside = lifetimes.in_live_allocation(events.where("action = 'l'").select("source", "seq", "address"), lifetimes.paired_allocations(events))
    assert [r["base"] for r in inside.collect()] == [0x1000, 0x1000]


def test_allocations_that_share_a_page_are_told_apart_by_time(spark):
    events = [(1, "a", 4096, 64), (3, "f", 4096, 0), (4, "a", 4096, 16), (5, "a", 4160, 5000), (9, "f", 4160, 0), (10, "a", 4160, 8)]
    frame = spark.createDataFrame([("s", base, t, t, action, "node", None, size) for t, action, base, size in events], "source string, base long, seq long, ts long, action string, type string, subclass string, size int")
    asked = [(2, 4100), (2, 4200), (6, 4100), (6, 4130), (7, 4161), (8, 9000), (11, 4161), (11, 9000), (12, None)]
    points = spark.createDataFrame([("s", 10 * t + k % 2 + 1, x) for k, (t, x) in enumerate(asked)], "source string, seq long, address long")
    lives = lifetimes.paired_allocations(frame.withColumn("seq", F.col("seq") * 10))
    found = lifetimes.in_live_allocation(points, lives)
    assert sorted((r["seq"] // 10, r["address"], r["base"]) for r in found.where("base is not null").collect()) == [(2, 4100, 4096), (6, 4100, 4096), (7, 4161, 4160), (8, 9000, 4160), (11, 4161, 4160)]
    assert found.count() == len(asked)
    # no join compares every point of a page with every allocation that it ever had
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert joins and not any("start_seq" in x and " > " in x for x in joins)


def streamed(spark, tmp_path, batches, schema):
    """Writes a file a batch, with the query stopped and started again between them."""
    from strandlog.streaming import ingest

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = ingest.transactions(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start(str(tmp_path / "out"))
        query.processAllAvailable()
        query.stop()
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("trace", "file", "line", "txn_id", "locks").collect()))


def test_restarted_stream_equals_the_batch(spark, tmp_path):
    """Files with the same lines, stolen and leaked locks, a restart after each; what was open stays open."""
    import random

    rng, schema = random.Random(3), "trace long, file string, line long, ctx int, kind string, lock long, side string, recursive boolean"
    batches = []
    for k in range(3):
        rows = []
        for line in range(80):
            kind = rng.choice("PPVVrw")
            op = kind in "PV"
            rows.append((line % 2, f"f{k}", line // 2, rng.randrange(3), kind, rng.randrange(3) if op else None, rng.choice("rrw") if op else None, op and rng.random() < 0.5))
        batches.append(rng.sample(rows, len(rows)))
    got = streamed(spark, tmp_path, batches, schema)
    want = []
    for trace in (0, 1):
        machine = Machine()
        for seq, r in enumerate(sorted((r for rows in batches for r in rows if r[0] == trace), key=lambda r: r[1:3]), 1):
            if found := machine.step(seq, *r[3:]):
                want.append((*r[:3], *found))
    want.sort(key=lambda r: r[:3])
    key = lambda rows: [(hash(r[:3]), r[3] and (r[0], r[3]), r[4]) for r in rows]
    same_but_for_numbers(key(got), key(want))


def test_stream_of_files_numbers_lines(spark, tmp_path):
    from strandlog.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("ts;header\n" + line(5, "r", base="10") + "\n" + line(5, "w", base="20") + "\n7;bad\n")
    events, bad = ingest.trace_stream(spark, str(tmp_path / "in"))
    for name, df in (("good_lines", events), ("bad_lines", bad)):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").start()
        query.processAllAvailable()
        query.stop()
    assert [(r["seq"], r["kind"], r["ts"]) for r in spark.table("good_lines").orderBy("seq").collect()] == [(1, "r", 5), (2, "w", 5)]
    assert [r["seq"] for r in spark.table("bad_lines").collect()] == [3]


def test_text_inputs(spark, tmp_path):
    (tmp_path / "rules.csv").write_text("datatype;member;accesstype;rule;comment;origin\nnode;m0;r;EMB;x;\\N\nshort;row\n")
    assert [r["member"] for r in traces.ground_truth(spark, str(tmp_path / "rules.csv")).collect()] == ["m0"]
    (tmp_path / "a.map").write_text("00ff\n\n0100\n")
    assert sorted(map(tuple, traces.coverage_maps(spark, str(tmp_path / "a.map")).collect())) == [("a.map", "00ff"), ("a.map", "0100")]


def test_nested_layout(spark):
    from strandlog.operators.layout import expanded

    members = spark.createDataFrame(
        [("s", "a", 0, 4, "int", "scalar", 1), ("s", "in", 8, 16, "t", "struct", 2), ("s", None, 24, 8, "u", "union", 1), ("t", "x", 0, 4, "int", "scalar", 1), ("u", "p", 0, 8, "int", "scalar", 1), ("u", "q", 0, 8, "int", "scalar", 1)],
        "type string, name string, byte_offset int, size int, member_type string, kind string, count int",
    )
    rows = expanded(members, spark.createDataFrame([("s",), ("t",)], "type string")).where("type = 's'").orderBy("byte_offset").collect()
    assert [(r["name"], r["byte_offset"]) for r in rows] == [("a", 0), ("in.x", 8), ("in.x", 16), ("p-q", 24)]


def test_lcov(spark):
    from strandlog.operators.coverage import lcov_summary

    text = ["SF:/a/b.c", "FN:1,f", "FNDA:3,f", "DA:1,3", "DA:2,0", "end_of_record", "SF:/a/c.c", "DA:1,1"]
    rows = {r["name"]: r for r in lcov_summary(spark.createDataFrame([("t", k, v) for k, v in enumerate(text)], "source string, n int, value string")).collect()}
    assert (rows["/a/b.c"]["lines"], rows["/a/b.c"]["covered"], rows["/a/b.c"]["covered_functions"]) == (2, 1, 1) and rows["/a/c.c"]["functions"] == 0
    more = ["SF:/a/b.c", "FN:9,g", "LF:4", "LH:1", "FNDA:0,f", "SF:/a/b.c", "LF:2", "LH:2", "SF:/x/d.c", "DA:bad", "SF:/a/e.c"]
    lines = spark.createDataFrame([("t", k, v) for k, v in enumerate(text + more)] + [("u", 0, "DA:7,7")], "source string, n int, value string")
    shown = lambda **how: sorted(tuple(r)[:-1] for r in lcov_summary(lines, **how).collect())
    assert shown(sums=True, prefix="/a/") == [("b.c", 6, 3, 50.0, 2, 1), ("c.c", 0, 0, None, 0, 0), ("e.c", 0, 0, None, 0, 0)]
    assert shown(by_directory=True) == [("/a", 3, 2, 200 / 3, 2, 1), ("/x", 0, 0, None, 0, 0)]
    assert shown(pattern="c.c$") == [("/a/c.c", 1, 1, 100.0, 0, 0)]


def test_inlined_frames_from_ranges(spark):
    scopes = spark.createDataFrame(
        [("k", 0, 100, 0, "f", None, None), ("k", 10, 50, 1, "g", "f.c", 7), ("k", 20, 30, 2, "h", "g.c", 8), ("k", 100, 120, 0, "p", None, None), ("m", 0, 10, 0, "other", None, None)],
        "module string, low long, high long, level int, function string, call_file string, call_line int",
    )
    table = spark.createDataFrame([("k", 0, "f.c", 1), ("k", 10, "g.c", 2), ("k", 20, "h.c", 3), ("k", 30, "g.c", 4), ("k", 90, "f.c", 5)], "module string, address long, file string, line int")
    asked = spark.createDataFrame([("k", a) for a in (0, 9, 10, 25, 29, 30, 49, 50, 99, 110, 120)], "module string, instruction_ptr long")
    found = {}
    for r in lifetimes.symbols_at(asked, scopes, table, 8).orderBy("instruction_ptr", "depth").collect():
        found.setdefault(r["instruction_ptr"], []).append((r["function"], r["file"], r["line"]))
    deep = [("h", "h.c", 3), ("g", "g.c", 8), ("f", "f.c", 7)]
    assert found == {0: [("f", "f.c", 1)], 9: [("f", "f.c", 1)], 10: [("g", "g.c", 2), ("f", "f.c", 7)], 25: deep, 29: deep, 30: [("g", "g.c", 4), ("f", "f.c", 7)], 49: [("g", "g.c", 4), ("f", "f.c", 7)], 50: [("f", "g.c", 4)], 99: [("f", "f.c", 5)], 110: [("p", "f.c", 5)], 120: [(None, "f.c", 5)]}


def test_blocks_of_lines_with_fallbacks(spark):
    from strandlog.operators.coverage import blocks_of_lines, lines_of_found

    blocks = spark.createDataFrame([("a.c", 10, [("a.c", 10), ("a.c", 3), ("in/x.h", 5)]), ("a.c", 20, [("a.c", 20)]), ("b.c", 4, [("a.c", 2), ("in/x.h", 5), ("y.h", 1)])], "file string, start int, lines array<struct<file:string,line:int>>")
    hits = [("a.c", 10), ("a.c", 19), ("a.c", 3), ("a.c", 2), ("a.c", 1), ("in/x.h", 5), ("in/x.h", 6), ("y.h", 1), ("z.c", 1)]
    found = blocks_of_lines(spark.createDataFrame(hits, "file string, line int"), blocks, "^in/")
    assert {tuple(r)[:2]: tuple(r)[2:] for r in found.collect()} == {
        ("a.c", 10): ("a.c", 10, "start"), ("a.c", 19): ("a.c", 10, "floor"), ("a.c", 3): ("a.c", 10, "inside"), ("a.c", 2): ("b.c", 4, "inside"), ("a.c", 1): (None, None, None),
        ("in/x.h", 5): ("a.c", 10, "inside"), ("in/x.h", 6): (None, None, None), ("y.h", 1): (None, None, None), ("z.c", 1): (None, None, None),
    }
    assert sorted(tuple(r)[:3] for r in lines_of_found(found, blocks).collect()) == [("a.c", 3, 4), ("in/x.h", 1, 1), ("y.h", 1, 1)]


def whole(events):
    """seq, txn_id, locks of the accesses by one machine over all events."""
    machine, out = Machine(), []
    for r in events.orderBy("seq").collect():
        if found := machine.step(r["seq"], r["ctx"], r["kind"], r["lock"], r["side"], r["recursive"]):
            out.append((r["seq"], *found))
    return out


def same_but_for_numbers(found, want):
    """Equal locks, and transactions that part the accesses alike."""
    assert [(s, l) for s, _, l in found] == [(s, l) for s, _, l in want]
    assert len({(a[1], b[1]) for a, b in zip(found, want)}) == len({a[1] for a in found}) == len({b[1] for b in want})


def malformed(spark, seed, n=1500):
    """Contexts of a group share its locks; some locks are acquired by one context and released by another, or never."""
    import random

    rng, rows = random.Random(seed), []
    for seq in range(1, n):
        kind, group = rng.choice("PPVVVrw"), rng.randrange(3)
        op = kind in "PV"
        rows.append((0, 90_000 * (seq // 700) + seq, 3 * group + rng.randrange(3), kind, 10 * group + rng.randrange(2) if op else None, rng.choice("rrw") if op else None, op and group == 1 and rng.random() < 0.5))
    return spark.createDataFrame(rows, "trace long, seq long, ctx int, kind string, lock long, side string, recursive boolean")


@pytest.mark.parametrize("seed", range(3))
def test_closed_form_equals_one_machine_on_malformed_traces(spark, seed):
    events = malformed(spark, seed)
    same_but_for_numbers(sorted(map(tuple, run_machine(events).select("seq", "txn_id", "locks").collect())), whole(events))


@pytest.mark.parametrize("size", [7, 64])
def test_stolen_locks_in_blocks_equal_one_machine(spark, monkeypatch, size):
    """One read-side lock that is never flushed, with leaked acquisitions: a single stretch of many blocks."""
    import random

    from strandlog.operators import machine

    rng = random.Random(size)
    kinds = [(c, "P") for c in (0, 0, 1, 1, 2)] + [(rng.randrange(3), rng.choice("PPPVVV")) for _ in range(60 * size if size < 64 else 700)]
    rows = [(0, k, c, kind, 1, "r", True) for k, (c, kind) in enumerate(kinds, 1)]
    rows += [(0, 10_000 + k, c, "r", None, None, False) for k, c in enumerate(range(3))]
    events = spark.createDataFrame(rows, "trace long, seq long, ctx int, kind string, lock long, side string, recursive boolean")
    monkeypatch.setattr(machine.stolen_ends, "__defaults__", (size,))
    got = {(r["ctx"], r["a"]): r["e"] for r in machine.lifetimes(events)[0].collect()}
    ended, after, _ = machine.run_block([(s, c, k) for _, s, c, k, *_ in rows if k in "PV"], [])
    assert got == {(c, a): e for c, a, e in ended} | {x: None for x in after}
    same_but_for_numbers(sorted(map(tuple, run_machine(events).select("seq", "txn_id", "locks").collect())), whole(events))


def test_raw_machine_equals_one_machine(spark):
    from strandlog.plans import registry
    from strandlog.sources.events import Trace

    sf = "/root/testdata/sf0.001"
    events = registry.raw_machine_events(Trace(spark, sf))
    same_but_for_numbers(sorted(map(tuple, registry.queries()["machine_raw"](spark, sf).collect())), whole(events))


def test_locks_held_over_a_gap_have_a_row_for_each_block_with_an_access(spark):
    """Numbers that jump by thousands of blocks, as in traces put one behind the other: locks that stay open aren't repeated for the blocks between."""
    from strandlog.operators import machine

    jump, rows = 3000 * machine.WIDTH, []
    for part in range(3):
        rows += [(0, part * jump + k, k % 2, "P", 10 * part + k, "r", True) for k in range(1, 9)]
        rows += [(0, part * jump + 20 + c, c, "r", None, None, False) for c in range(2)]
        rows += [(0, part * jump + 30, 0, "V", 2, "r", True), (0, part * jump + 31, 0, "r", None, None, False)]
        rows += [(0, part * jump + machine.WIDTH + 5, 1, "w", None, None, False)]
    events = spark.createDataFrame(rows, "trace long, seq long, ctx int, kind string, lock long, side string, recursive boolean")
    acquired = machine.lifetimes(events)[0]
    held = machine.locks_held(acquired, events.where("kind in ('r', 'w')").select("trace", "ctx", "seq")).collect()
    begins = {(r[2], r[1] // machine.WIDTH) for r in rows if r[3] in "rw"}
    open_at = lambda c, b: {(r["lock"], r["a"]) for r in acquired.collect() if r["ctx"] == c and r["a"] < b * machine.WIDTH and (r["e"] is None or r["e"] >= b * machine.WIDTH)}
    assert sorted((r["ctx"], r["block"], r["lock"], r["under"]) for r in held) == sorted((c, b, lock, a) for c, b in begins for lock, a in open_at(c, b))
    same_but_for_numbers(sorted(map(tuple, machine.run_machine(events).select("seq", "txn_id", "locks").collect())), whole(events))


def test_machine_without_rows(spark):
    assert run_machine(malformed(spark, 0, 2).where("false")).count() == 0


def test_points_meet_intervals_by_nodes(spark):
    import random

    from pyspark.sql import functions as F

    from strandlog.functions.intervals import covering_nodes, points_in_intervals

    rng = random.Random(4)
    spans = [(k % 3, a := rng.randrange(-500, 100_000), rng.choice([None, a + rng.randrange(0, 10), a + rng.randrange(0, 90_000)]), k) for k in range(60)]
    at = [(rng.randrange(4), rng.randrange(-600, 110_000), k) for k in range(400)]
    points, intervals = spark.createDataFrame(at, "key int, at long, p int"), spark.createDataFrame(spans, "key int, low long, high long, i int")
    for width in (1, 16, 1 << 20):
        got = sorted((r["p"], r["i"]) for r in points_in_intervals(points, "at", intervals, "low", "high", "key", width).collect())
        assert got == sorted((p, i) for key, x, p in at for k, a, b, i in spans if k == key and a < x and (b is None or x < b))
    ranges = [(a, a + n) for a in (0, 1, 5, 1023, -7) for n in (0, 1, 2, 63, 1000, 10**12)]
    for r in spark.createDataFrame(ranges, "a long, b long").select("a", "b", covering_nodes(F.col("a"), F.col("b")).alias("n")).collect():
        blocks = sorted((x["node"] << x["level"], (x["node"] + 1) << x["level"]) for x in r["n"])
        assert blocks[0][0] == r["a"] and blocks[-1][1] == r["b"] + 1 and all(x[1] == y[0] for x, y in zip(blocks, blocks[1:]))
        assert len(blocks) <= max(1, 2 * (r["b"] - r["a"] + 1).bit_length())


def test_floor_walk(spark):
    import random

    from pyspark.sql import functions as F

    from strandlog.functions.running import floor_walk

    rng, want, count = random.Random(2), [], {0: 0, 1: 0}
    for k in range(300):
        key, up = rng.randrange(2), rng.random() < 0.45
        before = count[key]
        count[key] = before + 1 if up else max(before - 1, 0)
        want.append((k, key, up, before, count[key]))
    rows = spark.createDataFrame([x[:3] for x in want], "k long, key int, up boolean")
    for width in (1, 5, 64, 1000):
        got = floor_walk(rows, ["key"], "k", F.col("up"), "before", "after", width).select("k", "key", "up", "before", "after")
        assert sorted(map(tuple, got.collect())) == want


def shuffled_rows(spark):
    """Rows that all stages of the session have written to shuffles so far."""
    stages = spark._jsc.sc().statusStore().store().view(spark._jvm.java.lang.Class.forName("org.apache.spark.status.StageDataWrapper")).iterator()
    rows = 0
    while stages.hasNext():
        rows += stages.next().info().shuffleWriteRecords()
    return rows


def test_cuts_and_accesses_dont_meet_all_open_acquisitions(spark):
    """400 locks that are released below 400 acquisitions of another lock, with accesses in between: neither meets each of the other."""
    n = 400
    steps = [(0, "P", lock) for lock in range(2, n + 2)] + [(0, "P", 1)] * n
    for lock in range(2, n + 2):
        steps += [(0, "V", lock), (0, "r", None)]
    steps += [(0, kind, lock) for _ in range(n) for kind, lock in (("V", 1), ("w", None))]
    rows = [(0, 100 * k, c, kind, lock, "r" if lock else None, True) for k, (c, kind, lock) in enumerate(steps, 1)]
    events = spark.createDataFrame(rows, "trace long, seq long, ctx int, kind string, lock long, side string, recursive boolean")
    before = shuffled_rows(spark)
    found = sorted(map(tuple, run_machine(events).select("seq", "txn_id", "locks").collect()))
    assert shuffled_rows(spark) - before < n * n
    same_but_for_numbers(found, whole(events))


def test_blocks_of_counts_compose_as_they_run():
    """The count of each context after a block, by its clamp, for all counts before it."""
    import random

    from strandlog.operators.machine import clamped_block, counted_block

    rng = random.Random(5)
    for _ in range(300):
        n = rng.randrange(2, 5)
        counts = {c: rng.randrange(3) for c in range(n)}
        total, ctxs, acquires = sum(counts.values()), [], []
        for _ in range(rng.randrange(1, 12)):
            acquired = not total or rng.random() < 0.45
            total += 1 if acquired else -1
            ctxs.append(rng.randrange(n)), acquires.append(acquired)
        after = dict(counts)
        for (c, depth), acquired in zip(counted_block(ctxs, acquires, counts), acquires):
            after[c] = depth if acquired else depth - 1
        for asked in range(1, n):
            step, low, high = clamped_block(ctxs, acquires, sum(counts.values()), {c: k for c, k in counts.items() if c > asked}, asked)
            got = max(counts[asked] + step, low)
            assert after[asked] == (got if high is None else min(got, high))


def test_rounds_of_stolen_locks_dont_grow_with_the_trace(spark, monkeypatch):
    """Three contexts that steal one lock all the time: as many tables are written for a trace four times as long."""
    import random

    from strandlog.functions import checkpoints
    from strandlog.operators import machine

    rng, kept, names = random.Random(3), checkpoints.kept, []
    monkeypatch.setattr(checkpoints, "kept", lambda df, name: names.append(name) or kept(df, name))
    monkeypatch.setattr(machine.stolen_ends, "__defaults__", (7,))
    rows = [(0, k, rng.randrange(3), "P" if k < 8 else rng.choice("PPVV"), 1, "r", True) for k in range(1, 281)]
    written = []
    for part in (rows[:70], rows):
        names.clear()
        machine.lifetimes(spark.createDataFrame(part, "trace long, seq long, ctx int, kind string, lock long, side string, recursive boolean"))
        written.append(len(names))
    assert written[0] == written[1]
