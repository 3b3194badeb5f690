"""Trace lines to tables, the smaller readers, and rendering."""

import struct
import zlib

from pyspark.sql import functions as F

from strandlog.functions import render
from strandlog.operators import conversion
from strandlog.sources import lines as trace_lines
from strandlog.sources import traces

from .test_traces import line, same_but_for_numbers, whole

SF = "/root/testdata/sf0.001"


def converted(spark, rows, types=("node",), **more):
    text = spark.createDataFrame([("t", k, v) for k, v in enumerate(rows)], "source string, seq long, value string")
    events, _ = traces.decoded(text)
    variables = spark.createDataFrame([], "position int, address long, size int, name string")
    symbols = spark.createDataFrame([], "address long, name string")
    return conversion.Converted(events, spark.createDataFrame([(t,) for t in types], "type_name string"), [], variables, symbols, "/src", **more)


def test_transactions_of_lines_equal_one_machine(spark):
    from strandlog.operators.machine import run_machine

    events = trace_lines.converted(spark, SF).machine_events
    same_but_for_numbers(sorted(map(tuple, run_machine(events).select("seq", "txn_id", "locks").collect())), whole(events))


def test_lock_dies_with_its_allocation_and_sides_are_numbered(spark):
    rows = [line(1, "a", address="1000", size="64", kind="node"), line(2, "l", "3", address="1008", kind="rw_semaphore"), line(3, "l", "1", address="1008", kind="rw_semaphore")]
    rows += [line(4, "f", address="1000", size="64"), line(5, "a", address="1000", size="64", kind="node"), line(6, "l", "0", address="1008", kind="rw_semaphore"), line(7, "l", "0", address="9000", kind="mutex")]
    c = converted(spark, rows)
    found = [(r["id"], r["embedded_in"], r["sub_lock"]) for r in c.locks.orderBy("id").collect()]
    assert found == [(1, 1, "r"), (2, 1, "w"), (3, 2, "r"), (4, 2, "w")]
    assert [(r["seq"], r["lock_id"]) for r in c.lock_operations.orderBy("seq").collect()] == [(2, 2), (5, 3)]
    assert sorted((r["seq"], r["reason"]) for r in c.rejected.collect()) == [(1, "release of an unseen lock"), (6, "lock of unknown place")]


def test_all_locks_take_those_of_unknown_place(spark):
    c = converted(spark, [line(1, "l", "1", address="9000", kind="mutex")], all_locks=True)
    assert [(r["id"], r["embedded_in"]) for r in c.locks.collect()] == [(1, 0)]


def test_subclass_after_a_type_without_one_clashes(spark):
    rows = [line(1, "a", address="1000", size="8", kind="node"), line(2, "a", address="2000", size="8", kind="node:x"), line(3, "a", address="3000", size="8", kind="what:x"), line(4, "a", address="4000", size="8", kind="what:y")]
    c = converted(spark, rows)
    assert [(r["id"], r["name"]) for r in c.subclasses.orderBy("id").collect()] == [(1, None), (2, "x")]
    assert [r["name"] for r in c.clashes.collect()] == ["x"]
    assert [(r["id"], r["subclass_id"]) for r in c.allocations.orderBy("id").collect()] == [(1, 1), (2, 2), (3, 2)]
    assert [r["reason"] for r in c.rejected.collect()] == ["unknown type"]


def test_noise_at_locks_goes_only_when_asked(spark):
    at = {"address": "1008", "size": "4", "base": "1000"}
    rows = [line(1, "a", address="1000", size="64", kind="node"), line(2, "r", **at), line(2, "w", **at), line(3, "l", "1", address="1008", kind="mutex"), line(4, "r", **at), line(5, "w", **at), line(6, "l", "3", address="1008", kind="mutex"), line(7, "r", **at)]
    assert [r["id"] for r in converted(spark, rows).accesses.orderBy("id").collect()] == [1, 2, 3, 4, 5]
    assert [r["id"] for r in converted(spark, rows, drop_noise=True).accesses.orderBy("id").collect()] == [3, 4, 5]


def test_empty_trace(spark):
    c = converted(spark, ["ts;header"])
    assert [x.count() for x in (c.subclasses, c.allocations, c.accesses, c.locks, c.lock_operations, c.stacktraces, c.rejected)] == [0] * 7


def test_paths_are_cut_by_the_folders_length(spark):
    paths = spark.createDataFrame([("/src/k/a.c",), ("x/src/k/a.c",), ("a.c",), (None,)], "p string")
    assert [r[0] for r in paths.select(conversion.relative_path(F.col("p"), "/src/k")).collect()] == ["a.c", "/a.c", "a.c", None]


def test_lists_and_tables_of_text(spark, tmp_path):
    (tmp_path / "types").write_text("node\nbuf\n")
    assert sorted(map(tuple, traces.type_list(spark, str(tmp_path / "types")).collect())) == [(1, "node"), (2, "buf")]
    (tmp_path / "t.tsv").write_text("type\tm\tl\tn\nnode\tr:a,w:b\tx,y\t12\nnode\tr:a\t\t3\nbad\t1\n")
    assert sorted(map(tuple, traces.observations_tsv(spark, str(tmp_path / "t.tsv")).collect())) == [("node", "r:a", "", 3), ("node", "r:a,w:b", "x,y", 12)]
    head = "type;member;accesstype;locks;conflictlist;occurrences;total;percentage;accepted;confidence;parameters\n"
    (tmp_path / "h.csv").write_text(head + "node;a;r;x;;5;9;55.5;1;0.1;p\nnode;a;r;x;;6;9;66.6;1;0.1;q\n")
    assert [(r["occurrences"], r["parameters"]) for r in traces.hypotheses_csv(spark, str(tmp_path / "h.csv")).collect()] == [(5, "p")]


def test_disassembly(spark):
    from strandlog.operators.coverage import disassembled

    pad = lambda a, m: f"{a}:".ljust(32) + m
    rows = ["", "section .text:", pad("c1000000", "push   %ebp"), pad("c1000001", "nopw   0x0"), pad("c1000002", "calll  c10"), pad("c1000007", "ret"), pad("c1000008", "x")[:32]]
    found = disassembled(spark.createDataFrame([("o", k, v) for k, v in enumerate(rows)], "source string, seq long, value string"))
    assert [(r["address"], r["number"], r["is_jump"]) for r in found.orderBy("number").collect()] == [("c1000000", 0, False), ("c1000002", 1, True), ("c1000007", 2, True)]


def test_rendering():
    assert render.euler_input([("a&b", 1), ("b", 3), ("a", 2)]) == "c(\n'a' = 2,\n'b' = 3,\n'a&b' = 1\n)\n"
    png = render.png_image(2, [(1, 0, (255, 0, 0))])
    at = png.index(b"IDAT")
    body = zlib.decompress(png[at + 4 : at + 4 + struct.unpack(">I", png[at - 4 : at])[0]])
    assert body == b"\0\xff\xff\xff\xff\0\0" + b"\0" + b"\xff" * 6
    assert render.dot_graph([("a", "b", 2)]) == 'digraph calls {\n  "a" -> "b" [label="2"];\n}\n'
    assert "! " in render.rule_report([("node", "m0", "r", "x", 9, 10, 1)]) and "<td>&lt;</td>" in render.table_page(["a"], [("<",)])
    assert "<li>f</li><li>g</li>" in render.counterexample_page("t", [("g,f", "x#2")])
