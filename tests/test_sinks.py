"""Tables written as one, and statistics of runs."""

import pytest
from pyspark.sql import functions as F

from strandlog.sinks.statistics import Statistics
from strandlog.sinks.tables import Tables, read_text_table, write_text_tables

SCHEMA = "id long, name string"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    sink = Tables(spark, str(tmp_path / "db"))
    one, two = (spark.createDataFrame([(k, f"n{k}")], SCHEMA) for k in (1, 2))
    assert sink.done() == [] and rows(sink.read("a", SCHEMA)) == []
    assert sink.write({"a": one, "b": two}, 0) and sink.write({"a": two, "b": two}, 1)
    assert not sink.write({"a": one, "b": two}, 0)
    assert rows(sink.read("a", SCHEMA)) == [(1, "n1"), (2, "n2")] and rows(sink.read("b", SCHEMA)) == [(2, "n2")] * 2
    sink.dropped()
    assert sink.done() == []


def test_a_batch_that_fails_half_way_is_in_no_table(spark, tmp_path):
    sink = Tables(spark, str(tmp_path / "db"))
    good = spark.createDataFrame([(1, "x")], SCHEMA)
    bad = good.withColumn("name", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        sink.write({"a": good, "b": bad}, 0)
    assert rows(sink.read("a", SCHEMA)) == [] and sink.done() == []
    # moved, but not marked: the batch is replaced
    good.write.parquet(str(tmp_path / "db" / "a" / "batch=0"))
    assert rows(sink.read("a", SCHEMA)) == []
    assert sink.write({"a": good, "b": good}, 0) and rows(sink.read("a", SCHEMA)) == [(1, "x")]


def test_a_stream_writes_several_tables(spark, tmp_path):
    spark.createDataFrame([(k, f"n{k}") for k in range(6)], SCHEMA).write.parquet(str(tmp_path / "in"))
    sink = Tables(spark, str(tmp_path / "db"))
    parts = lambda df: {"even": df.where("id % 2 = 0"), "odd": df.where("id % 2 = 1")}
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = stream.writeStream.foreachBatch(lambda df, n: (sink.write(parts(df), n), sink.write(parts(df), n))[0]).option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert [r[0] for r in rows(sink.read("even", SCHEMA))] == [0, 2, 4] and [r[0] for r in rows(sink.read("odd", SCHEMA))] == [1, 3, 5]


def test_text_tables_keep_nulls_and_separators(spark, tmp_path):
    values = [(1, None), (None, "a#b"), (3, 'quo"te'), (4, "two\nlines"), (5, "\\x"), (6, "x y")]
    write_text_tables({"t": spark.createDataFrame(values, SCHEMA)}, str(tmp_path), "#")
    assert sorted(map(tuple, read_text_table(spark, str(tmp_path / "t"), SCHEMA, "#").collect()), key=str) == sorted(values, key=str)


def test_statistics_of_a_run(spark, tmp_path):
    run = Statistics(spark)
    df = run.observed(spark.range(10), "numbers", even=F.col("id") % 2 == 0, total=F.lit(True))
    with run.timed("x", "write"):
        df.write.parquet(str(tmp_path / "n"))
    with run.timed("x", "again"), run.timed("y", "none"):
        pass
    assert rows(run.counts()) == [("numbers", "even", 5), ("numbers", "total", 10)]
    found = {(r["step"], r["section"]): r["duration"] for r in run.durations().collect()}
    assert set(found) == {("x", "write"), ("x", "again"), ("y", "none"), ("x", "total"), ("y", "total"), ("total", "total")}
    assert found["x", "total"] == found["x", "write"] + found["x", "again"] <= found["total", "total"]


def test_a_limit_counts_lines(spark, tmp_path):
    from strandlog.sources.traces import decoded, numbered_lines

    line = lambda ts: ";".join([str(ts), "r", "", "0", "4", "10", "", "", "a.c", "1", "ff", "", "0", "0"])
    for name, n in (("a", 5), ("b", 2)):
        (tmp_path / name).write_text("\n".join(["header", *[line(k) for k in range(n)]]) + "\n")
    events, _ = decoded(numbered_lines(spark, str(tmp_path)), limit=4)
    assert sorted((r["source"][-1], r["ts"]) for r in events.collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)]


def note_file(order, version, functions, tail=b""):
    """A .gcno file of (name, [lines of a block: (file, line)...])."""
    import struct

    word = lambda n: struct.pack(order + "I", n)

    def text(s):
        data = s.encode() + b"\0" if s else b""
        data += b"\0" * (-len(data) % 4)
        return word(len(data) // 4) + data

    wide = version[0] >= "A"
    out = word(0x67636E6F) + struct.pack(order + "I", int.from_bytes(version.encode(), "big")) + word(7) + (text("/cwd") + word(1) if wide else b"")
    record = lambda tag, data: word(tag) + word(len(data) // 4) + data
    for k, (name, blocks) in enumerate(functions):
        out += record(0x01000000, word(k) + word(1) + word(2) + text(name) + (word(0) if wide else b"") + text("x.c") + word(3)) + record(0x01410000, word(9))
        for n, lines in enumerate(blocks):
            data, now = word(n), None
            for file, line in lines:
                data += (word(0) + text(file) if file != now else b"") + word(line)
                now = file
            out += record(0x01450000, data + word(0) + text(""))
    return out + tail


def test_note_files_come_back(spark, tmp_path):
    from strandlog.sources.gcno import basic_blocks, note_records

    functions = [("f", [[("a.c", 3), ("a.c", 4), ("in/h.h", 9)], [("a.c", 8)]]), ("gé", [[("a.c", 3), ("a.c", 5)], []])]
    (tmp_path / "sub").mkdir()
    for name, data in {
        "little.gcno": note_file("<", "A93*", functions),
        "sub/big.gcno": note_file(">", "408*", functions),
        "cut.gcno": note_file("<", "A93*", functions)[:-30],
        "long.gcno": note_file("<", "407*", functions[:1], b"\0\0\x45\x01\xff\0\0\0"),
        "other.gcno": b"not notes",
        "ignored.txt": b"x",
    }.items():
        (tmp_path / name).write_bytes(data)
    records = note_records(spark, str(tmp_path)).collect()
    of = lambda name: [(r["function"], [tuple(x) for x in r["lines"]]) for r in records if r["source"].endswith(name) and r["reason"] is None]
    want = [(f, lines) for f, blocks in functions for lines in blocks if lines]
    assert of("little.gcno") == of("big.gcno") == want and of("cut.gcno") == want[:2] and of("long.gcno") == want[:2]
    reasons = {r["source"].rsplit("/", 1)[1]: r["reason"] for r in records if r["reason"]}
    assert set(reasons) == {"cut.gcno", "long.gcno", "other.gcno"}
    blocks = basic_blocks(note_records(spark, str(tmp_path / "little.gcno")))
    assert sorted((r["file"], r["start"], [tuple(x) for x in r["lines"]]) for r in blocks.collect()) == [("a.c", 3, [("a.c", 3), ("a.c", 4), ("a.c", 5), ("in/h.h", 9)]), ("a.c", 8, [("a.c", 8)])]


def test_lock_labels():
    from strandlog.functions.labels import LockRef

    assert LockRef.parse("EMBSAME(node:ext.m.x[w])") == LockRef("same", "w", "node", "ext", "m.x")
    assert LockRef.parse("EMBOTHER(node.a[3][r])") == LockRef("other", "r", "node", None, "a[3]")
    assert [LockRef.parse(x) for x in ("EMB:12(node.m[r])", "g_l:7(mutex[w])", "2(rcu[r])")] == [LockRef("id", s, lock_id=n) for n, s in ((12, "r"), (7, "w"), (2, "r"))]
    for bad in ("", "x", "EMBSAME(node.m)", "EMBSAME(node[w])", "EMBSAME(no de.m[w])", "EMBSAME(node.m?[w])", "a-b:3(x[w])", "a:b(x[w])", "3(x[w]) ", "3(x[q])"):
        with pytest.raises(ValueError):
            LockRef.parse(bad)
