"""Coverage inputs derived from the test tables: maps and instructions from `events`, source lines from `part` and `lineitem`."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Coverage:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
        return self.table("events").select((F.col("event_id") + 1).alias("seq"), "user_id", "event_type", k.alias("k"))

    @cached_property
    def maps(self) -> DataFrame:
        """map, number, bb (16 hexadecimal digits), t."""
        number = (7 * F.col("k") + F.col("user_id")) % 211
        return self.events.select(F.col("user_id").alias("map"), number.alias("number"), F.lpad(F.lower(F.hex(number)), 16, "0").alias("bb"), F.col("seq").alias("t"))

    @cached_property
    def suites(self) -> DataFrame:
        return self.maps.where("number % 4 <> map % 4").select(F.concat(F.lit("s"), (F.col("map") % 4).cast("string")).alias("suite"), "bb").distinct()

    @cached_property
    def instructions(self) -> DataFrame:
        return self.events.select((F.col("user_id") % 4).alias("part"), F.col("seq").alias("addr"), (F.col("event_type") == "signup").alias("is_call"), (F.col("event_type") == "error").alias("is_stop"), F.concat(F.lit("/f"), (F.col("user_id") % 10).cast("string"), F.lit(".c")).alias("file"), F.col("k").alias("line"), (F.col("k") % 10 == 0).alias("is_pc"))

    @cached_property
    def lines(self) -> DataFrame:
        """part key, file, line, covered."""
        used = self.table("lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("covered", F.lit(True))
        return self.table("part").join(used, "p_partkey", "left").select("p_partkey", F.concat(F.lit("/fs/"), "p_type", F.lit("/"), "p_brand", F.lit(".c")).alias("file"), F.col("p_size").alias("line"), F.coalesce("covered", F.lit(False)).alias("covered"))

    @cached_property
    def blocks(self) -> DataFrame:
        """file, start, lines: every third part begins a block, which holds a line before it, two from it on, and one of a header."""
        own = self.lines.where("p_partkey % 3 = 0").withColumn("header", F.concat(F.lit("/fs/inc/h"), (F.col("p_partkey") % 50).cast("string"), F.lit(".h")))
        line = lambda file, at: F.struct(F.col(file).alias("file"), at.cast("int").alias("line"))
        held = own.groupBy("file", F.col("line").alias("start")).agg(F.collect_set("header").alias("headers"))
        lines = F.concat(F.array(line("file", F.col("start") - 2), line("file", F.col("start")), line("file", F.col("start") + 1)), F.transform("headers", lambda h: F.struct(h.alias("file"), (F.col("start") % 9).cast("int").alias("line"))))
        return held.select("file", "start", lines.alias("lines"))

    @cached_property
    def hits(self) -> DataFrame:
        """file, line of the covered parts, and of headers and other files."""
        covered = self.lines.where("covered")
        other = F.concat(F.when(F.col("p_partkey") % 2 == 0, "/fs/inc/h").otherwise("/lib/h"), (F.col("p_partkey") % 70).cast("string"), F.lit(".h"))
        return covered.select("file", "line").unionByName(covered.select(other.alias("file"), (F.col("line") % 11).alias("line"))).distinct()

    @cached_property
    def scopes(self) -> DataFrame:
        """Address ranges: each part is a function of 64 bytes, some with a function inlined in it, some with one inlined in that."""
        p = self.table("part").select(F.col("p_partkey").cast("long").alias("k"), "p_size", "p_brand")
        at = lambda low, high, level, function, file, line: F.struct((F.col("k") * 64 + low).alias("low"), (F.col("k") * 64 + high).alias("high"), F.lit(level).alias("level"), function.alias("function"), file.cast("string").alias("call_file"), line.cast("int").alias("call_line"))
        name = lambda x: F.concat(F.lit(x), F.col("k").cast("string"))
        own = at(0, 64, 0, name("f"), F.lit(None), F.lit(None))
        inner = at(8, 40, 1, F.concat(F.lit("in"), "p_brand"), name("c"), F.col("p_size"))
        deeper = at(16, 24, 2, F.concat(F.lit("deep"), "p_brand"), name("d"), F.col("p_size") + 1)
        ranges = F.array_compact(F.array(own, F.when(F.col("p_size") % 2 == 0, inner), F.when(F.col("p_size") % 6 == 0, deeper)))
        return p.select(F.lit("k").alias("module"), F.explode(ranges).alias("r")).select("module", "r.*")

    @cached_property
    def line_table(self) -> DataFrame:
        p = self.table("part").select(F.col("p_partkey").cast("long").alias("k"), "p_size", "p_brand")
        return p.select(F.lit("k").alias("module"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"), "*").select("module", (F.col("k") * 64 + 16 * F.col("j")).alias("address"), F.concat("p_brand", F.lit(".c")).alias("file"), (F.col("p_size") * 4 + F.col("j")).cast("int").alias("line"))

    @cached_property
    def traces(self) -> DataFrame:
        """stacktrace_id, instruction_ptr, stacktrace: three frames an event."""
        near = lambda a, b: (F.col("user_id") * a + F.col("k") * b) % 12_000 + 32
        stack = F.concat(F.lower(F.hex(near(37, 64).cast("long"))), F.lit(","), F.lower(F.hex(near(211, 8).cast("long"))), F.lit(","))
        return self.events.select(F.col("seq").alias("stacktrace_id"), near(64, 5).cast("long").alias("instruction_ptr"), stack.alias("stacktrace"))

    @cached_property
    def lcov(self) -> DataFrame:
        """source, n, value: a tracefile with a record of two functions and three lines for each part; files come more than once."""
        k, n = F.col("p_partkey").cast("string"), F.col("p_partkey").cast("long") * 16
        hit = F.col("covered").cast("int").cast("string")
        values = [F.concat(F.lit("SF:"), "file"), F.concat(F.lit("FN:"), F.col("line").cast("string"), F.lit(",g"), (F.col("p_partkey") % 7).cast("string")), F.concat(F.lit("FN:1,f"), (F.col("p_partkey") % 20).cast("string"))]
        values += [F.concat(F.lit("FNDA:"), hit, F.lit(",f"), (F.col("p_partkey") % 20).cast("string")), F.concat(F.lit("DA:"), F.col("line").cast("string"), F.lit(","), hit), F.concat(F.lit("DA:"), (F.col("line") + 1).cast("string"), F.lit(",0")), F.concat(F.lit("DA:0,"), k), F.lit("LF:3"), F.concat(F.lit("LH:"), (F.col("covered").cast("int") + 1).cast("string")), F.lit("end_of_record")]
        return self.lines.select(F.lit("cov").alias("source"), n.alias("first"), F.posexplode(F.array(*values)).alias("i", "value")).select("source", (F.col("first") + F.col("i")).alias("n"), "value")
