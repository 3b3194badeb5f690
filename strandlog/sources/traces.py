"""Readers of trace files and of the small text inputs, and writers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions.running import running

COLUMNS = ("ts", "action", "lock_op", "address", "size", "base", "type", "lock_member", "file", "line", "instruction_ptr", "stacktrace", "flags", "ctx")
LOCK_OPS = {"0": ("P", "r"), "1": ("P", "w"), "2": ("V", "r"), "3": ("V", "w")}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and seq, increasing in each file's order of lines: a split's first byte plus the line's place in the split."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    first = lines.groupBy("source", "block").agg(F.min("id").alias("first"))
    return lines.join(first, ["source", "block"]).select("source", (F.col("block") + F.col("id") - F.col("first")).alias("seq"), "value")


def unhexed(c: Column) -> Column:
    return F.conv(c, 16, 10).cast("decimal(20,0)")


def decoded(lines: DataFrame, separator: str = ";", limit: int = -1) -> tuple[DataFrame, DataFrame]:
    """Events, and the lines that aren't: the wrong number of columns, or an unknown action. A header, whose first character is no digit, is neither.

    Allocations and frees have their base address in the address column, accesses in the base column. `limit` keeps the first lines of each source, a header among them.
    """
    if limit >= 0:
        lines = running(lines, ["source"], "seq", F.lit(1).cast("long"), "sum", "number", width=1 << 22).where(F.col("number") <= limit).drop("number")
    rows = lines.where(F.col("value").rlike("^[0-9]"))
    parts = rows.withColumn("x", F.split("value", rf"\Q{separator}\E", -1))
    good = (F.size("x") == len(COLUMNS)) & F.get("x", F.lit(1)).isin("a", "f", "l", "r", "w")
    named = parts.where(good).select("source", "seq", *[F.col("x")[k].alias(c) for k, c in enumerate(COLUMNS)])
    op = F.create_map(*[F.lit(v) for k, (kind, _) in LOCK_OPS.items() for v in (k, kind)])
    side = F.create_map(*[F.lit(v) for k, (_, s) in LOCK_OPS.items() for v in (k, s)])
    events = named.select(
        "source",
        "seq",
        F.col("ts").try_cast("long").alias("ts"),
        "action",
        F.when(F.col("action") == "l", op[F.col("lock_op")]).otherwise(F.col("action")).alias("kind"),
        F.when(F.col("action") == "l", side[F.col("lock_op")]).alias("side"),
        unhexed(F.col("address")).alias("address"),
        F.col("size").try_cast("int").alias("size"),
        unhexed(F.when(F.col("action").isin("a", "f"), F.col("address")).otherwise(F.col("base"))).alias("base"),
        F.substring_index("type", ":", 1).alias("type"),
        F.when(F.instr("type", ":") > 0, F.expr("substring(type, instr(type, ':') + 1)")).alias("subclass"),
        "lock_member",
        "file",
        F.col("line").try_cast("int").alias("line"),
        unhexed(F.col("instruction_ptr")).alias("instruction_ptr"),
        F.regexp_replace("stacktrace", ",$", "").alias("stacktrace"),
        F.coalesce(F.col("flags").try_cast("int"), F.lit(0)).alias("flags"),
        F.coalesce(F.col("ctx").try_cast("int"), F.lit(0)).alias("ctx"),
    )
    return events, parts.where(~F.coalesce(good, F.lit(False))).select("source", "seq", "value")


def semicolon_table(spark: SparkSession, path: str, columns: str) -> DataFrame:
    r"""A ;-separated file with a header, \N for null; rows with another number of fields are left out."""
    n = len(columns.split(","))
    lines = spark.read.text(path).withColumn("x", F.split("value", ";", -1))
    names = [c.strip().split()[0] for c in columns.split(",")]
    body = lines.where((F.size("x") == n) & (F.col("x")[0] != names[0]))
    return body.select(*[F.when(F.col("x")[k] != r"\N", F.col("x")[k]).cast(c.strip().split()[1]).alias(names[k]) for k, c in enumerate(columns.split(","))])


def ground_truth(spark: SparkSession, path: str, types: list[str] | None = None) -> DataFrame:
    found = semicolon_table(spark, path, "datatype string, member string, accesstype string, rule string, comment string, origin string")
    found = found.select(F.col("datatype").alias("type_name"), F.col("accesstype").alias("access"), "member", "rule", "comment")
    return found if types is None else found.where(F.col("type_name").isin(types))


def first_seen(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """key and id: numbers in the order of first appearance, a number without ties; counted by blocks of the order."""
    first = rows.groupBy(*key).agg(F.min(order).alias("first")).withColumn("all", F.lit(0))
    return running(first, ["all"], "first", F.lit(1).cast("long"), "sum", "id").drop("first", "all")


def hypotheses_csv(spark: SparkSession, path: str) -> DataFrame:
    """Report rows; of repeated (type, member, access, locks) the first of a file stays."""
    found = spark.read.csv(path, sep=";", header=True, schema="type string, member string, accesstype string, locks string, conflictlist string, occurrences long, total long, percentage double, accepted int, confidence double, parameters string")
    key = ["type", "member", "accesstype", "locks"]
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    rows = found.select(*key, at.alias("at"), F.struct(*[c for c in found.columns if c not in key]).alias("row"))
    first = rows.groupBy(*key).agg(F.min_by("row", "at").alias("row"))
    return first.select(*[c if c in key else F.col(f"row.{c}").alias(c) for c in found.columns])


def coverage_maps(spark: SparkSession, path: str) -> DataFrame:
    """map (file name) and bb, one token per line."""
    return spark.read.text(path).select(F.regexp_extract("_metadata.file_name", r"([^/]+)$", 1).alias("map"), F.trim("value").alias("bb")).where("bb <> ''")


def type_list(spark: SparkSession, path: str) -> DataFrame:
    """id and type_name: one name a line, numbered in the order of the lines."""
    lines = numbered_lines(spark, path).where("value <> ''").withColumn("all", F.lit(0))
    return running(lines, ["all"], "seq", F.lit(1).cast("long"), "sum", "id").select("id", F.col("value").alias("type_name"))


def observations_tsv(spark: SparkSession, path: str) -> DataFrame:
    """type_name, members_accessed, locks_held, occurrences of a tab-separated table; lines with another number of columns, and the header, are left out."""
    parts = spark.read.text(path).withColumn("x", F.split("value", "\t", -1)).where((F.size("x") == 4) & F.col("value").rlike("[0-9]$"))
    return parts.select(F.col("x")[0].alias("type_name"), F.col("x")[1].alias("members_accessed"), F.col("x")[2].alias("locks_held"), F.col("x")[3].cast("long").alias("occurrences"))
