"""Struct layouts: expansion of nested members, and a row for every covered byte."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Greatest offset that a flattened layout has.
MOST_OFFSET = 1_048_576


def flattened(structs_layout: DataFrame, most: int | DataFrame | None = MOST_OFFSET) -> DataFrame:
    """A row for each byte of each member, with helper_offset: so that an address finds its member by equality.

    `most` caps the offsets, as a number or by type (data_type_id, most): the largest offset that accesses have, say, so that a
    flexible array of a megabyte doesn't become a million rows. With None there is no cap.
    """
    if most is None:
        cut = structs_layout.withColumn("most", F.col("byte_offset") + F.col("size"))
    elif isinstance(most, int):
        cut = structs_layout.withColumn("most", F.lit(most))
    else:
        cut = structs_layout.join(most, "data_type_id")
    end = F.least(F.col("byte_offset") + F.col("size") - 1, F.col("most"))
    return cut.where(end >= F.col("byte_offset")).withColumn("helper_offset", F.explode(F.sequence(F.col("byte_offset"), end))).drop("most")


def expanded(members: DataFrame, observed: DataFrame, depth: int = 16) -> DataFrame:
    """Leaf members of every observed type: type, name, byte_offset, size, member_type.

    `members` has type, name (null: anonymous), byte_offset, size, member_type, kind (scalar, struct, union) and count (elements, 1 if no
    array). A struct member that is anonymous or of an observed type is replaced by its own members, names joined by dots, once per
    array element; a union is one row named by its members joined with hyphens; other anonymous members are named by their offset.
    """
    union_names = members.where("name is not null").groupBy(F.col("type").alias("member_type")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("byte_offset", "name"))), lambda x: x["name"]), "-").alias("joined"))
    named = members.join(union_names, "member_type", "left").withColumn("name", F.when((F.col("kind") == "union") & F.col("name").isNull(), F.col("joined")).otherwise(F.col("name"))).drop("joined")
    inner = named.join(observed.select(F.col("type").alias("member_type"), F.lit(True).alias("seen")), "member_type", "left")
    inner = inner.withColumn("opens", (F.col("kind") == "struct") & (F.col("name").isNull() | F.coalesce("seen", F.lit(False)))).drop("seen")
    now = inner.join(observed.select("type"), "type", "left_semi").withColumn("path", F.col("name"))
    done = None
    for _ in range(depth):
        leaves = now.where("not opens")
        done = leaves if done is None else done.unionByName(leaves)
        below = inner.select(F.col("type").alias("b_type"), *[F.col(c).alias(f"b_{c}") for c in ("name", "byte_offset", "size", "member_type", "kind", "count", "opens")])
        deeper = now.where("opens").withColumn("element", F.explode(F.sequence(F.lit(0), F.greatest("count", F.lit(1)) - 1))).join(below, F.col("member_type") == F.col("b_type"))
        offset = F.col("byte_offset") + F.col("element") * (F.col("size") / F.greatest("count", F.lit(1))).cast("int") + F.col("b_byte_offset")
        now = deeper.select("type", F.col("b_name").alias("name"), offset.alias("byte_offset"), F.col("b_size").alias("size"), F.col("b_member_type").alias("member_type"), F.col("b_kind").alias("kind"), F.col("b_count").alias("count"), F.col("b_opens").alias("opens"), F.concat_ws(".", "path", "b_name").alias("path"))
        if now.isEmpty():
            break
    return done.select("type", F.coalesce(F.when(F.col("path") != "", F.col("path")), F.concat(F.lit("anonymous_"), F.col("byte_offset"))).alias("name"), "byte_offset", F.when((F.col("size") == 0) & (F.col("count") == 0), MOST_OFFSET).otherwise(F.col("size")).alias("size"), "member_type")
