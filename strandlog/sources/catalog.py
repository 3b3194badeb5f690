"""A catalog of types, layouts, allocations, locks and blacklists from the test tables, which grows with them.

Types are the pairs of a part's type and brand, members are parts, allocations are suppliers, and locks are the parts that a supplier delivers: a lock lies in its supplier's object at the part's place,
where the object's type may or may not have a member.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlog.functions import checkpoints
from strandlog.operators import flat, layout

#: Bytes between two allocations, more than any member's offset.
ROOM = 1 << 32


class Catalog:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def parts(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").cast("long").alias("k"), "p_size", F.concat(F.lower("p_type"), F.lit("_"), F.substring("p_brand", 7, 9)).alias("type_name"))

    @cached_property
    def data_types(self) -> DataFrame:
        """Numbered by name; there are as many as pairs of type and brand, whatever the number of parts."""
        found = self.parts.select(F.col("type_name").alias("name")).distinct()
        return checkpoints.kept(found.select(F.row_number().over(Window.orderBy("name")).alias("id"), "name"), "catalog-types")

    @cached_property
    def members(self) -> DataFrame:
        """Parts with the number of their type."""
        return self.parts.join(self.data_types.select(F.col("id").alias("data_type_id"), F.col("name").alias("type_name")), "type_name")

    @cached_property
    def subclasses(self) -> DataFrame:
        """Every third type has none of its own, others have two."""
        t = F.col("id")
        kinds = F.when(t % 3 == 0, F.array(F.struct((t * 10).alias("id"), F.lit(None).cast("string").alias("name")))).otherwise(F.array(*[F.struct((t * 10 + k).alias("id"), F.lit(n).alias("name")) for k, n in ((1, "a"), (2, "b"))]))
        return self.data_types.select(t.alias("data_type_id"), F.explode(kinds).alias("s")).select("s.id", "data_type_id", "s.name")

    @cached_property
    def member_names(self) -> DataFrame:
        return self.parts.select(F.col("k").alias("id"), F.concat(F.lit("m"), F.col("k").cast("string")).alias("name"))

    @cached_property
    def structs_layout(self) -> DataFrame:
        of = F.when(F.col("p_size") % 10 == 0, "atomic_t").when(F.col("p_size") % 10 == 1, "atomic64_t").when(F.col("p_size") % 10 == 2, "atomic_long_t").otherwise("int")
        return self.members.select("data_type_id", of.alias("data_type_name"), F.col("k").alias("member_name_id"), (16 * F.col("k")).cast("int").alias("byte_offset"), (F.col("p_size") % 13 + 4).cast("int").alias("size"))

    @cached_property
    def layout_flat(self) -> DataFrame:
        """Offsets grow with the parts and members are short, so that none is capped."""
        return layout.flattened(self.structs_layout, None)

    @cached_property
    def allocations(self) -> DataFrame:
        k = F.col("s_suppkey").cast("long")
        of_type = (k % 20 + 1).cast("int")
        return self.table("supplier").select(k.alias("id"), F.when(of_type % 3 == 0, of_type * 10).otherwise(of_type * 10 + 1 + (k % 2).cast("int")).alias("subclass_id"), ((k + 1) * ROOM).alias("base_address"))

    @cached_property
    def locks(self) -> DataFrame:
        s, p = F.col("l_suppkey").cast("long"), F.col("l_partkey").cast("long")
        pairs = self.table("lineitem").select(s.alias("s"), p.alias("p")).distinct()
        return pairs.select((F.col("s") * ROOM + F.col("p")).alias("id"), ((F.col("s") + 1) * ROOM + 16 * F.col("p") + F.col("p") % 3 * 2).alias("address"), F.col("s").alias("embedded_in"), F.when(F.col("p") % 2 == 0, "w").otherwise("r").alias("sub_lock"))

    @cached_property
    def locks_embedded_flat(self) -> DataFrame:
        return flat.locks_embedded_flat(self)

    @cached_property
    def member_blacklist(self) -> DataFrame:
        """Members of size 7, for the type's first subclass."""
        first = F.when(F.col("data_type_id") % 3 == 0, F.col("data_type_id") * 10).otherwise(F.col("data_type_id") * 10 + 1)
        return self.members.where("p_size = 7").select(first.alias("subclass_id"), F.col("k").alias("member_name_id"))

    @cached_property
    def function_blacklist(self) -> DataFrame:
        """Functions for types, and for every second member of size 9."""
        k = F.col("k")
        return self.members.where("p_size = 9").select(
            F.when(F.col("data_type_id") % 3 == 0, F.col("data_type_id") * 10).otherwise(F.col("data_type_id") * 10 + 2).alias("subclass_id"),
            F.when(k % 2 == 0, k).alias("member_name_id"),
            F.concat(F.lit("fn"), (k % 50).cast("string")).alias("fn"),
            F.when(k % 3 > 0, (k % 4).cast("int")).alias("sequence"),
        )
