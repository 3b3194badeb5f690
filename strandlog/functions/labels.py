"""Lock labels: the text form of a lock as seen from an accessed allocation, and its parser."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def described_locks(db, subclasses: bool = False) -> DataFrame:
    """lock_id, embedded_in, own (label where not embedded), place (type.member, with ? inside a complex member), sub_lock."""
    a = db.allocations.select(F.col("id").alias("embedded_in"), F.col("subclass_id").alias("l_subclass"), F.col("base_address").alias("l_base"))
    sc = db.subclasses.select(F.col("id").alias("l_subclass"), F.col("data_type_id").alias("l_type"), F.col("name").alias("l_subname"))
    dt = db.data_types.select(F.col("id").alias("l_type"), F.col("name").alias("l_typename"))
    lay = db.layout_flat.select(F.col("data_type_id").alias("l_type"), "helper_offset", F.col("byte_offset").alias("l_offset"), F.col("member_name_id").alias("l_member"))
    mn = db.member_names.select(F.col("id").alias("l_member"), F.col("name").alias("l_membername"))
    found = db.locks.withColumnRenamed("id", "lock_id").join(a, "embedded_in", "left").join(sc, "l_subclass", "left").join(dt, "l_type", "left")
    found = found.withColumn("helper_offset", (F.col("address") - F.col("l_base")).cast("int")).join(lay, ["l_type", "helper_offset"], "left").join(mn, "l_member", "left")
    of_type = F.when(F.col("l_subname").isNotNull(), F.concat_ws(":", "l_typename", "l_subname")).otherwise(F.col("l_typename")) if subclasses else F.col("l_typename")
    inside = F.when(F.col("l_base") + F.col("l_offset") == F.col("address"), F.lit("")).otherwise(F.lit("?"))
    side = F.concat(F.lit("["), F.col("sub_lock"), F.lit("])"))
    own = F.concat_ws("", F.when(F.col("lock_var_name").isNotNull(), F.concat("lock_var_name", F.lit(":"))), F.col("lock_id").cast("string"), F.lit("("), F.col("lock_type_name"), side)
    return found.select("lock_id", "embedded_in", "sub_lock", F.when(F.col("embedded_in").isNull(), own).alias("own"), F.concat_ws("", F.lit("("), of_type, F.lit("."), F.col("l_membername"), inside, side).alias("place"))


def label(alloc: Column, other: str = "EMBOTHER") -> Column:
    """Label of a described lock as seen from an allocation. `other` is EMBOTHER, or EMB for labels that carry the lock's id."""
    elsewhere = F.concat(F.lit("EMBOTHER"), F.col("place")) if other == "EMBOTHER" else F.concat(F.lit("EMB:"), F.col("lock_id").cast("string"), F.col("place"))
    return F.when(F.col("embedded_in").isNull(), F.col("own")).when(F.col("embedded_in") == alloc, F.concat(F.lit("EMBSAME"), F.col("place"))).otherwise(elsewhere)


def joined_in_order(order: list[str], value: Column, separator: str) -> Column:
    """Values joined in the order of columns; nulls are left out."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("v")))), lambda x: x["v"]), separator)


def is_word(text: str) -> bool:
    """Letters, digits and underscores, one at least."""
    return text.isascii() and text.replace("_", "a").isalnum()


@dataclass(frozen=True)
class LockRef:
    """A parsed label. kind: same, other or id."""

    kind: str
    side: str
    type: str | None = None
    subclass: str | None = None
    member: str | None = None
    lock_id: int | None = None

    @staticmethod
    def parse(text: str) -> "LockRef":
        """Reads `head(place[side])`: the head ends at the first bracket, the place at the last square one; an embedded lock's place is type.member, the type up to the first dot."""
        head, opened, rest = text.partition("(")
        place, bracket, side = rest.rpartition("[")
        if not (opened and bracket and side in ("r])", "w])")):
            raise ValueError(f"not a lock label: {text}")
        if head in ("EMBSAME", "EMBOTHER"):
            owner, dot, member = place.partition(".")
            data_type, colon, subclass = owner.partition(":")
            if not dot or not is_word(data_type) or (colon and not is_word(subclass)):
                raise ValueError(f"not a lock label: {text}")
            if "?" in member:
                raise ValueError(f"the lock of {text} has no exact place")
            return LockRef("same" if head == "EMBSAME" else "other", side[0], data_type, subclass if colon else None, member)
        name, colon, number = head.rpartition(":")
        if not (number.isascii() and number.isdigit()) or (colon and not is_word(name)):
            raise ValueError(f"not a lock label: {text}")
        return LockRef("id", side[0], lock_id=int(number))


def parsed(text: Column) -> Column:
    """kind, side, type, subclass, member, lock_id: what `LockRef.parse` reads of a label, as columns; kind is null where that raises an error."""
    after = lambda c, n: F.substring(c, n + 1, F.length(c))
    head = F.substring_index(text, "(", 1)
    rest = after(text, F.length(head) + 1)
    side = F.substring_index(rest, "[", -1)
    place = F.left(rest, F.length(rest) - F.length(side) - 1)
    owner = F.substring_index(place, ".", 1)
    member = after(place, F.length(owner) + 1)
    embedded = head.isin("EMBSAME", "EMBOTHER")
    known = (F.instr(text, "(") > 0) & (F.instr(rest, "[") > 0) & side.isin("r])", "w])")
    inside = known & embedded & owner.rlike(r"^\w+(:\w+)?$") & (F.instr(place, ".") > 0) & (F.instr(member, "?") == 0)
    alone = known & ~embedded & head.rlike(r"^(\w+:)?[0-9]+$")
    subclass = F.when(F.instr(owner, ":") > 0, F.substring_index(owner, ":", -1))
    return F.struct(
        F.when(inside, F.when(head == "EMBSAME", "same").otherwise("other")).when(alone, "id").alias("kind"),
        F.left(side, F.lit(1)).alias("side"),
        F.when(inside, F.substring_index(owner, ":", 1)).alias("type"),
        F.when(inside, subclass).alias("subclass"),
        F.when(inside, member).alias("member"),
        F.when(alone, F.substring_index(head, ":", -1).try_cast("int")).alias("lock_id"),
    )
