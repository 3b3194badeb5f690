"""Source divergence audit: how far the sources of a language are from each other and from the whole language, by their terms.

Each kept term is a row with its counts in an array over the sources of its language, in the order of their names (a wide vector). Shares
are whole numbers of 10^-9, in decimal arithmetic, so that sums are the same in any order. Higher-order functions emit the differences of
a vector's shares by pairs of sources, each pair once; they are summed before the shuffle, so that what a task sends is a row for each pair
of sources at most.

Occurrences and documents of a term are counted by (lang, source, term), summed within tasks first: a frequent term or a large source sends a row a task.

Defined results: null text, lang and source are ''. A row is a document: repeated rows, and rows of one doc_id, count each. Texts without terms
give their source (a group without terms has the share of 5 in 5 * V everywhere). A language without kept terms has pairs of value 0 and no rows of part `term`. One
source alone has no pairs. Ties go to the item that is first by its UTF-8 bytes. Texts of any length are taken whole; one text's terms are an array
in its row. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UNIT = 1_000_000_000
PRIOR = 5


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents). A text's terms are followed by its distinct terms in one array, so that both are counted at once."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    terms = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), F.regexp_extract_all(text, F.lit(TERM), F.lit(0)).alias("terms"))
    found = terms.select("lang", "source", F.size("terms").alias("size"), F.posexplode(F.concat("terms", F.array_distinct("terms"))).alias("at", "term"))
    again = F.col("at") >= F.col("size")
    return found.groupBy("lang", "source", "term").agg(F.sum(F.when(again, 0).otherwise(1)).alias("n"), F.sum(F.when(again, 1).otherwise(0)).alias("d"))


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """lang, term, cells (source, n): the terms in at least so many documents of their language, with the sources that have them."""
    by_term = counted(docs).groupBy("lang", "term").agg(F.sum("d").alias("d"), F.collect_list(F.struct("source", "n")).alias("cells"))
    return by_term.where(F.col("d") >= least).select("lang", "term", "cells")


def sized_langs(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, sources (by name), sums (of each source, in that order), total, v: a row for each language."""
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sums = kept.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    langs = groups.join(sums, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("all"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return langs.join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v")), "lang", "left").select("lang", F.col("all.source").alias("sources"), F.col("all.n").alias("sums"), "total", F.coalesce("v", F.lit(0)).alias("v"))


def share(n, total):
    """1 + floor(UNIT * (n + PRIOR) / (total + PRIOR * v)); the product passes 64 bits for large counts."""
    wide = lambda x: (x + F.lit(PRIOR)).cast("decimal(19,0)")
    whole = (total + F.lit(PRIOR) * F.col("v")).cast("decimal(19,0)")
    # integral division of decimals gives a long
    return F.lit(1) + F.call_function("div", wide(n) * F.lit(UNIT).cast("decimal(10,0)"), whole)


def vectors(kept: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, term, sources, counts and shares (arrays over the sources), q (the language's share)."""
    absent = F.transform(F.array_except("sources", F.col("cells.source")), lambda s: F.struct(s.alias("source"), F.lit(0).cast("long").alias("n")))
    wide = kept.join(langs, "lang").withColumn("counts", F.transform(F.array_sort(F.concat("cells", absent)), lambda c: c["n"]))
    return wide.select(
        "lang",
        "term",
        "sources",
        "counts",
        F.zip_with("counts", "sums", share).alias("shares"),
        share(F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n), F.col("total")).alias("q"),
    )


def pair_values(found: DataFrame) -> DataFrame:
    """lang, i, j (places of sources, i < j), value: the sum of the shares' differences over all terms."""
    first = found.select("lang", "shares", F.posexplode("shares").alias("i", "p"))
    rest = F.slice("shares", F.col("i") + 2, F.size("shares"))
    gaps = first.select("lang", "i", F.posexplode(F.transform(rest, lambda x: F.abs(x - F.col("p")))).alias("k", "f"))
    return gaps.groupBy("lang", "i", (F.col("i") + 1 + F.col("k")).alias("j")).agg(F.sum("f").alias("value"))


def audit(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: other sources by distance, and the `top` terms that a source has above its language's share."""
    kept = written(kept_terms(docs, least), "divergence-terms")
    langs = written(sized_langs(docs, kept), "divergence-langs")
    found = vectors(kept, langs)
    places = langs.select("lang", "sources", F.posexplode("sources").alias("a", "source"))
    others = places.select("lang", "source", "a", F.posexplode("sources").alias("b", "item")).where("a <> b").withColumns({"i": F.least("a", "b"), "j": F.greatest("a", "b")})
    pairs = others.join(pair_values(found), ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    cells = found.select("lang", "term", "q", F.explode(F.arrays_zip("sources", "counts", "shares")).alias("c")).where("c.counts > 0 and c.shares > q")
    terms = cells.select("lang", F.col("c.sources").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("c.shares") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).union(terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))
