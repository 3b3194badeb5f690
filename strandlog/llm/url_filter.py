"""URL filters: rules of a host and the start of a path, found by hashes of the expressions that a URL stands for.

A URL is expanded into the suffixes of its host, by labels, and the starts of its path; an expression is a suffix and a start. Rules have the
SHA-256 digest of their expression. Expressions meet rules by the first 32 bits of the digest, then the whole digest must agree; of
the rules that are left the longest wins.

Only expressions that a rule can have are made: suffixes of as many labels as the rules' hosts have at most, starts up to as many slashes as
the rules' paths that end in one have at most, and starts of the lengths that the other rules' paths have. No rule is missed, and the number of a URL's expressions follows the rules, not the URL.
What a URL is asked for is thus a short host and a short path (its site), and each site is asked for once: a host with a third of all URLs has few sites.
The table of rules may be large; small ones are broadcast by the planner's own size check.

Defined results: a rule fits its host and all hosts that end in a dot and it, where the path starts with the rule's; an empty path starts with the empty path only. The longest rule is
that of the most characters, host and path together, then the one with the longer host; of equal rules of both verdicts `block` wins. Rules with a null host, path or verdict are left out,
hosts of rules are lower-cased (A-Z). URLs that no rule fits get `otherwise`. A URL that is null or has no `://` has host and path '', as one that ends there has.
Repeated rows stay. Very long URLs are taken whole. Columns of the input named host, path, rule or verdict are replaced, all others are carried. Empty tables of URLs or rules are fine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDED = ["host", "path", "rule", "verdict"]

#: The rules of the query, as host, path and verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def slashes(path):
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def labels(host):
    return F.split(host, r"\.", -1)


def with_digest(df: DataFrame, host: str, path: str) -> DataFrame:
    """`short` and `digest` of an expression; a host has no slash, so that the first one ends it."""
    return df.withColumn("digest", F.sha2(F.concat_ws("/", host, path), 256)).withColumn("short", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"))


def hashed_rules(rules: DataFrame) -> DataFrame:
    known = rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).dropna()
    return with_digest(known.groupBy("rule_host", "rule_path").agg(F.max(F.struct((F.col("rule_verdict") == "block").alias("blocks"), "rule_verdict")).alias("v")).select("rule_host", "rule_path", F.col("v.rule_verdict").alias("rule_verdict")), "rule_host", "rule_path")


def bounds(rules: DataFrame) -> tuple[int, int, list[int]]:
    """Most labels of a rule's host, most slashes of a path that ends in one, lengths of the other paths: one row, however many rules there are."""
    ends = F.col("rule_path").endswith("/")
    most = rules.agg(F.max(F.size(labels(F.col("rule_host")))).alias("labels"), F.max(F.when(ends, slashes(F.col("rule_path")))).alias("slashes"), F.array_sort(F.collect_set(F.when(~ends, F.length("rule_path")))).alias("lengths")).first()
    return most["labels"] or 0, most["slashes"] or 0, most["lengths"]


def parsed(urls: DataFrame) -> DataFrame:
    """The input as `row`, with its host and path."""
    at = F.locate("://", F.coalesce("url", F.lit("")))
    rest = F.when(at > 0, F.col("url").substr(at + 3, F.length("url"))).otherwise("")
    found = urls.select(F.struct(*(F.col(f"`{c}`") for c in urls.columns)).alias("row"), rest.alias("rest"))
    found = found.withColumn("host", F.regexp_extract("rest", r"^[^/?#]*", 0))
    path = F.regexp_extract(F.col("rest").substr(F.length("host") + 1, F.length("rest")), r"^[^?#]*", 0)
    return found.select("row", F.translate("host", UPPER, LOWER).alias("host"), path.alias("path"))


def with_site(df: DataFrame, most_labels: int, most_slashes: int, lengths: list[int]) -> DataFrame:
    """`site_host` and `site_path`: the longest suffix and start that a rule can have."""
    parts, steps = labels(F.col("host")), F.split("path", "/", -1)
    last = F.least(F.size(parts), F.lit(most_labels))
    whole = F.array_join(F.slice(steps, 1, F.lit(most_slashes)), "/")
    # as many characters as the starts that end in a slash have, or the longest of the other lengths
    long = F.greatest(F.when(F.size(steps) > most_slashes, F.length(whole) + (1 if most_slashes else 0)).otherwise(F.length("path")), F.lit(max(lengths, default=0)))
    return df.withColumns({"site_host": F.array_join(F.slice(parts, -last, last), "."), "site_path": F.col("path").substr(F.lit(1), long)})


def expressions(sites: DataFrame, most_slashes: int, lengths: list[int]) -> DataFrame:
    """A row for each suffix and start of a site, with its digest."""
    parts, steps = labels(F.col("site_host")), F.split("site_path", "/", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    slashed = F.transform(F.filter(F.sequence(F.lit(1), F.lit(max(most_slashes, 1))), lambda k: (k < F.size(steps)) & F.lit(most_slashes > 0)), lambda k: F.concat(F.array_join(F.slice(steps, 1, k), "/"), F.lit("/")))
    plain = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("site_path")), lambda n: F.col("site_path").substr(F.lit(1), n))
    found = sites.withColumns({"suffixes": suffixes, "starts": F.array_distinct(F.concat(slashed, plain))})
    found = found.select("site_host", "site_path", "starts", F.explode("suffixes").alias("suffix")).select("site_host", "site_path", "suffix", F.explode("starts").alias("start"))
    return with_digest(found, "suffix", "start")


def judged(urls: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """`urls` with host, path, rule (host and path of the longest rule that fits, or null) and verdict."""
    known = hashed_rules(rules)
    most_labels, most_slashes, lengths = bounds(known)
    pages = parsed(urls)
    kept = [F.col(f"row.`{c}`") for c in urls.columns if c not in ADDED]
    if not most_labels:
        return pages.select(*kept, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    pages = with_site(pages, most_labels, most_slashes, lengths)
    asked = expressions(pages.select("site_host", "site_path").distinct(), most_slashes, lengths)
    near = asked.alias("e").join(known.alias("r"), F.col("e.short") == F.col("r.short")).where("e.digest = r.digest and e.suffix = r.rule_host and e.start = r.rule_path")
    order = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), "rule_host")
    winners = near.groupBy("site_host", "site_path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")), order).alias("found"))
    return pages.join(winners, ["site_host", "site_path"], "left").select(*kept, "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(otherwise)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark, RULES)).drop("url")
