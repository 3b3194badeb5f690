"""Fuzzy line dedup in DataFrame functions alone: character shingles, MinHash, banding, exact Jaccard, distributed union-find.

Texts are cut into lines at \\n. A line's shingles are the `width` characters that start at each of its characters; a shorter line is one
shingle. They decide which lines are similar. Candidates are found by fewer, the anchors: those that start at each word, and at each character
more than `width` into an unbroken run, so that text without blanks has them as well; at the line's end they are shorter. An edit
changes a larger share of the anchors than of the shingles, so that bands are made for less than `percent`. Lines are told
apart by a 64-bit hash, so that equal lines are one from the start (of n distinct lines, about n * n / 2**65 pairs share one). Each distinct line has `bands * rows` minima of its anchors'
64-bit hash under fixed masks (exclusive or), aggregated before the shuffle; lines that agree in a band share a bucket and are compared
with the least line of the bucket; then, while they are in different components, with one line of its first and of its last
component; then those outside the bucket's commonest component with the lines of all others, within arrays. Pairs whose bitmaps prove
them dissimilar go; the others are confirmed by exact Jaccard on the sets of all shingles, which are built from the lines where they are compared: only lines and
bitmaps are moved. Components come
from large-star and small-star; of each, the first occurrence in the order of (doc_id, line) stays.

Defined results: lines without anything but white space have no shingles; they always stay and are linked with nothing. Null texts have no lines.
Rows with one id and one text are one document, and are decided alike; ids may be null and then come first. An empty
table gives an empty result. Other columns are ignored, or carried by `cleaned`. Line breaks other than \\n are ordinary characters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, table, written
from .components import components


@dataclass(frozen=True)
class Lines:
    width: int = 12
    #: Least similarity, in hundredths.
    percent: int = 80
    bands: int = 13
    rows: int = 3
    #: Longs of a line's bitmap, a power of two.
    words: int = 16

    def masks(self) -> list[int]:
        """Fixed 64-bit masks, from the golden ratio's multiples."""
        raw = [(k + 1) * 0x9E3779B97F4A7C15 % (1 << 64) for k in range(self.bands * self.rows)]
        return [x - (1 << 64) if x >> 63 else x for x in raw]

    def shingles(self, line: Column) -> Column:
        """The character shingles of a line, at every position."""
        return F.when(F.length(line) < self.width, F.array(line)).otherwise(F.regexp_extract_all(line, F.lit(rf"(?s)(?=(.{{{self.width}}}))."), 1))

    def anchors(self, line: Column) -> Column:
        """The shingles by which candidates are found."""
        w = self.width
        # The first characters of a run are consumed with its first shingle: none of them is tried as a start.
        return F.regexp_extract_all(line, F.lit(rf"(?s)(?=(\S.{{0,{w - 1}}}))(?:(?<!\S)\S{{1,{w}}}|(?<=\S{{{w}}})\S)"), 1)


def documents_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_key() -> Column:
    return F.xxhash64("text")


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line_no, line, line_key of each line with more than white space."""
    cut = documents_of(docs).where("text is not null").select("doc_id", text_key().alias("text_key"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return cut.where(F.col("line").rlike(r"\S")).withColumn("line_key", F.xxhash64("line"))


def signed(lines: DataFrame, how: Lines) -> DataFrame:
    """line_key and the minima m0, m1, ... of each distinct line."""
    hashes = lines.select("line_key", F.explode(how.anchors(F.col("line"))).alias("s")).select("line_key", F.xxhash64("s").alias("h"))
    return hashes.groupBy("line_key").agg(*[F.min(F.col("h").bitwiseXOR(F.lit(x))).alias(f"m{k}") for k, x in enumerate(how.masks())])


def bucketed(signatures: DataFrame, how: Lines) -> DataFrame:
    """bucket, line_key for each line and band."""
    keys = F.array(*[F.xxhash64(F.lit(b), *[f"m{b * how.rows + r}" for r in range(how.rows)]) for b in range(how.bands)])
    return signatures.select("line_key", F.explode(keys).alias("bucket"))


def bitmaps(lines: DataFrame, how: Lines) -> DataFrame:
    """line_key, the size of the set of each line's shingles and its bitmap, an array of longs: every shingle turns the bit that its hash names."""
    at = F.xxhash64("s").bitwiseAND(F.lit(64 * how.words - 1))
    places = lines.select("line_key", F.explode(F.array_distinct(how.shingles(F.col("line")))).alias("s")).select("line_key", at.alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
    word = lambda k: F.coalesce(F.bit_xor(F.when(F.shiftright("at", 6) == k, bit)), F.lit(0).cast("long"))
    return places.groupBy("line_key").agg(F.count(F.lit(1)).alias("size"), F.array(*[word(k) for k in range(how.words)]).alias("bits"))


def possible(a: Column, b: Column, how: Lines) -> Column:
    """False only for pairs that can't be alike. `a` and `b` are structs with `size` and `bits`.

    Shingles that both lines have turn a bit in both bitmaps, so that each bit in which these differ is a shingle that one line alone has, and of these similar lines have few.
    """
    apart = sum((F.bit_count(a["bits"][k].bitwiseXOR(b["bits"][k])) for k in range(how.words)), F.lit(0))
    near = 100 * F.least(a["size"], b["size"]) >= how.percent * F.greatest(a["size"], b["size"])
    return near & ((100 + how.percent) * apart <= (100 - how.percent) * (a["size"] + b["size"]))


def shingle_set(line: Column, how: Lines) -> Column:
    return F.array_distinct(F.transform(how.shingles(line), lambda s: F.xxhash64(s)))


def enough(a: Column, b: Column, how: Lines) -> Column:
    """Whether the exact Jaccard similarity of two sets is enough; sizes are compared first."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return (100 * small >= how.percent * large) & ((100 + how.percent) * F.size(F.array_intersect(a, b)) >= how.percent * (small + large))


def alike(line_a: Column, line_b: Column, how: Lines) -> Column:
    """Whether the shingle sets of the lines are similar enough."""
    # One element, so that each set is built once for all its uses.
    return F.exists(F.array(F.struct(shingle_set(line_a, how).alias("a"), shingle_set(line_b, how).alias("b"))), lambda x: enough(x["a"], x["b"], how))


def similar(pairs: DataFrame, own: DataFrame, how: Lines) -> DataFrame:
    """Of pairs (a, b), those whose shingle sets are similar enough; bitmaps are compared first."""
    side = lambda x: own.select(F.col("line_key").alias(x), F.struct("line", "size", "bits").alias(f"own_{x}"))
    a, b = F.col("own_a"), F.col("own_b")
    return pairs.join(side("a"), "a").join(side("b"), "b").where(possible(a, b, how) & alike(a["line"], b["line"], how)).select("a", "b")


def pairs_of(found: DataFrame) -> DataFrame:
    return found.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def roots_of(docs: DataFrame, how: Lines) -> DataFrame:
    """node, root: keys of lines that are linked with others, and of their component's least line."""
    lines = lines_of(docs)
    # Dealt by bucket once, for the hubs and for the join with them; both read the keys, so that it is one exchange.
    buckets = bucketed(signed(lines, how), how).repartition("bucket")
    hubs = buckets.groupBy("bucket").agg(F.min("line_key").alias("least"), F.max("line_key").alias("most")).where("least != most").drop("most")
    # Few buckets have a hub, each one row: they are hashed, and the many rows of all buckets needn't be sorted.
    shared = written(buckets.join(hubs.hint("shuffle_hash"), "bucket"), "line-shared")
    wanted = shared.select("line_key").distinct()
    # Equal lines are one before they are shuffled, so that a very common one is few rows.
    texts = written(lines.groupBy("line_key").agg(F.first("line").alias("line")).join(wanted, "line_key", "left_semi"), "line-texts")
    own = written(texts.join(bitmaps(texts, how), "line_key"), "line-own")
    dropped(texts)
    first = written(pairs_of(shared.select(F.col("line_key").alias("a"), F.col("least").alias("b"))), "line-pairs")
    roots = components(similar(first, own, how))

    # Lines of a bucket that are in different components are compared with the least and largest line of the bucket's least and largest component.
    labels = of_components(shared, roots)
    apart = labels.groupBy("bucket").agg(F.min(F.struct("label", "line_key")).alias("x"), F.max(F.struct("label", "line_key")).alias("y")).where("x.label != y.label")
    ends = labels.join(apart, "bucket").select("line_key", "label", F.explode(F.array("x", "y")).alias("e"))
    second = written(pairs_of(ends.where("label != e.label").select(F.col("line_key").alias("a"), F.col("e.line_key").alias("b"))).join(first, ["a", "b"], "left_anti"), "line-pairs")
    roots = joined(roots, similar(second, own, how))
    dropped(first)
    dropped(second)

    # Large buckets first in part: what is joined there needn't be compared with all others.
    for large, whole in ((True, False), (True, True), (False, True)):
        roots = joined(roots, cross_links(shared, of_components(shared, roots), own, how, large, whole))
    dropped(shared)
    dropped(own)
    return roots


#: Lines and characters of a bucket that one row holds for comparison, about; a line at least. Lines that one task compares with such a row, about.
BLOCK, BLOCK_CHARS, PART, FEW = 256, 1 << 20, 256, 32


def cross_links(shared: DataFrame, labels: DataFrame, own: DataFrame, how: Lines, large: bool, whole: bool) -> DataFrame:
    """Links (a, b) between the roots of components that have similar lines in a bucket.

    It takes the `large` buckets, of more than `FEW` lines, where each line's set is built once for many comparisons, or the others, where sets are built for the few
    pairs that need it. Not `whole`, it takes those of several rows, and each odd line meets one row only.

    Lines that don't have their bucket's commonest component are its odd ones. The lines of a bucket are gathered in rows of about
    `BLOCK` lines and `BLOCK_CHARS` characters, by component, and its odd lines in parts of about `PART` lines. Each part meets each such row once, as lines and bitmaps, and for each odd line the row
    is searched by array functions up to the first similar line of each component: no pair becomes a row but a link, and no row is repeated for an odd line. A pair that shares several
    buckets is compared in the least of them; bitmaps are compared before lines.
    """
    sized = labels.join(own.select("line_key", F.length("line").alias("chars")), "line_key")
    usual = sized.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("chars").alias("chars")).groupBy("bucket")
    usual = usual.agg(F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("n"), F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    blocks, parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("chars") / BLOCK_CHARS)), F.ceil((F.col("n") - F.col("top.k")) / PART)
    usual = usual.select("bucket", F.col("top.label").alias("usual"), blocks.cast("int").alias("blocks"), parts.cast("int").alias("parts"), "n")
    usual = usual.where(F.lit(large) == ((F.col("blocks") > 1) | (F.col("n") > FEW if whole else F.lit(False)))).drop("n")
    mixed = labels.join(usual, "bucket")
    keys = shared.join(mixed.select("line_key").distinct(), "line_key", "left_semi").groupBy("line_key").agg(F.collect_list("bucket").alias("keys"))
    full = mixed.join(keys.join(own, "line_key"), "line_key")
    dealt = lambda n: F.pmod(F.xxhash64("line_key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    here = F.struct("line_key", "keys", "size", "bits", "line")
    grouped = full.withColumn("block", dealt("blocks")).groupBy("bucket", "block", "label").agg(F.max("parts").alias("parts"), F.collect_list(here).alias("lines"))
    rows = grouped.groupBy("bucket", "block").agg(F.max("parts").alias("parts"), F.collect_list(F.struct("label", "lines")).alias("components")).withColumn("part", every("parts")).drop("parts")
    odd = full.where("label != usual").withColumn("part", dealt("parts")).withColumn("block", every("blocks") if whole else dealt("blocks"))
    met = odd.groupBy("bucket", "block", "part").agg(F.collect_list(F.struct("label", here.alias("line"))).alias("odd")).join(rows, ["bucket", "block", "part"])
    if large:
        with_set = lambda x: x.withField("set", shingle_set(x["line"], how)).dropFields("line")
        sets = F.struct(
            F.transform("odd", lambda o: o.withField("line", with_set(o["line"]))).alias("odd"),
            F.transform("components", lambda c: c.withField("lines", F.transform(c["lines"], with_set))).alias("components"),
        )
        # Of one element, which is made once: a column is built anew wherever it is named.
        met = met.select("bucket", F.explode(F.array(sets)).alias("x")).select("bucket", "x.odd", "x.components")

    def linked(x, y):
        first = F.array_min(F.array_intersect(x["keys"], y["keys"])) == F.col("bucket")
        return possible(x, y, how) & first & (enough(x["set"], y["set"], how) if large else alike(x["line"], y["line"], how))

    def others(o):
        found = F.filter("components", lambda c: (c["label"] != o["label"]) & F.exists(c["lines"], lambda x: linked(x, o["line"])))
        return F.transform(found, lambda c: F.struct(o["label"].alias("label"), c["label"].alias("other")))

    found = met.select(F.explode(F.flatten(F.transform("odd", others))).alias("x")).select("x.label", "x.other")
    return found.select(F.greatest("label", "other").alias("a"), F.least("label", "other").alias("b")).distinct()


def of_components(shared: DataFrame, roots: DataFrame) -> DataFrame:
    return shared.join(roots, F.col("line_key") == F.col("node"), "left").select("bucket", "line_key", F.coalesce("root", "line_key").alias("label"))


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots of the components after more links, which join the components' roots alone: lines inside components take no part in the rounds."""
    links = written(links, "line-links")
    if links.isEmpty():
        return roots
    root = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    ends = links.join(root("a"), "a", "left").join(root("b"), "b", "left")
    moved = components(ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    again = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    return written(again.select("node", F.coalesce("to", "root").alias("root")).union(moved), "line-roots")


def decided(docs: DataFrame, how: Lines = Lines()) -> DataFrame:
    """doc_id, text_key, line_no, rep_doc_id, rep_line_no, kept of each line with more than white space."""
    roots = roots_of(docs, how)
    lines = lines_of(docs).select("doc_id", "text_key", "line_no", "line_key")
    labelled = written(lines.join(roots, F.col("line_key") == F.col("node"), "left").select("doc_id", "text_key", "line_no", F.coalesce("root", "line_key").alias("label")).distinct(), "line-labels")
    here = F.struct("doc_id", "text_key", "line_no")
    # A table of its own, so that the join below isn't tied to the grouping and a very common label can be split.
    firsts = written(labelled.groupBy("label").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "line-firsts")
    found = labelled.join(firsts, "label", "left").withColumn("first", F.coalesce("first", here))
    return found.select("doc_id", "text_key", "line_no", F.col("first.doc_id").alias("rep_doc_id"), F.col("first.line_no").alias("rep_line_no"), here.eqNullSafe(F.col("first")).alias("kept"))


def cleaned(docs: DataFrame, how: Lines = Lines()) -> DataFrame:
    """`docs` without the lines that a similar earlier line stands for. Texts that lose nothing stay as they are; one that loses all its lines becomes empty."""
    gone = decided(docs, how).where("not kept").groupBy(F.col("doc_id").alias("gone id"), F.col("text_key").alias("gone key")).agg(F.collect_list("line_no").alias("gone lines"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("gone id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("gone key"))
    lost = F.map_from_arrays(F.col("gone lines"), F.col("gone lines"))
    left = F.array_join(F.filter(F.split(F.col("text").cast("string"), "\n", -1), lambda x, i: ~F.map_contains_key(lost, i)), "\n")
    text = F.when(F.col("gone lines").isNull(), F.col("text").cast("string")).otherwise(left)
    return docs.join(gone, same, "left").withColumn("text", text).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    found = decided(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("line_no").cast("long"), "rep_doc_id", F.col("rep_line_no").cast("long"), "kept")
