"""Near-duplicate documents: MinHash, banding, signature verification, exact verification, connected components.

A document's set holds the 64-bit hashes of its distinct word shingles. Documents with equal sets are one class, joined at once.
Every class has `bands * rows` universal hash minima; classes that agree on all rows of a band share a bucket. Within a
bucket, links are looked for in three steps, so that a bucket of n classes never gives n * n pairs:

1. every class is compared with one hub, the least class of the bucket that it shares the most bands with;
2. classes that are still in different components are compared with the least and the largest class of each shared bucket;
3. classes of a bucket that are still in different components are compared in blocks within a task, by signature and then on the
   full sets; only links leave it. Pairs within a component need no test: they are connected already.

All links are confirmed on the full sets. The components of the links are found by large-star and small-star.

Defined results: a text without words (or null) has an empty set and is linked with nothing. A text with fewer words than a shingle has its
whole sequence as one shingle. Repeated rows are copies of each other. A null doc_id takes part; the smallest id of a component leaves nulls out, and
`kept` is false for it unless the whole component has none. An empty table gives an empty result. Other columns are ignored, or carried by `kept_documents`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, pylist, slices, table, written
from .components import components

MASK = (1 << 64) - 1
#: Distinct words whose hashes a Python worker keeps at a time, twice over.
WORDS_KEPT = 200_000
WORDS = Recent(WORDS_KEPT)


@dataclass(frozen=True)
class Near:
    shingle: int = 5
    #: Least similarity, in hundredths.
    percent: int = 80
    bands: int = 25
    rows: int = 5
    #: Standard deviations of the estimate that a link's signature may fall below the limit: about one link in three million, at the limit itself, falls below five.
    slack: float = 5.0
    seed: int = 20_240_607

    @property
    def least_agreement(self) -> float:
        p = self.percent / 100
        return p - self.slack * (p * (1 - p) / (self.bands * self.rows)) ** 0.5

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        drawn = np.random.default_rng(self.seed).integers(0, MASK, (2, self.bands * self.rows), np.uint64, endpoint=True)
        return drawn[0] | np.uint64(1), drawn[1]


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    def of(w):
        found = WORDS.find(w)
        if found is None:
            WORDS.put(w, found := xxhash.xxh3_64_intdigest(w))
        return found

    return np.fromiter(map(of, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of k words; words are lower-cased in A-Z and parted by ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    k = min(k, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of (a * x + b) mod 2**64, of which the upper 32 bits stay; in blocks that fit in the cache."""
    least = np.full(len(a), MASK, np.uint64)
    for i in range(0, len(shingles), 512):
        least = np.minimum(least, (shingles[i : i + 512, None] * a + b).min(0))
    return (least >> np.uint64(32)).astype("<u4")


def text_hash():
    return F.xxhash64(F.col("text").cast("string"))


def sketches(docs: DataFrame, near: Near) -> DataFrame:
    """doc_id, text_hash, n, class (16 bytes that stand for the set), signature."""

    def run(batches):
        import xxhash

        a, b = near.factors()
        for batch in slices(batches, "text"):
            n, classes, signatures = [], [], []
            for text in pylist(batch, "text"):
                found = shingle_set(text, near.shingle)
                n.append(len(found))
                classes.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                signatures.append(signature(found, a, b).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(classes, pa.binary()), pa.array(signatures, pa.binary())], names=["doc_id", "text_hash", "n", "class", "signature"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash().alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, n long, class binary, signature binary")


def bucketed(classes: DataFrame, near: Near) -> DataFrame:
    """band, bucket, class: a row for each class and band."""
    size = 4 * near.rows
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("signature", i * size + 1, size)) for i in range(near.bands)])
    return classes.select("class", F.posexplode(keys).alias("band", "bucket"))


def verified(pairs: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches):
        for batch in slices(batches, "set_a"):
            keep = []
            for x, y in zip(pylist(batch, "set_a"), pylist(batch, "set_b")):
                keep.append(similar(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), near.percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: sets.select(F.col("class").alias(x), F.col("shingles").alias(f"set_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a binary, b binary")


def agreeing(pairs: DataFrame, classes: DataFrame, near: Near) -> DataFrame:
    """The pairs whose signatures agree often enough."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(pylist(batch, c)), "<u4").reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array((x == y).mean(1) >= near.least_agreement))

    side = lambda x: classes.select(F.col("class").alias(x), F.col("signature").alias(f"sig_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a binary, b binary")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def labelled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """`members` (class, ...) with `label`, the root of the class's component so far."""
    return members.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("label", F.coalesce("root", "class")).drop("root")


#: Classes of a bucket that a task compares at a time.
BLOCK = 512


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches the percentage."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def cross_links(mixed_buckets: DataFrame, near: Near) -> DataFrame:
    """Links (a, b) between classes of a bucket that have different labels, one at most for a class and a label in a block.

    Classes that don't have the bucket's commonest label are its odd ones. They are compared with all classes of the bucket: both are
    dealt to blocks, every block of the bucket meets every block of odd ones, and a task compares the two in memory, by signature
    and then on the full sets. No pair leaves a task but a link. A pair that shares several bands is compared in the first of them.
    """
    odd_of = F.col("label") != F.col("usual")
    sized = mixed_buckets.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("odd_blocks", F.ceil(F.col("n_odd") / BLOCK).cast("int"))
    deal = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = sized.withColumn("block", deal("blocks")).withColumn("odd_block", every("odd_blocks")).withColumn("odd", F.lit(False))
    odd = sized.where(odd_of).withColumn("odd_block", deal("odd_blocks")).withColumn("block", every("blocks")).withColumn("odd", F.lit(True))

    def run(key, pdf):
        import pandas as pd

        own, odd = pdf[~pdf["odd"]], pdf[pdf["odd"]]
        out = []
        if len(own) and len(odd):
            sig = np.frombuffer(b"".join(own["signature"]), "<u4").reshape(len(own), near.bands, near.rows)
            classes, labels = own["class"].to_list(), own["label"].to_list()
            sets = [np.frombuffer(x, "<u8") for x in own["shingles"]]
            for c, label, s, data in zip(odd["class"], odd["label"], odd["signature"], odd["shingles"]):
                same = sig == np.frombuffer(s, "<u4").reshape(near.bands, near.rows)
                agreement = same.mean((1, 2))
                here = (agreement >= near.least_agreement) & (same.all(2).argmax(1) == key[1])
                mine, done = np.frombuffer(data, "<u8"), {label}
                at = np.flatnonzero(here)
                for i in at[np.argsort(-agreement[at], kind="stable")]:
                    if labels[i] not in done and similar(mine, sets[i], near.percent):
                        done.add(labels[i])
                        out.append((c, classes[i]))
        return pd.DataFrame(out, columns=["a", "b"])

    both = own.unionByName(odd).select("bucket", "band", "block", "odd_block", "odd", "class", "label", "signature", "shingles")
    return both.groupBy("bucket", "band", "block", "odd_block").applyInPandas(run, "a binary, b binary")


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots of the components after more links."""
    if links.isEmpty():
        return roots
    return components(links.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def linked(docs: DataFrame, near: Near = Near()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches of all rows; classes with the smallest id; roots of the classes that are linked with others."""
    rows = written(sketches(docs, near), "near-sketches")
    classes = written(rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("first_id"), F.first("signature").alias("signature")), "near-classes")
    buckets = bucketed(classes, near)
    hubs = buckets.groupBy("bucket").agg(F.min("class").alias("hub"), F.max("class").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(buckets.join(hubs, "bucket"), "near-buckets")
    wanted = shared.select("class").distinct().join(classes, "class").select(F.col("first_id").alias("id")).distinct()

    def run(batches):
        import xxhash

        for batch in slices(batches, "text"):
            sets = [shingle_set(x, near.shingle).tobytes() for x in pylist(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], names=["class", "shingles"])

    # One text of each class that shares a bucket: the one with the smallest id.
    texts = docs.select(F.col("doc_id").cast("long").alias("first_id"), F.col("text").cast("string")).join(wanted, F.col("first_id").eqNullSafe(F.col("id")), "left_semi")
    sets = written(texts.select("text").mapInArrow(run, "class binary, shingles binary").join(shared.select("class").distinct(), "class", "left_semi").dropDuplicates(["class"]), "near-sets")

    favourite = shared.where("class != hub").groupBy("class", "hub").agg(F.count(F.lit(1)).alias("n")).groupBy("class").agg(F.max(F.struct("n", "hub")).alias("best"))
    tried = written(ordered(favourite.select(F.col("class").alias("a"), F.col("best.hub").alias("b"))), "near-pairs")
    roots = components(verified(tried, sets, near))

    known = written(labelled(shared, roots), "near-labels")
    of = lambda c: known.select(F.col("class").alias(c), F.col("label").alias(f"{c}_label")).distinct()
    to_hubs = known.select("class", "label", F.explode(F.array("hub", "last")).alias("end")).where("class != end").distinct().join(of("end"), "end").where("label != end_label")
    pairs = ordered(to_hubs.select(F.col("class").alias("a"), F.col("end").alias("b"))).join(tried, ["a", "b"], "left_anti")
    second = written(agreeing(pairs, classes, near), "near-pairs")
    roots = joined(roots, written(verified(second, sets, near), "near-links"))

    known = labelled(shared, roots)
    usual = known.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket").agg(F.max(F.struct("k", "label")).alias("top"), F.count(F.lit(1)).alias("labels"), F.sum("k").alias("all")).where("labels > 1")
    usual = usual.select("bucket", F.col("top.label").alias("usual"), (F.col("all") - F.col("top.k")).alias("n_odd"))
    mixed_buckets = known.join(usual, "bucket").join(classes.select("class", "signature"), "class").join(sets, "class")
    return rows, classes, joined(roots, written(ordered(cross_links(mixed_buckets, near)), "near-links"))


def decided(docs: DataFrame, near: Near) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for each row of `docs`."""
    rows, classes, roots = linked(docs, near)
    members = labelled(classes.select("class", "first_id"), roots)
    # A table of its own, so that the join isn't tied to the grouping and a large component can be split.
    smallest = written(members.groupBy("label").agg(F.min("first_id").alias("component"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"), "near-smallest")
    # `component` may be null where no member has an id; a class alone has no row here.
    joined_up = members.join(smallest.withColumn("several", F.lit(True)), "label", "left")
    component = joined_up.select("class", F.when(F.col("several"), F.col("component")).otherwise(F.col("first_id")).alias("component"))
    found = rows.select("doc_id", "text_hash", "n", "class").join(component, "class", "left")
    label = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return found.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), label.alias("component_id"), F.col("doc_id").eqNullSafe(label).alias("kept"))


def near_duplicates(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs`."""
    return decided(docs, near).drop("text_hash")


def kept_documents(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id, with the columns of `docs`; rows without words stay.

    Rows with one id and one text count as one document.
    """
    gone = decided(docs, near).where("not kept").select(F.col("doc_id").alias("gone id"), F.col("text_hash").alias("gone hash")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("gone id")) & (text_hash() == F.col("gone hash"))
    return docs.join(gone, same, "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Near(shingle=2))
