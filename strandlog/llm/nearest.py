"""Approximate nearest neighbours by cosine: inverted file, product-quantised residuals, asymmetric tables, exact reranking.

Equal vectors are one entry with its smallest ids, so that copies cost nothing. Directions are unit vectors; coarse centroids and
residual codebooks are fitted with k-means on a sample of at most `sample` entries, those with the least hashes. Every entry is
indexed: it goes to its nearest centroid's list with the code of its residual. A query, one for all its copies, probes its
nearest lists, as many as a measurement asks for: some of the table's own queries are compared with all entries, and the lists of what is nearest to them tell
how many hold enough of it; few where vectors form clusters, many where directions are near random. In each block of a list the asymmetric tables rank the codes. How far an entry is from what its code
stands for bounds the tables' error, so that only entries that can't be among the nearest are left out, whatever the codebooks are like; the others are scored exactly in double precision on the original vectors, and the best of all lists are merged.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, neither do those without the
commonest length. Rows with a null id take no part. Rows that repeat an id and a vector are one candidate; an id with
several vectors is a candidate with each. Ties go to the smaller id. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pylist, table, written


@dataclass(frozen=True)
class IVFPQ:
    k: int = 5
    #: Entries that centroids and codebooks are fitted on, at most; all entries are indexed.
    sample: int = 16_384
    #: Lists: the root of the number of entries, at most this; a sixteenth of the sample, so that each centroid has rows to fit.
    most_lists: int = 1024
    parts: int = 16
    codes: int = 256
    #: A query probes as many lists as hold this share of the measured queries' nearest neighbours, at least this many.
    share: float = 0.97
    least_probes: int = 8
    #: Queries that this is measured with, at most, each against all entries.
    probe_sample: int = 256
    #: Entries that the probed lists of a query hold together at least, as far as there are as many.
    least_probed: int = 256
    #: Entries of a list that one task searches.
    block: int = 8192
    rounds: int = 12
    seed: int = 5


def kmeans(x: np.ndarray, k: int, rounds: int, rng) -> np.ndarray:
    """Centroids of x; k-means++ seeding would cost k passes, so seeds are drawn rows; empty clusters get drawn rows again."""
    k = min(k, len(x))
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest_of(x, centroids)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, x)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centroids


def nearest_of(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids * centroids).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centroids.T - half, 1) for i in range(0, len(x), 4096)] or [np.empty(0, int)])


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray
    cuts: tuple[tuple[int, int], ...]
    codebooks: tuple[np.ndarray, ...]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and residual code of each unit vector."""
        at = nearest_of(x, self.centroids)
        rest = x - self.centroids[at]
        codes = np.stack([nearest_of(rest[:, a:b], book) for (a, b), book in zip(self.cuts, self.codebooks)], 1).astype(np.uint8)
        return at, codes

    def errors(self, x: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Distance of each unit vector of a list from what its code stands for: the tables' inner products are wrong by no more."""
        rest = x - self.centroids[at]
        for (a, b), book, c in zip(self.cuts, self.codebooks, codes):
            rest[:, a:b] -= book[c]
        return np.sqrt((rest * rest).sum(1))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """parts x codes: inner products of the query's parts with the codewords."""
        out = np.zeros((len(self.cuts), 256))
        for k, ((a, b), book) in enumerate(zip(self.cuts, self.codebooks)):
            out[k, : len(book)] = book @ q[a:b]
        return out


def fitted(x: np.ndarray, lists: int, how: IVFPQ) -> Index:
    rng = np.random.default_rng(how.seed)
    centroids = kmeans(x, lists, how.rounds, rng)
    rest = x - centroids[nearest_of(x, centroids)]
    edges = np.linspace(0, x.shape[1], min(how.parts, x.shape[1]) + 1).astype(int)
    cuts = tuple(zip(edges[:-1].tolist(), edges[1:].tolist()))
    return Index(centroids, cuts, tuple(kmeans(rest[:, a:b], how.codes, how.rounds, rng) for a, b in cuts))


def probes_for(x: np.ndarray, lists: list[list[int]], index: Index, how: IVFPQ) -> int:
    """Lists to probe: the rank, among a query's lists, below which the given share of the true neighbours lie. `lists` holds those of each query's neighbours."""
    ranks = []
    for q, own in zip(x, lists):
        order = np.empty(len(index.centroids), int)
        order[np.argsort(((index.centroids - q) ** 2).sum(1), kind="stable")] = np.arange(len(order))
        ranks += order[own].tolist()
    return max(how.least_probes, int(np.quantile(ranks, how.share, method="higher")) + 1) if ranks else how.least_probes


def candidates(near: np.ndarray, error: np.ndarray, k: int) -> np.ndarray:
    """Places of all entries that can be among the k nearest, by inner products that are wrong by no more than `error`."""
    if len(near) <= k:
        return np.arange(len(near))
    sure = np.partition(near - error, -k)[-k]
    return np.flatnonzero(near + error >= sure - 1e-9)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows over their lengths; scaled by the largest component first, so that no square over- or underflows."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of q with each row of v, in double precision; each row's sum is taken in the same order whatever the rows around it."""
    big_q, big_v = np.abs(q).max(), np.abs(v).max(1)
    q, v = q / 2.0 ** np.floor(np.log2(big_q)), v / 2.0 ** np.floor(np.log2(big_v))[:, None]
    return (v * q).sum(1) / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum(1)))


def drawn(entries: DataFrame, n: int, most: int) -> list:
    """Rows of entries (place, entry, vector), `most` or all: of those with small hashes, a little more than asked for, the smallest, so that no partition sends a sample of its own to the driver."""
    place, space = F.pmod(F.xxhash64("entry"), F.lit(1 << 40)), 1 << 40
    found = entries.where(place < min(space, math.ceil((1.05 * most + 64) / n * space))).select(place.alias("place"), "entry", "vector").collect()
    return sorted(found, key=lambda r: (r["place"], bytes(r["entry"])))[:most]


def rows_of(vectors) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), -1)


def neighbours_of(asked: list, coded: DataFrame, k: int) -> list[list[int]]:
    """Lists of the k nearest entries of each of some queries, of all entries: a task keeps the k best of its own."""
    spark = coded.sparkSession
    sent = spark.sparkContext.broadcast((unit(rows_of([r["vector"] for r in asked])), {bytes(r["entry"]): j for j, r in enumerate(asked)}))

    def run(batches):
        q, place = sent.value
        score, at = np.empty((len(q), 0)), np.empty((len(q), 0), int)
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                s = q @ unit(rows_of(pylist(part, "vector"))).T
                for row, entry in enumerate(pylist(part, "entry")):
                    if (own := place.get(bytes(entry))) is not None:
                        s[own, row] = -np.inf
                score = np.concatenate([score, s], 1)
                at = np.concatenate([at, np.broadcast_to(np.array(pylist(part, "list"), int), s.shape)], 1)
                if score.shape[1] > k:
                    best = np.argpartition(-score, k - 1, 1)[:, :k]
                    score, at = np.take_along_axis(score, best, 1), np.take_along_axis(at, best, 1)
        if score.shape[1]:
            j = np.repeat(np.arange(len(q)), score.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(-score.ravel()), pa.array(at.ravel(), pa.int32())], names=["query", "far", "list"])

    found = coded.select("entry", "vector", "list").mapInArrow(run, "query int, far double, list int").where("far < double('infinity')")
    best = found.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "list"))), 1, k).alias("best"))
    return [[x["list"] for x in r["best"]] for r in best.orderBy("query").collect()]


ENTRY = "entry binary, vector binary, ids array<long>"


def entries_of(vectors: DataFrame, k: int) -> DataFrame:
    """entry (a hash), vector (doubles), ids (the k + 1 smallest) of each distinct vector."""
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    usable = usable.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = usable.groupBy(F.size("v").alias("d")).count()
    usual = sizes.agg(F.max(F.struct("count", F.negative("d").alias("d"))).alias("x")).select((-F.col("x.d")).alias("d"))

    def run(batches):
        import xxhash

        found: dict[bytes, list] = {}
        for batch in batches:
            for i, v in zip(pylist(batch, "vec_id"), pylist(batch, "v")):
                data = (np.array(v, "<f8") + 0.0).tobytes()
                own = found.setdefault(xxhash.xxh3_128_digest(data), [data, []])
                if i not in own[1]:
                    own[1] = sorted([*own[1], i])[: k + 1]
            if len(found) >= 20_000:
                yield batch_of(found)
                found = {}
        if found:
            yield batch_of(found)

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([x[0] for x in found.values()], pa.binary()), pa.array([x[1] for x in found.values()], pa.list_(pa.int64()))], names=["entry", "vector", "ids"])

    here = usable.join(F.broadcast(usual), F.size("v") == F.col("d")).select("vec_id", "v").mapInArrow(run, ENTRY)
    return here.groupBy("entry").agg(F.first("vector").alias("vector"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))


def searched(vectors: DataFrame, is_query, how: IVFPQ = IVFPQ()) -> DataFrame:
    """query_id, rank, vec_id, score. `is_query` is a condition on vec_id that names the queries; every vector is a candidate."""
    spark, k = vectors.sparkSession, how.k
    schema = "query_id long, rank int, vec_id long, score double"
    entries = written(entries_of(vectors, k), "nearest-entries")
    n = entries.count()
    if not n:
        return spark.createDataFrame([], schema)
    sample = drawn(entries, n, how.sample)
    x = unit(rows_of([r["vector"] for r in sample]))
    lists = max(1, min(how.most_lists, round(n**0.5), len(x) // 16))
    index = spark.sparkContext.broadcast(fitted(x, lists, how))

    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                v = np.frombuffer(b"".join(pylist(batch, "vector")), "<f8").reshape(batch.num_rows, -1)
                at, codes = index.value.encode(unit(v))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["entry", "vector", "ids", "list", "code"])

    coded = written(entries.mapInArrow(encode, ENTRY + ", list int, code binary"), "nearest-index")
    sizes = np.zeros(lists, int)
    for r in coded.groupBy("list").count().collect():  # at most `most_lists` rows
        sizes[r["list"]] = r["count"]
    blocks = np.maximum(1, -(-sizes // how.block))
    asked = vectors.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("query_id").isNotNull()).withColumnRenamed("query_id", "vec_id").where(is_query)

    def hashed(batches):
        import xxhash

        for batch in batches:
            data = [None if v is None or None in v else (np.array(v, "<f8") + 0.0).tobytes() for v in pylist(batch, "v")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if d is None else xxhash.xxh3_128_digest(d) for d in data], pa.binary())], names=["query_id", "entry"])

    queries = written(asked.mapInArrow(hashed, "query_id long, entry binary").distinct().join(entries.select("entry"), "entry", "left_semi"), "nearest-queries")
    sought = written(entries.join(queries.select("entry").distinct(), "entry", "left_semi").select("entry", "vector"), "nearest-sought")
    if not (m := sought.count()):
        return spark.createDataFrame([], schema)
    measured = drawn(sought, m, how.probe_sample)
    probed = probes_for(unit(rows_of([r["vector"] for r in measured])), neighbours_of(measured, coded, k), index.value, how)

    def probe(batches):
        own = index.value
        half = (own.centroids * own.centroids).sum(1) / 2
        for batch in batches:
            out = []
            for entry, data in zip(pylist(batch, "entry"), pylist(batch, "vector")):
                order = np.argsort(half - own.centroids @ unit(np.frombuffer(data, "<f8")[None])[0], kind="stable")
                enough = int(np.searchsorted(np.cumsum(sizes[order]), how.least_probed)) + 1
                out += [(int(c), b, entry, data) for c in order[: max(probed, enough)] if sizes[c] for b in range(blocks[c])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["list", "block", "query", "vector"])

    probes = sought.mapInArrow(probe, "list int, block int, query binary, vector binary")
    per_list = F.array(*[F.lit(int(b)) for b in blocks])
    placed = coded.withColumn("block", F.pmod(F.xxhash64("entry"), F.element_at(per_list, F.col("list") + 1)).cast("int"))

    def search(key, left, right):
        import pandas as pd

        out = []
        if len(left) and len(right):
            own, centroid = index.value, index.value.centroids[key[0]]
            v = rows_of(left["vector"].to_list())
            codes = np.frombuffer(b"".join(left["code"]), np.uint8).reshape(len(left), -1).T
            ids = left["ids"].to_list()
            x = unit(v)
            error = own.errors(x, key[0], codes)
            for query, data in zip(right["query"], right["vector"]):
                q = np.frombuffer(data, "<f8")
                u = unit(q[None])[0]
                near = u @ centroid + sum(t[c] for t, c in zip(own.tables(u), codes))
                best = candidates(near, error, k + 1)
                # of these the nearest by whole vectors, with all that rounding may put among them
                close = x[best] @ u
                best = best[candidates(close, np.full(len(best), 1e-12), k + 1)]
                score = cosines(q, v[best])
                top = sorted((-s, i) for s, b in zip(score.tolist(), best) for i in ids[b])[: k + 1]
                out += [(query, s, i) for s, i in top]
        return pd.DataFrame(out, columns=["entry", "far", "vec_id"])

    found = placed.select("list", "block", "vector", "ids", "code").groupBy("list", "block").cogroup(probes.groupBy("list", "block")).applyInPandas(search, "entry binary, far double, vec_id long")
    best = found.groupBy("entry").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "vec_id"))), 1, k + 1).alias("best"))
    answers = queries.join(best, "entry").select("query_id", F.posexplode(F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("pos", "x"))
    return answers.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.far")).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return searched(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
