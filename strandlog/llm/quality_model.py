"""Quality classifier: regularised quadratic discriminant analysis over transformed statistics of documents.

A document becomes a vector of statistics of its text (lengths, shares, repetition, compression), each on a scale where it is
roughly normal within a class. The mean and covariance of each class come from sums of products over all labelled
training rows, added up in Spark. Covariances are shrunk towards the pooled one and towards a
multiple of the identity; their Cholesky factors are computed once. A score is the logistic function of the difference of the
classes' log densities (Mahalanobis terms and log determinants) with their log priors.

Defined results: null counts as empty, and has a score like any text. Labels other than 0 and 1 aren't learned from. Where either class has no
training row, every score is the share of class 1, or 0.5 without any row. Repeated rows have repeated scores;
several labels of a document count one by one. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pylist, slices, table, written
from .quality_rules import SYMBOLS, ratio_of, repeated_lines, repeated_words

NAMES = ("chars", "words", "word_mean", "word_spread", "word_longest", "symbols", "bars", "punctuation", "digits", "capitals", "short", "distinct", "repeated", "lines_again", "line_mean", "packed", "other", "ends")


def kind_of(c: str) -> int:
    return 5 if c in SYMBOLS else 6 if c in ".,;:!?" else 4 if c.isspace() else 3 if c.isdigit() else 2 if c.isupper() and c.isalpha() else int(c.isalpha())


#: By code point of the basic plane: 1 letter, 2 capital, 3 digit, 4 white space, 5 symbol, 6 punctuation, 0 any other.
KIND = np.array([kind_of(chr(x)) for x in range(0x10000)], np.uint8)


def log_odds(part: float, whole: float, prior: float = 0.5) -> float:
    return math.log((part + prior) / (whole - part + prior))


def statistics(text: str, ratio) -> list[float]:
    """The transformed statistics of a whole text; finite for any."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n, chars = len(words), len(text)
    sizes = np.fromiter(map(len, words), float, n) if n else np.zeros(1)
    lines = [x for x in text.split("\n") if x.strip()]
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = np.bincount(KIND[np.minimum(points, 0xFFFF)], minlength=7).tolist()
    letters, capitals, digits, spaces, symbols, punctuation = kinds[1] + kinds[2], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6]
    usual = ratio(data) if data else 1.0
    return [
        math.log1p(chars),
        math.log1p(n),
        math.log(sizes.mean() + 1),
        math.log(sizes.std() + 1),
        math.log(sizes.max() + 1),
        log_odds(symbols, max(chars, symbols)),
        log_odds(text.count("|"), max(chars, 1)),
        log_odds(punctuation, max(chars, 1)),
        log_odds(digits, max(chars, 1)),
        log_odds(capitals, max(letters, 1)),
        log_odds(int((sizes <= 3).sum()), max(len(sizes), 1)),
        log_odds(len(set(words)), max(n, 1)),
        log_odds(repeated_words(words), max(n, 1)),
        log_odds(repeated_lines(text), max(len(lines), 1)),
        math.log1p(chars / max(len(lines), 1)),
        math.log(usual),
        log_odds(max(chars - letters - digits - spaces - punctuation - symbols, 0), max(chars, 1)),
        log_odds(sum(x.rstrip()[-1:] in ".!?" for x in lines), max(len(lines), 1)),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, array<double>, for each row."""

    def run(batches):
        ratio = ratio_of(3)
        for batch in slices(batches, "text"):
            x = [statistics(t or "", ratio) for t in pylist(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    means: np.ndarray
    #: Inverses of the Cholesky factors.
    whiten: np.ndarray
    log_dets: np.ndarray
    log_priors: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = [((x - m) @ w.T) for m, w in zip(self.means, self.whiten)]
        logs = [p - 0.5 * (d + (y * y).sum(1)) for y, d, p in zip(z, self.log_dets, self.log_priors)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fitted(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pool: float = 0.2, ridge: float = 0.05) -> Discriminant | float:
    """From each class's count, sum and sum of products. A plain share where a class is missing."""
    n = {k: m[0] for k, m in moments.items()}
    if min(n.get(0, 0), n.get(1, 0)) < 1:
        return n.get(1, 0) / sum(n.values()) if sum(n.values()) else 0.5
    total = n[0] + n[1]
    means = [moments[k][1] / n[k] for k in (0, 1)]
    scatter = [moments[k][2] - n[k] * np.outer(m, m) for k, m in zip((0, 1), means)]
    pooled = (scatter[0] + scatter[1]) / total
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    whiten, dets = [], []
    for k in (0, 1):
        own = (1 - pool) * scatter[k] / n[k] + pool * pooled
        own = own / np.outer(scale, scale)
        own = (1 - ridge) * own + ridge * np.trace(own) / len(own) * np.eye(len(own)) + 1e-9 * np.eye(len(own))
        factor = np.linalg.cholesky(own)
        whiten.append(np.linalg.inv(factor) / scale)
        dets.append(2 * np.log(np.diag(factor)).sum() + 2 * np.log(scale).sum())
    return Discriminant(np.array(means), np.array(whiten), np.array(dets), np.log(np.array([n[0], n[1]]) / total))


def class_moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Sums over rows of x and y in {0, 1}: a row of sums for each task and class, added up by Spark."""
    d = len(NAMES)

    def run(batches):
        sums = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
        for batch in batches:
            if batch.num_rows:
                x = np.array(pylist(batch, "x"))
                y = np.array(pylist(batch, "y"))
                for k, s in sums.items():
                    own = x[y == k]
                    s[0] += len(own)
                    s[1 : 1 + d] += own.sum(0)
                    s[1 + d :] += (own.T @ own).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([sums[0], sums[1]], pa.list_(pa.float64()))], names=["y", "s"])

    sums = labelled.mapInArrow(run, "y int, s array<double>").select("y", F.posexplode("s")).groupBy("y", "pos").agg(F.sum("col").alias("s"))
    found = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
    for r in sums.collect():  # two classes, a few hundred sums each
        found[r["y"]][r["pos"]] = r["s"]
    return {k: (s[0], s[1 : 1 + d], s[1 + d :].reshape(d, d)) for k, s in found.items()}


def scored(docs: DataFrame, labels: DataFrame, held_out, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted. `labels` has doc_id and quality; `held_out`, a condition on doc_id, names the rows never learned from."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~F.coalesce(held_out, F.lit(False)))
    stats = written(with_statistics(docs), "quality-statistics")
    model = spark.sparkContext.broadcast(fitted(class_moments(stats.join(known, "doc_id").select("x", "y"))))

    def run(batches):
        own = model.value
        for batch in slices(batches, "x"):
            x = np.array(pylist(batch, "x"))
            score = np.full(len(x), own) if isinstance(own, float) else own.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    found = stats.mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)
