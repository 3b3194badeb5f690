"""Language-model scores: a log-bilinear model trained in numpy with noise-contrastive estimation.

Words are counted over all training texts. The vocabulary follows the counts: all words seen `least` times or more, the most frequent
`words` of them where there are more (a bound on memory), and one entry for all others. The model predicts a word's vector from those of
the two words before, each scaled by a vector of its place, and scores in two levels, by inner products and biases: first the word's
class, a run of words of about equal frequency, then the word within its class. There are about as many classes as the root of the
vocabulary. Every training text is learned from once, in `rounds` rounds of shards of texts. Hashes deal texts to shards, whose number follows the count of training tokens
(about `shard_tokens` each, at most `shards` a round), and order them, so that the result doesn't depend on partitions. In a round every shard trains from one common start; a
row's changes, and what was added to its squared gradients, are averaged, weighted by how often each shard changed it, first over the two shards of a task, which sends the rows that they changed, then in Spark; the next round goes on from both. Scores are normalised: softmax over the classes, for each
distinct context once, times softmax over the words of the class, both from matrix products. Another word has the entry of others'
probability times its share of it by counts plus one, where unseen words are one more word; so that probabilities sum to one over all words.

Counts of about the `broadcast_words` most frequent words, and of the end, go to all tasks; those of the others are joined. The result doesn't depend on how many there are,
as long as the model's own words are among them.

Texts are split into words twice, for counting and for numbering; training and scoring read numbers.

Defined results: null counts as empty; an empty text is its end token. A null id is not held out. Repeated rows are
texts like any other. A text is numbered, learned from and scored whole, in the memory of one row, however long it is. An empty table gives an empty result; where nothing is left to train on, counts are zero and the model is uniform. Other
columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pylist, slices, table, written

#: Words that a task holds before it counts them, about, or one text's.
WORDS_HELD = 4_000_000
#: The end of a text, counted as a token; no word is empty.
END = b""


@dataclass(frozen=True)
class Bilinear:
    #: The most words that the model knows, the end included; all others are one entry.
    words: int = 1 << 15
    #: Words seen less often in training are others.
    least: int = 8
    #: Words whose counts are broadcast.
    broadcast_words: int = 100_000
    width: int = 32
    #: Noise classes of a batch, and noise words of a position within the class of its word.
    noise: int = 32
    noise_words: int = 8
    batch: int = 8192
    rounds: int = 2
    shard_tokens: int = 1 << 20
    shards: int = 4096
    rate: float = 0.2
    seed: int = 11


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in order, as binaries, and the number of each text's."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = cut.flatten().cast(pa.binary())
    full = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty piece
    of_text = np.repeat(np.arange(len(texts)), np.diff(cut.offsets.to_numpy()))[full.to_numpy(zero_copy_only=False)]
    return words.filter(full), np.bincount(of_text, minlength=len(texts))


def counted(docs: DataFrame) -> DataFrame:
    """word, n over all texts, ends included."""

    def run(batches):
        held, n = [], 0
        for batch in slices(batches, "text"):
            held += [words_of(batch.column(0))[0], pa.array([END] * batch.num_rows, pa.binary())]
            n += len(held[-2])
            if n > WORDS_HELD:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    def flush(held):
        return pa.RecordBatch.from_arrays(list(pa.chunked_array(held).value_counts().flatten()), names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def commonest(counts: DataFrame, most: int) -> DataFrame:
    """The rows of `counts` (word, n) with the largest n, `most` at the most and about as many where there are more; rows of about equal n are chosen by their hashes.

    Histograms find the limits, so that no partition sends its own `most` rows to the driver.
    """
    level, place = F.floor(16 * F.log2("n")), F.pmod(F.xxhash64("word"), F.lit(4096))
    sizes = sorted(((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)  # some hundred rows
    room, least = most, None
    for at, size in sizes:
        if size > room:
            break
        room, least = room - size, at
    else:
        return counts
    places = sorted((r["place"], r["count"]) for r in counts.where(level == at).groupBy(place.alias("place")).count().collect())
    end = 0
    for k, size in places:
        if size > room:
            break
        room, end = room - size, k + 1
    above = F.lit(False) if least is None else level >= least
    return counts.where(above | ((level == at) & (place < end)))


def classes(share: np.ndarray) -> np.ndarray:
    """First entries of the classes, and the end: the others alone, then runs of equal sums of the roots of shares."""
    n = len(share)
    mass = np.cumsum(np.sqrt(share[1:]))
    if n == 1:
        return np.array([0, 1])
    cuts = np.searchsorted(mass, mass[-1] * np.arange(1, math.isqrt(n - 1) + 1) / math.isqrt(n - 1))
    return np.unique(np.concatenate([[0, 1], np.minimum(cuts + 2, n), [n]]))


@dataclass
class Parameters:
    """Vectors of context words, scales of the two places, vectors and biases of predicted classes and of predicted words."""

    context: np.ndarray
    scale: np.ndarray
    klass: np.ndarray
    klass_bias: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    #: First entries of the classes, and the class of each entry; these aren't trained.
    starts: np.ndarray
    class_of: np.ndarray

    @staticmethod
    def start(log_share: np.ndarray, how: Bilinear) -> "Parameters":
        """Near the shares of the words themselves, whatever the context."""
        rng = np.random.default_rng(how.seed)
        share = np.exp(log_share)
        starts = classes(share)
        class_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        klass_bias = np.log(np.add.reduceat(share, starts[:-1]))
        draw = lambda n: rng.normal(0, 0.1, (n, how.width)).astype(np.float32)
        bias = log_share - klass_bias[class_of]
        return Parameters(draw(len(share)), np.ones((2, how.width), np.float32), draw(len(klass_bias)), klass_bias.astype(np.float32), draw(len(share)), bias.astype(np.float32), starts, class_of)

    @property
    def trained(self) -> tuple[np.ndarray, ...]:
        return self.context, self.scale, self.klass, self.klass_bias, self.target, self.bias

    def copied(self) -> "Parameters":
        return Parameters(*(x.copy() for x in self.trained), self.starts, self.class_of)

    def predicted(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.context[one] * self.scale[0] + self.context[two] * self.scale[1]

    def log_probabilities(self, one: np.ndarray, two: np.ndarray, word: np.ndarray, block: int = 1 << 18) -> np.ndarray:
        """Normalised natural log probability of each word after its two words; each distinct context of a block has its classes' softmax once."""
        out = np.empty(len(word))
        for i in range(0, len(word), block):
            out[i : i + block] = self._of_block(one[i : i + block], two[i : i + block], word[i : i + block])
        return out

    def _of_block(self, one: np.ndarray, two: np.ndarray, word: np.ndarray, rows: int = 512) -> np.ndarray:
        k = len(self.bias)
        contexts, at = np.unique(one.astype(np.int64) * k + two, return_inverse=True)
        q, group = self.predicted(contexts // k, contexts % k), self.class_of[word]
        norms = np.empty(len(contexts))
        length = lambda x: float(np.sqrt(np.einsum("ij,ij->i", x, x).max()))
        small = length(q) * max(length(self.klass), length(self.target)) + float(max(np.abs(self.klass_bias).max(), np.abs(self.bias).max())) < 60  # bounds every logit
        for i in range(0, len(contexts), rows):  # few rows at a time stay in the processor's caches
            norms[i : i + rows] = log_sums(q[i : i + rows] @ self.klass.T + self.klass_bias, small)
        q = q[at]
        out = np.einsum("ij,ij->i", q, self.klass[group]) + self.klass_bias[group] - norms[at]
        order = np.argsort(group.astype(np.uint16) if len(self.starts) <= 1 << 16 else group, kind="stable")
        bounds = np.searchsorted(group[order], np.arange(len(self.starts)))
        for c in np.flatnonzero((np.diff(bounds) > 0) & (np.diff(self.starts) > 1)):
            first, end = self.starts[c], self.starts[c + 1]
            for i in range(bounds[c], bounds[c + 1], rows):
                own = order[i : min(i + rows, bounds[c + 1])]
                logits = q[own] @ self.target[first:end].T + self.bias[first:end]
                cells = logits[np.arange(len(own)), word[own] - first]
                out[own] += cells - log_sums(logits, small)
        return out


def log_sums(logits: np.ndarray, small: bool = False) -> np.ndarray:
    """Logarithm of the sum of the exponentials of each row; the argument is overwritten. Small logits need no shift to stay in range."""
    if small:
        return np.log(np.exp(logits, out=logits).sum(1)).astype(np.float64)
    top = logits.max(1)
    logits -= top[:, None]
    np.exp(logits, out=logits)
    return np.log(logits.sum(1)).astype(np.float64) + top


class Trainer:
    """Noise-contrastive estimation by AdaGrad with one step size a row, of classes and of words within their class.

    The noise classes of a batch are drawn by their shares and shared by its positions; the noise words of a class are drawn by their shares in it and
    shared by the batch's positions of that class, so that both are matrix products.
    """

    def __init__(self, p: Parameters, share: np.ndarray, how: Bilinear, seed: int, squares: list[np.ndarray] | None = None):
        self.p, self.how = p, how
        self.rng = np.random.default_rng([how.seed, seed])
        self.cumulated = np.concatenate([[0.0], np.cumsum(share)])
        of_class = np.add.reduceat(share, p.starts[:-1])
        self.class_cumulated = np.cumsum(of_class)
        self.log_class = np.log(how.noise * of_class).astype(np.float32)
        self.log_word = np.log(how.noise_words * share / of_class[p.class_of]).astype(np.float32)
        #: Mean squared gradients of each row, added up.
        self.squares = [x.copy() for x in squares] if squares else first_squares(p)
        #: How often each row was changed.
        self.changes = [np.zeros(len(x), np.int64) for x in p.trained]

    def update(self, which: int, rows: np.ndarray | slice, g: np.ndarray, n: int) -> None:
        """A step of AdaGrad with the summed values of each row, named once."""
        x, s = self.p.trained[which], self.squares[which]
        g = g * np.float32(n**-0.5)
        square = s[rows] + (g * g if g.ndim == 1 else np.einsum("ij,ij->i", g, g) / g.shape[1])
        s[rows] = square
        rate = np.float32(self.how.rate) / np.sqrt(square)
        g *= rate if g.ndim == 1 else rate[:, None]
        x[rows] -= g
        self.changes[which][rows] += 1

    def summed(self, which: int, rows: np.ndarray, values: np.ndarray, n: int) -> None:
        """A step with the values of rows that may be named several times."""
        order = np.argsort(rows.astype(np.uint16) if len(self.p.trained[which]) <= 1 << 16 else rows, kind="stable")  # 16 bits are sorted by radix
        rows = rows[order]
        first = firsts(rows)
        self.update(which, rows[first], np.add.reduceat(values[order], first), n)

    def step(self, run: np.ndarray, at: np.ndarray) -> None:
        """Learns the words at the places `at` of `run`, each after the two before it; places are named once."""
        p, n = self.p, len(at)
        word = run[at]
        order = np.argsort(word.astype(np.uint16) if len(p.bias) <= 1 << 16 else word, kind="stable")  # by word, so by class
        at, word = at[order], word[order]
        a, b = p.context[run[at - 1]], p.context[run[at - 2]]
        q = a * p.scale[0]
        q += b * p.scale[1]
        # Classes.
        group = p.class_of[word]
        noise = np.minimum(np.searchsorted(self.class_cumulated, self.rng.random(self.how.noise) * self.class_cumulated[-1]), len(p.klass_bias) - 1)
        d_q, m = p.klass[group], p.klass[noise]
        real = falling(np.einsum("ij,ij->i", q, d_q) + p.klass_bias[group] - self.log_class[group])
        fake = rising(q @ m.T + (p.klass_bias[noise] - self.log_class[noise]))
        d_q *= real[:, None]
        d_q += fake @ m
        first = firsts(group)
        rows = np.concatenate([group[first], noise])
        class_values = np.concatenate([np.add.reduceat(real[:, None] * q, first), fake.T @ q])
        class_bias_values = np.concatenate([np.add.reduceat(real, first), fake.sum(0)])
        # Words within their class; a word alone in its class has nothing to learn.
        runs = list(zip(first.tolist(), [*first[1:].tolist(), n]))
        low, high = p.starts[group[first]], p.starts[group[first] + 1]
        draws = self.cumulated[low][:, None] + self.rng.random((len(first), self.how.noise_words)) * (self.cumulated[high] - self.cumulated[low])[:, None]
        drawn = np.clip(np.searchsorted(self.cumulated, draws, "right") - 1, low[:, None], high[:, None] - 1)
        m, offset = p.target[drawn], p.bias[drawn] - self.log_word[drawn]
        t = p.target[word]
        real = falling(np.einsum("ij,ij->i", q, t) + p.bias[word] - self.log_word[word])
        fake = np.empty((n, self.how.noise_words), np.float32)
        for k, (i, j) in enumerate(runs):
            np.matmul(q[i:j], m[k].T, out=fake[i:j])
            fake[i:j] += offset[k]
        fake = rising(fake)
        alone = np.repeat(high - low == 1, np.diff([*first, n]))
        real[alone], fake[alone] = 0, 0
        t *= real[:, None]
        d_q += t
        fake_values = np.empty_like(m)
        for k, (i, j) in enumerate(runs):
            d_q[i:j] += fake[i:j] @ m[k]
            np.matmul(fake[i:j].T, q[i:j], out=fake_values[k])
        several = high - low > 1
        if several.any():
            of_word = firsts(word)
            of_word_kept = ~alone[of_word]
            word_rows = np.concatenate([word[of_word][of_word_kept], drawn[several].ravel()])
            values = np.concatenate([np.add.reduceat(real[:, None] * q, of_word)[of_word_kept], fake_values[several].reshape(-1, q.shape[1])])
            bias_values = np.concatenate([np.add.reduceat(real, of_word)[of_word_kept], np.add.reduceat(fake, first)[several].ravel()])
            self.summed(4, word_rows, values, n)
            self.summed(5, word_rows, bias_values, n)
        self.summed(2, rows, class_values, n)
        self.summed(3, rows, class_bias_values, n)
        # A place is the first word before one place and the second before the next, at the most.
        start = at.min() - 2
        g = np.zeros((at.max() - start, q.shape[1]), np.float32)
        g[at - 1 - start] = d_q * p.scale[0]
        g[at - 2 - start] += d_q * p.scale[1]
        used = np.zeros(len(g), bool)
        used[at - 1 - start] = used[at - 2 - start] = True
        used = np.flatnonzero(used)
        self.update(1, slice(None), np.stack([np.einsum("ij,ij->j", d_q, a), np.einsum("ij,ij->j", d_q, b)]), n)
        self.summed(0, run[used + start], g[used], n)


def first_squares(p: Parameters) -> list[np.ndarray]:
    return [np.full(len(x), 1e-5, np.float32) for x in p.trained]


def firsts(rows: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))


def falling(score: np.ndarray) -> np.ndarray:
    """Derivative of the loss by the score of a real word."""
    return -1 / (1 + np.exp(np.clip(score, -30, 30)))


def rising(score: np.ndarray) -> np.ndarray:
    """Derivative of the loss by the score of a noise word."""
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


#: Of the numbers of a text's words, as they are stored.
NUMBER = np.dtype("<u2")


def laid(rows: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all texts in one run, each text behind two ends, and the places of its words in it."""
    pad = np.array([end, end], np.int32)
    run = np.concatenate([x for r in rows for x in (pad, r.astype(np.int32))])
    keep = np.ones(len(run), bool)
    starts = np.cumsum([0] + [len(r) + 2 for r in rows[:-1]])
    keep[starts] = keep[starts + 1] = False
    return run, np.flatnonzero(keep)


#: Rows of parameters that one row of a shard's result holds, at the most.
PIECE = 512
#: Shards that one task trains, each from the common start; it sends their mean, so that a row that each of them changed is sent once.
TOGETHER = 2
#: Tokens that a shard lays in one run, or one text's.
RUN = 1 << 18


def trained(rows: DataFrame, tokens: int, share: np.ndarray, end: int, how: Bilinear) -> Parameters:
    """The model learned from `rows` (doc_id, numbers) of about `tokens` tokens."""
    model = Parameters.start(np.log(share), how)
    squares = first_squares(model)
    shards = max(1, min(how.shards, -(-tokens // (how.rounds * how.shard_tokens)))) if how.rounds else 1
    rows = rows.select("numbers", F.xxhash64("doc_id", "numbers").alias("order"))
    for k in range(how.rounds):
        turn = rows.where(F.pmod("order", F.lit(how.rounds)) == k).withColumn("shard", F.pmod(F.shiftrightunsigned("order", 20), F.lit(shards)).cast("int"))
        model, squares = averaged(turn, shards, share, end, model, squares, how, k)
    return model


def averaged(rows: DataFrame, shards: int, share: np.ndarray, end: int, start: Parameters, squares: list[np.ndarray], how: Bilinear, turn: int) -> tuple[Parameters, list[np.ndarray]]:
    """Every shard of `rows` (shard, order, numbers) trains from one start; each row of parameters, with its squares, moves by the mean of the shards' changes, weighted by their numbers."""
    import pandas as pd

    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((start, squares))
    tasks = -(-shards // TOGETHER)
    groups = max(1, math.isqrt(tasks))
    schema = "which int, piece int, shard int, rows binary, changes binary, moved binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def learn(trainer, texts):
        run, at = laid(texts, end)
        for i in range(0, len(at), how.batch):
            trainer.step(run, at[i : i + how.batch])

    def add(sums, trainer, start, squares):
        """Adds a shard's changes, weighted by how often rows were changed, to those of the shards before it in the task."""
        for which, (x, old, changes) in enumerate(zip(trainer.p.trained, start.trained, trainer.changes)):
            moved = np.column_stack([x - old, trainer.squares[which] - squares[which]]).astype("<f4")
            if which == len(sums):
                sums.append((np.zeros(len(x)), np.zeros(moved.shape)))
            at = np.flatnonzero(changes)
            sums[which][0][at] += changes[at]
            sums[which][1][at] += changes[at][:, None] * moved[at].astype(float)

    def result(group, sums):
        for which, (changes, moved) in enumerate(sums):
            changed = np.flatnonzero(changes)
            cuts = np.searchsorted(changed, np.arange(0, len(changes) + PIECE, PIECE))
            for piece in np.flatnonzero(np.diff(cuts)):
                at = changed[cuts[piece] : cuts[piece + 1]]
                data = (at % PIECE).astype("<i4").tobytes(), changes[at].astype("<f8").tobytes(), (moved[at] / changes[at][:, None]).astype("<f4").tobytes()
                yield pa.RecordBatch.from_pylist([dict(zip(names, (which, int(piece), group, *data)))], ARROW)

    ARROW = pa.schema([("which", pa.int32()), ("piece", pa.int32()), ("shard", pa.int32()), ("rows", pa.binary()), ("changes", pa.binary()), ("moved", pa.binary())])

    def run(batches):
        (start, squares), shard, trainer, texts, held, sums = shared.value, None, None, [], 0, []
        for batch in batches:
            for now, numbers in zip(pylist(batch, "shard"), pylist(batch, "numbers")):
                if now != shard or held >= RUN:
                    if texts:
                        learn(trainer, texts)
                    texts, held = [], 0
                if now != shard:
                    if trainer is not None:
                        add(sums, trainer, start, squares)
                    shard, trainer = now, Trainer(start.copied(), share, how, turn << 32 | now, squares)
                texts.append(np.frombuffer(numbers, NUMBER))
                held += len(texts[-1])
        if trainer is not None:
            learn(trainer, texts)
            add(sums, trainer, start, squares)
            yield from result(shard // TOGETHER, sums)

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")  # sums in one order
        which, piece = int(pdf["which"].iloc[0]), int(pdf["piece"].iloc[0])
        changes, moved = np.zeros(PIECE), None
        for at, n, x in zip(pdf["rows"], pdf["changes"], pdf["moved"]):
            at, n = np.frombuffer(at, "<i4"), np.frombuffer(n, "<f8")
            x = np.frombuffer(x, "<f4").reshape(len(at), -1)
            moved = np.zeros((PIECE, x.shape[1])) if moved is None else moved
            changes[at] += n
            moved[at] += n[:, None] * x
        at = np.flatnonzero(changes)
        data = at.astype("<i4").tobytes(), changes[at].tobytes(), (moved[at] / changes[at][:, None]).astype("<f4").tobytes()
        return pd.DataFrame({"which": [which], "piece": [piece], "shard": [int(pdf["shard"].iloc[0])], "rows": [data[0]], "changes": [data[1]], "moved": [data[2]]})

    # Some shards after each other are a partition, their texts in the order of their hashes. About the root of all partitions meet in one group, and their means in another.
    dealt = rows.withColumn("task", F.floor(F.col("shard") / TOGETHER).cast("int")).repartitionById(tasks, F.col("task")).sortWithinPartitions("shard", "order")
    each = dealt.select("shard", "numbers").mapInArrow(run, schema).groupBy("which", "piece", F.pmod("shard", F.lit(groups))).applyInPandas(mean, schema)
    model, squares = start.copied(), [x.copy() for x in squares]
    for r in each.groupBy("which", "piece").applyInPandas(mean, schema).collect():  # the model's parameters
        x = model.trained[r["which"]]
        at = np.frombuffer(r["rows"], "<i4") + PIECE * r["piece"]
        moved = np.frombuffer(r["moved"], "<f4").reshape(len(at), -1)
        x[at] += moved[:, :-1].reshape(len(at), *x.shape[1:])
        squares[r["which"]][at] += moved[:, -1]
    shared.unpersist()
    return model, squares


def scored(docs: DataFrame, held_out, how: Bilinear = Bilinear()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. `held_out` is a condition on doc_id: rows never learned from."""
    if not 1 <= how.words < 1 << 16:
        raise ValueError("words are numbered in 16 bits")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    training = docs.where("not held_out")
    counts = written(counted(training), "language-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, v_all = total["n"], total["v"]
    kept = commonest(counts, how.broadcast_words).union(counts.where(F.col("word") == F.lit(END)))
    top = dict(sorted(((bytes(r["word"]), r["n"]) for r in kept.collect()), key=lambda x: (-x[1], x[0])))
    known = [w for w, n in top.items() if n >= how.least][: how.words]
    if END not in known:
        known = [END, *known[: how.words - 1]]
    number = {w: k + 1 for k, w in enumerate(known)}
    known_n = np.array([top.get(w, 0) for w in known], float)
    others_n, others_v = n_all - int(known_n.sum()), v_all - sum(w in top for w in known)
    share = np.concatenate([[others_n + others_v + 1.0], known_n + 1])
    base_norm, others_norm = math.log10(n_all + v_all + 1), math.log10(others_n + others_v + 1)
    shared = spark.sparkContext.broadcast((number, top))
    first = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, other double, numbers binary, words array<binary>, times array<int>"

    def numbered(batches):
        number, top = shared.value
        logs = {w: math.log10(c + 1) for w, c in top.items() if w not in number}
        of_number = np.array([0.0, *(math.log10(top.get(w, 0) + 1) for w in number)])
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text", 8_000_000):
            words, sizes = words_of(batch.column(2))
            coded, n = words.dictionary_encode(), batch.num_rows
            distinct = coded.dictionary.to_pylist()
            # Of each distinct word, and behind them of the end: its number, the logarithm of its count if it isn't numbered, and whether that is to be joined.
            numbers = np.fromiter(map(number.get, [*distinct, END], repeat(0)), NUMBER, len(distinct) + 1)
            log = np.fromiter(map(logs.get, [*distinct, END], repeat(math.nan)), float, len(distinct) + 1)
            rest = np.isnan(log) & (numbers == 0)
            log[np.isnan(log)] = 0
            # Each text and its end.
            stops = np.cumsum(sizes + 1)
            starts = stops - sizes - 1
            run = np.full(len(words) + n, len(distinct), np.int32)
            is_word = np.ones(len(run), bool)
            is_word[stops - 1] = False
            run[is_word] = coded.indices.to_numpy()
            sums = lambda x: np.add.reduceat(x[run], starts)
            other = sums(log)
            n_known = sums((~rest).astype(np.int64)) - (END not in top)
            base = sums(of_number[numbers]) + other - (sizes + 1) * base_norm
            at = np.flatnonzero(rest[run])
            pairs, times = np.unique((np.searchsorted(stops, at, "right") << 32) | run[at], return_counts=True)
            cuts = pa.array(np.searchsorted(pairs, np.arange(n + 1) << 32), pa.int32())
            bytes_to = pa.py_buffer((NUMBER.itemsize * np.concatenate([[0], stops])).astype(np.int32))
            columns = [
                pa.array(np.arange(row, row + n)),
                batch.column(0),
                batch.column(1),
                pa.array(sizes + 1),
                pa.array(n_known),
                pa.array(base),
                pa.array(other - sums((numbers == 0).astype(np.int64)) * others_norm),
                pa.Array.from_buffers(pa.binary(), n, [None, bytes_to, pa.py_buffer(numbers[run])]),
                pa.ListArray.from_arrays(cuts, coded.dictionary.take(pa.array(pairs & 0xFFFFFFFF))),
                pa.ListArray.from_arrays(cuts, pa.array(times, pa.int32())),
            ]
            row += n
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in first.split(", ")])

    rows = written(docs.select("doc_id", "held_out", "text").mapInArrow(numbered, first), "language-rows")
    shared.unpersist()
    end = number[END]
    model = spark.sparkContext.broadcast(trained(rows.where("not held_out"), n_all, share / share.sum(), end, how))
    second = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"

    def judged(batches):
        p = model.value
        for batch in slices(batches, "numbers", 4_000_000):
            texts = [np.frombuffer(x, NUMBER) for x in pylist(batch, "numbers")]
            run, at = laid(texts, end)
            bounds = np.cumsum([0] + [len(t) for t in texts[:-1]])
            found = np.add.reduceat(p.log_probabilities(run[at - 1], run[at - 2], run[at]), bounds) / math.log(10)
            score = found + batch.column("other").to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(score)], names=[x.split()[0] for x in second.split(", ")])

    scores = rows.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "other", "numbers").mapInArrow(judged, second)
    rest = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    # A word is one row of its counts: they are hashed, and the many rows of rare words needn't be sorted.
    found = rest.join(counts.hint("shuffle_hash"), "word").groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"))
    more = F.coalesce("more", F.lit(0.0))
    return scores.join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
