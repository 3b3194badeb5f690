"""Packing of tokenised documents into sequences of a fixed capacity, by minimum bin slack.

Every document is cut at multiples of the capacity; its full pieces fill a sequence each. What remains of
it (1 .. capacity-1 tokens) is an item. The items' lengths, a multiset of fewer than `capacity` distinct values
whatever the corpus, are packed window by window: the longest remaining item seeds a window, and a subset-sum
dynamic program over bitsets picks the multiset of remaining lengths that comes closest to the capacity; its
counts are found by backtracking, and the window is repeated as often as the counts allow. Where even the
best multiset leaves slack, all items left are longer than the slack, and one of them is cut to fill it. So only
the last window can hold padding.

Defined results: a null or empty text has the end token only. Rows with the same id are packed one by one; a null
id is carried along. An empty table gives an empty result. Other columns are ignored. Ties (items of
one length) are dealt in the order of the stored rows.
"""

from __future__ import annotations

import codecs
import re
import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Recent, parallelism, pylist, slices, written

CAPACITY = 2048
END_ID = 1
#: Distinct words whose ids a Python worker keeps at a time, twice over.
WORDS_KEPT = 400_000
#: Normalised Latin letters; runs of these and runs of other characters that aren't white space are tokenised apart, but for
#: texts with an apostrophe (contractions), the marks of special tokens, or characters that normalisation may change.
LETTERS = re.compile("[a-zß-öø-ÿ]+")
RUNS = re.compile("[a-zß-öø-ÿ]+|[^a-zß-öø-ÿ \t-\r]+")
#: All characters but those that normalisation leaves, apostrophes aside: one class, which is searched several times faster than alternatives.
UNUSUAL = re.compile("[^\x00-\x1b\x20-&(-~¡-©«-´¶-¹»-ÿ–—‘’“”…]")
#: Separators that str.split() takes for white space and the tokenizer doesn't.
NOT_SPACE = re.compile("[\x1c-\x1f]")


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_characters() -> str:
    """The character of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the other bytes follow U+00FF in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b if b in own else next(rest)) for b in range(256))


def unusual(text: str) -> bool:
    return UNUSUAL.search(text) is not None or "<|" in text


def packed_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds(Recent):
    """Stretch without white space -> its ids as little-endian unsigned 32-bit integers; such stretches are tokenised apart from each other."""

    BYTES = byte_characters()

    def __init__(self, path: str):
        super().__init__(WORDS_KEPT)
        self.tokenizer = tokenizer(path)
        self.model = self.tokenizer.model

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None and LETTERS.fullmatch(word):  # normalised already, and a pre-token as a whole
            tokens = self.model.tokenize(codecs.charmap_decode(word.encode(), "strict", self.BYTES)[0])
            out = packed_ids([t.id for t in tokens])
        elif out is None:
            out = packed_ids(self.tokenizer.encode(word, add_special_tokens=False).ids)
        self.put(word, out)
        return out

    def text(self, text: str) -> bytes:
        if unusual(text):
            words = re.split("[ \t\n\r]+", text) if NOT_SPACE.search(text) else text.split()
        else:
            words = RUNS.findall(text.lower())
        return b"".join(map(self.__getitem__, words))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One for each Python worker, which keeps it from task to task."""
    return WordIds(path)


TOKENISED = "doc_id long, row long, n_tokens long, ids binary"


def tokenised(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """A row for each document: its ids with the end id, and a number for the row, unique once the table is written."""

    def run(batches):
        words, end, row = word_ids(vocabulary), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text"):
            ids = [words.text(x or "") + end for x in pylist(batch, "text")]
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(range(row, row + n), pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "row", "n_tokens", "ids"],
            )
            row += n

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, TOKENISED)


@dataclass(frozen=True)
class Lot:
    """Items of one remaining length: those of the original `length` with ranks lo .. hi-1, from token `start` on."""

    length: int
    lo: int
    hi: int
    start: int


@dataclass(frozen=True)
class Placing:
    """Where pieces of a lot go: the k-th goes to sequence first_sequence + k // copies, at offset + (k % copies) * size."""

    length: int
    lo: int
    hi: int
    start: int
    size: int
    skip: int
    copies: int
    first_sequence: int
    offset: int


def closest_fill(counts: dict[int, int], target: int) -> dict[int, int]:
    """The multiset of lengths, within counts, whose sum is the largest one up to target."""
    mask, reach, steps = (1 << (target + 1)) - 1, 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= target), reverse=True):
        left, k = min(counts[length], target // length), 1
        while left and not reach >> target & 1:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left -= k
            k *= 2
        if reach >> target & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + k
            at -= length * k
    return chosen


def planned(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Placing], int]:
    """Placings of all items of the histogram (length -> count), and the number of windows used."""
    lots: dict[int, list[Lot]] = {x: [Lot(x, 0, n, 0)] for x, n in histogram.items() if n}
    counts = {x: n for x, n in histogram.items() if n}
    placings: list[Placing] = []
    windows = 0

    def take(size: int, n: int, copies: int, offset: int, keep: int) -> None:
        """Puts n items of a size into windows, `keep` tokens of each; the rest of them are items again."""
        skip, rest = 0, []
        queue = lots[size]
        while n:
            lot = queue.pop()
            m = min(n, lot.hi - lot.lo)
            if m < lot.hi - lot.lo:
                queue.append(Lot(lot.length, lot.lo + m, lot.hi, lot.start))
            placings.append(Placing(lot.length, lot.lo, lot.lo + m, lot.start, keep, skip, copies, windows, offset))
            if keep < size:
                rest.append(Lot(lot.length, lot.lo, lot.lo + m, lot.start + keep))
            n, skip = n - m, skip + m
            counts[size] -= m
        if not counts[size]:
            del counts[size]
        for lot in rest:
            left = size - keep
            lots.setdefault(left, []).append(lot)
            counts[left] = counts.get(left, 0) + lot.hi - lot.lo

    while counts:
        seed = max(counts)
        counts[seed] -= 1
        chosen = closest_fill(counts, capacity - seed)
        counts[seed] += 1
        chosen[seed] = chosen.get(seed, 0) + 1
        slack = capacity - sum(x * n for x, n in chosen.items())
        cut = max((x for x, n in counts.items() if n > chosen.get(x, 0)), default=0) if slack else 0
        needed = {x: n + (x == cut) for x, n in chosen.items()} | ({cut: chosen.get(cut, 0) + 1} if cut else {})
        times = min(counts[x] // n for x, n in needed.items())
        offset = 0
        for x, n in sorted(chosen.items(), reverse=True):
            take(x, n * times, n, offset, x)
            offset += x * n
        if cut:
            take(cut, times, 1, offset, slack)
        windows += times
    return placings, windows


def packed(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    tokens = written(tokenised(docs, vocabulary or word_vocabulary(), end_id), "packing-tokens")
    buckets = 4 * parallelism(spark)
    items = tokens.select("row", (F.col("n_tokens") % capacity).alias("size"), F.floor(F.col("n_tokens") / capacity).alias("full"), F.pmod(F.xxhash64("row"), F.lit(buckets)).alias("bucket"))
    # An item's rank among those of its length, and the number of full pieces before a document's: counted in
    # buckets, so that no length, however frequent, meets in one task.
    here = Window.partitionBy("size", "bucket").orderBy("row")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    ranked = items.select("*", (F.row_number().over(here) - 1).alias("rank_here"), F.coalesce(F.sum("full").over(before), F.lit(0)).alias("full_here"))
    sums = written(items.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("n_full")), "packing-sums")
    earlier = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    by_size = sums.groupBy("size").agg(F.sum("n").alias("n"), F.sum("n_full").alias("n_full")).collect()  # at most `capacity` rows
    placings, windows = planned({r["size"]: r["n"] for r in by_size if r["size"]}, capacity)
    full_from, first = {}, windows
    for r in sorted(by_size, key=lambda r: r["size"]):
        full_from[r["size"]] = first
        first += r["n_full"]
    starts = spark.createDataFrame(list(full_from.items()), "size long, full_size long") if full_from else spark.createDataFrame([], "size long, full_size long")
    offsets = sums.select("size", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rank_bucket"), F.coalesce(F.sum("n_full").over(earlier), F.lit(0)).alias("full_bucket")).join(F.broadcast(starts), "size")
    ranks = ranked.join(offsets, ["size", "bucket"]).select("row", (F.col("rank_here") + F.col("rank_bucket")).alias("rank"), (F.col("full_here") + F.col("full_bucket") + F.col("full_size")).alias("full_sequence"))
    plan: dict[int, list[Placing]] = {}
    for p in placings:
        plan.setdefault(p.length, []).append(p)
    shared = spark.sparkContext.broadcast({k: sorted(v, key=lambda p: p.lo) for k, v in plan.items()})

    def place(batches):
        for batch in slices(batches, "ids"):
            out = []
            for doc, n, ids, rank, sequence in zip(*(pylist(batch, c) for c in ("doc_id", "n_tokens", "ids", "rank", "full_sequence"))):
                full = n // capacity
                cuts = [(k * capacity, capacity, sequence + k, 0) for k in range(full)]
                for p in shared.value.get(n % capacity, ()):
                    if p.lo > rank:
                        break
                    if rank < p.hi:
                        k = p.skip + rank - p.lo
                        cuts.append((full * capacity + p.start, p.size, p.first_sequence + k // p.copies, p.offset + k % p.copies * p.size))
                out += [(doc, at, size, ids[4 * at : 4 * (at + size)], n, to, offset) for at, size, to, offset in cuts]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return tokens.join(ranks, "row").select("doc_id", "n_tokens", "ids", "rank", "full_sequence").mapInArrow(place, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    """Per piece of `documents`: its place, and the CRC-32 of its ids."""
    from .common import table

    return packed(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
