"""Phrase collocations: phrases whose words meet more often than their parts' counts tell, by language.

Texts are cut into blocks, written once. First pass: a block's words and phrases of up to three words are a count-min sketch of its
own, sparse, by language: sorted cells and their counts, in slices. The blocks' sketches are merged slice by slice. A sketch never counts less than there is, so that cells below the least
count rule phrases out without loss, and so do those of their parts. The merge answers each block with a bit for each cell that the block has.
Second pass: blocks meet their bits, and what is left is counted exactly, within tasks first. Scores and subsumption are joins of the exact counts.

The sketch's width follows the corpus (a cell for every sixteen bytes of text), so that it rules out as much at any size, and no task or driver ever holds the whole of it: a slice is
one group of 2^20 counters and the cells that blocks have there, some eight for each counter, as hashes spread them; a cell of a block takes 1 to 2 bytes in the shuffle, its answer a bit.
The driver learns the number of bytes, nothing else.

Defined results: null texts are empty, null languages `und`. A row is a document; repeated rows count each. Phrases don't pass the marks
that split pieces. Empty and blank texts give nothing. Texts of any length are taken whole: they are cut into blocks between words, with the two words that
follow; a single word longer than a block is a block. A language's phrases of one score and count are ranked by their UTF-8 bytes. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pylist, slices, table, written

#: Lower case, white space to spaces, marks that split pieces to line ends.
FOLD = bytes(32 if c == 9 else 10 if c in b".,;:!?" or 10 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
TWO_MORE = re.compile(rb"(?: [^ \n]+){0,2}")
BLOCK = 1 << 21
#: Bytes of text of a task of the second pass: it holds their distinct phrases, and sends each once.
SHARE = 1 << 26
#: Cells of a slice.
CELLS = 1 << 20
ROWS = 2
MOST = 3


def pieces(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """Each language of a batch with its texts, folded, a space between words, joined by line ends."""
    by_lang: dict[str, list[bytes]] = {}
    for lang, text in zip(pylist(batch, "lang"), pylist(batch, "text")):
        by_lang.setdefault(lang, []).append(re.sub(rb"  +", b" ", text.encode().translate(FOLD)))
    for lang, texts in by_lang.items():
        yield lang, b"\n".join(texts)


def blocks(data: bytes, most: int = BLOCK) -> Iterator[tuple[bytes, int]]:
    """Parts of `data` of about `most` bytes, each with the end of its own words: at a line end, or else between words, followed by the next two words of the piece."""
    at, size = 0, len(data)
    while at < size:
        end = size
        if size - at > most and (end := data.rfind(b"\n", at + 1, at + most)) < 0 and (end := data.rfind(b" ", at + 1, at + most)) < 0:
            ends = [k for k in (data.find(b" ", at + most), data.find(b"\n", at + most)) if k >= 0]
            end = min(ends, default=size)
        yield data[at : TWO_MORE.match(data, end).end()], end - at
        at = end


def powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, base, np.uint64))])


class Hashes:
    """64-bit hashes of byte ranges: differences of sums of powers, an odd base's inverse brings a range to its start. `step` bytes at a time."""

    def __init__(self, step: int = 1 << 18):
        base = 0x9E3779B97F4A7C15
        self.step, self.inverse = step, pow(base, -1, 1 << 64)
        self.up, self.down = powers(base, step), powers(self.inverse, step)
        self.block_up, self.block_down = pow(base, step, 1 << 64), pow(self.inverse, step, 1 << 64)

    def sums(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sums of byte * base ** place over all places before each of `at` (rising)."""
        out, total, scale = np.zeros(len(at), np.uint64), np.zeros(1, np.uint64), 1
        for k in range(0, len(data), self.step):
            part = np.cumsum((data[k : k + self.step].astype(np.uint64) + np.uint64(1)) * self.up[: len(data) - k] * np.uint64(scale))
            a, b = np.searchsorted(at, [k + 1, k + len(part) + 1])
            out[a:b] = part[at[a:b] - k - 1] + total
            total, scale = total + part[-1:], scale * self.block_up & 0xFFFFFFFFFFFFFFFF
        return out

    def inverses(self, at: np.ndarray) -> np.ndarray:
        whole = [1]
        for _ in range(int(at[-1]) // self.step if len(at) else 0):
            whole.append(whole[-1] * self.block_down & 0xFFFFFFFFFFFFFFFF)
        return self.down[at % self.step] * np.array(whole, np.uint64)[at // self.step]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def phrases(hashes: Hashes, lang: str, block: bytes, own: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For lengths 1, 2 and 3: first words (their numbers), starts, ends and hashes of a block's phrases."""
    data = np.frombuffer(block, np.uint8)
    ends_line = data == 10
    gap = np.concatenate([[True], ends_line | (data == 32), [True]])
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    if not len(starts):
        return
    piece = np.cumsum(ends_line)[starts]
    first, last, back = hashes.sums(data, starts), hashes.sums(data, ends), hashes.inverses(starts)
    salt = np.uint64(int.from_bytes(lang.encode()[:8].ljust(8, b"\0"), "little") ^ len(lang))
    mine = int(np.searchsorted(starts, own))
    for n in range(1, MOST + 1):
        at = np.arange(min(mine, len(starts) - n + 1))
        at = at[piece[at] == piece[at + n - 1]] if len(at) else at
        yield n, at, starts[at], ends[at + n - 1], mixed(mixed((last[at + n - 1] - first[at]) * back[at]) ^ salt)


def places(h: np.ndarray, row: int, width: int) -> np.ndarray:
    """Cells of a row; each row mixes the hash anew. Widths are powers of two."""
    return (mixed(h + np.uint64(row * 0x632BE59BD9B4E019)) & np.uint64(width - 1)).astype(np.int64)


def cut_texts(most: int):
    """Blocks of a task's texts: block (a number of its own), lang, own (the end of its words), data (compressed: a task of the second pass takes more of them, and sends a phrase once)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text"):
            for lang, data in pieces(batch):
                for block, own in blocks(data, most):
                    yield pa.RecordBatch.from_pydict({"block": [number], "lang": [lang], "own": [own], "data": [zstandard.ZstdCompressor(level=3).compress(block)]}, schema=pa.schema([("block", pa.int64()), ("lang", pa.string()), ("own", pa.int32()), ("data", pa.binary())]))
                    number += 1

    return run


def packed(cells: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising cells as gaps, and counts of a byte, compressed by places of bytes."""
    gaps = np.diff(cells, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4)
    return zstandard.ZstdCompressor(level=1).compress(gaps.T.tobytes() + counts.astype(np.uint8).tobytes())


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(5, -1)
    return np.cumsum(np.ascontiguousarray(planes[:4].T).view("<u4").ravel(), dtype=np.int64), planes[4]


def plain(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def found_phrases(hashes: Hashes, lang: str, block: bytes, own: int) -> list[tuple]:
    return list(phrases(hashes, lang, block, own)) or [(n, *[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64)) for n in range(1, MOST + 1)]


def sliced(found: list[tuple], row: int, width: int, cells: int):
    """Distinct cells of a block's phrases in a row, where each phrase's is among them, how often each is met, and where slices begin."""
    at, where, n = np.unique(places(np.concatenate([h for *_, h in found]), row, width), return_inverse=True, return_counts=True)
    return at, where, n, np.searchsorted(at, np.arange(0, width + 1, cells))


def sketched(least: int, width: int, cells: int):
    """Sketches of blocks: slice, block, cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for block, lang, own, data in zip(*(pylist(batch, c) for c in ("block", "lang", "own", "data"))):
                found, numbers, parts = found_phrases(hashes, lang, plain(data), own), [], []
                for row in range(ROWS):
                    at, _, n, ends = sliced(found, row, width, cells)
                    for k in np.flatnonzero(np.diff(ends)).tolist():
                        a, b = ends[k], ends[k + 1]
                        numbers.append(row * (width // cells) + k)
                        parts.append(packed(at[a:b] - k * cells, np.minimum(n[a:b], least)))
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([block] * len(parts), pa.int64()), pa.array(parts, pa.binary())], ["slice", "block", "cells"])

    return run


ANSWER = pa.schema([("block", pa.int64()), ("slice", pa.int64()), ("bits", pa.binary())])


def merged(least: int, cells: int):
    """For a slice's sketches of all blocks: block, slice, a bit for each of the block's cells, set where all blocks together reach `least`."""

    def run(group: pa.Table) -> pa.Table:
        sums, parts = np.zeros(cells, np.uint8), [unpacked(x) for x in group["cells"].to_pylist()]
        for at, n in parts:
            sums[at] = np.minimum(sums[at] + n, least)
        enough = sums >= least
        return pa.table([group["block"].combine_chunks(), group["slice"].combine_chunks(), pa.array([np.packbits(enough[at]).tobytes() for at, _ in parts], pa.binary())], schema=ANSWER)

    return run


COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


def counted(width: int, cells: int):
    """Exact counts, within a block, of the phrases that the answers leave; a block's words are counted under the empty phrase."""
    hashes: list[Hashes] = []

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not hashes:
            hashes.append(Hashes())
        if not block.num_rows:
            return COUNTED.empty_table()
        lang, own, data = (block[c][0].as_py() for c in ("lang", "own", "data"))
        data = plain(data)
        bits = dict(zip(answers["slice"].to_pylist(), answers["bits"].to_pylist()))
        found = found_phrases(hashes[0], lang, data, own)
        left = np.ones(sum(len(x[1]) for x in found), bool)
        for row in range(ROWS):
            at, where, _, ends = sliced(found, row, width, cells)
            some = np.flatnonzero(np.diff(ends)).tolist()
            ok = [np.unpackbits(np.frombuffer(bits[row * (width // cells) + k], np.uint8), count=int(ends[k + 1] - ends[k])) for k in some]
            left &= np.concatenate([np.zeros(0, np.uint8), *ok])[where].astype(bool)
        counts, passed, begun = Counter(), np.ones(len(data) + 2, bool), 0
        for n, at, starts, ends, _ in found:
            ok = left[begun : begun + len(at)]
            begun += len(at)
            if n == 1:
                counts[b""] = len(at)
            else:
                # words of the next block have no verdict here: they pass
                ok = ok & passed[at] & passed[at + 1]
            passed = np.ones(len(passed), bool)
            passed[at] = ok
            counts.update([data[a:b] for a, b in zip(starts[ok].tolist(), ends[ok].tolist())])
        return pa.table([pa.array([lang] * len(counts), pa.string()), pa.array([p.decode() for p in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], schema=COUNTED)

    return run


def phrase_counts(docs: DataFrame, least: int, block: int, cells: int) -> DataFrame:
    """lang, phrase, words, n: all phrases of up to three words found at least `least` times, and the number of words of each language, as the phrase of no words."""
    if not 1 <= least <= 127:
        raise ValueError("counters of a byte are added: the least count is 127 at most")
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    cut = written(texts.mapInArrow(cut_texts(block), "block long, lang string, own int, data binary"), "collocation-blocks")
    size = cut.agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0]
    width = max(cells, 1 << (size // 16).bit_length())
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, size // SHARE)
    answers = cut.mapInArrow(sketched(least, width, cells), "slice long, block long, cells binary").groupBy("slice").applyInArrow(merged(least, cells), "block long, slice long, bits binary")
    found = cut.repartition(tasks, "block").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(counted(width, cells), "lang string, phrase string, n long")
    found = found.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    words = F.when(F.col("phrase") == "", 0).otherwise(F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1)
    return written(found.withColumn("words", words).where((F.col("words") == 0) | (F.col("n") >= least)), "collocations")


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, share: int = 50, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two and three words that no longer one holds in `share` percent of their places."""
    counts = phrase_counts(docs, least, block, cells)
    part = counts.where("words between 1 and 2").select("lang", "phrase", "n")
    some = counts.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    cuts = some.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    # sides are taken from the phrase where they are asked for, so that rows stay short
    left, right = (F.call_function("substring_index", "phrase", F.lit(" "), F.col("k") - back) for back in (F.lit(0), F.col("words")))
    both = cuts
    for side, n in ((left, "l"), (right, "r")):
        both = both.join(part.select(F.col("lang").alias("side_lang"), F.col("phrase").alias("side"), F.col("n").alias(n)), (F.col("lang") == F.col("side_lang")) & (side == F.col("side"))).drop("side_lang", "side")
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    # a is at most l and r, so that a score is at most a million
    score = F.call_function("div", wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)"), wide("l") * wide("r"))
    lowest = both.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inside = cuts.where("words = 3").select("lang", F.when(F.col("k") == 1, right).otherwise(left).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    whole = lowest.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = whole.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = counts.where("words = 0").select("lang", "n")
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
