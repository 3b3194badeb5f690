"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks.

A ratio is compressed bytes over UTF-8 bytes. Repetitive text compresses too well, noise hardly at all; what is usual
depends on the length, so that the limits do as well. A document is rejected by the method where its
own ratio is outside the band of its length, or where more than a given share of its chunks lies outside the chunks' band. Chunks are judged in every text that has a full
one; the last ends with the text, and overlaps the one before where the length is no multiple.
The limits are general ones for written prose in any language with an alphabet, not fitted to a corpus.

Defined results: null counts as empty; an empty text has no words, so the base rule fails. Repeated rows give repeated
results, a null id is carried along, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pylist, slices, table

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio by length in bytes: (up to, least, most), the last for all longer texts."""

    whole: tuple[tuple[float, float, float], ...] = ((256, 0.45, 1.10), (512, 0.42, 0.95), (1024, 0.38, 0.90), (4096, 0.32, 0.85), (16384, 0.26, 0.80), (float("inf"), 0.20, 0.80))
    chunk_bytes: int = 2048
    chunk: tuple[float, float] = (0.28, 0.85)
    #: A document goes if more than this share of its chunks is outside the band.
    chunk_share: float = 0.25
    level: int = 3

    def keeps(self, data: bytes, ratio) -> tuple[bool, float]:
        """Whether the method keeps the text, and its ratio."""
        if not data:
            return False, 1.0
        whole = ratio(data)
        least, most = next((a, b) for n, a, b in self.whole if len(data) <= n)
        if not least <= whole <= most:
            return False, whole
        last = len(data) - self.chunk_bytes
        if last < 0:
            return True, whole
        starts = [*range(0, last, self.chunk_bytes), last]
        chunks = [data[i : i + self.chunk_bytes] for i in starts]
        odd = sum(not self.chunk[0] <= ratio(x) <= self.chunk[1] for x in chunks)
        return odd <= self.chunk_share * len(chunks), whole


def ratio_of(level: int):
    import zstandard

    compress = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False).compress
    return lambda data: len(compress(data)) / len(data)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three that the text holds twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
    _, window, count = np.unique(pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    again = count[window] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            n += line in seen
            seen.add(line)
    return n


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, kept boolean"


def measure(text: str, bands: Bands, ratio) -> tuple:
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n, repeated = len(words), repeated_words(words)
    failed = n < 50 or 100 * repeated > 50 * n
    kept, whole = bands.keeps(data, ratio)
    return n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), repeated_lines(text), repeated, failed, whole, kept and not failed


def measured(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """All columns of `docs` (doc_id, text, ...) and a struct `quality` of MEASURES."""
    names = [x.split()[0] for x in MEASURES.split(", ")]
    types = dict(zip(names, (pa.int64(),) * 5 + (pa.bool_(), pa.float64(), pa.bool_())))
    kind = pa.struct(list(types.items()))

    def run(batches):
        ratio = ratio_of(bands.level)
        for batch in slices(batches, "text"):
            columns = zip(*(measure(x or "", bands, ratio) for x in pylist(batch, "text")))
            found = pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(columns, types.values())], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "quality"])

    schema = docs.schema
    from pyspark.sql.types import StructType

    return docs.mapInArrow(run, StructType([*schema.fields]).add("quality", StructType.fromDDL(MEASURES)))


def accepted(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The documents that the rules keep, with their columns."""
    if "quality" in docs.columns:
        inner = docs.withColumnRenamed("quality", "quality own")
        return accepted(inner, bands).withColumnRenamed("quality own", "quality")
    return measured(docs, bands).where("quality.kept").drop("quality")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return measured(docs).select("doc_id", "quality.*").drop("ratio")
