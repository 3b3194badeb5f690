"""Reader of compilers' note files (.gcno): the basic blocks of each function with their source lines.

A file is a task's row of bytes; files are small and many. What can't be read is a dead letter with its reason and the records before it are kept; files without a byte are passed over. Both byte orders are read, and
versions before and from the one that writes a working folder, columns and artificial functions.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The file's mark, and the tags of records.
MAGIC = 0x67636E6F
FUNCTION, LINES = 0x01000000, 0x01450000
#: The first version, as a number of ten times the major one and the minor one, with more fields.
WIDE = 80

RECORDS = "source string, function string, file string, start int, lines array<struct<file:string,line:int>>, reason string"
KIND = pa.list_(pa.struct([("file", pa.string()), ("line", pa.int32())]))


class Words:
    """32-bit words of a file, in its byte order."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, len(data)
        self.order = "<" if data[:4] == struct.pack("<I", MAGIC) else ">"

    def number(self) -> int:
        if self.at + 4 > self.end:
            raise ValueError("the file ends within a record")
        (found,) = struct.unpack_from(self.order + "I", self.data, self.at)
        self.at += 4
        return found

    def text(self) -> str:
        size = 4 * self.number()
        if self.at + size > self.end:
            raise ValueError("a text is longer than its record")
        found = self.data[self.at : self.at + size].rstrip(b"\0")
        self.at += size
        return found.decode("utf-8", "replace")


def version(mark: int) -> int:
    """Ten times the major version and the minor one: of four letters the first is a major digit or stands for ten and more, the third a minor digit."""
    major, tens, minor, _ = mark.to_bytes(4, "big").decode("latin-1")
    whole = 10 * (ord(major) - ord("A")) + int(tens) if major >= "A" else int(major)
    return 10 * whole + int(minor)


def blocks_of_file(data: bytes) -> Iterator[tuple[str, list[tuple[str, int]]]]:
    """(function, lines) of each block that has source lines."""
    words = Words(data)
    if words.number() != MAGIC:
        raise ValueError("not a note file")
    wide = version(words.number()) >= WIDE
    words.number()  # stamp
    if wide:
        words.text()  # working folder
        words.number()  # whether blocks that don't run are marked
    function = ""
    while words.at < len(data):
        tag = words.number()
        if not tag:
            break
        end = 4 * words.number() + words.at
        if end > len(data):
            raise ValueError("a record is longer than the file")
        words.end = end
        if tag == FUNCTION:
            for _ in range(3):
                words.number()
            function = words.text()
        elif tag == LINES:
            words.number()  # the block
            lines, file = [], ""
            while True:
                if line := words.number():
                    lines.append((file, line))
                elif not (file := words.text()):
                    break
            if lines:
                yield function, lines
        words.at, words.end = end, len(data)


def note_records(spark: SparkSession, path: str) -> DataFrame:
    """source, function, file, start, lines of each block; and dead letters, that have a reason and null else."""

    def run(batches):
        for batch in batches:
            for source, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, reason = [], None
                try:
                    for found in blocks_of_file(data):
                        rows.append(found)
                except ValueError as e:
                    reason = str(e)
                bad = [] if reason is None else [reason]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([source] * (len(rows) + len(bad)), pa.string()),
                        pa.array([f for f, _ in rows] + [None] * len(bad), pa.string()),
                        pa.array([lines[0][0] for _, lines in rows] + [None] * len(bad), pa.string()),
                        pa.array([lines[0][1] for _, lines in rows] + [None] * len(bad), pa.int32()),
                        pa.array([[{"file": f, "line": n} for f, n in lines] for _, lines in rows] + [None] * len(bad), KIND),
                        pa.array([None] * len(rows) + bad, pa.string()),
                    ],
                    names=["source", "function", "file", "start", "lines", "reason"],
                )

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gcno").load(path)
    return files.select("path", "content").mapInArrow(run, RECORDS)


def basic_blocks(records: DataFrame) -> DataFrame:
    """file, start, lines: blocks of one file that start at one line are one, with the lines of all; as coverage.blocks_of_lines takes them."""
    each = records.where("reason is null").select("file", "start", F.explode("lines").alias("x")).distinct()
    return each.groupBy("file", "start").agg(F.array_sort(F.collect_list("x")).alias("lines"))
