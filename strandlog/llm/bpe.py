"""Byte-level BPE encoding and decoding through sentencepiece.

A sentencepiece BPE model is serialised directly from the rank file: each token's bytes become characters by a
one-to-one byte map, and its score is its negative rank, so that sentencepiece merges in the order of the ranks.
Normalisation is the identity. Texts are cut into pre-tokens; each is encoded on its own, and decoding maps
ids back to bytes.

Defined results: a null text counts as empty and gives no ids. Repeated rows give repeated results, null ids are
carried along, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import struct
from array import array
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, pylist, slices, table

#: Distinct words, and pre-tokens, whose ids a Python worker keeps at a time, twice over.
WORDS_KEPT = 120_000
#: White space as Unicode defines it; the patterns of byte-level vocabularies mean this set by \s.
SPACE = r"\t-\r\x20\x85\xa0  -     　"
SPACES = frozenset("\t\n\x0b\x0c\r \x85\xa0                　")


def multi_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: Bytes 0 .. 255 go to U+0100 .. U+01FF: none of these is white space or special to sentencepiece.
BYTE_MAP = "".join(map(chr, range(0x100, 0x200)))


def as_characters(token: bytes) -> str:
    """One character for each byte."""
    return codecs.charmap_decode(token, "strict", BYTE_MAP)[0]


def varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model whose ids are the ranks; the id after the last is <unk>.

    Ranks must be 0 .. n-1 without gaps, and cover all single bytes, as byte-level vocabularies do.
    """
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("the ranks have gaps")
    # ModelProto: 1 pieces (1 piece, 2 score, 3 type: 1 normal, 2 unknown), 2 trainer_spec, 3 normalizer_spec.
    pieces = [field(1, field(1, as_characters(t).encode()) + field(2, -float(k)) + field(3, 1)) for k, t in enumerate(tokens)]
    pieces.append(field(1, field(1, b"<unk>") + field(2, 0.0) + field(3, 2)))
    # TrainerSpec: 3 model_type (2: BPE), 4 vocab_size, 24 treat_whitespace_as_suffix, 35 byte_fallback, 40 unk_id, 41-43 no bos, eos, pad.
    trainer = field(3, 2) + field(4, len(pieces)) + field(24, 0) + field(35, 0) + field(40, len(tokens)) + field(41, -1) + field(42, -1) + field(43, -1)
    # NormalizerSpec: 1 name, 3 add_dummy_prefix, 4 remove_extra_whitespaces, 5 escape_whitespaces.
    normalizer = field(1, b"identity") + field(3, 0) + field(4, 0) + field(5, 0)
    return b"".join(pieces) + field(2, trainer) + field(3, normalizer)


class ByteBPE:
    """Ids of texts and bytes of ids, for one rank file."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = ranks_of(path)
        self.bytes_of = sorted(self.ranks, key=self.ranks.__getitem__)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        self.words, self.pre_tokens = Recent(WORDS_KEPT), Recent(WORDS_KEPT)

    def stretches(self, text: str) -> list[str]:
        """A blank between two characters that aren't white space always begins a match, so the stretches between such blanks are matched apart."""
        parts = text.split(" ")
        if all(x and x[0] not in SPACES and x[-1] not in SPACES for x in parts):
            return [parts[0], *[" " + x for x in parts[1:]]]
        out, held = [], parts[0]
        for part in parts[1:]:
            if part and held and part[0] not in SPACES and held[-1] not in SPACES:
                out.append(held)
                held = " " + part
            else:
                held += " " + part
        return [*out, held] if held else out

    def ids_of(self, words: set[str]) -> dict[str, bytes]:
        """Ids are kept as bytes: millions of small lists would slow down Python's garbage collection."""
        found = {w: x for w in words if (x := self.words.find(w)) is not None}
        cut = {w: self.pattern.findall(w) for w in words if w not in found}
        ids = {m: self.pre_tokens.find(m) for ms in cut.values() for m in ms}
        new = [(m, m.encode("utf-8", "surrogatepass")) for m, x in ids.items() if x is None]
        ids |= {m: k.to_bytes(4, "little") for m, b in new if (k := self.ranks.get(b)) is not None}
        new = [(m, b) for m, b in new if ids[m] is None]
        pieces = self.pieces.encode([as_characters(b) for _, b in new], num_threads=1)
        for (m, _), x in zip(new, pieces, strict=True):
            ids[m] = out = array("I", x).tobytes()
            self.pre_tokens.put(m, out)
        for w, ms in cut.items():
            found[w] = out = ids[ms[0]] if len(ms) == 1 else b"".join(map(ids.__getitem__, ms))
            self.words.put(w, out)
        return found

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        cut = [self.stretches(x) for x in texts]
        ids = self.ids_of(set().union(*cut))
        return [b"".join(map(ids.__getitem__, x)) for x in cut]

    def encode(self, text: str) -> list[int]:
        return array("I", self.encode_all([text])[0]).tolist()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids)))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def encoded(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and decoded (the bytes that the ids stand for)."""
    import public_tokenizers

    vocabulary, pattern = vocabulary or multi_vocabulary(), pattern or public_tokenizers.PATTERN

    def run(batches):
        bpe = codec(vocabulary, pattern)
        for batch in slices(batches, "text", 4_000_000):
            ids = bpe.encode_all([x or "" for x in pylist(batch, "text")])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.binary())],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def query(spark, sf_dir: str) -> DataFrame:
    """Per document: digests of its ids and of the bytes that these decode to."""
    return encoded(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

