"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is cut in halves down to leaves, the leaves are encoded, and neighbours are joined. A join takes
the tokens of both sides and encodes anew only a window about the seam. The window grows on each side
until its edge is a stable cut: white space (space or line feed) after a character that is no white
space. No match of the pre-token pattern runs across such a place in any context, and the pattern looks
behind nowhere, so the tokens outside the window are those of the whole text. If no stable cut turns up,
the window grows to the ends of both sides, so the result is exact for every text.

Decoding is the same tree without windows: bytes of halves joined.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import arrow_map

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Characters of a leaf of the encoding tree, ids of a leaf of the decoding tree, and the first window.
LEAF, ID_LEAF, WINDOW = 1024, 4096, 16

_codecs: dict = {}


def codec(vocabulary: str = VOCABULARY, leaf: int = LEAF) -> TreeCodec:
    """The codec of a rank file, given by its path or by its name among the public tokenizers; one per process."""
    if (vocabulary, leaf) not in _codecs:
        import public_tokenizers

        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _codecs[vocabulary, leaf] = TreeCodec(ranks, public_tokenizers.PATTERN, leaf)
    return _codecs[vocabulary, leaf]


class TreeCodec:
    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF):
        import tiktoken

        self.base = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.run, self.leaf = self.base.encode_ordinary, max(1, leaf)

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self.run(text)
        middle = len(text) // 2
        return self.join(text, middle, self.encode(text[:middle]), self.encode(text[middle:]))

    def join(self, text: str, seam: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of text from those of text[:seam] and text[seam:]."""
        a, b, size = seam, seam, len(text)
        if not self.stable(text, seam):
            a, width = seam - 1, WINDOW
            while a > 0:
                edge = max(0, seam - width)
                while a > edge and not self.stable(text, a):
                    a -= 1
                if a > edge or a <= 0:
                    break
                width *= 2
            b, width = seam + 1, WINDOW
            while b < size:
                edge = min(size, seam + width)
                while b < edge and not self.stable(text, b):
                    b += 1
                if b < edge or b >= size:
                    break
                width *= 2
        if a == b:
            return left + right
        n_left, n_right = len(self.run(text[a:seam])), len(self.run(text[seam:b]))
        return left[: len(left) - n_left] + self.run(text[a:b]) + right[n_right:]

    @staticmethod
    def stable(text: str, at: int) -> bool:
        return 0 < at < len(text) and text[at] in " \n" and not text[at - 1].isspace()

    def decode(self, ids) -> bytes:
        if len(ids) <= ID_LEAF:
            return self.base.decode_bytes(ids)
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def packed(ids: list[int]) -> bytes:
    """ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if __import__("sys").byteorder == "big":
        out.byteswap()
    return out.tobytes()


def unpacked(data: bytes) -> list[int]:
    out = array("I", data)
    if __import__("sys").byteorder == "big":
        out.byteswap()
    return out.tolist()


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """Return (id_col, ids): ids is binary, little-endian unsigned 32-bit, of the whole text without special tokens.

    A null or empty text gives empty ids; a null id, repeated rows and an empty table pass through as they
    are; other columns, whatever their names, are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(vocabulary, leaf).encode
        for batch in batches:
            for part in pieces(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([packed(encode(t or "")) for t in part.column(1).to_pylist()], pa.binary())], names=[id_col, "ids"])

    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, ids binary")


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """Return (id_col, ids_col, decoded): the bytes of the packed ids. Null or empty ids give empty bytes."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(vocabulary).decode
        for batch in batches:
            for part in pieces(batch):
                ids = [x or b"" for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([decode(unpacked(x)) for x in ids], pa.binary())], names=[id_col, ids_col, "decoded"])

    return arrow_map(encoded.select(id_col, ids_col), run, f"`{id_col}` {kind}, `{ids_col}` binary, decoded binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """decode_documents(encode_documents(docs)) in one pass: a task has one Python worker, and ids cross to it once.

    Return (id_col, ids, decoded); decoded comes from the packed ids. Edge cases are those of the two.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = codec(vocabulary, leaf)
        for batch in batches:
            for part in pieces(batch):
                ids = [packed(tree.encode(t or "")) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([tree.decode(unpacked(x)) for x in ids], pa.binary())], names=[id_col, "ids", "decoded"])

    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, ids binary, decoded binary")


def pieces(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of bounded rows, so that the bytes made of one slice stay small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def digests(decoded: DataFrame) -> DataFrame:
    """Counts and digests of the ids and of the decoded bytes."""
    return decoded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
