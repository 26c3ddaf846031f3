"""Directly addressable codes for token ids, and shard files of them.

An id is cut into chunks of CHUNK bits, lowest first. Level k holds the k-th chunk of every id that has
one, one byte each, and a bitmap that tells which of them go on. A rank directory over each bitmap (one
count per 512 bits) says where an id goes on in the next level, so any id is read without decoding those
before it. A shard file holds whole documents: a directory of documents and the levels.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.common import arrow_map, written

#: Format, fixed: magic, chunk width, bits that a count of the rank directory covers.
MAGIC, CHUNK, RANK_BITS = b"DACS", 8, 512
VOCABULARY, END_ID = "word_bpe_49k.json", 1
#: A shard is closed at so many ids. Words that a worker remembers.
SHARD_IDS, MEMORY = 1 << 20, 600_000


class Level:
    """One level: chunks, and for all but the last a bitmap of those that go on with its rank directory."""

    def __init__(self, chunks: np.ndarray, bits: np.ndarray, ranks: np.ndarray):
        self.chunks, self.bits, self.ranks = chunks, bits, ranks

    @staticmethod
    def of(chunks: np.ndarray, goes_on: np.ndarray) -> Level:
        bits = np.packbits(goes_on, bitorder="little")
        per = np.add.reduceat(goes_on.astype(np.int64), np.arange(0, len(goes_on), RANK_BITS)) if len(goes_on) else np.zeros(0, np.int64)
        return Level(chunks.astype(np.uint8), bits, np.concatenate([[0], np.cumsum(per)]).astype("<u4"))

    def bit(self, a: int, b: int) -> np.ndarray:
        """Bits a to b as 0 and 1."""
        first = a // 8
        return np.unpackbits(self.bits[first : -(-b // 8)], bitorder="little")[a - 8 * first : b - 8 * first]

    def rank(self, i: int) -> int:
        """Ones before bit i: one directory entry and at most RANK_BITS bits."""
        start = i // RANK_BITS * RANK_BITS
        return int(self.ranks[i // RANK_BITS]) + (int(self.bit(start, i).sum()) if i > start else 0)


def levels_of(values: np.ndarray) -> list[Level]:
    out, rest = [], values.astype(np.uint32)
    while True:
        goes_on = rest >> CHUNK != 0
        out.append(Level.of(rest & ((1 << CHUNK) - 1), goes_on))
        if not goes_on.any():
            return out
        rest = rest[goes_on] >> CHUNK


class Codes:
    """Random access to coded ids."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def __len__(self) -> int:
        return len(self.levels[0].chunks)

    def __getitem__(self, i: int) -> int:
        value = 0
        for k, level in enumerate(self.levels):
            value |= int(level.chunks[i]) << (CHUNK * k)
            if not level.bit(i, i + 1)[0]:
                return value
            i = level.rank(i)
        return value

    def range(self, a: int, b: int, k: int = 0) -> np.ndarray:
        """Ids a to b: those that go on lie side by side in the next level too."""
        if a >= b:
            return np.zeros(0, np.uint32)
        level = self.levels[k]
        out, on = level.chunks[a:b].astype(np.uint32), level.bit(a, b).astype(bool)
        if on.any():
            first = level.rank(a)
            out[on] |= self.range(first, first + int(on.sum()), k + 1) << CHUNK
        return out


def write_shard(doc_ids: list[int | None], counts: list[int], values: np.ndarray) -> bytes:
    """The bytes of a shard file. counts: ids of each document, in the order of doc_ids."""
    levels = levels_of(values)
    parts = [MAGIC, struct.pack("<BBI", CHUNK, len(levels), len(doc_ids))]
    parts += [np.array([i is None for i in doc_ids], np.uint8).tobytes(), np.array([i or 0 for i in doc_ids], "<i8").tobytes(), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype("<i8").tobytes()]
    for level in levels:
        parts += [struct.pack("<QQQ", len(level.chunks), len(level.bits), len(level.ranks)), level.chunks.tobytes(), level.bits.tobytes(), level.ranks.tobytes()]
    return b"".join(parts)


class Shard:
    """A shard file read from its bytes; nothing is decoded before it is asked for."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard of directly addressable codes")
        chunk, n_levels, n = struct.unpack_from("<BBI", data, 4)
        if chunk != CHUNK:
            raise ValueError(f"chunks of {chunk} bits")
        self.at, self.data = 10, data
        null, ids = self._take(n, np.uint8), self._take(n, "<i8")
        self.doc_ids = [None if x else int(i) for x, i in zip(null, ids, strict=True)]
        self.offsets = self._take(n + 1, "<i8")
        levels = []
        for _ in range(n_levels):
            sizes = struct.unpack_from("<QQQ", data, self.at)
            self.at += 24
            levels.append(Level(self._take(sizes[0], np.uint8), self._take(sizes[1], np.uint8), self._take(sizes[2], "<u4")))
        self.codes = Codes(levels)

    def _take(self, n: int, kind) -> np.ndarray:
        out = np.frombuffer(self.data, kind, n, self.at)
        self.at += out.nbytes
        return out

    def document(self, k: int) -> np.ndarray:
        return self.codes.range(int(self.offsets[k]), int(self.offsets[k + 1]))


#: Parts of a text of lower-case Latin-1 that the vocabulary's splitter never joins: runs of letters, runs without
#: letters, and, as an apostrophe may begin a contraction, all of a word from one on with the run before it.
PARTS = re.compile(r"[a-zªµºß-öø-ÿ]+(?:'[^ \n]*)?|[^ \na-zªµºß-öø-ÿ']+(?:'[^ \n]*)?|'[^ \n]*")


def byte_signs() -> dict[int, str]:
    """The sign that byte-level vocabularies use for each byte: itself if it prints, else one from 256 on, in order."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}


#: How the vocabularies that Words takes apart normalise and split, fixed by the file; others go through the library whole.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class Words(dict):
    """Packed ids by part of a text. Texts are cut where the vocabulary's splitter always cuts: at spaces, line
    feeds and, in Latin-1, between the PARTS. A part of letters alone goes straight to the vocabulary's merges.
    Added tokens in a text are found as the library finds them. A vocabulary that normalises or splits otherwise
    gets every text whole.
    """

    def __init__(self, vocabulary: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
        # Texts that may hold an added token are encoded whole: by its first two signs, as normalising may change case.
        self.marks = {t.content[:2].lower() for t in self.tokenizer.get_added_tokens_decoder().values()}
        made = json.loads(self.tokenizer.to_str())
        self.known = made["normalizer"] == NORMALISER and made["pre_tokenizer"] == SPLITTER and made["model"]["type"] == "BPE"
        self.merge, self.signs = self.tokenizer.model.tokenize, byte_signs()

    def __missing__(self, part: str) -> bytes:
        if LETTERS.fullmatch(part):
            signs = part if part.isascii() else "".join(map(self.signs.__getitem__, part.encode()))
            ids = [t.id for t in self.merge(signs)]
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        out = array("I", ids).tobytes()
        if len(part) <= 64:
            self[part] = out
        return out

    def encode(self, text: str) -> bytes:
        if len(self) > MEMORY:
            self.clear()
        lower = text.lower()
        if not self.known or any(m in lower for m in self.marks):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        try:
            text.encode("latin-1")
            parts = PARTS.findall(lower)
        except UnicodeEncodeError:
            parts = text.replace("\n", " ").split(" ")
        return b"".join(map(self.__getitem__, parts))


LETTERS = re.compile("[a-zªµºß-öø-ÿ]+")
_words: dict[str, Words] = {}


def words(vocabulary: str) -> Words:
    if vocabulary not in _words:
        _words[vocabulary] = Words(vocabulary)
    return _words[vocabulary]


def write_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode whole texts, add end_id to each, and write shards in ascending id_col order to the shared folder.

    Return the written table, one row a shard file: part and seq (their order is the order of documents),
    first (ids of the part before the shard), n_docs, n_tokens, shard (the file's bytes). Texts that are null
    or empty hold end_id alone; null ids come first; repeated rows are written as often as they come, equal
    ids in the order of the first signs of their texts, then of a hash, so that an id on very many rows is
    split; an empty table gives no shard; other columns are ignored. The bytes of a shard stand in the table
    as they are, neither compressed nor coded.
    """
    order = [F.col(id_col), F.substring(text_col, 1, 64), F.xxhash64(text_col)]
    ordered = docs.select(id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, part = words(vocabulary).encode, np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        ids, counts, data, held, first, seq = [], [], [], 0, 0, 0

        def shard() -> pa.RecordBatch:
            blob = write_shard(ids, counts, np.frombuffer(b"".join(data), "<u4"))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "first": pa.array([first], pa.int64()), "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([held], pa.int64()), "shard": pa.array([blob], pa.binary())})

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                coded = encode(text or "") + end
                ids.append(i)
                data.append(coded)
                counts.append(len(coded) // 4)
                held += counts[-1]
                if held >= shard_ids:
                    yield shard()
                    ids, counts, data, held, first, seq = [], [], [], 0, first + held, seq + 1
        if ids:
            yield shard()

    return written(arrow_map(ordered, run, "part int, seq int, first long, n_docs long, n_tokens long, shard binary"), "shards", compression="uncompressed", **{"parquet.enable.dictionary": "false"})


def one_shard(shards: DataFrame, part: int, seq: int) -> Shard:
    """One shard of a written table; its codes give any id by its place, through the rank directories alone."""
    return Shard(shards.filter((F.col("part") == part) & (F.col("seq") == seq)).select("shard").first()[0])


def read_documents(shards: DataFrame) -> DataFrame:
    """Read written shards: doc_id, start (ids of all documents before), n_tokens, ids_crc32, each read by its place."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each task that wrote, no more
    before = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                shard = Shard(data.as_py())
                n = len(shard.doc_ids)
                crc = [zlib.crc32(shard.document(k).astype("<u4").tobytes()) for k in range(n)]
                yield pa.RecordBatch.from_pydict({"part": pa.array([part] * n, pa.int32()), "doc_id": pa.array(shard.doc_ids, pa.int64()), "within": pa.array(shard.offsets[:-1] + first), "n_tokens": pa.array(np.diff(shard.offsets)), "ids_crc32": pa.array(crc, pa.int64())})

    read = arrow_map(shards.select("part", "first", "shard"), run, "part int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return read.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
