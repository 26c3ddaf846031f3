"""Removal of repeated runs of lines.

Texts are looked at in pieces. With pairs, every two neighbouring lines with text are a piece, so a run of two
or more lines is found whole wherever it stands. With chunks, a rolling hash over the hashes of
neighbouring lines chooses where a piece ends; there are fewer, and runs without a whole chunk stay. Pieces
of two or more lines with text that occur again anywhere are removed but for their first
occurrence, after their bytes have been compared with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import arrow_map, written
from shelfmark.llm.dedup import BITMAP, BITS, bitmaps, filter_bits

#: Lines under the rolling hash, bits of it that are 0 at a chunk's end (2: every fourth line), fewest lines of a chunk.
WINDOW, MASK_BITS, LEAST = 2, 2, 2
_M, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def chunks(text: str | None) -> list[list[bytes]]:
    """The lines of a text in chunks: a chunk ends after a line where the top bits of the rolling hash are 0 and it has LEAST lines."""
    import xxhash

    lines = (text or "").encode().split(b"\n")
    out, now, before = [], [], [0] * (WINDOW - 1)
    for line in lines:
        h = xxhash.xxh3_64_intdigest(line)
        now.append(line)
        rolled = h
        for x in reversed(before):
            rolled = (rolled * _M + x) & _MASK
        before = [*before[1:], h]
        if len(now) >= LEAST and (rolled * _M & _MASK) >> (64 - MASK_BITS) == 0:
            out.append(now)
            now = []
    if now:
        out.append(now)
    return out


def removable(chunk: list[bytes]) -> bool:
    return sum(bool(x.strip()) for x in chunk) >= LEAST


#: A cut gives the lines of a text and its pieces as (first line, line after the last), in order.
Cut = Callable[[str | None], tuple[list[bytes], list[tuple[int, int]]]]


def by_chunks(text: str | None) -> tuple[list[bytes], list[tuple[int, int]]]:
    """The removable chunks."""
    out, spans = [], []
    for chunk in chunks(text):
        if removable(chunk):
            spans.append((len(out), len(out) + len(chunk)))
        out += chunk
    return out, spans


def by_pairs(text: str | None) -> tuple[list[bytes], list[tuple[int, int]]]:
    """Every line with text and the next one with text, and the blank lines between."""
    out = (text or "").encode().split(b"\n")
    full = [k for k, x in enumerate(out) if x.strip()]
    return out, [(a, b + 1) for a, b in zip(full, full[1:])]


def without(held: list[bytes], spans: list[tuple[int, int]], drop: set[int]) -> tuple[bytes, int]:
    """The lines without the pieces of drop, and how many have gone. A piece that overlaps the first occurrence of its own text leaves that whole."""
    gone: set[int] = set()
    for k in drop:
        a, b = spans[k]
        if k and k - 1 not in drop and spans[k - 1][1] > a and held[slice(*spans[k - 1])] == held[a:b]:
            a = spans[k - 1][1]
        gone.update(range(a, b))
    return b"\n".join(x for k, x in enumerate(held) if k not in gone), len(gone)


def coded(chunk: list[bytes]) -> tuple[int, bytes]:
    import xxhash

    data = b"\n".join(chunk)
    return xxhash.xxh3_64_intdigest(data) - (1 << 63), data


def text_key(text: str | None) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest((text or "").encode()) - (1 << 63)


def _occurrences(docs: DataFrame, cut: Cut, with_data, hits=None) -> DataFrame:
    """(doc_id, key, idx, hash[, data]) of the pieces; only those whose place is set in the shared bitmaps, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, size = _bits(hits) if hits else (None, 0)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    key = text_key(text)
                    held, spans = cut(text)
                    for idx, (a, b) in enumerate(spans):
                        h, data = coded(held[a:b])
                        if bits is None or _set(bits, h % size):
                            rows.append((i, key, idx, h, data) if with_data else (i, key, idx, h))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    arrays = [pa.array(c, pa.int32() if k == 2 else pa.binary() if k == 4 else pa.int64()) for k, c in enumerate(columns)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "key", "idx", "hash", "data"][: len(arrays)])

    return arrow_map(docs, run, "doc_id long, key long, idx int, hash long" + ", data binary" * with_data)


def _bits(hits) -> tuple[np.ndarray, int]:
    size, parts = hits.value
    out = np.zeros(size // 8, np.uint8)
    for bucket, data in parts:
        out[bucket * BITMAP // 8 : bucket * BITMAP // 8 + len(data)] = np.frombuffer(data, np.uint8)
    return out, size


def _set(bits: np.ndarray, at: int) -> bool:
    return bool(bits[at >> 3] >> (at & 7) & 1)


def dedup_lines(docs: DataFrame, most_bits: int = BITS, cut: Cut = by_chunks) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, text without removed chunks, n_lines (before), n_removed.

    Lines end at line feeds. A piece first occurs by doc_id (null ids last), then a hash of the text, then
    its place in it; so rows that repeat one another in both are treated alike. Chunks stay there. With
    pairs a line goes when it is in any pair that has occurred before, so the first place of a pair may lose a
    line to another pair; of every line one copy stays. Null texts count as empty: one empty line,
    never removed. Documents no piece of which can repeat are not shuffled. An empty table gives an empty
    result; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    counted = _occurrences(docs, cut, False)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "idx")
    repeated = written(counted.groupBy("hash").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").select("hash", "first"), "repeated")
    size = filter_bits(repeated.count(), most_bits)
    places = bitmaps(repeated.select(F.pmod("hash", F.lit(size)).alias("at"))).toArrow()  # most_bits bits at most
    hits = spark.sparkContext.broadcast((size, list(zip(places.column("bucket").to_pylist(), places.column("bits").to_pylist(), strict=True))))

    found = written(_occurrences(docs, cut, True, hits).withColumn("at", order), "occurrences")
    firsts = found.join(repeated.withColumnRenamed("first", "at"), ["hash", "at"], "left_semi").select("hash", F.col("data").alias("first_data"), F.col("at").alias("first")).dropDuplicates(["hash"])
    firsts = written(firsts, "firsts")
    # Both tables grow with the corpus, so neither is broadcast at any size.
    gone = found.join(firsts.hint("merge"), "hash").filter("at <> first and data = first_data")
    gone = written(gone.groupBy("doc_id", "key").agg(F.collect_set("idx").alias("idx")), "removed")

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, size = _bits(hits)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(1).to_pylist()
                maybe, lines = [], []
                for text in texts:
                    held, spans = cut(text)
                    maybe.append(any(_set(bits, coded(held[a:b])[0] % size) for a, b in spans))
                    lines.append(text.count("\n") + 1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(map(text_key, texts), pa.int64()), pa.array(lines, pa.int64()), pa.array(maybe)], names=["doc_id", "text", "key", "n_lines", "maybe"])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out, removed = [], []
                for text, idx in zip(part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True):
                    left, n = without(*cut(text), set(idx or ()))
                    out.append(left.decode())
                    removed.append(n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out), part.column(2), pa.array(removed, pa.int64())], names=["doc_id", "text", "n_lines", "n_removed"])

    flagged = arrow_map(docs, flag, "doc_id long, text string, key long, n_lines long, maybe boolean")
    kind = "doc_id long, text string, n_lines long, n_removed long"
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key"), "idx")
    touched = flagged.filter("maybe").join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left")
    stripped = arrow_map(touched.select("doc_id", "text", "n_lines", "idx"), strip, kind)
    return flagged.filter("not maybe").select("doc_id", "text", "n_lines", F.lit(0).cast("long").alias("n_removed")).unionByName(stripped)
