"""Join of documents by the Jaccard similarity of their word shingles, with set relations skipping work.

Sets that are equal become one class first. Every class indexes the prefix of its set, the rarest shingles
first, so long that linked sets share many of them (spare). Shingles that no other class's prefix holds are
known not to be shared: a class with too few others has no partner and leaves the index, and so does the
tail of every list that no first common shingle can lie in. The index lists are cut into blocks by shingle
and size; a class probes the block of its own size and the next larger ones its partners may lie in. Positions
in the lists, and signatures of what the lists hold, rule out pairs that cannot share enough.
So whole blocks and most places are skipped, and a pair that is left has few rows.

Answers are derived from those of similar sets: each class is first compared with one leader, the member
of its blocks with the shingle nearest the front. A class that links to its leader takes over the
leader's component; pairs under one leader, linked to it or not, are answered from what they differ in (leaders.py).
Pairs inside a component are then never compared, and a block whose classes are all
in one component is dropped whole; what is left is compared pair by pair. So components come out exact
without the pairs inside groups of copies.

Shingles are known by 64-bit hashes, sets and texts by 128 bits. The order of shingles comes from counts of all
documents in CELLS cells; it has an effect on speed alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import arrow_map, dropped, written
from shelfmark.llm.components import components
from shelfmark.llm.dedup import bitmaps, filter_bits, hit
from shelfmark.llm.leaders import centred, certain, inside

#: Cells of the frequency sketch (1 MB when it is sent out), and the parts it is counted in.
CELLS, PARTS = 1 << 20, 16
#: 64-bit words of the signature of a list.
WORDS = 4
#: A class that differs from its leader by more than so many times what links allow is compared by its lists alone.
FAR = 4
#: Words that a worker remembers the hashes of, and texts and shingles that it holds before it counts them.
MEMORY, TEXTS, HELD = 100_000, 500, 1 << 19


class Hashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        out = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMORY and len(word) <= 64:
            self[word] = out
        return out


_hashes = Hashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int) -> np.ndarray:
    """The set of a text: sorted distinct hashes of its word shingles; of all its words if fewer than width; none without words.

    Words are runs without space and tab to carriage return, A to Z in lower case.
    """
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space alone
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)
    for k in range(min(width, len(h))):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def least_overlap(n: int, percent: int) -> int:
    """The fewest shingles a set of n shares with any partner of at least that similarity."""
    return -(-percent * n // 100)


def spare(n: int, percent: int) -> int:
    """How many shingles the prefixes of a set of n and of any linked set that is no smaller share at least.

    The prefix leaves out least_overlap(n) - spare(n) shingles, and linked sets share least_overlap of the
    larger one, so at least the smaller set's spare lie in both prefixes.
    """
    return min(least_overlap(n, percent), 1 + n * (100 - percent) // 200)


def frequency(docs: DataFrame, width: int) -> np.ndarray:
    """Counts of the shingles of all documents by cell, on a logarithmic scale of one byte."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                held, n = [], 0
                for text in batch.column(0).slice(at, TEXTS).to_pylist():
                    held.append((shingles(text, width) >> np.uint64(44)).astype(np.int64))
                    n += len(held[-1])
                    if n >= HELD:
                        np.add.at(cells, np.concatenate(held), 1)
                        held, n = [], 0
                if held:
                    np.add.at(cells, np.concatenate(held), 1)
        yield from _packed_cells(TaskContext.get().partitionId() % 64, cells)

    def add(table: pa.Table) -> pa.Table:
        total = _unpacked_cells(table.column("cells").to_pylist())
        return pa.table({"part": table.column("part").slice(0, 1), "slot": pa.array([0], pa.int32()), "cells": pa.array([_squeezed(total)], pa.binary())})

    kind = "part int, slot int, cells binary"
    counted = arrow_map(docs.select("text"), count, kind)
    for keys in (["part", "slot"], ["part"]):
        counted = counted.groupBy(*keys).applyInArrow(add, kind)
    out = np.zeros(CELLS, np.int64)
    size = CELLS // PARTS
    found = counted.toArrow()  # PARTS rows of CELLS / PARTS counts
    for part, cells in zip(found.column("part").to_pylist(), found.column("cells").to_pylist(), strict=True):
        out[part * size : (part + 1) * size] = _unpacked_cells([cells])
    return np.minimum(255, np.round(8 * np.log2(1 + out))).astype(np.uint8)


def _squeezed(cells: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(cells.astype("<i8").tobytes())


def _unpacked_cells(blobs: list[bytes]) -> np.ndarray:
    import zstandard

    total = np.zeros(CELLS // PARTS, np.int64)
    for blob in blobs:
        total += np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<i8")
    return total


def _packed_cells(slot: int, cells: np.ndarray) -> Iterator[pa.RecordBatch]:
    for part, some in enumerate(np.split(cells, PARTS)):
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([slot], pa.int32()), pa.array([_squeezed(some)], pa.binary())], names=["part", "slot", "cells"])


def indexed(docs: DataFrame, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    """(row, doc_id, copy, n, digest, prefix) of every document: a number of the row, the digest of its text, its set's size and 128-bit digest, and the prefix of its set, rarest first, in index order."""
    shared = docs.sparkSession.sparkContext.broadcast(counts.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        rare = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sizes, digests, prefixes = [], [], []
                for text in part.column(3).to_pylist():
                    s = shingles(text, width)
                    sizes.append(len(s))
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    keep = len(s) - least_overlap(len(s), percent) + spare(len(s), percent)
                    order = np.lexsort((s, rare[(s >> np.uint64(44)).astype(np.int64)]))[:keep]
                    prefixes.append(s[order].view(np.int64))
                lengths = np.cumsum([0, *map(len, prefixes)])
                flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat, pa.int64()))],
                    names=["row", "doc_id", "copy", "n", "digest", "prefix"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", copy_of(F.col("text")).alias("copy"), "text")
    return arrow_map(rows, run, "row long, doc_id long, copy binary, n int, digest binary, prefix array<long>")


def copy_of(text: Column) -> Column:
    """128 bits of the digest of a text, which tell rows of one id apart."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def sets_of(docs: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """(class, items): the whole set of each class in needed (class, doc_id, digest), once.

    The texts are picked by a filter of the needed ids, of bounded size, so none is shuffled; sets that it
    lets through beyond those go by their digests.
    """
    place = lambda: F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    bits = filter_bits(needed.count())
    places = written(bitmaps(needed.select(place().alias("at"))), "needed")
    some = hit(docs, places, place(), "wanted").filter("wanted").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = [shingles(t, width) for t in batch.column(0).slice(at, 500).to_pylist()]
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                lengths = np.cumsum([0, *map(len, sets)])
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat, pa.int64()))], names=["digest", "items"])

    found = arrow_map(some, run, "digest binary, items array<long>").dropDuplicates(["digest"])
    out = written(found.join(needed.select("digest", "class"), "digest").select("class", "items"), "sets")
    dropped(places)
    return out


def compared(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, *more: Column) -> DataFrame:
    """The pairs (a, b) of classes with the sizes n1, n2 of their sets, the size of what both hold, and more, of their sets items1, items2."""
    pairs = written(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    ends = written(classes.join(ends, "class", "left_semi"), "ends")
    sets = sets_of(docs, ends, width)
    one = sets.select(F.col("class").alias("a"), F.col("items").alias("items1"))
    two = sets.select(F.col("class").alias("b"), F.col("items").alias("items2"))
    both = pairs.join(one, "a").join(two, "b").select("*", F.size("items1").alias("n1"), F.size("items2").alias("n2"), F.size(F.array_intersect("items1", "items2")).alias("both"))
    out = written(both.select("a", "b", "n1", "n2", "both", *more), "compared")
    dropped(pairs, ends, sets)
    return out


class Bounds:
    """SQL of what linked sets must share, from their sizes n1 and n2 and the percentage."""

    def __init__(self, percent: int):
        self.percent = percent
        #: What two linked sets share at least.
        self.need = f"(({percent}L * (n1 + n2) + {100 + percent - 1}L) div {100 + percent}L)"
        out = [f"({self.least(n)} - {self.spare(n)})" for n in ("n1", "n2")]
        #: What their prefixes share at least: what is not in both lies beyond the prefix that ends first.
        self.share = f"greatest({self.need} - greatest({out[0]}, {out[1]}), {self.spare('least(n1, n2)')})"
        self.sizes = f"100L * least(n1, n2) >= {percent}L * greatest(n1, n2)"
        self.linked = f"100L * both >= {percent}L * (n1 + n2 - both)"

    def least(self, n: str) -> str:
        """least_overlap in SQL."""
        return f"(({self.percent}L * {n} + 99) div 100)"

    def spare(self, n: str) -> str:
        """spare in SQL."""
        return f"least({self.least(n)}, 1 + {n} * {100 - self.percent} div 200)"

    def fits(self, words: Sequence[str] = ()) -> str:
        """Whether two postings may be the first shingle that two linked sets share: from it on, either list must still hold enough, and the signatures, if given, must not show too many that the other lacks."""
        lacks = {k: " + ".join(f"bit_count({w}_{k} & ~{w}_{3 - k})" for w in words) or "0" for k in (1, 2)}
        room = "least(" + ", ".join(f"held{k} - greatest(rank{k}, {lacks[k]})" for k in (1, 2)) + ")"
        return f"{self.sizes} and {room} >= {self.share}"


def lists_of(own: DataFrame, percent: int) -> DataFrame:
    """The index lists by class: (class, n, held, block, w0, ..., shingles) from (class, n, prefix).

    held is how many shingles of a class's prefix other prefixes hold too. Linked sets have many of those in
    common, worth at least; so a class with fewer leaves the index, and of the others the last worth - 1
    shingles need no place in it. shingles are the rest, in index order.
    """
    bounds = Bounds(percent)
    worth = bounds.spare(bounds.least("n"))
    posted = own.select("class", "n", F.posexplode("prefix").alias("pos", "shingle"))
    shared = written(posted.groupBy("shingle").agg(F.count("*").alias("k")).filter("k > 1").select("shingle"), "shared")
    # A filter of bounded size keeps most shingles that no other class has from the shuffle; the join decides.
    bits = filter_bits(shared.count())
    place = lambda: F.pmod(F.col("shingle"), F.lit(bits))
    places = written(bitmaps(shared.select(place().alias("at"))), "shared-places")
    kept = hit(posted, places, place(), "again").filter("again").drop("again").join(shared, "shingle", "left_semi")
    bit = F.expr("shiftleft(1L, cast(shingle & 63 as int))")
    signs = [F.bit_or(F.when(F.expr(f"pmod(shiftright(shingle, 6), {WORDS}) = {w}"), bit).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(WORDS)]
    held = kept.groupBy("class", "n").agg(F.sort_array(F.collect_list(F.struct("pos", "shingle"))).alias("found"), F.count("*").cast("int").alias("held"), *signs).filter(F.expr(f"held >= {worth}"))
    # A block for each shingle and size class: sizes of partners lie in the same or the next one.
    block = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    first = F.expr(f"slice(found.shingle, 1, cast(held - {worth} + 1 as int))").alias("shingles")
    out = written(held.select("class", "n", "held", block.alias("block"), *[f"w{w}" for w in range(WORDS)], first), "lists")
    dropped(shared, places)
    return out


def links_of(docs: DataFrame, own: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) of classes: links that reach all that the links of all classes reach."""
    bounds, words = Bounds(percent), [f"w{w}" for w in range(WORDS)]
    lists = lists_of(own, percent)
    place_in = F.posexplode("shingles").alias("rank", "shingle")

    # Answers taken over from a leader: of the classes with the shingle nearest the front of its lists, the one that leads most.
    posted = lists.select("class", "n", "held", place_in)
    heads = posted.groupBy("shingle").agg(F.min(F.struct("rank", "class", "n", "held")).alias("head"), F.count("*").alias("k")).filter("k > 1")
    heads = written(heads.select("shingle", *[F.col(f"head.{c}").alias(f"{c}1") for c in ("class", "n", "held", "rank")]), "heads")
    led = heads.join(posted.select("shingle", *[F.col(c).alias(f"{c}2") for c in ("class", "n", "held", "rank")]), "shingle").filter(F.expr(f"class1 <> class2 and {bounds.fits()}"))
    led = written(led.select(F.col("class2").alias("a"), F.col("class1").alias("b")).distinct(), "led")
    fame = written(led.groupBy("b").agg(F.count("*").alias("fame")), "fame")
    chosen = led.join(fame, "b").groupBy("a").agg(F.max(F.struct("fame", (-F.col("b")).alias("b"))).alias("to")).select("a", (-F.col("to.b")).alias("b"))
    apart = F.expr(f"if(n1 + n2 - 2L * both <= {FAR}L * (n1 + n2 - 2L * {bounds.need}), array_union(array_except(items1, items2), array_except(items2, items1)), null)")
    answers = compared(chosen, docs, classes, width, apart.alias("diff"))
    dropped(heads, led, fame)
    near = centred(answers.filter("diff is not null").select(F.col("b").alias("leader"), F.col("a").alias("class"), F.col("n1").alias("n"), "diff"), percent)
    found = answers.filter(bounds.linked).select("a", "b").unionByName(certain(near))
    place = written(components(found), "place")
    found = found.unionByName(inside(near, place, percent))

    # The rest: pairs of classes in different components and under different leaders. Lists of one component are dropped whole.
    known = written(place.withColumnRenamed("node", "class").join(near.select("class", "leader"), "class", "full"), "known")
    at = written(lists.join(known, "class", "left").withColumn("component", F.coalesce("component", "class")), "placed")
    posted = at.select("class", "n", "held", "block", *words, "component", "leader", place_in)
    mixed = posted.groupBy("shingle").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most").select("shingle")
    rest = written(posted.join(written(mixed, "mixed"), "shingle", "left_semi"), "rest")
    dropped(lists, at, known)
    one, two = (rest.select("shingle", "block", *[F.col(c).alias(f"{c}_{k}" if c in words else f"{c}{k}") for c in ("class", "n", "held", "rank", *words, "component", "leader")]) for k in (1, 2))
    one = one.withColumnRenamed("block", "at").withColumn("block", F.explode(F.array(F.col("at"), F.col("at") + 1)))
    apart = "component1 <> component2 and not coalesce(leader1 = leader2, false) and (at < block or class1 < class2)"
    rows = one.join(two, ["shingle", "block"]).filter(F.expr(f"{apart} and {bounds.fits(words)}"))
    rows = written(rows.select(F.least("class1", "class2").alias("a"), F.greatest("class1", "class2").alias("b")), "rows")
    dropped(rest)
    # Pairs that the leaders have refuted already need no second look.
    refuted = answers.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    late = compared(rows.distinct().join(refuted, ["a", "b"], "left_anti"), docs, classes, width)
    dropped(rows)
    return found.unionByName(late.filter(bounds.linked).select("a", "b"))


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows whose key is not among those of gone. Rows that a filter of these, of bounded size, does not hit pass without a shuffle."""
    bits = filter_bits(gone.count())
    at = lambda: F.pmod(F.xxhash64(key), F.lit(bits))
    seen = hit(rows, written(bitmaps(gone.select(at().alias("at"))), "places"), at(), "maybe")
    stays = seen.filter("maybe").join(gone.select(F.col(key).alias("gone_key")).hint("merge"), F.col(key) == F.col("gone_key"), "left_anti")
    return seen.filter("not maybe").drop("maybe").unionByName(stays.drop("maybe"))


def grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(row, doc_id, copy, n, first) of every row of docs (doc_id, text), as a table: first is (doc_id is null, doc_id, row) of the first row of its component, null for a row without words."""
    index = written(indexed(docs, frequency(docs, width), width, percent), "index")
    # A class of equal sets is named by the row of its smallest doc_id.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    firsts = index.filter("n > 0").groupBy("digest").agg(first, F.count("*").alias("size"))
    classes = written(firsts.select("digest", F.col("first.row").alias("class"), "first.doc_id", "first", "size"), "classes")
    again = classes.filter("size > 1").select("digest", "class")
    copies = written(index.select("row", "digest").join(again, "digest").filter("row <> class").select("row"), "copies")
    own = without(index.filter("n > 0").select("row", "n", "prefix"), copies, "row").withColumnRenamed("row", "class")
    classes = classes.drop("size")
    place = written(components(links_of(docs, own, classes.drop("first"), width, percent)), "place")
    named = classes.join(place.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    labels = written(named.groupBy("component").agg(F.min("first").alias("first")), "labels")
    # Written, so that the last join shuffles both sides and Spark can split a class with very many copies.
    named = written(named.drop("first").join(labels, "component").select("digest", "first"), "named")
    slim = index.drop("prefix")
    known = slim.filter("n > 0").join(named, "digest", "left").drop("digest")
    out = written(known.unionByName(slim.filter("n = 0").drop("digest").withColumn("first", F.lit(None).cast(named.schema["first"].dataType))), "grouped")
    dropped(index, copies, place, labels, named)
    return out


def near_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id.

    Two documents link when the Jaccard similarity of their shingle sets is at least percent / 100; the
    component is the smallest doc_id reachable by links, the document's own included. Null and empty texts
    and texts without words have no shingles and link with nothing. Rows that repeat an id with other texts
    are documents of their own under one id; rows with a null id link as others do, and a component of null
    ids alone is null. Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return grouped(docs, width, percent).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs, all columns, with one row of each component: that of the smallest doc_id, null ids last.

    Rows are told apart by id and text, not by id alone; of rows that agree in both one stays. Null and
    empty texts and texts without words are like nothing and all stay. An empty table stays empty; other columns,
    whatever their names, pass through; a text of any length is read whole.
    """
    name = lambda id, copy: F.xxhash64(id, copy)
    groups = grouped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width, percent).filter("n > 0")
    many = written(groups.groupBy(F.col("first.row").alias("lead")).agg(F.count("*").alias("size")).filter("size > 1").select("lead"), "many")
    some = groups.withColumn("lead", F.col("first.row")).join(many, "lead", "left_semi")
    members = written(some.groupBy("doc_id", "copy").agg(F.bool_or(F.col("row") == F.col("lead")).alias("stays")).withColumnRenamed("doc_id", "id2").withColumnRenamed("copy", "copy2"), "members")
    # Rows that a filter of those in groups, of bounded size, does not hit pass without a shuffle.
    bits = filter_bits(members.count())
    places = written(bitmaps(members.select(F.pmod(name(F.col("id2"), F.col("copy2")), F.lit(bits)).alias("at"))), "places")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole_row"), F.col("doc_id").cast("long").alias("id"), copy_of(F.col("text")).alias("copy"))
    seen = hit(rows, places, F.pmod(name(F.col("id"), F.col("copy")), F.lit(bits)), "maybe")
    known = seen.filter("maybe").join(members.hint("merge"), F.col("id").eqNullSafe(F.col("id2")) & (F.col("copy") == F.col("copy2")), "left")
    out = known.filter("stays").dropDuplicates(["id", "copy"]).unionByName(known.filter("stays is null"))
    return seen.filter("not maybe").select("whole_row.*").unionByName(out.select("whole_row.*"))
