"""Benchmark decontamination: item-sized windows compared by SimHash, then by their weighted shingles.

A window has as many words as the item it is compared with; a shorter text is one window as a whole. Its
64-bit SimHash is the sign of the sum of its shingles' random bits, where each occurrence of a shingle has
bits of its own: so weighted similarity is the similarity of sets of occurrences. Fingerprints are cut into one block more
than ``RADIUS``, so any two within the radius agree on a block and meet in an equi-join on window size,
block and its bits. Candidates within the radius are verified by the exact weighted similarity: shared
over united occurrences of shingles.

Windows that cannot be similar are never made: a similar window has at least 4/9 of the shingles of both in
an item of its size, and a bit filter of fixed size tells which of a text's shingles may be. Windows of
equal content are compared once, however many documents hold them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indicatrix.llm import words
from indicatrix.llm.common import FILTER_BITS, Scratch, bit_filter, bits_at, cut

WIDTH = 5  # words of a shingle
RADIUS = 20  # bits; at a similarity of exactly 0.8 the expected distance is 10, with a deviation of 3
BITS = 64


def needed(size: int, held: int | None = None) -> int:
    """Shingles that a window must share with an item of its size for a similarity of 0.8.

    A whole text that is shorter than the item is a window of the ``held`` shingles it has.
    """
    span = size - WIDTH + 1
    return -(-4 * (span + (span if held is None else held)) // 9)


def fewest(size: int) -> int:
    """Shingles that a text must have for a similarity of 0.8 with an item of a size."""
    return -(-4 * (size - WIDTH + 1) // 5)


def places(shingles: np.ndarray, size: int) -> np.ndarray:
    """Where the filter has shingles of items of a size; size 0 stands for any size."""
    salt = words.mix(np.array([size], np.uint64))
    return (words.mix(shingles ^ salt) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def fingerprint(shingles: np.ndarray) -> int:
    """The SimHash of some sorted shingles and their occurrence numbers, as a signed integer."""
    new = np.ones(len(shingles), bool)
    new[1:] = shingles[1:] != shingles[:-1]
    at = np.arange(len(shingles))
    number = at - np.maximum.accumulate(np.where(new, at, 0))
    bits = np.unpackbits(words.mix(shingles ^ words.mix(number)).view(np.uint8).reshape(-1, 8), axis=1)
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(shingles)).view(np.int64)[0])


def _shingled(texts: pa.Array):
    """``(place, number of words, shingles)`` of each text, in words without case and punctuation."""
    for first, last, data, offsets in words.chunks(texts):
        hashes, counts = words.words(data, offsets, words.PUNCTUATION)
        shingles, sizes = words.shingles(hashes, counts, WIDTH, short=False)
        yield first, counts, shingles, sizes


def described_items(items: DataFrame) -> DataFrame:
    """``item_id, size, print, shingles, place`` of every item of at least ``WIDTH`` words."""

    def run(batches):
        for batch in batches:
            for first, counts, shingles, sizes in _shingled(batch.column("text")):
                ends = np.cumsum(sizes)
                rows = {"item_id": [], "size": [], "print": [], "shingles": [], "place": []}
                for i in np.flatnonzero(sizes):
                    own, size = shingles[ends[i] - sizes[i] : ends[i]], int(counts[i])
                    rows["item_id"].append(batch.column("item_id")[first + int(i)].as_py())
                    rows["size"].append(size)
                    held = np.sort(own)
                    rows["print"].append(fingerprint(held))
                    rows["shingles"].append(held.tobytes())
                    rows["place"].append(np.concatenate([places(own, size), places(own, 0)]).tolist())
                yield pa.RecordBatch.from_pydict(rows, schema)

    schema = pa.schema([("item_id", pa.int64()), ("size", pa.int32()), ("print", pa.int64()), ("shingles", pa.binary()), ("place", pa.list_(pa.int64()))])
    return items.mapInArrow(run, "item_id long, size int, print long, shingles binary, place array<long>")


def windows(docs: DataFrame, sizes: list[int], kept: bytes) -> DataFrame:
    """``doc_id, row, start, size, content, print, shingles`` of every window that may be similar to an item.

    ``start`` counts words; ``content`` stands for the window's shingles. A text with fewer words than an
    item is one window of the item's size.
    """
    least = min(map(fewest, sizes), default=0)
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("size", pa.int32()), ("content", pa.int64()), ("print", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        for batch in batches:
            for first, _, shingles, counts in _shingled(batch.column("text")):
                may = bits_at(kept, places(shingles, 0))
                ends = np.cumsum(counts)
                before = np.concatenate([[0], np.cumsum(may)])
                hits = before[ends] - before[ends - counts]
                rows = []
                for i in np.flatnonzero(hits >= least) if sizes else ():
                    own, mine = shingles[ends[i] - counts[i] : ends[i]], may[ends[i] - counts[i] : ends[i]]
                    at = np.flatnonzero(mine)
                    for size in sizes:
                        if len(own) < fewest(size):
                            continue
                        span = min(size - WIDTH + 1, len(own))
                        need = needed(size, span)
                        if hits[i] < need:
                            continue
                        inside = np.zeros(len(own) + 1, np.int64)
                        inside[at + 1] = bits_at(kept, places(own[at], size))
                        inside = np.cumsum(inside)
                        for start in np.flatnonzero(inside[span:] - inside[:-span] >= need):
                            part = np.sort(own[start : start + span])
                            held = part.tobytes()
                            content = int.from_bytes(hashlib.blake2b(held, digest_size=8).digest(), "little", signed=True)
                            place = first + int(i)
                            rows.append((batch.column("doc_id")[place].as_py(), batch.column("row")[place].as_py(), int(start), size, content, fingerprint(part), held))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema)

    return docs.mapInArrow(run, "doc_id long, row long, start long, size int, content long, print long, shingles binary")


def blocks(rows: DataFrame) -> DataFrame:
    """``rows`` once for each block of their fingerprint, with ``block`` and its ``bits``."""
    edges = [BITS * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    cuts = ", ".join(f"named_struct('block', {i}, 'bits', shiftrightunsigned(print, {low}) & {(1 << (high - low)) - 1}L)" for i, (low, high) in enumerate(zip(edges, edges[1:])))
    return rows.select("*", F.expr(f"inline(array({cuts}))"))


@F.arrow_udf(T.DoubleType())
def similarity(lefts: pa.Array, rights: pa.Array) -> pa.Array:
    """Shared over united occurrences of shingles of two sorted lists."""
    out = []
    for left, right in zip(lefts, rights):
        x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
        (a, n), (b, m) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
        _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        shared = int(np.minimum(n[i], m[j]).sum())
        out.append(shared / (len(x) + len(y) - shared))
    return pa.array(out, pa.float64())


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", threshold: float = 0.8) -> DataFrame:
    """``doc_id, item_id, similarity, start, row``: the best window of a row for each item it holds.

    Words are runs of ASCII letters, digits and other characters outside ASCII, A-Z lowered; ``start``
    counts them. A text with fewer words than an item is compared with it as a whole. An item with fewer
    than ``WIDTH`` words is too short to be found. Null texts are empty
    and hold nothing; of equal similarities the first window counts; repeated rows each have their rows
    and ``row`` tells them apart; other columns are not looked at; an empty table gives an empty result.
    ``threshold`` may not be below 0.8. Only the distinct sizes of items and the filter reach the driver.
    """
    if threshold < 0.8:
        raise ValueError("windows below a similarity of 0.8 are not made")
    with Scratch(docs.sparkSession) as scratch:
        known = scratch.keep(described_items(items.select("item_id", "text")))
        kept = bit_filter(known.selectExpr("explode(place) AS place").distinct())
        sizes = sorted(r.size for r in known.select("size").distinct().toLocalIterator())
        rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
        found = scratch.keep(windows(rows, sizes, kept))
        contents = found.select("content", "size", "print", "shingles").dropDuplicates(["content", "size"])
        left, right = blocks(contents), blocks(known.drop("place").withColumnRenamed("print", "item_print").withColumnRenamed("shingles", "item_shingles").withColumn("print", F.col("item_print")))
        near = left.join(right.drop("print"), ["size", "block", "bits"]).where(f"bit_count(print ^ item_print) <= {RADIUS}")
        near = near.select("content", "size", "item_id", "shingles", "item_shingles").dropDuplicates(["content", "size", "item_id"])
        alike = near.select("content", "size", "item_id", similarity("shingles", "item_shingles").alias("similarity")).where(F.col("similarity") >= threshold)
        hits = found.select("doc_id", "row", "start", "size", "content").join(alike, ["content", "size"])
        best = hits.groupBy("row", "item_id").agg(F.first("doc_id").alias("doc_id"), F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
        return cut(best.select("doc_id", "item_id", "best.similarity", (-F.col("best.back")).alias("start"), "row"))
