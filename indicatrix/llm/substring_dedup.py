"""Repeated passages: windows of words that a document with a smaller id has too.

A window's anchor is the smallest hash of the runs of ``INNER`` words in it, so equal windows have equal
anchors, and neighbouring windows mostly share one: such a stretch of windows is one row. A count-min sketch
counts the documents of every anchor, which is at least the number of documents of each of its windows.
Each task lists the cells that its texts count in, shard by shard; the shards are merged where they meet,
and one bit a cell, whether it counts two or more, is broadcast. A second pass groups only stretches whose
anchor may be in two documents; a window that is repeated is never left out, whatever the sketch holds.

Grouping is exact and in two steps. An anchor whose stretches are all the same settles them as a whole.
Where they differ, as at the ends of a passage, their windows are grouped one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicatrix.llm import words
from indicatrix.llm.common import Scratch, cut, whole

WIDTH = 13  # words of a window
INNER = 5  # words of an anchor
ROWS = 2  # of the sketch
MOST_CELLS = 1 << 28  # of the sketch: 32 MiB are broadcast at most
LEAST_CELLS = 1 << 16
SHARDS = 1 << 12  # of any sketch; the cells of one are merged together
HELD = 1 << 21  # cells that a task notes before it sorts them and hands them on
CHARS = 4  # of the texts for each cell
LAST = (1 << 63) - 1  # stands for a null doc_id

Stretches = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def stretches(data: np.ndarray, offsets: np.ndarray, width: int) -> Stretches:
    """``(text, start, size, anchor, windows)`` of some texts' stretches of windows with one anchor.

    ``start`` counts words, ``size`` windows; ``windows`` are the hashes of all windows in order.
    """
    inner = min(INNER, width)
    hashes, counts = words.words(data, offsets, values=words.EXACT)
    windows, sizes = words.shingles(hashes, counts, width, short=False)
    runs, many = words.shingles(hashes, counts, inner, short=False)
    text = np.repeat(np.arange(len(counts)), sizes)
    place = np.arange(len(windows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    least = runs.copy()
    for k in range(1, width - inner + 1):
        np.minimum(least[:-k], runs[k:], out=least[:-k])
    anchor = least[(np.cumsum(many) - many)[text] + place]
    new = np.ones(len(windows), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    begins = np.flatnonzero(new)
    return text[begins], place[begins], np.diff(np.append(begins, len(windows))), anchor[begins], windows


def cells_of(anchors: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each anchor in each row of the sketch."""
    per_row = np.uint64(cells // ROWS)
    return np.stack([(words.mix(anchors + np.uint64(turn + 1)) % per_row + np.uint64(turn) * per_row).astype(np.int64) for turn in range(ROWS)])


def sketched(docs: DataFrame, cells: int, width: int) -> DataFrame:
    """``shard, places``: the cells that each task's texts count in, a document once for each anchor.

    A task notes cells and hands them on with one row for each shard, so rows grow with the tasks alone.
    """
    size = shard_size(cells)

    def noted(text, anchor):
        order = np.lexsort((anchor, text))
        text, anchor = text[order], anchor[order]
        once = np.ones(len(text), bool)
        once[1:] = (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])
        return cells_of(anchor[once], cells).ravel()

    def handed_on(notes):
        at = np.sort(np.concatenate(notes))
        twice = np.zeros(len(at), bool)
        twice[2:] = at[2:] == at[:-2]
        at = at[~twice]  # two say as much as more
        shard = at // size
        begins = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(at) else np.zeros(0, int)
        ends = np.append(begins[1:], len(at)).astype(np.int64)
        raw = (at % size).astype(np.uint16).tobytes()
        blobs = [raw[2 * low : 2 * high] for low, high in zip(begins.tolist(), ends.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(shard[begins].astype(np.int32)), pa.array(blobs, pa.binary())], ["shard", "places"])

    def run(batches):
        notes, held = [np.zeros(0, np.int64)], 0
        for batch in batches:
            for _, _, data, offsets in words.chunks(batch.column("text")):
                text, _, _, anchor, _ = stretches(data, offsets, width)
                notes.append(noted(text, anchor))
                held += len(notes[-1])
                if held > HELD:
                    yield handed_on(notes)
                    notes, held = [np.zeros(0, np.int64)], 0
        yield handed_on(notes)

    return docs.select("text").mapInArrow(run, "shard int, places binary")


def shard_size(cells: int) -> int:
    """Cells of a shard: at least a byte of bits, at most what 16 bits can number."""
    return max(8, cells // SHARDS)


def merged(parts: DataFrame, size: int) -> DataFrame:
    """``shard, bits``: which cells of a shard of a ``size`` count two or more. Rows come sorted, so a task holds one shard."""

    def packed(shard, counts):
        bits = np.packbits(counts > 1, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([bits], pa.binary())], ["shard", "bits"])

    def run(batches):
        current, counts = None, None
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if len(shards) else np.zeros(0, int)
            for low, high in zip(begins, np.append(begins[1:], len(shards))):
                if shards[low] != current:
                    if current is not None:
                        yield packed(current, counts)
                    current, counts = int(shards[low]), np.zeros(size, np.uint8)
                places = np.frombuffer(b"".join(batch.column("places")[low:high].to_pylist()), np.uint16)
                counts = np.minimum(counts + np.bincount(places, minlength=size), 2).astype(np.uint8)
        if current is not None:
            yield packed(current, counts)

    return parts.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "shard int, bits binary")


def repeated_cells(docs: DataFrame, cells: int, width: int) -> np.ndarray:
    """One bit for each cell of the merged sketch; ``cells / 8`` bytes reach the driver."""
    size = shard_size(cells)
    out = np.zeros((-(-cells // size), size // 8), np.uint8)
    for batch in merged(sketched(docs, cells, width), size).toArrow().to_batches():
        for shard, bits in zip(batch.column("shard").to_pylist(), batch.column("bits")):
            out[shard] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out.ravel()


def candidates(docs: DataFrame, kept, cells: int, width: int, windows: bool) -> DataFrame:
    """``anchor, doc, content`` of the stretches whose anchor may be in two documents; or with ``key, start, size, hashes``."""
    schema = "anchor long, doc long, " + ("key long, start int, size int, hashes array<long>" if windows else "content long")

    def one(batch, first, last, data, offsets) -> Iterator[pa.RecordBatch]:
        text, start, size, anchor, hashes = stretches(data, offsets, width)
        at = cells_of(anchor, cells)
        may = np.all((kept.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1, axis=0)
        doc = batch.column("doc")[first:last].take(pa.array(text[may]))
        out = {"anchor": pa.array(anchor[may].view(np.int64)), "doc": doc}
        if windows:
            hashes, sizes = hashes[np.repeat(may, size)], size[may]
            edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            out["key"] = batch.column("key")[first:last].take(pa.array(text[may]))
            out["start"], out["size"] = pa.array(start[may].astype(np.int32)), pa.array(sizes.astype(np.int32))
            out["hashes"] = pa.ListArray.from_arrays(pa.array(edges), pa.array(hashes.view(np.int64)))
        else:
            begins = np.cumsum(size) - size
            content = np.add.reduceat(words.mix(hashes), begins) if len(begins) else hashes
            out["content"] = pa.array(content[may].view(np.int64))
        yield pa.RecordBatch.from_pydict(out)

    def run(batches):
        for batch in batches:
            for chunk in words.chunks(batch.column("text")):
                yield from one(batch, *chunk)

    return docs.select("doc", "key", "text").mapInArrow(run, schema)


def repeated_windows(docs: DataFrame, width: int, most_cells: int, scratch: Scratch) -> DataFrame:
    """``doc, key, start, size``: stretches of windows of ``docs(doc, key, text)`` that a smaller ``doc`` has too."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    cells = LEAST_CELLS
    while cells < min(chars // CHARS, most_cells):
        cells *= 2
    kept = docs.sparkSession.sparkContext.broadcast(repeated_cells(docs, cells, width))
    span = [F.min("doc").alias("first"), F.max("doc").alias("last")]
    anchors = candidates(docs, kept, cells, width, False).groupBy("anchor").agg(*span, F.min("content").alias("low"), F.max("content").alias("high"))
    anchors = scratch.keep(anchors.where("first < last").selectExpr("anchor", "first", "low <> high AS mixed"))
    placed = candidates(docs, kept, cells, width, True).join(anchors, "anchor").where("mixed OR doc > first")
    placed = scratch.keep(placed.selectExpr("doc", "key", "start", "size", "mixed", "anchor", "IF(mixed, hashes, NULL) AS hashes"))
    single = placed.where("mixed").selectExpr("doc", "key", "start", "anchor", "posexplode(hashes) AS (place, window)")
    # Kept, so the join deals it out anew and a window of very many documents can be split.
    firsts = scratch.keep(single.groupBy("anchor", "window").agg(*span).where("first < last").select("anchor", "window", "first"))
    single = single.join(firsts, ["anchor", "window"]).where("doc > first").selectExpr("doc", "key", "start + place AS start", "1 AS size")
    return placed.where("NOT mixed").select("doc", "key", "start", "size").unionAll(single)


def without_repeats(docs: DataFrame, text: str = "text", width: int = WIDTH, most_cells: int = MOST_CELLS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every row of ``docs``.

    Words are runs of characters other than ASCII white space, as they stand. A word is removed if a window
    of ``width`` words covers it whose words also begin in a row with a smaller ``doc_id``; windows are those
    of the input. ``kept`` has the other words, joined by one space. Null texts, empty texts and texts with
    fewer words than a window lose nothing. A null ``doc_id`` counts as the largest one. Rows of one
    ``doc_id`` do not remove anything from each other; of repeated rows each has its row in the result. Other
    columns are not looked at; an empty table gives an empty result. Windows are known by a 64-bit hash
    and the 64-bit hash of their anchor. The sketch has ``most_cells`` at most; with many more anchors than
    that it rules nothing out, and all stretches are grouped.
    """
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), whole(text).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    with Scratch(docs.sparkSession) as scratch:
        spans = repeated_windows(rows, width, most_cells, scratch).groupBy("doc", "key").agg(F.collect_set(F.struct("start", "size")).alias("spans"))
        spans = cut(spans)

    def run(batches):
        for batch in batches:
            for first, last, data, offsets in words.chunks(batch.column("text")):
                raw, counts, removed, kept = data.tobytes(), [], [], []
                for k, span in enumerate(batch.column("spans")[first:last]):
                    parts = raw[offsets[k] : offsets[k + 1]].split()
                    gone = 0
                    counts.append(len(parts))
                    if span.is_valid:
                        depth = np.zeros(len(parts) + 1, np.int64)
                        start, size = (span.values.field(i).to_numpy() for i in (0, 1))
                        np.add.at(depth, start, 1)
                        np.add.at(depth, start + size + width - 1, -1)
                        away = np.cumsum(depth)[:-1] > 0
                        gone = int(away.sum())
                        parts = [part for part, one in zip(parts, away.tolist()) if not one]
                    removed.append(gone)
                    kept.append(b" ".join(parts))
                columns = [batch.column("doc_id")[first:last], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])

    return rows.join(spans, ["doc", "key"], "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
