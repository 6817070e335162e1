"""Documents whose sets of word shingles are alike, by a pigeonhole join of parity sketches.

A sketch toggles one bit for each shingle, so the Hamming distance of two sketches is at most the size
of the symmetric difference of their sets. Sets of sizes a <= b with 5 * shared >= 4 * united differ in
at most (a + b) / 9 shingles. Sizes fall into bands; the sketch of a band is cut into more blocks than
sets of that band can differ in, so alike sets agree on whole blocks, and these are joined. The bits of
a block are very many and nearly all zero, so a block is held as the exclusive or of its shingles'
64-bit hashes. A set is sketched for its own band and for the next, where larger partners are.

Blocks without a shingle, and blocks that more than ``CROWD`` different sets share (a licence, a
common passage, a large group of copies), say little and are left out. A band has ``slack`` more blocks
than needed, so a set with at most that many such blocks still meets every partner elsewhere. The sets
with more of them meet among themselves by their rarest shingles, without any limit on a group's size.

Equal sets are one class from the start. Each group first compares its members with one of them, its
leader. Only what this leaves in different components is compared further, and of large groups only
pairs that may share enough by the places of the shared shingle in both sets.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicatrix.llm import words
from indicatrix.llm.common import FILTER_BITS, Scratch, bit_filter, bits_at, cut, release
from indicatrix.llm.components import connected

WIDTH = 5  # words of a shingle
CROWD = 64  # different sets in a block's group from which the block says little
LEAST_BITS, SPREAD = 512, 2  # bits of a dense sketch, at least and for each shingle; it rules candidates out
TINY = 128  # in the low byte of a key: the row counts a block that says little; else that byte is the band


# --- sets and bands ---------------------------------------------------------------
@functools.cache
def bands() -> np.ndarray:
    """The smallest size of each band; each is about 1.25 times the one before."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return np.array(out)


def band_of(sizes: np.ndarray) -> np.ndarray:
    return np.searchsorted(bands(), sizes, "right") - 1


def most_different(band: np.ndarray) -> np.ndarray:
    """The most shingles in which two alike sets differ, the larger of which is in this band."""
    return 2 * (bands()[band + 1] - 1) // 9


def slack(band: np.ndarray) -> np.ndarray:
    """Blocks of a set in this band that may say little."""
    return most_different(band) // 6 + 1


def sets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, hashes, sizes)`` of runs of texts: the sorted distinct shingle hashes of each."""
    for first, last, data, offsets in words.chunks(texts):
        hashes, sizes = words.shingles(*words.words(data, offsets), WIDTH)
        ends = np.cumsum(sizes)
        for low, high in zip(ends - sizes, ends):
            hashes[low:high].sort()
        text = np.repeat(np.arange(last - first), sizes)
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
        yield first, last, hashes[new], np.bincount(text[new], minlength=last - first)


def class_ids(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One id for all equal sets; 0 for the empty one."""
    out = np.zeros(len(sizes), np.int64)
    ends = np.cumsum(sizes)
    for i in np.flatnonzero(sizes):
        digest = hashlib.blake2b(hashes[ends[i] - sizes[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little", signed=True)
    return out


def dense_sketch(hashes: np.ndarray) -> bytes:
    """The parity of a set's shingles in each of some bits: a power of two, at least ``SPREAD`` for a shingle."""
    bits = LEAST_BITS
    while bits < SPREAD * len(hashes):
        bits *= 2
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def distance(left: bytes, right: bytes) -> int:
    """The Hamming distance of two sketches; the longer one is folded, which keeps the parities right."""
    x, y = np.frombuffer(left, np.uint8), np.frombuffer(right, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def block_keys(hashes: np.ndarray, sizes: np.ndarray, classes: np.ndarray, ahead: int) -> tuple[np.ndarray, np.ndarray]:
    """``(keys, classes)`` of the sketch blocks of sets, for their own band or the next one.

    A set of a band that no larger partner can be in has no blocks there. For each block without a
    shingle there is a row that counts it.
    """
    own = band_of(np.maximum(sizes, 1))
    band = own + ahead
    takes_part = (sizes > 0) & (sizes * 5 // 4 >= bands()[band])
    blocks = np.where(takes_part, most_different(band) + 1 + slack(band), 0)
    text = np.repeat(np.arange(len(sizes)), np.where(takes_part, sizes, 0))
    mine = hashes[np.repeat(takes_part, sizes)]
    # The upper half of a hash chooses the block, so sorted hashes come block by block.
    block = ((mine >> np.uint64(32)) * blocks[text].astype(np.uint64)) >> np.uint64(32)
    new = np.ones(len(mine), bool)
    new[1:] = (block[1:] != block[:-1]) | (text[1:] != text[:-1])
    begins = np.flatnonzero(new)
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    parity = np.bitwise_xor.reduceat(words.mix(mine), begins)
    at = text[begins]
    where = block[begins] * np.uint64(256) + band[at].astype(np.uint64)
    keys = (words.mix(parity ^ words.mix(where)) & ~np.uint64(255)) | band[at].astype(np.uint64)
    first_block = np.cumsum(blocks) - blocks
    empty = np.ones(int(blocks.sum()), bool)
    empty[first_block[at] + block[begins].astype(np.int64)] = False
    empty = np.flatnonzero(empty)
    none = np.searchsorted(first_block + blocks, empty, "right")
    tiny = says_little(classes[none], empty - first_block[none], band[none])
    return np.concatenate([keys.view(np.int64), tiny]), classes[np.concatenate([at, none])]


def says_little(owners: np.ndarray, what: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Keys of rows that count a block that says little: spread by owner, and equal for equal blocks."""
    spread = words.mix(words.mix(owners) ^ what.astype(np.uint64)) & ~np.uint64(255)
    return (spread | (band | TINY).astype(np.uint64)).view(np.int64)


def _mapped(rows: DataFrame, one_batch: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches):
        try:
            for batch in batches:
                yield from one_batch(batch)
        finally:
            release()

    return rows.mapInArrow(run, schema)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def described(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, class, sketch`` of every row of ``docs(doc_id, text)``."""

    def one(batch):
        for first, last, hashes, sizes in sets(batch.column("text")):
            ends = np.cumsum(sizes)
            sketches = [dense_sketch(hashes[low:high]) for low, high in zip(ends - sizes, ends)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[first:last], pa.array(sizes.astype(np.int64)), pa.array(class_ids(hashes, sizes)), pa.array(sketches, pa.binary())],
                ["doc_id", "n_shingles", "class", "sketch"],
            )

    return _mapped(docs, one, "doc_id long, n_shingles long, class long, sketch binary")


def keyed(docs: DataFrame) -> DataFrame:
    """``key, class`` for the sketch blocks of every text, each pair once for a batch of texts."""

    def one(batch):
        for _, _, hashes, sizes in sets(batch.column("text")):
            classes = class_ids(hashes, sizes)
            firsts = np.unique(classes, return_index=True)[1]
            once = np.zeros(len(classes), bool)
            once[firsts] = sizes[firsts] > 0
            mine, few, known = hashes[np.repeat(once, sizes)], sizes[once], classes[once]
            for ahead in (0, 1):
                keys, owners = crowded_once(*block_keys(mine, few, known, ahead))
                yield _batch(key=keys, **{"class": owners})

    return _mapped(docs.select("text"), one, "key long, class long")


def crowded_once(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same rows, but of a key with more than ``CROWD`` owners here only one more than that many.

    They suffice to show it is crowded. The other owners' rows become rows that count a block that
    says little, which are spread by owner: so a very common block is not all sent to one task.
    """
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    begins = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(keys) else np.zeros(0, int)
    lengths = np.diff(np.append(begins, len(keys)))
    rank = np.arange(len(keys)) - np.repeat(begins, lengths)
    band = sorted_keys & 255
    extra = (rank > CROWD) & (band < TINY)
    return np.where(extra, says_little(owners[order], sorted_keys, band), sorted_keys), owners[order]


# --- groups -------------------------------------------------------------------------
GROUPED = "key long, class long, leader long"


def grouped(keys: DataFrame) -> DataFrame:
    """``key, class, leader`` of all groups of 2 to ``CROWD`` classes, and rows that count crowded blocks.

    Such rows have a null leader and the band of the block plus ``TINY`` as their key. Rows come sorted,
    so a task holds one batch and at most ``CROWD`` rows of an unfinished group.
    """

    def settle(key, owner):
        """Complete groups, sorted by key and owner."""
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        lengths = np.diff(np.append(begins, len(key)))
        crowd = np.repeat(lengths > CROWD, lengths)
        yield from little(key[crowd], owner[crowd])
        good = np.repeat((lengths > 1) & (lengths <= CROWD), lengths)
        if good.any():
            key, owner = key[good], owner[good]
            lengths = lengths[(lengths > 1) & (lengths <= CROWD)]
            begins = np.cumsum(lengths) - lengths
            draw = words.mix(owner ^ (key >> 8))
            least = np.repeat(np.minimum.reduceat(draw, begins), lengths)
            leader = np.repeat(owner[draw == least], lengths)
            yield _batch(key=key, **{"class": owner}, leader=leader)

    def little(key, owner):
        if len(key):
            yield _batch(key=(key & 255) | TINY, **{"class": owner}, leader=pa.nulls(len(key), pa.int64()))

    def run(batches):
        key, owner, crowded = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            new_key, new_owner = batch.column("key").to_numpy(), batch.column("class").to_numpy()
            tiny = (new_key & TINY) != 0
            once = tiny.copy()
            once[1:] &= (new_key[1:] != new_key[:-1]) | (new_owner[1:] != new_owner[:-1])
            yield from little(new_key[once], new_owner[once])
            new_key, new_owner = new_key[~tiny], new_owner[~tiny]
            if crowded is not None:
                more = new_key == crowded
                yield from little(new_key[more], new_owner[more])
                new_key, new_owner = new_key[~more], new_owner[~more]
            if not len(new_key):
                continue
            key, owner = np.concatenate([key, new_key]), np.concatenate([owner, new_owner])
            other = np.ones(len(key), bool)
            other[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            key, owner = key[other], owner[other]
            open_from = int(np.searchsorted(key, key[-1]))
            yield from settle(key[:open_from], owner[:open_from])
            key, owner, crowded = key[open_from:], owner[open_from:], None
            if len(key) > CROWD:
                yield from little(key, owner)
                crowded, key, owner = key[0], key[:0], owner[:0]
        yield from settle(key, owner)

    return keys.repartition("key").sortWithinPartitions("key", "class").mapInArrow(run, GROUPED)


# --- sets of some classes -------------------------------------------------------------
def sets_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``class, members`` for the wanted ``classes(class)``: each set's sorted 64-bit hashes, once."""
    wanted = classes.select("class").distinct()
    kept = bit_filter(wanted.selectExpr(f"class & {FILTER_BITS - 1} AS place"))

    def one(batch):
        for _, _, hashes, sizes in sets(batch.column("text")):
            owners = class_ids(hashes, sizes)
            hit = bits_at(kept, owners & (FILTER_BITS - 1)) & (sizes > 0)
            ends = np.cumsum(sizes)
            seen = {}
            for i in np.flatnonzero(hit):
                seen.setdefault(int(owners[i]), hashes[ends[i] - sizes[i] : ends[i]].tobytes())
            yield _batch(**{"class": pa.array(list(seen), pa.int64()), "members": pa.array(list(seen.values()), pa.binary())})

    found = _mapped(docs.select("text"), one, "class long, members binary")
    return found.join(wanted, "class", "left_semi").groupBy("class").agg(F.first("members").alias("members"))


# --- links --------------------------------------------------------------------------
def alike(pairs: DataFrame, about: DataFrame, members: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """The ``pairs(a, b)`` whose sets are alike: sizes and dense sketches rule out, then the sets decide."""

    @F.arrow_udf("boolean")
    def near(n_a: pa.Array, s_a: pa.Array, n_b: pa.Array, s_b: pa.Array) -> pa.Array:
        sizes = n_a.to_numpy() + n_b.to_numpy()
        return pa.array([9 * distance(x.as_buffer(), y.as_buffer()) <= n for n, x, y in zip(sizes, s_a, s_b)], pa.bool_())

    side = about.select("class", "n_shingles", "sketch")
    likely = (
        pairs.join(side.toDF("a", "n_a", "s_a"), "a")
        .join(side.toDF("b", "n_b", "s_b"), "b")
        .where("5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)")
        .where(near("n_a", "s_a", "n_b", "s_b"))
        .select("a", "b")
    )
    likely = scratch.keep(likely)
    nodes = likely.select(F.col("a").alias("class")).unionAll(likely.select(F.col("b").alias("class")))
    held = members(nodes)

    @F.arrow_udf("boolean")
    def enough(lefts: pa.Array, rights: pa.Array) -> pa.Array:
        out = []
        for left, right in zip(lefts, rights):
            x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
            at = np.searchsorted(x, y)
            shared = int((x[np.minimum(at, len(x) - 1)] == y).sum())
            out.append(100 * shared >= 80 * (len(x) + len(y) - shared))
        return pa.array(out, pa.bool_())

    return (
        likely.join(held.toDF("a", "m_a"), "a").join(held.toDF("b", "m_b"), "b").where(enough("m_a", "m_b")).select("a", "b")
    )


def rare_groups(held: DataFrame, scratch: Scratch) -> DataFrame:
    """Groups of sets by their rarest shingles: ``key, class, leader, n, rank`` for ``held(class, members)``.

    Alike sets share at least 80 % of either, so they share one of the first n - ceil(0.8 n) + 1
    shingles of either, in one order for all. The order puts shingles of one set first, then those of up
    to ``CROWD`` sets, then the others; two filters of fixed size say so, and where they err they err
    for all sets alike. ``rank`` is the shingle's place in its set of ``n``. The leader of a group is the
    set with the fewest shingles of its own: of edited copies, the original.
    """

    @F.arrow_udf("array<bigint>")
    def unpacked(blobs: pa.Array) -> pa.Array:
        flat = [np.frombuffer(blob.as_buffer(), np.int64) for blob in blobs]
        ends = np.cumsum([0, *map(len, flat)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *flat])))

    held = scratch.keep(held)
    place = F.col("key").bitwiseAND(FILTER_BITS - 1).alias("place")
    counts = scratch.keep(held.select(F.explode(unpacked("members")).alias("key")).groupBy("key").count().where("count > 1").select(place, "count"))
    shared, crowded = bit_filter(counts), bit_filter(counts.where(F.col("count") > CROWD))

    def one(batch):
        key, owner, size, rank, alone = [], [], [], [], []
        for number, blob in zip(batch.column("class").to_pylist(), batch.column("members")):
            own = np.frombuffer(blob.as_buffer(), np.int64)
            places = own & (FILTER_BITS - 1)
            often = bits_at(shared, places).astype(int) + bits_at(crowded, places)
            order = np.lexsort((own, often))[: len(own) - -(-4 * len(own) // 5) + 1]
            meets = np.flatnonzero(often[order])
            key.append(own[order[meets]])
            rank.append(meets + 1)
            for column, value in ((owner, number), (size, len(own)), (alone, int((often == 0).sum()))):
                column.append(np.full(len(meets), value, np.int64))
        yield _batch(key=np.concatenate(key), **{"class": np.concatenate(owner)}, n=np.concatenate(size), rank=np.concatenate(rank), alone=np.concatenate(alone))

    rows = scratch.keep(_mapped(held, one, "key long, class long, n long, rank long, alone long"))
    leaders = rows.groupBy("key").agg(F.min_by("class", F.struct("alone", F.xxhash64("key", "class"))).alias("leader"), F.count(F.lit(1)).alias("owners"))
    leaders = scratch.keep(leaders.where("owners > 1").select("key", "leader"))
    return rows.join(leaders, "key").select("key", "class", "leader", "n", "rank")


def saturated(rows: DataFrame) -> DataFrame:
    """``class`` of the sets with more blocks that say little than their band has to spare."""
    spark = rows.sparkSession
    band = np.arange(len(bands()) - 1)
    spare = spark.createDataFrame(list(zip(band.tolist(), slack(band).tolist())), "band long, spare long")
    counts = rows.where("leader IS NULL").selectExpr("class", f"key - {TINY} AS band").groupBy("class", "band").count()
    return counts.join(F.broadcast(spare), "band").where("count > spare").select("class").distinct()


def class_links(docs: DataFrame, about: DataFrame, scratch: Scratch) -> DataFrame:
    """``a, b``: enough alike pairs of classes to connect all that alike pairs connect."""
    found = scratch.keep(grouped(keyed(docs)))
    many = saturated(found)
    rare = scratch.keep(rare_groups(sets_of(docs, many), scratch))
    blocks = found.where("leader IS NOT NULL").selectExpr("key", "class", "leader", "CAST(NULL AS BIGINT) AS n", "CAST(NULL AS BIGINT) AS rank")
    groups = blocks.unionAll(rare)

    def wanted(classes):
        return sets_of(docs, classes)

    ordered = [F.least("class", "leader").alias("a"), F.greatest("class", "leader").alias("b")]
    first = groups.where("class <> leader").select(*ordered).distinct()
    links = scratch.keep(alike(first, about, wanted, scratch))
    label = connected(links).withColumnRenamed("node", "class")
    placed = groups.drop("leader").join(label, "class", "left").select("key", "class", "n", "rank", F.coalesce("component", "class").alias("label"))
    apart = scratch.keep(placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key"))
    placed = scratch.keep(placed.join(apart, "key", "left_semi"))
    other = placed.toDF("key", "other", "other_n", "other_rank", "other_label")
    # If a shingle is the rarest that two sets share, all that they share comes after it in both.
    enough = "rank IS NULL OR 9 * (1 + least(n - rank, other_n - other_rank)) >= 4 * (n + other_n)"
    rest = placed.join(other, (placed["key"] == other["key"]) & F.expr(f"label < other_label AND ({enough})"))
    rest = rest.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct()
    return links.unionAll(scratch.keep(alike(rest, about, wanted, scratch)))


def parity_join(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Words are runs of characters other than ASCII white space, A-Z lowered; a set holds the distinct
    runs of ``WIDTH`` words, or the whole sequence if a text has fewer. Two rows link when 100 times the
    shared shingles is at least 80 times the united ones; ``component_id`` is the smallest ``doc_id`` that
    links reach. A null, empty or white text has an empty set and is linked with nothing. Rows of equal
    text link like any others; a null ``doc_id`` counts as larger than all others, and a component of
    null ids only has a null id. Other columns are not looked at.
    """
    docs = docs.select("doc_id", F.col(text).alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.keep(described(docs))
        about = rows.where("n_shingles > 0").dropDuplicates(["class"])
        label = connected(class_links(docs, about, scratch)).withColumnRenamed("node", "class")
        placed = rows.where("n_shingles > 0").select("doc_id", "n_shingles", "class")
        placed = placed.join(label, "class", "left").select("doc_id", "n_shingles", F.coalesce("component", "class").alias("label"))
        least = scratch.keep(placed.groupBy("label").agg(F.min("doc_id").alias("component_id")))
        alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return cut(placed.join(least, "label").select("doc_id", "n_shingles", "component_id").unionAll(alone))
