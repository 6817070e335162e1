"""Language identification by hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1, drawn from its code point. A run of three letters is
bound into one vector: the letters' vectors, rotated by their place, multiplied. A text bundles (adds)
the vectors of its runs; a language bundles those of its texts. A text has the language whose prototype
is at the smallest angle. Bundling is linear, so runs are counted first and each distinct run's vector
is made once for a chunk of texts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicatrix.llm.common import release
from indicatrix.llm.words import mix

DIMENSIONS = 1024
RUN = 3
CHUNK = 1_000_000  # characters counted together; a longer text is a chunk of its own
CELLS = 4_000_000  # of a table of counts, texts by runs; a single text may have more
SLICE = 2048  # vectors of runs made at once
CODES = 0x110000
UNDETERMINED = "und"


@functools.cache
def letter_table() -> np.ndarray:
    """Code point -> code point of the lower-case letter, 0 for what is no letter."""
    table = np.zeros(CODES, np.int64)
    for code in range(CODES):
        letter = chr(code)
        if letter.isalpha():
            lower = letter.lower()
            table[code] = ord(lower) if len(lower) == 1 else code
    return table


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """The +1 / -1 vector of each code point; the same in every task. The space between words has one too."""
    draws = mix(codes.astype(np.uint64)[:, None] * np.uint64(DIMENSIONS) + np.arange(DIMENSIONS // 64, dtype=np.uint64) + np.uint64(1))
    bits = np.unpackbits(draws.view(np.uint8).reshape(len(codes), -1), axis=1)
    return (bits.astype(np.int8) << 1) - 1


def run_vectors(runs: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Bound vectors of runs, given as places in ``letters``."""
    base = letter_vectors(letters)
    out = np.roll(base, RUN - 1, axis=1)[runs[:, 0]]
    for place in range(1, RUN):
        out = out * np.roll(base, RUN - 1 - place, axis=1)[runs[:, place]]
    return out.astype(np.float32)


def _runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(letters, runs, text of each run)``; every stretch without letters is one space, also at the ends."""
    joined = "".join(f"\n{text}\n" for text in texts)
    codes = letter_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(len(texts)), [len(text) + 2 for text in texts])
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (owner[1:] != owner[:-1])
    codes, owner = codes[keep], owner[keep]
    present = np.zeros(CODES, bool)
    present[codes] = True
    letters = np.flatnonzero(present)
    place = np.zeros(CODES, np.int64)
    place[letters] = np.arange(len(letters))
    codes = place[codes]
    size = max(len(codes) - RUN + 1, 0)
    runs = np.stack([codes[k : k + size] for k in range(RUN)], axis=1)
    inside = owner[:size] == owner[RUN - 1 :][:size]
    return letters, runs[inside], owner[:size][inside]


def bundles(texts: list[str]) -> np.ndarray:
    """The bundled vector of each text; zeros for one without letters."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    if not texts:
        return out
    letters, runs, owner = _runs(texts)
    code = (runs[:, 0] * len(letters) + runs[:, 1]) * len(letters) + runs[:, 2]
    if len(letters) ** RUN <= 1 << 22:
        seen = np.flatnonzero(np.bincount(code, minlength=1))
        index = np.zeros(int(seen[-1]) + 1 if len(seen) else 0, np.int64)
        index[seen] = np.arange(len(seen))
        index = index[code]
    else:
        seen, index = np.unique(code, return_inverse=True)
    if len(texts) > 1 and len(texts) * len(seen) > CELLS:
        half = len(texts) // 2
        return np.concatenate([bundles(texts[:half]), bundles(texts[half:])])
    counts = np.bincount(owner * len(seen) + index, minlength=len(texts) * len(seen)).reshape(len(texts), -1).astype(np.float32)
    parts = np.stack([seen // len(letters) ** 2, seen // len(letters) % len(letters), seen % len(letters)], axis=1)
    for low in range(0, len(seen), SLICE):
        out += counts[:, low : low + SLICE] @ run_vectors(parts[low : low + SLICE], letters)
    return out


def chunked(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """``(place of the first, texts)`` of runs of texts with about ``CHUNK`` characters."""
    first, held, size = 0, [], 0
    for at, text in enumerate(texts):
        text = text.as_py() or ""
        if held and size + len(text) > CHUNK:
            yield first, held
            first, held, size = at, [], 0
        held.append(text)
        size += len(text)
    yield first, held


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Language -> prototype of unit length, from all rows with a language.

    Each task bundles its own texts, so a task sends one vector for each of its languages; their sum
    reaches the driver: ``DIMENSIONS`` numbers a language, whatever the number of texts. Rows without a
    language and null texts teach nothing, repeated rows count each time, and an empty table gives no prototypes.
    """

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, texts in chunked(batch.column("text")):
                vectors = bundles(texts).astype(np.float64)
                for name in set(langs[first : first + len(texts)]):
                    mine = [i for i in range(len(texts)) if langs[first + i] == name]
                    sums[name] = sums.get(name, 0.0) + vectors[mine].sum(axis=0)
        for name, vector in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [name] * DIMENSIONS, "place": np.arange(DIMENSIONS), "value": vector})
        release()

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang IS NOT NULL")
    sums = rows.mapInArrow(bundle, "lang string, place long, value double").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    out: dict[str, np.ndarray] = {}
    for row in sums.toLocalIterator():
        out.setdefault(row.lang, np.zeros(DIMENSIONS))[row.place] = row.value
    return {name: vector / length for name, vector in sorted(out.items()) if (length := np.linalg.norm(vector)) > 0}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct ``language(lang_pred string, score double)``.

    ``score`` is the cosine of the text and the prototype, 0 if it is negative; of equal cosines the
    first name stays. A null text or one without letters is ``und`` with score 0, and so is every text
    if nothing was learnt. Repeated rows get the same, an empty table stays empty. All other columns stay; a
    column of the name ``language`` is replaced.
    """
    names = [*prototypes]
    table = np.stack([prototypes[name] for name in names], axis=1).astype(np.float32) if names else np.zeros((DIMENSIONS, 0), np.float32)

    def nearest(texts: pa.Array) -> pa.Array:
        found, scores = [], []
        for _, chunk in chunked(texts):
            vectors = bundles(chunk)
            lengths = np.linalg.norm(vectors, axis=1)
            cosines = vectors @ table / np.maximum(lengths, 1e-9)[:, None]
            for length, row in zip(lengths, cosines):
                best = int(row.argmax()) if names and length > 0 else None
                found.append(UNDETERMINED if best is None else names[best])
                scores.append(0.0 if best is None else float(min(max(row[best], 0.0), 1.0)))
        return pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def named(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            yield from map(nearest, batches)
        finally:
            release()

    return docs.withColumn(into, named(F.col(text)))


def held_out() -> F.col:
    """Whether a row is never learnt from: crc32 of its doc_id as text leaves 1 when divided by 3. Null ids are not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``docs`` with ``language``, learnt from its rows that are not held out. An empty table stays empty; see :func:`predict`."""
    return predict(docs, learn(docs.where(~held_out())))
