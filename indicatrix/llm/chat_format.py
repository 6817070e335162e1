"""Chat formatting: turns are laid into one preallocated Arrow buffer.

The template of a turn is ``<|role|>`` and a line break, the text, ``<|end|>`` and a line break. A
backslash goes before each backslash and each bar of roles and texts, so no text can hold a mark of the
template, and taking the backslashes away gives the text back.

Lengths of all segments, their cumulative offsets and a scatter index for every byte are computed in
numpy; then marks and contents are copied, each with one assignment. No turn is a Python string.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 2 << 20  # bytes of texts formatted together; a longer text is a chunk of its own
MARKS = [b"<|", b"|>\n", b"<|end|>\n"]  # before the role, after it, after the text
PARTS = "conv_id long, part long, n_turns long, formatted string, loss_start array<int>, loss_end array<int>"


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class _Contents:
    """One content column: where escapes go and how long each row becomes."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = _bytes(column)
        self.special = (self.data == 0x5C) | (self.data == 0x7C)
        self.before = np.concatenate([[0], np.cumsum(self.special)])
        self.lengths = np.diff(self.offsets) + np.diff(self.before[self.offsets])

    def scatter(self, out: np.ndarray, starts: np.ndarray) -> None:
        shift = starts - self.offsets[:-1] - self.before[self.offsets[:-1]]
        place = np.repeat(shift, np.diff(self.offsets)) + np.arange(len(self.data)) + self.before[1:]
        out[place] = self.data
        out[place[self.special] - 1] = 0x5C


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(buffer, turn offsets, text starts, text ends)`` of formatted turns laid end to end."""
    role, text = _Contents(roles), _Contents(texts)
    lengths = [np.full(len(roles), len(MARKS[0])), role.lengths, np.full(len(roles), len(MARKS[1])), text.lengths, np.full(len(roles), len(MARKS[2]))]
    turn = np.concatenate([[0], np.cumsum(sum(lengths))])
    starts = [turn[:-1]]
    for length in lengths:
        starts.append(starts[-1] + length)
    out = np.empty(turn[-1], np.uint8)
    for mark, at in zip(MARKS, (starts[0], starts[2], starts[4])):
        out[at[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    role.scatter(out, starts[1])
    text.scatter(out, starts[3])
    return out, turn, starts[3], starts[4]


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``CHUNK`` bytes."""
    sizes = np.cumsum(batch.column("size").to_numpy())
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + CHUNK, "right")))
        yield batch.slice(first, last - first)
        first = last


def _ragged(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, pa.int32()))


def format_chats(turns: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """Formatted conversations in parts: ``conv_id, part, n_turns, formatted, loss_start, loss_end``.

    ``turns`` has ``conv_id, turn, role, text``. Rows are laid out by turn; rows of one turn by role,
    then text; null comes first. Null roles and texts are empty; repeated rows stay; null ``conv_id``
    is one conversation. The parts of a conversation in order of ``part`` are its formatted text: a
    range of rows is a task, so a very long conversation is many parts and many tasks. ``loss_start``
    and ``loss_end`` are byte offsets, within the part, of the texts whose role is ``learn_from``.
    """
    keys = ["conv_id", "turn", "role", "text"]
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("role"), F.lit(0)))
    rows = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions(*keys)

    def run(batches):
        part = TaskContext.get().partitionId() << 33
        for whole_batch in batches:
            for batch in _chunks(whole_batch):
                buffer, turn, text_start, text_end = assemble(batch.column("role"), batch.column("text"))
                conv = batch.column("conv_id")
                known, value = conv.is_valid().to_numpy(zero_copy_only=False), conv.fill_null(0).to_numpy()
                new = np.ones(len(value), bool)
                new[1:] = (known[1:] != known[:-1]) | (value[1:] != value[:-1])
                first = np.flatnonzero(new)
                sizes = np.diff(np.append(first, len(value)))
                begin = turn[first]
                offsets = np.append(begin, turn[-1])
                loss = (np.array(batch.column("role").to_pylist(), object) == learn_from).astype(bool)
                at = np.repeat(begin, sizes)
                losses = np.add.reduceat(loss.astype(int), first)
                yield pa.RecordBatch.from_arrays(
                    [
                        conv.take(pa.array(first)),
                        pa.array(part + np.arange(len(first))),
                        pa.array(sizes),
                        pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(buffer)]).cast(pa.string()),
                        _ragged((text_start - at)[loss], losses),
                        _ragged((text_end - at)[loss], losses),
                    ],
                    ["conv_id", "part", "n_turns", "formatted", "loss_start", "loss_end"],
                )
                part += len(first)

    return rows.mapInArrow(run, PARTS)


_TURN = re.compile(rb"<\|([^\\|]*(?:\\.[^\\|]*)*)\|>\n([^\\|]*(?:\\.[^\\|]*)*)<\|end\|>\n", re.DOTALL)
_ESCAPED = re.compile(rb"\\(.)", re.DOTALL)


def unescape(text: bytes) -> bytes:
    return _ESCAPED.sub(rb"\1", text)


def read_turns(formatted: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Role and text of each turn of a formatted part; a byte that is no turn is an error."""
    at = 0
    while at < len(formatted):
        turn = _TURN.match(formatted, at)
        if turn is None:
            raise ValueError(f"no turn at byte {at}")
        yield unescape(turn[1]), unescape(turn[2])
        at = turn.end()


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest_chats(parts: DataFrame) -> DataFrame:
    """What each conversation holds, read back from its formatted parts alone.

    Turns come from the marks, the learnt texts from the loss spans. The parts of a conversation stream
    through running digests in order, one at a time: a digest of a whole cannot be split, but nothing
    is held.
    """

    def run(batches):
        now, started = None, False
        fields = [f.split()[0] for f in DIGESTS.split(", ")]

        def row():
            conv, turns, chars, loss, turn_hash, loss_hash = now
            return pa.RecordBatch.from_pylist([dict(zip(fields, (conv, turns, turn_hash.hexdigest(), loss, loss_hash.hexdigest(), chars)))], schema)

        kinds = {"long": pa.int64(), "string": pa.string()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in DIGESTS.split(", "))])
        for batch in batches:
            for conv, formatted, starts, ends in zip(*(batch.column(c) for c in ("conv_id", "formatted", "loss_start", "loss_end"))):
                conv, formatted = conv.as_py(), formatted.as_py().encode()
                if not started or conv != now[0]:
                    if started:
                        yield row()
                    now, started = [conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()], True
                for role, text in read_turns(formatted):
                    now[1] += 1
                    now[4].update(role + b"\n" + text + b"\n")
                now[2] += len(formatted.decode())
                for start, end in zip(starts.as_py(), ends.as_py()):
                    learnt = unescape(formatted[start:end])
                    now[3] += len(learnt.decode())
                    now[5].update(learnt)
        if started:
            yield row()

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, DIGESTS)
