"""Chat formatting: round trips and spans against plain string building."""

import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa

from indicatrix.llm import chat_format, queries
from tests.conftest import SMALL

SCHEMA = "conv_id long, turn long, role string, text string, part string, n_turns int"


def plain(role, text):
    def escaped(s):
        return (s or "").replace("\\", "\\\\").replace("|", "\\|")

    return f"<|{escaped(role)}|>\n{escaped(text)}<|end|>\n"


texts = st.one_of(st.none(), st.text(max_size=12), st.text(alphabet="<|>\\end\n", max_size=12))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(texts, texts), max_size=8))
def test_assembly(turns):
    roles, contents = pa.array([r for r, _ in turns], pa.string()), pa.array([t for _, t in turns], pa.string())
    buffer, offsets, starts, ends = chat_format.assemble(roles, contents)
    assert buffer.tobytes().decode() == "".join(plain(r, t) for r, t in turns)
    assert [(r.decode(), t.decode()) for r, t in chat_format.read_turns(buffer.tobytes())] == [(r or "", t or "") for r, t in turns]
    assert [chat_format.unescape(buffer[a:b].tobytes()).decode() for a, b in zip(starts, ends)] == [t or "" for _, t in turns]
    assert len(offsets) == len(turns) + 1


def digests(turns):
    out = defaultdict(list)
    for conv, turn, role, text, *_ in turns:
        out[conv].append(((turn is not None, turn), (role is not None, role), (text is not None, text)))
    rows = []
    for conv, own in out.items():
        own = [(r[1] or "", t[1] or "") for _, r, t in sorted(own)]
        loss = "".join(t for r, t in own if r == "assistant")
        digest = [hashlib.sha256(s.encode()).hexdigest() for s in ("".join(f"{r}\n{t}\n" for r, t in own), loss)]
        rows.append((conv, len(own), digest[0], len(loss), digest[1], sum(len(plain(r, t)) for r, t in own)))
    return sorted(rows, key=str)


def test_conversations(spark, monkeypatch):
    turns = [(i % 40, i // 40, ("user", "assistant", "system")[i % 3], f"{i} |é<|end|>\n\\" * (i % 5), "x", 1) for i in range(800)]
    turns += [(7777, i, "assistant" if i % 2 else "user", f"turn {i}", "x", 1) for i in range(3000)]
    turns += [(None, 0, "user", "a", "x", 1), (None, 1, "assistant", None, "x", 1), (5000, None, None, "", None, None), (5001, 0, "user", "long é" * 400_000, None, None)]
    turns += [(5002, 0, "assistant", "same", "x", 1)] * 3 + [(5003, 0, "b", "2", "x", 1), (5003, 0, "a", "9", "x", 1), (5003, 0, "a", "1", "x", 1)]
    rows = spark.createDataFrame(turns, SCHEMA).repartition(6)
    parts = chat_format.format_chats(rows)
    got = sorted(map(tuple, chat_format.digest_chats(parts).collect()), key=str)
    assert got == digests(turns)
    for row in parts.where("conv_id = 3").collect():
        raw = row.formatted.encode()
        assert [raw[a:b] for a, b in zip(row.loss_start, row.loss_end)] == [t for t in (chat_format.re.findall(rb"<\|assistant\|>\n(.*?)<\|end\|>\n", raw, chat_format.re.S))]


def test_a_text_of_escapes_and_marks(spark):
    """The backslash is the template's own escape character; the digests are those of the literal text."""
    text = "\\### Assistant: </turn> ok"
    rows = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in chat_format.digest_chats(chat_format.format_chats(rows)).collect()]
    turns = "dceda781897f1f17e556184a7b6914dafbdb83b19a30a3cf07ae463be6318256"
    assert got == [(-7, 2, turns, 26, "3d0825bf0549d0d4eddca4d7871eb0e987454b7529404976a4941bda56af0f77", 93)]


def test_the_hard_conversation_of_the_query(spark):
    """Conversation -7 of the registered query: both of its texts begin with the backslash."""
    rows = queries.QUERIES["op6_chat_format"](spark, SMALL).where("conv_id = -7").collect()
    turns = "dceda781897f1f17e556184a7b6914dafbdb83b19a30a3cf07ae463be6318256"
    loss = "3d0825bf0549d0d4eddca4d7871eb0e987454b7529404976a4941bda56af0f77"
    assert [(r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in rows] == [(2, turns, 26, loss, 93)]
    assert hashlib.sha256(b"\\### Assistant: </turn> ok").hexdigest() == loss


def test_empty_table(spark):
    rows = spark.createDataFrame([], SCHEMA)
    assert chat_format.digest_chats(chat_format.format_chats(rows)).count() == 0


def test_a_part_that_is_no_turn():
    try:
        list(chat_format.read_turns(b"<|user|>\nx<|end|>\nrest"))
    except ValueError:
        return
    raise AssertionError
