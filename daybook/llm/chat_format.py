"""Conversations rendered as training text by columnar byte assembly.

Turn markup (``SEGMENTS``)::

    system     <<SYS>>\\n text \\n<</SYS>>\\n
    user       <s>[INST]\\n text \\n[/INST]\\n
    assistant  <s>\\n text \\n</s>\\n
    other      [ROLE]\\n role \\n[/ROLE]\\n text \\n</s>\\n

A control string inside a text or role gets a backslash after its first character and
every backslash is doubled, so no control string of the output comes from a text and the
texts can be read back exactly.

Turns are assembled in slices of some megabytes, without a Python loop over turns: lengths
of all segments, cumulative offsets, and a scatter of header, content and footer bytes into
one preallocated buffer that becomes the Arrow column. Scatter indices are made for a few
megabytes at a time; a long text is copied as it is.

Scale: one shuffle on the conversation, sorted within partitions and streamed. A
conversation comes out in parts (at turn boundaries, in order), so one that holds a third
of all turns never has to fit into one buffer; only its running digest is sequential. A single
turn is never divided: it needs some six times its own length while it is escaped and copied.

Defined results: turns are ordered by turn (null first), then role and text; a null text
or role is empty; a null conv_id is a conversation of its own; repeated rows are turns
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The control strings and, by role, what stands about a turn's text.
CONTROLS = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "<s>", "</s>")
SEGMENTS = {
    "system": ("<<SYS>>\n", "\n<</SYS>>\n"),
    "user": ("<s>[INST]\n", "\n[/INST]\n"),
    "assistant": ("<s>\n", "\n</s>\n"),
}
OTHER = ("[ROLE]\n", "\n[/ROLE]\n", "\n</s>\n")
_CONTROL = "|".join(re.escape(c[0]) + "(?:" + re.escape(c[1:]) + ")" for c in CONTROLS)
_PARTS = "conv_id {0}, part int, n_turns int, formatted string, loss_starts array<long>, loss_lengths array<long>"


def escape(texts: pa.Array) -> pa.Array:
    """Double backslashes; break each control string after its first character."""
    texts = pc.replace_substring(texts, "\\", "\\\\")
    rest = "|".join(re.escape(c[1:]) for c in CONTROLS if c[0] == "<")
    texts = pc.replace_substring_regex(texts, f"<({rest})", r"<\\\1")
    rest = "|".join(re.escape(c[1:]) for c in CONTROLS if c[0] == "[")
    return pc.replace_substring_regex(texts, rf"\[({rest})", r"[\\\1")


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n + 1 offsets of a string array."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


SLICE = 1 << 22  # bytes of text that a buffer takes at a time, if no turn alone has more
LONG = 1 << 16  # from here on a segment is copied by itself


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray, pick: np.ndarray | None = None) -> None:
    """Copy segment i (or pick[i]) of ``data`` to out[at[i]:]."""
    begins, lengths = offsets[:-1], np.diff(offsets)
    if pick is not None:
        begins, lengths = begins[pick], lengths[pick]
    for i in np.flatnonzero(lengths >= LONG).tolist():
        out[at[i] : at[i] + lengths[i]] = data[begins[i] : begins[i] + lengths[i]]
    short = np.flatnonzero((lengths > 0) & (lengths < LONG))
    upto = np.cumsum(lengths[short])
    for own in np.split(short, np.searchsorted(upto, np.arange(SLICE, int(upto[-1]) if len(upto) else 0, SLICE))):
        n = lengths[own]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(at[own], n) + within] = data[np.repeat(begins[own], n) + within]


def _points(buffer: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Code points before each of the places: all bytes but continuation bytes count."""
    out, before = np.zeros(len(places), np.int64), 0
    order = np.argsort(places, kind="stable")
    ranked = places[order]
    for a in range(0, len(buffer) + 1, SLICE):
        part = buffer[a : a + SLICE]
        counts = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80, dtype=np.int32)])
        lo, hi = np.searchsorted(ranked, [a, a + SLICE])
        out[order[lo:hi]] = before + counts[ranked[lo:hi] - a]
        before += int(counts[-1])
    return out


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Stretches of turns with some SLICE bytes of text."""
    upto = np.cumsum(np.asarray(pc.binary_length(batch.column(2)), np.int64))
    at = 0
    while at < len(batch):
        end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE, "right"))
        end = max(at + 1, end)
        yield batch.slice(at, end - at)
        at = end


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buffer, turn offsets, and byte begin and end of each turn's content in the buffer."""
    names = list(SEGMENTS)
    kind = np.asarray(pc.fill_null(pc.index_in(roles, pa.array(names)), len(names)))
    other = kind == len(names)
    heads = pa.array([*(SEGMENTS[r][0] for r in names), OTHER[0]])
    feet = pa.array([*(SEGMENTS[r][1] for r in names), OTHER[2]])
    head, head_at = _bytes_of(heads)
    foot, foot_at = _bytes_of(feet)
    body, body_at = _bytes_of(escape(texts))
    role, role_at = _bytes_of(escape(pc.if_else(pa.array(other), roles, "")))
    between, between_at = _bytes_of(pa.array(["", OTHER[1]]))
    lengths = [np.diff(head_at)[kind], np.diff(role_at), np.diff(between_at)[other.astype(int)], np.diff(body_at), np.diff(foot_at)[kind]]
    ends = np.cumsum(np.stack(lengths, 1).ravel()).reshape(-1, 5)
    begins = ends - np.stack(lengths, 1)
    out = np.empty(int(ends[-1, -1]) if len(ends) else 0, np.uint8)
    _scatter(out, begins[:, 0], head, head_at, kind)
    _scatter(out, begins[:, 1], role, role_at)
    _scatter(out, begins[:, 2], between, between_at, other.astype(int))
    _scatter(out, begins[:, 3], body, body_at)
    _scatter(out, begins[:, 4], foot, foot_at, kind)
    return out, np.concatenate([[0], ends[:, -1]]), begins[:, 3], ends[:, 3]


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Formatted text in parts: conv_id, part, n_turns, formatted, loss_starts, loss_lengths.

    Loss spans are in code points of the part's text and cover assistant contents.
    Parts of a conversation follow each other in its partition.
    """
    rows = turns.select(F.col(conv).alias("c"), F.col(turn).alias("n"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.repartition("c").sortWithinPartitions("c", F.col("n").asc_nulls_first(), "r", "t").select("c", "r", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = object(), 0
        for batch in (part for whole in batches for part in _slices(whole)):
            buffer, turn_at, body_from, body_to = assemble(batch.column(1), batch.column(2))
            convs = batch.column(0)
            ids = convs.to_pylist()
            first = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1])]
            edges = np.asarray([*first, len(ids)])
            spoken = np.asarray(pc.equal(batch.column(1), "assistant"))
            picked = np.flatnonzero(spoken)
            begin = turn_at[edges[np.searchsorted(edges, picked, "right") - 1]]
            began, came, went = np.split(_points(buffer, np.concatenate([begin, body_from[picked], body_to[picked]])), 3)
            starts, lengths = came - began, went - came
            spans_at = pa.array(np.searchsorted(picked, edges), pa.int32())
            part = np.zeros(len(first), np.int32)
            part[0] = parts if ids[0] == last else 0
            last, parts = ids[-1], int(part[-1]) + 1
            formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(turn_at[edges].astype(np.int64)), pa.py_buffer(buffer))
            yield pa.RecordBatch.from_arrays(
                [
                    convs.take(pa.array(first)),
                    pa.array(part),
                    pa.array(np.diff(edges), pa.int32()),
                    formatted.cast(pa.string()),
                    pa.ListArray.from_arrays(spans_at, pa.array(starts, pa.int64())),
                    pa.ListArray.from_arrays(spans_at, pa.array(lengths, pa.int64())),
                ],
                ["conv_id", "part", "n_turns", "formatted", "loss_starts", "loss_lengths"],
            )

    return rows.mapInArrow(run, _PARTS.format(dict(turns.dtypes)[conv]))


_TURN = re.compile(
    "|".join(f"(?:{re.escape(a)}(?P<{r}>.*?){re.escape(b)})" for r, (a, b) in SEGMENTS.items() if r != "assistant")
    + f"|(?:{re.escape(SEGMENTS['assistant'][0])}(?P<assistant>.*?){re.escape(SEGMENTS['assistant'][1])})"
    + f"|(?:{re.escape(OTHER[0])}(?P<role>.*?){re.escape(OTHER[1])}(?P<other>.*?){re.escape(OTHER[2])})",
    re.DOTALL,
)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted part."""
    at = 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text outside of turns")
        at = m.end()
        if m["role"] is not None:
            yield unescape(m["role"]), unescape(m["other"])
        else:
            kind = next(r for r in SEGMENTS if m[r] is not None)
            yield kind, unescape(m[kind])
    if at != len(formatted):
        raise ValueError("text outside of turns")


def digests(parts: DataFrame) -> DataFrame:
    """Per conversation, read back from its parts alone: turns, loss mask, lengths, digests."""
    kind = dict(parts.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        open_: list | None = None

        def closed(rows):
            cols = list(zip(*[(c, n, a.hexdigest(), lc, b.hexdigest(), fc) for c, n, a, lc, b, fc in rows]))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], schema_kind), *(pa.array(x) for x in cols[1:])], names)

        schema_kind = None
        for batch in batches:
            schema_kind = batch.column(0).type
            done = []
            for c, part, n, text, starts, lengths in zip(*(col.to_pylist() for col in batch.columns)):
                if part == 0:
                    if open_ is not None:
                        done.append(open_)
                    open_ = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    open_[1] += 1
                    open_[2].update(f"{role}\n{said}\n".encode())
                for a, k in zip(starts, lengths):
                    said = unescape(text[a : a + k])
                    open_[3] += len(said)
                    open_[4].update(said.encode())
                open_[5] += len(text)
            if done:
                yield closed(done)
        if open_ is not None:
            yield closed([open_])

    return parts.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _escaped(column: str) -> str:
    """SQL for the escaped text."""
    out = f"replace({column}, chr(92), chr(92) || chr(92))"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return out


def _oracle() -> str:
    about = " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in SEGMENTS.items())
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length({_escaped("text")}) + CASE role {about} ELSE {sum(map(len, OTHER))} + length({_escaped("role")}) END)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


ORACLE = _oracle()
