r"""Chat formatting by columnar byte assembly.

A turn is written as ``### role: text </turn>`` and a line feed.  Inside texts a
backslash goes before every backslash and before the first character of the
template's own strings, so that a text can never be taken for a mark and every
text can be read back.

The rows of a batch are not joined one by one: lengths of all segments give the
place of every byte, and headers and contents are copied into one buffer that
becomes the Arrow column.
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

from chartfold.llm.textbatch import SLICE_BYTES, Texts, column

# the template
OPEN, NAMED, CLOSE = b"### ", b": ", b" </turn>\n"
ESCAPE = ord("\\")


def _escaped(texts: Texts, role: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes get a backslash before them, and each text's length with these."""
    b = texts.data
    mark = b == ESCAPE
    if role:
        mark |= (b == ord(":")) | (b == ord("\n"))
    left = np.repeat(texts.at[1:], texts.n_bytes) - np.arange(len(b))  # bytes from here to the text's end
    for string in (b"###", b"</turn>"):
        if len(b) < len(string):
            continue
        found = left >= len(string)
        for i, c in enumerate(string):
            found[: len(b) - i] &= b[i:] == c
            if i:
                found[len(b) - i :] = False
        mark |= found
    return mark, texts.n_bytes + texts.per_text(mark)


def _scatter(out: np.ndarray, to: np.ndarray, texts: Texts, mark: np.ndarray) -> None:
    """Copy each text, escaped, to its place in ``out``."""
    before = np.concatenate([[0], np.cumsum(mark)])  # escapes before each byte, over all texts
    shift = to - texts.at[:-1] - before[texts.at[:-1]]
    place = np.repeat(shift, texts.n_bytes) + np.arange(len(texts.data)) + before[1:]
    out[place] = texts.data
    out[place[mark] - 1] = ESCAPE


def _fill(out: np.ndarray, to: np.ndarray, string: bytes) -> None:
    out[to[:, None] + np.arange(len(string))] = np.frombuffer(string, np.uint8)


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray, loss_role: str) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Formatted conversations, the spans of ``loss_role`` in them, their numbers of turns.

    ``first`` holds the first row of every conversation, and the number of rows.
    Spans count code points of the formatted text.
    """
    r, t = Texts(roles), Texts(texts)
    r_mark, r_size = _escaped(r, role=True)
    t_mark, t_size = _escaped(t)
    row = np.concatenate([[0], np.cumsum(len(OPEN) + r_size + len(NAMED) + t_size + len(CLOSE))])
    if row[-1] >= 1 << 31:
        raise ValueError("a conversation takes 2 GiB or more, which no string column holds")
    out = np.empty(row[-1], np.uint8)
    name = row[:-1] + len(OPEN)
    body = name + r_size + len(NAMED)
    _fill(out, row[:-1], OPEN)
    _scatter(out, name, r, r_mark)
    _fill(out, name + r_size, NAMED)
    _scatter(out, body, t, t_mark)
    _fill(out, body + t_size, CLOSE)

    ends = row[first].astype(np.int32)
    formatted = pa.Array.from_buffers(pa.string(), len(first) - 1, [None, pa.py_buffer(ends), pa.py_buffer(out)])

    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    scored = np.flatnonzero(pc.fill_null(pc.equal(roles, loss_role), False).to_numpy(zero_copy_only=False))
    start = points[row[first[np.searchsorted(first, scored, "right") - 1]]]
    spans = pa.StructArray.from_arrays(
        [pa.array(points[body[scored]] - start), pa.array(points[body[scored] + t_size[scored]] - start)],
        ["start", "end"],
    )
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(scored, first).astype(np.int32)), spans)
    return formatted, spans, pa.array(np.diff(first))


def _changes(ids: pa.Array) -> np.ndarray:
    """Rows whose id differs from that of the row before."""
    a, b = ids[1:], ids[:-1]
    differ = pc.if_else(pc.or_(a.is_null(), b.is_null()), pc.xor(a.is_null(), b.is_null()), pc.not_equal(a, b))
    return np.flatnonzero(differ.to_numpy(zero_copy_only=False)) + 1


def format_chat(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: its id, ``formatted``, ``loss_spans``, ``n_turns``.

    ``loss_spans`` are the places of all texts of ``loss_role``, escapes
    included, in code points of ``formatted``.  Turns go by ``turn`` (null
    first), equal ones by role and text; repeated rows are repeated turns.  A
    null text or role is an empty one.  Rows without a conversation id make one
    conversation with a null id.  Other columns are not looked at.

    A conversation is one value of one row, so it is put together in one task;
    tasks stream over their conversations and hold one batch and the
    conversation that runs on.  One of 2 GiB or more is beyond a string column
    and fails.
    """
    kind = turns.schema[conversation].dataType.simpleString()

    def whole(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Conversations in slices of bounded size, one at least."""
        rows = rows.combine_chunks()
        ids, roles, texts = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.columns)
        first = np.concatenate([[0], _changes(ids), [len(ids)]])
        size = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy().astype(np.int64) for c in (roles, texts))
        upto = np.concatenate([[0], np.cumsum(size)])[first]
        at = 0
        while at < len(first) - 1:
            end = max(at + 1, int(np.searchsorted(upto, upto[at] + SLICE_BYTES, "right")) - 1)
            a, n = first[at], first[end] - first[at]
            formatted, spans, turns = assemble(roles.slice(a, n), texts.slice(a, n), first[at : end + 1] - a, loss_role)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(first[at:end])), formatted, spans, turns],
                                             ["id", "formatted", "loss_spans", "n_turns"])
            at = end

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.select(["id", "role", "text"])
            edges = _changes(column(batch, "id"))
            if held and _changes(pa.concat_arrays([column(held[-1], "id")[-1:], column(batch, "id")[:1]])).size:
                yield from whole(pa.Table.from_batches(held))
                held = []
            if len(edges):
                held.append(batch.slice(0, edges[-1]))
                yield from whole(pa.Table.from_batches(held))
                held = [batch.slice(edges[-1])]
            else:
                held.append(batch)
        if held:
            yield from whole(pa.Table.from_batches(held))

    rows = turns.select(
        F.col(conversation).alias("id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    dealt = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text")
    schema = f"id {kind}, formatted string, loss_spans array<struct<start: bigint, end: bigint>>, n_turns bigint"
    return dealt.mapInArrow(run, schema).withColumnRenamed("id", conversation)


_ROLE = re.compile(r"((?:[^\\:]|\\.)*): ", re.DOTALL)
_PAIR = re.compile(r"\\(.)", re.DOTALL)


def unescape(s: str) -> str:
    return _PAIR.sub(r"\1", s) if "\\" in s else s


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs that a formatted conversation was made of."""
    turns = []
    # inside texts the mark always has a backslash before its "<"
    for part in formatted.split(CLOSE.decode())[:-1]:
        head = _ROLE.match(part, len(OPEN))
        turns.append((unescape(head[1]), unescape(part[head.end():])))
    return turns


def read_back(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Digests of what :func:`format_chat` has put out, read from its output alone."""
    kind = formatted.schema[conversation].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(column(batch, "formatted").to_pylist(), column(batch, "loss_spans").to_pylist()):
                turns = parse(text)
                all_turns = "".join(f"{role}\n{said}\n" for role, said in turns)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((len(turns), hashlib.sha256(all_turns.encode()).hexdigest(), len(loss),
                             hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    schema = (f"id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
              "formatted_chars bigint")
    rows = formatted.select(F.col(conversation).alias("id"), "formatted", "loss_spans")
    return rows.mapInArrow(run, schema).withColumnRenamed("id", conversation)
