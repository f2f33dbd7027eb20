"""Chat formatting by columnar byte assembly.

A turn becomes opening, role, a line end, text, closing.  Inside roles and
texts every control string gets the escape character behind its first byte and
every escape character one in front, so no text can open or close a turn, and
taking the escapes out gives the text back.

A batch of turns is laid out at once: segment lengths and their cumulative sums
give every segment's place in one preallocated buffer; headers and contents are
copied to scatter indices, and the buffer is cut into Arrow strings.

Skew: turns are sorted by range of (conversation, turn), so a conversation with
a third of all rows spreads over many tasks.  A row of the output holds at most
`PART` bytes of one conversation (or one turn), numbered by `part`; nothing
gathers a conversation in memory.  Only a digest over a conversation has to see
its parts in order; it streams them.

Defined cases: a null text or role counts as empty; rows of a null conversation
form one conversation; a null turn comes first; equal turns are ordered by role
and text.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import dataclasses
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linescope.llm.storage import python_tasks

PART = 1 << 20


@dataclasses.dataclass(frozen=True)
class Template:
    """Marks of a turn, and the control strings to escape inside texts."""

    opening: bytes = b"<|im_start|>"
    role_end: bytes = b"\n"
    closing: bytes = b"<|im_end|>"
    controls: tuple[bytes, ...] = (
        b"<|im_start|>", b"<|im_end|>", b"<|endoftext|>", b"<s>", b"</s>", b"[INST]", b"[/INST]", b"<<SYS>>", b"<</SYS>>",
    )
    escape: bytes = b"\\"
    trained: str = "assistant"


def insertions(data: np.ndarray, offsets: np.ndarray, template: Template, line_ends: bool) -> np.ndarray:
    """Places in `data` in front of which the escape character goes."""
    found = [np.flatnonzero(data == template.escape[0])]
    if line_ends:
        found.append(np.flatnonzero(data == template.role_end[0]))
    limit = np.repeat(offsets[1:], np.diff(offsets))  # end of the text a byte is in
    for control in template.controls:
        places = np.flatnonzero(data[: max(0, len(data) - len(control) + 1)] == control[0])
        for k in range(1, len(control)):
            places = places[data[places + k] == control[k]]
        found.append(places[places + len(control) <= limit[places]] + 1)
    return np.unique(np.concatenate(found))


def escaped(column: pa.Array, template: Template, line_ends: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts with escapes, and the texts' offsets in them."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    base, end = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[base:end]
    offsets = offsets - base
    extra = insertions(data, offsets, template, line_ends)
    if not len(extra):
        return data, offsets
    shift = np.zeros(len(data) + 1, np.int64)
    shift[extra] = 1
    shift = np.cumsum(shift)  # escapes in front of or at a byte
    out = np.full(len(data) + len(extra), template.escape[0], np.uint8)
    out[np.arange(len(data)) + shift[:-1]] = data
    return out, offsets + np.append(0, shift[np.maximum(offsets[1:] - 1, 0)] * (offsets[1:] > 0))


def assembled(roles: pa.Array, texts: pa.Array, template: Template) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns, the turns' offsets in it, and where each
    turn's escaped text begins and ends."""
    count = len(texts)
    role_data, role_at = escaped(roles, template, line_ends=True)
    text_data, text_at = escaped(texts, template)
    role_size, text_size = np.diff(role_at), np.diff(text_at)
    sizes = np.empty((count, 5), np.int64)
    sizes[:, 0], sizes[:, 1], sizes[:, 2] = len(template.opening), role_size, len(template.role_end)
    sizes[:, 3], sizes[:, 4] = text_size, len(template.closing)
    places = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(places[-1], np.uint8)
    starts = places[:-1].reshape(count, 5)
    for k, mark in ((0, template.opening), (2, template.role_end), (4, template.closing)):
        out[starts[:, k, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    for k, data, at, size in ((1, role_data, role_at, role_size), (3, text_data, text_at, text_size)):
        out[np.arange(len(data)) + np.repeat(starts[:, k] - at[:-1], size)] = data
    return out, places[::5], starts[:, 3], starts[:, 3] + text_size


_PARTS = "conv_id bigint, part bigint, n_turns bigint, formatted string, loss_start array<bigint>, loss_end array<bigint>"
_PARTS_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("conv_id", "part", "n_turns")]
    + [("formatted", pa.string()), ("loss_start", pa.list_(pa.int64())), ("loss_end", pa.list_(pa.int64()))]
)


def _format(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    part, last = 0, object()
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_pylist()
        out, at, begin, end = assembled(batch.column(1), batch.column(2), template)
        trained = np.array([role == template.trained for role in batch.column(1).to_pylist()])
        rows = []
        first = 0
        for k in range(1, len(keys) + 1):
            if k < len(keys) and keys[k] == keys[first] and at[k + 1] - at[first] <= PART:
                continue
            part = part + 1 if keys[first] == last else 0
            last = keys[first]
            loss = np.flatnonzero(trained[first:k]) + first
            rows.append((last, part, k - first, begin[loss] - at[first], end[loss] - at[first]))
            first = k
        bounds = np.append(0, np.cumsum([row[2] for row in rows]))
        texts = pa.Array.from_buffers(pa.large_string(), len(rows), [None, pa.py_buffer(np.ascontiguousarray(at[bounds])), pa.py_buffer(out)])
        columns = [pa.array([row[k] for row in rows], pa.int64()) for k in range(3)] + [texts.cast(pa.string())]
        columns += [pa.array([row[k] for row in rows], pa.list_(pa.int64())) for k in (3, 4)]
        yield pa.RecordBatch.from_arrays(columns, schema=_PARTS_ARROW)


def format_chat(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Rows (conv_id, part, n_turns, formatted, loss_start, loss_end).

    A conversation's formatted text is its parts one behind the other, in the
    order of the partitions and of `part` within each.  The loss mask gives byte
    offsets within the part: the texts of the trained role.
    """
    python_tasks(turns.sparkSession)
    rows = turns.select("conv_id", "turn", "role", "text").repartitionByRange("conv_id", "turn")
    rows = rows.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(lambda batches: _format(batches, template), _PARTS)


def unescaped(data: bytes, template: Template) -> bytes:
    mark = re.escape(template.escape)
    return re.sub(mark + rb"(.)", rb"\1", data, flags=re.DOTALL) if template.escape in data else data


def parsed(formatted: bytes, template: Template) -> Iterator[tuple[bytes, bytes]]:
    """Role and text of each turn of a formatted part, escapes taken out."""
    role_end = re.compile(rb"((?:[^\\\n]|\\.)*)\n".replace(b"\n", re.escape(template.role_end)), re.DOTALL)
    for turn in formatted.split(template.opening)[1:]:
        turn = turn[: -len(template.closing)]
        head = role_end.match(turn)
        yield unescaped(head[1], template), unescaped(turn[head.end() :], template)


class Reader:
    """Digests of one conversation, fed part by part."""

    def __init__(self, template: Template):
        self.template, self.turns, self.loss = template, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def feed(self, formatted: str, starts: list[int], ends: list[int]) -> None:
        data = formatted.encode()
        self.formatted_chars += len(formatted)
        for role, text in parsed(data, self.template):
            self.n_turns += 1
            self.turns.update(role + b"\n" + text + b"\n")
        for start, end in zip(starts, ends):
            text = unescaped(data[start:end], self.template)
            self.loss_chars += len(text.decode())
            self.loss.update(text)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


_DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
_PIECE = ", place bigint, formatted string, loss_start array<bigint>, loss_end array<bigint>"
_DIGEST_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)
_PIECE_ARROW = pa.schema(
    [*_DIGEST_ARROW, pa.field("place", pa.int64()), pa.field("formatted", pa.string()), pa.field("loss_start", pa.list_(pa.int64())), pa.field("loss_end", pa.list_(pa.int64()))]
)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _read_inner(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    """Digest conversations that lie in this partition as one part; pass on the
    parts of all that may go on elsewhere: those with several parts here, and
    the partition's first and last."""
    none = (None,) * 5
    place, first, held = 0, True, None  # held: the newest conversation's only part
    open_key = object()  # a conversation whose parts are passed on
    for batch in batches:
        rows, size = [], 0
        for key, _, _, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns)):
            item = (place, text, starts, ends)
            place += 1
            if first:
                first, open_key = False, key
            if key == open_key:
                rows.append((key, *none, *item))
            elif held and held[0] == key:
                rows += [(key, *none, *held[1]), (key, *none, *item)]
                held, open_key = None, key
            else:
                if held:
                    reader = Reader(template)
                    reader.feed(*held[1][1:])
                    rows.append((held[0], *reader.row(), None, None, None, None))
                held = (key, item)
        if rows:
            yield _table(rows, _PIECE_ARROW)
    if held:
        yield _table([(held[0], *none, *held[1])], _PIECE_ARROW)


def _read_outer(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    key, reader = None, None
    for batch in batches:
        rows = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if reader and row[0] != key:
                rows.append((key, *reader.row()))
                reader = None
            if row[7] is None:
                rows.append(row[:6])
                continue
            if not reader:
                key, reader = row[0], Reader(template)
            reader.feed(*row[7:10])
        if rows:
            yield _table(rows, _DIGEST_ARROW)
    if reader:
        yield _table([(key, *reader.row())], _DIGEST_ARROW)


def read_chat(parts: DataFrame, template: Template = Template()) -> DataFrame:
    """Read formatted parts (as format_chat left them) back: per conversation
    the digests of its turns and of the text under the loss mask.

    Nearly every conversation ends in the task that formatted it.  Only those
    at the edges of a partition or with several parts move, and are digested
    part by part in constant memory.
    """
    inner = parts.mapInArrow(lambda batches: _read_inner(batches, template), _DIGEST + _PIECE)
    moved = inner.withColumn("task", F.spark_partition_id())
    moved = moved.repartition("conv_id").sortWithinPartitions("conv_id", "task", "place").drop("task")
    return moved.mapInArrow(lambda batches: _read_outer(batches, template), _DIGEST)
