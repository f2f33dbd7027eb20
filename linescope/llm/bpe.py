"""Byte-level BPE encoding and decoding without a regular expression.

Pre-tokenisation is a finite automaton run over whole blocks of text at once.
Each code point becomes one of eight symbols (letter, number, other, two kinds
of contraction apostrophe, three kinds of white space), each symbol a function
from states to states.  Composing functions is associative, so a two-level scan
of array look-ups gives the state before every code point, and a table says
where a token slice begins.  The slices are dictionary-encoded; each distinct
slice is merged once and kept in a bounded cache, which forgets the slices not
asked for longest.  Byte offsets of the tokens stay with the ids, so any range
of tokens can be decoded.

A row stays in its task: no shuffle.  Texts are worked on in blocks of about
half a MB; a longer text is cut in front of white space, where a slice always
ends.

Nulls: a null text counts as empty; an empty text has no ids.  An empty table
gives no rows.  Extra columns are ignored; repeated rows stay.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from linescope.llm.storage import python_tasks

BLOCK = 1 << 19
CACHED = 100_000  # slices in each of the two generations of a cache

# White space as the pattern's \s has it.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

# Symbols.  GAP: white space with white space or the end behind it; JOIN: a
# blank, LAST: other white space, with something else behind it.  QUOTE1 and
# QUOTE2: an apostrophe before a contraction of one or two letters.
LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, GAP, JOIN, LAST = range(8)
# States: what the code point before belongs to.  FREE: anything starts anew.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_GAP, AFTER_BLANK, ONE_LEFT, TWO_LEFT = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a slice begins at this symbol."""
    if symbol == LETTER:
        if state in (ONE_LEFT, TWO_LEFT):
            return (FREE, False) if state == ONE_LEFT else (ONE_LEFT, False)
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_BLANK)
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_BLANK)
    if symbol in (OTHER, QUOTE1, QUOTE2):
        inside = state in (IN_OTHERS, AFTER_BLANK)
        if symbol == OTHER or inside:
            return IN_OTHERS, not inside
        return (ONE_LEFT if symbol == QUOTE1 else TWO_LEFT), True
    if symbol == GAP:
        return IN_GAP, state != IN_GAP
    return (AFTER_BLANK if symbol == JOIN else FREE), True


@functools.cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The functions the symbols generate: id of each symbol's function (eight
    plain, then eight that begin a text), composition table, result of each
    function on each state, and where slices begin."""
    plain = [tuple(_step(state, symbol)[0] for state in range(8)) for symbol in range(8)]
    fresh = [(f[FREE],) * 8 for f in plain]
    known: dict[tuple, int] = {}
    todo = list(dict.fromkeys(plain + fresh))
    while todo:
        f = todo.pop()
        if f not in known:
            known[f] = len(known)
            todo += [tuple(g[s] for s in f) for g in plain + fresh]
    functions = list(known)
    compose = np.array([[known[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint16)
    begins = np.array([[_step(state, symbol)[1] for symbol in range(8)] for state in range(8)])
    ids = np.array([known[f] for f in plain + fresh], np.uint16)
    return ids, compose.ravel(), np.array(functions, np.uint8), begins


def scanned(ids: np.ndarray, width: int = 512) -> np.ndarray:
    """Composition of all functions up to and including each place."""
    _, compose, functions, _ = automaton()
    size = len(functions)
    if len(ids) <= width:
        out = ids.copy()
        for k in range(1, len(out)):
            out[k] = compose[int(out[k - 1]) * size + int(out[k])]
        return out
    rows = -(-len(ids) // width)
    grid = np.full(rows * width, ids[-1], np.uint16)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)  # one row of the text per column
    for k in range(1, width):
        grid[k] = compose[grid[k - 1].astype(np.int32) * size + grid[k]]
    before = scanned(grid[-1])[:-1].astype(np.int32) * size
    grid[:, 1:] = compose[before[None, :] + grid[:, 1:]]
    return grid.T.reshape(-1)[: len(ids)]


@functools.cache
def code_point_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER, JOIN (a blank) or LAST (other white space) of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind in "LN":
            table[code] = LETTER if kind == "L" else NUMBER
    table[list(WHITE_SPACE)] = LAST
    table[0x20] = JOIN
    return table


def slice_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places in `points` (code points of several texts) where a slice begins.
    `first`: where the texts begin."""
    symbols = code_point_classes()[points]
    fresh = np.zeros(len(points) + 1, bool)
    fresh[first] = True
    fresh[-1] = True
    ends = fresh[1:]  # the next place belongs to another text, or to none
    white = symbols >= JOIN
    following = np.append(white[1:], True) | ends
    symbols[white & following] = GAP
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        padded = np.append(points, [0, 0])
        one, two = padded[quotes + 1], padded[quotes + 2]
        open1 = ~ends[quotes]
        open2 = open1 & ~ends[np.minimum(quotes + 1, len(points) - 1)]
        symbols[quotes[open1 & np.isin(one, [ord(c) for c in "stmd"])]] = QUOTE1
        pairs = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        symbols[quotes[open2 & pairs]] = QUOTE2
    ids, _, functions, begins = automaton()
    after = functions[scanned(ids[symbols + 8 * fresh[:-1]]), FREE]
    state = np.append(np.uint8(FREE), after[:-1])
    state[fresh[:-1]] = FREE
    return np.flatnonzero(begins[state, symbols] | fresh[:-1])


class Vocabulary:
    """Ranks of a byte-level BPE, with a bounded cache of merged slices."""

    def __init__(self, source: bytes):
        pairs = [line.split() for line in source.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.large_binary())
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.decimals = pa.array([b"%d " % k for k in range(size)], pa.large_binary())
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.older: dict[bytes, tuple[int, ...]] = {}

    def ids_of(self, piece: bytes) -> tuple[int, ...]:
        found = self.cache.get(piece)
        if found is None:
            found = self.older.get(piece)
            if found is None:
                rank = self.ranks.get(piece)
                found = (rank,) if rank is not None else self.merged(piece)
            if len(piece) <= 256:
                if len(self.cache) >= CACHED:
                    self.older, self.cache = self.cache, {}
                self.cache[piece] = found
        return found

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Merge the pair of lowest rank, the leftmost first, until none is left."""
        return self.merged_short(piece) if len(piece) <= 100 else self.merged_long(piece)

    def merged_short(self, piece: bytes) -> tuple[int, ...]:
        ranks, none = self.ranks.get, 1 << 60
        edges = list(range(len(piece) + 1))
        pairs = [ranks(piece[k : k + 2], none) for k in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) < none:
            k = pairs.index(least)
            del edges[k + 1], pairs[k]
            if k:
                pairs[k - 1] = ranks(piece[edges[k - 1] : edges[k + 1]], none)
            if k < len(pairs):
                pairs[k] = ranks(piece[edges[k] : edges[k + 2]], none)
        return tuple([self.ranks[piece[a:b]] for a, b in zip(edges, edges[1:])])

    def merged_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap, for slices of any length."""
        ranks, size = self.ranks, len(piece)
        after = list(range(1, size + 1))  # end of the part that begins here
        before = list(range(-1, size))  # begin of the part in front; at a part's begin only
        alive = bytearray(b"\1") * size
        heap = []
        for k in range(size - 1):
            rank = ranks.get(piece[k : k + 2])
            if rank is not None:
                heap.append((rank, k, k + 2))
        heapq.heapify(heap)
        while heap:
            _, start, end = heapq.heappop(heap)
            middle = after[start]
            if not alive[start] or middle >= size or after[middle] != end:
                continue
            alive[middle] = 0
            after[start] = end
            if end < size:
                before[end] = start
                rank = ranks.get(piece[start : after[end]])
                if rank is not None:
                    heapq.heappush(heap, (rank, start, after[end]))
            left = before[start]
            if left >= 0:
                rank = ranks.get(piece[left:end])
                if rank is not None:
                    heapq.heappush(heap, (rank, left, end))
        out, start = [], 0
        while start < size:
            out.append(ranks[piece[start : after[start]]])
            start = after[start]
        return tuple(out)

    def encoded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin and end."""
        data = b"".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        bounds = np.zeros(len(texts) + 1, np.int64)
        if not data:
            return np.zeros(0, np.int32), bounds
        points = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        widths = 1 + (points >= 0x80).view(np.int8) + (points >= 0x800) + (points >= 0x10000)
        offsets = np.zeros(len(points) + 1, np.int64)
        np.cumsum(widths, out=offsets[1:])
        begins = np.concatenate([[0], np.cumsum(sizes)])
        first = np.searchsorted(offsets, begins[:-1][sizes > 0])
        starts = offsets[slice_starts(points, first)]
        edges = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        found = [self.ids_of(piece) for piece in coded.dictionary.to_pylist()]
        flat = np.fromiter((i for ids in found for i in ids), np.int32)
        counts = np.array([len(ids) for ids in found], np.int64)
        places = np.cumsum(counts) - counts
        index = coded.indices.to_numpy()
        each = counts[index]
        total = np.cumsum(each)
        ids = flat[np.arange(total[-1]) - np.repeat(total - each - places[index], each)]
        bounds[:] = np.append(0, total)[np.searchsorted(starts, begins)]
        return ids, bounds

    def decoded(self, ids: np.ndarray) -> memoryview:
        """Bytes of the ids."""
        taken = pc.take(self.tokens, pa.array(ids))
        return memoryview(taken.buffers()[2] or b"")[: int(self.lengths[ids].sum())]

    def numbers(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """Decimal ids, each with a blank behind it, and their byte offsets."""
        taken = pc.take(self.decimals, pa.array(ids))
        offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(ids) + 1]
        return memoryview(taken.buffers()[2] or b""), offsets


_LOADED: dict[bytes, Vocabulary] = {}


def vocabulary(source: bytes) -> Vocabulary:
    """The vocabulary of a rank file's content; one per Python worker."""
    key = hashlib.sha256(source).digest()
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(source)
    return _LOADED[key]


def portions(texts: list[str | None], size: int = BLOCK) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts, or parts of long ones, in blocks of about `size` bytes, with
    their row numbers.  A part ends in front of white space behind another
    character, where a slice ends anyhow."""
    rows: list[int] = []
    parts: list[bytes] = []
    held = 0
    for row, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        start = 0
        while start < len(data):
            end = len(data)
            if end - start > size:
                end = start + size
                while end < len(data) and not (data[end] in b" \n" and data[end - 1] > 0x20 and data[end - 1] < 0x80):
                    end += 1
            if held and held + end - start > size:
                yield rows, parts
                rows, parts, held = [], [], 0
            rows.append(row)
            parts.append(data[start:end])
            held += end - start
            start = end
    if rows:
        yield rows, parts


def _encode(batches: Iterator[pa.RecordBatch], source) -> Iterator[pa.RecordBatch]:
    words = vocabulary(source.value)
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1).to_pylist()
        ids: list[list[np.ndarray]] = [[] for _ in texts]
        for rows, parts in portions(texts):
            found, bounds = words.encoded(parts)
            for k, row in enumerate(rows):
                ids[row].append(found[bounds[k] : bounds[k + 1]])
        whole = [np.concatenate(x) if x else np.zeros(0, np.int32) for x in ids]
        ends = [np.cumsum(words.lengths[x]) for x in whole]
        yield pa.RecordBatch.from_arrays(
            [keys, pa.array(whole, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int64()))], ["doc_id", "ids", "ends"]
        )


def _decode(batches: Iterator[pa.RecordBatch], source) -> Iterator[pa.RecordBatch]:
    words = vocabulary(source.value)
    for batch in batches:
        ids = batch.column(1)
        texts = [bytes(words.decoded(np.asarray(x.values, np.int32))) if x.is_valid else b"" for x in ids]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "decoded"])


def _digests(batches: Iterator[pa.RecordBatch], source, with_ids: bool) -> Iterator[pa.RecordBatch]:
    words = vocabulary(source.value)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        counts = [0] * len(texts)
        kept: list[list[np.ndarray]] = [[] for _ in texts]
        sums = [(hashlib.sha256(), hashlib.sha256()) for _ in texts]
        for rows, parts in portions(texts):
            ids, bounds = words.encoded(parts)
            numbers, places = words.numbers(ids)
            data = words.decoded(ids)
            edges = np.append(0, np.cumsum(words.lengths[ids]))
            for k, row in enumerate(rows):
                a, b = int(bounds[k]), int(bounds[k + 1])
                if counts[row] and b > a:
                    sums[row][0].update(b" ")
                sums[row][0].update(numbers[int(places[a]) : max(int(places[a]), int(places[b]) - 1)])
                sums[row][1].update(data[int(edges[a]) : int(edges[b])])
                counts[row] += b - a
                if with_ids:
                    kept[row].append(ids[a:b])
        columns = [batch.column(0), pa.array(counts, pa.int64())]
        names = ["doc_id", "n_tokens"]
        if with_ids:
            columns.append(pa.array([np.concatenate(x) if x else np.zeros(0, np.int32) for x in kept], pa.list_(pa.int32())))
            names.append("ids")
        columns += [pa.array([s[k].hexdigest() for s in sums]) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(columns, [*names, "ids_sha256", "decoded_sha256"])
        del columns, kept
        pa.default_memory_pool().release_unused()


def _mapped(rows: DataFrame, function, path: str, schema: str, *more) -> DataFrame:
    spark = rows.sparkSession
    python_tasks(spark, "2m")
    with open(path, "rb") as file:  # a vocabulary of fixed size, on the driver
        source = spark.sparkContext.broadcast(file.read())
    return rows.mapInArrow(lambda batches: function(batches, source, *more), schema)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, ids, and `ends`: the byte offset in the text where each token ends."""
    return _mapped(docs.select("doc_id", text), _encode, path, "doc_id bigint, ids array<int>, ends array<bigint>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and the bytes of its `ids`; null ids give no bytes."""
    return _mapped(tokens.select("doc_id", "ids"), _decode, path, "doc_id bigint, decoded binary")


def round_trip(docs: DataFrame, path: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, (ids,) ids_sha256 and
    decoded_sha256.  Ids and bytes of long texts are digested block by block."""
    ids = "ids array<int>, " if with_ids else ""
    schema = f"doc_id bigint, n_tokens bigint, {ids}ids_sha256 string, decoded_sha256 string"
    return _mapped(docs.select("doc_id", text), _digests, path, schema, with_ids)
