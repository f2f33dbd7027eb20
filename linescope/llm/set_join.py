"""Sets of hashed n-grams that may be similar to another set.

The part that the exact similarity joins share.  A task turns its rows into
sets and takes a chunk of them at a time.  Of each chunk it keeps a directory
(names and sizes of the sets) and notes (where each set occurs), and deals the
n-grams to buckets by hash, each with its set's place in the directory.  A
bucket finds the n-grams that at least two sets hold.  All others cannot add to
any overlap, though they count in the set's size.  What is left returns to its
chunk: a set of n n-grams can only reach `percent` similarity if it shares
percent of n; the rest end here.  A set that several chunks hold is kept in one
of them, its home.

An n-gram is named by its bucket and 40 more bits of its hash, so the name
grows with the number of buckets; a set by 64 bits.  A bucket holds its share
of all n-grams in one task, about 6 bytes each before it is unpacked, and a
gathering task the shared ones of its chunks; both are numbered by
spark.sql.shuffle.partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescope.llm.storage import python_tasks, saved

CHUNK = 1_000_000  # n-grams dealt at once
NONE = -(1 << 63)  # stands for null in notes
WIDTH = 5  # bytes of an n-gram beside its bucket


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def set_name(grams: np.ndarray) -> int:
    return signed(xxhash.xxh3_64_intdigest(grams.tobytes()))


#: What one row gives: its sets (name, sorted distinct n-grams), and notes: three
#: numbers and the name of the set they belong to, or None.
Items = tuple[list[tuple[int, np.ndarray]], list[tuple[int, int, int, int | None]]]

_DEALT = pa.schema(
    [("bucket", pa.int32()), ("chunk", pa.int64())] + [(name, pa.binary()) for name in ("owners", "grams", "names", "sizes", "notes")]
)
_DEALT_DDL = "bucket int, chunk bigint, owners binary, grams binary, names binary, sizes binary, notes binary"


def _unpacked(data: bytes, bucket: int) -> np.ndarray:
    out = np.zeros((len(data) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return out.reshape(-1).view(np.int64) | (bucket << 8 * WIDTH)


def _steps(ascending: np.ndarray) -> bytes:
    """Ascending places as differences, which compress well."""
    return np.diff(ascending, prepend=0).astype(np.uint32).tobytes()


def _places(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint32), dtype=np.int64)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row[k] for row in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _flushed(held: dict[int, np.ndarray], notes: list, buckets: int, chunk: int) -> pa.RecordBatch:
    names = list(held)
    place = {name: k for k, name in enumerate(names)}
    sizes = np.array([len(s) for s in held.values()], np.int32)
    noted = np.array([(*note, -1 if name is None else place[name]) for *note, name in notes], np.int64)
    rows = [(chunk % buckets, chunk, None, None, np.array(names, np.int64).tobytes(), sizes.tobytes(), noted.tobytes())]
    if held:
        grams = np.concatenate(list(held.values()))
        owner = np.repeat(np.arange(len(names)), sizes)
        bucket = ((grams >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(edges)):
            mine = order[edges[k] : edges[k + 1]]
            packed = grams[mine].view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()
            rows.append((int(k), chunk, _steps(owner[mine]), packed, None, None, None))
    return _rows(rows, _DEALT)


def _deal(batches: Iterator[pa.RecordBatch], items_of: Callable[[pa.RecordBatch], Iterator[Items]], buckets: int) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    notes: list = []
    total, chunk = 0, TaskContext.get().partitionId() << 24
    for batch in batches:
        for sets, places in items_of(batch):
            notes += places
            for name, grams in sets:
                if name not in held:
                    held[name] = grams
                    total += len(grams)
            if total >= CHUNK or len(notes) >= CHUNK:
                yield _flushed(held, notes, buckets, chunk)
                held, notes, total, chunk = {}, [], 0, chunk + 1
    if notes:
        yield _flushed(held, notes, buckets, chunk)


_SHARED = pa.schema(
    [("chunk", pa.int64())] + [(name, pa.binary()) for name in ("owners", "grams", "freqs", "names", "sizes", "notes")]
)
_SHARED_DDL = "chunk bigint, owners binary, grams binary, freqs binary, names binary, sizes binary, notes binary"


def _shared_of(bucket: int, parts: list[tuple]) -> pa.RecordBatch:
    """N-grams of a bucket that two sets hold, by chunk."""
    grams = np.concatenate([_unpacked(p[2], bucket) for p in parts])
    order = np.argsort(grams)
    ranked = grams[order]
    edges = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    repeats = np.diff(np.append(edges, len(ranked))).astype(np.int32)
    del ranked
    freqs = np.empty(len(grams), np.int32)
    freqs[order] = np.repeat(repeats, repeats)
    del order
    rows, start = [], 0
    for chunk, owners, packed in parts:
        end = start + len(packed) // WIDTH
        kept = freqs[start:end] > 1
        if kept.any():
            rows.append((chunk, _steps(_places(owners)[kept]), grams[start:end][kept].tobytes(), freqs[start:end][kept].tobytes(), None, None, None))
        start = end
    return _rows(rows, _SHARED)


def _share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bucket, parts = None, []
    for batch in batches:
        for key, chunk, owners, grams, names, sizes, notes in zip(*(c.to_pylist() for c in batch.columns)):
            if names is not None:
                yield _rows([(chunk, None, None, None, names, sizes, notes)], _SHARED)
                continue
            if parts and key != bucket:
                yield _shared_of(bucket, parts)
                parts = []
            bucket = key
            parts.append((chunk, owners, grams))
    if parts:
        yield _shared_of(bucket, parts)


_NODES = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("grams", pa.list_(pa.int64())), ("freqs", pa.list_(pa.int32()))])


def _sets_of(parts: list[tuple], percent: int) -> Iterator[pa.RecordBatch]:
    """The sets of one chunk that are at home there and share enough."""
    names, sizes = next((np.frombuffer(p[3], np.int64), np.frombuffer(p[4], np.int32)) for p in parts if p[3] is not None)
    at_home = np.zeros(len(names), bool)
    for p in parts:
        if p[5] is not None:
            at_home[p[5]] = True
    held = [p for p in parts if p[0] is not None]
    if not held:
        return
    owner = np.concatenate([_places(p[0]) for p in held])
    grams = np.concatenate([np.frombuffer(p[1], np.int64) for p in held])
    freqs = np.concatenate([np.frombuffer(p[2], np.int32) for p in held])
    shared = np.bincount(owner, minlength=len(names))
    enough = at_home & (shared > 0) & (100 * shared >= percent * sizes.astype(np.int64))
    kept = enough[owner]
    owner, grams, freqs = owner[kept], grams[kept], freqs[kept]
    order = np.lexsort((grams, freqs, owner))
    offsets = pa.array(np.append(0, np.cumsum(shared[enough])).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in (grams, freqs)]
    yield pa.RecordBatch.from_arrays([pa.array(names[enough]), pa.array(sizes[enough]), *lists], schema=_NODES)


def _gather(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    chunk, parts = None, []
    for batch in batches:
        for key, *part in zip(*(c.to_pylist() for c in batch.columns)):
            if parts and key != chunk:
                yield from _sets_of(parts, percent)
                parts = []
            chunk = key
            parts.append(part)
    if parts:
        yield from _sets_of(parts, percent)


def _noted(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, names, sizes, notes in zip(*(c.to_pylist() for c in batch.columns)):
            rows = np.frombuffer(notes, np.int64).reshape(-1, 4)
            none = rows[:, 3] < 0
            names = np.append(np.frombuffer(names, np.int64), 0)[rows[:, 3]]
            sizes = np.append(np.frombuffer(sizes, np.int32), 0).astype(np.int64)[rows[:, 3]]
            values = [pa.array(rows[:, k], mask=rows[:, k] == NONE) for k in range(3)]
            values += [pa.array(names, mask=none), pa.array(sizes), pa.array(np.full(len(rows), chunk)), pa.array(rows[:, 3].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(values, [*columns, "node", "n", "chunk", "place_in_chunk"])


def candidate_sets(rows: DataFrame, items_of: Callable[[pa.RecordBatch], Iterator[Items]], percent: int, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Two tables from one reading of `rows`: sets that may reach `percent`
    with another (node, n, and their shared n-grams in the global order,
    frequency then hash, with the frequencies), and the notes: columns `names`
    with node and n of their set (null and 0 where there is none)."""
    spark = rows.sparkSession
    python_tasks(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.mapInArrow(lambda b: _deal(b, items_of, buckets), _DEALT_DDL)
    shared = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    shared = saved(shared.mapInArrow(_share, _SHARED_DDL))
    columns = ", ".join(f"{name} bigint" for name in names)
    notes = shared.filter("notes is not null").select("chunk", "names", "sizes", "notes")
    notes = saved(notes.mapInArrow(lambda b: _noted(b, names), f"{columns}, node bigint, n bigint, chunk bigint, place_in_chunk int"))
    homes = notes.filter("node is not null").groupBy("node").agg(F.min(F.struct("chunk", "place_in_chunk")).alias("home"))
    homes = homes.groupBy("home.chunk").agg(F.collect_list("home.place_in_chunk").alias("at_home"))  # one chunk's at most
    parts = shared.drop("notes").withColumn("at_home", F.lit(None).cast("array<int>"))
    none = [F.lit(None).cast("binary").alias(name) for name in ("owners", "grams", "freqs", "names", "sizes")]
    parts = parts.union(homes.select("chunk", *none, "at_home"))
    nodes = (
        parts.repartition(buckets, "chunk")
        .sortWithinPartitions("chunk")
        .mapInArrow(lambda b: _gather(b, percent), "node bigint, n int, grams array<bigint>, freqs array<int>")
    )
    return saved(nodes), notes.drop("chunk", "place_in_chunk")


def prefixes(nodes: DataFrame, percent: int) -> DataFrame:
    """(node, n, unshared, place, gram): the n-grams of which two similar sets share one.

    `place` counts from 0 in the set's whole order, n-grams that no other set
    holds first.
    """
    need = F.expr(f"cast(floor(({percent} * n + 99) / 100) as int)")
    first = F.expr("slice(grams, 1, size(grams) - need + 1)")
    return (
        nodes.withColumn("need", need)
        .select("node", "n", (F.col("n") - F.size("grams")).alias("unshared"), F.posexplode(first).alias("place", "gram"))
        .select("node", "n", "unshared", (F.col("unshared") + F.col("place")).alias("place"), "gram")
    )


def lengths_fit(percent: int) -> Column:
    """Neither set is too small for the other."""
    return F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")


def places_fit(percent: int) -> Column:
    """What stands behind a shared n-gram suffices in both sets.  It must at the
    first one that a similar pair shares, so it may be asked of every one."""
    return F.expr(f"(100 + {percent}) * least(n_a - place_a, n_b - place_b) >= {percent} * (n_a + n_b)")


def similar(overlap: str, percent: int) -> Column:
    return F.expr(f"100 * {overlap} >= {percent} * (n_a + n_b - {overlap})")
