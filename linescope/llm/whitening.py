"""Embedding whitening from a bit-sliced scatter matrix.

A vector's entries become integers, x = floor(256 * c).  The fit list holds each
distinct integer vector once.  A task shifts every dimension by its minimum,
slices the shifted integers into bit planes and packs each plane across the
rows of a block into 64-bit words.  The AND of two planes, counted, says how
many rows have both bits; weighted by two to the sum of their places, these
counts add up to the exact cross-product of two dimensions.  Spark sums them as
integers.  n * sum(x x') - S S' is then the centred scatter, n squared times the
covariance, in integers of any length; a shift changes neither.  Only that goes
into eigh.

Double precision resolves components down to 1e-16 of the largest one.  So each
of the leading pairs is polished against the exact matrix in decimal arithmetic,
with the factors of eigh as the approximate inverse, and taken out of the matrix
before eigh looks for the next.

What reaches the driver depends on the number of dimensions d alone (d * d sums
of some digits each).  Vectors are dealt once, to find the distinct ones; a
common vector is one row a task.

Defined cases: a row whose vector is null, empty or holds null or non-finite
entries is dropped, and so is one whose vector has another length than most
(at a tie, the longer ones stay); entries beyond 64 bits stop at the largest
integer; a null id stays; repeated rows each come out.  A component without
variance has whitened null, and explained null where there is no variance at
all; identity_error covers the other components, and is null without any.
deviation is null where it passes 64 bits; deviation_exact always has it, as text.
An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import dataclasses
import decimal
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescope.llm.storage import python_tasks, saved

SCALE = 256.0
COMPONENTS = 4
BLOCK = 1 << 14  # rows whose planes are held at once
LIMB = 8  # weights 2 ** 0 .. 2 ** 7 share a sum, so sums of 2 ** 40 rows fit 64 bits
DIGITS = 100
SETTLED = Decimal("1e-60")  # residual of a polished pair, as a share of its value
NOTHING = Decimal("1e-45")  # share of the first value below which there is no variance


# ---- integers --------------------------------------------------------------------------


def integer_rows(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows with a sound vector of the usual length."""
    entries = F.col("entries")
    sound = entries.isNotNull() & (F.size(entries) > 0) & F.forall(entries, _sound)
    found = rows.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("entries")).filter(F.coalesce(sound, F.lit(False)))
    found = saved(found.select("vec_id", F.transform("entries", lambda c: F.floor(c * F.lit(SCALE)).cast("bigint")).alias("x")))
    lengths = found.groupBy(F.size("x").alias("length")).agg(F.count("*").alias("n"))
    usual = lengths.orderBy(F.desc("n"), F.desc("length")).first()
    return found.filter(F.size("x") == (usual.length if usual else 0))


def _sound(c: Column) -> Column:
    return c.isNotNull() & (F.abs(c) < F.lit(float("inf")))  # NaN is above infinity


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


# ---- scatter ---------------------------------------------------------------------------


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least and largest value of every dimension, and the rows of this task."""
    low = high = None
    count = 0
    for batch in batches:
        x = _matrix(batch.column(0))
        if len(x):
            low = x.min(0) if low is None else np.minimum(low, x.min(0))
            high = x.max(0) if high is None else np.maximum(high, x.max(0))
            count += len(x)
    if count:
        columns = [pa.array(np.arange(len(low))), pa.array(low), pa.array(high), pa.array(np.full(len(low), count))]
        yield pa.RecordBatch.from_arrays(columns, ["dim", "low", "high", "n"])


def planes(shifted: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of unsigned rows, packed across rows into words: the words of
    each plane, its dimension and its place."""
    words, dims, places = [], [], []
    padded = -len(shifted) % 64
    for place in range(int(widths.max(initial=0))):
        has = np.flatnonzero(widths > place)
        bits = (shifted[:, has] >> np.uint64(place)).astype(np.uint8) & 1
        packed = np.packbits(np.pad(bits, ((0, padded), (0, 0))).T, axis=1)
        words.append(np.ascontiguousarray(packed).view(np.uint64))
        dims.append(has)
        places.append(np.full(len(has), place))
    if not words:
        return np.zeros((0, 1), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(words), np.concatenate(dims), np.concatenate(places)


def add_products(products: np.ndarray, sums: np.ndarray, words: np.ndarray, dims: np.ndarray, places: np.ndarray) -> None:
    """Add a block's weighted counts: products[limb, a, b], of which (a, b) and
    (b, a) together are the cross-product, and sums[limb, a]."""
    for k in range(len(words)):
        both = np.bitwise_count(words[k] & words[k:]).sum(1, dtype=np.int64)
        weight = places[k] + places[k:]
        again = (dims[k:] == dims[k]) & (np.arange(len(both)) > 0)  # two places of one dimension meet twice
        value = (both << (weight % LIMB)) << again
        np.add.at(products, (weight // LIMB, dims[k], dims[k:]), value)
        sums[places[k] // LIMB, dims[k]] += both[0] << (places[k] % LIMB)


def _scatter(batches: Iterator[pa.RecordBatch], low: np.ndarray, widths: np.ndarray) -> Iterator[pa.RecordBatch]:
    d, limbs = len(low), 2 * int(widths.max(initial=0)) // LIMB + 1
    products, sums = np.zeros((limbs, d, d), np.int64), np.zeros((limbs, d), np.int64)
    for batch in batches:
        x = _matrix(batch.column(0))
        for start in range(0, len(x), BLOCK):
            shifted = x[start : start + BLOCK].view(np.uint64) - low.view(np.uint64)  # wraps to the unsigned distance
            add_products(products, sums, *planes(shifted, widths))
    limb, a, b = np.nonzero(products)
    at, dim = np.nonzero(sums)
    columns = [np.append(limb, at), np.append(a, dim), np.append(b, np.full(len(at), -1)), np.append(products[limb, a, b], sums[at, dim])]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["limb", "a", "b", "value"])


@dataclasses.dataclass(frozen=True)
class Scatter:
    """Exact figures of the fit list.  `low` and `high` bound its entries; `sums`
    are of the entries; `centred` is n squared times their covariance."""

    n: int
    low: list[int]
    high: list[int]
    sums: list[int]
    centred: list[list[int]]


def scatter(fit: DataFrame) -> Scatter | None:
    """Of the integer vectors `x`; None without any."""
    python_tasks(fit.sparkSession)
    ranges = fit.select("x").mapInArrow(_ranges, "dim bigint, low bigint, high bigint, n bigint")
    ranges = ranges.groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("dim").collect()
    if not ranges:
        return None
    n, d = ranges[0].n, len(ranges)
    low, high = [row.low for row in ranges], [row.high for row in ranges]
    least, widths = np.array(low, np.int64), np.array([(b - a).bit_length() for a, b in zip(low, high)])
    found = fit.select("x").mapInArrow(lambda batches: _scatter(batches, least, widths), "limb bigint, a bigint, b bigint, value bigint")
    products, sums = [[0] * d for _ in range(d)], [0] * d
    for limb, a, b, value in found.groupBy("limb", "a", "b").agg(F.sum("value")).collect():  # d * d sums a limb
        weighted = value << (LIMB * limb)
        if b < 0:
            sums[a] += weighted
        else:
            products[a][b] += weighted
            if a != b:
                products[b][a] += weighted
    centred = [[n * products[a][b] - sums[a] * sums[b] for b in range(d)] for a in range(d)]
    return Scatter(n, low, high, [s + n * least for s, least in zip(sums, low)], centred)


# ---- components ------------------------------------------------------------------------


def _polished(matrix: np.ndarray) -> tuple[Decimal, np.ndarray]:
    """The largest eigenvalue of a matrix of decimals and its unit vector."""
    values, basis = np.linalg.eigh(matrix.astype(float))
    vector = np.array([Decimal(v) for v in basis[:, -1]], object)
    value = Decimal(0)
    for _ in range(40):
        vector = vector / (vector @ vector).sqrt()
        image = matrix @ vector
        value = vector @ image
        rest = image - value * vector
        size = max(abs(r) for r in rest)
        if size <= SETTLED * abs(value):
            break
        gaps = float(value) - values
        apart = np.abs(gaps) > 1e-14 * abs(values[-1])
        apart[-1] = False
        share = basis.T @ (rest / size).astype(float)
        step = basis[:, apart] @ (share[apart] / gaps[apart])
        vector = vector + size * np.array([Decimal(v) for v in step], object)
    return value, vector / (vector @ vector).sqrt()


def components(stats: Scatter, count: int = COMPONENTS) -> list[tuple[Decimal, np.ndarray | None]]:
    """The leading eigenvalues of the covariance, falling, with unit vectors whose
    largest entry is positive; (0, None) for those without variance."""
    found = []
    with decimal.localcontext(decimal.Context(prec=DIGITS)):
        matrix = np.array([[Decimal(v) for v in row] for row in stats.centred], object) / Decimal(stats.n * stats.n)
        for _ in range(min(count, len(matrix))):
            value, vector = _polished(matrix)
            if value <= NOTHING * (found[0][0] if found else 0):
                break
            along = matrix @ vector
            matrix = matrix - np.outer(vector, along) - np.outer(along, vector) + (vector @ along) * np.outer(vector, vector)
            found.append((value, vector if vector[np.argmax(np.abs(vector))] > 0 else -vector))
        found.sort(key=lambda pair: -pair[0])
    return found + [(Decimal(0), None)] * (min(count, len(stats.low)) - len(found))


@dataclasses.dataclass(frozen=True)
class Whitener:
    """Directions over n * sqrt(e), in two parts of double precision."""

    n: int
    low: np.ndarray
    sums: list[int]  # of the entries less `low`
    span: int  # bound of the centred entries
    main: np.ndarray
    rest: np.ndarray

    @staticmethod
    def of(stats: Scatter, found: list[tuple[Decimal, np.ndarray | None]]) -> Whitener:
        main, rest = [], []
        with decimal.localcontext(decimal.Context(prec=DIGITS)):
            for value, vector in found:
                scaled = [Decimal(0)] * len(stats.low) if vector is None else list(vector / (stats.n * value.sqrt()))
                main.append([float(v) for v in scaled])
                rest.append([float(v - Decimal(float(v))) for v in scaled])
        span = stats.n * max(b - a for a, b in zip(stats.low, stats.high))
        sums = [s - stats.n * a for s, a in zip(stats.sums, stats.low)]
        return Whitener(stats.n, np.array(stats.low, np.int64), sums, span, np.array(main).T, np.array(rest).T)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        if self.span < 1 << 62:
            return self.n * (x - self.low) - np.array(self.sums, np.int64)
        return self.n * (x.astype(object) - self.low.astype(object)) - np.array(self.sums, object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        exact = centred.astype(np.longdouble)
        return (exact @ (self.main.astype(np.longdouble) + self.rest.astype(np.longdouble))).astype(float)

    def deviations(self, centred: np.ndarray) -> list[int]:
        """Sums of squares of the centred entries, exact."""
        if self.span < 1 << 52 and centred.shape[1] <= 1 << 10:  # halves of 26 bits, sums below 64
            high, low = centred >> 26, centred & ((1 << 26) - 1)
            sums = ((high * high).sum(1), (high * low).sum(1), (low * low).sum(1))
            return [(int(a) << 52) + (int(b) << 27) + int(c) for a, b, c in zip(*sums)]
        return [sum(int(v) * int(v) for v in row) for row in centred]


def _whiten(batches: Iterator[pa.RecordBatch], model: Whitener, kind: pa.DataType | None = None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch.column(batch.num_columns - 1))
        if not len(x):
            continue
        centred = model.centred(x)
        exact = model.deviations(centred)
        columns = [
            *batch.columns[:-1],
            pa.array([v if v < 1 << 63 else None for v in exact], pa.int64()),
            pa.array(map(str, exact), pa.string()),
            pa.array(list(model.whitened(centred)), pa.list_(pa.float64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "deviation", "deviation_exact", "parts"])


_PARTS = "deviation bigint, deviation_exact string, parts array<double>"


def identity_error(fit: DataFrame, model: Whitener, sound: list[int]) -> float | None:
    """The largest entry of the fit list's whitened covariance less the identity.
    The entries are centred as integers before they are multiplied."""
    if not sound:
        return None
    parts = fit.select("x").mapInArrow(lambda batches: _whiten(batches, model), _PARTS)
    pairs = [(i, j) for i in sound for j in sound if i <= j]
    means = parts.agg(*(F.avg(F.get("parts", F.lit(i)) * F.get("parts", F.lit(j))) for i, j in pairs)).first()
    return max(abs(value - (i == j)) for (i, j), value in zip(pairs, means))


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """One row for each sound vector and each of the `count` leading components:
    vec_id, component (from 1), n, deviation, deviation_exact, whitened,
    explained, identity_error."""
    python_tasks(rows.sparkSession)
    found = integer_rows(rows, key, vector)
    fit = saved(found.select("x").distinct())
    stats = scatter(fit)
    if stats is None:
        names = {"component": "int", "n": "bigint", "deviation": "bigint", "deviation_exact": "string", "whitened": "double", "explained": "double"}
        empty = {name: F.lit(None).cast(kind) for name, kind in (names | {"identity_error": "double"}).items()}
        return found.select("vec_id", *(value.alias(name) for name, value in empty.items()))
    pairs = components(stats, count)
    model = Whitener.of(stats, pairs)
    sound = [k for k, (_, v) in enumerate(pairs) if v is not None]
    error = identity_error(fit, model, sound)
    trace = sum(stats.centred[k][k] for k in range(len(stats.low)))
    with decimal.localcontext(decimal.Context(prec=DIGITS)):
        shares = [float(value * stats.n * stats.n / trace) if trace else None for value, _ in pairs]
    schema = f"vec_id {found.schema['vec_id'].dataType.simpleString()}, {_PARTS}"
    out = found.select("vec_id", "x").mapInArrow(lambda batches: _whiten(batches, model), schema)
    out = out.select("vec_id", "deviation", "deviation_exact", F.posexplode("parts").alias("place", "part"))
    explained = F.array(*(F.lit(share).cast("double") for share in shares))
    return out.select(
        "vec_id",
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(stats.n).cast("bigint").alias("n"),
        "deviation",
        "deviation_exact",
        F.when(F.col("place").isin(sound), F.col("part")).alias("whitened"),
        F.get(explained, "place").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
