"""Exact top-k search over binary codes by multi-index hashing.

A code of 64 bits is cut into m segments; an index row holds a segment's number
and value with the code.  A query probes each segment's values within a search
radius.  With radius r in segments up to j and r - 1 in the others, every code
within Hamming distance m * r + j has been met, as a farther miss would add up
to more.  Radii grow segment by segment, and a query leaves when k verified
neighbours lie within that bound: its kth distance is then provably covered.
The first `coarse` radii grow by whole rounds, as they find little.

Each step takes the pairs beyond the last bound and up to the new one, so what
it returns follows k and not the candidates.  Candidates are verified inside
the join.

Skew: rows with one code are one index row that keeps the k smallest ids, cut
by a partial top-k; queries with one code are searched once.  A segment value
that many codes hold is a hot key of a plain join, which Spark splits.

Ties go to the smaller id.  A query row finds itself at distance 0.  Defined
cases: a null embedding has no code: it is no neighbour and finds none; null
components count as not positive; repeated rows are neighbours of their own;
with fewer than k codes a query gets all.  An empty table gives no rows.  Extra
columns are ignored.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linescope.llm.storage import saved

BITS = 64


def sign_code(vector: str) -> Column:
    """The signs of the first 64 components as a 64-bit code."""
    bits = f"transform(slice({vector}, 1, {BITS}), (x, k) -> if(x > 0, shiftleft(1L, k), 0L))"
    return F.expr(f"if({vector} is null, null, aggregate({bits}, 0L, (a, b) -> a | b))")


def segment(code: Column, k: int, width: int) -> Column:
    return F.shiftrightunsigned(code, k * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def code_table(rows: DataFrame, k: int) -> DataFrame:
    """(code, ids): every code with its k smallest ids."""
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy("id"))).filter(F.col("place") <= k)
    return ranked.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _probes(queries: DataFrame, radii: list[int], width: int) -> DataFrame:
    """(query, segment, value) for every segment value within its radius."""
    values = F.sequence(F.lit(0), F.lit((1 << width) - 1))
    rows = []
    for k, radius in enumerate(radii):
        if radius < 0:
            continue
        rows.append(F.struct(F.lit(k).alias("segment"), F.transform(_masks(values, radius), _turned(segment(F.col("query"), k, width))).alias("values")))
    parts = queries.select("query", F.explode(F.array(*rows)).alias("part"))
    return parts.select("query", "part.segment", F.explode("part.values").alias("value"))


def _masks(values: Column, radius: int) -> Column:
    return F.filter(values, lambda x: F.bit_count(x) <= radius)


def _turned(value: Column):
    return lambda mask: value.bitwiseXOR(mask)


def _new_pairs(queries: DataFrame, index: DataFrame, radii: list[int], low: int, high: int, width: int) -> DataFrame:
    """Pairs at distances low < d <= high, each from the first segment that meets it."""
    differ = F.col("query").bitwiseXOR(F.col("code"))
    distance = F.bit_count(differ)
    earlier = [
        ~((F.col("segment") > F.lit(k)) & (F.bit_count(segment(differ, k, width)) <= F.lit(radius)))
        for k, radius in enumerate(radii)
        if radius >= 0
    ]
    first = functools.reduce(operator.and_, earlier)
    near = (distance <= F.lit(high)) & (distance > F.lit(low))
    return (
        _probes(queries, radii, width)
        .join(index, ["segment", "value"])
        .filter(near & first)
        .select("query", "code", "ids", distance.cast("int").alias("distance"))
    )


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, segments: int = 8, coarse: int = 2) -> DataFrame:
    """The k nearest rows (id, code) of every query (id, code): query_id, rank
    from 1, neighbor_id, distance.

    More segments make fewer probes and more candidates; about
    64 / log2(number of rows) is right for large tables.
    """
    width = BITS // segments
    rows, queries = rows.filter("code is not null"), queries.filter("code is not null")
    codes = saved(code_table(rows, k))
    parts = F.array(*(F.struct(F.lit(j).alias("segment"), segment(F.col("code"), j, width).alias("value")) for j in range(segments)))
    index = codes.select("code", "ids", F.explode(parts).alias("part")).select("part.segment", "part.value", "code", "ids")
    held = codes.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    want = min(k, held)
    active = saved(queries.select(F.col("code").alias("query")).distinct())
    found = None
    radius, last, bound = 0, 0, -1
    while want and active.take(1):
        last = segments - 1 if radius < coarse else last
        radii = [radius if j <= last else radius - 1 for j in range(segments)]
        covered = segments * radius + last
        step = saved(_new_pairs(active, index, radii, bound, covered, width))
        found = step if found is None else found.union(step)
        bound = covered
        enough = found.groupBy("query").agg(F.sum(F.size("ids")).alias("met")).filter(F.col("met") >= want).select("query")
        active = saved(active.join(enough, "query", "left_anti"))
        radius, last = (radius + 1, 0) if last == segments - 1 else (radius, last + 1)
    asked = queries.select(F.col("id").alias("query_id"), F.col("code").alias("query"))
    if found is None:
        return asked.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("neighbor_id"), F.lit(0).alias("distance")).limit(0)
    near = found.select("query", F.explode("ids").alias("neighbor_id"), "distance")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbor_id"))
    near = near.withColumn("rank", rank).filter(F.col("rank") <= k)
    return asked.join(near, "query").select("query_id", "rank", "neighbor_id", "distance")
