"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct five-word shingles, lower-cased.  A line is
removed when an earlier one (by doc_id, then place) has a Jaccard similarity of
at least `percent`.  A line of fewer words than a shingle has its whole word
sequence for its one token, so it goes when an earlier line has the same words.
`shortest` is the number of words from which lines take part: 1 for all.

Lines with equal token sets are one node, held by its earliest place.  Tokens
are ordered by rarity.  Two similar lines share a token of both prefixes (prefix
filter), neither is too short for the other (length filter), and enough tokens
stand behind the first shared one (position filter).  Every line meets the
earliest line of each of its prefix tokens first; most repeats are settled by
that.  Lines shorter than a shingle need no join: their repeats are equal nodes.
Only lines that stay unsettled are compared with all earlier lines of
their prefixes.

Skew: a common line is one node, and its places are partial minima; common
tokens are hot keys of plain joins, which Spark splits.

Defined cases: a null or empty text has no lines; rows with equal doc_id and
text are handled alike, the same place in both being one place; a null doc_id
comes first.  An empty table gives no rows.  Extra columns stay in `dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescope.llm.set_join import NONE, Items, candidate_sets, lengths_fit, places_fit, prefixes, signed, similar
from linescope.llm.storage import free_name, saved
from linescope.llm.words import line_words, mixed, windows

SIZE = 5


def mark_of(data: bytes) -> int:
    """What Spark's xxhash64 gives for the text."""
    return signed(xxhash.xxh64_intdigest(data, seed=42))


def _named(sums: np.ndarray) -> list[int]:
    return mixed(sums).view(np.int64).tolist()


def short_lines(hashes: np.ndarray, counts: np.ndarray, shortest: int, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Place, name and an empty set of every line of `shortest` to `size` - 1
    words: it can only resemble its equals, which the name tells."""
    starts, none = np.cumsum(counts) - counts, np.empty(0, np.uint64)
    for n in range(max(1, shortest), size):
        places = np.flatnonzero(counts == n)
        if len(places):
            words = hashes[starts[places][:, None] + np.arange(n)].reshape(-1)
            names = _named(mixed(windows(words, n)[::n]))
            yield from ((place, name, none) for place, name in zip(places.tolist(), names))


def line_sets(data: bytes, size: int = SIZE, shortest: int = SIZE) -> Iterator[tuple[int, int, np.ndarray]]:
    """Place, name and distinct shingles of every line of at least `shortest`
    words.  The name is a sum over the shingles, so their order does not matter."""
    hashes, counts = line_words(data)
    yield from short_lines(hashes, counts, shortest, size)
    if len(hashes) < size:
        return
    lines = np.repeat(np.arange(len(counts)), counts)
    whole = lines[size - 1 :] == lines[: len(lines) - size + 1]
    grams, lines = windows(hashes, size)[whole], lines[: len(whole)][whole]
    if not len(grams):
        return
    ordered = np.sort(grams)
    if (ordered[1:] == ordered[:-1]).any():  # perhaps twice in one line
        order = np.lexsort((grams, lines))
        grams, lines = grams[order], lines[order]
        fresh = np.append(True, (grams[1:] != grams[:-1]) | (lines[1:] != lines[:-1]))
        grams, lines = grams[fresh], lines[fresh]
    edges = np.flatnonzero(np.append(True, lines[1:] != lines[:-1]))
    names = _named(np.add.reduceat(mixed(grams), edges))
    for place, name, start, end in zip(lines[edges].tolist(), names, edges.tolist(), [*edges[1:].tolist(), len(lines)]):
        yield place, name, grams[start:end]


def _lines(batch: pa.RecordBatch, shortest: int) -> Iterator[Items]:
    """The sets of a document's lines; notes (doc_id, mark of the text, place) of
    each, and one without a set that has the number of lines for place."""
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        data = (text or "").encode("utf-8", "surrogatepass")
        doc_id, mark = NONE if doc_id is None else doc_id, mark_of(data)
        sets, notes = [], [(doc_id, mark, data.count(b"\n") + 1 if data else 0, None)]
        for place, name, grams in line_sets(data, shortest=shortest):
            sets.append((name, grams))
            notes.append((doc_id, mark, place, name))
        yield sets, notes


def earlier_matches(nodes: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """Nodes (node) whose earliest place has an earlier similar line."""
    sets = nodes.select("node", "grams")
    # Numbers in the order of the lines stand for the nodes: partitions of a sort
    # are in order, and so are these ids.
    order = first.join(nodes.select("node"), "node").orderBy("first").select("node", F.monotonically_increasing_id().alias("line"))
    order = saved(order)
    sets = sets.join(order, "node").select("line", "grams")
    postings = saved(prefixes(nodes, percent).join(order, "node").select("line", "n", "place", "gram"))
    earliest = postings.groupBy("gram").agg(F.min(F.struct("line", "n", "place")).alias("other"))
    heads = postings.join(earliest, "gram").select(
        F.col("line").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("place_a"),
        F.col("other.line").alias("b"), F.col("other.n").alias("n_b"), F.col("other.place").alias("place_b"),
    )
    settled = saved(_matched(_thinned(heads, percent), sets, percent))
    mine = postings.join(settled, "line", "left_anti")
    mine = mine.select(F.col("line").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("place_a"), "gram")
    others = postings.select(F.col("line").alias("b"), F.col("n").alias("n_b"), F.col("place").alias("place_b"), "gram")
    rest = _thinned(mine.join(others, "gram"), percent)
    return settled.union(_matched(rest, sets, percent)).distinct().join(order, "line").select("node")


def _thinned(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of a line and an earlier one that pass the length and
    position filters."""
    return pairs.filter((F.col("b") < F.col("a")) & lengths_fit(percent) & places_fit(percent)).select("a", "n_a", "b", "n_b").distinct()


def _matched(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("line").alias("a"), F.col("grams").alias("left"))
    right = sets.select(F.col("line").alias("b"), F.col("grams").alias("right"))
    both = pairs.join(left, "a").join(right, "b").withColumn("overlap", F.size(F.array_intersect("left", "right")))
    return both.filter(similar("overlap", percent)).select(F.col("a").alias("line")).distinct()


def removed_lines(docs: DataFrame, percent: int = 75, shortest: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, removed_lines): places, from 0, of the lines to remove, of
    every document (doc_id and hash of its text) that has any; and (doc_id,
    mark, n_lines) of all documents."""
    nodes, notes = candidate_sets(docs.select("doc_id", "text"), lambda batch: _lines(batch, shortest), percent, ["doc_id", "mark", "place"])
    every = notes.filter("node is null").select("doc_id", "mark", F.col("place").alias("n_lines"))
    places = notes.filter("node is not null").select("doc_id", "mark", "place", "node")
    spot = F.struct("doc_id", "mark", "place")
    first = saved(places.groupBy("node").agg(F.min(spot).alias("first")))
    again = earlier_matches(nodes, first, percent).withColumn("beaten", F.lit(True))
    verdict = first.join(again, "node", "left")
    later = places.join(verdict, "node").filter(F.coalesce("beaten", F.lit(False)) | (spot != F.col("first")))
    return later.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("place")).alias("removed_lines")), every


def _with_removed(rows: DataFrame, mark: Column, removed: DataFrame, name: str) -> DataFrame:
    """The lines to remove of every row of `rows`, by doc_id and `mark`, as
    `name`; null where no line goes."""
    own, its = free_name(rows, "removed_doc_id"), free_name(rows, "removed_mark")
    side = removed.select(F.col("doc_id").alias(own), F.col("mark").alias(its), F.col("removed_lines").alias(name))
    here = F.col("doc_id").eqNullSafe(F.col(own)) & (mark == F.col(its))
    return rows.join(side, here, "left").drop(own, its)


def verdicts(docs: DataFrame, percent: int = 75, shortest: int = SIZE) -> DataFrame:
    """doc_id, n_lines, n_removed and removed_lines of every document."""
    removed, every = removed_lines(docs, percent, shortest)
    gone = F.coalesce("removed_lines", F.array().cast("array<bigint>"))
    rows = _with_removed(every, F.col("mark"), removed, "removed_lines")
    return rows.select("doc_id", "n_lines", F.size(gone).cast("bigint").alias("n_removed"), gone.alias("removed_lines"))


def dedup(docs: DataFrame, percent: int = 75, shortest: int = SIZE) -> DataFrame:
    """`docs` without the removed lines; n_chars, where there is one, counts
    anew.  A document that loses lines and has no word left goes."""
    removed, _ = removed_lines(docs, percent, shortest)
    name = free_name(docs, "removed_lines")
    rows, gone = _with_removed(docs, F.xxhash64("text"), removed, name), F.col(name)
    lines = F.split("text", "\n", -1)
    left = F.array_join(F.filter(lines, lambda line, k: ~F.array_contains(gone, k.cast("bigint"))), "\n")
    rows = rows.withColumn("text", F.when(gone.isNotNull(), left).otherwise(F.col("text")))
    rows = rows.filter(gone.isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.when(gone.isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return rows.select(*docs.columns)
