"""Jaccard join of documents on word n-grams, by vertical partitioning.

All n-grams have one global order, rare ones first.  The order is cut into
fragments; a pair's overlap is counted in each fragment by itself and the
partial counts are summed.

1. `candidate_sets` reads every text once and leaves the sets that share 75 %
   of their n-grams with others; most documents end there.  Documents with
   equal sets are one node.
2. Two linked sets share one of the first r - ceil(0.75 n) + 1 shared n-grams
   of both (r: how many a set has).  Every set is compared with one hub: the
   set most of these point to.  That joins large groups of near copies without
   expanding their pairs.
3. What is left are pairs that share such an n-gram across two groups; length
   and position filters and a bound from parity sketches thin them while they
   are joined, and all that pass are verified.  A pair inside one group needs no
   look: it cannot change a component.

Skew: copies meet as one node; hubs and common n-grams are hot keys of plain
joins, which Spark splits, and of partial aggregates.

Defined cases: a null or empty text, or one without words, has n_shingles 0 and
its own doc_id as component; with fewer than five words the whole sequence is
the one n-gram; repeated rows are documents that link; a null doc_id is never
the least.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescope.llm.components import components
from linescope.llm.line_dedup import mark_of
from linescope.llm.set_join import NONE, Items, candidate_sets, lengths_fit, places_fit, prefixes, set_name, similar
from linescope.llm.storage import free_name, saved
from linescope.llm.words import windows, word_hashes

WORDS = 16  # of 64 bits, in a sketch; a power of two


def gram_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct n-gram hashes of a lower-cased text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    grams = np.sort(windows(word_hashes(data, lower=True), size))
    return grams[np.append(True, grams[1:] != grams[:-1])] if len(grams) else grams


def _documents(batch: pa.RecordBatch, size: int) -> Iterator[Items]:
    """The set of each document; notes (doc_id, mark of the text, 0)."""
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        doc_id = NONE if doc_id is None else doc_id
        mark = mark_of((text or "").encode("utf-8", "surrogatepass"))
        grams = gram_set(text, size)
        if len(grams):
            name = set_name(grams)
            yield [(name, grams)], [(doc_id, mark, 0, name)]
        else:
            yield [], [(doc_id, mark, 0, None)]


def fragments_of(nodes: DataFrame, fragments: int) -> DataFrame:
    """(node, fragment, grams): each set cut at the same places of the global
    order, which split all shared n-grams about evenly."""
    place = lambda freq, gram: F.shiftleft(F.least(freq, F.lit(32767)).cast("bigint"), 48) + F.shiftright(gram, 16)
    order = nodes.select(F.explode(F.arrays_zip("freqs", "grams")).alias("g")).select(place(F.col("g.freqs"), F.col("g.grams")).alias("place"))
    shares = [(k + 1) / fragments for k in range(fragments - 1)]
    cuts = order.agg(F.percentile_approx("place", shares, 1000)).first()[0] or []  # one number per cut

    def between(low: int | None, high: int | None):
        after = lambda g: F.lit(True) if low is None else place(g["freqs"], g["grams"]) > F.lit(low)
        until = lambda g: F.lit(True) if high is None else place(g["freqs"], g["grams"]) <= F.lit(high)
        return lambda g: after(g) & until(g)

    both = F.arrays_zip("freqs", "grams")
    pieces = [F.transform(F.filter(both, between(*ends)), lambda g: g["grams"]) for ends in zip([None, *cuts], [*cuts, None])]
    rows = nodes.select("node", F.posexplode(F.array(*pieces)).alias("fragment", "grams"))
    return rows.filter(F.size("grams") > 0)


def verified(pairs: DataFrame, segments: DataFrame, percent: int, fragments: int) -> DataFrame:
    """Pairs (a, b) whose partial overlaps, summed over the fragments, reach
    `percent` of the union.  r is how many n-grams of a set others share.

    The fragments are counted one after another, the rarest n-grams first.
    Before and after each, pairs end that could not reach the overlap even if they
    shared all that is left of the smaller set.
    """
    size = lambda grams: F.coalesce(F.array_size(grams), F.lit(0))
    enough = F.expr(f"(100 + {percent}) * (overlap + least(left_a, left_b)) >= {percent} * (n_a + n_b)")
    rows = pairs.select("a", "b", "n_a", "n_b", F.col("r_a").alias("left_a"), F.col("r_b").alias("left_b"), F.lit(0).alias("overlap")).filter(enough)
    for fragment in range(fragments):
        part = segments.filter(F.col("fragment") == fragment)
        of_a = part.select(F.col("node").alias("a"), F.col("grams").alias("grams_a"))
        of_b = part.select(F.col("node").alias("b"), F.col("grams").alias("grams_b"))
        both = rows.join(of_a, "a", "left").join(of_b, "b", "left")
        rows = both.select(
            "a", "b", "n_a", "n_b",
            (F.col("left_a") - size(F.col("grams_a"))).alias("left_a"),
            (F.col("left_b") - size(F.col("grams_b"))).alias("left_b"),
            (F.col("overlap") + size(F.array_intersect("grams_a", "grams_b"))).alias("overlap"),
        ).filter(enough)
    return rows.filter(similar("overlap", percent)).select("a", "b")


def sketches(nodes: DataFrame) -> DataFrame:
    """(node, bits_0, bits_1, ...): the parity, at each of 64 * WORDS places, of
    how many of a set's shared n-grams hash there."""
    hashed = nodes.select("node", F.explode("grams").alias("gram")).select("node", F.xxhash64("gram").alias("hash"))
    hashed = hashed.select("node", F.expr(f"(hash >> 6) & {WORDS - 1}").alias("word"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("bit"))
    words = [F.coalesce(F.bit_xor(F.when(F.col("word") == k, F.col("bit"))), F.lit(0)).alias(f"bits_{k}") for k in range(WORDS)]
    return hashed.groupBy("node").agg(*words)


def sketches_fit(percent: int) -> Column:
    """The overlap can reach `percent` of the union.  Every place where two
    sketches differ stands for an n-gram that one set has and the other lacks."""
    differ = " + ".join(f"bit_count(bits_{k}_a ^ bits_{k}_b)" for k in range(WORDS))
    return F.expr(f"(100 + {percent}) * (r_a + r_b - ({differ})) >= 2 * {percent} * (n_a + n_b)")


def links(nodes: DataFrame, percent: int, fragments: int) -> DataFrame:
    """Links (a, b) between different sets; enough to give every component."""
    segments = saved(fragments_of(nodes, fragments))
    shared = (F.col("n") - F.col("unshared")).alias("r")
    # The likeliest centre of a group has the fewest n-grams of its own.
    own = F.floor(64 * F.col("unshared") / F.col("n")).alias("own")
    postings = saved(prefixes(nodes, percent).select("node", "n", shared, own, "place", "gram"))
    hubs = postings.groupBy("gram").agg(F.min(F.struct("own", F.xxhash64("node").alias("mark"), "node", "n", "r")).alias("hub"))
    votes = (
        postings.join(hubs, "gram")
        .filter(F.col("node") != F.col("hub.node"))
        .groupBy(
            F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("r").alias("r_a"),
            F.col("hub.node").alias("b"), F.col("hub.n").alias("n_b"), F.col("hub.r").alias("r_b"),
        )
        .agg(F.count("*").alias("votes"))
        .filter(lengths_fit(percent))
    )
    star = votes.groupBy("a", "n_a", "r_a").agg(F.max(F.struct("votes", "b", "n_b", "r_b")).alias("top"))
    star = star.select("a", "n_a", "r_a", "top.b", "top.n_b", "top.r_b")
    found = saved(verified(star, segments, percent, fragments))
    groups = saved(components(found))

    grouped = postings.drop("own").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = grouped.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("gram")
    rest = saved(grouped.join(mixed, "gram"))
    drawn = sketches(nodes.join(rest.select("node").distinct(), "node", "left_semi"))
    rest = saved(rest.join(drawn, "node"))
    held = [column for column in rest.columns if column != "gram"]
    one = rest.select("gram", *(F.col(c).alias(f"{c}_a") for c in held))
    two = rest.select("gram", *(F.col(c).alias(f"{c}_b") for c in held))
    pairs = (
        one.join(two, "gram")
        .filter("root_a < root_b")
        .filter(lengths_fit(percent) & places_fit(percent))
        .filter(sketches_fit(percent))
        .select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "n_a", "n_b", "r_a", "r_b")
        .distinct()
    )
    return found.union(verified(pairs, segments, percent, fragments))


def _placed(docs: DataFrame, size: int, percent: int, fragments: int) -> DataFrame:
    """Of every document doc_id, mark of its text, n_shingles and root of its
    component; root is null without words."""
    nodes, notes = candidate_sets(docs.select("doc_id", "text"), lambda b: _documents(b, size), percent, ["doc_id", "mark", "nil"])
    roots = components(links(nodes, percent, fragments)).select(F.col("node").alias("linked"), "root")
    placed = notes.join(roots, F.col("node") == F.col("linked"), "left")
    return placed.select("doc_id", "mark", F.col("n").alias("n_shingles"), F.coalesce("root", "node").alias("root"))


def ngram_components(docs: DataFrame, size: int = 5, percent: int = 75, fragments: int = 3) -> DataFrame:
    """One row per document: doc_id, n_shingles (set size), component_id (the
    smallest doc_id it reaches by links, itself included).

    Two documents link when 100 * intersection >= percent * union.
    """
    placed = _placed(docs, size, percent, fragments).drop("mark")
    least = placed.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return placed.join(least, "root", "left").select("doc_id", "n_shingles", component.alias("component_id"))


def first_of_each_group(docs: DataFrame, size: int = 5, percent: int = 75, fragments: int = 3) -> DataFrame:
    """`docs` with one row of each component: the one of the smallest doc_id, a
    null one last, then of the smallest mark of the text; documents without
    words all stay.  A row is known by doc_id and text, so another text under a
    repeated id is judged by itself; of rows equal in both one stays."""
    placed = saved(_placed(docs, size, percent, fragments).filter("root is not null"))
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")
    kept = placed.groupBy("root").agg(F.min(row).alias("first")).select("root", "first.doc_id", "first.mark")
    # Rows of a component but its first; and firsts that are there more than once.
    rows = placed.groupBy("root", "doc_id", "mark").agg(F.count("*").alias("rows"))
    first = kept.select(F.col("root").alias("its_root"), F.col("doc_id").alias("first_id"), F.col("mark").alias("first_mark"))
    judged = saved(
        rows.join(first, F.col("root") == F.col("its_root")).select(
            F.col("doc_id").alias("own_id"), F.col("mark").alias("own_mark"), "rows",
            (F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("mark") == F.col("first_mark"))).alias("stays"),
        )
    )
    known = lambda side: docs["doc_id"].eqNullSafe(side["own_id"]) & (F.xxhash64(docs["text"]) == side["own_mark"])
    gone = judged.filter("not stays or rows > 1").select("own_id", "own_mark")
    again = judged.filter("stays and rows > 1").select("own_id", "own_mark")
    mark = free_name(docs, "mark")
    one = docs.join(again, known(again), "left_semi").withColumn(mark, F.xxhash64("text")).dropDuplicates(["doc_id", mark]).drop(mark)
    return docs.join(gone, known(gone), "left_anti").unionByName(one)
