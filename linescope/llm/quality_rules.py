"""Quality rules: lines that too many documents of a host share.

Every text is read once.  The task that reads it counts the base figures and
hashes its normalised lines; from then on only hashes move.  A line counts once
per document (`per_document`: distinct doc_id, and every row without one), or
else once per distinct text of a host.  Lines above the limit are removed; a
document that keeps too little is rejected.  With `share` 0 the limit is the
same for a host of any size.

Skew: the count has the key (host, line) and partial sums, so a host with a
third of all rows spreads over its lines, and a line of a third of all
documents arrives as one row per task.  Finding the documents of a common line
is a plain join whose hot keys Spark splits.

Nulls: a null text has no words and fails the base rules; a null host is a host
of its own.  Each input row is judged as a document, repeated ids included.  An empty
table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescope.llm.set_join import signed
from linescope.llm.storage import python_tasks, saved
from linescope.llm.words import SPACE, windows, word_hashes

SYMBOLS = b"#*$%&|<>"

_FIELDS = "doc_id bigint, host string, text_hash bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, line_hash array<bigint>, line_words array<int>, line_first array<int>"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("host", pa.string()), ("text_hash", pa.int64())]
    + [(name, pa.int64()) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("line_hash", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int32())), ("line_first", pa.list_(pa.int32()))]
)


def repeated_words(hashes: np.ndarray, size: int = 5) -> int:
    """Words inside windows of `size` words that occur twice or more."""
    if len(hashes) <= size:
        return 0
    found = windows(hashes, size)
    order = np.argsort(found, kind="stable")
    same = found[order[1:]] == found[order[:-1]]
    if not same.any():
        return 0
    edge = np.zeros(len(hashes) + 1, np.int64)
    again = np.zeros(len(found), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    hits = np.flatnonzero(again)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_figures(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and of each
    distinct normalised line with a word: hash, words (all copies), first place."""
    data = (text or "").encode("utf-8", "surrogatepass")
    spaces = len(data) - len(data.translate(None, SPACE))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    hashes = word_hashes(data)
    seen: set[bytes] = set()
    lines: dict[int, list[int]] = {}
    repeats = 0
    for place, line in enumerate(data.split(b"\n")):
        if not line.strip(SPACE):
            continue
        digest = xxhash.xxh3_128_digest(line)
        repeats += digest in seen
        seen.add(digest)
        words = line.lower().split()
        key = signed(xxhash.xxh3_64_intdigest(b" ".join(words)))
        if key in lines:
            lines[key][0] += len(words)
        else:
            lines[key] = [len(words), place]
    return (
        len(hashes),
        len(text or "") - spaces,
        symbols,
        repeats,
        repeated_words(hashes),
        list(lines),
        [v[0] for v in lines.values()],
        [v[1] for v in lines.values()],
    )


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hosts, texts = (batch.column(k).to_pylist() for k in range(3))
        rows = [text_figures(text) for text in texts]
        marks = [signed(xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass"))) for text in texts]
        columns = [ids, hosts, marks, *map(list, zip(*rows))] if rows else [[] for _ in _ARROW]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def figures(docs: DataFrame, host: str = "source") -> DataFrame:
    """Base figures and line hashes of every document, saved once."""
    python_tasks(docs.sparkSession)
    rows = docs.select("doc_id", F.col(host).alias("host"), "text").mapInArrow(_figures, _FIELDS)
    return saved(rows.withColumn("row_id", F.monotonically_increasing_id()))


def common_lines(rows: DataFrame, min_docs: int, share: float, per_document: bool = False) -> DataFrame:
    """(host, line_hash) of lines in more distinct texts, or documents, of a
    host than max(min_docs, share * texts, or documents, of the host)."""
    unnamed = F.when(F.col("doc_id").isNull(), F.col("row_id")).alias("unnamed")
    one = ["doc_id", unnamed] if per_document else ["text_hash"]
    texts = rows.select("host", *one).distinct().groupBy("host").agg(F.count("*").alias("n_texts"))
    lines = (
        rows.select("host", *one, F.explode("line_hash").alias("line_hash"))
        .distinct()
        .groupBy("host", "line_hash")
        .agg(F.count("*").alias("n_docs"))
        .filter(F.col("n_docs") > min_docs)
    )
    if share == 0:
        return lines
    limit = F.greatest(F.lit(min_docs), F.col("n_texts") * F.lit(share))
    return (
        lines.withColumnRenamed("host", "line_host")
        .join(texts, F.col("line_host").eqNullSafe(F.col("host")))
        .filter(F.col("n_docs") > limit)
        .select("host", "line_hash", "n_docs")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def quality_rules(
    docs: DataFrame, host: str = "source", min_docs: int = 10, share: float = 0.05, min_left: float = 0.3, per_document: bool = False
) -> DataFrame:
    """One row per document: base figures, `removed_lines` (places of the first
    copies of lines above the limit, from 0), `n_removed_words`, base_failed,
    kept.

    A document is rejected when the lines it keeps hold less than `min_left` of
    its words.
    """
    rows = figures(docs, host)
    common = common_lines(rows, min_docs, share, per_document)
    mine = rows.select("row_id", "host", F.explode(F.arrays_zip("line_hash", "line_words", "line_first")).alias("line"))
    mine = mine.select("row_id", F.col("host").alias("own_host"), "line.*")
    gone = (
        mine.withColumnRenamed("line_hash", "own_hash")
        .join(common, F.col("own_host").eqNullSafe(F.col("host")) & (F.col("own_hash") == F.col("line_hash")))
        .groupBy("row_id")
        .agg(F.sum("line_words").alias("n_removed_words"), F.sort_array(F.collect_list("line_first")).alias("removed_lines"))
    )
    left = F.col("n_words") - F.col("n_removed_words")
    return (
        rows.drop("line_hash", "line_words", "line_first", "text_hash")
        .join(gone, "row_id", "left")
        .withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
        .withColumn("removed_lines", F.coalesce("removed_lines", F.array().cast("array<int>")))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (left >= F.lit(min_left) * F.col("n_words")))
        .drop("row_id")
    )


def without_common_lines(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The kept documents with their common lines (every copy) taken out of the
    text.  `doc_id` must be unique."""
    verdict = verdicts.filter("kept").select("doc_id", "removed_lines")
    lines = F.split("text", "\n", -1)
    key = lambda x: F.array_join(F.filter(F.split(F.lower(x), r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ")
    bad = F.transform("removed_lines", lambda k: key(F.get(lines, k)))
    text = F.array_join(F.filter(lines, lambda x: ~F.array_contains(bad, key(x))), "\n")
    return docs.join(verdict, "doc_id").withColumn("text", F.when(F.size("removed_lines") > 0, text).otherwise(F.col("text"))).drop("removed_lines")
