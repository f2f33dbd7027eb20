"""Quality classifier by importance resampling.

Tokens (runs of word characters, runs of punctuation) and token pairs are hashed
to a fixed number of slots.  Two multinomial models are counted: the target's
(labelled good texts) and the raw corpus's (every document); the target's is
shrunk to the raw one, so a slot without evidence weighs nothing.  A document's
log weight is the sum of log target / raw over its slots, the ratio of the two
models.  Gumbel noise is added, and the k largest are kept: a sample of k
documents without repetition, drawn by weight.

k is a share of the documents with words: the one that is asked for, or else the
share of good ones among the labelled documents that are there.

The target and the share come from at most `max_labels` labelled rows, a stated
bound (those with the least hash of doc_id); all counts of the raw model, all
weights and the choice of the k largest cover every document.  Only two arrays
of a fixed number of slots and histogram counts reach the driver.

Noise depends on doc_id and seed alone, so a retried task draws the same.

Defined cases: a text without words (null, empty) has weight null and is
rejected; without any good labelled document in the corpus every document with
words is kept; a null label counts as none; equal keys at the border are all
kept; repeated rows are judged alike.  An empty table gives no rows.  Extra
columns stay in `resample`.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linescope.llm.storage import free_name, python_tasks, saved
from linescope.llm.words import blocks, mixed

SLOTS = 1 << 15
MAX_LABELS = 20_000


_TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^\x00-\x200-9A-Za-z_\x80-\xff]+")


def slots_of(text: str | None) -> np.ndarray:
    """Slots of the tokens and token pairs of a text."""
    parts = []
    for piece in blocks((text or "").encode("utf-8", "surrogatepass")):
        found = _TOKEN.findall(piece)
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)))
    hashes = np.concatenate(parts)
    pairs = mixed(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
    return (np.concatenate([hashes, pairs]) >> np.uint64(64 - 15)).astype(np.int32)


def log_weight(slots: np.ndarray, ratio: np.ndarray) -> float | None:
    return float(ratio[slots].sum(dtype=np.float64)) if len(slots) else None


#: Stands for the number of labelled documents, beside the slots.
_LABELLED = -1


def _count(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
    """Slot counts of this task's documents, raw and target, and how many of them
    are labelled and how many of these are good."""
    raw, target = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
    labelled = good = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            slots = slots_of(text)
            counts = np.bincount(slots, minlength=SLOTS)
            raw += counts
            quality = known.value.get(doc_id) if len(slots) else None
            if quality is not None:
                labelled += 1
                good += quality > 0
            if quality is not None and quality > 0:
                target += counts
    used = np.flatnonzero(raw)
    columns = [np.append(used, _LABELLED), np.append(raw[used], labelled), np.append(target[used], good)]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["slot", "raw", "target"])


@dataclasses.dataclass(frozen=True)
class Model:
    ratio: np.ndarray  # log target / raw by slot
    share: float  # of good documents among the labelled ones


def labelled(labels: DataFrame, max_labels: int) -> dict[int, int]:
    """doc_id and quality of at most `max_labels` labelled rows."""
    rows = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels).collect()  # bounded by the parameter
    return {row.doc_id: row.quality for row in rows}


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, shrink: float = 10.0) -> Model | None:
    """Both models; None without a good labelled document.  `shrink` is added to
    the target's count of a slot and to the count that the raw model expects
    there."""
    spark = docs.sparkSession
    python_tasks(spark)
    known = spark.sparkContext.broadcast(labelled(labels, max_labels))
    counts = docs.select("doc_id", "text").mapInArrow(lambda b: _count(b, known), "slot bigint, raw bigint, target bigint")
    counts = counts.groupBy("slot").agg(F.sum("raw"), F.sum("target")).collect()  # SLOTS rows at most, and one
    raw, target, share = np.zeros(SLOTS), np.zeros(SLOTS), 0.0
    for slot, all_of, good_of in counts:
        if slot == _LABELLED:
            share = good_of / all_of if all_of else 0.0
        else:
            raw[slot], target[slot] = all_of, good_of
    if not share:
        return None
    expected = raw * (target.sum() / raw.sum())
    return Model(np.log((target + shrink) / (expected + shrink)), share)


#: Weighs every document alike.
EVEN = Model(np.zeros(SLOTS), 1.0)


def weighed(docs: DataFrame, model: Model, name: str = "log_weight") -> DataFrame:
    """`docs` with the log weight of every document as `name`."""
    python_tasks(docs.sparkSession)
    ratio = docs.sparkSession.sparkContext.broadcast(model.ratio)
    at = docs.columns.index("text")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([log_weight(slots_of(text), ratio.value) for text in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    return docs.mapInArrow(weigh, StructType(list(docs.schema.fields)).add(name, "double"))


def noise(seed: int):
    """Gumbel noise from doc_id and seed."""
    unit = (F.pmod(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1))), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(unit))


def kth_largest(keys: DataFrame, k: int) -> float:
    """Value of the k-th largest `key`, by counting in ever finer bins."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    bins = 4096
    while high > low:
        width = (high - low) / bins
        if low + width == low or high - width == high:
            break
        place = F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1)).alias("bin")
        inside = keys.filter((F.col("key") >= low) & (F.col("key") <= high))
        found = {row.bin: row for row in inside.groupBy(place).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()}
        for b in sorted(found, reverse=True):
            if k <= found[b].n:
                low, high = found[b].low, found[b].high
                break
            k -= found[b].n
    return low


def border(weights: DataFrame, share: float, seed: int, name: str = "log_weight") -> float:
    """The least key, weight and noise, of the share of documents to keep."""
    keys = weights.filter(F.col(name).isNotNull()).select((F.col(name) + noise(seed)).alias("key"))
    k = round(share * keys.count())
    return kth_largest(keys, k) if k else np.inf


def classify(docs: DataFrame, labels: DataFrame, seed: int = 0, max_labels: int = MAX_LABELS, share: float | None = None) -> DataFrame:
    """doc_id, log_weight and kept for every document."""
    model = fit(docs, labels, max_labels) or EVEN
    rows = saved(weighed(docs.select("doc_id", "text"), model).drop("text"))
    least = border(rows, model.share if share is None else share, seed)
    kept = F.coalesce(F.col("log_weight") + noise(seed) >= F.lit(least), F.lit(False))
    return rows.select("doc_id", "log_weight", kept.alias("kept"))


def resample(docs: DataFrame, labels: DataFrame, seed: int = 0, max_labels: int = MAX_LABELS, share: float | None = None) -> DataFrame:
    """The kept documents with all their columns.  Only doc_ids and weights are
    saved.  Texts are read three times, for the models, the border and the
    choice; none is kept on disk or shuffled, and every reading weighs alike."""
    model = fit(docs, labels, max_labels) or EVEN
    weights = saved(weighed(docs.select("doc_id", "text"), model).drop("text"))
    least = border(weights, model.share if share is None else share, seed)
    name = free_name(docs, "log_weight")
    return weighed(docs, model, name).filter(F.col(name) + noise(seed) >= F.lit(least)).select(*docs.columns)
