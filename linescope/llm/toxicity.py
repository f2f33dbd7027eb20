"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the bag has a label.  A sentence's
probability is a logistic function of the character n-grams and words it holds;
a document is toxic unless all its sentences are clean (noisy-or):

    score = 1 - product over sentences of (1 - p)

Learning: labelled documents are sampled, at most `max_labels` (those with the
least hash of doc_id; a stated bound).  N-grams inside words, their edges marked
by a space, that are found in more toxic than clean documents by `FIRM` standard
errors become the features, the firmest `FEATURES` of them.  The sampled
documents are reduced to the features of each sentence and saved; each step of
the gradient descent is a job over that table, whose tasks return one gradient.
The likelihood is that of the noisy-or, so a toxic document pulls up the
sentences that explain its label and leaves the others alone.

Scoring: one pass over all documents; an Aho-Corasick automaton finds the
features of a text.  Offending sentences are those with a probability of one half
or more, given as places in the text.

Only rows with a label, and of these only those whose doc_id is not held out,
are learned from; lang, source and doc_id are no inputs of a score.

Defined cases: a text without sentences (null, empty, no letters) has score 0;
without toxic or without clean labels nothing is learned, and every sentence has
the share of toxic labels (one half without labels) as its probability; a null label counts as none, of several
labels of a document the highest counts; repeated rows are scored alike; a row
without doc_id is scored and not held out.  Texts of any length are read whole.
An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import dataclasses
import itertools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescope.llm.storage import python_tasks, saved

MAX_LABELS = 10_000
FEATURES = 1 << 12
SHORTEST, LONGEST, WORD = 3, 6, 24  # characters of an n-gram, and of a whole word with its edges
FIRM = 3.0
PARTS = 16  # tasks of a step; the sample has a bound, so they have one too
STEPS, PACE, DECAY = 80, 0.15, 1e-4
LEAST = 0.1  # features of less weight are dropped after learning
FOLDS = 5
HELD = 300_000  # n-grams that a counting task holds at once
BIAS = 0  # place of the intercept

_SENTENCE = re.compile(r"[^.!?\n…。！？]+")
_OTHER = re.compile(r"[^\w ]|[\d_]")


# ---- sentences and n-grams -------------------------------------------------------------


def letters(text: str) -> str:
    """The text in lower case with a space for every character that is no letter,
    place by place."""
    low = text.lower()
    if len(low) != len(text):  # a few letters have a longer lower case
        low = "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))
    return _OTHER.sub(" ", low)


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans between sentence ends that hold a letter or a digit."""
    return [m.span() for m in _SENTENCE.finditer(text) if any(map(str.isalnum, m[0]))]


def grams(word: str) -> set[str]:
    """N-grams of a word with its edges, and the word itself."""
    edged = f" {word} "
    found = {edged[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(edged) - n + 1)}
    if len(edged) <= WORD:
        found.add(edged)
    return found


class Finder:
    """Finds the features of a text, sentence by sentence."""

    def __init__(self, features: list[str]):
        self.automaton = ahocorasick.Automaton()
        for k, feature in enumerate(features):
            self.automaton.add_word(feature, (k, len(feature)))
        if features:
            self.automaton.make_automaton()

    def found(self, text: str | None) -> tuple[list[tuple[int, int]], dict[int, set[int]]]:
        """The sentences, and the features of those that have any, by place."""
        if not text:
            return [], {}
        spans = sentences(text)
        if not spans or not len(self.automaton):
            return spans, {}
        by_sentence: dict[int, set[int]] = {}
        at, end = -1, -1
        for last, (feature, size) in self.automaton.iter(f" {letters(text)} "):
            place = last - size // 2 - 1  # in the text, of a letter inside the match
            while end <= place and at + 1 < len(spans):
                at += 1
                end = spans[at][1]
            by_sentence.setdefault(at, set()).add(feature)
        return spans, by_sentence


# ---- sample and features ---------------------------------------------------------------


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, max_labels: int) -> DataFrame:
    """(text, toxic) of the labelled documents to learn from."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).select(F.col("doc_id").alias("known_id"), (F.col("toxic") > 0).alias("toxic"))
    known = known.orderBy(F.xxhash64("known_id"), "known_id").limit(max_labels)  # bounded by the parameter
    texts = docs.select(F.col("doc_id").alias("own_id"), "text").join(F.broadcast(known), F.col("own_id") == F.col("known_id"))
    return saved(texts.filter(F.length("text") > 0).select("text", "toxic").distinct())


class Counter:
    """Toxic and clean documents of every n-gram."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.words: dict[str, np.ndarray] = {}
        self.counts = np.zeros((1 << 16, 2), np.int64)

    def of_word(self, word: str) -> np.ndarray:
        found = self.words.get(word)
        if found is None:
            ids = self.ids
            found = np.array([ids.setdefault(gram, len(ids)) for gram in grams(word)], np.int64)
            self.words[word] = found
        return found

    def add(self, text: str, toxic: bool) -> None:
        words = set(letters(text).split())
        if words:
            found = np.unique(np.concatenate([self.of_word(word) for word in words]))
            while len(self.ids) > len(self.counts):
                self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
            self.counts[found, int(not toxic)] += 1

    def batch(self) -> pa.RecordBatch:
        used = self.counts[: len(self.ids)]
        return pa.RecordBatch.from_arrays([pa.array(list(self.ids), pa.string()), pa.array(used[:, 0]), pa.array(used[:, 1])], ["gram", "toxic", "clean"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = Counter()
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counter.add(text, toxic)
            if len(counter.ids) > HELD:
                yield counter.batch()
                counter = Counter()
    yield counter.batch()


def firm_grams(texts: DataFrame, toxic: int, clean: int) -> list[str]:
    """N-grams that tell toxic from clean documents, the firmest first."""
    counts = texts.mapInArrow(_counted, "gram string, toxic bigint, clean bigint")
    counts = counts.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    gap = F.log(a / (toxic + 1 - a)) - F.log(b / (clean + 1 - b))
    firm = (gap / F.sqrt(1 / a + 1 / (toxic + 1 - a) + 1 / b + 1 / (clean + 1 - b))).alias("firm")
    chosen = counts.select("gram", firm).filter(F.col("firm") >= FIRM).orderBy(F.desc("firm"), "gram").limit(FEATURES)
    return [row.gram for row in chosen.collect()]  # bounded by FEATURES


# ---- learning --------------------------------------------------------------------------


def _bags(batches: Iterator[pa.RecordBatch], features) -> Iterator[pa.RecordBatch]:
    """Of every text: label, number of sentences without features, and sizes and
    features of the others."""
    finder = Finder(features.value)
    for batch in batches:
        plain, sizes, held = [], [], []
        for text in batch.column(0).to_pylist():
            spans, found = finder.found(text)
            plain.append(len(spans) - len(found))
            sizes.append([len(s) for s in found.values()])
            held.append(list(itertools.chain.from_iterable(sorted(s) for s in found.values())))
        columns = [batch.column(1), pa.array(plain, pa.int64()), pa.array(sizes, pa.list_(pa.int32())), pa.array(held, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["toxic", "plain", "sizes", "features"])


def gradient(toxic: np.ndarray, plain: np.ndarray, sentences_of: np.ndarray, sizes: np.ndarray, features: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Gradient of the negative log likelihood by the intercept and the weights,
    and that value.  Bags have `plain` sentences without features and
    `sentences_of` others, of which each has `sizes` features."""
    bias = weights[BIAS]
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    bag = np.repeat(np.arange(len(toxic)), sentences_of)
    logit = bias + np.bincount(sentence, weights[1 + features], len(sizes))
    clean = plain * np.logaddexp(0, bias) + np.bincount(bag, np.logaddexp(0, logit), len(toxic))  # -log of the clean probability
    clean = np.maximum(clean, 1e-12)
    chance = -np.expm1(-clean)
    pull = np.where(toxic, 1 - 1 / chance, 1.0)  # derivative by `clean`
    loss = float(np.where(toxic, -np.log(chance), clean).sum())
    by_sentence = pull[bag] / (1 + np.exp(-logit))
    found = np.zeros_like(weights)
    found[1:] = np.bincount(features, by_sentence[sentence], len(weights) - 1)
    found[BIAS] = by_sentence.sum() + (pull * plain).sum() / (1 + np.exp(-bias))
    return found, loss


def _step(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    total, loss = np.zeros_like(weights), 0.0
    for batch in batches:
        toxic, plain = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        sizes, features = batch.column(2), batch.column(3)
        found, more = gradient(
            toxic, plain, np.diff(sizes.offsets.to_numpy()), sizes.flatten().to_numpy(), features.flatten().to_numpy(), weights
        )
        total, loss = total + found, loss + more
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([loss])], ["gradient", "loss"])


def descend(start: np.ndarray, gradient_of, steps: int = STEPS) -> np.ndarray:
    """Adam's descent; `gradient_of` gives the mean gradient at some weights.
    Weights shrink by DECAY; the intercept does not."""
    weights, mean, square = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for step in range(1, steps + 1):
        found = gradient_of(weights)
        found[1:] += DECAY * weights[1:]
        mean = 0.9 * mean + 0.1 * found
        square = 0.99 * square + 0.01 * found**2
        pace = PACE * min(1.0, 2.0 * (1 - step / (steps + 1)))
        weights = weights - pace * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return weights


@dataclasses.dataclass(frozen=True)
class Model:
    features: list[str]
    weights: np.ndarray  # intercept, then one for each feature


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Model:
    spark = docs.sparkSession
    python_tasks(spark)
    texts = sample(docs, labels, max_labels)
    numbers = {row.toxic: row.n for row in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = numbers.get(True, 0), numbers.get(False, 0)
    if not toxic or not clean:
        return Model([], np.array([np.log((toxic + 0.5) / (clean + 0.5))]))  # nothing to tell apart
    features = firm_grams(texts, toxic, clean)
    held = spark.sparkContext.broadcast(features)
    bags = saved(texts.mapInArrow(lambda batches: _bags(batches, held), "toxic boolean, plain bigint, sizes array<int>, features array<int>").coalesce(PARTS))

    def gradient_of(weights: np.ndarray) -> np.ndarray:
        rows = bags.coalesce(PARTS).mapInArrow(lambda batches: _step(batches, weights), "gradient binary, loss double").collect()
        return sum(np.frombuffer(row.gradient) for row in rows) / (toxic + clean)

    start = np.zeros(1 + len(features))
    start[BIAS] = np.log(toxic / (toxic + clean)) - 3.0
    weights = descend(start, gradient_of)
    held_on = np.flatnonzero(np.abs(weights[1:]) >= LEAST)
    return Model([features[k] for k in held_on], np.append(weights[BIAS], weights[1 + held_on]))


# ---- scoring ---------------------------------------------------------------------------


class Scorer:
    def __init__(self, model: Model):
        self.weights = model.weights
        self.finder = Finder(model.features)

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Of the text, and its offending sentences (start, end, probability)."""
        spans, found = self.finder.found(text)
        bias = float(self.weights[BIAS])
        clean = (len(spans) - len(found)) * float(np.logaddexp(0, bias))
        offending = []
        if bias >= 0:
            offending = [(*spans[k], 1 / (1 + np.exp(-bias))) for k in range(len(spans)) if k not in found]
        for place, features in found.items():
            logit = bias + sum(float(self.weights[1 + k]) for k in sorted(features))
            clean += float(np.logaddexp(0, logit))
            if logit >= 0:
                offending.append((*spans[place], float(1 / (1 + np.exp(-logit)))))
        return float(-np.expm1(-clean)), sorted(offending)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("probability", pa.float64())]))
_SCORED = "doc_id bigint, score double, offending array<struct<start:int,stop:int,probability:double>>"


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model.value)
    for batch in batches:
        rows = [scorer.score(text) for text in batch.column(1).to_pylist()]
        spans = [[dict(zip(("start", "stop", "probability"), span)) for span in found] for _, found in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in rows], pa.float64()), pa.array(spans, _SPANS)], ["doc_id", "score", "offending"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and offending (spans of sentences) of every document."""
    python_tasks(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(lambda batches: _scored(batches, held), _SCORED)


def toxicity(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """doc_id, held_out, score, predicted and offending of every document."""
    rows = score(docs, fit(docs, labels, max_labels))
    return rows.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "offending")
