"""Toxicity: features and gradient against plain versions, held-out accuracy."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linescope.llm import toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"
BAD = ["vrogle", "snerk", "blathgut"]


def corpus(n, seed=1, long=False):
    """Documents of which a fifth has one to three sentences with a bad word."""
    rng = random.Random(seed)
    docs, labels = [], []
    plain = [f"{a}{b}{c}" for a in ("ta", "mo", "re", "li") for b in ("na", "tu", "ko") for c in ("", "s", "ndo")]
    for doc_id in range(n):
        lines = [" ".join(rng.choices(plain, k=rng.randrange(4, 12))).capitalize() for _ in range(rng.randrange(2, 30))]
        toxic = rng.random() < 0.2
        if toxic:
            for k in rng.sample(range(len(lines)), min(len(lines), rng.randrange(1, 4))):
                words = lines[k].split(" ")
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "s", "ed"]))
                lines[k] = " ".join(words)
        docs.append((doc_id, ". ".join(lines) + rng.choice([".", "!", "\n"]), "en", "s", 0))
        labels.append((doc_id, 1, int(toxic)))
    return docs, labels


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_found_against_plain_search():
    rng = random.Random(3)
    letters = "abé \n.!Ai7_-…İ"
    for _ in range(300):
        text = "".join(rng.choices(letters, k=rng.randrange(0, 60)))
        features = sorted({g for w in toxicity.letters(text).split() for g in toxicity.grams(w) if rng.random() < 0.3} | {"zzz"})
        spans, found = toxicity.Finder(features).found(text)
        assert spans == toxicity.sentences(text)
        want = {}
        for k, (a, b) in enumerate(spans):
            have = set().union(*(toxicity.grams(w) for w in toxicity.letters(text[a:b]).split()), set())
            if hits := {i for i, f in enumerate(features) if f in have}:
                want[k] = hits
        assert found == want


def test_counts_against_plain_sets():
    docs, labels = corpus(40)
    counter = toxicity.Counter()
    want = {}
    for (_, text, *_), (_, _, toxic) in zip(docs, labels):
        counter.add(text, bool(toxic))
        for gram in set().union(*(toxicity.grams(w) for w in toxicity.letters(text).split())):
            want.setdefault(gram, [0, 0])[1 - toxic] += 1
    batch = counter.batch()
    got = {row["gram"]: [row["toxic"], row["clean"]] for row in batch.to_pylist()}
    assert got == want


def plain_loss(bags, weights):
    loss = 0.0
    for toxic, plain, found in bags:
        clean = plain * math.log1p(math.exp(weights[0])) + sum(math.log1p(math.exp(weights[0] + sum(weights[1 + f] for f in s))) for s in found)
        loss += -math.log(1 - math.exp(-clean)) if toxic else clean
    return loss


def test_gradient_by_differences():
    rng = random.Random(4)
    bags = [(rng.random() < 0.5, rng.randrange(1, 5), [sorted(rng.sample(range(6), rng.randrange(1, 4))) for _ in range(rng.randrange(0, 4))]) for _ in range(20)]
    weights = np.array([rng.gauss(-1, 0.5) for _ in range(7)])
    arrays = (
        np.array([b[0] for b in bags]),
        np.array([b[1] for b in bags]),
        np.array([len(b[2]) for b in bags]),
        np.array([len(s) for b in bags for s in b[2]]),
        np.array([f for b in bags for s in b[2] for f in s]),
    )
    found, loss = toxicity.gradient(*arrays, weights)
    assert loss == pytest.approx(plain_loss(bags, weights))
    for k in range(7):
        step = np.zeros(7)
        step[k] = 1e-5
        slope = (plain_loss(bags, weights + step) - plain_loss(bags, weights - step)) / 2e-5
        assert found[k] == pytest.approx(slope, rel=1e-4, abs=1e-6)


def test_held_out_accuracy_and_sentences(spark):
    docs, labels = corpus(700)
    odd = [(-1, None, "en", "s", 0), (-2, "", "en", "s", 0), (-3, " \n.. 7!", "en", "s", 1), (None, docs[0][1], None, None, 0), (5, docs[5][1], "x", "y", 9)]
    odd += [(-4, "tana moko. " * 200_000 + "you vrogle. " + "tana moko. " * 1000, "en", "s", 1)]
    marked = [*labels, (-1, 1, 1), (3, 1, None), (None, 1, 1), (7, 0, 0)]
    table = spark.createDataFrame(docs + odd, DOCS)
    got = toxicity.toxicity(table, spark.createDataFrame(marked, LABELS)).collect()
    assert len(got) == len(docs) + len(odd)
    truth = {doc_id: toxic for doc_id, _, toxic in labels}
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    judged = [r for r in got if r.doc_id in truth and r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in judged) >= 0.97 * len(judged) and len(judged) > 80
    texts = dict((d[0], d[1]) for d in docs)
    right = wrong = missed = 0
    for r in judged:
        spans = [texts[r.doc_id][s.start : s.stop] for s in r.offending]
        right += sum(any(b in s for b in BAD) for s in spans)
        wrong += sum(not any(b in s for b in BAD) for s in spans)
        missed += sum(any(b in s for b in BAD) for s in (texts[r.doc_id][a:b] for a, b in toxicity.sentences(texts[r.doc_id])) if s not in spans)
    assert wrong <= 0.05 * right and missed <= 0.05 * right
    by_id = {r.doc_id: r for r in got}
    assert by_id[-1].score == by_id[-2].score == 0 and by_id[None].held_out is False
    assert [r.score for r in got if r.doc_id == 5][0] == [r.score for r in got if r.doc_id == 5][1]
    assert any("vrogle" in odd[-1][1][s.start : s.stop] for s in by_id[-4].offending)


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs, labels = corpus(150, seed=6)
    table = spark.createDataFrame(docs, DOCS)
    turned = [(d, q, 1 - t if held(d) else t) for d, q, t in labels]
    first, second = (
        sorted((r.doc_id, r.score) for r in toxicity.toxicity(table, spark.createDataFrame(rows, LABELS)).collect()) for rows in (labels, turned)
    )
    assert first == second


def test_without_one_kind_and_empty(spark):
    docs, labels = corpus(30, seed=2)
    table = spark.createDataFrame(docs, DOCS)
    for rows in ([], [(d, q, 0) for d, q, _ in labels], [(d, q, 1) for d, q, _ in labels]):
        got = toxicity.toxicity(table, spark.createDataFrame(rows, LABELS)).collect()
        assert len(got) == 30 and all(0 <= r.score <= 1 for r in got)
    empty = toxicity.toxicity(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, LABELS))
    assert empty.collect() == [] and empty.columns == ["doc_id", "held_out", "score", "predicted", "offending"]


def test_extra_columns(spark):
    docs, labels = corpus(60, seed=9)
    names = ["own_id", "known_id", "toxic", "score", "gram", "clean", "plain", "sizes", "features", "held_out", "offending"]
    odd = spark.createDataFrame(docs, DOCS).select("*", *(F.lit("clash").alias(n) for n in names))
    odd_labels = spark.createDataFrame(labels, LABELS).select("*", *(F.lit("clash").alias(n) for n in ["known_id", "own_id", "text", "score"]))
    assert toxicity.toxicity(odd, odd_labels).count() == 60
