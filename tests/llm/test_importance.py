"""The resampling as a whole: against plain models and a plain draw."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_row_operators import documents

from linescope.llm import importance
from linescope.llm.storage import shared_folder

LABELS = "doc_id bigint, quality int, toxic int"


def corpus(n=400, seed=3):
    """Short texts whose words lean to one side more or less, so that many
    weights lie near each other."""
    rng = random.Random(seed)
    good, bad = [f"g{k}" for k in range(30)], [f"b{k}" for k in range(30)]
    docs, labels = [], []
    for k in range(n):
        lean = rng.random()
        docs.append((k, " ".join(rng.choice(good if rng.random() < lean else bad) for _ in range(rng.randrange(2, 12)))))
        if k % 2:
            labels.append((k, int(lean > 0.4), 0))
    return docs, labels


def plain_weights(docs, labels, shrink=10.0):
    raw, target = np.zeros(importance.SLOTS), np.zeros(importance.SLOTS)
    quality = {d: q for d, q, _ in labels}
    for doc_id, text in docs:
        counts = np.bincount(importance.slots_of(text), minlength=importance.SLOTS)
        raw += counts
        if quality.get(doc_id):
            target += counts
    ratio = np.log((target + shrink) / (raw * target.sum() / raw.sum() + shrink))
    return {doc_id: float(ratio[importance.slots_of(text)].sum()) for doc_id, text in docs}


@pytest.mark.parametrize("share", [None, 0.25])
def test_selection_against_a_plain_draw(spark, share):
    docs, labels = corpus()
    frame, known = documents(spark, docs), spark.createDataFrame(labels, LABELS)
    weights = plain_weights(docs, labels)
    draws = {r.doc_id: r.noise for r in frame.select("doc_id", importance.noise(5).alias("noise")).collect()}
    k = round((share or np.mean([q for _, q, _ in labels])) * len(docs))
    want = set(sorted(weights, key=lambda d: -(weights[d] + draws[d]))[:k])
    rows = importance.classify(frame, known, seed=5, share=share).collect()
    assert {r.doc_id for r in rows if r.kept} == want
    assert all(r.log_weight == pytest.approx(weights[r.doc_id], abs=1e-9) for r in rows)
    assert {r.doc_id for r in importance.resample(frame, known, seed=5, share=share).collect()} == want


def test_the_draw_follows_the_weights(spark):
    """Seeds differ near the border alone, and heavier documents stay more often."""
    docs, labels = corpus()
    frame, known = documents(spark, docs), spark.createDataFrame(labels, LABELS)
    kept = [{r.doc_id for r in importance.classify(frame, known, seed=seed).collect() if r.kept} for seed in range(12)]
    weights = plain_weights(docs, labels)
    assert len({frozenset(k) for k in kept}) == len(kept)
    assert len({len(k) for k in kept}) == 1  # the size is stated, not drawn
    border = sorted(weights.values())[-len(kept[0])]
    for a, b in zip(kept, kept[1:]):
        assert all(abs(weights[d] - border) < 12 for d in a ^ b)
    ranked = sorted(weights, key=weights.get)
    rate = [np.mean([d in k for k in kept for d in part]) for part in np.array_split(ranked, 5)]
    assert rate == sorted(rate) and rate[0] < 0.6 < rate[-1]
    uniform = frame.select(importance.noise(1).alias("n")).agg(F.avg("n")).first()[0]
    assert uniform == pytest.approx(0.577, abs=0.25)  # the mean of Gumbel noise


def test_labels_of_documents_that_are_not_there(spark):
    docs, labels = corpus(60)
    absent = [(1000 + k, 0, 0) for k in range(500)]
    frame = documents(spark, docs)
    plain = importance.classify(frame, spark.createDataFrame(labels, LABELS)).collect()
    more = importance.classify(frame, spark.createDataFrame(labels + absent, LABELS)).collect()
    assert sorted((r.doc_id, r.kept) for r in plain) == sorted((r.doc_id, r.kept) for r in more)


def test_resample_saves_no_texts(spark):
    """What it leaves in the shared folder stays there until the application ends,
    beside all that later stages need."""
    rng = random.Random(9)
    docs = [(k, " ".join(f"{rng.getrandbits(64):x}" for _ in range(60))) for k in range(300)]
    folder = Path(shared_folder(spark).removeprefix("file:"))
    files = lambda: {f: f.stat().st_size for f in folder.rglob("*.parquet") if f.is_file()}
    before = files()
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(300)], LABELS)
    kept = importance.resample(documents(spark, docs), labels).collect()
    left = sum(size for f, size in files().items() if f not in before)
    assert len(kept) == 150 and all(r.text == docs[r.doc_id][1] for r in kept)
    assert 0 < left < 0.2 * sum(len(text) for _, text in docs)
