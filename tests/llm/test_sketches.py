"""Pairs of near sets that a sketch tells apart."""

import random
from collections import Counter

import brute
import pytest

from linescope.llm import ngram_join

SCHEMA = "doc_id bigint, text string"


def test_near_sets_below_the_threshold_end_before_they_are_verified(spark, monkeypatch):
    rng = random.Random(1)
    sets = [[*range(60), *rng.sample(range(1000, 1200), 40)] for _ in range(120)]
    freq = Counter(gram for grams in sets for gram in grams)
    order = [sorted(grams, key=lambda gram: (freq[gram], gram)) for grams in sets]
    rows = [(k, len(grams), grams, [freq[gram] for gram in grams]) for k, grams in enumerate(order)]
    looked_at, whole = [], ngram_join.verified

    def counted(pairs, *rest):
        looked_at.append(pairs.count())
        return whole(pairs, *rest)

    monkeypatch.setattr(ngram_join, "verified", counted)
    found = ngram_join.links(spark.createDataFrame(rows, "node bigint, n int, grams array<bigint>, freqs array<int>"), 75, 3).collect()
    assert found == [] and not any(brute.similar(set(sets[a]), set(sets[b])) for a in range(120) for b in range(a))
    assert looked_at[1] <= 120


@pytest.mark.parametrize("words", [1, 16])
def test_sketches_lose_no_link(spark, monkeypatch, words):
    monkeypatch.setattr(ngram_join, "WORDS", words)
    rng = random.Random(words)
    docs = []
    for k in range(120):
        base = [f"b{k % 4}w{j}" for j in range(rng.choice([30, 60, 400]))]
        for place in rng.sample(range(len(base)), rng.choice([0, 1, 2, 3])):
            base[place] = f"y{rng.randrange(6)}"
        docs.append((k, " ".join(base)))
    got = ngram_join.ngram_components(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {k: w for (k, _), w in zip(docs, brute.components(docs))}
