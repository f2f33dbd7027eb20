"""Cases of the second round of advice."""

import collections
import random

import brute
import pytest
from test_row_operators import documents

import corpus_pipeline
from linescope.llm import importance, line_dedup, mixing, quality_rules

# ---- mixing ----------------------------------------------------------------------------

MIXED = "doc_id bigint, source string, lang string, topic string, n_tokens bigint, factor double"


def test_a_stray_cell_does_not_shrink_the_mix(spark):
    rows = [(k, "a" if k % 4 else "b", "xy"[k % 2], "p", 100 + k % 50, 0.0) for k in range(2000)]
    rows.append((5000, "stray", "rare", "p", 3, 0.0))
    got = mixing.mix(spark.createDataFrame(rows, MIXED), share=0.5).collect()
    total = sum(r.n_tokens for r in got)
    assert sum(r.n_tokens * r.probability for r in got) == pytest.approx(0.5 * total, rel=1e-9)
    assert sum(r.n_tokens for r in got if r.kept) == pytest.approx(0.5 * total, rel=0.1)
    assert [r.kept for r in got if r.doc_id == 5000] == [True]
    assert all(0 < r.probability <= 1 for r in got)
    rates = {(r.source, r.lang): r.probability for r in got}
    assert rates["a", "x"] < 1 and rates["b", "x"] > rates["a", "x"]  # the larger source is kept less


def test_shares_that_cannot_be_met(spark):
    rows = [(1, "a", "x", "p", 5, 0.0), (2, "b", "x", "p", 50, 0.0), (3, None, None, None, 0, 0.0)]
    frame = spark.createDataFrame(rows, MIXED)
    everything = {r.doc_id: r.probability for r in mixing.mix(frame, share=1.0).collect()}
    assert everything[1] == everything[2] == 1.0
    only = {"source": spark.createDataFrame([("a", 1.0)], "key string, share double")}
    assert {r.doc_id: r.probability for r in mixing.mix(frame, share=0.5, targets=only).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}
    assert mixing.mix(frame.limit(0), share=0.5).count() == 0


def test_the_pipeline_mix_keeps_its_share(spark):
    docs = [(k, " ".join(["word"] * 40), "a" if k % 3 else "b") for k in range(1500)] + [(9000, "three short words", "stray")]
    kept = corpus_pipeline.mix_sources(spark, documents(spark, docs), "").collect()
    counts = collections.Counter(r.source for r in kept)
    assert counts["stray"] == 1
    assert sum(counts.values()) == pytest.approx(750, rel=0.1)


# ---- line dedup ------------------------------------------------------------------------


def all_removed_lines(docs):
    """brute.removed_lines, with lines of every length."""
    seen, out = [], {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        out[doc_id] = []
        for place, line in enumerate((text or "").split("\n")):
            mine = brute.shingles(line)
            if any(brute.similar(mine, other) for other in seen):
                out[doc_id].append(place)
            seen.append(mine)
    return out


def test_short_lines_take_part(spark):
    rng = random.Random(4)
    lines = ["Home | About", "home  |  ABOUT", "Wh the.", "}", "one two three four", "four three two one", "one two three four five"]
    lines += ["a a a a a", "a a a a", "a a a a a a", " ", "", "x", " ".join(f"w{k}" for k in range(20)), " ".join(f"w{k}" for k in range(1, 20))]
    docs = [(k, "\n".join(rng.choice(lines) for _ in range(rng.choice([1, 3, 6])))) for k in range(40)]
    docs += [(90, None), (91, "\n\n"), (92, "\n".join(["Erheed. Titionly."] * 181)), (93, "new\nerheed. titionly.")]
    rows = {r.doc_id: r.removed_lines for r in line_dedup.verdicts(documents(spark, docs), shortest=1).collect()}
    assert rows == all_removed_lines(docs)
    assert rows[92] == list(range(1, 181)) and rows[93] == [1]


def test_the_pipeline_removes_short_repeats(spark):
    docs = [(k, f"footer of four words\nthe text of number {k} alone {k} {k + 1}") for k in range(9)] + [(20, "Footer of  four words")]
    left = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, documents(spark, docs), "").collect()}
    assert left == {k: text if k == 0 else text.split("\n")[1] for k, text in docs[:9]}


# ---- quality rules ---------------------------------------------------------------------


def removed_words(spark, docs):
    rows = quality_rules.quality_rules(documents(spark, docs), share=0.0, per_document=True).collect()
    return sorted(((r.doc_id, r.n_removed_words) for r in rows), key=repr)


def test_the_limit_does_not_grow_with_the_host(spark):
    """11 of 400 documents share a footer, 10 another line."""
    own = lambda k: " ".join(f"{k}x{j}" for j in range(12))
    docs = [(k, own(k) + ("\nshared footer" if k < 11 else "\nless shared" if k < 21 else ""), "big") for k in range(400)]
    assert removed_words(spark, docs) == sorted(((k, 2 if k < 11 else 0) for k, _, _ in docs), key=repr)


def test_copies_count_as_documents(spark):
    """A text copied whole 11 times counts 11 times, rows of one id once, rows
    without an id each."""
    text = lambda name: " ".join(f"{name}{j}" for j in range(12))
    docs = [(k, text("copied"), "a") for k in range(11)] + [(50, text("same"), "a")] * 30 + [(None, text("nameless"), "a")] * 11
    docs += [(100 + k, text("ten"), "a") for k in range(10)] + [(200 + k, text("copied"), "b") for k in range(10)]
    want = {"copied": 12, "same": 0, "nameless": 12, "ten": 0}
    assert removed_words(spark, docs) == sorted(((i, want[t.split("0")[0]] if h == "a" else 0) for i, t, h in docs), key=repr)


# ---- importance resampling -------------------------------------------------------------


@pytest.mark.parametrize("qualities", [(1, 0), (0, 1), (1, 0, 0), (0, 0, 1), (0, 1, 0)])
def test_classifier_with_two_or_three_labels(spark, qualities):
    docs = [(k, " ".join(("good" if k % 2 else "b$d") + str(j % 7) for j in range(60))) for k in range(40)]
    rows = [(2 * k + quality, quality, 0) for k, quality in enumerate(qualities)]
    labels = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
    kept = {r.doc_id for r in importance.classify(documents(spark, docs), labels).collect() if r.kept}
    assert kept and len(kept) < len(docs)


def test_classifier_whose_good_documents_are_absent(spark):
    labels = spark.createDataFrame([(900, 1, 0), (901, 1, 0), (1, 0, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    rows = importance.classify(documents(spark, [(k, f"some words {k}") for k in range(9)]), labels).collect()
    assert all(r.kept for r in rows)
