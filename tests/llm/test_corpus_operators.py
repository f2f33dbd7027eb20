"""Operators over the whole corpus, against brute force."""

import collections
import math
import random

import brute
import numpy as np
import pytest
from test_row_operators import documents

from linescope.llm import hamming, importance, licenses, line_dedup, mixing, ngram_join
from linescope.llm.components import components


def prose(rng, n, size=400):
    return " ".join(f"w{int(rng.random() ** 2 * size)}" for _ in range(n))


def corpus(seed=5):
    """Copies, near copies with more or fewer edits, shared passages, odd rows."""
    rng = random.Random(seed)
    docs = []
    base = [prose(rng, rng.choice([3, 5, 6, 20, 60, 120])) for _ in range(25)]
    passage = prose(rng, 30)
    for text in base:
        docs.append(text)
        for _ in range(rng.choice([0, 0, 1, 4])):
            parts = text.split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                parts[rng.randrange(len(parts))] = f"x{rng.randrange(9)}"
            docs.append("  ".join(parts).upper() if rng.random() < 0.2 else " ".join(parts))
    docs += [passage + " " + prose(rng, rng.choice([0, 2, 4, 8])) for _ in range(12)]
    docs += ["", None, " \n\t ", "one", "ONE ", "a b c d", "a b c d e", "a b c d e"]
    order = list(range(len(docs)))
    rng.shuffle(order)
    return [(order[k], text) for k, text in enumerate(docs)]


# ---- n-gram join -----------------------------------------------------------------------


@pytest.mark.parametrize("seed", [5, 6])
def test_ngram_components(spark, seed):
    docs = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(documents(spark, docs)).collect()}
    assert got == {doc_id: want for (doc_id, _), want in zip(docs, brute.components(docs))}


def test_ngram_chain_links_through_documents(spark):
    """Each text is close to the next only, so the hub alone does not join them."""
    tokens = [f"t{k}" for k in range(300)]
    docs = [(k, " ".join(tokens[6 * k : 6 * k + 60])) for k in range(30)]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(documents(spark, docs)).collect()}
    assert got == {doc_id: want[1] for (doc_id, _), want in zip(docs, brute.components(docs))}
    assert set(got.values()) == {0}


def test_ngram_repeated_and_null_ids(spark):
    docs = [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (1, ""), (None, None)]
    rows = sorted(map(tuple, ngram_join.ngram_components(documents(spark, docs)).collect()), key=repr)
    assert rows == sorted([(3, 2, 3), (3, 2, 3), (None, 2, 3), (1, 0, 1), (None, 0, None)], key=repr)
    assert ngram_join.ngram_components(documents(spark, [])).count() == 0


def test_first_of_each_group(spark):
    docs = corpus()
    kept = {r.doc_id for r in ngram_join.first_of_each_group(documents(spark, docs)).collect()}
    assert kept == {component for _, component in brute.components(docs)}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(500, 560)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    group = {}
    find = lambda x: x if group.setdefault(x, x) == x else find(group[x])
    for a, b in pairs:
        a, b = find(a), find(b)
        group[max(a, b)] = min(a, b)
    assert got == {x: find(x) for a, b in pairs if a != b for x in (a, b)}


# ---- line dedup ------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [5, 6])
def test_removed_lines(spark, seed):
    rng = random.Random(seed)
    lines = [text for _, text in corpus(seed) if text]
    docs = [(k, "\n".join(rng.choice(lines) for _ in range(rng.choice([0, 1, 3, 6])))) for k in range(60)] + [(90, None), (91, "\n\n")]
    rows = {r.doc_id: r for r in line_dedup.verdicts(documents(spark, docs)).collect()}
    want = brute.removed_lines(docs)
    assert {k: r.removed_lines for k, r in rows.items()} == want
    assert all(r.n_removed == len(want[k]) for k, r in rows.items())
    left = {r.doc_id: r for r in line_dedup.dedup(documents(spark, docs)).collect()}
    for doc_id, text in docs:
        kept = "\n".join(x for k, x in enumerate((text or "").split("\n")) if k not in want[doc_id])
        if want[doc_id] and not brute.words(kept):
            assert doc_id not in left
        else:
            assert (left[doc_id].text or "") == kept
            assert left[doc_id].n_chars == (len(kept) if want[doc_id] else 1)


def test_lines_of_repeated_rows(spark):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "x")]
    rows = sorted(((r.doc_id, r.removed_lines) for r in line_dedup.verdicts(documents(spark, docs)).collect()), key=repr)
    assert rows == sorted([(1, [0]), (1, [0]), (None, []), (2, [])], key=repr)
    assert line_dedup.verdicts(documents(spark, [])).count() == 0


# ---- importance resampling -------------------------------------------------------------


def labelled_corpus(n=600):
    rng = random.Random(7)
    docs, labels = [], []
    for k in range(n):
        bad = rng.random() < 0.2
        text = prose(rng, rng.randrange(20, 200))
        docs.append((k, " ".join(w + "$%#"[rng.randrange(3)] for w in text.split()) if bad else text))
        labels.append((k, 0 if bad else 1, 0))
    return docs, labels


def test_classifier_on_held_out_labels(spark):
    docs, labels = labelled_corpus()
    known = spark.createDataFrame([row for row in labels if row[0] % 2], "doc_id bigint, quality int, toxic int")
    odd = [(10_000, ""), (10_001, None), (10_002, " \n")]
    rows = {r.doc_id: r for r in importance.classify(documents(spark, docs + odd), known).collect()}
    right = sum(rows[k].kept == bool(quality) for k, quality, _ in labels if k % 2 == 0)
    assert right >= 0.97 * 300
    assert all(not rows[k].kept and rows[k].log_weight is None for k, _ in odd)
    kept = {r.doc_id for r in importance.resample(documents(spark, docs + odd), known).collect()}
    assert kept == {k for k, r in rows.items() if r.kept}


def test_kth_largest(spark):
    values = [random.Random(3).gauss(0, 1) for _ in range(500)] + [2.5] * 20
    frame = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 10, 25, 300, 520):
        assert importance.kth_largest(frame, k) == sorted(values, reverse=True)[k - 1]


def test_classifier_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = documents(spark, [(1, "some words"), (2, None), (1, "some words")])
    assert sorted((r.doc_id, r.kept) for r in importance.classify(docs, labels).collect()) == [(1, True), (1, True), (2, False)]
    some = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, 0)], labels.schema)
    assert importance.classify(documents(spark, []), some).count() == 0


def test_weights_are_log_ratios():
    ratio = np.arange(importance.SLOTS, dtype=np.float32)
    slots = importance.slots_of("ab cd!")
    assert len(slots) == 5  # ab, cd, ! and two pairs
    assert importance.log_weight(slots, ratio) == pytest.approx(float(ratio[slots].sum()))
    assert importance.log_weight(importance.slots_of("  "), ratio) is None


# ---- mixing ----------------------------------------------------------------------------

MIXED = "doc_id bigint, source string, lang string, topic string, n_tokens bigint, factor double"


def mixing_rows():
    rng = random.Random(9)
    return [(k, rng.choice(["a", "a", "a", "b", None]), rng.choice("xy"), rng.choice("pqr"), rng.randrange(0, 500), 0.0) for k in range(800)]


def raked(rows, targets, rounds):
    cells = collections.Counter()
    for _, s, l, t, n, _ in rows:
        cells[s, l, t] += n
    weight = {c: float(n) for c, n in cells.items() if n}
    for _ in range(rounds):
        for place, target in enumerate(targets):
            sums, present = collections.Counter(), {c[place] for c in weight}
            total = sum(target[k] for k in present)
            for c, w in weight.items():
                sums[c[place]] += w
            weight = {c: w * target[c[place]] / total / sums[c[place]] for c, w in weight.items()}
    ratio = {c: w / cells[c] for c, w in weight.items()}
    return {c: r / max(ratio.values()) for c, r in ratio.items()}, weight


def test_raking_reaches_the_targets(spark):
    rows = mixing_rows()
    targets = [{"a": 0.2, "b": 0.5, None: 0.3}, {"x": 0.7, "y": 0.3}, {"p": 1, "q": 1, "r": 2}]
    frames = {m: spark.createDataFrame([(k, float(v)) for k, v in t.items()], "key string, share double") for m, t in zip(mixing.MARGINS, targets)}
    want, weight = raked(rows, targets, 8)
    got = mixing.mix(spark.createDataFrame(rows, MIXED), targets=frames, rounds=8).collect()
    for r in got:
        assert r.probability == pytest.approx(want.get((r.source, r.lang, r.topic), 0.0), abs=1e-9)
        assert 0 <= r.probability <= 1
    share = sum(w for c, w in weight.items() if c[0] == "b") / sum(weight.values())
    assert share == pytest.approx(0.5, abs=1e-3)
    kept = sum(r.kept for r in got)
    assert abs(kept - sum(r.probability for r in got)) < 4 * math.sqrt(len(got)) / 2


def test_mixing_odd_tables(spark):
    assert mixing.mix(spark.createDataFrame([], MIXED)).count() == 0
    rows = [(1, None, None, None, 0, 0.0), (1, None, None, None, 0, 0.0), (None, "a", "x", "p", 5, 0.0)]
    got = mixing.mix(spark.createDataFrame(rows, MIXED)).collect()
    assert sorted((r.n_tokens, r.probability) for r in got) == [(0, 0.0), (0, 0.0), (5, 1.0)]
    assert spark.createDataFrame([("a b\n c",), (None,), (" ",)], "text string").select(mixing.n_tokens()).collect() == [(3,), (0,), (0,)]


# ---- top-k search ----------------------------------------------------------------------


def nearest(rows, queries, k):
    out = []
    for query_id, code in queries:
        if code is None:
            continue
        near = sorted((bin((code ^ other) & (2**64 - 1)).count("1"), i) for i, other in rows if other is not None)[:k]
        out += [(query_id, place + 1, i, d) for place, (d, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("segments", [4, 8])
def test_top_k(spark, segments):
    rng = random.Random(11)
    centres = [rng.getrandbits(64) for _ in range(6)]
    code = lambda: (rng.choice(centres) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(8)))) % 2**64
    rows = [(k, code() - 2**63) for k in range(300)] + [(400 + k, 5) for k in range(30)] + [(500, None), (3, 5)]
    queries = [row for row in rows if row[0] % 20 == 0]
    schema = "id bigint, code bigint"
    got = hamming.top_k(spark.createDataFrame(rows, schema), spark.createDataFrame(queries, schema), k=7, segments=segments).collect()
    assert sorted(map(tuple, got)) == nearest(rows, queries, 7)


def test_top_k_small_tables(spark):
    schema = "id bigint, code bigint"
    rows = spark.createDataFrame([(1, 0), (2, -1), (20, 1)], schema)
    got = sorted(map(tuple, hamming.top_k(rows, rows.filter("id = 20"), k=10).collect()))
    assert got == [(20, 1, 20, 0), (20, 2, 1, 1), (20, 3, 2, 63)]
    assert hamming.top_k(rows.limit(0), rows.limit(0)).count() == 0


def test_sign_code(spark):
    vectors = [[1.0, -1.0, 0.5], [0.0], [], None, [float(k % 3 - 1) for k in range(70)], [None, 2.0]]
    frame = spark.createDataFrame([(v,) for v in vectors], "v array<float>")
    want = [None if v is None else sum(1 << k for k, x in enumerate(v[:64]) if x is not None and x > 0) for v in vectors]
    got = [r[0] for r in frame.select(hamming.sign_code("v")).collect()]
    assert [None if g is None else g % 2**64 for g in got] == want


# ---- licences --------------------------------------------------------------------------


def test_license_scan(spark):
    files = [
        (1, "a/LICENSE", "Some words.\nReleased under the MIT License."),
        (2, "a/b/x.txt", "nothing here"),
        (3, "a/b/c/LICENSE.md", "Licensed under the Apache License, Version 2.0."),
        (4, "a/b/c/d/y.txt", None),
        (5, "a/b/z.txt", "First line\nThis work is licensed under the GNU General Public License, version 3."),
        (6, "e/f.txt", "You need a license to drive a car in most of the countries of this world."),
        (7, None, "All rights reserved."),
        (8, "LICENSE2/g.txt", ""),
        (9, "a/bb/h.txt", "x"),
        (2, "a/b/x.txt", "nothing here"),
    ]
    frame = spark.createDataFrame([(*f, "clash") for f in files], "doc_id bigint, path string, text string, license string")
    got = sorted(((r.doc_id, r.license, r.source) for r in licenses.scan(frame).collect()), key=repr)
    want = [
        (1, "MIT", "own"), (2, "MIT", "inherited"), (2, "MIT", "inherited"), (3, "Apache-2.0", "own"), (4, "Apache-2.0", "inherited"),
        (5, "GPL-3.0", "own"), (6, None, "none"), (7, "All-rights-reserved", "own"), (8, None, "none"), (9, "MIT", "inherited"),
    ]
    assert got == sorted(want, key=repr)
    assert licenses.scan(frame.limit(0)).count() == 0


def test_root_license_is_inherited(spark):
    files = [(1, "LICENSE", "Licensed under CC BY-NC 4.0."), (2, "x.txt", "y"), (3, "d/e/x.txt", "y")]
    frame = spark.createDataFrame(files, "doc_id bigint, path string, text string")
    assert {r.doc_id: r.license for r in licenses.scan(frame).collect()} == dict.fromkeys((1, 2, 3), "CC-BY-NC-4.0")


def test_every_template_finds_its_licence(spark):
    files = [(k, f"f{k}", f"prose before it.\n{text}.") for k, (_, text) in enumerate(licenses.TEMPLATES)]
    frame = spark.createDataFrame(files, "doc_id bigint, path string, text string")
    assert {r.doc_id: r.license for r in licenses.scan(frame).collect()} == {k: name for k, (name, _) in enumerate(licenses.TEMPLATES)}
