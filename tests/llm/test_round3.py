"""Groups whose hub links only part, clashing columns, row marks, nested tags."""

import random
import time

import brute
import pytest
from pyspark.sql import functions as F
from test_row_operators import documents

from linescope.llm import importance, line_dedup, mixing, ngram_join, web_pages


def near_copies(n, seed=1, words=60, edits=(1, 2, 3)):
    """Copies of one text, each with edits of its own: some are too far from any
    one copy but near to others."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    docs = []
    for k in range(n):
        text = list(base)
        for _ in range(rng.choice(edits)):
            text[rng.randrange(words)] = f"x{rng.randrange(40)}"
        docs.append((k, " ".join(text)))
    return docs


def test_a_hub_that_links_only_part(spark):
    docs = near_copies(2000)
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(documents(spark, docs)).collect()}
    sets = [brute.shingles(text) for _, text in docs]
    by_gram, group = {}, list(range(len(docs)))

    def find(k):
        while group[k] != k:
            group[k] = group[group[k]]
            k = group[k]
        return k

    for k, grams in enumerate(sets):
        for gram in grams:
            by_gram.setdefault(gram, []).append(k)
    for a, grams in enumerate(sets):  # all pairs of one text's group
        for b in range(a):
            if find(a) != find(b) and brute.similar(sets[a], sets[b]):
                group[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {k: find(k) for k in range(len(docs))}


@pytest.mark.parametrize("fragments", [1, 3, 8])
def test_overlaps_do_not_depend_on_the_cuts(spark, fragments):
    docs = near_copies(120, 3, edits=(1, 2, 4, 6))
    want = brute.components(docs)
    got = ngram_join.ngram_components(documents(spark, docs), fragments=fragments).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {k: w for (k, _), w in zip(docs, want)}


def test_first_of_each_group_goes_by_rows(spark):
    one, two, three = "a b c d e f g", "h i j k l m n", "o p q r s t"
    rows = [(1, one), (2, one), (2, two), (None, three), (None, three), (None, None), (None, ""), (3, None), (4, two), (5, "z y"), (5, "z y")]
    kept = ngram_join.first_of_each_group(documents(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=repr) == sorted(
        [(1, one), (2, two), (None, three), (None, None), (None, ""), (3, None), (5, "z y")], key=repr
    )


CLASHING = [
    "log_weight", "LOG_WEIGHT", "log_weight_", "key", "factor", "source_key", "lang_key", "topic_key", "source_factor", "lang_factor", "topic_factor",
    "removed_lines", "removed_doc_id", "removed_mark", "_mark", "_removed", "mark", "own_id", "own_mark", "root", "node", "rows", "stays", "share", "tokens", "target", "held", "weight",
]


@pytest.mark.parametrize("stage", ["resample", "mix", "dedup", "first_of_each_group"])
def test_columns_with_clashing_names_stay(spark, stage):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(50)]
    texts = [" ".join(rng.choices(words, k=12)) + "\nshared line of seven words in all" for _ in range(30)]
    docs = documents(spark, list(enumerate([*texts, texts[0]])))
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(30)], "doc_id bigint, quality int, toxic int")
    topical = docs.withColumns({"topic": F.lit("t"), "n_tokens": F.lit(20).cast("bigint")})
    apply = {
        "resample": lambda d: importance.resample(d, labels),
        "mix": lambda d: mixing.mix(d, share=0.5),
        "dedup": lambda d: line_dedup.dedup(d, shortest=1),
        "first_of_each_group": ngram_join.first_of_each_group,
    }[stage]
    table = topical if stage == "mix" else docs
    names = [n for n in CLASHING if n != "LOG_WEIGHT"]
    extra = table.select("*", *(F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in names))
    want = apply(table)
    got = apply(extra)
    plain = [c for c in want.columns]
    assert sorted(map(tuple, got.select(plain).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    for row in got.select("doc_id", *names).collect():
        assert [row[n] for n in names] == [f"{n} {row.doc_id}" for n in names]


def test_nested_tags_take_linear_time():
    for page in (
        "<div>" * 90_000 + "</span>" * 80_000,
        "<span>" + "<article>" + "<div>" * 90_000 + "</span>" * 80_000,
        "<p>" * 150_000 + "</div>" * 100_000,
        "<div>" * 90_000 + "text" + "</div>" * 90_000,
    ):
        start = time.process_time()
        web_pages.main_text(page)
        assert time.process_time() - start < 2.0


def test_raking_ends_near_its_targets(spark):
    """After the eight rounds each margin is within a thousandth of its target."""
    rng = random.Random(8)
    sources = [("s0", 900), ("s1", 60), ("s2", 30), ("stray", 1)]
    rows = [
        (k, rng.choices([n for n, _ in sources], [w for _, w in sources])[0], rng.choice(["en", "en", "fr", None]), rng.choice(["note", "book"]), rng.randrange(1, 500))
        for k in range(2000)
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, topic string, n_tokens bigint")
    table = mixing.cells(docs)
    targets = {margin: mixing.tempered(table, margin, 0.7) for margin in mixing.MARGINS}
    errors = mixing.margin_errors(table, mixing.rake(table, targets), targets)
    assert set(errors) == set(mixing.MARGINS) and max(errors.values()) < 1e-3
    assert max(mixing.margin_errors(table, {m: t.select("key", F.lit(1.0).alias("factor")) for m, t in targets.items()}, targets).values()) > 0.01
