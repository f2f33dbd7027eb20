"""The Merkle manifest against a tree built level by level."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from linescope.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row, extra=0):
    doc_id, text, lang, source, n_chars = row
    n_chars = None if n_chars is None else n_chars + extra
    values = (doc_id, source, lang, n_chars, text)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """Root, and of each leaf its (siblings on the left, on the right) by level."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, place in enumerate(at):
            run = nodes[place // 2 * 2 : place // 2 * 2 + 2]
            paths[leaf].append((run[: place % 2], run[place % 2 + 1 :]))
        at = [place // 2 for place in at]
        nodes = [h("".join(nodes[k : k + 2])) for k in range(0, len(nodes), 2)]
    return nodes[0], paths


def brute_manifest(rows):
    first = lambda v: (v is not None, v)
    langs = sorted({row[2] for row in rows}, key=lambda v: (v is not None, (v or "").encode()))
    groups = []
    for lang in langs:
        mine = sorted((row for row in rows if row[2] == lang), key=lambda row: (first(row[0]), brute_leaf(row)))
        groups.append((mine, *climb([brute_leaf(row) for row in mine])))
    root, upper = climb([g[1] for g in groups])
    out = []
    for (mine, subroot, paths), above in zip(groups, upper):
        for row, path in zip(mine, paths):
            steps = path + above
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            value = brute_leaf(row, 1 if hit else 0)
            for left, right in steps:
                value = h("".join([*left, value, *right]))
            proof = h("".join(x for left, right in steps for x in left + right))
            out.append((row[0], brute_leaf(row), subroot, root, proof, value, value == root))
    return out


def made(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, merkle.manifest(merkle.document_leaves(docs)).collect()), key=repr)


def corpus(sizes, seed=3):
    rng = random.Random(seed)
    rows, doc_id = [], 0
    for lang, size in sizes.items():
        for _ in range(size):
            doc_id += rng.choice([1, 1, 3])
            rows.append((doc_id, rng.choice(["", "a b", "é" * 30, None, "x" * 500]), lang, rng.choice(["s", None]), rng.choice([7, None, 2**63 - 1])))
    rng.shuffle(rows)
    return rows


@pytest.fixture
def small_blocks(monkeypatch):
    """Sweeps run in Python workers, which read the block height from the module
    as shipped; levels and steps are therefore checked in this process."""
    monkeypatch.setattr(merkle, "BITS", 2)
    monkeypatch.setattr(merkle, "HEIGHT", 2)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 5, None: 2}, {"de": 3, "en": 2500, "é": 1, "z": 1024, "Z": 1025}])
def test_manifest(spark, sizes):
    rows = corpus(sizes)
    assert made(spark, rows) == sorted(brute_manifest(rows), key=repr)


def test_many_groups(spark):
    """More groups than a block holds: the upper tree has two rounds."""
    rows = corpus({f"l{k}": 1 + k % 2 for k in range(1100)})
    assert made(spark, rows) == sorted(brute_manifest(rows), key=repr)


def test_odd_rows(spark):
    """Null fields, repeated and null ids, equal rows, null and empty groups."""
    rows = [(None, "a", "en", "s", 1), (None, "a", "en", "s", 1), (4, "b", "en", "s", None), (4, "c", "en", "s", 2), (4, "c", "en", "s", 2)]
    rows += [(9, None, None, None, None), (1, "", "", "", 0), (0, "w " * 300_000, "en", "s", 600_000)]
    rows += [(k, "t", None, "s", 3) for k in range(20, 60)]
    got = made(spark, rows)
    assert got == sorted(brute_manifest(rows), key=repr)
    hit = {r[0] for r in rows if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0}
    assert {r[0] for r in got if not r[6]} == hit


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    out = merkle.manifest(merkle.document_leaves(empty))
    assert out.columns == ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and out.collect() == []
    rows = corpus({"en": 9, "fr": 4})
    plain = spark.createDataFrame(rows, SCHEMA)
    names = ["pos", "tree", "tie", "part", "rank", "run", "block", "digest", "name", "suffix", "subroot", "root", "id", "group", "leaf", "altered", "before", "first", "last"]
    odd = plain.select("*", *(F.lit("clash").alias(name) for name in names))
    assert sorted(map(tuple, merkle.manifest(merkle.document_leaves(odd)).collect()), key=repr) == sorted(brute_manifest(rows), key=repr)


@pytest.mark.parametrize("size", range(1, 12))
def test_sweeps(small_blocks, size):
    """Blocks of four nodes: rounds upwards and suffixes downwards agree with the
    plain tree."""
    rounds = [[h(str(k)) for k in range(size)]]
    whole = lambda nodes, block: block == 0 and len(nodes) < 4
    blocks = lambda nodes: [nodes[k : k + 4] for k in range(0, len(nodes), 4)]
    while len(rounds[-1]) > 1:
        rounds.append([merkle.forward(b, whole(b, k))[-1][0] for k, b in enumerate(blocks(rounds[-1]))])
    suffixes = [""]
    for nodes in reversed(rounds[:-1]):
        suffixes = [s for k, b in enumerate(blocks(nodes)) for s in merkle.backward(merkle.forward(b, whole(b, k)), suffixes[k])]
    root, paths = climb(rounds[0])
    assert rounds[-1] == [root]
    for value, steps, path in zip(rounds[0], suffixes, paths):
        assert merkle.fold(value, steps) == root
        assert merkle.siblings(steps) == "".join(x for left, right in path for x in left + right)


def test_proofs_fold(spark):
    rows = corpus({"en": 40, "fr": 3})
    found = merkle.manifest(merkle.document_leaves(spark.createDataFrame(rows, SCHEMA)), with_proof=True).collect()
    for row in found:
        assert merkle.fold(row.leaf, row.proof) == row.root and h(merkle.siblings(row.proof)) == row.proof_sha256
