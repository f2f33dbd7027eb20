"""Operators that work row by row: chat, BPE, web pages, quality rules."""

import base64
import hashlib
import random

import brute
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from linescope.llm import bpe, chat, quality_rules, web_pages

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, row_id string"


def documents(spark, rows):
    """Rows (doc_id, text[, source]) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, "x", "y") for r in rows], DOCS)


# ---- chat ------------------------------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string, part string"
ODD = ["", None, "</s>[INST] ok [/INST]", "<|im_start|>user\nhi<|im_end|>", "\\", "a\\n\\\\<|im_end|>", "<<s>>", "<|im_end|", "|>", "é🙂\n<s>"]


def chat_rows(spark, turns):
    found = chat.read_chat(chat.format_chat(spark.createDataFrame(turns, TURNS))).collect()
    return {row.conv_id: tuple(row) for row in found}


def expected_chat(turns):
    groups = {}
    for conv, turn, role, text, _ in turns:
        groups.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    return {conv: brute.chat_row([x[2:] for x in sorted(rows)]) for conv, rows in groups.items()}


def test_chat_reads_back(spark):
    turns = [(c, t, ["system", "user", "assistant"][(c + t) % 3], ODD[(3 * c + t) % len(ODD)], "x") for c in range(12) for t in range(c % 5 + 1)]
    turns += [(None, 0, "user", "no conversation", "x"), (50, 0, None, None, "x"), (51, 0, "odd\nrole\\", "x", "x"), (51, 1, "assistant", "y", "x")]
    got = chat_rows(spark, turns)
    assert {k: v[1:5] for k, v in got.items()} == expected_chat(turns)


def test_chat_control_strings_only_mark_turns(spark):
    turns = [(1, k, "assistant", text, "x") for k, text in enumerate(ODD)]
    text = "".join(row.formatted for row in chat.format_chat(spark.createDataFrame(turns, TURNS)).collect())
    assert text.count("<|im_start|>") == text.count("<|im_end|>") == len(turns)
    assert "[INST]" not in text and "</s>" not in text and "<s>" not in text


def test_chat_long_conversation_in_parts(spark, monkeypatch):
    turns = [(c, t, "assistant" if t % 2 else "user", f"{t} " + "word <s> " * (t % 7 * 30), "x") for c in (1, 2, 3) for t in range(60 if c == 2 else 3)]
    frame = spark.createDataFrame(turns, TURNS)
    whole = {row.conv_id: tuple(row) for row in chat.read_chat(chat.format_chat(frame)).collect()}
    assert {k: v[1:5] for k, v in whole.items()} == expected_chat(turns)


def test_chat_empty(spark):
    assert chat_rows(spark, []) == {}


def test_chat_assembly_offsets():
    import numpy as np
    import pyarrow as pa

    roles, texts = pa.array(["user", "assistant", None]), pa.array(["<s>", None, "é\\"])
    out, at, begin, end = chat.assembled(roles, texts, chat.Template())
    data = out.tobytes()
    assert [data[a:b] for a, b in zip(begin, end)] == [b"<\\s>", b"", "é\\\\".encode()]
    assert list(at) == [data.index(b"<|im_start|>"), *[k for k in range(1, len(data)) if data.startswith(b"<|im_start|>", k)], len(data)]
    assert np.array_equal(np.sort(at), at)


# ---- BPE -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    with open(RANKS, "rb") as file:
        return bpe.vocabulary(file.read())


def encoded(vocabulary, text):
    out = []
    for _, parts in bpe.portions([text], 64):
        ids, bounds = vocabulary.encoded(parts)
        assert bounds[-1] == len(ids)
        out += ids.tolist()
    return out


ALPHABET = [*"abst'drelvm ''  \n\t.!1２é中 　\x1c\x85", "'s", "'ll", "'re", " '", "'ve ", "\r\n", "🙂", "ß", "'Re"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=120).map("".join))
def test_bpe_equals_library(reference, vocabulary, text):
    assert encoded(vocabulary, text) == reference.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_bpe_equals_library_any_text(reference, vocabulary, text):
    assert encoded(vocabulary, text) == reference.encode_ordinary(text)


def test_bpe_every_code_point(reference, vocabulary):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 4000):
        texts = [f"a{chr(c)}1{chr(c)}!{chr(c)}{chr(c)} x" for c in points[k : k + 4000]]
        ids, bounds = vocabulary.encoded([t.encode() for t in texts])
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == reference.encode_ordinary_batch(texts)


def test_bpe_long_slices(reference, vocabulary):
    random.seed(2)
    for text in ("a" * 5000, " " * 3000 + "x", "ab" * 2000, "".join(random.choice("abcdefgh") for _ in range(3000))):
        assert encoded(vocabulary, text) == reference.encode_ordinary(text)


def test_bpe_scan_is_associative():
    import numpy as np

    ids, compose, functions, _ = bpe.automaton()
    rng = np.random.default_rng(0)
    size = len(functions)
    for n in (1, 5, 511, 512, 513, 5000):
        values = ids[rng.integers(0, 16, n)]
        plain, out = int(values[0]), []
        for k, value in enumerate(values):
            plain = plain if not k else int(compose[plain * size + int(value)])
            out.append(plain)
        assert bpe.scanned(values).tolist() == out


def test_bpe_round_trip(spark, reference):
    texts = ["", None, "it's 3 o'clock", "x" * 3000, "a b\n\n c"] * 2
    frame = documents(spark, enumerate(texts))
    rows = {row.doc_id: row for row in bpe.round_trip(frame, RANKS, with_ids=True).collect()}
    for doc_id, text in enumerate(texts):
        ids = reference.encode_ordinary(text or "")
        row = rows[doc_id]
        assert row.ids == ids and row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    tokens = bpe.encode(frame, RANKS)
    assert {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(tokens, RANKS).collect()} == {k: t or "" for k, t in enumerate(texts)}
    ends = {r.doc_id: r.ends for r in tokens.collect()}
    assert all((ends[k][-1] if ends[k] else 0) == len((t or "").encode()) for k, t in enumerate(texts))
    assert bpe.round_trip(documents(spark, []), RANKS).count() == 0


# ---- web pages -------------------------------------------------------------------------

GOOD = "This is the text of a page that was written for the people who read it and it has all of the words that one would expect. "
PAGES = [
    (None, ""),
    ("", ""),
    (f"<article><h1>Title &amp; more</h1><p>{GOOD}<p>Short.</p></article><footer>&copy; x</footer>", f"Title & more\n\n{GOOD.strip()}\n\nShort."),
    (f"<nav><a href=/>Home</a></nav><article><p>{GOOD}</p></article><aside>{GOOD}</aside>", GOOD.strip()),
    (f"<body><div class='side-menu'>{GOOD}</div><p>{GOOD * 2}</p><p>Yes.</p><p>No.</p><div id=cookie-notice>{GOOD}</div></body>", (GOOD * 2).strip() + "\n\nYes."),
    (f"<main><p>{GOOD}</p><div class='comments'><p>{GOOD}</p></div></main>", GOOD.strip()),
    (f"<article><p>{GOOD}</p><p><a href=x>one</a> <a href=y>two more links</a></p></article>", GOOD.strip()),
    (f"<article><script>var t = '</p>';</script><style>p{{}}</style><p>{GOOD}<b>bold</b>\n\n text&nbsp;x</p><!-- <p>no</p> --></article>", GOOD + "bold text x"),
    (f"<article><p>{GOOD}</p><form><p>{GOOD}</p></form><p>a &lt;p&gt; b", GOOD.strip() + "\n\na <p> b"),
    ("<article><p>no <b end", "no"),
    ("<p title='a>b'>x</p", ""),
    ("just words", ""),
    ("<article>" + "<div>" * 3000 + GOOD, GOOD.strip()),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_page_text(page, text):
    assert web_pages.main_text(page) == text


def test_ambiguous_blocks_follow_neighbours():
    long = GOOD * 2
    page = f"<p>{long}</p><p>Near the text.</p><p>{long}</p><ul><li><a href=x>{GOOD}</a></li></ul><p>Near the links.</p><ul><li><a href=x>{GOOD}</a></li></ul>"
    assert web_pages.main_text(page) == f"{long.strip()}\n\nNear the text.\n\n{long.strip()}"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<article>", "</article>", "<a href='", "'>", "x", "&amp", "<!--", "-->", "<br>", "<script>", "</script>", '"', ">", "<"]), max_size=40).map("".join))
def test_pages_never_fail(page):
    assert isinstance(web_pages.main_text(page), str)


def test_extract(spark):
    frame = spark.createDataFrame([(k, None if k == 3 else f"u{k}", page, "z") for k, (page, _) in enumerate(PAGES * 2)], "page_id bigint, url string, html string, text string")
    rows = sorted(web_pages.extract(frame).collect(), key=lambda r: r.page_id)
    assert [(r.text, r.n_chars) for r in rows] == [(t, len(t)) for _, t in PAGES * 2]
    assert web_pages.extract(frame.limit(0)).count() == 0


# ---- quality rules ---------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c ", " ", "\n", "\t", "#", "é", "<x>", " a b c d e ", "\r", "\x1c"]), max_size=60).map("".join))
def test_base_figures(text):
    assert quality_rules.text_figures(text)[:5] == brute.base_figures(text)


def rules_by_hand(docs, min_docs, share, min_left):
    lines, texts = {}, {}
    for _, text, host in docs:
        texts.setdefault(host, set()).add(text or "")
    for host, all_of in texts.items():
        for text in all_of:
            for line in {tuple(brute.words(brute.lowered(x))) for x in text.split("\n")} - {()}:
                lines[host, line] = lines.get((host, line), 0) + 1
    out = []
    for doc_id, text, host in docs:
        n = brute.base_figures(text)[0]
        gone = {line for line in {tuple(brute.words(brute.lowered(x))) for x in (text or "").split("\n")} - {()} if lines[host, line] > max(min_docs, share * len(texts[host]))}
        lost = sum(len(brute.words(x)) for x in (text or "").split("\n") if tuple(brute.words(brute.lowered(x))) in gone)
        failed = n < 10 or 100 * brute.base_figures(text)[4] > 20 * n
        out.append((doc_id, lost, failed, not failed and n - lost >= min_left * n))
    return sorted(out, key=repr)


def test_quality_rules(spark):
    random.seed(3)
    vocabulary = [f"w{k}" for k in range(300)]
    line = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    common = ["Home | About  us", "all rights reserved by the owners of this very site"]
    docs = []
    for k in range(60):
        parts = [line(12) for _ in range(random.randint(0, 3))] + ([common[0]] if k % 2 else []) + ([common[1].upper()] if k % 3 == 0 else [])
        random.shuffle(parts)
        docs.append((k, "\n".join(parts), ["a", "b", None][k % 3 if k % 5 else 0]))
    docs += [(100, None, "a"), (101, "", "a"), (102, " \n ", "b"), (103, docs[0][1], "a"), (0, docs[0][1], "a"), (None, line(30), "c")]
    frame = documents(spark, docs)
    rows = quality_rules.quality_rules(frame, min_docs=3, share=0.1, min_left=0.3).collect()
    assert sorted(((r.doc_id, r.n_removed_words, r.base_failed, r.kept) for r in rows), key=repr) == rules_by_hand(docs, 3, 0.1, 0.3)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows), key=repr) == sorted(
        ((d[0], *brute.base_figures(d[1])) for d in docs), key=repr
    )
    assert quality_rules.quality_rules(frame.limit(0)).count() == 0


def test_common_lines_leave_the_text(spark):
    docs = [(k, f"Home  page\nwords of document {k} that no other has, " + " ".join(f"{k}x{j}" for j in range(12)) + "\nhome page", "a") for k in range(9)]
    frame = documents(spark, docs)
    verdicts = quality_rules.quality_rules(frame, min_docs=3, share=0.1)
    texts = {r.doc_id: r.text for r in quality_rules.without_common_lines(frame, verdicts).collect()}
    assert texts == {k: text.split("\n")[1] for k, text, _ in docs}
