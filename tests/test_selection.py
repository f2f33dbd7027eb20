"""Decoding, detection, selection rules, globs, ignore files, settings."""

import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from linescope.functions import paths as P
from linescope.operators import decode, ignore
from linescope.operators.detect import detect_language
from linescope.operators.warnings import discovery_warnings
from linescope.plans.analyze import analyze_files
from linescope.settings import PRESETS, Settings, parse_settings
from linescope.sources.files import (
    dedupe_paths,
    from_table,
    list_directory,
    scan_directory,
    scan_files,
    scan_single_file,
    union_roots,
    walk_errors,
)

BOM = b"\xef\xbb\xbf"


def files(spark, entries, root="/w"):
    rows = [(path, bytes(content) if content is not None else None) for path, content in entries]
    return from_table(spark.createDataFrame(rows, "path string, content binary"), root)


def analyze(spark, entries, settings=None, root="/w"):
    return {r.relative_path: r for r in analyze_files(files(spark, entries, root), settings).collect()}


def test_decoding(spark):
    cases = [
        (b"Hello\x96W", "windows-1252", "Hello\u2013W", ["decoded using windows-1252 fallback"]),
        (b"\x81\x8d\x80", "windows-1252", "\x81\x8d\u20ac", ["decoded using windows-1252 fallback"]),
        ("é".encode(), "utf-8", "é", []),
        (BOM + b"a", "utf-8-bom", "a", []),
        (BOM + b"\xff", "utf-8-bom", None, []),
        (b"\xff\xfea\x00", "utf-16le", "a", []),
        (b"\xfe\xff\x00a", "utf-16be", "a", []),
        (b"\xff\xfe\x00\xd8", "utf-16le", "\ufffd", ["utf-16le decode contained replacement characters"]),
        (b"", "utf-8", "", []),
    ]
    df = spark.createDataFrame([(n, c[0]) for n, c in enumerate(cases)], "n int, content binary")
    c = F.col("content")
    df = df.withColumn("label", decode.encoding(c)).withColumn("text", decode.text(c, F.col("label")))
    rows = df.withColumn("w", decode.warnings(c, F.col("label"), F.col("text"))).orderBy("n").collect()
    assert [(r.label, r.text, r.w) for r in rows] == [case[1:] for case in cases]


def test_detection(spark):
    cases = [
        ("/a/script", "#!/usr/bin/env bash", "Shell"),
        ("/a/x.PY", "", "Python"),
        ("/a/.bashrc", "", None),
        ("/a/Dockerfile.dev", "", "Dockerfile"),
        ("/a/DOCKERFILE", "", "Dockerfile"),
        ("/a/GNUmakefile", "", "Makefile"),
        ("/a/Podfile", "", "Ruby"),
        ("/a/run", "#! /usr/bin/NODEJS", "JavaScript"),
        ("/a/run", "#!/usr/bin/pwsh -python", "Python"),
        ("/a/run.zzz", "#!/bin/sh", "Shell"),
        ("/a/run.", "", None),
        ("/a/x.foo", "", "C#"),
        ("/a/x.bar", "", None),
    ]
    df = spark.createDataFrame([(n, *c[:2]) for n, c in enumerate(cases)], "n int, path string, first string")
    overrides = Settings().updated(analysis={"extension_overrides": {"foo": "CS", "bar": "nothing"}})
    found = detect_language(F.col("path"), F.col("first"), overrides.extension_languages())
    assert [r.l for r in df.select("n", found.alias("l")).orderBy("n").collect()] == [c[2] for c in cases]


def test_rules_in_order(spark):
    dense = b"x" * 3000
    got = analyze(
        spark,
        [
            ("/w/a.c", b"int a;\n"),
            ("/w/vendor/a.c", b"int a;\n"),
            ("/w/target/vendor/a.c", b"int a;\n"),
            ("/w/a.generated.c", b""),
            ("/w/b.c", b"// Generated By x\n"),
            ("/w/a.min.js", b"x"),
            ("/w/dense.js", dense),
            ("/w/spaced.js", b"x " * 1500),
            ("/w/nul.c", b"a\x00"),
            ("/w/late.c", b"a" * 8192 + b"\x00"),
            ("/w/utf16.c", b"\xff\xfea\x00"),
            ("/w/bad.c", BOM + b"\xff"),
            ("/w/notes.md", b"x"),
            ("/w/Cargo.lock", b"x"),
            ("/w/gone.c", None),
            ("/w/open.c", b"/* open"),
            ("/w/.hidden/a.c", b"x"),
        ],
    )
    warning = {k: (r.status, r.warnings[0] if r.warnings else "") for k, r in got.items()}
    assert warning == {
        "a.c": ("analyzed_exact", ""),
        "vendor/a.c": ("skipped_by_policy", "vendor file skipped by policy"),
        "target/vendor/a.c": ("skipped_by_policy", "path matched excluded directory setting"),
        "a.generated.c": ("skipped_by_policy", "generated file skipped by policy"),
        "b.c": ("skipped_by_policy", "generated file skipped by policy"),
        "a.min.js": ("skipped_by_policy", "minified file skipped by policy"),
        "dense.js": ("skipped_by_policy", "minified file skipped by policy"),
        "spaced.js": ("analyzed_exact", ""),
        "nul.c": ("skipped_binary", "binary file skipped by default"),
        "late.c": ("skipped_by_policy", "minified file skipped by policy"),
        "utf16.c": ("analyzed_exact", ""),
        "bad.c": ("skipped_decode_error", "invalid utf-8 sequence after byte order mark"),
        "notes.md": ("skipped_unsupported", "unsupported or undetected language"),
        "Cargo.lock": ("skipped_by_policy", "lockfile skipped by default policy"),
        "gone.c": ("error_internal", "failed to read metadata"),
        "open.c": ("analyzed_best_effort", "unclosed block comment detected; result is best effort"),
    }
    assert got["utf16.c"].detected_encoding == "utf-16le" and got["utf16.c"].effective.code_lines == 1
    assert got["notes.md"].language is None and got["notes.md"].raw.total_physical_lines == 0


def test_root_below_packages_is_vendor(spark):
    entry = [("/x/packages/y/a.c", b"int a;")]
    assert analyze(spark, entry, root="/x/packages/y")["a.c"].status == "skipped_by_policy"
    off = Settings().updated(analysis={"vendor_directory_detection": False})
    kept = analyze(spark, entry, off, root="/x/packages/y")["a.c"]
    assert kept.status == "analyzed_exact" and kept.vendor


def test_presets_and_failing_settings(spark):
    with pytest.raises(PySparkException, match="binary file encountered: /w/a.c"):
        analyze(spark, [("/w/a.c", b"\x00")], PRESETS["strict"])
    full = analyze(spark, [("/w/vendor/a.min.js", b"x; // y\n"), ("/w/.h.c", b"x")], PRESETS["full_scope"])
    assert full["vendor/a.min.js"].effective.asDict() == {
        "code_lines": 1, "comment_lines": 1, "blank_lines": 0, "mixed_lines_separate": 0,
    }
    assert ".h.c" in full


def test_settings_text():
    settings = parse_settings('[analysis]\nmixed_line_policy = "comment-only"\nenabled_languages = ["JS"]\n')
    assert settings.analysis.mixed_line_policy == "comment_only"
    assert settings.enabled_languages() == ["JavaScript"]
    for bad in ("[discovery]\nmax_file_size_bytes = 0", '[analysis]\nenabled_languages = ["cobol"]'):
        with pytest.raises(ValueError):
            parse_settings(bad)
    assert Settings().excluding_output("/p", "/p/out/x").discovery.excluded_directories[-2:] == ("out", "sloc")


@pytest.mark.parametrize(
    "glob, yes, no",
    [
        ("*.rs", ["a.rs", "d/a.rs"], ["a.rsx"]),
        ("**/x", ["x", "a/x", "a/b/x"], ["ax"]),
        ("a/**", ["a/b", "a/b/c"], ["a", "ab/c"]),
        ("a/**/b", ["a/b", "a/x/b", "a/x/y/b"], ["ab", "a/xb"]),
        ("[!ab]?.{c,h}", ["xy.c", "x/.h"], ["ay.c", "x.c"]),
        (r"a\*b", ["a*b"], ["axb"]),
        ("**", ["x", "a/b"], []),
    ],
)
def test_globs(glob, yes, no):
    regex = re.compile(P.glob_regex(glob).replace(r"\z", r"\Z"))
    assert all(regex.search(text) for text in yes) and not any(regex.search(text) for text in no)


def test_invalid_globs():
    for glob in ("a[b", "{a", "[z-a].c"):
        with pytest.raises(ValueError):
            P.glob_regex(glob)


def test_ignore_rules(spark):
    paths = ["a.log", "keep.log", "d/a.log", "build/x.c", "d/build/x.c", "d/build2/x", "d/gen/x", "src/gen/x",
             "t/a1.txt", "t/b1.txt", "t/u/a1.txt", "d/#x", "q/very/deep/z", "d/foo/bar"]
    rules = [
        ("", "# c\n*.log\n!keep.log\nbuild/\n/d/gen\nt/a?.txt\n\\#x\nq/**/z\n**/foo/bar\n"),
        ("d", "!a.log\n"),
    ]
    df = spark.createDataFrame([(p,) for p in paths], "relative_path string")
    texts = spark.createDataFrame(rules, "dir string, text string")
    kept = ignore.apply_ignore_rules(df, ignore.parse_ignore_files(texts))
    assert {r.relative_path for r in kept.collect()} == {
        "keep.log", "d/a.log", "d/build2/x", "src/gen/x", "t/b1.txt", "t/u/a1.txt",
    }


def test_ignore_kinds_and_malformed_lines(spark):
    df = spark.createDataFrame([("keep.log",), ("a.log",), ("x.c",), ("d/keep.log",)], "relative_path string")
    texts = spark.createDataFrame(
        [("", ".gitignore", "\n\n*.log\nfoo[abc\n[z-a].c\nend\\"), ("", ".ignore", "!keep.log")], "dir string, kind string, text string"
    )
    rules = ignore.parse_ignore_files(texts)
    assert {r.relative_path for r in ignore.apply_ignore_rules(df, rules).collect()} == {"keep.log", "x.c", "d/keep.log"}
    assert sorted(r.ord for r in ignore.malformed_lines(texts).collect()) == [3, 4, 5]


def test_ignore_rules_move_no_content(spark):
    """Paths are joined and dealt out; contents stay where they are read, and no
    rules are gathered."""
    table = files(spark, [("/w/.gitignore", b"*.c\n"), ("/w/a.c", b"x"), ("/w/b.py", b"x")])
    kept = ignore.apply_ignore_rules(table, ignore.parse_ignore_files(ignore.ignore_texts(table)))
    assert {r.relative_path for r in kept.collect()} == {".gitignore", "b.py"}
    plan = kept._jdf.queryExecution().executedPlan()
    assert "collect_list" not in plan.toString() and "ShuffleExchange" not in plan.toString()
    paths = table.selectExpr("root as key", "root", "relative_path")
    rules = ignore.parse_ignore_files(ignore.ignore_texts(table)).withColumnRenamed("root", "key")
    inner = ignore.ignored_entries(paths, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in inner and "Join" in inner


def walked(paths, texts, repositories=None):
    """Kept (root, path) by a walk from the root down, as git reads its patterns.
    `texts` are (root, dir, kind, text) with plain patterns: names, endings,
    paths from the rule's directory."""
    kinds = ["global", "exclude", ".gitignore", ".ignore"]

    def depth(folder):
        return -len(folder.split("/")) if folder.startswith("..") else len([p for p in folder.split("/") if p])

    def seen_from(root, folder, path):
        if folder.startswith(".."):
            return "/".join([*root.strip("/").split("/")[depth(folder):], path])
        return path[len(folder) + 1 :] if folder else path

    def verdict(root, path, is_dir):
        parent = path.rpartition("/")[0]
        inner = None
        if repositories is not None:
            inner = max((depth(d) for r, d in repositories if r == root and (d.startswith("..") or not d or f"{parent}/".startswith(f"{d}/"))), default=None)
        for kind in reversed(kinds):
            own = [(d, t) for r, d, k, t in texts if r == root and k == kind]
            own = [(d, t) for d, t in own if d.startswith("..") or not d or path.startswith(f"{d}/")]
            if kind != ".ignore" and repositories is not None:
                own = [(d, t) for d, t in own if inner is not None and (kind == "global" or depth(d) >= inner)]
            for folder, text in sorted(own, key=lambda x: -depth(x[0])):
                for line in reversed(text.split("\n")):
                    negate, pattern = line.startswith("!"), line.removeprefix("!")
                    if not pattern or (pattern.endswith("/") and not is_dir):
                        continue
                    pattern = pattern.removesuffix("/")
                    below = seen_from(root, folder, path)
                    if "/" in pattern:
                        hit = below == pattern.removeprefix("/")
                    elif pattern.startswith("*"):
                        hit = path.endswith(pattern[1:])
                    else:
                        hit = path.rpartition("/")[2] == pattern
                    if hit:
                        return not negate
        return False

    def kept(root, path):
        parts = path.split("/")
        above = ["/".join(parts[:k]) for k in range(1, len(parts))]
        return not any(verdict(root, d, True) for d in above) and not verdict(root, path, False)

    return {(root, path) for root, path in paths if kept(root, path)}


def planted(seed):
    rng = random.Random(seed)
    names, patterns = ["a", "b", "c.x", "d.y"], ["a", "b/", "*.x", "!*.x", "!c.x", "/a", "a/b", "/b/a", "!a", "*.y", "!d.y", "b/c.x"]
    roots = ["/w/r", "/w/q/r", "/v"]
    paths = {(rng.choice(roots), "/".join(rng.choices(names, k=rng.randrange(1, 5)))) for _ in range(60)}
    folders = ["", "", "a", "b", "a/b", "..", "../..", "b/b"]
    texts = {}
    for _ in range(14):
        key = (rng.choice(roots), rng.choice(folders), rng.choice(["global", "exclude", ".gitignore", ".gitignore", ".ignore"]))
        if key[0] == "/v" and key[1] == "../..":
            continue
        texts[key] = "\n".join(rng.choices(patterns, k=rng.randrange(1, 4)))
    return sorted(paths), [(*k, t) for k, t in texts.items()], [(rng.choice(roots[:2]), rng.choice(folders)) for _ in range(6)]


@pytest.mark.parametrize("seed", range(6))
def test_ignore_rules_of_several_roots(spark, seed):
    """Files above the root, exclude and global files, repositories inside of
    others: against a walk of every path."""
    paths, texts, works = planted(seed)
    table = spark.createDataFrame(paths, "root string, relative_path string")
    rules = ignore.parse_ignore_files(spark.createDataFrame(texts, "root string, dir string, kind string, text string"))
    got = {tuple(r) for r in ignore.apply_ignore_rules(table, rules).collect()}
    assert got == walked(paths, texts)
    repositories = spark.createDataFrame(works, "root string, dir string")
    got = {tuple(r) for r in ignore.apply_ignore_rules(table, rules, repositories).collect()}
    assert got == walked(paths, texts, works)


def test_ignore_texts_and_outer_texts(spark):
    table = files(spark, [("/w/.gitignore", b"*.c\n"), ("/w/.git/info/exclude", b"a"), ("/w/s/.git/info/exclude", b"b"), ("/w/s/.ignore", b"c"), ("/w/exclude", b"")])
    assert sorted(tuple(r) for r in ignore.ignore_texts(table).collect()) == [
        ("/w", "", ".gitignore", "*.c\n"), ("/w", "", "exclude", "a"), ("/w", "s", ".ignore", "c"), ("/w", "s", "exclude", "b"),
    ]
    texts = spark.createDataFrame([("/", ".gitignore", "1"), ("/w", ".gitignore", "2"), ("/w/s/", ".ignore", "3"), ("/x", ".ignore", "4"), ("/w/st", ".ignore", "5")], "dir string, kind string, text string")
    assert sorted(tuple(r) for r in ignore.outer_texts(texts, "/w/s").collect()) == [
        ("/w/s", "", ".ignore", "3"), ("/w/s", "..", ".gitignore", "2"), ("/w/s", "../..", ".gitignore", "1"),
    ]


def test_large_ignored_sets_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ignore, "BROADCAST_BYTES", 0)
    table = files(spark, [("/w/.gitignore", b"*.c\nd/\n"), ("/w/a.c", b"x"), ("/w/d/b.py", b"x"), ("/w/b.py", b"x")])
    kept = ignore.apply_ignore_rules(table, ignore.parse_ignore_files(ignore.ignore_texts(table)))
    assert {r.relative_path for r in kept.collect()} == {".gitignore", "b.py"}


def test_minified_by_invalid_bytes(spark):
    got = analyze(spark, [("/w/e.c", b"\xe0" * 900), ("/w/f.c", b"\xe0" * 600), ("/w/g.c", b"x" * 2001), ("/w/h.c", b"x" * 2000)])
    assert {name: row.warnings == ["minified file skipped by policy"] for name, row in got.items()} == {
        "e.c": True, "f.c": False, "g.c": True, "h.c": False,
    }
    whole = Settings().updated(analysis={"minified_sample_bytes": None, "generated_sample_bytes": None, "binary_sample_bytes": None})
    late = [("/w/a.c", b"a b\n" * 2000 + b"y" * 900000), ("/w/b.c", b"a b\n" * 3000 + b"\0"), ("/w/c.c", b"a b\n" * 400 + b"@generated")]
    assert [analyze(spark, late)[f"{n}.c"].status for n in "abc"] == ["analyzed_exact"] * 3
    assert [analyze(spark, late, whole)[f"{n}.c"].status for n in "abc"] == ["skipped_by_policy", "skipped_binary", "skipped_by_policy"]


def test_unreadable_folders_and_links(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.c").write_bytes(b"x")
    (tmp_path / "link").symlink_to(tmp_path / "d")
    (tmp_path / "d" / "up").symlink_to(tmp_path)
    root = str(tmp_path)
    assert {r.relative_path for r in scan_directory(spark, root, 40).collect()} == {"d/a.c"}
    followed = list_directory(spark, root, follow_symlinks=True)
    assert {r.relative_path for r in scan_directory(spark, root, 40, listing=followed).collect()} == {"d/a.c", "link/a.c"}
    assert {r.path.removeprefix(root) for r in walk_errors(followed).collect()} == {"/d/up"} | {
        r.path.removeprefix(root) for r in followed.where("error is not null").collect()
    }
    missing = list_directory(spark, root + "/gone")
    assert [r.path for r in walk_errors(missing).collect()] == [root + "/gone"]
    assert discovery_warnings(walk_errors(missing)).first().warning.startswith("discovery warning: ")


def test_directory_sources(spark, tmp_path):
    for name, data in {"a.c": b"int a;\n", "_p/__init__.py": b"x = 1\n", "big.c": b"y" * 50, ".h/x.c": b"z",
                       "s/t/u.rs": b"// c\n"}.items():
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    (tmp_path / "link.c").symlink_to(tmp_path / "a.c")
    root = str(tmp_path)
    got = {r.relative_path: (r.size_bytes, r.is_symlink, r.content and bytes(r.content))
           for r in scan_directory(spark, root, 40).collect()}
    assert set(got) == {"a.c", "_p/__init__.py", "big.c", "s/t/u.rs", "link.c"}
    assert got["big.c"] == (50, False, None) and got["a.c"] == (7, False, b"int a;\n") and got["link.c"][1]
    native = {r.relative_path: r.content for r in scan_files(spark, root, 40).collect()}
    assert {"a.c", "big.c", "s/t/u.rs"} <= set(native) and native["big.c"] is None
    corpus = spark.createDataFrame([("/r/d/a.c", b"x")], "path string, content binary")
    assert scan_single_file(corpus, "/r/d/a.c").first().relative_path == "a.c"


def test_overlapping_roots(spark):
    corpus = spark.createDataFrame([(p, b"x") for p in ("/r/.s/a.c", "/r/b.c")], "path string, content binary")
    roots = ["/r", "/r/.s"]
    parts = [from_table(corpus.where(F.startswith("path", F.lit(root + "/"))), root) for root in roots]
    both = union_roots(parts)
    assert {(r.root, r.path) for r in dedupe_paths(both, roots).collect()} == {("/r", "/r/.s/a.c"), ("/r", "/r/b.c")}
    single = union_roots([scan_single_file(corpus, "/r/b.c"), *parts])
    found = dedupe_paths(single, ["/r/b.c", *roots], file_roots=[0]).collect()
    assert sorted((r.path, r.relative_path) for r in found) == [("/r/.s/a.c", ".s/a.c"), ("/r/b.c", "b.c"), ("/r/b.c", "b.c")]
    hidden = dedupe_paths(both, roots, ignore_hidden_files=True)
    assert {(r.root, r.path) for r in hidden.collect()} == {("/r/.s", "/r/.s/a.c"), ("/r", "/r/b.c")}


def test_analysis_honors_ignore_files(spark):
    table = files(spark, [("/w/.gitignore", b"*.c\n"), ("/w/a.c", b"x"), ("/w/b.py", b"x")])
    texts = ignore.ignore_texts(table)
    assert [r.relative_path for r in analyze_files(table, ignore_files=texts).collect()] == ["b.py"]
    off = Settings().updated(discovery={"honor_ignore_files": False, "ignore_hidden_files": False})
    got = {r.relative_path: r.warnings for r in analyze_files(table, off, ignore_files=texts).collect()}
    assert set(got) == {".gitignore", "a.c", "b.py"} and got[".gitignore"] == [".gitignore is always excluded"]


def test_analysis_of_a_stream_equals_the_batch(spark, tmp_path):
    table = files(spark, [(f"/w/f{n}.py", b"x = 1 # y\n" * n) for n in range(1, 9)])
    table.write.parquet(str(tmp_path / "corpus"))
    batch = analyze_files(spark.read.parquet(str(tmp_path / "corpus")))
    stream = analyze_files(spark.readStream.schema(table.schema).parquet(str(tmp_path / "corpus")))
    done = stream.writeStream.format("memory").queryName("analyzed").trigger(availableNow=True).start()
    done.awaitTermination(120)
    assert sorted(map(tuple, spark.table("analyzed").collect())) == sorted(map(tuple, batch.collect()))
