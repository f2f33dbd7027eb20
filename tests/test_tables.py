"""Rows of the fixed tables, written out: the SQL checks build on the same
tables as the engine and would not see a wrong one."""

import pytest
from pyspark.sql import functions as F

from linescope.operators import languages, policy, preview
from linescope.operators import warnings as W
from linescope.operators.detect import detect_language

BY_PATH = {
    "a.c": "C", "a.h": "C", "a.cc": "C++", "a.hpp": "C++", "a.cs": "C#", "a.go": "Go", "a.mjs": "JavaScript", "a.py": "Python",
    "a.zsh": "Shell", "a.psm1": "PowerShell", "a.mts": "TypeScript", "a.asm": "Assembly", "a.edn": "Clojure", "a.exs": "Elixir",
    "a.hrl": "Erlang", "a.fsx": "F#", "a.gradle": "Groovy", "a.lhs": "Haskell", "a.xhtml": "HTML", "a.kts": "Kotlin", "a.mk": "Makefile",
    "a.nims": "Nim", "a.mm": "Objective-C", "a.mli": "OCaml", "a.pm": "Perl", "a.phtml": "PHP", "a.R": "R", "a.rake": "Ruby",
    "a.sass": "SCSS", "a.svg": "XML", "a.zig": "Zig", "Dockerfile": "Dockerfile", "GNUmakefile": "Makefile", "Gemfile": "Ruby",
    "a.md": None, "a.json": None, ".py": None,
}
BY_SHEBANG = {"#!/usr/bin/env python3": "Python", "#!/usr/bin/pwsh": "PowerShell", "#!/bin/bash": "Shell", "#! none": None}
BUCKET_OF = {
    "x: unsupported or undetected language": "Unsupported or undetected text formats",
    "x: file exceeded max_file_size_bytes (3)": "Large files skipped by size limit",
    "x: binary file skipped by default": "Binary assets skipped",
    "x: minified file skipped by policy": "Minified files skipped by policy",
    "x: vendor file skipped by policy": "Vendor files skipped by policy",
    "x: unclosed string literal": "Best-effort parse results",
    "x: anything else": "Other warnings",
}
PREVIEW_OF = {
    "a.h": ("C", "supported", "C source"), "a.hxx": ("C++", "supported", "C++ source"), "a.psd1": ("PowerShell", "supported", "PowerShell source"),
    "a.min.js": (None, "skipped", "Minified asset"), "a.tar": (None, "skipped", "Binary or archive"), "a.lock": (None, "skipped", "Skipped file"),
    "README": (None, "unsupported", "Unsupported file"), "a.rs": (None, "unsupported", "RS file"),
}


def test_languages_by_path_and_shebang(spark):
    rows = [(path, "", language) for path, language in BY_PATH.items()] + [("s", line, language) for line, language in BY_SHEBANG.items()]
    found = spark.createDataFrame(rows, "path string, line string, want string")
    found = found.withColumn("got", detect_language(F.col("path"), F.col("line")))
    assert [tuple(r) for r in found.where(~F.col("want").eqNullSafe(F.col("got"))).collect()] == []


def test_language_names():
    assert len(languages.LANGUAGES) == 41
    rows = {language.name: (language.slug, language.json_name) for language in languages.LANGUAGES}
    assert rows["C#"] == ("csharp", "c_sharp") and rows["F#"] == ("fsharp", "f_sharp") and rows["Objective-C"] == ("objectivec", "objective_c")
    assert [languages.resolve_name(n) for n in ("c++", "golang", "JS", "hs", "objc", "cobol")] == [
        "C++", "Go", "JavaScript", "Haskell", "Objective-C", None,
    ]


def test_warning_buckets_by_text(spark):
    frame = spark.createDataFrame(list(BUCKET_OF.items()), "warning string, want string")
    assert frame.select(W.bucket_label(F.col("warning")) == F.col("want")).distinct().collect() == [(True,)]


def test_preview_labels(spark):
    frame = spark.createDataFrame([(name, *want) for name, want in PREVIEW_OF.items()], "name string, language string, kind string, label string")
    name = F.col("name")
    got = frame.select(
        "name",
        preview.preview_language(name).eqNullSafe(F.col("language")) & (preview.preview_kind(name) == F.col("kind")) & (preview.type_label(name) == F.col("label")),
    )
    assert [r[0] for r in got.collect() if not r[1]] == []


@pytest.mark.parametrize("name", ["Cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Pipfile.lock", "poetry.lock", "composer.lock"])
def test_lockfiles(spark, name):
    assert spark.range(1).select(policy.is_lockfile(F.lit(f"/r/{name}"))).first()[0]
