"""Line classification: golden files, hand-made cases, random texts."""

import random

import pytest
from pyspark.sql import functions as F
from scanner import scan

from linescope.operators import classify as K
from linescope.operators.languages import LANGUAGES

GOLDEN = {
    "C": (
        "/* block comment only line */\nint x = 1; // inline comment\n// single-line comment\nint y = 2;\n\n"
        "void foo() {\n    return; /* trailing block */\n}\n",
        "MXSC CYC",
    ),
    "Python": (
        '"""Module docstring."""\n\n\ndef greet(name):\n    """Return a greeting string."""\n'
        '    return "Hello, " + name  # inline comment\n\n\nclass Greeter:\n    """Greeter class."""\n\n'
        "    def hello(self):\n        pass\n",
        "D  CDX  CD CC",
    ),
    "Rust": (
        "// single-line comment\n/* block comment */\nfn add(a: i32, b: i32) -> i32 {\n    a + b // inline comment\n}\n\n"
        "fn main() {\n    let _result = add(1, 2);\n}\n",
        "SMCXC CCC",
    ),
    "Go": (
        '// Package doc comment.\npackage main\n\nimport "fmt"\n\n// Greet returns a greeting.\n'
        'func Greet(name string) string {\n    return fmt.Sprintf("Hello, %s", name) /* inline block */\n}\n',
        "SC C SCYC",
    ),
    "TypeScript": (
        "// single-line comment\n/* block comment */\nfunction add(a: number, b: number): number {\n"
        "    return a + b; // inline\n}\n\nexport { add };\n",
        "SMCXC C",
    ),
}

CASES = [
    ("C", "int x = 1; // note\n/* block */\n", "XM", False, False),
    ("Python", '"""module docs"""\n\n\ndef fn_a():\n    """function docs"""\n    value = 1  # trailing comment\n'
     "    return value\n", "D  CDXC", False, False),
    ("C", '/* a\n\n b */ x;\nchar*s="p\n\n  \nq"; /*/ still\n// "in" comment', "MMYC CYM", True, False),
    ("C", "a\r\nb\rc\n", "CCC", False, False),
    ("C", "\n", " ", False, False),
    ("C", "x; /* a */ // b", "X", False, False),
    ("Lua", "--[[ a\nb ]] x", "MY", False, False),
    ("C", 's = "a\\\nb"', "CC", False, False),
    ("Python", 'class A:\n@d\n    """doc"""', "CCD", False, False),
    ("Python", 'x = """a\n\n  b', "C C", False, True),
    ("Python", '\tdef f():\n\t\t"""doc\n\tstill"""\n\tpass\n', "CDDC", False, False),
    ("C#", 'a = @"x ""y\n" + b; // c', "CX", False, False),
    ("HTML", "<p><!-- a\n\n--></p>", "YMY", False, False),
]


def classify(spark, rows):
    df = spark.createDataFrame([(n, *row) for n, row in enumerate(rows)], "n int, language string, text string")
    return [tuple(r)[2:] for r in sorted(K.classify(df.repartition(8)).collect(), key=lambda r: r.n)]


def test_golden_files(spark):
    rows = [(language, text) for language, (text, _) in GOLDEN.items()]
    got = classify(spark, rows)
    assert [r[0] for r in got] == [codes for _, codes in GOLDEN.values()]
    assert not any(r[1] or r[2] for r in got)


def test_hand_made_cases(spark):
    got = classify(spark, [case[:2] for case in CASES])
    assert got == [case[2:] for case in CASES]


def test_empty_text_has_no_lines(spark):
    assert classify(spark, [(lang.name, "") for lang in LANGUAGES]) == [("", False, False)] * len(LANGUAGES)


def test_null_text_stays_null(spark):
    assert classify(spark, [("C", None)])[0][0] is None


@pytest.mark.parametrize("seed", [11, 12])
def test_random_texts_match_the_scanner(spark, seed):
    rnd = random.Random(seed)
    rows = []
    common = ["\n", "\n", "\r\n", "\r", " ", "x", "\t", '"', "'", "\\", '"""', "'''", '@"', "\u00a0", "\x01", "\x04",
              "\x06", "e", "*", "/", "-", "[", "]", "#", "="]
    for lang in LANGUAGES:
        alphabet = common + list(lang.lexicon.line) * 2 + list(lang.lexicon.block or ()) * 2
        rows += [(lang.name, "".join(rnd.choices(alphabet, k=rnd.randint(0, 30)))) for _ in range(300)]
    python = ["def f():", "class A:", "async def g(x):  ", "@d", '"""', "'''", 'r"""', "#", "\n", "\n", "\n", "\n    ",
              "\n  ", "\n\t", "\n ", " ", "x", ":", '"', "\\", "pass", "\u3000", "\n\n"]
    rows += [("Python", "".join(rnd.choices(python, k=rnd.randint(0, 25)))) for _ in range(6000)]
    got = classify(spark, rows)
    assert [(row, want) for row, want in zip(rows, got) if scan(*row) != want] == []


def test_large_single_token_files(spark):
    size = 1_500_000
    rows = [
        ("C", 's = "' + "\\n" * (size // 2)),
        ("C", "/* " + "a\n" * (size // 2)),
        ("C", "'\n" * (size // 2)),
        ("C", "/" * size),
        ("Python", 'def f():\n    """' + "x\n" * (size // 2)),
    ]
    got = classify(spark, rows)
    assert [len(r[0]) for r in got] == [1, size // 2, size // 2, 1, size // 2 + 1]
    assert [r[1:] for r in got] == [(False, True), (True, False), (False, False), (False, False), (False, False)]


def test_lines_and_counts_agree(spark):
    df = spark.createDataFrame([(k, text) for k, (text, _) in GOLDEN.items()], "language string, text string")
    done = K.classify(df)
    by_line = {
        (r.language, r.category): r["count"]
        for r in K.lines(done, "language").groupBy("language", "category").count().collect()
    }
    for row in done.select("language", K.raw_counts(F.col("line_codes")).alias("raw")).collect():
        counts = row.raw.asDict()
        total = counts.pop("total_physical_lines")
        assert sum(counts.values()) == total
        assert {k: v for k, v in counts.items() if v} == {
            c: n for (language, c), n in by_line.items() if language == row.language
        }


def test_filters_do_not_repeat_the_classification(spark):
    df = spark.createDataFrame([("C", "x")], "language string, text string")
    plan = K.classify(df).where(~F.col("unclosed_string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("unclosed_block") and plan.split("Generate")[0].count("regexp_replace") == 0
