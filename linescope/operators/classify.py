"""Line classification as a chain of column expressions.

A file stays one row from decoding to its line counts, so the whole
computation is one narrow projection: no line is ever shuffled, and a file's
state (open block comment, open string) never leaves its row.

The text is rewritten in a fixed number of linear passes:

1. `_ruled`: newlines are unified, input characters that serve as marks are
   replaced, the last line gets a terminator, an end mark is appended.
2. `_docstring_marked` (Python only): docstring lines are taken out and leave
   one DOC mark each in front of the next line.
3. `_token_marked`: one regular expression per language walks the text from
   token to token.  It keeps line ends, brackets block comments and strings
   that run over several lines, and shrinks everything else to one character
   per run of code.  This is the only pass that costs much; the ones below see
   a few characters per line.
4. `_flattened`: strings and block comments over several lines are cut at line
   ends and lose their content, so each line can be judged on its own.
5. `_line_codes`: one letter per line.

The quantifiers over unbounded content are possessive or lazy over a single
character class, which the JVM runs as loops, so file size is not limited by
the stack.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescope.functions.barrier import sealed
from linescope.operators.languages import LANGUAGES, Lexicon, lookup

# Marks: control characters that the input is cleared of first.
STRING, BLOCK, LINE, CLOSE, DOC, END = (chr(n) for n in range(1, 7))
_NEUTRAL = chr(14)

# Unicode White_Space without line feed and carriage return.
BLANKS = r"\t\x0B\f \x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"

#: letter of `line_codes` -> counter it feeds
CATEGORIES = {
    " ": "blank_only_lines",
    "C": "code_only_lines",
    "S": "single_comment_only_lines",
    "M": "multi_comment_only_lines",
    "X": "mixed_code_single_comment_lines",
    "Y": "mixed_code_multi_comment_lines",
    "D": "docstring_comment_lines",
}

RAW_FIELDS = [
    "total_physical_lines",
    "blank_only_lines",
    "code_only_lines",
    "single_comment_only_lines",
    "multi_comment_only_lines",
    "mixed_code_single_comment_lines",
    "mixed_code_multi_comment_lines",
    "docstring_comment_lines",
    "skipped_unknown_lines",
]

UNCLOSED_BLOCK = "unclosed block comment detected; result is best effort"
UNCLOSED_STRING = "unclosed string literal detected; result is best effort"


def token_pattern(lexicon: Lexicon) -> str:
    """The token expression of a lexical rule.

    Matches follow each other without gaps.  Only one group of a match is set:
    1 a string over several lines, 2 and 3 a block comment (2 only the opener
    of a one-line comment), 4 the prefix of a line comment, 5 line ends and
    marks, 6 the first character of a run of code within a line.  Strings and
    block comments either close or swallow an end mark.
    """
    in_line, in_file = rf"[^\n{END}]", rf"[^{END}]"
    openers, long_strings, short_strings = [], [], []
    if "v" in lexicon.quotes:
        openers.append('@"')
        for found, stop in ((long_strings, ""), (short_strings, r"\n")):
            plain = rf'[^"{stop}{END}]*+'
            found.append(rf'@"{plain}(?:""{plain})*+["{"" if stop else END}]')
    if "t" in lexicon.quotes:
        for quote in ('"""', "'''"):
            openers.append(quote)
            long_strings.append(rf"{quote}{in_file}*?(?:{quote}|{END})")
            short_strings.append(rf"{quote}{in_line}*?{quote}")
    for kind, quote in (("q", "'"), ("d", '"')):
        if kind in lexicon.quotes:
            openers.append(quote)
            not_triple = rf"(?!{quote * 3})" if "t" in lexicon.quotes else ""
            plain = rf"[^{quote}\\{END}]*+"
            long_strings.append(rf"{quote}{plain}(?:\\{in_file}{plain})*+(?:{quote}|\\?+{END})")
            plain = rf"[^{quote}\\\n{END}]*+"
            short_strings.append(rf"{not_triple}{quote}{plain}(?:\\{in_line}{plain})*+{quote}")
    tokens = []
    if lexicon.block:
        opener, closer = map(re.escape, lexicon.block)
        openers.append(opener)
        tokens.append(rf"({opener}){in_line}*?{closer}")
        tokens.append(rf"({opener}{in_file}*?(?:{closer}|{END}{END}))")
    else:
        tokens.append("((?!))((?!))")
    prefixes = "|".join(map(re.escape, lexicon.line))
    openers += [re.escape(prefix) for prefix in lexicon.line]
    tokens.append(rf"({prefixes or '(?!)'}){in_line}*+")
    tokens.append(rf"(\n++{DOC}*+|{DOC}++|{END}++)")
    starts = re.escape("".join(sorted({opener.lstrip("\\")[0] for opener in openers})))
    code = [rf"[^\n{END}{starts}]++", rf"(?!{'|'.join(openers)})[{starts}]", *short_strings]
    return (
        rf"(?s)[{BLANKS}]*+(?:(?!{'|'.join(short_strings) or '(?=)'})({'|'.join(long_strings) or '(?!)'})|"
        rf"{'|'.join(tokens)}|(?=(.))(?:{'|'.join(code)})++)"
    )


TOKEN_PATTERNS = {lang.name: token_pattern(lang.lexicon) for lang in LANGUAGES}

# Docstrings: at the top of the file, or on the first significant line below a
# block header when that line is indented deeper.  Decorators that are not
# deeper than the header do not use up its expectation.
_IDLE = r" *+(?:#[^\n]*+)?+\n"
_HEADER = rf"( *+)(?:(?:async )?def |class )[^\n]*:[{BLANKS}]*+\n"
DOCSTRING_PATTERN = (
    rf"(?md)(?:\A((?:{_IDLE})*+) *+"
    rf"|^({_HEADER}(?:{_IDLE}|(?!\3 ) *+@[^\n]*+\n)*+)\3 ++)"
    rf"([rRuUbBfF]*+(\"\"\"|''')[^{END}]*?(?:\5[^\n]*+|(?=\n{END})))\n"
)
_INDENT = BLANKS.replace(" ", "")
_INDENT_PATTERN = rf"(?md)((?:^|\G(?<!\n)) *+)[{_INDENT}]"


def normalized_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def split_lines(text: Column) -> Column:
    """Physical lines; a final terminator adds none and empty text has none."""
    lines = F.split(normalized_newlines(text), "\n")
    return F.when(
        F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)
    ).otherwise(lines)


def first_line(text: Column) -> Column:
    return F.regexp_replace(F.substring_index(text, "\n", 1), r"\r\z", "")


def _ruled(text: Column) -> Column:
    body = F.regexp_replace(text, rf"[{STRING}-{END}]", _NEUTRAL)
    terminated = (body == "") | F.endswith(body, F.lit("\n"))
    return F.concat(body, F.when(terminated, END * 3).otherwise("\n" + END * 3))


def _has_triple_quotes(text: Column) -> Column:
    return F.contains(text, F.lit('"""')) | F.contains(text, F.lit("'''"))


def _plain_indent(body: Column) -> Column:
    """Each blank of an indent becomes one space, so depths compare as text."""
    odd = F.rlike(body, F.lit(rf"\n *+[{_INDENT}]")) | F.rlike(
        F.substring(F.ltrim(body), 1, 1), F.lit(rf"[{_INDENT}]")
    )
    return F.when(odd, F.regexp_replace(body, _INDENT_PATTERN, "$1 ")).otherwise(body)


def _docstring_marked(body: Column) -> Column:
    found = F.regexp_replace(body, DOCSTRING_PATTERN, rf"$1$2{STRING}$4{CLOSE}")
    return F.regexp_replace(found, rf"(?:{STRING}|\G(?<=\n))[^\n{CLOSE}]*+[\n{CLOSE}]", DOC)


def _token_marked(body: Column, language: Column) -> Column:
    marked = F.regexp_replace(
        body,
        lookup(TOKEN_PATTERNS, language),
        F.lit(f"$5{STRING}$1$6{CLOSE}{BLOCK}$2$3{CLOSE}{LINE}$4{CLOSE}"),
    )
    for opener in (STRING, BLOCK, LINE):
        marked = F.replace(marked, F.lit(opener + CLOSE), F.lit(""))
    return marked


def _flattened(marked: Column) -> Column:
    carried, content = rf"\G(?<=\n)({DOC}*+)", rf"[^\n{CLOSE}{END}]"
    # A string line leaves its first character, an empty one leaves nothing.
    code = F.regexp_replace(
        marked, rf"(?:{STRING}|{carried})(?:({content}){content}*+)?+{END}?+(?:{CLOSE}|(\n))", "$1$2$3"
    )
    return F.regexp_replace(
        code, rf"(?:{BLOCK}|{carried}){content}*+(?:{END}{END})?+(?:{CLOSE}|(\n))", rf"$1{BLOCK}$2"
    )


def _line_codes(flat: Column) -> Column:
    open_line = F.replace(F.replace(flat, F.lit(BLOCK + END), F.lit("")), F.lit(END), F.lit(""))
    # Code runs and comment prefixes become "C", so a line comment reads LINE C.
    codes = F.regexp_replace(open_line, rf"[^\n{BLOCK}{LINE}{DOC}]++", "C")
    for pattern, letter in (
        (rf"{BLOCK}*+C[C{BLOCK}]*+{LINE}C", "X"),
        (rf"{BLOCK}*+{LINE}C", "S"),
        (rf"(?:C{BLOCK}|{BLOCK}++C)[C{BLOCK}]*+", "Y"),
        (rf"{BLOCK}++", "M"),
        (r"(?<![CXSYM])\n", " "),
    ):
        codes = F.regexp_replace(codes, pattern, letter)
    return F.replace(F.replace(codes, F.lit("\n"), F.lit("")), F.lit(DOC), F.lit("D"))


def classify(df: DataFrame, text: str = "text", language: str = "language") -> DataFrame:
    """Replace the text by `line_codes` (one letter per physical line, see
    CATEGORIES), `unclosed_block` and `unclosed_string`.

    Narrow; null text gives nulls.  Filters on the result do not repeat the
    classification.
    """
    ruled, flat = "_ruled", "_flat"
    return sealed(
        df.withColumn(
            ruled,
            F.when(F.contains(F.col(text), F.lit("\r")), normalized_newlines(F.col(text))).otherwise(F.col(text)),
        )
        .withColumn(ruled, _ruled(F.col(ruled)))
        .withColumn("_docs", (F.col(language) == "Python") & _has_triple_quotes(F.col(ruled)))
        .withColumn(ruled, F.when(F.col("_docs"), _plain_indent(F.col(ruled))).otherwise(F.col(ruled)))
        .withColumn(ruled, F.when(F.col("_docs"), _docstring_marked(F.col(ruled))).otherwise(F.col(ruled)))
        .withColumn(flat, _flattened(_token_marked(F.col(ruled), F.col(language))))
        .drop(text, ruled, "_docs")
        .withColumns(
            {
                "line_codes": _line_codes(F.col(flat)),
                "unclosed_block": ~F.endswith(F.col(flat), F.lit(END * 2)),
                "unclosed_string": F.endswith(F.col(flat), F.lit(END * 2))
                & ~F.endswith(F.col(flat), F.lit(END * 3)),
            }
        )
        .drop(flat)
    )


def raw_counts(codes: Column) -> Column:
    """The nine raw counters of a file from its line codes."""
    counts = {name: F.length(codes) - F.length(F.replace(codes, F.lit(letter), F.lit("")))
              for letter, name in CATEGORIES.items()}
    counts["total_physical_lines"] = F.length(codes)
    counts["skipped_unknown_lines"] = F.lit(0)
    return F.struct(*[F.coalesce(counts[name], F.lit(0)).cast("bigint").alias(name) for name in RAW_FIELDS])


def line_category(code: Column) -> Column:
    """Category name of one line code."""
    return lookup(CATEGORIES, code)


def parse_mode(unclosed_block: Column, unclosed_string: Column) -> Column:
    return F.when(unclosed_block | unclosed_string, "lexical_best_effort").otherwise("lexical")


def parse_warnings(unclosed_block: Column, unclosed_string: Column) -> Column:
    return F.array_compact(
        F.array(F.when(unclosed_block, UNCLOSED_BLOCK), F.when(unclosed_string, UNCLOSED_STRING))
    )


def lines(df: DataFrame, *keys: str) -> DataFrame:
    """One row per physical line: keys, line_no (from 1) and category."""
    letters = F.split(F.col("line_codes"), "")
    return df.where(F.col("line_codes") != "").select(
        *keys, F.posexplode(letters).alias("_pos", "_code")
    ).select(*keys, (F.col("_pos") + 1).alias("line_no"), line_category(F.col("_code")).alias("category"))
