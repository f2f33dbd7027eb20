"""The language dimension: names, aliases, file-name rules and lexical rules.

Everything in this module is fixed reference data (41 rows).  The data is used
in two forms: as constant map literals folded into a projection (no join, no
shuffle), and as small DataFrames for queries over the dimension itself.
"""

from __future__ import annotations

from collections import namedtuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Lexicon = namedtuple("Lexicon", "line block quotes")
Language = namedtuple("Language", "name slug json_name aliases extensions lexicon")

# Fixed values.  `quotes` holds the string kinds of a language:
#   q single quote, d double quote, t triple quotes, v verbatim @"..."
_C_STYLE = Lexicon(("//",), ("/*", "*/"), "qd")
_HASH = Lexicon(("#",), None, "qd")

# Fixed values, in the order run totals are reported:
# display name, slug, name in run JSON, aliases, extensions, lexical rule.
LANGUAGES = [
    Language("C", "c", "c", "c", "c h", _C_STYLE),
    Language("C++", "cpp", "cpp", "cpp c++ cplusplus", "cc cp cpp cxx hh hpp hxx", _C_STYLE),
    Language("C#", "csharp", "c_sharp", "csharp c# cs", "cs", Lexicon(("//",), ("/*", "*/"), "qdv")),
    Language("Go", "go", "go", "go golang", "go", _C_STYLE),
    Language("Java", "java", "java", "java", "java", _C_STYLE),
    Language("JavaScript", "javascript", "java_script", "javascript js", "js mjs cjs", _C_STYLE),
    Language("Python", "python", "python", "python py", "py", Lexicon(("#",), None, "qdt")),
    Language("Rust", "rust", "rust", "rust rs", "rs", Lexicon(("//",), ("/*", "*/"), "d")),
    Language("Shell", "shell", "shell", "shell sh bash", "sh bash zsh ksh", _HASH),
    Language("PowerShell", "powershell", "power_shell", "powershell pwsh ps", "ps1 psm1 psd1",
             Lexicon(("#",), ("<#", "#>"), "qd")),
    Language("TypeScript", "typescript", "type_script", "typescript ts", "ts mts cts", _C_STYLE),
    Language("Assembly", "assembly", "assembly", "assembly asm", "asm s", Lexicon((";",), None, "")),
    Language("Clojure", "clojure", "clojure", "clojure clj", "clj cljs cljc edn", Lexicon((";",), None, "d")),
    Language("CSS", "css", "css", "css", "css", Lexicon((), ("/*", "*/"), "qd")),
    Language("Dart", "dart", "dart", "dart", "dart", _C_STYLE),
    Language("Dockerfile", "dockerfile", "dockerfile", "dockerfile docker", "", Lexicon(("#",), None, "")),
    Language("Elixir", "elixir", "elixir", "elixir ex", "ex exs", _HASH),
    Language("Erlang", "erlang", "erlang", "erlang erl", "erl hrl", Lexicon(("%",), None, "d")),
    Language("F#", "fsharp", "f_sharp", "fsharp f# fs", "fs fsi fsx", Lexicon(("//",), ("(*", "*)"), "d")),
    Language("Groovy", "groovy", "groovy", "groovy", "groovy gradle", _C_STYLE),
    Language("Haskell", "haskell", "haskell", "haskell hs", "hs lhs", Lexicon(("--",), ("{-", "-}"), "qd")),
    Language("HTML", "html", "html", "html htm", "html htm xhtml", Lexicon((), ("<!--", "-->"), "")),
    Language("Julia", "julia", "julia", "julia jl", "jl", Lexicon(("#",), ("#=", "=#"), "dt")),
    Language("Kotlin", "kotlin", "kotlin", "kotlin kt", "kt kts", _C_STYLE),
    Language("Lua", "lua", "lua", "lua", "lua", Lexicon(("--",), ("--[[", "]]"), "qd")),
    Language("Makefile", "makefile", "makefile", "makefile make mk", "mk", Lexicon(("#",), None, "")),
    Language("Nim", "nim", "nim", "nim", "nim nims", Lexicon(("#",), ("#[", "]#"), "qd")),
    Language("Objective-C", "objectivec", "objective_c", "objectivec objc objective-c", "m mm", _C_STYLE),
    Language("OCaml", "ocaml", "ocaml", "ocaml ml", "ml mli", Lexicon((), ("(*", "*)"), "d")),
    Language("Perl", "perl", "perl", "perl pl", "pl pm t", _HASH),
    Language("PHP", "php", "php", "php", "php php3 php4 php5 php7 phtml", Lexicon(("//", "#"), ("/*", "*/"), "qd")),
    Language("R", "r", "r", "r", "r", _HASH),
    Language("Ruby", "ruby", "ruby", "ruby rb", "rb rake", _HASH),
    Language("Scala", "scala", "scala", "scala", "scala sc", _C_STYLE),
    Language("SCSS", "scss", "scss", "scss sass", "scss sass", _C_STYLE),
    Language("SQL", "sql", "sql", "sql", "sql", Lexicon(("--",), ("/*", "*/"), "q")),
    Language("Svelte", "svelte", "svelte", "svelte", "svelte", _C_STYLE),
    Language("Swift", "swift", "swift", "swift", "swift", Lexicon(("//",), ("/*", "*/"), "d")),
    Language("Vue", "vue", "vue", "vue", "vue", _C_STYLE),
    Language("XML", "xml", "xml", "xml", "xml xsd xsl xslt svg", Lexicon((), ("<!--", "-->"), "")),
    Language("Zig", "zig", "zig", "zig", "zig", Lexicon(("//",), None, "qd")),
]

# Exact file names, tested before the extension.
FILE_NAMES = {
    "Dockerfile": "Dockerfile",
    "Makefile": "Makefile GNUmakefile makefile BSDmakefile",
    "Ruby": "Rakefile Gemfile Guardfile Vagrantfile Fastfile Podfile",
}

# Interpreter substrings of a #! line, in test order.
SHEBANGS = [
    ("Python", ("python",)),
    ("PowerShell", ("pwsh", "powershell")),
    ("Shell", ("bash", "/sh", "zsh", "ksh")),
    ("Ruby", ("ruby",)),
    ("Perl", ("perl",)),
    ("PHP", ("php",)),
    ("JavaScript", ("node",)),
]

NAMES = [lang.name for lang in LANGUAGES]
_ALIASES = {alias: lang.name for lang in LANGUAGES for alias in lang.aliases.split()}
_EXTENSIONS = {ext: lang.name for lang in LANGUAGES for ext in lang.extensions.split()}
_EXACT_NAMES = {file: lang for lang, files in FILE_NAMES.items() for file in files.split()}


def sql_text(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def constant_map(entries: dict[str, str]) -> Column:
    """A map literal; Catalyst folds it to one constant."""
    parts = ", ".join(sql_text(part) for pair in entries.items() for part in pair)
    return F.expr(f"map({parts})")


def lookup(entries: dict, key: Column, value_type: str = "string") -> Column:
    """Constant-map lookup; null when the key is absent."""
    if not entries:
        return F.lit(None).cast(value_type)
    return F.try_element_at(constant_map(entries), key)


def resolve_name(name: str) -> str | None:
    """Driver-side alias resolution for configuration values."""
    return _ALIASES.get(name.strip().lower())


def language_alias(name: Column) -> Column:
    """Language for a name or alias, ignoring case and outer blanks."""
    return lookup(_ALIASES, F.lower(F.trim(name)))


def by_extension(extension: Column) -> Column:
    return lookup(_EXTENSIONS, extension)


def by_file_name(file_name: Column) -> Column:
    """Languages recognised from the exact file name."""
    return F.when(
        F.startswith(file_name, F.lit("Dockerfile.")) | (F.lower(file_name) == "dockerfile"),
        F.lit("Dockerfile"),
    ).otherwise(lookup(_EXACT_NAMES, file_name))


def json_name(language: Column) -> Column:
    return lookup({lang.name: lang.json_name for lang in LANGUAGES}, language)


def from_json_name(name: Column) -> Column:
    return lookup({lang.json_name: lang.name for lang in LANGUAGES}, name)


def enum_order(language: Column) -> Column:
    """Position in the declared language order; the sort key of run totals."""
    names = F.expr(f"array({', '.join(map(sql_text, NAMES))})")
    return F.array_position(names, language).cast("int") - 1


def language_dim(spark: SparkSession) -> DataFrame:
    """The 41 supported languages with every name they go by."""
    return spark.createDataFrame(
        [(lang.name, lang.slug, lang.json_name, order) for order, lang in enumerate(LANGUAGES)],
        "language string, slug string, json_name string, enum_order int",
    )


def language_rules(spark: SparkSession) -> DataFrame:
    """The lexical rule of each language."""
    return spark.createDataFrame(
        [
            (
                lang.name,
                list(lang.lexicon.line),
                lang.lexicon.block and lang.lexicon.block[0],
                lang.lexicon.block and lang.lexicon.block[1],
                *[kind in lang.lexicon.quotes for kind in "qdtv"],
            )
            for lang in LANGUAGES
        ],
        "language string, line_comments array<string>, block_open string, block_close string, "
        "single_q boolean, double_q boolean, triple_q boolean, verbatim boolean",
    )
