"""Registered queries: one per operator, each over whole test tables, with the
SQL that checks it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linescope.catalog import oracles as O
from linescope.catalog import views as V
from linescope.functions import paths as P
from linescope.functions import text as T
from linescope.functions.barrier import sealed
from linescope.operators import classify as K
from linescope.operators import decode, delta, detect, history, languages, preview, rollup, submodules
from linescope.operators import ignore as ignored
from linescope.operators import policy
from linescope.operators import warnings as W
from linescope.operators.counts import effective_counts
from linescope.plans import runs as runs_plan
from linescope.plans.analyze import analyze_files
from linescope.session import checkpoint_dir
from linescope.settings import MIXED_LINE_POLICIES, Settings, parse_settings
from linescope.sinks import runs as sinks
from linescope.sources import files as S
from linescope.sources import runs as R

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the session's shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def records(spark: SparkSession, sf: str, settings: Settings | None = None) -> DataFrame:
    return analyze_files(V.files(spark, sf), settings, run_id="run")


def saved_records(spark: SparkSession, sf: str) -> DataFrame:
    """The records of a run, saved first: what sorts or exports them should not
    analyse the files again."""
    return sinks.save_records(records(spark, sf), scratch(spark, "records"))


def corpus_text(spark: SparkSession, sf: str) -> DataFrame:
    """Corpus texts with their detected language, without selection."""
    language = detect.detect_language(F.col("path"), K.first_line(F.col("text")))
    texts = V.corpus(spark, sf).select("path", "text", language.alias("language"))
    return sealed(texts).where(F.col("language").isNotNull())


TEXTS = f"select path as id, detected as language, text from ({O.corpus()}) c where detected is not null"
COUNTS = [
    "total_physical_lines", "code_lines", "comment_lines", "blank_lines", "mixed_lines_separate",
]
SUMS = ", ".join(f"cast(sum({name}) as bigint) as {name}" for name in COUNTS)
ANALYZED = "rule is null"

# ---------------------------------------------------------------- sources


@query("scan_files", f"select path, relative_path, size_bytes from ({O.corpus()}) c")
def scan_files(spark, sf):
    return V.files(spark, sf).select("path", "relative_path", "size_bytes")


_FIRST_FILE = f"(select min(path) from ({V.CORPUS}) c where path like '/repo/src1/%')"


def _first_file(spark, sf) -> str:
    """A file to name as a root."""
    return V.corpus(spark, sf).where(F.startswith("path", F.lit("/repo/src1/"))).agg(F.min("path")).first()[0]


@query(
    "scan_single_file",
    f"select path, regexp_replace(path, '/[^/]*$', '') as root, string_split(path, '/')[-1] as relative_path, "
    f"strlen(text) as size_bytes from ({V.CORPUS}) c where path = {_FIRST_FILE}",
)
def scan_single_file(spark, sf):
    corpus = V.corpus(spark, sf).select("path", F.encode("text", "UTF-8").alias("content"))
    return S.scan_single_file(corpus, _first_file(spark, sf)).select("path", "root", "relative_path", "size_bytes")


ROOTS = ["/repo/src1/en", "/repo", "/repo/src1"]
_UNION = " union all ".join(
    f"select {n} as root_ord, '{root}' as root, path, substr(path, {len(root) + 2}) as relative_path "
    f"from ({V.CORPUS}) c where path like '{root}/%'"
    for n, root in enumerate(ROOTS)
)


def _roots(spark, sf):
    corpus = V.corpus(spark, sf).select("path", F.encode("text", "UTF-8").alias("content"))
    return S.union_roots(
        [S.from_table(corpus.where(P.is_below(F.col("path"), F.lit(root))), root) for root in ROOTS]
    )


@query("union_roots", f"select root, path, relative_path from ({_UNION}) u")
def union_roots(spark, sf):
    return _roots(spark, sf).select("root", "path", "relative_path")


@query(
    "dedupe_paths",
    f"select root, path, relative_path from (select *, row_number() over (partition by path order by root_ord) as rn "
    f"from ({_UNION}) u) d where rn = 1 "
    f"union all select regexp_replace(p, '/[^/]*$', ''), p, string_split(p, '/')[-1] from (select {_FIRST_FILE} as p) f",
)
def dedupe_paths(spark, sf):
    """Three directories and, in front of them, a file that lies in all."""
    file = _first_file(spark, sf)
    corpus = V.corpus(spark, sf).select("path", F.encode("text", "UTF-8").alias("content"))
    parts = [S.from_table(corpus.where(P.is_below(F.col("path"), F.lit(root))), root) for root in ROOTS]
    files = S.union_roots([S.scan_single_file(corpus, file), *parts])
    return S.dedupe_paths(files, [file, *ROOTS], file_roots=[0]).select("root", "path", "relative_path")


@query(
    "relative_path",
    f"select path, case when path like '/repo/src1/%' then substr(path, 12) else path end as relative_path "
    f"from ({V.CORPUS}) c",
)
def relative_path(spark, sf):
    return V.corpus(spark, sf).select(
        "path", P.relative_path(F.col("path"), F.lit("/repo/src1")).alias("relative_path")
    )


_SECTION = f"""
select repo, ord, list_filter(string_split(section, chr(10)), lambda l: l <> '') as ls
from (select repo, unnest(secs) as section, generate_subscripts(secs, 1) - 1 as ord
  from (select repo, string_split(text, '[submodule ') as secs from ({V.GITMODULES}) g) a) b where ord > 0"""
_SECTION_NAME = "regexp_extract(ls[1], '\"([^\"]*)\"', 1)"


@query(
    "read_gitmodules",
    f"select repo, cast(ord as int) as ord, {_SECTION_NAME} as name, "
    f"trim(regexp_extract(ps[-1], '=(.*)$', 1)) as path "
    f"from (select *, list_filter(ls, lambda l: regexp_matches(l, '^[ \\t]*path')) as ps from ({_SECTION}) s) t "
    f"where len(ps) > 0",
)
def read_gitmodules(spark, sf):
    return submodules.parse_gitmodules(V.gitmodules(spark, sf), "repo")


@query(
    "gitmodules_fill",
    f"select repo, name, cast(count(*) as bigint) as lines from "
    f"(select repo, ord, {_SECTION_NAME} as name, unnest(ls) as l from ({_SECTION}) s) t group by repo, name",
)
def gitmodules_fill(spark, sf):
    return submodules.section_lines(V.gitmodules(spark, sf), "repo").groupBy("repo", "name").agg(
        F.count("*").alias("lines")
    )


_TOML = """
[discovery]
max_file_size_bytes = 20000
exclude_globs = ["*.R"]
[analysis]
mixed_line_policy = "code-and-comment"
python_docstrings_as_comments = false
enabled_languages = ["py", "C", "rust", "html", "c#"]
"""


@query(
    "load_settings",
    O.with_records(
        f"select status, cast(count(*) as bigint) as files, {SUMS} from records group by status",
        max_size=20000, exclude="relative_path like '%.R'", policy="code_and_comment", docstrings=False,
        enabled="detected in ('Python', 'C', 'Rust', 'HTML', 'C#')",
    ),
)
def load_settings(spark, sf):
    rows = records(spark, sf, parse_settings(_TOML))
    return rows.groupBy("status").agg(
        F.count("*").alias("files"),
        F.sum("raw.total_physical_lines").alias("total_physical_lines"),
        *[F.sum(f"effective.{name}").alias(name) for name in COUNTS[1:]],
    )


# ---------------------------------------------------------------- selection

_WARNING = f"select relative_path, {O._rule_case(1)} as warning"


def rule_query(name: str, rule: str, settings: Settings = Settings(), sql: str | None = None, change=None, **options):
    """Register the files one rule stops."""
    by_rule = f"select relative_path from ({O.ruled(O.corpus(), **options)}) r where rule = '{rule}'"

    @query(name, sql or by_rule)
    def run(spark, sf):
        files = V.files(spark, sf)
        if change is not None:
            files = change(files)
        selected = policy.path_rules(policy.visible(files), settings)
        if rule not in ("metadata_error", "symlink", "gitignore_file", "excluded_dir", "max_size", "exclude_glob", "lockfile"):
            selected = policy.content_rules(selected, settings)
        return selected.where(F.col("rule") == rule).select("relative_path")


def _visible(condition: str) -> str:
    return (
        f"select relative_path from ({O.corpus()}) c "
        f"where not regexp_matches(relative_path, '(^|/)\\.') and ({condition})"
    )


_EXCLUDED = "list_has_any(string_split(path, '/'), ['.git', 'node_modules', 'target'])"
_LOCK = "path like '%/yarn.lock'"
rule_query(
    "policy_metadata_error", "metadata_error", sql=_visible("size_bytes > 3000"),
    change=lambda f: f.withColumn("size_bytes", F.when(F.col("size_bytes") <= 3000, F.col("size_bytes"))),
)
rule_query(
    "policy_symlink", "symlink", sql=_visible("size_bytes > 3000"),
    change=lambda f: f.withColumn("is_symlink", F.col("size_bytes") > 3000),
)


@query(
    "policy_gitignore_file",
    f"select replace(relative_path, 'Makefile', '.gitignore') as relative_path from ({O.corpus()}) c "
    f"where path like '%/Makefile'",
)
def policy_gitignore_file(spark, sf):
    renamed = V.files(spark, sf).withColumns(
        {name: F.replace(name, F.lit("Makefile"), F.lit(".gitignore")) for name in ("path", "relative_path")}
    )
    return policy.path_rules(renamed, Settings()).where(F.col("rule") == "gitignore_file").select("relative_path")


rule_query("policy_excluded_dir", "excluded_dir")
rule_query(
    "policy_max_size", "max_size", Settings().updated(discovery={"max_file_size_bytes": 4000}), max_size=4000
)
rule_query(
    "filter_exclude_globs", "exclude_glob", Settings().updated(discovery={"exclude_globs": ("**/*.{md,py}", "src1/*")}),
    exclude="regexp_matches(path, '\\.(md|py)$') or relative_path like 'src1/%'",
)
rule_query("policy_lockfile", "lockfile")
rule_query(
    "policy_read_error", "read_error", sql=_visible(f"size_bytes > 3000 and not {_EXCLUDED} and not {_LOCK}"),
    change=lambda f: f.withColumn("content", F.when(F.col("size_bytes") <= 3000, F.col("content"))),
)
rule_query("policy_vendor", "vendor")
rule_query("policy_generated", "generated")
rule_query("policy_minified", "minified")
rule_query("policy_binary", "binary")
rule_query("policy_decode_error", "decode_error")
rule_query("policy_unsupported", "unsupported")
rule_query(
    "filter_enabled_languages", "disabled_language",
    Settings().updated(analysis={"enabled_languages": ("js", "bash", "SQL")}),
    enabled="detected in ('JavaScript', 'Shell', 'SQL')",
)


@query(
    "filter_include_globs",
    _visible(
        f"{_EXCLUDED} or regexp_matches(path, '\\.(c|h)$') or relative_path like 'src1/%'"
    ),
)
def filter_include_globs(spark, sf):
    settings = Settings().updated(discovery={"include_globs": ("*.[ch]", "src1/**")})
    return policy.path_rules(policy.visible(V.files(spark, sf)), settings).select("relative_path")


@query(
    "policy_rank",
    f"select coalesce(rule, 'analyzed') as rule, cast(count(*) as bigint) as files, "
    f"cast(sum(size_bytes) as bigint) as size_bytes from ({O.ruled(O.corpus())}) r group by 1",
)
def policy_rank(spark, sf):
    selected = policy.content_rules(policy.path_rules(policy.visible(V.files(spark, sf)), Settings()), Settings())
    return selected.groupBy(F.coalesce("rule", F.lit("analyzed")).alias("rule")).agg(
        F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes")
    )


@query("hidden_filter", _visible("true"))
def hidden_filter(spark, sf):
    return policy.visible(V.paths(spark, sf)).select("relative_path")


@query(
    "glob_match",
    f"""select relative_path, regexp_matches(relative_path, '^(?:.*/)?f[0-9]*[05]\\.(?:py|c|rs)$') as numbered,
  regexp_matches(relative_path, '^src1./.*/deep/.*$') as deep from ({O.corpus()}) c""",
)
def glob_match(spark, sf):
    rel = F.col("relative_path")
    return V.paths(spark, sf).select(
        "relative_path",
        P.glob_match(rel, ["**/f*[05].{py,c,rs}"]).alias("numbered"),
        P.glob_match(rel, ["src1?/**/deep/**"]).alias("deep"),
    )


@query(
    "wildcard_match",
    f"""select relative_path, regexp_matches(relative_path, '^.*/f.?.?7\\..*$') as hit,
  relative_path like 'src1/%' as below from ({O.corpus()}) c""".replace(".?.?7", "..7"),
)
def wildcard_match(spark, sf):
    rel = F.col("relative_path")
    return V.paths(spark, sf).select(
        "relative_path",
        P.wildcard_match(rel, ["*/f??7.*"]).alias("hit"),
        P.wildcard_match(rel, [" src1\\* "]).alias("below"),
    )


_DIRS = f"""select distinct array_to_string(parts[1:i], '/') as dir from (
  select parts, unnest(range(1, len(parts))) as i from (
    select string_split(relative_path, '/') as parts from ({O.corpus()}) c) a) b"""


@query("preview_dir_filter", f"select dir, dir like 'src2/%' or dir = 'src2' or dir like '%/deep/%' or dir like '%/deep' as skipped from ({_DIRS}) d")
def preview_dir_filter(spark, sf):
    dirs = V.paths(spark, sf).select(F.explode(P.directories(F.col("relative_path"))).alias("dir")).distinct()
    return dirs.select("dir", P.preview_skips_directory(F.col("dir"), ["src2/*", "*/deep/placeholder"]).alias("skipped"))


ORACLES["preview_dir_filter"] = (
    f"select dir, dir || '/' like 'src2/%' or dir || '/placeholder' like '%/deep/placeholder' as skipped "
    f"from ({_DIRS}) d"
)


@query(
    "preview_file_filter",
    f"select relative_path from ({O.corpus()}) c where (relative_path like 'src1%' or relative_path like '%.py') "
    f"and not relative_path like '%deep%'",
)
def preview_file_filter(spark, sf):
    return V.paths(spark, sf).where(
        P.preview_includes_file(F.col("relative_path"), ["src1*", "*.py"], ["*deep*"])
    ).select("relative_path")


@query(
    "allowed_roots",
    f"select path from ({V.CORPUS}) c where path like '/repo/src1/%' or path like '/repo/src2/en/%'",
)
def allowed_roots(spark, sf):
    return policy.within_roots(V.corpus(spark, sf).select("path"), ["/repo/src1/", "/repo/src2/en"])


rule_query(
    "exclude_output_dir", "excluded_dir", Settings().excluding_output("/repo", "/repo/src4/out"),
    sql=_visible(f"{_EXCLUDED} or relative_path like 'src4/%'"),
)


@query(
    "split_patterns",
    """select doc_id, array_to_string(list_filter(list_transform(string_split(replace(text, chr(10), ','), ','),
  lambda p: trim(p)), lambda p: p <> ''), '|') as patterns from documents""",
)
def split_patterns(spark, sf):
    return V.table(spark, sf, "documents").select(
        "doc_id", F.array_join(T.split_patterns(F.col("text")), "|").alias("patterns")
    )


@query(
    "ignore_rules",
    f"""select relative_path from ({O.corpus()}) c where not (
  (relative_path like '%.md' and not relative_path like 'src1/%')
  or regexp_matches(relative_path, '(^|/)deep/') or regexp_matches(relative_path, '^src2/de/')
  or (relative_path like 'src3/%' and relative_path like '%.c' and not regexp_matches(relative_path, 'f[0-9]*5\\.c$'))
  or regexp_matches(relative_path, '^src5/.*f[0-9]*1\\.'))""",
)
def ignore_rules(spark, sf):
    files = V.paths(spark, sf)
    # The ignore files planted in the corpus.  `.ignore` outranks
    # `.gitignore` whatever their lines; malformed lines state no rule.
    planted = [
        ("", ".gitignore", "# top\n*.md\ndeep/\n/src2/de\nsrc5/**/f*1.*\nsrc6/[a\nsrc7/[z-a]*\n"),
        ("src1", ".gitignore", "!*.md\n"),
        ("src3", ".gitignore", "\n\n*.c\n\n\\!odd\n"),
        ("src3", ".ignore", "!f*5.c\n"),
    ]
    rules = spark.createDataFrame(planted, "dir string, kind string, text string")
    return ignored.apply_ignore_rules(files, ignored.parse_ignore_files(rules)).select("relative_path")


# ---------------------------------------------------------------- decoding and detection


@query(
    "decode_text",
    f"""select path, encoding, case kind when 'cp1252' then length_bytes + 1 when 'badbom' then null
    when 'nul' then length(text) + 1 else length(text) end as n_chars,
  case kind when 'cp1252' then 'decoded using windows-1252 fallback' else '' end as warnings from ({O.corpus()}) c""",
)
def decode_text(spark, sf):
    content = F.col("content")
    return (
        V.files(spark, sf)
        .withColumn("encoding", decode.encoding(content))
        .withColumn("text", decode.text(content, F.col("encoding")))
        .select(
            "path",
            "encoding",
            F.length("text").cast("bigint").alias("n_chars"),
            F.array_join(decode.warnings(content, F.col("encoding"), F.col("text")), "; ").alias("warnings"),
        )
    )


@query("detect_language", f"select path, detected as language from ({O.corpus()}) c")
def detect_language(spark, sf):
    language = detect.detect_language(F.col("path"), K.first_line(F.col("text")))
    return V.corpus(spark, sf).select("path", language.alias("language"))


_NO_SHEBANG = O.detected(text="''")


@query(
    "detect_overrides",
    f"select path, case when path like '%.md' then 'HTML' when path like '%.py' then 'C#' "
    f"else {_NO_SHEBANG} end as language from ({V.CORPUS}) c",
)
def detect_overrides(spark, sf):
    overrides = Settings().updated(
        analysis={"extension_overrides": {"md": "htm", "py": "cs", "txt": "no such language"}}
    ).extension_languages()
    language = detect.detect_language(F.col("path"), K.first_line(F.col("text")), overrides, shebang_detection=False)
    return V.corpus(spark, sf).select("path", language.alias("language"))


@query(
    "detect_shebang",
    f"""select path, case when text like '#!%' then case {' '.join(
        'when ' + ' or '.join(f"contains(lower(string_split(text, chr(10))[1]), {O.quoted(h)})" for h in hints)
        + f" then {O.quoted(name)}" for name, hints in languages.SHEBANGS)} end end as language
  from ({V.CORPUS}) c""",
)
def detect_shebang(spark, sf):
    return V.corpus(spark, sf).select(
        "path", detect.shebang_language(K.first_line(F.col("text"))).alias("language")
    )


_EXT = "lower(regexp_extract(string_split(path, '/')[-1], '^.+\\.([^.]*)$', 1))"


@query(
    "language_alias",
    f"select path, case {' '.join(f'when {_EXT} in ({O._list(lang.aliases.split())}) then {O.quoted(lang.name)}' for lang in languages.LANGUAGES)} "
    f"end as language from ({V.CORPUS}) c",
)
def language_alias(spark, sf):
    name = F.concat(F.lit(" "), F.upper(P.extension(F.col("path"))), F.lit(" "))
    return V.corpus(spark, sf).select("path", languages.language_alias(name).alias("language"))


_DIM = "(values " + ", ".join(
    f"({O.quoted(l.name)}, {O.quoted(l.slug)}, {O.quoted(l.json_name)}, {n})" for n, l in enumerate(languages.LANGUAGES)
) + ") dim(language, slug, json_name, enum_order)"


@query(
    "language_names",
    f"select dim.language, slug, json_name, cast(count(*) as bigint) as files "
    f"from ({O.corpus()}) c join {_DIM} on dim.language = detected group by all",
)
def language_names(spark, sf):
    dim = languages.language_dim(spark)
    counts = corpus_text(spark, sf).groupBy("language").agg(F.count("*").alias("files"))
    return counts.join(F.broadcast(dim), "language").select("language", "slug", "json_name", "files")


@query(
    "supported_languages",
    f"select dim.language, enum_order, cast(count(detected) as bigint) as files "
    f"from {_DIM} left join ({O.corpus()}) c on dim.language = detected group by all",
)
def supported_languages(spark, sf):
    counts = corpus_text(spark, sf).groupBy("language").agg(F.count("*").alias("n"))
    return languages.language_dim(spark).join(counts, "language", "left").select(
        "language", "enum_order", F.coalesce("n", F.lit(0)).alias("files")
    )


@query("first_line", f"select path, string_split(text, chr(10))[1] as first_line from ({V.CORPUS}) c")
def first_line(spark, sf):
    return V.corpus(spark, sf).select("path", K.first_line(F.col("text")).alias("first_line"))


# ---------------------------------------------------------------- lines


@query(
    "split_lines",
    f"""select path, cast(len(parts) - case when parts[-1] = '' then 1 else 0 end as bigint) as lines
  from (select path, string_split(text, chr(10)) as parts from ({V.CORPUS}) c) p""",
)
def split_lines(spark, sf):
    return V.corpus(spark, sf).select("path", F.size(K.split_lines(F.col("text"))).cast("bigint").alias("lines"))


_RULES = "(values " + ", ".join(
    O._row(
        O.quoted(l.name), O.quoted(",".join(l.lexicon.line)), O.quoted(" ".join(l.lexicon.block) if l.lexicon.block else None),
        *[kind in l.lexicon.quotes for kind in "qdtv"],
    )
    for l in languages.LANGUAGES
) + ") r(language, line_comments, block, single_q, double_q, triple_q, verbatim)"


@query(
    "language_rules",
    f"select line_comments, block, single_q, double_q, triple_q, verbatim, cast(count(*) as bigint) as files "
    f"from ({O.corpus()}) c join {_RULES} on r.language = detected group by all",
)
def language_rules(spark, sf):
    rules = languages.language_rules(spark).withColumns(
        {
            "line_comments": F.array_join("line_comments", ","),
            "block": F.concat("block_open", F.lit(" "), "block_close"),
        }
    )
    keys = ["line_comments", "block", "single_q", "double_q", "triple_q", "verbatim"]
    return corpus_text(spark, sf).join(F.broadcast(rules), "language").groupBy(*keys).agg(F.count("*").alias("files"))


def classified(spark, sf):
    return K.classify(corpus_text(spark, sf).select("path", "language", "text"))


@query(
    "classify_lines",
    f"with recursive {O.classified(TEXTS)} select id as path, cast(line_no as bigint) as line_no, category from lines",
)
def classify_lines(spark, sf):
    return K.lines(classified(spark, sf), "path").withColumn("line_no", F.col("line_no").cast("bigint"))


@query(
    "line_category",
    f"with recursive {O.classified(TEXTS)} select language, category, cast(count(*) as bigint) as lines "
    f"from lines join texts using (id) group by all",
)
def line_category(spark, sf):
    return K.lines(classified(spark, sf), "path", "language").groupBy("language", "category").agg(
        F.count("*").alias("lines")
    )


@query(
    "raw_counts",
    f"with recursive {O.classified(TEXTS)} select t.id as path, {O.raw_columns()} "
    f"from texts t left join lines l using (id) group by t.id",
)
def raw_counts(spark, sf):
    return classified(spark, sf).select("path", K.raw_counts(F.col("line_codes")).alias("raw")).select("path", "raw.*")


@query(
    "python_docstrings",
    f"with recursive {O.classified(TEXTS)} select id as path, cast(n as bigint) as line_no from docs",
)
def python_docstrings(spark, sf):
    python = corpus_text(spark, sf).where(F.col("language") == "Python").select("path", "language", "text")
    lines = K.lines(K.classify(python), "path")
    return lines.where(F.col("category") == "docstring_comment_lines").select(
        "path", F.col("line_no").cast("bigint").alias("line_no")
    )


@query(
    "parse_mode",
    f"""with recursive {O.classified(TEXTS)} select id as path,
  case when unclosed_block or unclosed_string then 'lexical_best_effort' else 'lexical' end as parse_mode,
  concat_ws('; ', case when unclosed_block then '{K.UNCLOSED_BLOCK}' end,
    case when unclosed_string then '{K.UNCLOSED_STRING}' end) as warnings from flags""",
)
def parse_mode(spark, sf):
    block, string = F.col("unclosed_block"), F.col("unclosed_string")
    return classified(spark, sf).select(
        "path",
        K.parse_mode(block, string).alias("parse_mode"),
        F.array_join(K.parse_warnings(block, string), "; ").alias("warnings"),
    )


@query("file_status", O.with_records("select relative_path, status from records"))
def file_status(spark, sf):
    return records(spark, sf).select("relative_path", "status")


PAGES = f"select page_id as id, 'HTML' as language, text from ({V.PAGE_FILES}) p"


@query(
    "analyze_html",
    f"with recursive {O.classified(PAGES)} select t.id as page_id, {O.raw_columns()} "
    f"from texts t left join lines l using (id) group by t.id",
)
def analyze_html(spark, sf):
    pages = K.classify(V.page_files(spark, sf).select("page_id", "language", "text"))
    return pages.select("page_id", K.raw_counts(F.col("line_codes")).alias("raw")).select("page_id", "raw.*")


_PAGE_RAW = f"""with recursive {O.classified(PAGES)},
raw as (select t.id, {O.raw_columns()} from texts t left join lines l using (id) group by t.id),
eff as (select raw.total_physical_lines, {O.effective("'code_only'")} from raw)"""


@query(
    "flagship",
    f"{_PAGE_RAW} select 'HTML' as language, cast(count(*) as bigint) as files, {SUMS} from eff",
)
def flagship(spark, sf):
    """Pages as files, classified, counted and rolled up by language."""
    pages = K.classify(V.page_files(spark, sf).select("path", "language", "text"))
    counted = pages.withColumn("raw", K.raw_counts(F.col("line_codes"))).withColumn(
        "effective", effective_counts(F.col("raw"), "code_only")
    )
    return rollup.language_totals(counted.withColumn("status", F.lit("analyzed_exact"))).drop("enum_order")


# ---------------------------------------------------------------- counts and views

_POLICIES = "(values " + ", ".join(f"('{p}')" for p in MIXED_LINE_POLICIES) + ") p(policy)"


@query(
    "effective_counts",
    f"""with recursive {O.classified(TEXTS)},
raw as (select t.id, {O.raw_columns()} from texts t left join lines l using (id) group by t.id)
select id as path, policy, {O.effective('policy')} from raw, {_POLICIES}""",
)
def effective(spark, sf):
    raw = classified(spark, sf).select("path", K.raw_counts(F.col("line_codes")).alias("raw"))
    policies = F.array(*[F.lit(p) for p in MIXED_LINE_POLICIES])
    return raw.select("path", "raw", F.explode(policies).alias("policy")).select(
        "path", "policy", effective_counts(F.col("raw"), F.col("policy")).alias("e")
    ).select("path", "policy", "e.*")


@query(
    "skipped_record",
    O.with_records(
        f"select relative_path, language, size_bytes, {', '.join(COUNTS)}, status, warnings from records where rule is not null"
    ),
)
def skipped_record(spark, sf):
    return rollup.skipped(records(spark, sf)).select(
        "relative_path", "language", "size_bytes", "raw.total_physical_lines", "effective.*", "status",
        F.array_join("warnings", "; ").alias("warnings"),
    )


_SHOWN = "array_to_string(list_transform(string_split(status, '_'), lambda w: upper(w[1]) || w[2:]), '')"


@query(
    "file_row_view",
    O.with_records(
        f"select relative_path, coalesce(language, '-') as language, {', '.join(COUNTS)}, {_SHOWN} as status, "
        f"lower({_SHOWN}) as status_class, warnings from records"
    ),
)
def file_row_view(spark, sf):
    return rollup.file_row_view(records(spark, sf))


@query(
    "fixed_offset_time",
    f"""select run_id, strftime(timestamp_utc - interval 8 hour, '%Y-%m-%d %H:%M:%S') as seconds,
  strftime(timestamp_utc - interval 8 hour, '%Y-%m-%d %H:%M PST') as minutes from ({V.RUNS}) r""",
)
def fixed_offset_time(spark, sf):
    ts = F.col("timestamp_utc")
    return V.runs(spark, sf).select(
        "run_id", T.fixed_offset_time(ts).alias("seconds"), T.fixed_offset_time(ts, False).alias("minutes")
    )


@query(
    "utc_time_text",
    f"""select run_id, strftime(timestamp_utc, '%Y-%m-%d %H:%M:%S UTC') as utc,
  strftime(timestamp_utc, '%Y-%m-%dT%H:%M:%S') || case when f = '000000' then '' when f like '%000' then '.' || f[1:3]
    else '.' || f end || '+00:00' as rfc3339 from (select *, strftime(timestamp_utc, '%f') as f from ({V.RUNS}) r) s""",
)
def utc_time_text(spark, sf):
    ts = F.col("timestamp_utc")
    return V.runs(spark, sf).select("run_id", T.utc_time_text(ts).alias("utc"), T.rfc3339(ts).alias("rfc3339"))


@query("epoch_minute_text", f"select run_id, strftime(timestamp_utc, '%Y-%m-%d %H:%M') as modified from ({V.RUNS}) r")
def epoch_minute_text(spark, sf):
    return V.runs(spark, sf).select(
        "run_id", T.epoch_minute_text(F.unix_timestamp("timestamp_utc")).alias("modified")
    )


@query(
    "run_id_gen",
    f"select run_id, strftime(timestamp_utc, '%Y%m%d-%H%M-') as minute, 32 as unique_length from ({V.RUNS}) r",
)
def run_id_gen(spark, sf):
    made = T.run_id(F.col("timestamp_utc"), F.uuid())
    return V.runs(spark, sf).withColumn("_made", made).select(
        "run_id",
        F.substring("_made", 1, 14).alias("minute"),
        F.length(F.substring_index("_made", "-", -1)).alias("unique_length"),
    )


@query(
    "format_thousands",
    "select o_orderkey, format('{:,}', cast(floor(o_totalprice) as bigint)) as shown from orders",
)
def format_thousands(spark, sf):
    return V.table(spark, sf, "orders").select(
        "o_orderkey", T.format_thousands(F.floor("o_totalprice")).alias("shown")
    )


_BALANCE = "cast(floor(c_acctbal) as bigint)"


@query(
    "signed_text",
    f"select c_custkey, case when {_BALANCE} > 0 then '+' else '' end || {_BALANCE} as shown from customer",
)
def signed_text(spark, sf):
    return V.table(spark, sf, "customer").select("c_custkey", T.signed_text(F.floor("c_acctbal")).alias("shown"))


@query(
    "delta_sign",
    f"""select c_custkey, case when c_acctbal > 9000 then 'na' when {_BALANCE} > 0 then 'pos'
  when {_BALANCE} < 0 then 'neg' else 'zero' end as sign from customer""",
)
def delta_sign(spark, sf):
    balance = F.when(~(F.col("c_acctbal") > 9000), F.floor("c_acctbal"))
    return V.table(spark, sf, "customer").select("c_custkey", T.delta_sign(balance).alias("sign"))


@query(
    "code_ratio_pct",
    f"""select run_id, case when code_lines + comment_lines + blank_lines = 0 then 0
  else code_lines * 100 // (code_lines + comment_lines + blank_lines) end as code_pct from ({V.RUNS}) r""",
)
def code_ratio_pct(spark, sf):
    return V.runs(spark, sf).select(
        "run_id", T.code_ratio_pct(*map(F.col, ("code_lines", "comment_lines", "blank_lines"))).alias("code_pct")
    )


@query(
    "project_label",
    """select event_id, coalesce(nullif(trim(lower(regexp_replace(props, '[^A-Za-z0-9]', '-', 'g')), '-'), ''), 'project')
  as label from events""",
)
def project_label(spark, sf):
    root = F.concat(F.lit("/srv/"), "props", F.lit("/"))
    return V.table(spark, sf, "events").select("event_id", T.project_label(root).alias("label"))


@query(
    "truncate_text",
    f"select relative_path, case when strlen(relative_path) <= 18 then relative_path "
    f"else left(relative_path, 17) || '…' end as shown from ({O.corpus()}) c",
)
def truncate_text(spark, sf):
    return V.files(spark, sf).select("relative_path", T.truncate_text(F.col("relative_path"), 18).alias("shown"))


@query(
    "csv_quote",
    """select doc_id, md5(case when regexp_matches(text, '[,"\\n]')
  then chr(34) || replace(text, chr(34), chr(34) || chr(34)) || chr(34) else text end) as quoted from documents""",
)
def csv_quote(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.md5(T.csv_quote(F.col("text"))).alias("quoted"))


@query(
    "html_escape",
    """select page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
  '"', '&quot;'), chr(39), '&#39;')) as escaped from pages""",
)
def html_escape(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", F.md5(T.html_escape(F.col("html"))).alias("escaped"))


@query(
    "text_search",
    f"select run_id from ({V.RUNS}) r where contains(lower(concat_ws(chr(9), run_id, project_label, git_commit, code_lines)), 'click-1')",
)
def text_search(spark, sf):
    shown = [F.col(name) for name in ("run_id", "project_label", "git_commit", "code_lines")]
    return V.runs(spark, sf).where(T.text_search("CLICK-1", *shown)).select("run_id")


# ---------------------------------------------------------------- totals


@query(
    "run_totals",
    O.with_records(
        f"select cast(count(*) as bigint) as files_considered, cast(count(*) filter ({ANALYZED}) as bigint) as files_analyzed, "
        f"cast(count(*) filter (not ({ANALYZED})) as bigint) as files_skipped, {SUMS} from records"
    ),
)
def run_totals(spark, sf):
    return rollup.run_totals(records(spark, sf))


_ORDER = "case language " + " ".join(f"when {O.quoted(n)} then {i}" for i, n in enumerate(languages.NAMES)) + " end"


@query(
    "language_totals",
    O.with_records(
        f"select language, cast(count(*) as bigint) as files, {SUMS}, {_ORDER} as enum_order "
        f"from records where {ANALYZED} group by language"
    ),
)
def language_totals(spark, sf):
    return rollup.language_totals(records(spark, sf)).orderBy("enum_order")


@query(
    "all_records",
    O.with_records(
        "select status, cast(count(*) as bigint) as files, cast(sum(size_bytes) as bigint) as size_bytes "
        "from records group by status"
    ),
)
def all_records(spark, sf):
    rows = records(spark, sf)
    return rows.groupBy("status").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes"))


@query(
    "sort_files",
    O.with_records(
        "select relative_path, language, status, cast(row_number() over (order by relative_path, path) as bigint) as position from records"
    ),
)
def sort_files(spark, sf):
    rows = rollup.sort_files(saved_records(spark, sf).select("relative_path", "path", "language", "status"))
    return rows.select("relative_path", "language", "status", F.col("number").alias("position"))


_TAGGED = f"""
, subs as (select * from ({V.SUBMODULES}) s),
tagged as (
  select r.*, (select s.name from subs s where r.relative_path = s.path or starts_with(r.relative_path, s.path || '/')
    order by s.ord limit 1) as submodule from records r where {ANALYZED})"""


def tagged(spark, sf):
    subs = V.submodules(spark, sf).withColumn("run_id", F.lit("run")).drop("root")
    return submodules.tag_submodule(records(spark, sf), subs, "run_id")


def with_tags(body: str) -> str:
    return O.with_records(f"{_TAGGED} {body}")


@query("tag_submodule", with_tags("select relative_path, submodule from tagged"))
def tag_submodule(spark, sf):
    return rollup.analyzed(tagged(spark, sf)).select("relative_path", "submodule")


_SUB_SUMS = ", ".join(f"cast(sum({name}) as bigint) as {name}" for name in COUNTS[:-1])


@query(
    "submodule_totals",
    with_tags(
        f"select t.submodule, s.path as relative_path, cast(count(*) as bigint) as files_analyzed, {_SUB_SUMS}, s.ord "
        f"from tagged t join subs s on s.name = t.submodule group by t.submodule, s.path, s.ord"
    ),
)
def submodule_totals(spark, sf):
    return rollup.submodule_totals(tagged(spark, sf), V.submodules(spark, sf))


@query(
    "submodule_language_totals",
    with_tags(
        f"select submodule, language, cast(count(*) as bigint) as files, {SUMS} from tagged "
        f"where submodule is not null group by all"
    ),
)
def submodule_language_totals(spark, sf):
    return rollup.submodule_language_totals(tagged(spark, sf)).orderBy("submodule", "language")


@query(
    "submodule_run",
    with_tags(
        f"select submodule, cast(count(*) as bigint) as files_considered, cast(count(*) as bigint) as files_analyzed, "
        f"0 as files_skipped, {_SUB_SUMS}, 0 as mixed_lines_separate from tagged where submodule = 'mod-src7' group by 1"
    ),
)
def submodule_run(spark, sf):
    return rollup.submodule_run(tagged(spark, sf), V.submodules(spark, sf), "mod-src7")


@query(
    "quality_gate",
    O.with_records(
        "select 'no_warnings' as \"check\", 2 as exit_code, w = 0 as passed, w as value, 0 as \"limit\" "
        "from (select cast(count(*) filter (warnings <> '') "
        "+ count(*) filter (contains(warnings, '; ')) + count(*) filter (regexp_matches(warnings, 'fallback; .*effort; ')) "
        "as bigint) as w from (select replace(warnings, 'detected; result', 'detected, result') as warnings from records) x) y "
        "union all select 'code_lines', 3, c >= 1000000, c, 1000000 from (select cast(sum(code_lines) as bigint) as c "
        "from records) z"
    ),
)
def quality_gate(spark, sf):
    return rollup.quality_gate(records(spark, sf), fail_on_warnings=True, fail_below=1000000)


@query("trend_extract", O.with_records(f"select language, cast(sum(code_lines) as bigint) as code_lines from (select {'case language ' + ' '.join(f'when {O.quoted(l.name)} then {O.quoted(l.json_name)}' for l in languages.LANGUAGES) + ' end'} as language, code_lines from records where {ANALYZED}) x group by 1"))
def trend_extract(spark, sf):
    return sinks.trend_languages(records(spark, sf))


@query(
    "trend_summary",
    O.with_records(
        f"select cast(sum(code_lines) as bigint) as code_lines, cast(sum(comment_lines) as bigint) as comment_lines, "
        f"cast(sum(blank_lines) as bigint) as blank_lines, cast(count(*) filter ({ANALYZED}) as bigint) as files_analyzed "
        f"from records"
    ),
)
def trend_summary(spark, sf):
    return sinks.trend_summary(records(spark, sf))


# ---------------------------------------------------------------- warnings

_WARNINGS = """
, warned as (select relative_path, relative_path || ': ' || w as warning from (select relative_path,
  unnest(string_split(replace(warnings, 'detected; result', 'detected@ result'), '; ')) as w0,
  replace(w0, 'detected@ result', 'detected; result') as w from records where warnings <> '') x)"""


def warned(spark, sf):
    return W.run_warnings(records(spark, sf))


def saved_warnings(spark, sf):
    return W.run_warnings(saved_records(spark, sf))


@query("run_warnings", O.with_records(f"{_WARNINGS} select relative_path, warning from warned"))
def run_warnings(spark, sf):
    return warned(spark, sf).select("relative_path", "warning")


_BUCKET = "case " + " ".join(
    f"when {' or '.join(f'contains(warning, {O.quoted(h)})' for h in hints)} then {O.quoted(label)}"
    for label, hints, _, _ in W.BUCKETS[:-1]
) + f" else {O.quoted(W.OTHER)} end"


def _pick(column: str, pairs) -> str:
    return f"case {column} " + " ".join(f"when {O.quoted(k)} then {O.quoted(v)}" for k, v in pairs) + " end"


@query(
    "warning_buckets",
    O.with_records(
        f"""{_WARNINGS} select label, cast(count(*) as bigint) as count,
  {_pick('label', [(b[0], b[2]) for b in W.BUCKETS])} as tone_class,
  {_pick('label', [(b[0], b[3]) for b in W.BUCKETS])} as detail
from (select {_BUCKET} as label from warned) w group by label"""
    ),
)
def warning_buckets(spark, sf):
    return W.warning_buckets(warned(spark, sf)).orderBy("label")


_OPPORTUNITY = "case " + " ".join(
    f"when {' or '.join(f'path like {O.quoted(chr(37) + e)}' for e in ends)} then {O.quoted(label)}"
    for label, ends, _ in W.OPPORTUNITIES
) + (" when regexp_extract(string_split(path, '/')[-1], '^.+\\.([^.]*)$', 1) = '' "
     "then 'Extensionless or custom text files' else 'Other unsupported text formats' end")


@query(
    "support_opportunities",
    O.with_records(
        f"""{_WARNINGS} select label, cast(count(*) as bigint) as count,
  coalesce({_pick('label', [(o[0], o[2]) for o in W.OPPORTUNITIES])}, {O.quoted(W.REVIEW)}) as recommendation
from (select {_OPPORTUNITY} as label from (select trim(string_split(warning, ':')[1]) as path from warned
  where contains(warning, '{W.UNSUPPORTED}')) p) w group by label"""
    ),
)
def support_opportunities(spark, sf):
    return W.support_opportunities(warned(spark, sf)).orderBy(F.desc("count"), "label")


@query(
    "number_console",
    O.with_records(
        f"""{_WARNINGS} select number, '[' || format('{{:03d}}', number) || '] ' || warning as line
from (select cast(row_number() over (order by relative_path, warning) as bigint) as number, warning from warned) w"""
    ),
)
def number_console(spark, sf):
    return W.number_console(saved_warnings(spark, sf))


@query(
    "warning_preview",
    O.with_records(
        f"""{_WARNINGS} select number, '[' || format('{{:03d}}', number) || '] ' || warning as line, total, total > 12 as truncated
from (select row_number() over (order by relative_path, warning) as number, warning,
  cast(count(*) over () as bigint) as total from warned) w where number <= 12"""
    ),
)
def warning_preview(spark, sf):
    return W.warning_preview(saved_warnings(spark, sf))


# ---------------------------------------------------------------- preview

_PL = "case " + " ".join(
    f"when {' or '.join(f'lower(name) like {O.quoted(chr(37) + e)}' for e in ends.split())} then {O.quoted(lang)}"
    for lang, ends in preview.PREVIEW_LANGUAGES.items()
) + " end"
_PS = " or ".join(f"lower(name) like {O.quoted(chr(37) + e)}" for e in preview.SKIPPED_ENDINGS.split())
_PK = f"case when {_PL} is not null then 'supported' when {_PS} then 'skipped' else 'unsupported' end"
_PX = "lower(regexp_extract(name, '^.+\\.([^.]*)$', 1))"
_PT = f"""case when {_PL} is not null then {_PL} || ' source'
  when {_PK} = 'skipped' then case when lower(name) like '%.min.js' then 'Minified asset'
    when {_PX} in ({O._list(preview.ARCHIVE_EXTENSIONS.split())}) then 'Binary or archive' else 'Skipped file' end
  when {_PX} = '' then 'Unsupported file' else upper({_PX}) || ' file' end"""
_NAMES = f"(select path, string_split(path, '/')[-1] as name from ({V.CORPUS}) c) n"


@query("type_label", f"select path, {_PT} as type_label from {_NAMES}")
def type_label(spark, sf):
    return V.corpus(spark, sf).select("path", preview.type_label(P.file_name(F.col("path"))).alias("type_label"))


@query("preview_language", f"select path, {_PL} as language from {_NAMES}")
def preview_language(spark, sf):
    return V.corpus(spark, sf).select("path", preview.preview_language(P.file_name(F.col("path"))).alias("language"))


@query("preview_kind", f"select path, {_PK} as kind from {_NAMES}")
def preview_kind(spark, sf):
    return V.corpus(spark, sf).select("path", preview.preview_kind(P.file_name(F.col("path"))).alias("kind"))


_CLOSED = "['.git', 'node_modules', 'target']"
_TREE = f"""
with f as (select relative_path, string_split(relative_path, '/') as parts from ({O.corpus()}) c),
d as (select distinct array_to_string(parts[1:i], '/') as relative_path, parts[1:i] as parts from
  (select parts, unnest(range(1, len(parts))) as i from f) x),
e as (select *, true as is_dir from d union all select *, false from f where relative_path not like '%.md'),
shown as (select relative_path, parts, is_dir, parts[-1] as name from e
  where not list_has_any(parts[1:-2], {_CLOSED}) and parts[1] <> 'src2'),
tree as (select relative_path, case when len(parts) > 1 then array_to_string(parts[1:-2], '/') end as parent,
  len(parts) as depth, is_dir, case when is_dir then name || '/' else name end as name,
  case when is_dir then 'dir' else {_PK} end as kind, case when not is_dir then {_PL} end as language,
  case when is_dir then 'Directory' else {_PT} end as type_label from shown)"""


@query("preview_tree", f"{_TREE} select * from tree")
def preview_tree(spark, sf):
    return preview.preview_tree(V.paths(spark, sf), exclude=["src2/*", "*.md"])


@query(
    "preview_stats",
    f"""{_TREE} select cast(count(*) filter (is_dir) as bigint) as directories,
  cast(count(*) filter (not is_dir) as bigint) as files,
  cast(count(*) filter (kind = 'supported') as bigint) as supported,
  cast(count(*) filter (kind = 'skipped') as bigint) as skipped,
  cast(count(*) filter (kind = 'unsupported') as bigint) as unsupported,
  array_to_string(list_sort(list_distinct(list(language) filter (language is not null))), ',') as languages from tree""",
)
def preview_stats(spark, sf):
    return preview.preview_stats(preview.preview_rows(V.paths(spark, sf), exclude=["src2/*", "*.md"]))


# ---------------------------------------------------------------- comparison

_LONGER = "case when lang = 'fr' then concat(text, chr(10), 'x = 1', chr(10), chr(10), '// y', chr(10)) else text end"


def two_runs_saved(spark, sf):
    """A baseline without one source, and a current run without another whose
    French texts have three more lines.

    Both are saved first, as runs are, and compared from the saved table, so
    each file is classified once.
    """
    corpus = V.corpus(spark, sf)
    base = corpus.where(F.col("source") != "src3").withColumn("run", F.lit("base"))
    cur = corpus.where(F.col("source") != "src7").withColumns({"run": F.lit("cur"), "text": F.expr(_LONGER)})
    files = V.corpus_files(base.unionByName(cur), "run")
    return sinks.save_records(analyze_files(files, run_id=F.col("run")), scratch(spark, "runs"))


def two_runs(spark, sf):
    """The analysed records of both runs."""
    saved = rollup.analyzed(two_runs_saved(spark, sf))
    return saved.where(F.col("run_id") == "base"), saved.where(F.col("run_id") == "cur")


def deltas(spark, sf):
    return delta.file_delta(*two_runs(spark, sf))


_SIDE = "select relative_path, language, code_lines as code, comment_lines as comment, blank_lines as blank from records where rule is null"
_PAIR = ", ".join(
    f"coalesce(b.{s}, 0) as baseline_{s}, coalesce(c.{s}, 0) as current_{s}, "
    f"coalesce(c.{s}, 0) - coalesce(b.{s}, 0) as {s}_delta" for s in ("code", "comment", "blank")
)
_DELTA = f"""with base as materialized ({O.with_records(_SIDE, where="where source <> 'src3'")}),
cur as materialized ({O.with_records(_SIDE, where="where source <> 'src7'", text=_LONGER)}),
pairs as (select coalesce(c.relative_path, b.relative_path) as relative_path,
  case when c.relative_path is null then b.language else c.language end as language,
  case when b.relative_path is null then 'added' when c.relative_path is null then 'removed'
    when b.code = c.code and b.comment = c.comment and b.blank = c.blank then 'unchanged' else 'modified' end as status,
  {_PAIR} from cur c full outer join base b on b.relative_path = c.relative_path),
deltas as (select *, code_delta + comment_delta + blank_delta as total_delta from pairs)"""


@query("file_delta", f"{_DELTA} select * from deltas")
def file_delta(spark, sf):
    return deltas(spark, sf)


_RANK = "case status when 'modified' then 0 when 'added' then 1 when 'removed' then 2 else 3 end"


@query(
    "sort_deltas",
    f"{_DELTA} select *, cast(row_number() over (order by {_RANK}, relative_path, current_code, baseline_code, total_delta) as bigint) as position from deltas",
)
def sort_deltas(spark, sf):
    ranked = deltas(spark, sf).withColumn("_rank", delta.status_rank())
    rows = W.numbered(ranked, "_rank", "relative_path", "current_code", "baseline_code", "total_delta")
    return rows.drop("_rank").withColumnRenamed("number", "position")


@query(
    "top_changed",
    f"{_DELTA} select relative_path, status, code_delta from deltas where status <> 'unchanged' "
    f"order by case status when 'modified' then 0 when 'added' then 1 else 2 end, relative_path limit 20",
)
def top_changed(spark, sf):
    return delta.top_changed(deltas(spark, sf)).select("relative_path", "status", "code_delta")


@query("delta_status_filter", f"{_DELTA} select * from deltas where status = 'modified'")
def delta_status_filter(spark, sf):
    return delta.delta_status_filter(deltas(spark, sf), "modified")


@query(
    "status_counts",
    f"{_DELTA} select " + ", ".join(
        f"cast(count(*) filter (status = '{s}') as bigint) as files_{s}" for s in ("added", "removed", "modified", "unchanged")
    ) + " from deltas",
)
def status_counts(spark, sf):
    return delta.status_counts(deltas(spark, sf))


@query(
    "line_churn",
    f"""{_DELTA}, s as (select
  cast(sum(case status when 'added' then current_code when 'modified' then greatest(code_delta, 0) else 0 end) as bigint) as lines_added,
  cast(sum(case status when 'removed' then baseline_code when 'modified' then greatest(-code_delta, 0) else 0 end) as bigint) as lines_removed,
  cast(sum(case status when 'unchanged' then current_code else 0 end) as bigint) as lines_unmodified from deltas)
select *, lines_added - lines_removed as lines_net from s""",
)
def line_churn(spark, sf):
    return delta.line_churn(deltas(spark, sf))


@query("removed_files", f"{_DELTA} select relative_path, language from deltas where status = 'removed'")
def removed_files(spark, sf):
    return delta.removed_files(*two_runs(spark, sf)).select("relative_path", "language")


@query(
    "path_sets",
    f"""{_DELTA} select cast(count(*) filter (status = 'removed') as bigint) as only_baseline,
  cast(count(*) filter (status = 'added') as bigint) as only_current,
  cast(count(*) filter (status in ('modified', 'unchanged')) as bigint) as in_both from deltas""",
)
def path_sets(spark, sf):
    return delta.path_sets(*two_runs(spark, sf))


@query(
    "baseline_dedupe",
    """select user_id % 500 as relative_path, max(event_id) as event_id, arg_max(event_type, event_id) as event_type
  from events group by 1""",
)
def baseline_dedupe(spark, sf):
    rows = V.table(spark, sf, "events").select(
        (F.col("user_id") % 500).alias("relative_path"), "event_id", "event_type"
    )
    return delta.baseline_dedupe(rows, "event_id")


# ---------------------------------------------------------------- history

_RUN = f"({V.RUNS}) r"
_ART = f"({V.ARTIFACTS})"


def _ends(spark, sf):
    """Ids of the oldest and the newest run, as a user would pick them."""
    row = V.runs(spark, sf).agg(
        F.min_by("run_id", F.struct("timestamp_utc", "run_id")).alias("a"),
        F.max_by("run_id", F.struct("timestamp_utc", "run_id")).alias("b"),
    ).first()
    return row["a"], row["b"]


_FIRST = f"(select run_id from {_RUN} order by timestamp_utc, run_id limit 1)"
_LAST = f"(select run_id from {_RUN} order by timestamp_utc desc, run_id desc limit 1)"


@query(
    "summary_delta",
    f"""select b.run_id as baseline_run_id, c.run_id as current_run_id,
  b.files_analyzed as baseline_files, c.files_analyzed as current_files,
  c.files_analyzed - b.files_analyzed as files_analyzed_delta, b.code_lines as baseline_code, c.code_lines as current_code,
  c.code_lines - b.code_lines as code_lines_delta, b.comment_lines as baseline_comments,
  c.comment_lines as current_comments, c.comment_lines - b.comment_lines as comment_lines_delta,
  c.blank_lines - b.blank_lines as blank_lines_delta, c.total_physical_lines - b.total_physical_lines as total_lines_delta
from ({V.RUNS}) b, ({V.RUNS}) c where b.run_id = {_FIRST} and c.run_id = {_LAST}""",
)
def summary_delta(spark, sf):
    first, last = _ends(spark, sf)
    return delta.summary_delta(V.runs(spark, sf), first, last).drop("baseline_timestamp", "current_timestamp")


@query("order_pair", f"select {_FIRST} as baseline_run_id, {_LAST} as current_run_id")
def order_pair(spark, sf):
    first, last = _ends(spark, sf)
    return history.order_pair(V.runs(spark, sf), last, first)


_SECOND = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query(
    "register_run",
    f"""select run_id, {_SECOND.format('timestamp_utc')} as scanned, code_lines from {_RUN} where git_branch is distinct from 'click'
union all select run_id, {_SECOND.format("timestamp_utc + interval 1 day")}, code_lines + 1 from {_RUN} where git_branch = 'click'
union all select run_id || '-again', {_SECOND.format("timestamp_utc + interval 1 day")}, code_lines + 1 from {_RUN} where git_branch = 'view'""",
)
def register_run(spark, sf):
    runs = V.runs(spark, sf)
    later = runs.withColumns(
        {"timestamp_utc": F.col("timestamp_utc") + F.expr("interval 1 day"), "code_lines": F.col("code_lines") + 1}
    )
    new = later.where(F.col("git_branch") == "click").unionByName(
        later.where(F.col("git_branch") == "view").withColumn("run_id", F.concat("run_id", F.lit("-again")))
    )
    return history.register_run(runs, new).select(
        "run_id", F.date_format("timestamp_utc", "yyyy-MM-dd HH:mm:ss").alias("scanned"), "code_lines"
    )


@query("prune_stale", f"select run_id, json_path from {_RUN} where json_path in (select path from {_ART} a)")
def prune_stale(spark, sf):
    return history.prune_stale(V.runs(spark, sf), V.artifacts(spark, sf)).select("run_id", "json_path")


_WITH_JSON = f"(select *, json_path in (select path from {_ART} a) as has_json from {_RUN}) j"
_EARLIER = "(partition by root order by timestamp_utc, run_id rows between unbounded preceding and 1 preceding)"


def _before(column: str) -> str:
    """Value of the newest earlier run whose JSON exists."""
    return f"last_value(case when has_json then {column} end ignore nulls) over {_EARLIER}"



@query(
    "prev_run",
    f"select run_id, {_before('run_id')} as prev_run_id, "
    f"strftime({_before('timestamp_utc')}, '%Y-%m-%d %H:%M:%S') as prev_scanned from {_WITH_JSON}",
)
def prev_run(spark, sf):
    return history.prev_run(V.runs(spark, sf), V.artifacts(spark, sf)).select(
        "run_id", "prev_run_id", F.date_format("prev_timestamp_utc", "yyyy-MM-dd HH:mm:ss").alias("prev_scanned")
    )


@query(
    "scan_number",
    f"select run_id, cast(coalesce(sum(case when has_json then 1 else 0 end) over {_EARLIER}, 0) + 1 as bigint) as scan_number from {_WITH_JSON}",
)
def scan_number(spark, sf):
    return history.scan_number(V.runs(spark, sf), V.artifacts(spark, sf))


@query(
    "run_change",
    "select run_id, "
    + ", ".join(f"{_before(n)} as prev_{n}, {n} - {_before(n)} as {n}_change" for n in history.TOTALS)
    + f" from {_WITH_JSON}",
)
def run_change(spark, sf):
    return history.run_change(V.runs(spark, sf), V.artifacts(spark, sf))


@query(
    "run_change_text",
    f"""select run_id, case when d is null then '—' when d > 0 then '+' || d else cast(d as varchar) end as change,
  case when d is null then 'na' when d > 0 then 'pos' when d < 0 then 'neg' else 'zero' end as sign
from (select run_id, code_lines - {_before('code_lines')} as d from {_WITH_JSON}) x""",
)
def run_change_text(spark, sf):
    return history.run_change_text(V.runs(spark, sf), V.artifacts(spark, sf))


@query(
    "latest_per_project",
    f"select run_id, root from (select *, row_number() over (partition by root order by timestamp_utc desc, run_id desc) "
    f"as rn from {_RUN}) x where rn = 1",
)
def latest_per_project(spark, sf):
    return history.latest_per_project(V.runs(spark, sf)).select("run_id", F.element_at("input_roots", 1).alias("root"))


@query(
    "run_metrics",
    f"select run_id, {', '.join(history.TOTALS)} from {_RUN} where run_id = {_LAST}",
)
def run_metrics(spark, sf):
    return history.run_metrics(V.runs(spark, sf)).select("run_id", *history.TOTALS)


@query(
    "badge_value",
    f"""select metric, label, format('{{:,}}', value) as value from (
  select 'code-lines' as metric, 'code lines' as label, code_lines as value, run_id from {_RUN}
  union all select 'files', 'files analyzed', files_analyzed, run_id from {_RUN}
  union all select 'comment-lines', 'comment lines', comment_lines, run_id from {_RUN}
  union all select 'blank-lines', 'blank lines', blank_lines, run_id from {_RUN}) b where run_id = {_LAST}""",
)
def badge_value(spark, sf):
    return history.badge_value(V.runs(spark, sf))


@query(
    "project_history",
    f"""select cast(count(*) as bigint) as scan_count, arg_max(run_id, (timestamp_utc, run_id)) as last_scan_id,
  strftime(max(timestamp_utc) - interval 8 hour, '%Y-%m-%d %H:%M PST') as last_scan_timestamp,
  arg_max(code_lines, (timestamp_utc, run_id)) as last_scan_code_lines,
  max_by(coalesce(git_branch, '-'), (timestamp_utc, run_id)) as last_git_branch,
  arg_max(git_commit, (timestamp_utc, run_id)) as last_git_commit from {_RUN} where root = '/repo/u3'""",
)
def project_history(spark, sf):
    return history.project_history(V.runs(spark, sf), "/repo/u3").withColumn(
        "last_git_branch", F.coalesce("last_git_branch", F.lit("-"))
    )


@query(
    "artifact_lookup",
    f"""select run_id, d as output_dir, html_path, case when d || '/report.pdf' in (select path from {_ART} a)
  then d || '/report.pdf' end as pdf_path, json_path, project_label as report_title
from (select *, regexp_replace(coalesce(html_path, json_path), '/[^/]*$', '') as d from {_RUN}) x""",
)
def artifact_lookup(spark, sf):
    return history.artifact_lookup(V.runs(spark, sf), V.artifacts(spark, sf))


@query(
    "history_rows",
    f"""select run_id, string_split(run_id, '-')[-1] as run_id_short,
  strftime(timestamp_utc - interval 8 hour, '%Y-%m-%d %H:%M PST') as "timestamp", project_label, root as project_path,
  files_analyzed, files_skipped, code_lines, comment_lines, blank_lines, coalesce(git_branch, '') as git_branch,
  coalesce(git_commit, '') as git_commit, coalesce(html_path in (select path from {_ART} a), false) as has_html,
  coalesce(json_path in (select path from {_ART} a), false) as has_json from {_RUN}""",
)
def history_rows(spark, sf):
    return history.history_rows(V.runs(spark, sf), V.artifacts(spark, sf))


_REPORTS = "select concat('/out/', cast(event_id as varchar(20)), '/found.html') as path from events where event_type <> 'view'"


@query(
    "link_report",
    f"""select run_id, json_path, case when git_branch is distinct from 'view' then regexp_replace(json_path, 'result.json', 'found.html')
    else html_path end as html_path, case when git_branch = 'purchase' then null else git_branch end as git_branch from {_RUN}""",
)
def link_report(spark, sf):
    runs = V.runs(spark, sf)
    reports = V.view(spark, sf, _REPORTS, "events")
    purchase = F.coalesce(F.col("git_branch") == "purchase", F.lit(False))
    linked = history.link_report(runs.where(~purchase), reports, runs.where(purchase))
    return linked.select("run_id", "json_path", "html_path", "git_branch")


@query(
    "history_filter",
    f"select run_id from {_RUN} where contains(lower(project_label), 'ick') and git_branch = 'click'",
)
def history_filter(spark, sf):
    return history.history_filter(V.runs(spark, sf), project=" ICK ", branch="click").select("run_id")


def _positioned(rows: DataFrame) -> DataFrame:
    """Sorted rows with their place, from 1.  Partitions of a sort are in order,
    and so are monotonically increasing ids."""
    kept = rows.withColumn("_place", F.monotonically_increasing_id()).checkpoint()
    return W.numbered(kept, "_place").drop("_place").withColumnRenamed("number", "position")


@query(
    "runs_newest_first",
    f"select run_id, {_SECOND.format('timestamp_utc')} as scanned, "
    f"cast(row_number() over (order by timestamp_utc desc, run_id desc) as bigint) as position from {_RUN}",
)
def runs_newest_first(spark, sf):
    checkpoint_dir(spark)
    rows = history.runs_newest_first(V.runs(spark, sf)).select(
        "run_id", F.date_format("timestamp_utc", "yyyy-MM-dd HH:mm:ss").alias("scanned")
    )
    return _positioned(rows)


@query(
    "table_sort",
    f"select run_id, project_label, cast(row_number() over (order by lower(project_label), run_id) as bigint) as position from {_RUN}",
)
def table_sort(spark, sf):
    checkpoint_dir(spark)
    return _positioned(history.table_sort(V.runs(spark, sf), "project_label", tie="run_id").select("run_id", "project_label"))


@query(
    "paginate",
    f"select run_id, code_lines from {_RUN} order by code_lines desc, run_id limit 25 offset 50",
)
def paginate(spark, sf):
    rows = history.table_sort(V.runs(spark, sf), "code_lines", tie="run_id", ascending=False)
    return history.paginate(rows.select("run_id", "code_lines"), page=3)


@query(
    "enrich_languages",
    O.with_records(
        """, t as (select source, language, count(*) as files, sum(code_lines) as code from records where rule is null group by all)
select run_id, string_agg(shown, ',' order by shown) as languages
from (select source as run_id, language || ':' || files || ':' || code as shown from t) s group by 1"""
    ),
)
def enrich_languages(spark, sf):
    by_source = records(spark, sf).withColumn("run_id", F.substring_index("relative_path", "/", 1))
    runs = V.corpus(spark, sf).select(F.col("source").alias("run_id")).distinct()
    rows = history.enrich_languages(runs, rollup.language_totals(by_source, "run_id"))
    shown = F.transform(
        "languages", lambda r: F.concat_ws(":", r["name"], r["files"].cast("string"), r["code_lines"].cast("string"))
    )
    return rows.select("run_id", F.array_join(F.array_sort(shown), ",").alias("languages"))


# ---------------------------------------------------------------- sinks, written and read back


_SUMMARY = [("Files Analyzed", f"count(*) filter ({ANALYZED})"), ("Files Skipped", f"count(*) filter (not ({ANALYZED}))")] + [
    (label, f"sum({name})") for label, name in (
        ("Physical Lines", "total_physical_lines"), ("Code Lines", "code_lines"), ("Comment Lines", "comment_lines"),
        ("Blank Lines", "blank_lines"), ("Mixed Lines (separate)", "mixed_lines_separate"))
]
_CSV_SUMMARY = " union all ".join(
    f"select 'summary' as section, '{label}' as name, null as size, cast({value} as varchar) as code, null as physical from records"
    for label, value in _SUMMARY
)


@query(
    "write_run_csv",
    O.with_records(
        f"""{_CSV_SUMMARY}
union all select 'language', language, cast(count(*) as varchar), cast(sum(code_lines) as varchar),
  cast(sum(total_physical_lines) as varchar) from records where {ANALYZED} group by language
union all select 'file', relative_path, cast(size_bytes as varchar), cast(code_lines as varchar),
  cast(total_physical_lines as varchar) from records where {ANALYZED}"""
    ),
)
def write_run_csv(spark, sf):
    """All three sections of the export, read back."""
    path = scratch(spark, "csv")
    sinks.write_run_csv(saved_records(spark, sf), path, "run", datetime(2024, 1, 2, tzinfo=timezone.utc), "Title")
    read = lambda name: spark.read.csv(f"{path}/{name}", header=True, lineSep="\r\n", escape='"')
    none = F.lit(None).cast("string")
    summary = read("summary").where(~F.col("Metric").isin("Run ID", "Timestamp", "Report Title")).select(
        F.lit("summary").alias("section"), F.col("Metric").alias("name"), none.alias("size"), F.col("Value").alias("code"), none.alias("physical")
    )
    by_language = read("by_language").select(F.lit("language"), "Language", "Files", "Code Lines", "Physical Lines")
    per_file = read("per_file").select(F.lit("file"), "Path", "Size (bytes)", "Code Lines", "Physical Lines")
    return summary.union(by_language).union(per_file)


@query(
    "write_skipped_table",
    O.with_records(
        f'select relative_path as "Path", {_SHOWN} as "Status", cast(size_bytes as varchar) as "Size" '
        f"from records where not ({ANALYZED})"
    ),
)
def write_skipped_table(spark, sf):
    path = scratch(spark, "skipped")
    sinks.write_skipped_table(saved_records(spark, sf), path)
    back = spark.read.csv(path, header=True, lineSep="\r\n", escape='"')
    return back.select("Path", "Status", F.col("Size (bytes)").alias("Size"))


@query(
    "write_diff_csv",
    f"{_DELTA} select upper(status[1]) || status[2:] as status, relative_path as path, language, "
    f"cast(code_delta as varchar) as code, cast(total_delta as varchar) as total from deltas "
    + " ".join(
        f"union all select 'summary', 'Files {s.capitalize()}', null, cast(count(*) filter (status = '{s}') as varchar), null from deltas"
        for s in ("added", "removed", "modified", "unchanged")
    ),
)
def write_diff_csv(spark, sf):
    path = scratch(spark, "diff")
    changes = _saved_deltas(spark, sf)
    sinks.write_diff_csv(_diff_summary(changes), changes, path)
    back = spark.read.csv(f"{path}/file_deltas", header=True, lineSep="\r\n", escape='"')
    counts = spark.read.csv(f"{path}/summary", header=True, lineSep="\r\n", escape='"').where(F.startswith("Metric", F.lit("Files ")))
    none = F.lit(None).cast("string")
    counts = counts.select(F.lit("summary").alias("status"), F.col("Metric").alias("path"), none.alias("language"), F.col("Value").alias("code"), none.alias("total"))
    return counts.union(back.toDF(*[name.lower().replace(" ", "_") for name in back.columns]).select(
        "status", "path", "language", F.col("code_δ").alias("code"), F.col("total_δ").alias("total")
    ))


def _saved_deltas(spark, sf) -> DataFrame:
    """A comparison, saved: an export reads it three times."""
    path = scratch(spark, "deltas")
    deltas(spark, sf).write.parquet(path)
    return spark.read.parquet(path)


def _diff_summary(changes: DataFrame) -> DataFrame:
    """One row naming both runs, with the sums of the changes."""
    sums = [F.sum(f"{c}_delta").alias(f"{name}_lines_delta") for c, name in (("code", "code"), ("comment", "comment"), ("blank", "blank"), ("total", "total"))]
    return changes.agg(*sums).select(F.lit("base").alias("baseline_run_id"), F.lit("cur").alias("current_run_id"), "*")


@query(
    "write_diff_json",
    f"{_DELTA} select relative_path, status, code_delta, total_delta from deltas "
    f"union all select 'summary', 'modified', cast(count(*) filter (status = 'modified') as bigint), cast(sum(total_delta) as bigint) from deltas",
)
def write_diff_json(spark, sf):
    path = scratch(spark, "diffjson")
    changes = _saved_deltas(spark, sf)
    sinks.write_diff_json(_diff_summary(changes), changes, path)
    back = spark.read.schema("relative_path string, status string, code_delta bigint, total_delta bigint").json(f"{path}/file_deltas")
    summary = spark.read.schema("files_modified bigint, total_lines_delta bigint").json(f"{path}/summary")
    return back.union(summary.select(F.lit("summary"), F.lit("modified"), "files_modified", "total_lines_delta"))


_JSON_NAME = "case language " + " ".join(f"when {O.quoted(l.name)} then {O.quoted(l.json_name)}" for l in languages.LANGUAGES) + " end"


@query(
    "write_run_json",
    O.with_records(f"select relative_path, {_JSON_NAME} as language, status, size_bytes, code_lines from records"),
)
def write_run_json(spark, sf):
    path = scratch(spark, "runjson")
    sinks.write_run_json(saved_records(spark, sf), path)
    shape = "relative_path string, language string, status string, size_bytes bigint, effective_counts struct<code_lines:bigint>"
    back = spark.read.schema(shape).json(f"{path}/files")
    return back.select("relative_path", "language", "status", "size_bytes", "effective_counts.code_lines")


@query(
    "read_run_json",
    O.with_records(
        f"select path as run_id, relative_path, language, status, {', '.join(COUNTS)} from records"
    ),
)
def read_run_json(spark, sf):
    """Every file as a saved run of one file, read back as runs."""
    path = scratch(spark, "saved")
    rows = records(spark, sf)
    document = F.struct(F.col("path").alias("run_id"))
    files = F.array(sinks.file_json())
    none = F.filter(files, lambda f: F.lit(False))
    rows.select(
        document.alias("tool"),
        F.array(F.col("path")).alias("input_roots"),
        F.when(rollup.is_analyzed(), files).otherwise(none).alias("per_file_records"),
        F.when(rollup.is_analyzed(), none).otherwise(files).alias("skipped_file_records"),
    ).write.json(path)
    back = R.run_files(R.read_run_json(spark, path, multi_line=False))
    return back.select(
        "run_id", "relative_path", "language", "status", "raw.total_physical_lines", "effective.*"
    )


@query("save_registry", f"select run_id, root, code_lines, git_branch from {_RUN}")
def save_registry(spark, sf):
    path = scratch(spark, "registry")
    sinks.save_registry(V.runs(spark, sf), path)
    return R.read_registry(spark, path).select(
        "run_id", F.element_at("input_roots", 1).alias("root"), "code_lines", "git_branch"
    )


@query(
    "read_registry",
    f"select git_branch, cast(count(*) as bigint) as runs, cast(sum(code_lines) as bigint) as code_lines from {_RUN} group by 1",
)
def read_registry(spark, sf):
    path = scratch(spark, "registry")
    known = R.read_registry(spark, path)
    sinks.save_registry(history.register_run(known, V.runs(spark, sf).select(*known.columns)), path)
    return R.read_registry(spark, path).groupBy("git_branch").agg(
        F.count("*").alias("runs"), F.sum("code_lines").alias("code_lines")
    )


# ---------------------------------------------------------------- whole scans

_T0, _T1 = datetime(2024, 1, 2, tzinfo=timezone.utc), datetime(2024, 1, 3, tzinfo=timezone.utc)
_PLAIN = "select relative_path, language, rule, size_bytes, total_physical_lines, code_lines, comment_lines, blank_lines from records"
_COUNTED = ", ".join(
    f"cast({value} as bigint) as {name}"
    for name, value in [
        ("files_analyzed", "count(*) filter (rule is null)"), ("files_skipped", "count(*) filter (rule is not null)"),
        *[(n, f"sum({n}) filter (rule is null)") for n in ("total_physical_lines", "code_lines", "comment_lines", "blank_lines")],
    ]
)


@query(
    "scan_with_history",
    f"""{_DELTA},
old as ({O.with_records(_PLAIN, where="where source <> 'src3'")}),
new as ({O.with_records(_PLAIN, where="where source <> 'src7'", text=_LONGER)}),
o as (select {_COUNTED} from old), n as (select {_COUNTED} from new),
c as (select {', '.join(f"cast(count(*) filter (status = '{s}') as bigint) as files_{s}" for s in ('added', 'removed', 'modified', 'unchanged'))},
  cast(sum(case status when 'added' then current_code when 'modified' then greatest(code_delta, 0) else 0 end) as bigint) as lines_added,
  cast(sum(case status when 'removed' then baseline_code when 'modified' then greatest(-code_delta, 0) else 0 end) as bigint) as lines_removed,
  cast(sum(case status when 'unchanged' then current_code else 0 end) as bigint) as lines_unmodified from deltas)
select 'cur' as run_id, 'repo' as project_label, 'base' as prev_run_id, 2 as scan_number,
  {', '.join(f'n.{t}' for t in history.TOTALS)}, {', '.join(f'n.{t} - o.{t} as {t}_change' for t in history.TOTALS)},
  c.*, lines_added - lines_removed as lines_net from o, n, c""",
)
def scan_with_history(spark, sf):
    """A baseline scanned and registered, then a scan with that history."""
    saved = two_runs_saved(spark, sf)
    artifacts = spark.createDataFrame([("/out/base/result.json",)], "path string")
    empty = R.read_registry(spark, scratch(spark, "none"))
    facts = lambda run, when: runs_plan.run_facts(spark, run, when, ["/repo"], Settings(), json_path=f"/out/{run}/result.json")
    first = runs_plan.scan_with_history(facts("base", _T0), saved, empty, artifacts)
    path = scratch(spark, "registry")
    sinks.save_registry(first.history, path)
    return runs_plan.scan_with_history(facts("cur", _T1), saved, R.read_registry(spark, path), artifacts).summary


@query(
    "write_run_document",
    with_tags(
        f"""select relative_path as name, language, status, code_lines, submodule
from (select r.relative_path, r.language, r.status, r.code_lines, t.submodule from records r
  left join tagged t on t.relative_path = r.relative_path) f
union all select 'run', {O.quoted(Settings().to_json())}, cast(count(*) as varchar), cast(sum(code_lines) as bigint),
  cast(count(distinct language) filter ({ANALYZED}) as varchar) from records
union all select 'submodule', submodule, cast(count(*) as varchar), cast(sum(code_lines) as bigint),
  cast(count(distinct language) as varchar) from tagged where submodule is not null group by submodule"""
    ),
)
def write_run_document(spark, sf):
    """A run written as tables and read back: files, run row and submodules."""
    path = scratch(spark, "document")
    kept = sinks.save_records(tagged(spark, sf), scratch(spark, "records"))
    facts = runs_plan.run_facts(spark, "run", _T0, ["/repo"], Settings())
    subs = V.submodules(spark, sf).drop("root")
    sinks.write_run_document(kept, runs_plan.run_rows(kept, facts), path, subs, W.run_warnings(kept))
    run, back = R.read_run_document(spark, path)
    files = back.select(
        F.col("relative_path").alias("name"), "language", "status", F.col("effective.code_lines").alias("code_lines"),
        F.when(rollup.is_analyzed(), F.col("submodule")).alias("submodule"),
    )
    top = run.select(
        F.lit("run"), "effective_configuration", F.col("summary_totals.files_considered").cast("string"),
        "summary_totals.code_lines", F.size("totals_by_language").cast("string"),
    )
    nested = run.select(F.inline("submodule_summaries")).select(
        F.lit("submodule"), "name", F.col("files_analyzed").cast("string"), "code_lines", F.size("language_summaries").cast("string")
    )
    return files.union(top).union(nested)


from linescope.catalog import saved_queries  # noqa: E402, F401  registers its queries
