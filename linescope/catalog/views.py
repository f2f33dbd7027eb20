"""Views over the test tables, as SQL both Spark and DuckDB run.

The tables hold prose, so delimiters are planted with plain replacements and
paths are made from keys.  Every view covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linescope.functions.barrier import sealed
from linescope.functions.paths import relative_path
from linescope.session import configure
from linescope.sources.files import from_table, spread

_PLANTED = [
    ("' the '", "' /* the '"),
    ("' of '", "' */ of '"),
    ("' and '", "concat(' ', chr(34), 'and', chr(34), ' // ')"),
    ("' to '", "chr(10)"),
    ("' in '", "concat(' # in', chr(10))"),
    ("' is '", "concat(chr(10), 'class is:', chr(10), '    ', chr(34), chr(34), chr(34), 'is ')"),
    ("' a '", "concat(chr(34), chr(34), chr(34), chr(10), chr(10))"),
    ("' for '", "concat(' ', chr(39), 'for ')"),
    ("' with '", "concat(' -- with', chr(10))"),
    ("' der '", "concat(chr(10), '<!-- der ')"),
    ("' les '", "concat(' --> les', chr(10), '  ')"),
    ("' que '", "concat(' ', chr(34), chr(92), chr(34), chr(10))"),
    ("'. '", "concat('.', chr(10))"),
]

_TEXT = "text"
for _old, _new in _PLANTED:
    _TEXT = f"replace({_TEXT}, {_old}, {_new})"

_ENDINGS = (
    ".py .c .sh .sql .html .rs .lua .cs .hs .fs .jl .ps1 .php .js .css .nim .ml .clj .erl .asm .vue "
    ".min.js .generated.c .md .json .txt .png .R .h"
).split()
_ENDING = "case doc_id % 31 " + " ".join(f"when {n} then '{e}'" for n, e in enumerate(_ENDINGS)) + " else '' end"

#: doc_id, source, lang, kind, root, path, text
CORPUS = f"""
select doc_id, source, lang,
  case when doc_id % 37 = 5 then 'nul' when doc_id % 37 = 6 then 'cp1252' when doc_id % 37 = 7 then 'bom'
       when doc_id % 37 = 8 then 'badbom' when doc_id % 37 = 9 then 'utf16' else 'plain' end as kind,
  '/repo' as root,
  concat('/repo/', source, '/',
    case doc_id % 23 when 0 then 'vendor/' when 1 then 'node_modules/' when 2 then '.git/' when 3 then '.hidden/'
      when 4 then 'packages/a/' when 5 then concat(lang, '/deep/er/') else concat(lang, '/') end,
    case doc_id % 43 when 1 then concat('d', cast(doc_id as varchar(20)), '/Dockerfile')
      when 2 then concat('d', cast(doc_id as varchar(20)), '/Makefile')
      when 3 then concat('d', cast(doc_id as varchar(20)), '/Gemfile')
      when 4 then concat('d', cast(doc_id as varchar(20)), '/yarn.lock')
      else concat('f', cast(doc_id as varchar(20)), {_ENDING}) end) as path,
  concat(
    case when doc_id % 31 = 29 then concat('#!/usr/bin/env bash', chr(10))
         when doc_id % 31 = 30 then concat('#!/usr/bin/python', chr(10))
         when doc_id % 47 = 11 then concat('// Code Generated BY tool', chr(10)) else '' end,
    {_TEXT}) as text
from documents
"""

#: page_id, path, text
PAGE_FILES = """
select page_id, concat('/web/', cast(page_id as varchar(20)), '.html') as path,
  replace(replace(html, '<p>', concat('<p><!-- ', chr(10))), '</p>', concat(chr(10), ' --></p>')) as text
from pages
"""

#: root, ord, name, path: the sources as submodules, and one nested in another
SUBMODULES = """
select '/repo' as root, cast(row_number() over (order by source) as int) as ord, concat('mod-', source) as name,
  source as path
from (select distinct source from documents) s
union all
select '/repo' as root, 0 as ord, 'nested' as name, 'src1/en' as path
"""

#: repo, text: a .gitmodules text per document, some sections without a path
GITMODULES = """
select doc_id as repo, concat('path = outside', chr(10),
  '[submodule ', chr(34), source, chr(34), ']', chr(10), chr(9), 'path = libs/', source, chr(10),
  chr(9), 'url = https://example.org/', source, chr(10),
  case when n_chars % 3 = 0 then concat('  path=other/', source, '  ', chr(10)) else '' end,
  '[submodule ', chr(34), lang, chr(34), ']  ', chr(10),
  case when n_chars % 2 = 0 then concat(chr(9), 'path = ', lang) else '' end) as text
from documents
"""

#: the history table, one run per event
RUNS = """
select concat('run-', event_type, '-', cast(event_id as varchar(20))) as run_id,
  cast(ts as timestamp) as timestamp_utc,
  concat(event_type, '-project') as project_label,
  concat('/repo/u', cast(user_id % 20 as varchar(20))) as root,
  concat('/out/', cast(event_id as varchar(20)), '/result.json') as json_path,
  case when event_type = 'click' then concat('/out/', cast(event_id as varchar(20)), '/report.html') end as html_path,
  cast(null as varchar(20)) as pdf_path,
  cast(floor(value * 10) as bigint) as files_analyzed, cast(floor(value) as bigint) as files_skipped,
  cast(floor(value * 2000) as bigint) as total_physical_lines, cast(floor(value * 1000) as bigint) as code_lines,
  cast(floor(value * 300) as bigint) as comment_lines, cast(floor(value * 70) as bigint) as blank_lines,
  case when event_type = 'error' then null else event_type end as git_branch,
  props as git_commit
from events
"""

#: path of every artifact that exists
ARTIFACTS = """
select concat('/out/', cast(event_id as varchar(20)), '/result.json') as path from events where value >= 4
union all
select concat('/out/', cast(event_id as varchar(20)), '/report.html') as path from events where value >= 6
union all
select concat('/out/', cast(event_id as varchar(20)), '/report.pdf') as path from events where event_type <> 'view'
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    parts = spark.conf.get("spark.linescope.inputPartitions", None)
    return spread(rows, int(parts)) if parts and name in ("documents", "pages") else rows


def view(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    """A view above, run by Spark over one table."""
    return spark.sql(sql.replace(f"from {name}", f"from {{{name}}}"), **{name: table(spark, sf_dir, name)})


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CORPUS, "documents")


def content(text: Column, kind: Column) -> Column:
    """Bytes of a corpus text in the encoding its kind names."""
    utf8 = F.encode(text, "UTF-8")
    bom = F.concat(F.lit(b"\xef\xbb\xbf"), utf8)
    return (
        F.when(kind == "nul", F.concat(F.lit(b"\x00"), utf8))
        .when(kind == "cp1252", F.concat(utf8, F.lit(b"\x96")))
        .when(kind == "bom", bom)
        .when(kind == "badbom", F.concat(bom, F.lit(b"\xff")))
        .when(kind == "utf16", F.concat(F.lit(b"\xff\xfe"), F.encode(text, "UTF-16LE")))
        .otherwise(utf8)
    )


def corpus_files(rows: DataFrame, *keep: str) -> DataFrame:
    """Corpus rows as a file table."""
    stored = sealed(rows.select("path", content(F.col("text"), F.col("kind")).alias("content"), *keep))
    return from_table(stored, "/repo", *keep)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_files(corpus(spark, sf_dir))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the file table alone; no text is read for them."""
    path = F.col("path")
    return corpus(spark, sf_dir).select("path", relative_path(path, F.lit("/repo")).alias("relative_path"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PAGE_FILES, "pages").withColumn("language", F.lit("HTML"))


def submodules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SUBMODULES, "documents")


def gitmodules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, GITMODULES, "documents")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, RUNS, "events")
    empty = {name: F.lit(None).cast("string") for name in ("git_author", "git_tags", "settings_json")}
    return rows.withColumn("input_roots", F.array("root")).drop("root").withColumns(empty)


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, ARTIFACTS, "events")
