"""Queries of saved runs, their history and large scans; registered with those
of `queries`, which imports this module last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linescope.catalog import oracles as O
from linescope.catalog import queries as Q
from linescope.catalog import views as V
from linescope.catalog.queries import ANALYZED, COUNTS, SUMS, query, scratch
from linescope.functions.paths import relative_path
from linescope.operators import delta, history, ignore, rollup
from linescope.operators.gate import Gate
from linescope.operators.pages import Pages, save_sorted
from linescope.plans.analyze import analyze_files
from linescope.session import checkpoint_dir
from linescope.settings import Settings
from linescope.sinks import runs as sinks
from linescope.sources import documents
from linescope.sources import files as S
from linescope.sources import runs as R

# ---------------------------------------------------------------- ignore files of several roots

_ROOT = "case when relative_path like 'src7/%' then '/repo/src7' when relative_path like 'src8/%' then '/repo/src8' else '/repo' end"
_NAME = "string_split(relative_path, '/')[-1]"


@query(
    "ignore_rules_roots",
    f"""select {_ROOT} as root, case when {_ROOT} = '/repo' then relative_path else substr(relative_path, 6) end as relative_path
from ({O.corpus()}) c where not (relative_path like 'src2/%' or relative_path like 'src7/de/%' or relative_path like 'src8/fr/%' or
  case when relative_path like 'src7/%' and regexp_matches({_NAME}, '^f.*3\\.png$') then false
    when relative_path like 'src7/en/%' and {_NAME} like '%.py' then true
    when relative_path like 'src8/%' and {_NAME} like '%.c' then true
    when relative_path like 'src8/%' and {_NAME} like '%.md' then false
    when {_NAME} like '%.md' then true
    when {_NAME} like '%.lua' then false
    when {_NAME} like '%.png' then true
    when regexp_matches({_NAME}, '^f.*1\\.json$') then false
    when {_NAME} like '%.json' then true
    when {_NAME} like '%.txt' then true else false end)""",
)
def ignore_rules_roots(spark, sf):
    """Three roots with files above, at and below them, an exclude file of the
    repository and a global file.

    Fixed values: the planted ignore files.  The roots below `/repo` take its
    rules from above; their own do not reach each other.
    """
    roots = ["/repo", "/repo/src7", "/repo/src8"]
    outer = spark.createDataFrame(
        [
            ("/", ".gitignore", "/repo/src7/de\n*.png\n"),
            ("/repo", "exclude", "*.json\n!f*1.json\nsrc2/\n/src8/fr\n"),
            ("/repo", ".gitignore", "*.md\n!*.lua\n"),
        ],
        "dir string, kind string, text string",
    )
    inner = [(root, "", "global", "*.txt\n*.lua\n") for root in roots]
    inner += [
        ("/repo/src7", "", ".ignore", "!f*3.png\n"),
        ("/repo/src7", "en", ".gitignore", "*.py\n"),
        ("/repo/src8", "", ".gitignore", "*.c\n!*.md\n"),
    ]
    texts = spark.createDataFrame(inner, "root string, dir string, kind string, text string")
    for root in roots:
        texts = texts.unionByName(ignore.outer_texts(outer, root))
    path = F.col("path")
    root = F.when(path.startswith("/repo/src7/"), "/repo/src7").when(path.startswith("/repo/src8/"), "/repo/src8").otherwise("/repo")
    files = V.paths(spark, sf).select(root.alias("root"), relative_path(path, root).alias("relative_path"))
    return ignore.apply_ignore_rules(files, ignore.parse_ignore_files(texts))


# ---------------------------------------------------------------- history


@query("update_registry", Q.ORACLES["register_run"])
def update_registry(spark, sf):
    """Two writers: one registers its runs while the other is at it."""
    path = scratch(spark, "registry")
    runs = V.runs(spark, sf)
    names = R.read_registry(spark, path).columns
    sinks.save_registry(runs.select(*names), path)
    later = runs.withColumns({"timestamp_utc": F.col("timestamp_utc") + F.expr("interval 1 day"), "code_lines": F.col("code_lines") + 1})
    mine = later.where(F.col("git_branch") == "click").select(*names)
    other = later.where(F.col("git_branch") == "view").withColumn("run_id", F.concat("run_id", F.lit("-again"))).select(*names)
    rounds = []

    def change(known: DataFrame) -> DataFrame:
        if not rounds:
            sinks.add_runs(spark, path, other)
        rounds.append(known)
        return history.register_run(known, mine)

    sinks.update_registry(spark, path, change)
    return R.read_registry(spark, path).select("run_id", F.date_format("timestamp_utc", "yyyy-MM-dd HH:mm:ss").alias("scanned"), "code_lines")


@query("paginate_saved", Q.ORACLES["paginate"])
def paginate_saved(spark, sf):
    """The third page behind the last row of the second, from a saved order."""
    path = scratch(spark, "pages")
    save_sorted(V.runs(spark, sf).select("run_id", "code_lines"), path, "code_lines", tie="run_id", ascending=False)
    pages = Pages(spark, path, ascending=False)
    seen = pages.page(2).collect()[-1]  # one page
    return pages.after(seen.code_lines, seen.run_id)


# ---------------------------------------------------------------- records


@query(
    "all_totals",
    Q.with_tags(
        f"""select 'run' as level, cast(null as varchar) as language, cast(null as varchar) as submodule, cast(count(*) as bigint) as files_considered,
  cast(count(*) filter ({ANALYZED}) as bigint) as files_analyzed, cast(count(*) filter (not ({ANALYZED})) as bigint) as files_skipped, {SUMS} from records
union all select 'language', language, null, cast(count(*) as bigint), cast(count(*) as bigint), 0, {SUMS} from tagged group by language
union all select 'submodule', null, submodule, cast(count(*) as bigint), cast(count(*) as bigint), 0, {SUMS} from tagged where submodule is not null group by submodule
union all select 'submodule_language', language, submodule, cast(count(*) as bigint), cast(count(*) as bigint), 0, {SUMS}
  from tagged where submodule is not null group by language, submodule"""
    ),
)
def all_totals(spark, sf):
    return rollup.all_totals(Q.tagged(spark, sf))


@query("file_delta_bucketed", Q.ORACLES["file_delta"])
def file_delta_bucketed(spark, sf):
    """Both runs saved in buckets; their comparison moves no records."""
    saved = Q.two_runs_saved(spark, sf)
    path = scratch(spark, "buckets")
    base, cur = (rollup.analyzed(sinks.save_bucketed(saved, path, run, buckets=8)) for run in ("base", "cur"))
    return delta.file_delta(base, cur)


@query("spread_by_bytes", O.with_records(f"select relative_path, status, {', '.join(COUNTS)} from records"))
def spread_by_bytes(spark, sf):
    rows = analyze_files(S.spread_bytes(V.files(spark, sf), 8), run_id="run")
    return rows.select("relative_path", "status", "raw.total_physical_lines", "effective.*")


@query(
    "quality_gate_observed",
    O.with_records(
        "select 'no_binary_files' as \"check\", 1 as exit_code, b = 0 as passed, b as value, 0 as \"limit\" "
        "from (select cast(count(*) filter (status = 'skipped_binary') as bigint) as b from records) x "
        "union all select 'no_decode_errors', 1, b = 0, b, 0 "
        "from (select cast(count(*) filter (status = 'skipped_decode_error') as bigint) as b from records) x "
        "union all select 'code_lines', 3, c >= 1000, c, 1000 from (select cast(sum(code_lines) as bigint) as c from records) z"
    ),
)
def quality_gate_observed(spark, sf):
    """The gate is fed while the records are written."""
    settings = Settings().updated(analysis={"binary_file_behavior": "fail", "decode_failure_behavior": "fail"})
    gate = Gate(settings, fail_below=1000)
    rows = analyze_files(V.files(spark, sf), settings, run_id="run", stop_early=False)
    sinks.save_records(rows, scratch(spark, "records"), gate)
    shape = "check string, exit_code int, passed boolean, value bigint, limit bigint"
    return spark.createDataFrame([tuple(check) for check in gate.checks()], shape)


# ---------------------------------------------------------------- documents


def one_document(records: DataFrame, path: str) -> None:
    """All files of a run as one JSON document in one file, a file a line."""
    lists = [("per_file_records", rollup.is_analyzed()), ("skipped_file_records", ~rollup.is_analyzed())]
    spark = records.sparkSession
    head = '{"tool": {"name": "linescope", "run_id": "run"}, "input_roots": ["/repo"], "warnings": ["a, b"], "per_file_records": ['
    marks = spark.createDataFrame([(0, "", head), (2, "", '], "skipped_file_records": ['), (4, "", "]}")], "part int, path string, value string")
    lines = marks
    for part, (_, chosen) in zip((1, 3), lists):
        mine = records.where(chosen)
        first = mine.agg(F.min("path")).scalar()
        comma = F.when(F.col("path") == first, "").otherwise(",")
        lines = lines.unionByName(mine.select(F.lit(part).alias("part"), "path", F.concat(comma, F.to_json(sinks.file_json())).alias("value")))
    lines.repartition(1).sortWithinPartitions("part", "path").select("value").write.text(path)


@query(
    "read_run_documents",
    O.with_records(f"select 'run' as run_id, relative_path, language, status, {', '.join(COUNTS)} from records"),
)
def read_run_documents(spark: SparkSession, sf: str) -> DataFrame:
    """All files as one document, read back in ranges."""
    path = scratch(spark, "document")
    checkpoint_dir(spark)
    one_document(Q.saved_records(spark, sf), path)
    _, files, _ = documents.read_run_documents(spark, path)
    return files.select("run_id", "relative_path", "language", "status", "raw.total_physical_lines", "effective.*")
