"""Run history: registration, artifacts, previous runs and lookups.

Operators that look along the time line of one project do not put a project
into a single window partition.  The history is cut into ranges of project and
time of about equal size, work is done inside the ranges, and the little that
crosses a border is carried through a table with one row per project and
range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linescope.functions.paths import parent
from linescope.functions.text import change_text, delta_sign, fixed_offset_time, short_run_id
from linescope.session import checkpoint_dir

TOTALS = [
    "files_analyzed", "files_skipped", "total_physical_lines", "code_lines", "comment_lines", "blank_lines",
]

_LANGUAGE_LIST = (
    "array<struct<name:string,files:bigint,code_lines:bigint,comment_lines:bigint,blank_lines:bigint>>"
)


def register_run(runs: DataFrame, new: DataFrame) -> DataFrame:
    """Append runs; a new run replaces an entry of the same id.

    The history is only probed for the new ids: where these are few, Spark
    broadcasts them and shuffles none of it.
    """
    return runs.join(new.select("run_id").distinct(), "run_id", "left_anti").select(*runs.columns).unionByName(new)


def runs_newest_first(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("timestamp_utc"), F.desc("run_id"))


def _flagged(runs: DataFrame, artifacts: DataFrame, column: str, flag: str) -> DataFrame:
    """Left join on the listed artifact paths; `flag` tells whether it exists.

    Missing paths get a key of their own each, so they do not meet in one
    partition.
    """
    listed = artifacts.select(F.col("path").alias("_key")).distinct().withColumn(flag, F.lit(True))
    keyed = runs.withColumn("_key", F.coalesce(column, F.concat(F.lit("\0"), "run_id")))
    return keyed.join(listed, "_key", "left").drop("_key").withColumn(flag, F.coalesce(flag, F.lit(False)))


def prune_stale(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Drop runs whose JSON file is gone; runs without a JSON path stay."""
    found = _flagged(runs, artifacts, "json_path", "_found")
    return found.where(F.col("json_path").isNull() | F.col("_found")).select(*runs.columns)


def with_json(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Runs with `has_json`: whether their JSON file exists."""
    return _flagged(runs, artifacts, "json_path", "has_json")


def along_time(runs: DataFrame, keys: Sequence[str], carry: Sequence[str], counted: str) -> DataFrame:
    """Run id, keys and carried columns of every run, with `scan_number` (the
    counted runs before it by time within the keys, plus one) and `previous`
    (the carried columns of the newest counted run before).  `counted` is a
    boolean column.

    Rows are range-partitioned by keys, time and id.  The id is unique, so
    even one project with one time is spread evenly.  A checkpoint fixes that
    layout; windows then run inside (keys, range), and only one row per key
    and range is windowed across ranges.
    """
    checkpoint_dir(runs.sparkSession)
    order = ["timestamp_utc", "run_id"]
    columns = list(dict.fromkeys([*keys, *order, *carry]))
    ranges = (
        runs.select(*columns, F.col(counted).alias("_counted"))
        .repartitionByRange(*keys, *order)
        .withColumn("_range", F.spark_partition_id())
        .checkpoint()
    )
    facts = F.struct(*carry)
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranges.withColumns(
        {
            "_rank": F.coalesce(F.sum(F.col("_counted").cast("bigint")).over(inside), F.lit(0)),
            "_before": F.last(F.when(F.col("_counted"), facts), ignorenulls=True).over(inside),
        }
    )
    across = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    borders = (
        ranges.groupBy(*keys, "_range")
        .agg(
            F.count_if("_counted").alias("_runs"),
            F.max_by(facts, F.when(F.col("_counted"), F.struct(*order))).alias("_last"),
        )
        .withColumns(
            {
                "_offset": F.coalesce(F.sum("_runs").over(across), F.lit(0)),
                "_carried": F.last("_last", ignorenulls=True).over(across),
            }
        )
        .select(*keys, "_range", "_offset", "_carried")
    )
    return local.join(borders, [*keys, "_range"]).select(
        *columns,
        (F.col("_offset") + F.col("_rank") + 1).alias("scan_number"),
        F.coalesce("_before", "_carried").alias("previous"),
    )


def _timed(runs: DataFrame, artifacts: DataFrame, carry: Sequence[str]) -> DataFrame:
    return along_time(with_json(runs, artifacts), ["input_roots"], carry, "has_json")


def prev_run(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Of every run the newest earlier one of the same roots whose JSON exists."""
    return _timed(runs, artifacts, ["run_id", "timestamp_utc"]).select(
        "run_id",
        "timestamp_utc",
        F.col("previous.run_id").alias("prev_run_id"),
        F.col("previous.timestamp_utc").alias("prev_timestamp_utc"),
    )


def scan_number(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Place of every run among the scans of its roots whose JSON exists."""
    return _timed(runs, artifacts, ["run_id"]).select("run_id", "scan_number")


def run_change(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The six totals of the run before and the change against them; null
    without an earlier run whose JSON exists."""
    return _timed(runs, artifacts, TOTALS).select(
        "run_id",
        *[F.col(f"previous.{name}").alias(f"prev_{name}") for name in TOTALS],
        *[(F.col(name) - F.col(f"previous.{name}")).alias(f"{name}_change") for name in TOTALS],
    )


def run_change_text(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Code-line change as shown: signed text and its sign class."""
    change = F.col("code_lines") - F.col("previous.code_lines")
    return _timed(runs, artifacts, TOTALS).select(
        "run_id",
        change_text(F.col("code_lines"), F.col("previous.code_lines")).alias("change"),
        delta_sign(change).alias("sign"),
    )


def latest_per_project(runs: DataFrame) -> DataFrame:
    """The newest run of each root list: an aggregate, no window."""
    newest = F.max_by(F.struct(*runs.columns), F.struct("timestamp_utc", "run_id"))
    return runs.groupBy(F.col("input_roots").alias("_roots")).agg(newest.alias("_run")).select("_run.*")


def run_metrics(runs: DataFrame, run_id: str | None = None) -> DataFrame:
    """One run by id, or the newest."""
    if run_id is not None:
        return runs.where(F.col("run_id") == run_id)
    newest = F.max_by(F.struct(*runs.columns), F.struct("timestamp_utc", "run_id"))
    return runs.agg(newest.alias("_run")).where(F.col("_run").isNotNull()).select("_run.*")


def enrich_languages(runs: DataFrame, language_totals: DataFrame) -> DataFrame:
    """Runs with their language rows as an array in reporting order.

    A run has at most one row per supported language, so the arrays are
    small.
    """
    row = F.struct(
        "enum_order", F.col("language").alias("name"), "files", "code_lines", "comment_lines", "blank_lines"
    )
    lists = language_totals.groupBy("run_id").agg(F.array_sort(F.collect_list(row)).alias("languages"))
    shown = F.transform("languages", lambda r: r.dropFields("enum_order"))
    return runs.join(lists, "run_id", "left").withColumn(
        "languages", F.coalesce(shown, F.expr(f"cast(array() as {_LANGUAGE_LIST})"))
    )


def badge_value(runs: DataFrame) -> DataFrame:
    """Badge label and value of each metric of the newest run."""
    # Metric, label, column.
    metrics = [
        ("code-lines", "code lines", "code_lines"),
        ("files", "files analyzed", "files_analyzed"),
        ("comment-lines", "comment lines", "comment_lines"),
        ("blank-lines", "blank lines", "blank_lines"),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(metric).alias("metric"),
                F.lit(label).alias("label"),
                F.format_number(F.col(column), 0).alias("value"),
            )
            for metric, label, column in metrics
        ]
    )
    return run_metrics(runs).select(F.inline(rows))


def project_history(runs: DataFrame, root: str) -> DataFrame:
    """Number of scans of a root and facts of the newest."""
    facts = F.struct("run_id", "timestamp_utc", "code_lines", "git_branch", "git_commit")
    return (
        runs.where(F.array_contains("input_roots", root))
        .agg(
            F.count("*").alias("scan_count"),
            F.max_by(facts, F.struct("timestamp_utc", "run_id")).alias("last"),
        )
        .select(
            "scan_count",
            F.col("last.run_id").alias("last_scan_id"),
            fixed_offset_time(F.col("last.timestamp_utc"), seconds=False).alias("last_scan_timestamp"),
            F.col("last.code_lines").alias("last_scan_code_lines"),
            F.col("last.git_branch").alias("last_git_branch"),
            F.col("last.git_commit").alias("last_git_commit"),
        )
    )


def order_pair(runs: DataFrame, first: str, second: str) -> DataFrame:
    """Of two runs the older is the baseline; `first` when both are as old."""
    run, ts = F.col("run_id"), F.col("timestamp_utc")
    times = runs.where(run.isin(first, second)).agg(
        F.max(F.when(run == first, ts)).alias("a"), F.max(F.when(run == second, ts)).alias("b")
    )
    forward = F.col("a") <= F.col("b")
    return times.select(
        F.when(forward, first).otherwise(second).alias("baseline_run_id"),
        F.when(forward, second).otherwise(first).alias("current_run_id"),
    )


def artifact_lookup(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Artifact paths of runs; a missing PDF path is the report.pdf beside the
    other artifacts when that is listed."""
    folder = F.coalesce(parent(F.coalesce("html_path", "json_path", "pdf_path")), F.lit(""))
    candidate = F.concat_ws("/", F.nullif(folder, F.lit("")), F.lit("report.pdf"))
    located = runs.select(
        "run_id",
        folder.alias("output_dir"),
        "html_path",
        "json_path",
        "pdf_path",
        candidate.alias("_candidate"),
        F.col("project_label").alias("report_title"),
    )
    return _flagged(located, artifacts, "_candidate", "_listed").select(
        "run_id",
        "output_dir",
        "html_path",
        F.coalesce("pdf_path", F.when(F.col("_listed"), F.col("_candidate"))).alias("pdf_path"),
        "json_path",
        "report_title",
    )


def history_rows(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Runs as the history table shows them."""
    flagged = _flagged(_flagged(runs, artifacts, "html_path", "has_html"), artifacts, "json_path", "has_json")
    return flagged.select(
        "run_id",
        short_run_id(F.col("run_id")).alias("run_id_short"),
        fixed_offset_time(F.col("timestamp_utc"), seconds=False).alias("timestamp"),
        "project_label",
        F.coalesce(F.try_element_at("input_roots", F.lit(1)), F.lit("")).alias("project_path"),
        "files_analyzed",
        "files_skipped",
        "code_lines",
        "comment_lines",
        "blank_lines",
        F.coalesce("git_branch", F.lit("")).alias("git_branch"),
        F.coalesce("git_commit", F.lit("")).alias("git_commit"),
        "has_html",
        "has_json",
    )


def link_report(runs: DataFrame, reports: DataFrame, stored: DataFrame) -> DataFrame:
    """Attach report files to the history.

    A report goes to the newest run with an artifact in the report's
    directory.  Reports that match no run bring in the run of the stored
    `result.json` beside them, without git facts.  `stored` has the columns of
    runs, keyed by `json_path`.
    """
    hung = reports.select(F.col("path").alias("report"), parent(F.col("path")).alias("folder"))
    sides = F.array_distinct(F.array_compact(F.array(parent(F.col("json_path")), parent(F.col("html_path")))))
    owners = (
        runs.select("run_id", "timestamp_utc", F.explode(sides).alias("folder"))
        .join(hung.select("folder").distinct(), "folder", "left_semi")
        .groupBy("folder")
        .agg(F.max_by("run_id", F.struct("timestamp_utc", "run_id")).alias("run_id"))
    )
    matched = hung.join(owners, "folder")
    chosen = matched.groupBy("run_id").agg(F.max("report").alias("_report"))
    linked = runs.join(chosen, "run_id", "left").withColumn("html_path", F.coalesce("_report", "html_path"))
    orphans = hung.join(owners, "folder", "left_anti").groupBy("folder").agg(F.max("report").alias("_report"))
    adopted = (
        stored.withColumn("folder", parent(F.col("json_path")))
        .where(F.endswith("json_path", F.lit("/result.json")))
        .join(orphans, "folder")
        .withColumns(
            {
                "html_path": F.col("_report"),
                "pdf_path": F.lit(None).cast("string"),
                **{name: F.lit(None).cast("string") for name in ("git_branch", "git_commit", "git_author", "git_tags")},
            }
        )
    )
    return register_run(linked.select(*runs.columns), adopted.select(*runs.columns))


def history_filter(runs: DataFrame, project: str = "", branch: str = "") -> DataFrame:
    """Project substring, ignoring case, and exact branch; empty means all."""
    project = project.strip().lower()
    if project:
        runs = runs.where(F.contains(F.lower("project_label"), F.lit(project)))
    return runs.where(F.coalesce("git_branch", F.lit("")) == branch) if branch else runs


def table_sort(rows: DataFrame, column: str, tie: str, ascending: bool = True) -> DataFrame:
    """Numbers by value, text ignoring case, with a unique tie-break."""
    is_text = dict(rows.dtypes)[column] == "string"
    key: Column = F.lower(column) if is_text else F.col(column)
    return rows.orderBy(key.asc() if ascending else key.desc(), tie)


def paginate(sorted_rows: DataFrame, page: int, per_page: int = 25) -> DataFrame:
    return sorted_rows.offset((page - 1) * per_page).limit(per_page)
