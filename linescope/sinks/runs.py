"""Writers.  Every table is written in parallel; nothing is merged into one
file on the driver."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linescope.functions.text import utc_time_text
from linescope.operators.gate import Gate
from linescope.operators.history import register_run
from linescope.operators.languages import json_name
from linescope.operators.rollup import (
    all_totals,
    analyzed,
    language_level,
    language_totals,
    run_level,
    run_totals,
    skipped,
    submodule_language_level,
    submodule_level,
)
from linescope.operators.delta import sort_deltas, status_counts
from linescope.schemas import FILE_RECORDS
from linescope.session import checkpoint_dir
from linescope.sources.runs import read_registry
from linescope.versions import latest_version, write_version


def run_id(now: datetime | None = None) -> str:
    """A new run id: minute of the run and a random part."""
    now = now or datetime.now(timezone.utc)
    return f"{now:%Y%m%d-%H%M}-{uuid.uuid4().hex}"


def write_table(rows: DataFrame, path: str) -> None:
    """One CSV table with a header, CRLF line ends and doubled quotes."""
    rows.write.mode("overwrite").csv(path, header=True, lineSep="\r\n", quote='"', escape='"', emptyValue="")


def metric_rows(one_row: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """A one-row frame as (Metric, Value) rows in the given order."""
    pairs = F.array(
        *[F.struct(F.lit(name).alias("Metric"), value.cast("string").alias("Value")) for name, value in metrics.items()]
    )
    return one_row.select(F.inline(pairs))


def summary_table(records: DataFrame, run: str, timestamp: datetime, title: str) -> DataFrame:
    return metric_rows(
        run_totals(records),
        {
            "Run ID": F.lit(run),
            "Timestamp": utc_time_text(F.lit(timestamp)),
            "Report Title": F.lit(title),
            "Files Analyzed": F.col("files_analyzed"),
            "Files Skipped": F.col("files_skipped"),
            "Physical Lines": F.col("total_physical_lines"),
            "Code Lines": F.col("code_lines"),
            "Comment Lines": F.col("comment_lines"),
            "Blank Lines": F.col("blank_lines"),
            "Mixed Lines (separate)": F.col("mixed_lines_separate"),
        },
    )


def language_table(records: DataFrame) -> DataFrame:
    return language_totals(records).orderBy("enum_order").select(
        F.col("language").alias("Language"),
        F.col("files").alias("Files"),
        F.col("total_physical_lines").alias("Physical Lines"),
        F.col("code_lines").alias("Code Lines"),
        F.col("comment_lines").alias("Comment Lines"),
        F.col("blank_lines").alias("Blank Lines"),
        F.col("mixed_lines_separate").alias("Mixed Lines"),
    )


def file_table(records: DataFrame) -> DataFrame:
    return analyzed(records).orderBy("relative_path", "path").select(
        F.col("relative_path").alias("Path"),
        F.coalesce("language", F.lit("")).alias("Language"),
        F.col("size_bytes").alias("Size (bytes)"),
        F.col("effective.code_lines").alias("Code Lines"),
        F.col("effective.comment_lines").alias("Comment Lines"),
        F.col("effective.blank_lines").alias("Blank Lines"),
        F.col("raw.total_physical_lines").alias("Physical Lines"),
        F.col("generated").alias("Generated"),
        F.col("minified").alias("Minified"),
        F.col("vendor").alias("Vendor"),
    )


def skipped_table(records: DataFrame) -> DataFrame:
    shown = F.replace(F.initcap(F.replace(F.col("status"), F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))
    return skipped(records).orderBy("relative_path", "path").select(
        F.col("relative_path").alias("Path"), shown.alias("Status"), F.col("size_bytes").alias("Size (bytes)")
    )


def write_run_csv(records: DataFrame, path: str, run: str, timestamp: datetime, title: str) -> None:
    """The three sections of the run export as three CSV tables."""
    write_table(summary_table(records, run, timestamp, title), f"{path}/summary")
    write_table(language_table(records), f"{path}/by_language")
    write_table(file_table(records), f"{path}/per_file")


def write_skipped_table(records: DataFrame, path: str) -> None:
    write_table(skipped_table(records), path)


def _with_counts(summary: DataFrame, deltas: DataFrame) -> DataFrame:
    """The one-row summary with the status counts beside it."""
    counts = status_counts(deltas)
    row = counts.select(F.struct(*counts.columns)).scalar()
    return summary.withColumn("_counts", row).select(*summary.columns, "_counts.*")


def diff_summary_table(summary: DataFrame, deltas: DataFrame) -> DataFrame:
    return metric_rows(
        _with_counts(summary, deltas),
        {
            "Baseline Run": F.col("baseline_run_id"),
            "Current Run": F.col("current_run_id"),
            "Files Added": F.col("files_added"),
            "Files Removed": F.col("files_removed"),
            "Files Modified": F.col("files_modified"),
            "Files Unchanged": F.col("files_unchanged"),
            "Code Δ": F.col("code_lines_delta"),
            "Comment Δ": F.col("comment_lines_delta"),
            "Blank Δ": F.col("blank_lines_delta"),
            "Total Δ": F.col("total_lines_delta"),
        },
    )


def diff_file_table(deltas: DataFrame) -> DataFrame:
    columns = [F.initcap("status").alias("Status"), F.col("relative_path").alias("Path"),
               F.coalesce("language", F.lit("")).alias("Language")]
    for short in ("code", "comment", "blank"):
        label = short.capitalize()
        columns += [
            F.col(f"baseline_{short}").alias(f"Baseline {label}"),
            F.col(f"current_{short}").alias(f"Current {label}"),
            F.col(f"{short}_delta").alias(f"{label} Δ"),
        ]
    return sort_deltas(deltas).select(*columns, F.col("total_delta").alias("Total Δ"))


def write_diff_csv(summary: DataFrame, deltas: DataFrame, path: str) -> None:
    write_table(diff_summary_table(summary, deltas), f"{path}/summary")
    write_table(diff_file_table(deltas), f"{path}/file_deltas")


def write_diff_json(summary: DataFrame, deltas: DataFrame, path: str) -> None:
    """Summary with status counts, and one JSON row per file."""
    _with_counts(summary, deltas).write.mode("overwrite").json(f"{path}/summary", ignoreNullFields=False)
    sort_deltas(deltas).write.mode("overwrite").json(f"{path}/file_deltas", ignoreNullFields=False)


def save_records(records: DataFrame, path: str, gate: Gate | None = None) -> DataFrame:
    """Write file records by run and return them as saved.

    Analysis is the costly step: every sort, list and export that follows
    should start from what this returns.  A run that is saved again replaces
    its rows.  A `gate` is fed while the records are written and needs no pass
    of its own; ask it afterwards.
    """
    spark = records.sparkSession
    _by_run(records if gate is None else gate.watch(records), f"{path}/file_records")
    return spark.read.schema(records.schema).parquet(f"{path}/file_records").select(*records.columns)


def save_bucketed(records: DataFrame, path: str, run: str, buckets: int) -> DataFrame:
    """Write the records of one run in buckets by relative path, sorted, and
    return them as saved.  Runs with as many buckets are compared without
    moving their records (`file_delta`)."""
    name = _bucketed_name(path, run, buckets)
    spark = records.sparkSession
    spark.sql(f"drop table if exists {name}")
    place = _bucketed_path(path, run, buckets)
    columns = records.select(*[field.split(" ")[0] for field in _top_fields(FILE_RECORDS)])
    # One task a bucket, so a bucket is one sorted file.
    dealt = columns.where(F.col("run_id") == run).repartition(buckets, "relative_path")
    dealt.write.bucketBy(buckets, "relative_path").sortBy("relative_path").mode("overwrite").option("path", place).saveAsTable(name)
    return spark.table(name)


def open_bucketed(spark: SparkSession, path: str, run: str, buckets: int) -> DataFrame:
    """The records that `save_bucketed` wrote, in any session."""
    name = _bucketed_name(path, run, buckets)
    spark.sql(
        f"create table if not exists {name} ({FILE_RECORDS}) using parquet "
        f"clustered by (relative_path) sorted by (relative_path) into {buckets} buckets location '{_bucketed_path(path, run, buckets)}'"
    )
    return spark.table(name)


def _bucketed_path(path: str, run: str, buckets: int) -> str:
    return f"{path}/run={hashlib.sha256(run.encode()).hexdigest()[:32]}/buckets={buckets}"


def _bucketed_name(path: str, run: str, buckets: int) -> str:
    return "records_" + hashlib.sha256(f"{path}|{run}|{buckets}".encode()).hexdigest()[:32]


def _top_fields(shape: str) -> list[str]:
    """Fields of a schema, those inside of structs left whole."""
    fields, depth = [""], 0
    for char in shape:
        depth += (char == "<") - (char == ">")
        if char == "," and not depth:
            fields.append("")
        else:
            fields[-1] += char
    return [field.strip() for field in fields]


def _by_run(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def write_run_tables(records: DataFrame, path: str) -> DataFrame:
    """File records and totals as parquet, by run; returns the saved records.
    A run that is saved again replaces its rows in all three tables.  The
    records are read once for the totals."""
    checkpoint_dir(records.sparkSession)
    saved = save_records(records, path)
    totals = all_totals(saved, "run_id").checkpoint()
    _by_run(language_level(totals, "run_id"), f"{path}/language_totals")
    _by_run(run_level(totals, "run_id"), f"{path}/run_totals")
    return saved


def file_json() -> Column:
    return F.struct(
        "path",
        "relative_path",
        json_name(F.col("language")).alias("language"),
        "size_bytes",
        "detected_encoding",
        F.col("raw").alias("raw_line_categories"),
        F.col("effective").alias("effective_counts"),
        "status",
        "warnings",
        "generated",
        "minified",
        "vendor",
        "parse_mode",
        "submodule",
    )


def write_run_json(records: DataFrame, path: str) -> None:
    """A run in the interchange names, one JSON row per file, with totals in
    separate tables.

    The files of a run are unbounded, so they are never nested into one
    document.
    """
    records.select("run_id", file_json().alias("file")).select("run_id", "file.*").write.mode("overwrite").json(
        f"{path}/files"
    )
    run_totals(records, "run_id").write.mode("overwrite").json(f"{path}/summary_totals")
    language_totals(records, "run_id").withColumn("language", json_name(F.col("language"))).write.mode(
        "overwrite"
    ).json(f"{path}/totals_by_language")


def write_run_document(
    records: DataFrame,
    run: DataFrame,
    path: str,
    submodules: DataFrame | None = None,
    warnings: DataFrame | None = None,
    version: str = "",
    environment: dict[str, str] | None = None,
) -> None:
    """A saved run as tables: `run`, one row with all run-level fields; `files`,
    one row per file; `warnings`, one row each.

    `records` should be saved ones, of this run only; `run` is its history row.
    Languages and submodules are bounded and nested into the run's row; files
    and warnings are not bounded and stay rows.  `submodules` (ord, name, path)
    are the definitions the records were tagged with.
    """
    checkpoint_dir(records.sparkSession)
    env = environment or {}
    counted = all_totals(records.select("status", "language", "submodule", "raw", "effective")).checkpoint()
    fields = ("operating_system", "architecture", "runtime_mode", "initiator_username", "initiator_hostname")
    totals = run_level(counted)
    nothing = F.struct(*[F.lit(0).cast("bigint").alias(name) for name in totals.columns])  # a run without files
    languages = language_level(counted).withColumn("language", json_name(F.col("language")))
    shown = [name for name in languages.columns if name != "enum_order"]
    rows = F.array_sort(F.collect_list(F.struct("enum_order", *shown)))
    by_language = languages.agg(F.transform(rows, lambda r: r.dropFields("enum_order"))).scalar()
    document = run.select(
        F.struct(F.lit("linescope").alias("name"), F.lit(version).alias("version"), "run_id", "timestamp_utc").alias("tool"),
        F.struct(*[F.lit(env.get(name)).cast("string").alias(name) for name in fields]).alias("environment"),
        F.col("settings_json").alias("effective_configuration"),
        "input_roots",
        F.coalesce(totals.select(F.struct(*totals.columns)).scalar(), nothing).alias("summary_totals"),
        by_language.alias("totals_by_language"),
        F.col("git_commit").alias("git_commit_long"),
        F.substring("git_commit", 1, 7).alias("git_commit_short"),
        "git_branch",
        F.col("git_author").alias("git_commit_author"),
        "git_tags",
    )
    if submodules is not None:
        inner = submodule_language_level(counted).withColumn("language", json_name(F.col("language")))
        nested = inner.groupBy("submodule").agg(
            F.array_sort(F.collect_list(F.struct(*[name for name in inner.columns if name != "submodule"]))).alias("language_summaries")
        )
        outer = submodule_level(counted, submodules).join(nested, "submodule")
        row = F.struct("ord", F.col("submodule").alias("name"), *[name for name in outer.columns if name not in ("submodule", "ord")])
        summaries = outer.agg(F.array_sort(F.collect_list(row)).alias("s")).select(F.transform("s", lambda r: r.dropFields("ord"))).scalar()
        document = document.withColumn("submodule_summaries", summaries)
    document.write.mode("overwrite").json(f"{path}/run", ignoreNullFields=False)
    records.select(file_json().alias("file")).select("file.*").write.mode("overwrite").json(f"{path}/files")
    if warnings is not None:
        warnings.select("path", "relative_path", "warning").write.mode("overwrite").json(f"{path}/warnings")


def trend_summary(records: DataFrame, *keys: str) -> DataFrame:
    return run_totals(records, *keys).select(*keys, "code_lines", "comment_lines", "blank_lines", "files_analyzed")


def trend_languages(records: DataFrame, *keys: str) -> DataFrame:
    return language_totals(records, *keys).select(*keys, json_name(F.col("language")).alias("language"), "code_lines")


def save_registry(runs: DataFrame, path: str) -> int:
    """Write the history as the next version and return its number.  `runs` may
    come from an older version at the same path.

    What others registered since `runs` was read is replaced with the rest; see
    `update_registry` for a change on top of whatever is there.
    """
    spark = runs.sparkSession
    while True:
        number = latest_version(spark, path) + 1
        if write_version(runs, path, number):
            return number


def update_registry(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], attempts: int = 20) -> int:
    """Save what `change` makes of the newest history, and return its version.

    Writers do not wait for each other: one that finds its number taken reads
    the newer history and makes its change again, so no registered run is lost.
    """
    for _ in range(attempts):
        number = latest_version(spark, path)
        if write_version(change(read_registry(spark, path, number)), path, number + 1):
            return number + 1
    raise RuntimeError(f"{path}: other writers came first {attempts} times")


def add_runs(spark: SparkSession, path: str, new: DataFrame) -> int:
    """Register runs in the saved history; one of the same id is replaced."""
    return update_registry(spark, path, lambda runs: register_run(runs, new.select(*runs.columns)))
