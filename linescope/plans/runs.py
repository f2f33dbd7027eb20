"""A whole scan: assemble the run, compare it with the one before, register it."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linescope.functions.text import project_label as label_of
from linescope.operators.delta import change_counts, file_delta
from linescope.operators.history import TOTALS, register_run, with_json
from linescope.operators.rollup import analyzed, run_totals
from linescope.schemas import RUNS
from linescope.session import checkpoint_dir
from linescope.settings import Settings

_FACTS = ", ".join(part for part in RUNS.split(", ") if part.split(" ")[0] not in TOTALS)


def run_facts(
    spark: SparkSession,
    run_id: str,
    timestamp: datetime,
    roots: Iterable[str],
    settings: Settings,
    project_label: str | None = None,
    json_path: str | None = None,
    html_path: str | None = None,
    pdf_path: str | None = None,
    branch: str | None = None,
    commit: str | None = None,
    author: str | None = None,
    tags: str | None = None,
) -> DataFrame:
    """What is known of a run beside its files, as one row.  The label comes
    from the first root when none is given."""
    row = (run_id, timestamp, project_label, list(roots), json_path, html_path, pdf_path, branch, commit, author, tags, settings.to_json())
    facts = spark.createDataFrame([row], _FACTS)
    first = F.coalesce(F.try_element_at("input_roots", F.lit(1)), F.lit(""))
    return facts.withColumn("project_label", F.coalesce("project_label", label_of(first)))


def run_rows(records: DataFrame, facts: DataFrame) -> DataFrame:
    """History rows: facts of runs with the totals of their records."""
    totals = run_totals(records, "run_id").select("run_id", *TOTALS)
    names = [part.split(" ")[0] for part in RUNS.split(", ")]
    joined = facts.join(totals, "run_id", "left")
    return joined.select(*[F.coalesce(name, F.lit(0).cast("bigint")).alias(name) if name in TOTALS else name for name in names])


class Scan(NamedTuple):
    """What a scan of a project with a history gives."""

    run: DataFrame  # the history row
    previous: DataFrame  # its newest earlier run with a JSON file, or no row
    deltas: DataFrame | None  # change of every file against that run
    summary: DataFrame  # one row: place, totals, their changes, files and lines changed
    history: DataFrame  # the history with the run registered


def previous_run(run: DataFrame, runs: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, int]:
    """The newest earlier run of the same roots whose JSON exists, as no or one
    row, and the number of such runs.  One aggregate with partial maxima, run
    now: what it gives is one row."""
    own = run.select("input_roots", F.col("timestamp_utc").alias("_now"), F.col("run_id").alias("_id"))
    earlier = with_json(runs, artifacts).where("has_json").join(own, "input_roots")
    earlier = earlier.where((F.col("timestamp_utc") < F.col("_now")) & (F.col("run_id") != F.col("_id")))
    newest = F.max_by(F.struct(*runs.columns), F.struct("timestamp_utc", "run_id"))
    found = earlier.agg(newest.alias("run"), F.count("*").alias("earlier")).first()
    rows = [tuple(found["run"])] if found["run"] is not None else []
    return runs.sparkSession.createDataFrame(rows, runs.schema), found["earlier"]


def scan_with_history(
    facts: DataFrame, saved: DataFrame, runs: DataFrame, artifacts: DataFrame
) -> Scan:
    """Compare and register a run of one row of facts.

    `saved` are the saved file records of all runs, by run; only the partitions
    of this run and the one before are read.  The history is read once for the
    run before, and the change of every file is worked out once and kept.
    """
    checkpoint_dir(saved.sparkSession)
    run_id = facts.first()["run_id"]
    current = saved.where(F.col("run_id") == run_id)
    run = run_rows(current, facts)
    previous, earlier = previous_run(facts, runs, artifacts)
    before = previous.first()  # no or one row, held by the driver
    totals_before = {name: before[name] if before else None for name in TOTALS}
    summary = run.select(
        "run_id",
        "project_label",
        F.lit(before["run_id"] if before else None).cast("string").alias("prev_run_id"),
        F.lit(earlier + 1).cast("bigint").alias("scan_number"),
        *TOTALS,
        *[(F.col(name) - F.lit(value).cast("bigint")).alias(f"{name}_change") for name, value in totals_before.items()],
    )
    deltas = None
    if before:
        baseline = saved.where(F.col("run_id") == before["run_id"])
        deltas = file_delta(analyzed(baseline), analyzed(current)).checkpoint()
        counted = change_counts(deltas)
        row = counted.select(F.struct(*counted.columns)).scalar()
        summary = summary.withColumn("_row", row).select(*summary.columns, "_row.*")
    return Scan(run, previous, deltas, summary, register_run(runs, run))
