"""Comparison of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Report order of the change statuses.
STATUS_ORDER = ["modified", "added", "removed", "unchanged"]

_COUNTS = {"code": "code_lines", "comment": "comment_lines", "blank": "blank_lines"}


def _side(records: DataFrame) -> DataFrame:
    return records.select(
        "relative_path", "language", "path", *[F.col(f"effective.{name}").alias(short) for short, name in _COUNTS.items()]
    )


def baseline_dedupe(baseline: DataFrame, order: str = "path") -> DataFrame:
    """One row per relative path, the last by `order`.

    An aggregate with partial maxima, so copies of one path are reduced
    before they are shuffled.
    """
    payload = [name for name in baseline.columns if name != "relative_path"]
    return baseline.groupBy("relative_path").agg(
        F.max_by(F.struct(*payload), F.col(order)).alias("_last")
    ).select("relative_path", "_last.*")


def file_delta(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Change of every file between two sets of analysed records.

    A left join keeps all current rows; its right side has unique paths, and
    Spark splits hot paths of the left side at run time, which it cannot do
    for a full outer join.  Removed files are an anti join of unique paths.
    """
    base = baseline_dedupe(_side(baseline))
    cur = _side(current).drop("path")
    matched = cur.join(
        base.select("relative_path", *[F.col(short).alias(f"base_{short}") for short in _COUNTS]),
        "relative_path",
        "left",
    )
    found = F.col("base_code").isNotNull()
    kept = matched.select(
        "relative_path",
        "language",
        F.when(~found, "added")
        .when(
            (F.col("code") == F.col("base_code"))
            & (F.col("comment") == F.col("base_comment"))
            & (F.col("blank") == F.col("base_blank")),
            "unchanged",
        )
        .otherwise("modified")
        .alias("status"),
        *[c for short in _COUNTS for c in _pair(short, F.coalesce(f"base_{short}", F.lit(0)), F.col(short))],
    )
    gone = removed_files(base, cur).select(
        "relative_path",
        "language",
        F.lit("removed").alias("status"),
        *[c for short in _COUNTS for c in _pair(short, F.col(short), F.lit(0).cast("bigint"))],
    )
    total = sum((F.col(f"{short}_delta") for short in _COUNTS), F.lit(0))
    return kept.unionByName(gone).withColumn("total_delta", total.cast("bigint"))


def _pair(short: str, base: Column, current: Column) -> list[Column]:
    return [
        base.alias(f"baseline_{short}"),
        current.alias(f"current_{short}"),
        (current - base).alias(f"{short}_delta"),
    ]


def removed_files(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Baseline rows whose path does not occur in the current run."""
    return baseline.join(current.select("relative_path").distinct(), "relative_path", "left_anti")


def path_sets(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Number of paths only in the baseline, only in the current run, in both."""
    sides = (
        baseline.select("relative_path", F.lit(1).alias("b"), F.lit(0).alias("c"))
        .unionByName(current.select("relative_path", F.lit(0).alias("b"), F.lit(1).alias("c")))
        .groupBy("relative_path")
        .agg(F.max("b").alias("b"), F.max("c").alias("c"))
    )
    return sides.agg(
        F.count_if((F.col("b") == 1) & (F.col("c") == 0)).alias("only_baseline"),
        F.count_if((F.col("b") == 0) & (F.col("c") == 1)).alias("only_current"),
        F.count_if((F.col("b") == 1) & (F.col("c") == 1)).alias("in_both"),
    )


def _counts() -> list[Column]:
    return [F.count_if(F.col("status") == name).alias(f"files_{name}") for name in ("added", "removed", "modified", "unchanged")]


def _churn() -> list[Column]:
    status = F.col("status")
    added = F.when(status == "added", F.col("current_code")).when(
        status == "modified", F.greatest("code_delta", F.lit(0))
    )
    removed = F.when(status == "removed", F.col("baseline_code")).when(
        status == "modified", F.greatest(-F.col("code_delta"), F.lit(0))
    )
    return [
        F.coalesce(F.sum(added), F.lit(0)).alias("lines_added"),
        F.coalesce(F.sum(removed), F.lit(0)).alias("lines_removed"),
        F.coalesce(F.sum(F.when(status == "unchanged", F.col("current_code"))), F.lit(0)).alias("lines_unmodified"),
    ]


def _net(sums: DataFrame) -> DataFrame:
    return sums.withColumn("lines_net", F.col("lines_added") - F.col("lines_removed"))


def status_counts(deltas: DataFrame) -> DataFrame:
    return deltas.agg(*_counts())


def line_churn(deltas: DataFrame) -> DataFrame:
    """Code lines added, removed, net and left alone."""
    return _net(deltas.agg(*_churn()))


def change_counts(deltas: DataFrame) -> DataFrame:
    """`status_counts` and `line_churn` in one row and one pass."""
    return _net(deltas.agg(*_counts(), *_churn()))


def summary_delta(runs: DataFrame, baseline_id: str, current_id: str) -> DataFrame:
    """Totals of two runs side by side; the total is in physical lines."""
    fields = {
        "timestamp": "timestamp_utc",
        "files": "files_analyzed",
        "code": "code_lines",
        "comments": "comment_lines",
        "blank": "blank_lines",
        "total": "total_physical_lines",
    }
    run = F.col("run_id")
    both = runs.where(run.isin(baseline_id, current_id)).agg(
        *[
            F.max(F.when(run == run_id, F.col(name))).alias(f"{side}_{short}")
            for side, run_id in (("baseline", baseline_id), ("current", current_id))
            for short, name in fields.items()
        ]
    )

    def change(short: str) -> Column:
        return F.col(f"current_{short}") - F.col(f"baseline_{short}")

    return both.select(
        F.lit(baseline_id).alias("baseline_run_id"),
        F.lit(current_id).alias("current_run_id"),
        "baseline_timestamp",
        "current_timestamp",
        "baseline_files",
        "current_files",
        change("files").alias("files_analyzed_delta"),
        "baseline_code",
        "current_code",
        change("code").alias("code_lines_delta"),
        "baseline_comments",
        "current_comments",
        change("comments").alias("comment_lines_delta"),
        change("blank").alias("blank_lines_delta"),
        change("total").alias("total_lines_delta"),
    )


def status_rank() -> Column:
    return F.array_position(F.array(*[F.lit(name) for name in STATUS_ORDER]), F.col("status"))


def sort_deltas(deltas: DataFrame) -> DataFrame:
    return deltas.orderBy(status_rank(), "relative_path")


def top_changed(deltas: DataFrame, limit: int = 20) -> DataFrame:
    """The first changed files in report order."""
    return sort_deltas(deltas.where(F.col("status") != "unchanged")).limit(limit)


def delta_status_filter(deltas: DataFrame, status: str | None) -> DataFrame:
    return deltas.where(F.col("status") == status) if status else deltas
