"""From a file table to file records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescope.operators.classify import classify, parse_mode, parse_warnings, raw_counts
from linescope.operators.counts import effective_counts
from linescope.operators.ignore import apply_ignore_rules, parse_ignore_files
from linescope.operators.policy import (
    content_rules,
    is_vendor,
    path_rules,
    rule_status,
    rule_warning,
    visible,
)
from linescope.settings import Settings


def analyze_files(
    files: DataFrame,
    settings: Settings | None = None,
    run_id: str | Column = "",
    ignore_files: DataFrame | None = None,
    stop_early: bool = True,
) -> DataFrame:
    """File records of a file table: one narrow stage, no shuffle.

    `run_id` is a value, or a column of the file table when it holds several
    runs.  `ignore_files` (dir, kind, text and, with several, root) are the ignore
    files of the roots; they are a separate small table, so honoring them does
    not read the contents of all files a second time.  `stop_early=False` leaves
    files that the settings do not allow to a `Gate`.
    """
    settings = settings or Settings()
    analysis = settings.analysis
    if settings.discovery.ignore_hidden_files:
        files = visible(files)
    if settings.discovery.honor_ignore_files and ignore_files is not None:
        files = apply_ignore_rules(files, parse_ignore_files(ignore_files))
    selected = content_rules(path_rules(files, settings), settings, stop_early)
    classified = classify(selected).withColumn("raw", raw_counts(F.col("line_codes")))
    open_ = F.col("rule").isNull()
    block, string = F.col("unclosed_block"), F.col("unclosed_string")
    best_effort = block | string
    return classified.select(
        (F.lit(run_id) if isinstance(run_id, str) else run_id).alias("run_id"),
        "path",
        "relative_path",
        F.when(open_, F.col("language")).alias("language"),
        F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"),
        F.when(open_, F.col("encoding")).alias("detected_encoding"),
        "raw",
        effective_counts(
            F.col("raw"), analysis.mixed_line_policy, analysis.python_docstrings_as_comments
        ).alias("effective"),
        F.when(~open_, rule_status(F.col("rule")))
        .when(best_effort, "analyzed_best_effort")
        .otherwise("analyzed_exact")
        .alias("status"),
        F.when(~open_, F.array(rule_warning(F.col("rule"), F.col("language"), settings)))
        .otherwise(F.concat(F.col("decode_warnings"), parse_warnings(block, string)))
        .alias("warnings"),
        F.lit(False).alias("generated"),
        F.lit(False).alias("minified"),
        (open_ & is_vendor(F.col("path"))).alias("vendor"),
        F.when(open_, parse_mode(block, string)).alias("parse_mode"),
        F.lit(None).cast("string").alias("submodule"),
    )
