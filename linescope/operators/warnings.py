"""Warnings of a run: flat list, buckets, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linescope.functions.paths import extension
from linescope.operators.languages import lookup
from linescope.session import checkpoint_dir

# Fixed values.
UNSUPPORTED = "unsupported or undetected language"
OTHER = "Other warnings"

# Fixed values, in test order: label, substrings, tone, detail.
BUCKETS = [
    ("Unsupported or undetected text formats", (UNSUPPORTED,), "tone-neutral",
     "These are usually docs, manifests, templates, or formats that have not been promoted into first-class "
     "analyzers yet."),
    ("Large files skipped by size limit", ("file exceeded max_file_size_bytes",), "tone-warn",
     "Artifacts and archives larger than the configured cap were skipped intentionally to keep runs fast and "
     "predictable."),
    ("Binary assets skipped", ("binary file skipped by default",), "tone-neutral",
     "Binary bundles are excluded from source counting unless you explicitly opt into them."),
    ("Minified files skipped by policy", ("minified file skipped by policy",), "tone-warn",
     "Generated and minified assets are being filtered out to avoid inflating code totals."),
    ("Vendor files skipped by policy", ("vendor file skipped by policy",), "tone-neutral",
     "Vendored third-party code is being excluded so the report stays focused on repository-owned source."),
    ("Best-effort parse results", ("best effort", "unclosed string literal"), "tone-danger",
     "These files were analyzed, but the parser hit malformed or ambiguous content and fell back to a "
     "best-effort count."),
    (OTHER, (), "tone-danger",
     "Warnings in this bucket need manual review because they do not match one of the common policy-based "
     "skip reasons."),
]

# Fixed values, in test order: label, path endings, recommendation.
OPPORTUNITIES = [
    ("Documentation / text", (".md", "README", "README.md", "LICENSE"),
     "Add a docs/text classification path so README, LICENSE, and markdown stop appearing as source-language misses."),
    ("JSON manifests and config", (".json", ".spdx.json", "devkit.json"),
     "Promote JSON manifests into a metadata bucket or add a light-weight JSON analyzer if you want them counted "
     "separately."),
    ("Project metadata and packaging", (".toml", "MANIFEST.in", "requirements.txt"),
     "Treat TOML, MANIFEST.in, and requirements files as metadata so they become intentional non-source records "
     "instead of generic warnings."),
    ("HTML templates", (".html",),
     "Add HTML/template detection for web views and server-rendered pages to reduce unsupported-template noise."),
    ("Plain text assets", (".txt",),
     "Classify text asset placeholders as plain text or ignore them by policy."),
]
# Fixed value.
REVIEW = (
    "Review this bucket and either map it to an existing metadata class or create a dedicated analyzer when it "
    "truly represents source."
)


def run_warnings(records: DataFrame, *keys: str) -> DataFrame:
    """One row per warning, with the path in front of its text.

    The full path comes along: it tells apart files of several roots that
    share a relative path, so sorted warnings never pile up on one key.
    """
    return records.select(*keys, "path", "relative_path", F.explode("warnings").alias("_w")).select(
        *keys, "path", "relative_path", F.concat_ws(": ", "relative_path", "_w").alias("warning")
    )


def discovery_warnings(errors: DataFrame) -> DataFrame:
    """Warnings of a walk's errors (path, error), shaped like `run_warnings`."""
    return errors.select("path", F.col("path").alias("relative_path"), F.concat_ws(": ", F.lit("discovery warning"), "error").alias("warning"))


def _first_match(rules: list[tuple[Column, str]], default: Column | str) -> Column:
    found = default if isinstance(default, Column) else F.lit(default)
    for hit, label in reversed(rules):
        found = F.when(hit, label).otherwise(found)
    return found


def bucket_label(warning: Column) -> Column:
    rules = []
    for label, hints, _, _ in BUCKETS[:-1]:
        hit = F.lit(False)
        for hint in hints:
            hit = hit | F.contains(warning, F.lit(hint))
        rules.append((hit, label))
    return _first_match(rules, OTHER)


def warning_buckets(warnings: DataFrame) -> DataFrame:
    """Warnings per bucket with the bucket's tone and detail; report order is
    by label."""
    return warnings.groupBy(bucket_label(F.col("warning")).alias("label")).agg(F.count("*").alias("count")).select(
        "label",
        "count",
        lookup({label: tone for label, _, tone, _ in BUCKETS}, F.col("label")).alias("tone_class"),
        lookup({label: detail for label, _, _, detail in BUCKETS}, F.col("label")).alias("detail"),
    )


def support_opportunities(warnings: DataFrame) -> DataFrame:
    """Unsupported files by what could be done about them; report order is
    count descending, then label."""
    path = F.when(F.contains("warning", F.lit(":")), F.trim(F.substring_index("warning", ":", 1)))
    rules = []
    for label, endings, _ in OPPORTUNITIES:
        hit = F.lit(False)
        for ending in endings:
            hit = hit | F.endswith(F.col("_path"), F.lit(ending))
        rules.append((hit, label))
    # Labels of what no ending names.
    rest = F.when(extension(F.col("_path")) == "", "Extensionless or custom text files").otherwise(
        "Other unsupported text formats"
    )
    return (
        warnings.where(F.contains("warning", F.lit(UNSUPPORTED)))
        .select(path.alias("_path"))
        .where(F.col("_path") != "")
        .groupBy(_first_match(rules, rest).alias("label"))
        .agg(F.count("*").alias("count"))
        .withColumn(
            "recommendation",
            F.coalesce(lookup({label: text for label, _, text in OPPORTUNITIES}, F.col("label")), F.lit(REVIEW)),
        )
    )


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Number all rows from 1 in a total order without gathering them.

    The order should be unique, so that ranges can be cut anywhere.  Rows are
    range-partitioned and sorted; a checkpoint fixes that layout, so the
    per-partition counts and the rows come from the same partitions even
    when executors are lost.  Only one count per partition is windowed.
    """
    checkpoint_dir(rows.sparkSession)
    laid_out = (
        rows.orderBy(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .select(
            "*",
            F.shiftright("_id", 33).alias("_part"),
            F.expr("_id & 8589934591L").alias("_pos"),
        )
        .drop("_id")
        .checkpoint()
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = laid_out.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    return laid_out.join(F.broadcast(offsets), "_part").select(
        *rows.columns, (F.col("_offset") + F.col("_pos") + 1).alias("number")
    )


def number_console(warnings: DataFrame) -> DataFrame:
    """Console lines `[001] warning`, one row per line."""
    order = ("relative_path", "warning", "path")
    return numbered(warnings.select(*order), *order).select(
        "number",
        F.concat(
            F.lit("["),
            F.lpad(F.col("number").cast("string"), F.greatest(F.lit(3), F.length(F.col("number").cast("string"))), F.lit("0")),
            F.lit("] "),
            "warning",
        ).alias("line"),
    )


def warning_preview(warnings: DataFrame, limit: int = 12) -> DataFrame:
    """The first warnings, numbered, with the total and whether more exist."""
    order = ("relative_path", "warning", "path")
    shown = warnings.orderBy(*order).limit(limit)
    number = F.row_number().over(Window.orderBy(*order))  # of at most `limit` rows
    total = warnings.agg(F.count("*")).scalar()
    return (
        shown.select(number.alias("number"), "warning")
        .select("number", F.format_string("[%03d] %s", "number", "warning").alias("line"), total.alias("total"))
        .withColumn("truncated", F.col("total") > limit)
    )
