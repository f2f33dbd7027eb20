"""Totals per run, language and submodule.

All are plain hash aggregates over file records with map-side partial sums, so
a hot language or run costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescope.operators.languages import enum_order
from linescope.operators.warnings import numbered

ANALYZED = ["analyzed_exact", "analyzed_best_effort"]
_SUMMED = ["total_physical_lines", "code_lines", "comment_lines", "blank_lines", "mixed_lines_separate"]


def is_analyzed() -> Column:
    return F.col("status").isin(ANALYZED)


def analyzed(records: DataFrame) -> DataFrame:
    return records.where(is_analyzed())


def skipped(records: DataFrame) -> DataFrame:
    return records.where(~is_analyzed())


def _sums(condition: Column | None = None, mixed: bool = True) -> list[Column]:
    values = {
        "total_physical_lines": F.col("raw.total_physical_lines"),
        "code_lines": F.col("effective.code_lines"),
        "comment_lines": F.col("effective.comment_lines"),
        "blank_lines": F.col("effective.blank_lines"),
        "mixed_lines_separate": F.col("effective.mixed_lines_separate"),
    }
    if not mixed:
        del values["mixed_lines_separate"]
    return [
        F.coalesce(F.sum(value if condition is None else F.when(condition, value)), F.lit(0)).alias(name)
        for name, value in values.items()
    ]


def run_totals(records: DataFrame, *keys: str) -> DataFrame:
    """Files considered, analysed and skipped, and line sums of the analysed."""
    return records.groupBy(*keys).agg(
        F.count("*").alias("files_considered"),
        F.count_if(is_analyzed()).alias("files_analyzed"),
        F.count_if(~is_analyzed()).alias("files_skipped"),
        *_sums(is_analyzed()),
    )


def language_totals(records: DataFrame, *keys: str) -> DataFrame:
    """Totals per language; `enum_order` is the reporting order."""
    return (
        analyzed(records)
        .groupBy(*keys, "language")
        .agg(F.count("*").alias("files"), *_sums())
        .withColumn("enum_order", enum_order(F.col("language")))
    )


def submodule_totals(records: DataFrame, submodules: DataFrame, *keys: str) -> DataFrame:
    """Totals per submodule that has files, with its place in .gitmodules."""
    totals = (
        analyzed(records)
        .where(F.col("submodule").isNotNull())
        .groupBy(*keys, "submodule")
        .agg(F.count("*").alias("files_analyzed"), *_sums(mixed=False))
    )
    return _placed(totals, submodules, *keys)


def _placed(totals: DataFrame, submodules: DataFrame, *keys: str) -> DataFrame:
    """Totals with the path and place of their submodule."""
    order = submodules.groupBy(F.col("name").alias("submodule")).agg(
        F.min(F.struct("ord", F.col("path").alias("relative_path"))).alias("_first")
    )
    return totals.join(order, "submodule").select(
        *keys, "submodule", "_first.relative_path", *totals.columns[len(keys) + 1:], "_first.ord"
    )


def submodule_language_totals(records: DataFrame, *keys: str) -> DataFrame:
    """Totals per submodule and language, reported by language name."""
    return (
        analyzed(records)
        .where(F.col("submodule").isNotNull())
        .groupBy(*keys, "submodule", "language")
        .agg(F.count("*").alias("files"), *_sums())
    )


def submodule_run(records: DataFrame, submodules: DataFrame, name: str) -> DataFrame:
    """One submodule as a run of its own: nothing skipped, mixed lines not kept."""
    totals = submodule_totals(records.where(F.col("submodule") == name), submodules)
    return totals.select(
        "submodule",
        F.col("files_analyzed").alias("files_considered"),
        "files_analyzed",
        F.lit(0).cast("bigint").alias("files_skipped"),
        "total_physical_lines",
        "code_lines",
        "comment_lines",
        "blank_lines",
        F.lit(0).cast("bigint").alias("mixed_lines_separate"),
    )


# Rows of `all_totals`: what a row stands for.
LEVELS = ["run", "language", "submodule", "submodule_language"]


def all_totals(records: DataFrame, *keys: str) -> DataFrame:
    """Totals of runs, languages, submodules and languages of submodules from one
    aggregate over grouping sets: one scan and one shuffle.

    `level` says what a row stands for; the columns it does not have are null.
    The result has a row for each of these things, so it can be kept (a
    checkpoint, a saved table) and the `..._level` functions taken from it.
    """
    marks = {"language": F.when(is_analyzed(), F.col("language")), "submodule": F.when(is_analyzed(), F.col("submodule"))}
    marked = records.withColumns(marks)
    sets = [[*keys], [*keys, "language"], [*keys, "submodule"], [*keys, "submodule", "language"]]
    level = (
        F.when(F.grouping("language") + F.grouping("submodule") == 2, LEVELS[0])
        .when(F.grouping("submodule") == 1, LEVELS[1])
        .when(F.grouping("language") == 1, LEVELS[2])
        .otherwise(LEVELS[3])
    )
    totals = marked.groupingSets(sets, *keys, "language", "submodule").agg(
        level.alias("level"),
        F.count("*").alias("files_considered"),
        F.count_if(is_analyzed()).alias("files_analyzed"),
        F.count_if(~is_analyzed()).alias("files_skipped"),
        *_sums(is_analyzed()),
    )
    # Skipped files have no language and files outside of submodules no submodule;
    # these groups count at the run alone.
    whole = F.col("level") == LEVELS[0]
    in_submodule = (F.col("level") == LEVELS[1]) | F.col("submodule").isNotNull()
    return totals.where(whole | ((F.col("files_analyzed") > 0) & in_submodule))


def run_level(totals: DataFrame, *keys: str) -> DataFrame:
    """`run_totals` from `all_totals`."""
    shown = ["files_considered", "files_analyzed", "files_skipped", *_SUMMED]
    return totals.where(F.col("level") == LEVELS[0]).select(*keys, *shown)


def language_level(totals: DataFrame, *keys: str) -> DataFrame:
    """`language_totals` from `all_totals`."""
    return totals.where(F.col("level") == LEVELS[1]).select(
        *keys, "language", F.col("files_analyzed").alias("files"), *_SUMMED, enum_order(F.col("language")).alias("enum_order")
    )


def submodule_level(totals: DataFrame, submodules: DataFrame, *keys: str) -> DataFrame:
    """`submodule_totals` from `all_totals`."""
    counted = totals.where(F.col("level") == LEVELS[2]).select(*keys, "submodule", "files_analyzed", *_SUMMED[:-1])
    return _placed(counted, submodules, *keys)


def submodule_language_level(totals: DataFrame, *keys: str) -> DataFrame:
    """`submodule_language_totals` from `all_totals`."""
    return totals.where(F.col("level") == LEVELS[3]).select(*keys, "submodule", "language", F.col("files_analyzed").alias("files"), *_SUMMED)


def quality_gate(records: DataFrame, fail_on_warnings: bool = False, fail_below: int | None = None) -> DataFrame:
    """One row per requested check: exit code, whether it passed, value, limit."""
    values = records.agg(
        F.coalesce(F.sum(F.size("warnings").cast("bigint")), F.lit(0)).alias("warnings"),
        F.coalesce(F.sum(F.when(is_analyzed(), F.col("effective.code_lines"))), F.lit(0)).alias("code"),
    )
    warned, code = F.col("warnings"), F.col("code")
    checks = []
    if fail_on_warnings:
        checks.append(("no_warnings", 2, warned == 0, warned, 0))
    if fail_below is not None:
        checks.append(("code_lines", 3, code >= fail_below, code, fail_below))
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("check"),
                F.lit(exit_code).alias("exit_code"),
                passed.alias("passed"),
                value.alias("value"),
                F.lit(limit).cast("bigint").alias("limit"),
            )
            for name, exit_code, passed, value, limit in checks
        ]
    )
    return values.select(F.inline(rows))


def sort_files(records: DataFrame) -> DataFrame:
    """Records in report order with their `number`, from 1.  Pass saved records:
    sorting reads them twice."""
    return numbered(records, "relative_path", "path")


def file_row_view(records: DataFrame) -> DataFrame:
    """File records as the report shows them."""
    shown = F.replace(F.initcap(F.replace(F.col("status"), F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))
    return records.select(
        "relative_path",
        F.coalesce("language", F.lit("-")).alias("language"),
        "raw.total_physical_lines",
        "effective.*",
        shown.alias("status"),
        F.lower(shown).alias("status_class"),
        F.array_join("warnings", "; ").alias("warnings"),
    )
