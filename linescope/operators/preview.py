"""Directory preview of a project before it is scanned.

The preview knows fewer languages than the analysis; both rules are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescope.functions.paths import (
    ascii_lower,
    ascii_upper,
    directories,
    extension,
    file_name,
    has_component,
    preview_includes_file,
    preview_skips_directory,
)

# File name endings of the preview languages, and of files
# shown as skipped.
PREVIEW_LANGUAGES = {
    "C": ".c .h",
    "C++": ".cpp .cxx .cc .hpp .hh .hxx",
    "C#": ".cs",
    "Python": ".py",
    "Shell": ".sh",
    "PowerShell": ".ps1 .psm1 .psd1",
}
SKIPPED_ENDINGS = ".min.js .lock .png .jpg .jpeg .gif .zip .pdf .pyc .xz .tar .gz"
# Extensions called archives, and directories never opened.
ARCHIVE_EXTENSIONS = "png jpg jpeg gif zip pdf xz gz tar pyc"
CLOSED_DIRECTORIES = [".git", "node_modules", "target"]


def _ends(name: Column, endings: str) -> Column:
    hit = F.lit(False)
    for ending in endings.split():
        hit = hit | F.endswith(name, F.lit(ending))
    return hit


def preview_language(name: Column) -> Column:
    lower = ascii_lower(name)
    return F.coalesce(*[F.when(_ends(lower, ends), language) for language, ends in PREVIEW_LANGUAGES.items()])


def preview_kind(name: Column) -> Column:
    return (
        F.when(preview_language(name).isNotNull(), "supported")
        .when(_ends(ascii_lower(name), SKIPPED_ENDINGS), "skipped")
        .otherwise("unsupported")
    )


def type_label(name: Column) -> Column:
    kind, language, ext = preview_kind(name), preview_language(name), extension(name)
    return (
        F.when(language.isNotNull(), F.concat(language, F.lit(" source")))
        .when((kind == "skipped") & F.endswith(ascii_lower(name), F.lit(".min.js")), "Minified asset")
        .when((kind == "skipped") & ext.isin(ARCHIVE_EXTENSIONS.split()), "Binary or archive")
        .when(kind == "skipped", "Skipped file")
        .when(ext == "", "Unsupported file")
        .otherwise(F.concat(ascii_upper(ext), F.lit(" file")))
    )


def preview_entries(files: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Directories and files the preview may show: relative_path and is_dir.

    A closed or excluded directory hides what is below it.
    """
    include, exclude = list(include), list(exclude)
    rel = F.col("relative_path")
    open_files = files.select("relative_path", directories(rel).alias("_dirs"))
    # A directory is listed when all directories above it are open.
    shut = lambda d: has_component(file_name(d), CLOSED_DIRECTORIES) | preview_skips_directory(d, exclude)
    shut_at = F.array_position(F.transform("_dirs", shut), True)
    seen = F.when(shut_at > 0, F.slice("_dirs", F.lit(1), shut_at.cast("int"))).otherwise(F.col("_dirs"))
    listed = (
        open_files.select(F.explode(seen).alias("relative_path"))
        .distinct()
        .where(~preview_skips_directory(rel, exclude))
        .withColumn("is_dir", F.lit(True))
    )
    shown = open_files.where((shut_at == 0) & preview_includes_file(rel, include, exclude)).select(
        "relative_path", F.lit(False).alias("is_dir")
    )
    return listed.unionByName(shown)


def preview_rows(files: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Every preview entry with its labels, in no order."""
    rel = F.col("relative_path")
    parts = F.split(rel, "/")
    name = file_name(rel)
    return preview_entries(files, include, exclude).select(
        "relative_path",
        F.when(F.contains(rel, F.lit("/")), F.regexp_replace(rel, "/[^/]*$", "")).alias("parent"),
        F.size(parts).alias("depth"),
        "is_dir",
        F.when(F.col("is_dir"), F.concat(name, F.lit("/"))).otherwise(name).alias("name"),
        F.when(F.col("is_dir"), "dir").otherwise(preview_kind(name)).alias("kind"),
        F.when(~F.col("is_dir"), preview_language(name)).alias("language"),
        F.when(F.col("is_dir"), "Directory").otherwise(type_label(name)).alias("type_label"),
    )


def preview_tree(
    files: DataFrame,
    include: list[str] = (),
    exclude: list[str] = (),
    max_depth: int | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Tree rows in display order; a page that shows part of the tree passes
    its own limits.

    Sorting by the path parts, each lower-cased and then as it is, puts every
    directory right in front of its children, as a depth-first listing does.
    """
    rows = preview_rows(files, include, exclude)
    if max_depth is not None:
        rows = rows.where(F.col("depth") <= max_depth)
    order = F.transform(F.split("relative_path", "/"), lambda part: F.struct(ascii_lower(part).alias("low"), part.alias("part")))
    rows = rows.orderBy(order)
    return rows if max_rows is None else rows.limit(max_rows)


def preview_stats(rows: DataFrame) -> DataFrame:
    """Counts over all preview rows (`preview_rows`) and the languages among
    them (at most six)."""
    return rows.agg(
        F.count_if("is_dir").alias("directories"),
        F.count_if(~F.col("is_dir")).alias("files"),
        *[F.count_if(F.col("kind") == kind).alias(kind) for kind in ("supported", "skipped", "unsupported")],
        F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"),
    )
