"""File selection.

Rules are tried in a fixed order and the first match decides.  A rule sees
either only the path and size or the content too; the content rules are
guarded by the path rules, so skipped files are never decoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescope.functions.barrier import sealed
from linescope.functions.paths import file_name, glob_match, has_component, is_below, is_hidden
from linescope.operators import decode
from linescope.operators.classify import BLANKS, first_line
from linescope.operators.detect import detect_language
from linescope.operators.languages import lookup
from linescope.settings import Settings

# Rule -> (status, warning), in the order of the rules.
RULES = {
    "metadata_error": ("error_internal", "failed to read metadata"),
    "symlink": ("skipped_by_policy", "symlink skipped by policy"),
    "gitignore_file": ("skipped_by_policy", ".gitignore is always excluded"),
    "excluded_dir": ("skipped_by_policy", "path matched excluded directory setting"),
    "max_size": ("skipped_by_policy", "file exceeded max_file_size_bytes ({})"),
    "exclude_glob": ("skipped_by_policy", "path matched exclude glob"),
    "lockfile": ("skipped_by_policy", "lockfile skipped by default policy"),
    "read_error": ("error_internal", "failed to read file"),
    "vendor": ("skipped_by_policy", "vendor file skipped by policy"),
    "generated": ("skipped_by_policy", "generated file skipped by policy"),
    "minified": ("skipped_by_policy", "minified file skipped by policy"),
    "binary": ("skipped_binary", "binary file skipped by default"),
    "decode_error": ("skipped_decode_error", "invalid utf-8 sequence after byte order mark"),
    "unsupported": ("skipped_unsupported", "unsupported or undetected language"),
    "disabled_language": ("skipped_by_policy", "language {} disabled by configuration"),
}

# Fixed values.
LOCKFILES = [
    "Cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Pipfile.lock", "poetry.lock", "composer.lock",
]
VENDOR_DIRECTORIES = ["vendor", "node_modules", "packages"]


def is_vendor(path: Column) -> Column:
    return has_component(path, VENDOR_DIRECTORIES)


def is_lockfile(path: Column) -> Column:
    return file_name(path).isin(LOCKFILES)


def _head(content: Column, size: int | None) -> Column:
    """The first bytes of a file, or all of it."""
    return content if size is None else F.substring(content, 1, size)


def _sample(content: Column, size: int | None) -> Column:
    return F.make_valid_utf8(_head(content, size).cast("string"))


def looks_generated(path: Column, content: Column, sample_bytes: int | None = 1024) -> Column:
    head = F.lower(_sample(content, sample_bytes))
    return F.rlike(file_name(path), F.lit(r"\.generated\.|\.g\.")) | F.rlike(
        head, F.lit("@generated|generated by")
    )


def looks_minified(path: Column, content: Column, sample_bytes: int | None = 4096) -> Column:
    """Named so, or a sample with a very long line and hardly any blanks.  An
    invalid byte counts as the three of its replacement."""
    head = _sample(content, sample_bytes)
    longest = F.array_max(F.transform(F.split(head, r"\r?\n"), F.octet_length))
    blanks = F.length(head) - F.length(F.regexp_replace(head, rf"[\r\n{BLANKS}]", ""))
    dense = blanks * 100 < F.octet_length(head)
    return F.contains(file_name(path), F.lit(".min.")) | F.coalesce((longest > 2000) & dense, F.lit(False))


def is_binary(content: Column, sample_bytes: int | None = 8192) -> Column:
    return ~decode.has_bom(content) & F.contains(_head(content, sample_bytes), F.lit(b"\x00"))


def visible(files: DataFrame) -> DataFrame:
    """Drop dot files and everything below dot directories."""
    return files.where(~is_hidden(F.col("relative_path")))


def within_roots(files: DataFrame, roots: list[str]) -> DataFrame:
    """Keep files below an allowed root; no roots allow everything."""
    if not roots:
        return files
    allowed = F.lit(False)
    for root in roots:
        allowed = allowed | is_below(F.col("path"), F.lit(root))
    return files.where(allowed)


def early_rule(settings: Settings) -> Column:
    """Rules that come before the include globs."""
    path, discovery = F.col("path"), settings.discovery
    return (
        F.when(F.col("size_bytes").isNull(), "metadata_error")
        .when(F.col("is_symlink") & F.lit(not discovery.follow_symlinks), "symlink")
        .when(file_name(path) == ".gitignore", "gitignore_file")
        .when(has_component(path, list(discovery.excluded_directories)), "excluded_dir")
        .when(F.col("size_bytes") > discovery.max_file_size_bytes, "max_size")
    )


def _matches(patterns: tuple[str, ...]) -> Column:
    return glob_match(F.col("relative_path"), list(patterns)) | glob_match(F.col("path"), list(patterns))


def path_rules(files: DataFrame, settings: Settings) -> DataFrame:
    """Add `rule` from path and size; files no include glob names disappear."""
    discovery, analysis, path = settings.discovery, settings.analysis, F.col("path")
    selected = files.withColumn("rule", early_rule(settings))
    if discovery.include_globs:
        selected = selected.where(F.col("rule").isNotNull() | _matches(discovery.include_globs))
    later = F.when(_matches(discovery.exclude_globs), "exclude_glob").when(
        is_lockfile(path) & F.lit(not analysis.include_lockfiles), "lockfile"
    )
    return selected.withColumn("rule", F.coalesce("rule", later))


def _stop(rule: str, behavior: str, message: str) -> Column:
    """The rule name, or an error when the settings ask to fail."""
    if behavior == "fail":
        return F.raise_error(F.concat(F.lit(message), F.col("path"))).cast("string")
    return F.lit(rule)


def content_rules(files: DataFrame, settings: Settings, stop_early: bool = True) -> DataFrame:
    """Complete `rule` from the content, and replace the content by `encoding`,
    `text`, `decode_warnings` and `language` of the files that remain.

    Where the settings ask to fail, the first such file ends the job; without
    `stop_early` it only gets its rule, for a gate to count.
    """
    stop = _stop if stop_early else lambda rule, behavior, message: F.lit(rule)
    analysis, path, content = settings.analysis, F.col("path"), F.col("content")
    open_ = F.col("rule").isNull()
    by_bytes = (
        F.when(content.isNull(), "read_error")
        .when(is_vendor(path) & F.lit(analysis.vendor_directory_detection), "vendor")
        .when(F.lit(analysis.generated_file_detection) & looks_generated(path, content, analysis.generated_sample_bytes), "generated")
        .when(F.lit(analysis.minified_file_detection) & looks_minified(path, content, analysis.minified_sample_bytes), "minified")
        .when(is_binary(content, analysis.binary_sample_bytes), stop("binary", analysis.binary_file_behavior, "binary file encountered: "))
    )
    decoded = (
        files.withColumn("rule", F.when(open_, by_bytes).otherwise(F.col("rule")))
        .withColumn("encoding", F.when(open_, decode.encoding(content)))
        .withColumn("text", F.when(open_, decode.text(content, F.col("encoding"))))
        .withColumn("decode_warnings", F.when(open_, decode.warnings(content, F.col("encoding"), F.col("text"))))
    )
    failed = stop("decode_error", analysis.decode_failure_behavior, "decode failure for ")
    language = detect_language(
        path, first_line(F.col("text")), settings.extension_languages(), analysis.shebang_detection
    )
    known = decoded.withColumn(
        "rule", F.when(open_ & F.col("text").isNull(), failed).otherwise(F.col("rule"))
    ).withColumn("language", F.when(open_, language))
    enabled = settings.enabled_languages()
    by_language = F.when(F.col("language").isNull(), "unsupported")
    if enabled:
        by_language = by_language.when(~F.col("language").isin(enabled), "disabled_language")
    decided = known.withColumn("rule", F.when(open_, by_language).otherwise(F.col("rule"))).withColumn(
        "text", F.when(open_, F.col("text"))
    )
    return sealed(decided.drop("content"))


def rule_status(rule: Column) -> Column:
    return lookup({name: status for name, (status, _) in RULES.items()}, rule)


def rule_warning(rule: Column, language: Column, settings: Settings) -> Column:
    template = lookup({name: warning for name, (_, warning) in RULES.items()}, rule)
    filler = F.when(rule == "max_size", str(settings.discovery.max_file_size_bytes)).otherwise(
        F.coalesce(language, F.lit(""))
    )
    return F.replace(template, F.lit("{}"), filler)
