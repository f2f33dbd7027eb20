"""Language detection from path and first line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linescope.functions.paths import ascii_lower, extension, file_name
from linescope.operators.languages import SHEBANGS, by_extension, by_file_name, lookup


def shebang_language(first_line: Column) -> Column:
    line = ascii_lower(first_line)
    found = F.lit(None).cast("string")
    for language, hints in reversed(SHEBANGS):
        hit = F.rlike(line, F.lit("|".join(hints)))
        found = F.when(hit, language).otherwise(found)
    return F.when(F.startswith(first_line, F.lit("#!")), found)


def detect_language(
    path: Column,
    first_line: Column,
    overrides: dict[str, str] | None = None,
    shebang_detection: bool = True,
) -> Column:
    """Override, exact file name, extension, then the #! line."""
    sources = [lookup(overrides or {}, extension(path)), by_file_name(file_name(path)), by_extension(extension(path))]
    if shebang_detection:
        sources.append(shebang_language(first_line))
    return F.coalesce(*sources)
