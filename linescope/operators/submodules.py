"""Submodule definitions and tagging of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescope.operators.classify import BLANKS, normalized_newlines

_SPACE = rf"[{BLANKS}\r]*"
_HEADER = rf'{_SPACE}\[submodule "([^\n]*)"\]{_SPACE}'


def _sections(text: Column) -> Column:
    """Text pieces, each starting at a section line; the first is a preamble."""
    return F.split(F.concat(F.lit("\n"), normalized_newlines(text)), rf"\n(?={_HEADER}(?:\n|\z))")


def parse_gitmodules(files: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Sections of .gitmodules texts: keys, ord (file order), name and path.

    A file stays one row, so no window runs over its lines.  Lines in front
    of the first section and sections without a path give nothing; the last
    path of a section counts.
    """
    sections = files.select(*keys, F.posexplode(_sections(F.col(text))).alias("ord", "section"))
    name = F.regexp_extract("section", rf"\A{_HEADER}", 1)
    paths = F.regexp_extract_all(
        F.concat(F.lit("\n"), F.col("section")),
        F.lit(rf"\n{_SPACE}path[^=\n]*={_SPACE}([^\n]*?){_SPACE}(?=\n|\z)"),
        1,
    )
    return sections.where(F.col("ord") > 0).select(
        *keys, "ord", name.alias("name"), F.try_element_at(paths, F.lit(-1)).alias("path")
    ).where(F.col("path").isNotNull())


def section_lines(files: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Every line of the sections with the section name carried down."""
    sections = files.select(*keys, F.posexplode(_sections(F.col(text))).alias("section_no", "section"))
    name = F.regexp_extract("section", rf"\A{_HEADER}", 1)
    return (
        sections.where(F.col("section_no") > 0)
        .select(*keys, "section_no", name.alias("name"), F.posexplode(F.split("section", "\n")).alias("pos", "line"))
        .where(F.col("line") != "")
    )


def tag_submodule(records: DataFrame, submodules: DataFrame, *keys: str) -> DataFrame:
    """Set `submodule` to the first submodule, in file order, holding the file.

    `keys` (at least one) name the repository or run a submodule belongs to.  A
    file is joined by its directories to submodules whose paths are as deep, one
    equi-join for each depth that submodules have, so each file meets at most one
    row a join, the records are read once, and submodules may be many.  Spark
    broadcasts definitions below its byte threshold and otherwise splits the
    hot keys of the left side.
    """
    path = F.replace("path", F.lit("\\"), F.lit("/"))
    defined = submodules.select(*keys, path.alias("_holder"), F.size(F.split(path, "/")).alias("_depth"), F.struct("ord", "name").alias("_entry"))
    depths = sorted(row[0] for row in defined.select("_depth").distinct().collect() if row[0] > 0)  # no more than a path is deep
    rel = F.col("relative_path")
    parts = F.split(rel, "/")
    columns = [name for name in records.columns if name != "submodule"]
    tagged = records.select(*columns)
    for depth in depths:
        side = defined.where(F.col("_depth") == depth).groupBy(*keys, "_holder").agg(F.min("_entry").alias(f"_at_{depth}"))
        # A path that is not as deep is no such directory: it keeps a key of its own.
        holder = F.when(F.size(parts) >= depth, F.array_join(F.slice(parts, 1, depth), "/")).otherwise(rel)
        tagged = tagged.withColumn("_holder", holder).join(side, [*keys, "_holder"], "left").drop("_holder")
    first = F.array_min(F.array_compact(F.array(*[F.col(f"_at_{depth}") for depth in depths]))) if depths else None
    name = first["name"] if depths else F.lit(None).cast("string")
    return tagged.select(*[name.alias("submodule") if column == "submodule" else column for column in records.columns])
