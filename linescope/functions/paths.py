"""Column functions over paths, and glob patterns as regular expressions."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def ascii_upper(text: Column) -> Column:
    return F.translate(text, string.ascii_lowercase, string.ascii_uppercase)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Directory of a path; null when the path has none."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", ""))


def extension(path: Column) -> Column:
    """Text after the last dot of the file name, lower case; a leading dot
    does not start an extension.  Empty when there is none."""
    return ascii_lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def relative_path(path: Column, root: Column) -> Column:
    """Path below its root with forward slashes; the whole path otherwise."""
    prefix = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    below = F.substring(path, F.length(prefix) + 1, F.length(path))
    return F.replace(F.when(F.startswith(path, prefix), below).otherwise(path), F.lit("\\"), F.lit("/"))


def has_component(path: Column, names: list[str]) -> Column:
    """True when any component of the path, file name included, is in names."""
    if not names:
        return F.lit(False)
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(name) for name in names]))


def is_below(path: Column, directory: Column) -> Column:
    """True for the directory itself and everything below it."""
    return (path == directory) | F.startswith(path, F.concat(F.rtrim(directory, F.lit("/")), F.lit("/")))


def is_hidden(relative: Column) -> Column:
    """A dot file, or a file below a dot directory."""
    return F.startswith(relative, F.lit(".")) | F.contains(relative, F.lit("/."))


def directories(relative: Column) -> Column:
    """All directories above a relative path, outermost first."""
    parts = F.split(relative, "/")
    depths = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(depths, lambda depth: F.array_join(F.slice(parts, F.lit(1), depth), "/"))


def glob_regex(pattern: str) -> str:
    """A file glob as an anchored regular expression.

    `*` and `?` cross directory separators; `**` between separators stands for
    any number of directories; `[...]` and `{a,b}` are supported.
    """
    rest, out, depth = pattern, "", 0
    if rest == "**":
        return r"(?s)\A.*\z"
    if rest.startswith("**/"):
        rest, out = rest[3:], "(?:/?|.*/)"
    tail = ""
    if rest.endswith("/**"):
        rest, tail = rest[:-3], "/.*"
    while rest:
        if rest.startswith("/**/"):
            rest, out = rest[4:], out + "(?:/|/.*/)"
            continue
        char, rest = rest[0], rest[1:]
        group = re.match(r"([!^]?)(\]?[^\]]*)\]", rest) if char == "[" else None
        if char == "*":
            out += ".*"
        elif char == "?":
            out += "."
        elif group:
            if any(a > b for a, b in re.findall(r"(?s)(.)-(.)", group[2])):
                raise ValueError(f"invalid glob pattern: {pattern}")
            members = re.sub(r"([\\\[\]^&])", r"\\\1", group[2])
            out, rest = out + f"[{'^' if group[1] else ''}{members}]", rest[group.end():]
        elif char == "{":
            out, depth = out + "(?:", depth + 1
        elif char == "}" and depth:
            out, depth = out + ")", depth - 1
        elif char == "," and depth:
            out += "|"
        elif char == "\\" and rest:
            out, rest = out + re.escape(rest[0]), rest[1:]
        elif char == "[" or depth < 0:
            raise ValueError(f"invalid glob pattern: {pattern}")
        else:
            out += re.escape(char)
    if depth:
        raise ValueError(f"invalid glob pattern: {pattern}")
    return rf"(?s)\A{out}{tail}\z"


def wildcard_regex(pattern: str) -> str:
    """The simpler preview pattern: only `*` (any run) and `?` (one character)."""
    text = pattern.strip().replace("\\", "/")
    return r"(?s)\A" + "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in text) + r"\z"


def _any_match(candidate: Column, regexes: list[str]) -> Column:
    if not regexes:
        return F.lit(False)
    return F.rlike(candidate, F.lit("|".join(f"(?:{regex})" for regex in regexes)))


def glob_match(candidate: Column, patterns: list[str]) -> Column:
    """True when any glob of the list matches the whole candidate."""
    return _any_match(candidate, [glob_regex(p) for p in patterns])


def wildcard_match(candidate: Column, patterns: list[str]) -> Column:
    text = F.replace(F.trim(candidate), F.lit("\\"), F.lit("/"))
    return _any_match(text, [wildcard_regex(p) for p in patterns])


def preview_skips_directory(relative: Column, exclude: list[str]) -> Column:
    """A directory is skipped when a pattern matches it, it with a slash, or
    a placeholder file below it."""
    names = (relative, F.concat(relative, F.lit("/")), F.concat(relative, F.lit("/placeholder")))
    hit = F.lit(False)
    for name in names:
        hit = hit | wildcard_match(name, exclude)
    return (relative != "") & hit


def preview_includes_file(relative: Column, include: list[str], exclude: list[str]) -> Column:
    included = wildcard_match(relative, include) if include else F.lit(True)
    return (relative == "") | (included & ~wildcard_match(relative, exclude))
