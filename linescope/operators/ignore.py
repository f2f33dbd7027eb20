"""Ignore files: .gitignore, .ignore, a repository's exclude file and a global
one, at, below or above a root.

An ignore file is one row, keyed by root and directory, whose text is parsed in
place.  Verdicts are worked out for paths alone: every entry (file or directory)
is joined to its parent directory, and that directory to the ignore files on
the way up.  Verdicts on directories are then carried down to the directories
below them, and files are dropped by their directory or by their own verdict.

Skew: the ignore file of a root meets all entries of that root; it is a plain
equi-join whose hot keys Spark splits.  Contents are never moved as long as what
is ignored is below `BROADCAST_BYTES`; its size is measured, not guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescope.functions.paths import directories, file_name
from linescope.session import checkpoint_dir

# Names of ignore files; rules of later ones outrank earlier ones.
IGNORE_FILES = [".gitignore", ".ignore"]
KINDS = ["global", "exclude", *IGNORE_FILES]
EXCLUDE_FILE = ".git/info/exclude"

#: Paths of what is ignored are sent to every executor up to this size.
BROADCAST_BYTES = 32 * 1024 * 1024

_LEADING, _INNER, _TRAILING = "\x01", "\x02", "\x03"
_CLASS = r"\[(?:[!^]?\]?[^\]]*)\]"


def _root(files: DataFrame) -> list[Column]:
    return [F.col("root")] if "root" in files.columns else []


def ignore_texts(files: DataFrame) -> DataFrame:
    """Ignore files of a file table as (root, dir, kind, text); `dir` is the
    directory that the rules start from.  Without a column `root` there is none
    in the result either."""
    rel = F.col("relative_path")
    exclude = (rel == EXCLUDE_FILE) | F.endswith(rel, F.lit("/" + EXCLUDE_FILE))
    kind = F.when(exclude, "exclude").otherwise(file_name(rel))
    folder = F.when(exclude, F.regexp_replace(rel, r"/?\.git/info/exclude$", "")).otherwise(F.regexp_replace(rel, "/?[^/]*$", ""))
    return files.where(file_name(rel).isin(IGNORE_FILES) | exclude).select(
        *_root(files), folder.alias("dir"), kind.alias("kind"), F.col("content").cast("string").alias("text")
    )


def outer_texts(texts: DataFrame, root: str) -> DataFrame:
    """Ignore files (dir, kind, text) at or above a root, found outside of its
    file table, as (root, dir, kind, text).  `dir` becomes a way up: `..` is the
    directory that holds the root."""
    root = root.rstrip("/")
    folder = F.rtrim("dir", F.lit("/"))
    below = F.substring(F.lit(root), F.length(folder) + 2, F.lit(len(root) + 2))
    steps = F.array_join(F.transform(F.split(below, "/"), lambda _: F.lit("..")), "/")
    return texts.where((folder == root) | F.startswith(F.lit(root), F.concat(folder, F.lit("/")))).select(
        F.lit(root).alias("root"), F.when(folder == root, "").otherwise(steps).alias("dir"), "kind", "text"
    )


def _regex(pattern: Column, anchored: Column) -> Column:
    """A pattern as a regular expression; `*` and `?` stay within a name."""
    body = F.regexp_replace(pattern, r"\\([A-Za-z0-9])", "$1")
    body = F.regexp_replace(body, r"([.+^$(){}|])", r"\\$1")
    body = F.replace(body, F.lit("[!"), F.lit("[^"))
    for wildcard, mark in ((r"^\*\*/", _LEADING), (r"/\*\*/", _INNER), (r"/\*\*$", _TRAILING)):
        body = F.regexp_replace(body, wildcard, mark)
    body = F.regexp_replace(F.regexp_replace(body, r"\*+", "[^/]*"), r"(?<!\\)\?", "[^/]")
    for mark, meaning in ((_LEADING, "(?:.*/)?"), (_INNER, "/(?:.*/)?"), (_TRAILING, "/.+")):
        body = F.replace(body, F.lit(mark), F.lit(meaning))
    return F.concat(F.when(anchored, r"\A").otherwise(r"\A(?:.*/)?"), body, F.lit(r"\z"))


def _malformed(pattern: Column) -> Column:
    """A class that is not closed, a range that runs backwards, or a single
    backslash at the end."""
    plain = F.regexp_replace(pattern, r"\\.", "")
    classes = F.regexp_extract_all(plain, F.lit(f"({_CLASS})"), 1)
    backwards = F.exists(
        F.flatten(F.transform(classes, lambda c: F.regexp_extract_all(c, F.lit(r"([^\[]-[^\]])"), 1))),
        lambda r: F.ascii(F.substring(r, 1, 1)) > F.ascii(F.substring(r, 3, 1)),
    )
    return F.contains(F.regexp_replace(plain, _CLASS, ""), F.lit("[")) | backwards | F.endswith(plain, F.lit("\\"))


def _rule_lines(text: Column) -> Column:
    """Lines that state a rule: struct(ord, line, negate, pattern)."""
    trimmed = F.transform(F.split(text, r"\r?\n"), lambda line, n: F.struct(n.alias("ord"), F.regexp_replace(line, r"(?<!\\) +$", "").alias("line")))
    stated = F.filter(trimmed, lambda r: (r["line"] != "") & ~F.startswith(r["line"], F.lit("#")))
    negate = lambda r: F.startswith(r["line"], F.lit("!"))
    return F.transform(
        stated,
        lambda r: F.struct(
            r["ord"].alias("ord"),
            r["line"].alias("line"),
            negate(r).alias("negate"),
            F.when(negate(r), F.substring(r["line"], 2, 2**31 - 1)).otherwise(r["line"]).alias("pattern"),
        ),
    )


def _parsed(rule: Column) -> Column:
    """Does the pattern start at its directory, and without its slashes."""
    bare = F.regexp_replace(rule["pattern"], "/$", "")
    return F.struct(
        rule["negate"].alias("negate"),
        F.endswith(rule["pattern"], F.lit("/")).alias("dir_only"),
        F.contains(bare, F.lit("/")).alias("anchored"),
        F.regexp_replace(bare, "^/", "").alias("bare"),
    )


def _tested(rule: Column) -> Column:
    """How the pattern is tested: most are a name or an ending, and only the rest
    needs a regular expression."""
    literal = ~F.rlike(rule["bare"], F.lit(r"[*?\[\]\\]"))
    ending = ~rule["anchored"] & F.rlike(rule["bare"], F.lit(r"^\*[^*?\[\]\\/]+$"))
    return F.struct(
        rule["negate"].alias("negate"),
        rule["dir_only"].alias("dir_only"),
        rule["anchored"].alias("anchored"),
        F.when(literal, "literal").when(ending, "ending").otherwise("glob").alias("form"),
        F.when(literal, rule["bare"]).when(ending, F.substring(rule["bare"], 2, 2**31 - 1)).otherwise(_regex(rule["bare"], rule["anchored"])).alias("test"),
    )


def parse_ignore_files(texts: DataFrame) -> DataFrame:
    """Ignore files (dir, text and, when known, root and kind) with their rules
    in line order: root, dir, rank, rules.  Malformed lines state no rule; see
    `malformed_lines`."""
    kind = F.col("kind") if "kind" in texts.columns else F.lit(IGNORE_FILES[0])
    rank = F.array_position(F.array(*[F.lit(name) for name in KINDS]), kind)
    stated = F.filter(_rule_lines(F.col("text")), lambda r: ~_malformed(r["pattern"]))
    return texts.select(
        *_root(texts), "dir", rank.alias("rank"), F.transform(F.transform(stated, _parsed), _tested).alias("rules")
    ).where(F.size("rules") > 0)


def malformed_lines(texts: DataFrame) -> DataFrame:
    """Lines that state no rule, as warnings: dir, ord, warning."""
    bad = texts.select("dir", F.explode(F.filter(_rule_lines(F.col("text")), lambda r: _malformed(r["pattern"]))).alias("bad"))
    return bad.select("dir", "bad.ord", F.concat(F.lit("malformed ignore rule: "), "bad.line").alias("warning"))


# ---- directories -----------------------------------------------------------------------


def _parent(path: Column) -> Column:
    """Directory of a relative path; empty for the root itself."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def _steps_up(root: Column) -> Column:
    """`..`, `../..` and so on, as far as the root's path allows."""
    depth = F.size(F.split(F.rtrim(root, F.lit("/")), "/")) - 1
    steps = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda k: F.array_join(F.array_repeat(F.lit(".."), k), "/"))


def _way_up(root: Column, folder: Column) -> Column:
    """A directory, those above it, the root, and those above the root."""
    below = F.concat(directories(folder), F.when(folder == "", F.array().cast("array<string>")).otherwise(F.array(folder)))
    return F.concat(_steps_up(root), F.array(F.lit("")), below)


def _outside(folder: Column) -> Column:
    return F.rlike(folder, F.lit(r"^\.\.(/|$)"))


def _depth(folder: Column) -> Column:
    """Directories between it and the root; negative above the root."""
    parts = F.size(F.split(folder, "/"))
    return F.when(folder == "", 0).when(_outside(folder), -parts).otherwise(parts)


def _below(root: Column, folder: Column, path: Column) -> Column:
    """A relative path as seen from a directory on its way up."""
    parts = F.split(F.rtrim(root, F.lit("/")), "/")
    up = F.size(F.split(folder, "/"))
    outer = F.concat(F.array_join(F.slice(parts, -up, up), "/"), F.lit("/"), path)
    return (
        F.when(folder == "", path)
        .when(_outside(folder), outer)
        .otherwise(F.substring(path, F.length(folder) + 2, F.length(path)))
    )


def _links(folders: DataFrame, rules: DataFrame, repositories: DataFrame | None) -> DataFrame:
    """(key, parent, holder): which directories with ignore files count for the
    entries of a directory.

    With `repositories`, rules other than those of .ignore files count within
    the innermost repository only, and not at all outside of one.
    """
    ways = folders.select("key", F.col("folder").alias("parent"), F.explode(_way_up(F.col("root"), F.col("folder"))).alias("holder"))
    holders = rules.select("key", F.col("dir").alias("holder")).distinct()
    links = ways.join(holders, ["key", "holder"], "left_semi")
    if repositories is None:
        return links.withColumn("within", F.lit(-(2**31)))
    works = repositories.select("key", F.col("dir").alias("holder")).distinct()
    inner = ways.join(works, ["key", "holder"], "left_semi").groupBy("key", "parent").agg(F.max(_depth(F.col("holder"))).alias("within"))
    return links.join(inner, ["key", "parent"], "left")


def _matches(rule: Column, below: Column, name: Column, is_dir: Column) -> Column:
    whole = F.when(rule["anchored"], below).otherwise(name)
    hit = (
        F.when(rule["form"] == "literal", whole == rule["test"])
        .when(rule["form"] == "ending", F.endswith(name, rule["test"]))
        .otherwise(F.rlike(below, rule["test"]))
    )
    return (is_dir | ~rule["dir_only"]) & hit


def ignored_entries(paths: DataFrame, rules: DataFrame, repositories: DataFrame | None = None) -> DataFrame:
    """(key, entry, is_dir): files and directories whose own verdict is to be
    ignored.  `paths` holds key, root and relative_path.

    Ignore files count by kind, then depth, and within one the last line that
    matches; the first that says anything decides.
    """
    rel = F.col("relative_path")
    folders = _folders(paths)
    links = _links(folders, rules, repositories)
    entries = folders.where("folder <> ''").select("key", "root", F.col("folder").alias("entry"), F.lit(True).alias("is_dir")).unionByName(
        paths.select("key", "root", rel.alias("entry"), F.lit(False).alias("is_dir"))
    )
    linked = entries.withColumn("parent", _parent(F.col("entry"))).join(links, ["key", "parent"])
    met = linked.join(rules.withColumnRenamed("dir", "holder"), ["key", "holder"]).where(
        (F.col("rank") == len(KINDS)) | ((F.col("rank") == 1) & F.col("within").isNotNull()) | (_depth(F.col("holder")) >= F.col("within"))
    )
    seen = met.withColumns({"below": _below(F.col("root"), F.col("holder"), F.col("entry")), "name": file_name(F.col("entry"))})
    hits = F.filter("rules", lambda rule: _matches(rule, F.col("below"), F.col("name"), F.col("is_dir")))
    said = seen.select(
        "key", "entry", "is_dir", "rank", _depth(F.col("holder")).alias("depth"), F.try_element_at(hits, F.lit(-1))["negate"].alias("negate")
    ).where(F.col("negate").isNotNull())
    verdict = said.groupBy("key", "entry", "is_dir").agg(F.max_by("negate", F.struct("rank", "depth")).alias("negate"))
    return verdict.where(~F.col("negate")).drop("negate")


def _folders(paths: DataFrame) -> DataFrame:
    """(key, root, folder): all directories of the paths, the roots among them."""
    found = F.concat(F.array(F.lit("")), directories(F.col("relative_path")))
    return paths.select("key", "root", F.explode(found).alias("folder")).distinct()


def shut_directories(folders: DataFrame, ignored: DataFrame) -> DataFrame:
    """(key, folder): directories that are ignored or lie below one that is;
    nothing in them can be brought back."""
    above = F.concat(directories(F.col("folder")), F.array("folder"))
    ways = folders.select("key", "folder", F.explode(above).alias("entry"))
    return ways.join(ignored.where("is_dir").select("key", "entry"), ["key", "entry"], "left_semi").select("key", "folder").distinct()


def apply_ignore_rules(files: DataFrame, rules: DataFrame, repositories: DataFrame | None = None) -> DataFrame:
    """Files no ignore rule excludes.

    Rules with a root count for files of that root alone, rules without one for
    all.  `repositories` (dir and, when known, root) names the directories that
    hold a repository; without it every ignore file counts as inside of one.
    """
    checkpoint_dir(files.sparkSession)
    by_root = "root" in rules.columns and "root" in files.columns
    key = lambda table: table.withColumn("key", F.col("root") if by_root else F.lit(""))
    root = F.col("root") if "root" in files.columns else F.lit("")
    own = files.select(root.alias("root"), "relative_path")
    paths = key(own)
    ignored = ignored_entries(paths, key(rules).drop("root"), None if repositories is None else key(repositories)).checkpoint()
    shut = shut_directories(_folders(paths), ignored).checkpoint()
    alone = ignored.where(~F.col("is_dir")).select("key", "entry")
    size = sum(table.agg(F.coalesce(F.sum(F.octet_length(name) + 64), F.lit(0))).first()[0] for table, name in ((alone, "entry"), (shut, "folder")))
    if size <= BROADCAST_BYTES:
        alone, shut = F.broadcast(alone), F.broadcast(shut)
    marks = {"_key": F.col("root") if by_root else F.lit(""), "_folder": _parent(F.col("relative_path"))}
    judged = files.withColumns(marks)
    judged = judged.join(shut, (judged["_key"] == shut["key"]) & (judged["_folder"] == shut["folder"]), "left_anti")
    judged = judged.join(alone, (judged["_key"] == alone["key"]) & (judged["relative_path"] == alone["entry"]), "left_anti")
    return judged.select(*files.columns)
