"""File tables."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linescope.functions.paths import file_name, is_below, is_hidden, relative_path

_READ_BYTES = 32 * 1024 * 1024
_BUCKETS_A_TASK = 64
_FILE_BYTES = 256  # what a file costs beside its content


def spread(rows: DataFrame, partitions: int | None) -> DataFrame:
    """Deal rows to `partitions` tasks; None leaves the scan as it is.

    Classification is bound by CPU, and a small file of one row group is one
    task however many cores there are.  Only the caller knows that.
    """
    return rows if partitions is None else rows.repartition(partitions)


def spread_bytes(files: DataFrame, partitions: int) -> DataFrame:
    """Deal files to `partitions` tasks of about equal bytes.

    Paths are hashed to some dozens of buckets a task.  The bytes of the buckets,
    the only thing that is gathered, decide which task each belongs to: the
    heaviest goes to the task that has least.  Contents are moved once, straight
    to their task.
    """
    buckets = partitions * _BUCKETS_A_TASK
    bucket = F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")
    weight = F.coalesce("size_bytes", F.lit(0)) + _FILE_BYTES
    weights = dict(files.groupBy(bucket.alias("bucket")).agg(F.sum(weight).alias("bytes")).collect())  # one row a bucket
    tasks = [(0, task) for task in range(partitions)]
    home = [0] * buckets
    for place in sorted(weights, key=lambda b: (-weights[b], b)):
        held, task = heapq.heappop(tasks)
        home[place] = task
        heapq.heappush(tasks, (held + weights[place], task))
    return files.repartitionById(partitions, F.get(F.lit(home), bucket))


def from_table(corpus: DataFrame, root: str | Column, *keep: str) -> DataFrame:
    """Files of a corpus table (path, content and, when stored, size_bytes and
    is_symlink) below a root; `keep` names columns to carry along."""
    root = F.lit(root) if isinstance(root, str) else root
    have = set(corpus.columns)
    return corpus.select(
        root.alias("root"),
        "path",
        relative_path(F.col("path"), root).alias("relative_path"),
        (F.col("size_bytes") if "size_bytes" in have else F.octet_length("content")).cast("bigint").alias("size_bytes"),
        (F.col("is_symlink") if "is_symlink" in have else F.lit(False)).alias("is_symlink"),
        F.col("content").cast("binary").alias("content"),
        *keep,
    )


def scan_files(spark: SparkSession, root: str, max_file_size_bytes: int) -> DataFrame:
    """Files below a directory, read by Spark's binary file source.

    The size limit is pushed into both scans: files above it are listed but
    their bytes are never read.  The source itself skips names that start
    with `_` or `.`; `scan_directory` lists those too.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    listing = reader.load(root).withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    small = listing.where(F.col("length") <= max_file_size_bytes).select(
        "path", F.col("length").alias("size_bytes"), "content"
    )
    large = listing.where(F.col("length") > max_file_size_bytes).select(
        "path", F.col("length").alias("size_bytes"), F.lit(None).cast("binary").alias("content")
    )
    return from_table(small.unionByName(large), root)


def scan_single_file(corpus: DataFrame, path: str) -> DataFrame:
    """A root that is a file: its directory becomes the root."""
    directory = path.rsplit("/", 1)[0] or "/"
    return from_table(corpus.where(F.col("path") == path), directory)


def _list_folders(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    import os

    def entry(e: os.DirEntry) -> tuple:
        try:
            if e.is_symlink() and e.is_dir():
                inside = (os.path.realpath(os.path.dirname(e.path)) + "/").startswith(os.path.realpath(e.path).rstrip("/") + "/")
                return e.path, True, True, 0, "link to a folder above it" if inside else None
            return e.path, e.is_dir(follow_symlinks=False), e.is_symlink(), e.stat(follow_symlinks=False).st_size, None
        except OSError as error:
            return e.path, False, False, None, str(error)

    for batch in batches:
        for folder in batch["path"]:
            try:
                entries = [entry(e) for e in os.scandir(folder)]
            except OSError as error:
                entries = [(folder, False, False, None, str(error))]
            rows = pd.DataFrame(entries, columns=["path", "is_dir", "is_symlink", "size_bytes", "error"])
            yield rows.astype({"size_bytes": "Int64"})


def _read_bytes(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    def content(path: str) -> bytes | None:
        try:
            with open(path, "rb") as file:
                return file.read()
        except OSError:
            return None

    for batch in batches:
        # Output batches of about equal bytes, whatever the file sizes.
        step = batch["size_bytes"].cumsum() // _READ_BYTES
        for _, part in batch.groupby(step):
            yield part.assign(content=[content(path) for path in part["path"]])


def list_directory(
    spark: SparkSession, root: str, ignore_hidden_files: bool = True, follow_symlinks: bool = False
) -> DataFrame:
    """Entries below a directory that every executor can open: path, is_dir,
    is_symlink, size_bytes, error.

    Folders are listed level by level as a DataFrame, so no task owns a whole
    subtree; each level is checkpointed before the next one starts from it.
    What cannot be listed is a row with its error.  Links to folders are only
    entered with `follow_symlinks`; one that leads to a folder above itself is
    an error then.
    """
    from linescope.session import checkpoint_dir

    checkpoint_dir(spark)
    parallel = spark.sparkContext.defaultParallelism
    shape = "path string, is_dir boolean, is_symlink boolean, size_bytes bigint, error string"
    folders = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string")
    levels = []
    while True:
        level = folders.mapInPandas(_list_folders, shape)
        if ignore_hidden_files:
            level = level.where(~F.startswith(file_name(F.col("path")), F.lit(".")))
        level = level.checkpoint()
        levels.append(level)
        enter = F.col("is_dir") & (~F.col("is_symlink") | (F.lit(follow_symlinks) & F.col("error").isNull()))
        folders = level.where(enter).select("path").repartition(parallel)
        if folders.isEmpty():
            break
    listing = levels[0]
    for level in levels[1:]:
        listing = listing.unionByName(level)
    return listing


def scan_directory(
    spark: SparkSession,
    root: str,
    max_file_size_bytes: int,
    ignore_hidden_files: bool = True,
    follow_symlinks: bool = False,
    listing: DataFrame | None = None,
) -> DataFrame:
    """Files below a directory that every executor can open, any name.  A link
    to a folder is no file.

    Only files within the size limit are opened.  `listing` is what
    `list_directory` found, when the caller wants its errors too
    (`walk_errors`).
    """
    parallel = spark.sparkContext.defaultParallelism
    listing = list_directory(spark, root, ignore_hidden_files, follow_symlinks) if listing is None else listing
    listing = listing.where(~F.col("is_dir") & F.col("error").isNull())
    small = F.col("size_bytes") <= max_file_size_bytes
    opened = (
        listing.where(small)
        .select("path", "size_bytes", "is_symlink")
        .repartition(parallel * 4)
        .mapInPandas(_read_bytes, "path string, size_bytes bigint, is_symlink boolean, content binary")
    )
    unopened = listing.where(~small).select(
        "path", "size_bytes", "is_symlink", F.lit(None).cast("binary").alias("content")
    )
    return from_table(opened.unionByName(unopened), root)


def walk_errors(listing: DataFrame) -> DataFrame:
    """Entries the walk could not list or enter: path and error."""
    return listing.where(F.col("error").isNotNull()).select("path", "error")


def union_roots(parts: list[DataFrame]) -> DataFrame:
    """Files of several roots together, with the place of their root."""
    tagged = [part.withColumn("root_ord", F.lit(n)) for n, part in enumerate(parts)]
    union = tagged[0]
    for part in tagged[1:]:
        union = union.unionByName(part)
    return union


def dedupe_paths(
    files: DataFrame, roots: list[str], ignore_hidden_files: bool = False, file_roots: Iterable[int] = ()
) -> DataFrame:
    """Keep a path reached from several directory roots once, under the first.

    Roots at the places `file_roots` are files: each keeps its record, and none
    takes a path from a directory.  Whether an earlier root reaches a path
    follows from the path itself, so the content is neither shuffled nor
    compared.
    """
    path = F.col("path")
    single = set(file_roots)
    first = F.lit(None).cast("int")
    for n, root in reversed(list(enumerate(roots))):
        if n in single:
            continue
        reached = is_below(path, F.lit(root))
        if ignore_hidden_files:
            reached = reached & ~is_hidden(relative_path(path, F.lit(root)))
        first = F.when(reached, n).otherwise(first)
    return files.where((F.col("root_ord") == first) | F.col("root_ord").isin(sorted(single)))
