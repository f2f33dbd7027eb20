"""Saved runs and the run history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linescope.operators.languages import enum_order, from_json_name
from linescope.schemas import FILE_ROW, RUN_DOCUMENT, RUN_JSON, RUNS
from linescope.versions import latest_version, version_path


def read_run_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Saved runs, one row each; fields older files lack are null.

    A file is one indented document, or one document per line.
    """
    return spark.read.schema(RUN_JSON).json(path, multiLine=multi_line)


def run_files(runs: DataFrame) -> DataFrame:
    """File records of saved runs, analysed and skipped."""
    every = F.concat(
        F.coalesce("per_file_records", F.array()), F.coalesce("skipped_file_records", F.array())
    )
    return runs.select(F.col("tool.run_id").alias("run_id"), F.explode(every).alias("f")).select(
        "run_id",
        "f.path",
        "f.relative_path",
        from_json_name(F.col("f.language")).alias("language"),
        "f.size_bytes",
        "f.detected_encoding",
        F.col("f.raw_line_categories").alias("raw"),
        F.col("f.effective_counts").alias("effective"),
        "f.status",
        "f.warnings",
        "f.generated",
        "f.minified",
        "f.vendor",
        "f.parse_mode",
        "f.submodule",
    )


def read_run_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A run saved as tables: its row in the shape of RUN_DOCUMENT, and its file
    records."""
    run = spark.read.schema(RUN_DOCUMENT).json(f"{path}/run")
    files = spark.read.schema(FILE_ROW).json(f"{path}/files")
    records = files.select(
        run.select("tool.run_id").scalar().alias("run_id"),
        "path",
        "relative_path",
        from_json_name(F.col("language")).alias("language"),
        "size_bytes",
        "detected_encoding",
        F.col("raw_line_categories").alias("raw"),
        F.col("effective_counts").alias("effective"),
        "status",
        "warnings",
        "generated",
        "minified",
        "vendor",
        "parse_mode",
        "submodule",
    )
    return run, records


def run_languages(runs: DataFrame) -> DataFrame:
    """Language totals of saved runs."""
    return (
        runs.select(F.col("tool.run_id").alias("run_id"), F.explode("totals_by_language").alias("t"))
        .select("run_id", "t.*")
        .withColumn("language", from_json_name(F.col("language")))
        .withColumn("enum_order", enum_order(F.col("language")))
    )


def read_registry(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The run history, of the newest version unless one is named; empty when
    nothing was saved at `path` (version 0).  A plain folder without versions is
    read as it is."""
    number = latest_version(spark, path) if version is None else version
    if number:
        return spark.read.schema(RUNS).parquet(version_path(spark, path, number))
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    plain = files.exists(place) and not files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/data"))
    return spark.read.schema(RUNS).parquet(path) if plain else spark.createDataFrame([], RUNS)
