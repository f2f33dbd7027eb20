"""Input tables, and intermediate tables in the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    A session on one machine that names none (tests) gets a temporary folder;
    on any other master that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="linescope-llm-")
        context.setCheckpointDir(folder)
    return folder


def saved(rows: DataFrame) -> DataFrame:
    """Write `rows` as Parquet to the shared folder and read them back.

    Cuts the lineage: what follows reads files that survive any executor, and
    a costly step whose rows are used twice runs once.  The files go when the
    application ends.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(rows.schema).parquet(path)


def free_name(rows: DataFrame, name: str) -> str:
    """`name`, made longer until `rows` has no such column, in any case."""
    taken = {column.lower() for column in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shipped(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that
    executors need no installation of their own."""
    package = Path(__file__).resolve().parents[1]
    context = spark.sparkContext
    if getattr(context, "_linescope_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="linescope-py-")) / "linescope_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))  # the driver serves it to the executors
    context._linescope_shipped = True


def python_tasks(spark: SparkSession, size: str = "8m") -> None:
    """Settings for Python tasks: the package is shipped, and Arrow batches end
    after `size` bytes, so that long texts do not gather by the thousand."""
    shipped(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
