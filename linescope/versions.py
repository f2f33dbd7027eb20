"""Tables that are replaced as a whole, by numbered versions.

A version is written to a folder of its own.  It counts from the moment its
marker, a small file named by the version's number, is renamed into place; the
rename fails when another writer took that number first.  A reader follows the
highest marker, so it sees one whole version, and goes on reading it when newer
ones appear.  The file system must refuse to rename onto an existing file
(HDFS and its kin do; on a local disk the test and the rename are two steps).
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class _Folder:
    """A folder of the file system that a path belongs to."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")
        place = self.at("")
        self.files = place.getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self.files.exists(self.at(name))

    def names(self, name: str) -> list[str]:
        return sorted(status.getPath().getName() for status in self.files.listStatus(self.at(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self.files.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.files.create(self.at(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.files.delete(self.at(name), True)

    def claim(self, source: str, target: str) -> bool:
        """Rename a file unless the target is there."""
        place = self.files.makeQualified(self.at(target))
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self.files.makeQualified(self.at(source)), place, options)
        except Py4JJavaError as error:
            if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True


def _numbers(folder: _Folder) -> list[int]:
    return [int(name) for name in folder.names("versions") if name.isdigit()]


def latest_version(spark: SparkSession, path: str) -> int:
    """Number of the newest version; 0 without any."""
    return max(_numbers(_Folder(spark, path)), default=0)


def version_path(spark: SparkSession, path: str, number: int) -> str:
    """The folder that holds a version's data."""
    folder = _Folder(spark, path)
    return f"{folder.path}/{json.loads(folder.read(f'versions/{number:012d}'))['data']}"


def write_version(rows: DataFrame, path: str, number: int) -> bool:
    """Write `rows` as the version of this number; False, and nothing left
    behind, when another writer took it."""
    folder = _Folder(rows.sparkSession, path)
    data = f"data/{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder.path}/{data}")
    if not _numbers(folder):
        folder.files.mkdirs(folder.at("versions"))
    draft = f"{data}/_marker"
    folder.write(draft, json.dumps({"data": data}))
    if folder.claim(draft, f"versions/{number:012d}"):
        return True
    folder.delete(data)
    return False


def drop_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Remove all but the newest versions, markers first.  A reader that still
    follows a removed version fails; keep as many as readers may lag behind."""
    folder = _Folder(spark, path)
    for number in sorted(_numbers(folder))[: -keep or None]:
        data = json.loads(folder.read(f"versions/{number:012d}"))["data"]
        folder.delete(f"versions/{number:012d}")
        folder.delete(data)
