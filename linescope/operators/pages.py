"""Pages of a long sorted table without reading the rows in front of them.

The table is written once in its order: dealt to ranges, a folder each, and
sorted inside.  A small index holds the first place, the number of rows and the
last key of each range.  A page then reads the ranges that hold it, and inside of
these the row groups that the stored places or keys allow.
"""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_GROUP_BYTES = 1024 * 1024  # row groups of about a thousand rows of history


class Range(NamedTuple):
    number: int
    start: int  # rows in front of it
    rows: int
    last: tuple  # order of its last row


def _order(rows: DataFrame, column: str, tie: str, ascending: bool) -> tuple[dict[str, Column], list[Column]]:
    """Sort columns and their directions; text by its lower case.  Nulls come
    first upwards and last downwards."""
    key = F.lower(column) if dict(rows.dtypes)[column] == "string" else F.col(column)
    late = key.isNotNull() if ascending else key.isNull()
    columns = {"_late": late.cast("int"), "_key": key, "_tie": F.col(tie)}
    return columns, [F.col("_late"), F.col("_key") if ascending else F.desc("_key"), F.col("_tie")]


def save_sorted(rows: DataFrame, path: str, column: str, tie: str, ascending: bool = True, ranges: int | None = None) -> None:
    """Write `rows` by `column` and a unique `tie`; `ranges` is left to Spark
    unless it is given."""
    spark = rows.sparkSession
    added, order = _order(rows, column, tie, ascending)
    dealt = rows.withColumns(added).repartitionByRange(*([ranges] if ranges else []), *order).withColumn("_range", F.spark_partition_id())
    placed = dealt.sortWithinPartitions("_range", *order).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed.write.mode("overwrite").partitionBy("_range").option("parquet.block.size", _GROUP_BYTES).parquet(f"{path}/rows")
    placed.limit(0).write.mode("overwrite").parquet(f"{path}/shape")  # an empty table has no rows to tell it
    saved = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    last = F.max_by(F.struct("_late", "_key", "_tie"), "_place").alias("last")
    saved.groupBy("_range").agg(F.count("*").alias("rows"), last).write.mode("overwrite").parquet(f"{path}/index")


class Pages:
    """Reads pages of what `save_sorted` wrote."""

    def __init__(self, spark: SparkSession, path: str, ascending: bool = True):
        self.table = spark.read.schema(spark.read.parquet(f"{path}/shape").schema).parquet(f"{path}/rows")
        self.ascending = ascending
        self.columns = [name for name in self.table.columns if name not in ("_late", "_key", "_tie", "_range", "_place")]
        self.ranges, start = [], 0
        for row in spark.read.parquet(f"{path}/index").orderBy("_range").collect():  # one row a range
            self.ranges.append(Range(row["_range"], start, row.rows, tuple(row.last)))
            start += row.rows

    def _sorted(self, rows: DataFrame) -> DataFrame:
        return rows.orderBy("_range", "_place")

    def page(self, number: int, per_page: int = 25) -> DataFrame:
        """A page by its number, from 1: what an offset into the sorted table gives."""
        first = (number - 1) * per_page
        held = F.lit(False)
        for r in self.ranges:
            low, high = max(first, r.start) - r.start, min(first + per_page, r.start + r.rows) - r.start
            if low < high:
                held = held | ((F.col("_range") == r.number) & (F.col("_place") >= low) & (F.col("_place") < high))
        return self._sorted(self.table.where(held)).select(*self.columns)

    def _behind(self, seen: tuple) -> Column:
        late, key, tie = seen
        beyond = F.col("_late") > late
        if key is None:
            return beyond | ((F.col("_late") == late) & (F.col("_tie") > tie))
        further = F.col("_key") > key if self.ascending else F.col("_key") < key
        return beyond | ((F.col("_late") == late) & (further | ((F.col("_key") == key) & (F.col("_tie") > tie))))

    def _is_behind(self, order: tuple, seen: tuple) -> bool:
        (late, key, tie), (seen_late, seen_key, seen_tie) = order, seen
        if late != seen_late:
            return late > seen_late
        if key == seen_key:
            return tie > seen_tie
        return (key > seen_key) == self.ascending

    def after(self, key: Any, tie: Any, per_page: int = 25) -> DataFrame:
        """The page behind the last row that was seen, by its sort value (text in
        lower case) and tie.  That row need not be there any more."""
        seen = (int((key is not None) == self.ascending), key, tie)
        chosen, sure = [], 0
        for r in self.ranges:
            if sure >= per_page or not self._is_behind(r.last, seen):
                continue
            sure += r.rows if chosen else 1  # the first may hold no more than its last row
            chosen.append(r.number)
        rows = self.table.where(F.col("_range").isin(chosen) & self._behind(seen))
        return self._sorted(rows).limit(per_page).select(*self.columns)
