"""A quality gate that is fed while records pass by."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from linescope.operators.rollup import is_analyzed
from linescope.settings import Settings


class Check(NamedTuple):
    check: str
    exit_code: int
    passed: bool
    value: int
    limit: int


class GateError(Exception):
    """Checks that failed, all of them."""

    def __init__(self, failed: list[Check]):
        self.failed = failed
        self.exit_code = failed[0].exit_code
        super().__init__("; ".join(f"{c.check}: {c.value}, limit {c.limit}" for c in failed))


class Gate:
    """Counts what the checks of a run need while its records are written.

    `watch` attaches observed metrics to the records; the next action on what it
    returns fills them, with no job or pass of their own.  A file that the
    settings do not allow (binary, not decodable) is a count here, not an error
    in a task: analyse with `stop_early=False`, and the gate names every kind
    that failed instead of the first path.  A watch holds for one action.
    """

    def __init__(self, settings: Settings | None = None, fail_on_warnings: bool = False, fail_below: int | None = None):
        analysis = (settings or Settings()).analysis
        self.no_binary = analysis.binary_file_behavior == "fail"
        self.no_broken = analysis.decode_failure_behavior == "fail"
        self.fail_on_warnings, self.fail_below = fail_on_warnings, fail_below
        self.observation: Observation | None = None

    def watch(self, records: DataFrame) -> DataFrame:
        self.observation = Observation()
        status = F.col("status")
        return records.observe(
            self.observation,
            F.coalesce(F.sum(F.size("warnings").cast("bigint")), F.lit(0)).alias("warnings"),
            F.coalesce(F.sum(F.when(is_analyzed(), F.col("effective.code_lines"))), F.lit(0)).alias("code"),
            F.count_if(status == "skipped_binary").alias("binary"),
            F.count_if(status == "skipped_decode_error").alias("broken"),
        )

    def checks(self) -> list[Check]:
        """The requested checks, in the order of their exit codes; waits for the
        action on the watched records."""
        if self.observation is None:
            raise ValueError("no records were watched")
        seen = self.observation.get
        found = []
        if self.no_binary:
            found.append(Check("no_binary_files", 1, seen["binary"] == 0, seen["binary"], 0))
        if self.no_broken:
            found.append(Check("no_decode_errors", 1, seen["broken"] == 0, seen["broken"], 0))
        if self.fail_on_warnings:
            found.append(Check("no_warnings", 2, seen["warnings"] == 0, seen["warnings"], 0))
        if self.fail_below is not None:
            found.append(Check("code_lines", 3, seen["code"] >= self.fail_below, seen["code"], self.fail_below))
        return found

    def enforce(self) -> None:
        """Raise with all failed checks, if any."""
        failed = [check for check in self.checks() if not check.passed]
        if failed:
            raise GateError(failed)
