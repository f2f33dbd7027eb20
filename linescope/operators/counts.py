"""Raw line counters to reported counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linescope.settings import MIXED_LINE_POLICIES

EFFECTIVE_FIELDS = ["code_lines", "comment_lines", "blank_lines", "mixed_lines_separate"]


def effective_counts(raw: Column, policy: str | Column, docstrings_as_comments: bool | Column = True) -> Column:
    """Code, comment, blank and separately kept mixed lines.

    `policy` is a setting or a column, so all policies can be compared in one
    pass.
    """
    policy = F.lit(policy) if isinstance(policy, str) else policy
    as_comments = F.lit(docstrings_as_comments) if isinstance(docstrings_as_comments, bool) else docstrings_as_comments
    code_only, both, comment_only, separate = (policy == name for name in MIXED_LINE_POLICIES)
    mixed = raw["mixed_code_single_comment_lines"] + raw["mixed_code_multi_comment_lines"]
    comments = raw["single_comment_only_lines"] + raw["multi_comment_only_lines"]
    docs, none = raw["docstring_comment_lines"], F.lit(0)
    return F.struct(
        (raw["code_only_lines"] + F.when(as_comments, none).otherwise(docs)
         + F.when(code_only | both, mixed).otherwise(none)).alias("code_lines"),
        (comments + F.when(as_comments, docs).otherwise(none)
         + F.when(comment_only | both, mixed).otherwise(none)).alias("comment_lines"),
        raw["blank_only_lines"].alias("blank_lines"),
        F.when(separate, mixed).otherwise(none).cast("bigint").alias("mixed_lines_separate"),
    )
