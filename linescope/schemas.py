"""Schemas of the stored tables and of run JSON."""

from __future__ import annotations

RAW = (
    "struct<total_physical_lines:bigint,blank_only_lines:bigint,code_only_lines:bigint,"
    "single_comment_only_lines:bigint,multi_comment_only_lines:bigint,"
    "mixed_code_single_comment_lines:bigint,mixed_code_multi_comment_lines:bigint,"
    "docstring_comment_lines:bigint,skipped_unknown_lines:bigint>"
)
EFFECTIVE = "struct<code_lines:bigint,comment_lines:bigint,blank_lines:bigint,mixed_lines_separate:bigint>"

FILES = (
    "root string, path string, relative_path string, size_bytes bigint, is_symlink boolean, content binary"
)

FILE_RECORDS = (
    "run_id string, path string, relative_path string, language string, size_bytes bigint, "
    f"detected_encoding string, raw {RAW}, effective {EFFECTIVE}, status string, warnings array<string>, "
    "generated boolean, minified boolean, vendor boolean, parse_mode string, submodule string"
)

RUNS = (
    "run_id string, timestamp_utc timestamp, project_label string, input_roots array<string>, "
    "json_path string, html_path string, pdf_path string, files_analyzed bigint, files_skipped bigint, "
    "total_physical_lines bigint, code_lines bigint, comment_lines bigint, blank_lines bigint, "
    "git_branch string, git_commit string, git_author string, git_tags string, settings_json string"
)

LANGUAGE_ROW = (
    "struct<language:string,files:bigint,total_physical_lines:bigint,code_lines:bigint,"
    "comment_lines:bigint,blank_lines:bigint,mixed_lines_separate:bigint>"
)

FILE_JSON = (
    "struct<path:string,relative_path:string,language:string,size_bytes:bigint,detected_encoding:string,"
    f"raw_line_categories:{RAW},effective_counts:{EFFECTIVE},status:string,warnings:array<string>,"
    "generated:boolean,minified:boolean,vendor:boolean,parse_mode:string,submodule:string>"
)

RUN_JSON = (
    "tool struct<name:string,version:string,run_id:string,timestamp_utc:timestamp>, "
    "environment struct<operating_system:string,architecture:string,runtime_mode:string,"
    "initiator_username:string,initiator_hostname:string>, "
    "input_roots array<string>, "
    "summary_totals struct<files_considered:bigint,files_analyzed:bigint,files_skipped:bigint,"
    "total_physical_lines:bigint,code_lines:bigint,comment_lines:bigint,blank_lines:bigint,"
    "mixed_lines_separate:bigint>, "
    f"totals_by_language array<{LANGUAGE_ROW}>, "
    f"per_file_records array<{FILE_JSON}>, skipped_file_records array<{FILE_JSON}>, warnings array<string>, "
    "submodule_summaries array<struct<name:string,relative_path:string,files_analyzed:bigint,"
    "total_physical_lines:bigint,code_lines:bigint,comment_lines:bigint,blank_lines:bigint,"
    f"language_summaries:array<{LANGUAGE_ROW}>>>, "
    "git_commit_short string, git_commit_long string, git_branch string, git_commit_author string, git_tags string"
)

#: One row of the `files` table of a saved run.
FILE_ROW = (
    "path string, relative_path string, language string, size_bytes bigint, detected_encoding string, "
    f"raw_line_categories {RAW}, effective_counts {EFFECTIVE}, status string, warnings array<string>, "
    "generated boolean, minified boolean, vendor boolean, parse_mode string, submodule string"
)

#: The one row of the `run` table of a saved run.
RUN_DOCUMENT = (
    ", ".join(part for part in RUN_JSON.split(", ") if not part.startswith(("per_file_records", "skipped_file_records", "warnings")))
    + ", effective_configuration string"
)
