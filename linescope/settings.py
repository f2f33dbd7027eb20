"""Analysis settings: defaults, TOML files, presets and validation.

Settings are small driver-side values.  They end up as literals in column
expressions, so Catalyst can fold and push them.
"""

from __future__ import annotations

import dataclasses
import json
import tomllib
from dataclasses import dataclass, field

from linescope.operators.languages import resolve_name

# The accepted words of three settings.
MIXED_LINE_POLICIES = ("code_only", "code_and_comment", "comment_only", "separate_mixed_category")
BINARY_BEHAVIORS = ("skip", "fail")
FAILURE_BEHAVIORS = ("warn_skip", "fail")


@dataclass(frozen=True)
class Discovery:
    root_paths: tuple[str, ...] = ()
    include_globs: tuple[str, ...] = ()
    exclude_globs: tuple[str, ...] = ()
    excluded_directories: tuple[str, ...] = (".git", "node_modules", "target")
    honor_ignore_files: bool = True
    ignore_hidden_files: bool = True
    follow_symlinks: bool = False
    max_file_size_bytes: int = 2 * 1024 * 1024
    parallelism_limit: int | None = None  # accepted, Spark decides
    submodule_breakdown: bool = True
    allowed_scan_roots: tuple[str, ...] = ()


@dataclass(frozen=True)
class Analysis:
    enabled_languages: tuple[str, ...] = ()
    extension_overrides: dict[str, str] = field(default_factory=dict)
    shebang_detection: bool = True
    mixed_line_policy: str = "code_only"
    python_docstrings_as_comments: bool = True
    generated_file_detection: bool = True
    minified_file_detection: bool = True
    vendor_directory_detection: bool = True
    include_lockfiles: bool = False
    binary_file_behavior: str = "skip"
    decode_failure_behavior: str = "warn_skip"
    parse_failure_behavior: str = "warn_skip"  # accepted, never consulted
    # Leading bytes the content tests look at; None is the whole content.
    generated_sample_bytes: int | None = 1024
    minified_sample_bytes: int | None = 4096
    binary_sample_bytes: int | None = 8192


@dataclass(frozen=True)
class Reporting:
    report_title: str = "Source Line Report"
    output_formats: tuple[str, ...] = ("cli", "json", "html")
    include_summary_charts: bool = True
    include_skipped_files_section: bool = True
    include_warnings_section: bool = True
    theme: str = "auto"


@dataclass(frozen=True)
class Settings:
    discovery: Discovery = field(default_factory=Discovery)
    analysis: Analysis = field(default_factory=Analysis)
    reporting: Reporting = field(default_factory=Reporting)

    def __post_init__(self) -> None:
        if self.discovery.max_file_size_bytes <= 0:
            raise ValueError("the size limit of a file must be positive")
        for value, domain in (
            (self.analysis.mixed_line_policy, MIXED_LINE_POLICIES),
            (self.analysis.binary_file_behavior, BINARY_BEHAVIORS),
            (self.analysis.decode_failure_behavior, FAILURE_BEHAVIORS),
            (self.analysis.parse_failure_behavior, FAILURE_BEHAVIORS),
        ):
            if value not in domain:
                raise ValueError(f"unknown setting value: {value}")
        self.enabled_languages()

    def enabled_languages(self) -> list[str] | None:
        """Display names of the enabled languages; None enables all."""
        names = [(name, resolve_name(name)) for name in self.analysis.enabled_languages]
        unknown = [name for name, language in names if language is None]
        if unknown:
            raise ValueError(f"no such language: {unknown[0]}")
        return sorted({language for _, language in names}) or None

    def extension_languages(self) -> dict[str, str]:
        """Usable extension overrides; values that name no language are ignored."""
        pairs = {ext: resolve_name(name) for ext, name in self.analysis.extension_overrides.items()}
        return {ext: language for ext, language in pairs.items() if language}

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self))

    def updated(self, **sections: dict) -> Settings:
        """A copy with some fields of some sections replaced."""
        return dataclasses.replace(
            self,
            **{name: dataclasses.replace(getattr(self, name), **values) for name, values in sections.items()},
        )

    def excluding_output(self, project_root: str, output_dir: str) -> Settings:
        """Keep results of earlier runs out of the counts: the output folder
        inside the project, and every folder of a fixed name, become excluded."""
        names = list(self.discovery.excluded_directories)
        root = project_root.rstrip("/") + "/"
        inside = output_dir[len(root):].split("/")[0] if output_dir.startswith(root) else ""
        # Fixed value: the customary name of an output folder.
        names += [name for name in (inside, "sloc") if name and name not in names]
        return self.updated(discovery={"excluded_directories": tuple(names)})


def _section(kind: type, values: dict):
    known = {f.name for f in dataclasses.fields(kind)}
    cleaned = {}
    for name, value in values.items():
        if name in known:
            cleaned[name] = tuple(value) if isinstance(value, list) else value
            if name.endswith(("_policy", "_behavior")):
                cleaned[name] = value.replace("-", "_")
    return kind(**cleaned)


def parse_settings(text: str) -> Settings:
    """Settings from TOML text; fields that are absent keep their defaults."""
    data = tomllib.loads(text)
    return Settings(
        _section(Discovery, data.get("discovery", {})),
        _section(Analysis, data.get("analysis", {})),
        _section(Reporting, data.get("reporting", {})),
    )


def load_settings(path: str) -> Settings:
    with open(path, encoding="utf-8") as file:
        return parse_settings(file.read())


# The three published presets.
_BUILD_DIRECTORIES = (".git", "node_modules", "target", ".venv", "__pycache__", "dist", "build")
PRESETS = {
    "default": Settings(Discovery(excluded_directories=_BUILD_DIRECTORIES)),
    "strict": Settings(
        Discovery(excluded_directories=_BUILD_DIRECTORIES, max_file_size_bytes=1048576),
        Analysis(mixed_line_policy="separate_mixed_category", binary_file_behavior="fail"),
    ),
    "full_scope": Settings(
        Discovery(
            excluded_directories=(".git",),
            honor_ignore_files=False,
            ignore_hidden_files=False,
            max_file_size_bytes=10485760,
        ),
        Analysis(
            mixed_line_policy="code_and_comment",
            generated_file_detection=False,
            minified_file_detection=False,
            vendor_directory_detection=False,
            include_lockfiles=True,
        ),
    ),
}
