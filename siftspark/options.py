"""Job options of a scan: a plain object handed to the plan builders."""

from __future__ import annotations

from dataclasses import dataclass, field

from siftspark.functions.patterns import REDACTIONS, Redaction

# Directories never scanned.
DEFAULT_IGNORES = (
    ".git/**", "**/.git/**", ".hg/**", "**/.hg/**", ".svn/**", "**/.svn/**",
    ".venv/**", "**/.venv/**", "venv/**", "**/venv/**", "env/**", "**/env/**",
    "__pycache__/**", "**/__pycache__/**", ".mypy_cache/**", "**/.mypy_cache/**",
    ".pytest_cache/**", "**/.pytest_cache/**", ".ruff_cache/**", "**/.ruff_cache/**",
    "node_modules/**", "**/node_modules/**", "target/**", "**/target/**",
    "build/**", "**/build/**", "dist/**", "**/dist/**", ".idea/**", "**/.idea/**",
    ".vscode/**", "**/.vscode/**", "generated/**", "**/generated/**",
    "vendor/**", "**/vendor/**",
)


# The supported languages by suffix.
SUFFIXES = ((".py", "python"), (".java", "java"))


@dataclass(frozen=True)
class ScanOptions:
    suffixes: tuple[tuple[str, str], ...] = SUFFIXES          # lower case, with the dot
    languages_include: tuple[str, ...] = ("python", "java")
    languages_exclude: tuple[str, ...] = ()
    ignore_patterns: tuple[str, ...] = ()
    default_ignores: tuple[str, ...] = DEFAULT_IGNORES
    ignore_files: tuple[str, ...] = (".gitignore", ".scanignore")
    max_file_bytes: int = 500 * 1024
    max_files: int | None = None
    block_mode: str = "scoped"            # "scoped" or "window"
    directive: str = "scan"               # prefix of the suppression comments
    window_radius: int = 8
    clip_chars: int = 5000
    max_snippets: int = 40
    max_snippets_per_file: int = 20
    min_confidence: float = 0.70
    redact: bool = True
    redactions: tuple[Redaction, ...] = REDACTIONS            # one after the other, in this order
    model: str = "external"
    catalog_version: str = "owasp-logging-exception-v1"
    report_formats: tuple[str, ...] = ("markdown",)
    fail_on_severity: str | None = None
    custom_rules: tuple = field(default_factory=tuple)

    def __post_init__(self):
        if self.block_mode not in ("scoped", "window"):
            raise ValueError(f"unknown block mode: {self.block_mode}")
