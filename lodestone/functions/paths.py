"""Classification of paths: languages, ignored directories, binary files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import base_name, choice, suffix

# Suffix to language.
LANGUAGES = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".java": "java",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".c": "c",
    ".h": "c",
    ".hpp": "cpp",
    ".go": "go",
    ".rs": "rust",
    ".rb": "ruby",
    ".php": "php",
    ".cs": "csharp",
    ".swift": "swift",
    ".kt": "kotlin",
    ".scala": "scala",
    ".md": "markdown",
    ".json": "json",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".toml": "toml",
    ".xml": "xml",
    ".html": "html",
    ".css": "css",
    ".sql": "sql",
    ".sh": "shell",
    ".bat": "batch",
    ".ps1": "powershell",
    ".dockerfile": "dockerfile",
}
DOCKER_NAMES = ["dockerfile", "dockerfile.dev", "dockerfile.prod"]
# Directory names that a scan does not enter.
IGNORED_DIRS = [
    ".git", ".svn", ".hg", "node_modules", "__pycache__", ".mypy_cache", ".pytest_cache", "venv", ".venv", "env", ".env",
    ".tox", ".nox", "dist", "build", ".eggs", "*.egg-info", ".idea", ".vscode", "qdrant_data", "neo4j_data",
]
# Suffixes of files that are not text.
BINARY_SUFFIXES = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".woff", ".woff2", ".ttf", ".eot", ".pdf", ".doc", ".docx",
    ".xls", ".xlsx", ".zip", ".tar", ".gz", ".bz2", ".7z", ".rar", ".exe", ".dll", ".so", ".dylib", ".o", ".a", ".pyc",
    ".pyo", ".class", ".jar", ".mp3", ".mp4", ".avi", ".mov", ".wav", ".sqlite", ".db",
]


def language(path: Column) -> Column:
    """Language by name; null where unknown."""
    return F.when(F.lower(base_name(path)).isin(DOCKER_NAMES), "dockerfile").otherwise(choice(LANGUAGES, suffix(path)))


def is_ignored_dir(name: Column) -> Column:
    return name.isin(IGNORED_DIRS) | F.startswith(name, F.lit("."))


def in_ignored_dir(path: Column) -> Column:
    """Whether any directory of a relative path is ignored; the file's own name is not tested."""
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), is_ignored_dir)


def is_binary(path: Column) -> Column:
    return suffix(path).isin(BINARY_SUFFIXES)


def ignores_dir(name: str) -> bool:
    """is_ignored_dir for one name, for the sources' own walk."""
    return name in IGNORED_DIRS or name.startswith(".")


def binary_name(name: str) -> bool:
    dot = name.rfind(".")
    return dot > 0 and name[dot:].lower() in BINARY_SUFFIXES
