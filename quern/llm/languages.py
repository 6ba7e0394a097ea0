"""Languages by file suffix, and the tokens that tell comments and strings from code."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

#: Leading dots belong to the name, so a dotfile has no suffix.
SUFFIX = r"(?s)(?:^|/)\.*[^./][^/]*(\.[^./]*)\z"

_DOUBLE = r'"(?:[^"\\\n]|\\[\s\S])*"'
_SINGLE = r"'(?:[^'\\\n]|\\[\s\S])*'"
_C = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|" + _DOUBLE + "|" + _SINGLE
_TRIPLE = r'"""[\s\S]*?(?:"""|\Z)|' + r"'''[\s\S]*?(?:'''|\Z)|"
_TOKENS = {
    "c": _C,
    "js": _C + r"|`(?:[^`\\]|\\[\s\S])*`",
    "go": _C + r"|`[^`]*`",
    "php": r"#(?!\[)[^\n]*|" + r'//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|"(?:[^"\\]|\\[\s\S])*"|' + r"'(?:[^'\\]|\\[\s\S])*'",
    "python": r"#[^\n]*|" + _TRIPLE + _DOUBLE + "|" + _SINGLE,
    "hash": r"(?m:(?:^|(?<=\s))#[^\n]*)|" + _DOUBLE + "|" + _SINGLE,
    "css": r"/\*[\s\S]*?(?:\*/|\Z)|" + _DOUBLE + "|" + _SINGLE,
    "xml": r"<!--[\s\S]*?(?:-->|\Z)",
    "sql": r"--[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|" + "'(?:[^']|'')*'",
    "none": r"(?!)",
}
TOKENS = {k: re.compile(v) for k, v in _TOKENS.items()}
OPENS = {"c": ("//", "/*"), "js": ("//", "/*"), "go": ("//", "/*"), "php": ("//", "/*", "#"), "python": ("#",), "hash": ("#",), "css": ("/*",), "xml": ("<!--",), "sql": ("--", "/*"), "none": ()}
FAMILY = {
    ".py": "python", ".js": "js", ".jsx": "js", ".mjs": "js", ".ts": "js", ".tsx": "js", ".java": "c", ".c": "c", ".h": "c", ".cc": "c", ".cpp": "c", ".hpp": "c", ".cs": "c", ".kt": "c", ".scala": "c",
    ".swift": "c", ".rs": "c", ".go": "go", ".php": "php", ".rb": "hash", ".sh": "hash", ".bash": "hash", ".pl": "hash", ".r": "hash", ".yml": "hash", ".yaml": "hash", ".toml": "hash", ".ini": "hash",
    ".cfg": "hash", ".conf": "hash", ".css": "css", ".scss": "js", ".xml": "xml", ".html": "xml", ".htm": "xml", ".md": "xml", ".sql": "sql",
}
CODE = {".py", ".js", ".jsx", ".mjs", ".ts", ".tsx", ".java", ".c", ".h", ".cc", ".cpp", ".hpp", ".cs", ".kt", ".scala", ".swift", ".rs", ".go", ".php", ".rb", ".sh", ".bash", ".pl", ".r"}


def suffix(column: str = "file_path"):
    return F.lower(F.regexp_extract(column, SUFFIX, 1))


def comments(text: str, family: str) -> list[str]:
    opens = OPENS[family]
    return [t for t in TOKENS[family].findall(text) if t.startswith(opens)] if opens else []
