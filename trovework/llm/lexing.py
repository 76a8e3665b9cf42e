"""A small lexer: comments and string literals of the languages by file extension.

One regular expression a family finds the comments and literals; what lies between is code. It is the
helper that the operators of this package run inside tasks; all grouping and joining is left to Spark.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: File extensions by language.
EXTENSIONS = {
    "java": "java", "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript",
    "ts": "typescript", "tsx": "typescript", "go": "go", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp",
    "hpp": "cpp", "cs": "csharp", "rs": "rust", "rb": "ruby", "php": "php", "kt": "kotlin", "kts": "kotlin",
    "scala": "scala", "sc": "scala", "swift": "swift", "toml": "toml", "yml": "yaml", "yaml": "yaml", "json": "json",
    "xml": "xml", "properties": "properties", "env": "dotenv", "sh": "shell", "bash": "shell",
}
CONFIG = frozenset({"toml", "yaml", "json", "xml", "properties", "dotenv", "shell"})
#: Other spellings of the language column.
ALIASES = {"py": "python", "js": "javascript", "ts": "typescript", "golang": "go", "c++": "cpp", "c#": "csharp", "cs": "csharp", "rs": "rust", "rb": "ruby", "kt": "kotlin", "yml": "yaml", "env": "dotenv", "sh": "shell", "bash": "shell"}


def language_of(path: str | None, language: str | None = None) -> str:
    """The language by the file's extension, else by the language column, else empty."""
    base = (path or "").rsplit("/", 1)[-1]
    ext = base.rsplit(".", 1)[-1].lower() if "." in base else ""
    if ext in EXTENSIONS:
        return EXTENSIONS[ext]
    name = (language or "").strip().lower()
    name = ALIASES.get(name, name)
    return name if name in EXTENSIONS.values() else ""


_LINE = r"//[^\n]*"
_BLOCK = r"/\*.*?(?:\*/|\Z)"
_HASH = r"\#[^\n]*"
_DQ = r'"(?:\\.|[^"\\\n])*"'
_SQ = r"'(?:\\.|[^'\\\n])*'"
_DQM = r'"(?:\\.|[^"\\])*"'
_SQM = r"'(?:\\.|[^'\\])*'"
_CHAR = r"'(?:\\[^\n']*|[^'\\\n])'"
_TDQ = r'"""(?:\\.|[^\\])*?"""'
_TSQ = r"'''(?:\\.|[^\\])*?'''"
_RAWT = r'"""[\s\S]*?"""'
_TICK = r"`(?:\\.|[^`\\])*`"
_C = f"{_LINE}|{_BLOCK}"
#: By language: the patterns of comments and of literals.
_PATTERNS = {
    "java": (_C, f"{_TDQ}|{_DQ}|{_SQ}"),
    "kotlin": (_C, f"{_RAWT}|{_DQ}|{_CHAR}"),
    "scala": (_C, f"{_RAWT}|{_DQ}|{_CHAR}"),
    "swift": (_C, f"{_RAWT}|{_DQ}"),
    "javascript": (_C, f"{_TICK}|{_DQ}|{_SQ}"),
    "typescript": (_C, f"{_TICK}|{_DQ}|{_SQ}"),
    "go": (_C, f"`[^`]*`|{_DQ}|{_CHAR}"),
    "c": (_C, f"{_DQ}|{_SQ}"),
    "cpp": (_C, rf'R"(?P<cd>[^(\s\\"]*)\([\s\S]*?\)(?P=cd)"|{_DQ}|{_SQ}'),
    "csharp": (_C, rf'"""[\s\S]*?"""|@\$?"(?:""|[^"])*"|{_DQ}|{_CHAR}'),
    "rust": (_C, rf'\br(?P<rh>\#*)"[\s\S]*?"(?P=rh)|{_DQM}|{_CHAR}'),
    "php": (rf"{_C}|\#(?!\[)[^\n]*", rf"<<<[ \t]*['\"]?(?P<ph>\w+)['\"]?\r?\n[\s\S]*?\n[ \t]*(?P=ph)\b|{_DQM}|{_SQM}"),
    "python": (_HASH, f"(?<!\\w)[rbfuRBFU]{{0,2}}(?:{_TDQ}|{_TSQ}|{_DQ}|{_SQ})"),
    "ruby": (r"(?m:^=begin\b)[\s\S]*?(?m:^=end\b)|\#(?!\{)[^\n]*", rf"<<[~-]?(?P<rq>['\"]?)(?P<rt>[A-Z_]\w*)(?P=rq)[^\n]*\n[\s\S]*?\n[ \t]*(?P=rt)\b|{_DQM}|{_SQM}"),
    "shell": (r"(?:(?<=\s)|(?m:^))\#[^\n]*", f"{_DQM}|'[^']*'"),
    "yaml": (r"(?:(?<=\s)|(?m:^))\#[^\n]*", f"{_DQ}|'[^'\\n]*'"),
    "toml": (_HASH, f"{_TDQ}|{_TSQ}|{_DQ}|'[^'\\n]*'"),
    "properties": (r"(?m:^[ \t]*)[#!][^\n]*", r"(?!)"),
    "dotenv": (r"(?:(?<=\s)|(?m:^))\#[^\n]*", f"{_DQ}|'[^'\\n]*'"),
    "json": (r"(?!)", _DQ),
    "xml": (r"<!--[\s\S]*?(?:-->|\Z)", r"(?!)"),
}


@lru_cache(maxsize=64)
def scanner(language: str) -> re.Pattern | None:
    """Comments are in group c, literals in group s; None for an unknown language."""
    if language not in _PATTERNS:
        return None
    comment, literal = _PATTERNS[language]
    return re.compile(f"(?P<c>{comment})|(?P<s>{literal})", re.S)


_ESCAPED = re.compile(r"\\u\{?([0-9a-fA-F]{4,6})\}?|\\x([89a-fA-F][0-9a-fA-F])")


def unescape(content: str) -> str:
    r"""Letters written as \u00e9 become letters; characters below U+00A0 stay, so quotes and lines stay as they are."""
    if "\\u" not in content and "\\x" not in content:
        return content

    def one(m: re.Match) -> str:
        n = int(m[1] or m[2], 16)
        return chr(n) if 0xA0 <= n < 0xD800 or 0xDFFF < n <= 0x10FFFF else m[0]

    return _ESCAPED.sub(one, content)


def blank(text: str) -> str:
    """Spaces of the same length, with the line ends kept."""
    return "\n".join([" " * len(x) for x in text.split("\n")])
