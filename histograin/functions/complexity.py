"""Code complexity of file contents: syntax-based where the language is known, by indentation elsewhere.

Python files are parsed with the standard library's parser. Rust, Go, JavaScript and TypeScript are read by a lexer that
skips comments, strings and regular expressions and counts the constructs that branch; it is close to a grammar, not
one. ``backend`` says which of them judged a file. A file that the parser refuses is judged by the lexer as well.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .columns import LANGUAGES, WHITE

# The constructs that add one to a file's cyclomatic complexity, by language.
KEYWORDS = {
    "rust": ("if", "while", "for", "loop"),
    "go": ("if", "for", "case"),
    "js": ("if", "for", "while", "do", "case", "catch"),
    "ts": ("if", "for", "while", "do", "case", "catch"),
    "tsx": ("if", "for", "while", "do", "case", "catch"),
    "python": ("if", "elif", "for", "while", "except", "case"),
}


def language_of(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    return LANGUAGES.get(name.rsplit(".", 1)[-1]) if "." in name else None


def lines_of(text: str) -> list[str]:
    """Lines without their ends; only \\n, with a \\r before it, ends one."""
    out = [x.removesuffix("\r") for x in text.split("\n")]
    return out[:-1] if out and not out[-1] else out


def lines_of_code(text: str) -> int:
    return sum(bool(x.strip(WHITE)) for x in lines_of(text))


def indentation(text: str) -> int:
    """Sum over the lines that aren't blank of how many indents enclose them."""
    open_at: list[int] = []
    total = 0
    for line in lines_of(text):
        if not line.strip(WHITE):
            continue
        own = len(line.encode()) - len(line.lstrip(WHITE).encode())
        while open_at and open_at[-1] >= own:
            open_at.pop()
        total += len(open_at)
        open_at.append(own)
    return total


def _python(text: str) -> int:
    kinds = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.match_case, ast.IfExp)
    return 1 + sum(isinstance(x, kinds) for x in ast.walk(ast.parse(text)))


_C_LIKE = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_TOKENS = {
    "rust": re.compile(_C_LIKE + r"""|b?r(?P<h>\#*)".*?"(?P=h)|b?"(?:\\.|[^"\\])*"|b?'(?:\\.[^']*|[^'\\])'|(?P<word>'?[A-Za-z_]\w*)|(?P<op>=>|[{}();,|?:])""", re.S),
    "go": re.compile(_C_LIKE + r"""|`[^`]*`|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|(?P<word>[A-Za-z_]\w*)|(?P<op>[{}();,:])""", re.S),
    "js": re.compile(_C_LIKE + r"""|`(?:\\.|[^`\\])*`|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|(?P<word>[\w$]+)|(?P<op>\?\.(?!\d)|\?\?=?|=>|[{}()\[\];,?:.=/+*!&|<>-])""", re.S),
    "python": re.compile(r"""#[^\n]*|[rbfuRBFU]*(?:\"\"\".*?\"\"\"|'''.*?'''|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<word>[^\W\d]\w*)|(?P<op>[{}();,:=])""", re.S),
}
_TOKENS["ts"] = _TOKENS["tsx"] = _TOKENS["js"]
_SCRIPTS = ("js", "ts", "tsx")
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")


def _lex(text: str, language: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of words and operators."""
    pattern, at, last = _TOKENS[language], 0, ""
    while m := pattern.search(text, at):
        at = m.end()
        token = m["word"] or m["op"]
        if token == "/" and language in _SCRIPTS:
            if (not last or last in "{}([;,?:=+*!&|<>-" or last in ("return", "typeof", "case", "=>")) and (r := _REGEX.match(text, m.start())):
                at, last = r.end(), "regex"
            continue
        if token:
            yield ("word" if m["word"] else "op"), token
            last = token


def _lexed(text: str, language: str) -> int:
    """One and the branching constructs; arms of Rust's match by their arrows, JavaScript's ?: by question marks that no type or optional member takes."""
    keywords, total, tokens = KEYWORDS[language], 1, list(_lex(text, language))
    matches: list[int] = []  # depths of match bodies
    depth, expect = 0, False
    for i, (kind, t) in enumerate(tokens):
        before = tokens[i - 1][1] if i else ""
        after = tokens[i + 1][1] if i + 1 < len(tokens) else ""
        if language == "rust":
            if t == "match" and kind == "word":
                expect = True
            elif t == "{":
                depth += 1
                if expect:
                    matches.append(depth)
                    expect = False
            elif t == "}":
                if matches and matches[-1] == depth:
                    matches.pop()
                depth -= 1
            elif t == "=>" and matches:
                total += 1
                continue
            if t == "for" and (after == "<" or _is_impl(tokens, i)):
                continue
        if kind == "word" and t in keywords and before != ".":
            if t == "while" and language in _SCRIPTS and _ends_do(tokens, i):
                continue
            if after == ":" and language in _SCRIPTS and t != "case":
                continue  # the name of a property
            total += 1
        elif language in _SCRIPTS and t == "?" and after not in (":", ")", ",", "=", ";") and before not in ("",):
            total += 1
    return total


def _is_impl(tokens: list[tuple[str, str]], i: int) -> bool:
    """``for`` of ``impl Trait for Type``: an ``impl`` stands before it since the last brace or semicolon."""
    for _, t in reversed(tokens[max(0, i - 40) : i]):
        if t in ("{", "}", ";"):
            return False
        if t == "impl":
            return True
    return False


def _ends_do(tokens: list[tuple[str, str]], i: int) -> bool:
    """``while`` after the body of a ``do``."""
    if not i or tokens[i - 1][1] != "}":
        return False
    depth = 0
    for j in range(i - 1, -1, -1):
        depth += (tokens[j][1] == "}") - (tokens[j][1] == "{")
        if not depth:
            return j > 0 and tokens[j - 1][1] == "do"
    return False


def cyclomatic(text: str, language: str) -> tuple[int, str]:
    """The value, and what judged it: ast or lexer."""
    if language == "python":
        try:
            return _python(text), "ast"
        except (SyntaxError, ValueError, RecursionError):
            pass
    return _lexed(text, language), "lexer"


def file_complexity(path: str, content: bytes) -> dict:
    """lang, value, per_loc, loc, method and backend of a file; broken UTF-8 is replaced."""
    text = content.decode("utf-8", "replace")
    lang, loc = language_of(path), lines_of_code(text)
    value, backend = cyclomatic(text, lang) if lang else (indentation(text), "indentation")
    return {"lang": lang or "none", "value": float(value), "per_loc": value / loc if loc else 0.0, "loc": loc, "method": "cyclomatic" if lang else "indentation", "backend": backend}


VALUES = "blob_sha string, lang string, value double, per_loc double, loc int, method string, backend string"


def complexities(blobs: DataFrame) -> DataFrame:
    """Values of (blob_sha, path, content): one row for each blob and language. A null content counts as empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            own = [{"blob_sha": b, **file_complexity(p, bytes(c) if c is not None else b"")} for b, p, c in zip(f["blob_sha"], f["path"], f["content"], strict=True)]
            yield pd.DataFrame(own, columns=["blob_sha", "lang", "value", "per_loc", "loc", "method", "backend"])

    return blobs.select("blob_sha", "path", "content").mapInPandas(run, VALUES).dropDuplicates(["blob_sha", "lang"])
