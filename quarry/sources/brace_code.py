"""Functions and classes of languages with braces, by pattern and matching of braces outside strings and comments."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

FUNCTIONS = "path string, kind string, name string, line int, loc int, params array<string>, returns string, body string, nesting int, branches int"

# How a function or class begins, by language: name, parameters and return type are groups n, p and r.
_NAME = r"(?P<n>[A-Za-z_$][\w$]*)"
_ARGS = r"\((?P<p>[^()]*(?:\([^()]*\)[^()]*)*)\)"
HEADS = {
    "typescript": rf"(?:\bfunction\s*\*?\s*{_NAME}\s*(?:<[^>]*>)?\s*{_ARGS}\s*(?::\s*(?P<r>[^{{=]+?))?\s*\{{)|(?:\b(?:const|let|var)\s+(?P<n2>[\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\((?P<p2>[^()]*)\)|(?P<p3>\w+))\s*(?::\s*[^=]+?)?=>\s*\{{)",
    "csharp": rf"(?:\b(?:public|private|protected|internal|static|async|override|virtual|sealed)\s+)+(?P<r>[\w<>\[\],.?]+)\s+{_NAME}\s*{_ARGS}\s*(?:where[^{{]+)?\{{",
    "go": rf"\bfunc\s+(?:\([^)]*\)\s*)?{_NAME}\s*{_ARGS}\s*(?P<r>\([^)]*\)|[\w*.\[\]]*)\s*\{{",
    "dart": rf"(?P<r>[A-Za-z_][\w<>?,]*)\s+{_NAME}\s*{_ARGS}\s*(?:async\*?|sync\*)?\s*\{{",
    "java": rf"(?:\b(?:public|private|protected|static|final|abstract|synchronized)\s+)+(?:<[^>]+>\s*)?(?P<r>[\w<>\[\],.?]+)\s+{_NAME}\s*{_ARGS}\s*(?:throws[^{{]+)?\{{",
    "rust": rf"\bfn\s+{_NAME}\s*(?:<[^>]*>)?\s*{_ARGS}\s*(?:->\s*(?P<r>[^{{]+?))?\s*\{{",
}
HEADS["javascript"] = HEADS["typescript"]
ENDINGS = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "cs": "csharp", "go": "go", "dart": "dart", "java": "java", "rs": "rust"}
_CLASS = re.compile(rf"\b(?:class|struct|interface)\s+{_NAME}[^;{{]*\{{")
_KEYWORDS = frozenset("if for while switch catch return else do try using lock foreach when match new function".split())
_BRANCH = re.compile(r"\b(?:if|for|while|case|catch|foreach)\b|&&|\|\||\?\?")


def blanked(text: str) -> str:
    """text with the insides of strings and comments replaced by spaces, line feeds kept."""
    spaces = lambda m: re.sub(r"[^\n]", " ", m[0])
    return re.sub(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`', spaces, text, flags=re.S)


def _closing(code: str, opened: int) -> int:
    """The place after the brace that closes the one at a place; the end if none does."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, opened):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(code)


def _params(text: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in text + ",":
        depth += (c in "(<[{") - (c in ")>]}")
        if c == "," and depth <= 0:
            if part.strip():
                out.append(part.strip())
            part = ""
        else:
            part += c
    names = [re.split(r"[:=]", p)[0].strip().lstrip(".") for p in out]
    return [n.split()[-1] if " " in n else n for n in names if n]


def _deepest(code: str) -> int:
    depth = most = 0
    for c in code:
        if c == "{":
            depth += 1
            most = max(most, depth)
        elif c == "}":
            depth -= 1
    return most


def file_functions(path: str, text: str | None) -> Iterator[tuple]:
    language = ENDINGS.get(path.rpartition(".")[2])
    if not language or not text:
        return
    code = blanked(text)
    for kind, pattern in (("function", re.compile(HEADS[language])), ("class", _CLASS)):
        for m in pattern.finditer(code):
            g = m.groupdict()
            name = g.get("n") or g.get("n2")
            if not name or name in _KEYWORDS or (g.get("r") or "") in _KEYWORDS:
                continue
            opened = m.end() - 1
            end = _closing(code, opened)
            line = code.count("\n", 0, m.start() + len(m[0]) - len(m[0].lstrip())) + 1
            inner = code[opened:end]
            body = "\n".join(x.strip() for x in text[opened + 1 : end - 1].splitlines() if x.strip() and not x.strip().startswith(("//", "console.", "*", "/*")))
            yield path, kind, name, line, code.count("\n", m.start(), end) + 1, _params(g.get("p") or g.get("p2") or g.get("p3") or ""), (g.get("r") or "").strip(), body, _deepest(inner) - 1, 1 + len(_BRANCH.findall(inner))


def functions(files: DataFrame) -> DataFrame:
    """Functions and classes of files (path, content), by the ending of their path; nesting is that of braces, branches the decisions and one. Files of other languages, null and empty ones have none."""
    names = [c.split()[0] for c in FUNCTIONS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([r for p, t in zip(batch["path"], batch["content"], strict=True) for r in file_functions(p, t)], columns=names)

    return files.select("path", "content").mapInPandas(run, FUNCTIONS)
