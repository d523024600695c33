"""Name and path patterns as column expressions, reduced to the cheapest string operation that says the same."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed


def glob_regex(glob: str, path: bool = False) -> str:
    """A whole-string regex. In names `*` is any text; in paths it stops at separators and `**` does not."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            deep = glob[i : i + 2] == "**"
            out += ".*" if deep or not path else r"[^\\/]*"
            i += 1 + deep
            continue
        if c == "?":
            out += r"[^\\/]" if path else "."
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body.startswith("!") else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^(?s:{out})$"


def match(column: Column, pattern: str, case_sensitive: bool = False, whole: bool = False) -> Column:
    """`>regex`, `a|b` alternatives, a glob if it has any of * ? [, else a substring (with `whole`, equality)."""
    if pattern.startswith(">"):
        return column.rlike(pattern[1:] if case_sensitive else f"(?i){pattern[1:]}")
    if "|" in pattern:
        out = F.lit(False)
        for part in filter(None, pattern.split("|")):
            out = out | match(column, part, case_sensitive, whole)
        return out
    text, word = (column, pattern) if case_sensitive else (F.lower(column), pattern.lower())
    if not re.search(r"[*?\[]", word):
        return text == word if whole else text.contains(word)
    inner = word.strip("*")
    if not inner:
        return F.lit(True) if "?" not in word and word else text.isNotNull()
    if not re.search(r"[*?\[]", inner):
        if word == inner + "*" * (len(word) - len(inner)):
            return text.startswith(inner)
        if word == "*" * (len(word) - len(inner)) + inner:
            return text.endswith(inner)
        return text.contains(inner)
    return text.rlike(glob_regex(word))


def regex_escape(text: str) -> str:
    return "".join("\\" + c if c in fixed.REGEX_META else c for c in text)


def match_path(column: Column, pattern: str, case_sensitive: bool = False) -> Column:
    """A path glob, its first segment unanchored, separators normalised; without case unless told."""
    body = pattern.replace("/", "\\")
    body = body if case_sensitive else body.lower()
    return (column if case_sensitive else F.lower(column)).rlike("(?:^|.*\\\\)" + glob_regex(body, path=True)[1:])
