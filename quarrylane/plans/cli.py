"""Command-line words to a search and its aggregate specs."""

from __future__ import annotations

import argparse
import datetime as dt
import re

from .search import SearchParams
from .specs import parse_size


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="search", exit_on_error=False, add_help=False)
    p.add_argument("pattern", nargs="?")
    for flag in ("files-only", "dirs-only", "hide-system", "hide-ads", "case", "smart-case", "word", "name-only", "count", "rows", "sort-desc", "malformed", "well-formed", "malformed-path", "deleted"):
        p.add_argument(f"--{flag}", action="store_true")
    for flag in ("begins-with", "ends-with", "contains", "not-contains", "exclude", "in-path", "not-in-path", "type", "ext", "attr", "month", "between", "sort", "columns", "drive", "drives"):
        p.add_argument(f"--{flag}")
    for end in ("newer", "older"):
        for field in ("", "-created", "-accessed"):
            p.add_argument(f"--{end}{field}")
    for field in ("size", "size-on-disk", "treesize", "tree-allocated", "descendants", "name-length", "path-length", "bulkiness"):
        for end in ("min", "max", "exact"):
            p.add_argument(f"--{end}-{field}")
    p.add_argument("--limit", "-n", type=int, default=0)
    p.add_argument("--offset", type=int, default=0)
    for flag in ("agg", "facet", "stats", "histogram"):
        p.add_argument(f"--{flag}", action="append", default=[])
    return p


def _extensions(pattern: str) -> list[str] | None:
    """Extensions of a pattern that asks for nothing else: `*.ext` or `>.*\\.(a|b)$`."""
    if m := re.fullmatch(r"\*\.(\w+)", pattern, re.ASCII):
        return [m[1].lower()]
    if m := re.fullmatch(r">\.\*\\\.(?:\((\w+(?:\|\w+)*)\)|(\w+))\$", pattern, re.ASCII):
        return (m[1] or m[2]).lower().split("|")
    return None


def parse_args(words: list[str], now: dt.datetime | None = None) -> tuple[SearchParams, list[str]]:
    """(search, aggregate specs). An unknown flag, a path where only names are asked for, or a bad number is an error."""
    try:
        a = _parser().parse_args(words)
    except (argparse.ArgumentError, SystemExit) as e:
        raise ValueError(str(e)) from e
    sugar = (a.begins_with and f"{a.begins_with}*") or (a.ends_with and f"*{a.ends_with}") or (a.contains and f"*{a.contains}*")
    pattern, whole_path, mode = a.pattern or sugar or "*", False, "files" if a.files_only else "dirs" if a.dirs_only else "all"
    drives = [d.strip().rstrip(":").upper() for d in (a.drives or a.drive or "").split(",") if d.strip()]
    if pattern.startswith("path:"):
        whole_path, pattern = True, pattern[5:]
    elif pattern.startswith("dir:"):
        mode, pattern = "dirs", pattern[4:]
    elif pattern.startswith("file:"):
        mode, pattern = "files", pattern[5:]
    elif re.match(r"[A-Za-z]:[^\\/]", pattern):
        drives, pattern = drives or [pattern[0].upper()], pattern[2:]
    if a.name_only and not pattern.startswith(">") and re.search(r"[\\/]", pattern):
        raise ValueError("a name has no path separators")
    case = a.case or (a.smart_case and pattern != pattern.lower())
    ext = a.ext or ""
    if not whole_path and not case and not ext and (found := _extensions(pattern)):
        ext, pattern = ",".join(found), "*"
    ranges, fields = {}, {"size": "size", "size-on-disk": "size_on_disk", "treesize": "tree_size", "tree-allocated": "tree_allocated", "descendants": "descendants", "name-length": "name_length", "path-length": "path_length", "bulkiness": "bulkiness"}
    for flag, field in fields.items():
        low, high, exact = (getattr(a, f"{end}_{flag.replace('-', '_')}") for end in ("min", "max", "exact"))
        scale = 10_000 if field == "bulkiness" else 1  # given in percent
        number = lambda v, s=scale: None if v is None else parse_size(v) * s
        low, high = number(exact or low), number(exact or high)
        if low is not None or high is not None:
            ranges[field] = (low, high)
    start, end = (a.between.split(",", 1) + [None])[:2] if a.between else (None, None)
    newer = {"modified": a.newer or start, "created": a.newer_created, "accessed": a.newer_accessed}
    older = {"modified": a.older or end, "created": a.older_created, "accessed": a.older_accessed}
    aggs = list(a.agg)
    aggs += ["count"] if a.count and "count" not in aggs else []
    for f in a.facet:
        field, _, top = f.partition(":")
        aggs.append(f"terms:{field},top={top or 20}")
    aggs += [f"stats:{f}" for f in a.stats]
    aggs += [f"hist:{f},interval={i}" if i else f"hist:{f}" for f, _, i in (h.partition(":") for h in a.histogram)]
    predicates = [("malformed_path", "eq", True)] if a.malformed_path else []
    search = SearchParams(
        pattern=f"path:{pattern}" if whole_path else pattern, case_sensitive=bool(case), word=a.word, drives=drives, mode=mode, ext=ext, type=a.type or "", exclude=a.exclude or "", not_contains=a.not_contains or "",
        in_path=a.in_path or "", not_in_path=a.not_in_path or "", hide_system=a.hide_system, hide_ads=a.hide_ads, attr=a.attr or "", months=a.month or "", ranges=ranges,
        newer={k: v for k, v in newer.items() if v}, older={k: v for k, v in older.items() if v}, deleted=True if a.deleted else None, malformed=True if a.malformed else False if a.well_formed else None, predicates=predicates,
        sort=(f"{a.sort}:desc" if a.sort_desc and a.sort and ":" not in a.sort else a.sort or ""), limit=a.limit, offset=a.offset, columns=[c.strip() for c in (a.columns or "").split(",") if c.strip()], now=now,
    )
    return search, aggs if not a.rows or aggs else []
