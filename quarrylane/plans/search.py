"""Search: parameters to one logical plan of filter, sort, limit and projection."""

from __future__ import annotations

import datetime as dt
import functools
import operator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.registry import resolve
from ..operators.tree import directory_chains, with_paths, with_tree, tree_metrics
from ..sources.catalog import complete
from .patterns import match, match_path
from .specs import expand_extensions, parse_attributes, parse_months, parse_size, parse_time


@dataclass
class SearchParams:
    pattern: str = "*"
    case_sensitive: bool = False
    smart_case: bool = False
    word: bool = False
    drives: list[str] = field(default_factory=list)
    mode: str = "all"  # all, files, dirs
    ext: str = ""
    type: str = ""
    exclude: str = ""
    not_contains: str = ""
    in_path: str = ""
    not_in_path: str = ""
    hide_system: bool = False
    hide_metadata: bool = False
    hide_ads: bool = False
    attr: str = ""
    months: str = ""
    ranges: dict[str, tuple[Any, Any]] = field(default_factory=dict)  # numeric field -> (min, max), inclusive
    newer: dict[str, str] = field(default_factory=dict)  # time field -> spec, inclusive
    older: dict[str, str] = field(default_factory=dict)  # exclusive
    deleted: bool | None = None
    malformed: bool | None = None
    predicates: list[tuple[str, str, Any]] = field(default_factory=list)
    sort: str = ""
    limit: int = 0
    offset: int = 0
    columns: list[str] = field(default_factory=list)
    now: dt.datetime | None = None


def predicate(name: str, op: str, value: Any) -> Column:
    """A structured predicate; strings compare without case. A field or operator that does not fit is an error."""
    f = resolve(name)
    c = f.column
    compare = {"eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "lte": operator.le, "gt": operator.gt, "gte": operator.ge}
    if f.kind == "bits" and f.name == "attributes":
        if op not in ("has_all", "has_any", "has_none"):
            raise ValueError(f"{op} does not fit {name}")
        masks = [fixed.ATTRIBUTES[v.lower()] for v in value]
        hits = [c.bitwiseAND(F.lit(m)) != 0 for m in masks]
        joined = functools.reduce(operator.and_ if op == "has_all" else operator.or_, hits)
        return ~joined if op == "has_none" else joined
    if f.kind != "string":
        if op not in compare or (f.kind == "bool" and op not in ("eq", "ne")):
            raise ValueError(f"{op} does not fit {name}")
        return compare[op](c, F.lit(value))
    low = F.lower(c)
    many = [str(v).lower() for v in value] if isinstance(value, (list, tuple)) else [str(value).lower()]
    has = [low.contains(v) for v in many]
    ops = {
        "eq": lambda: low == many[0], "ne": lambda: low != many[0], "in": lambda: low.isin(many), "not_in": lambda: ~low.isin(many),
        "match": lambda: match(c, many[0], whole=True), "not_match": lambda: ~match(c, many[0], whole=True), "contains": lambda: has[0], "starts_with": lambda: low.startswith(many[0]), "ends_with": lambda: low.endswith(many[0]),
        "has_all": lambda: functools.reduce(operator.and_, has), "has_any": lambda: functools.reduce(operator.or_, has), "has_none": lambda: ~functools.reduce(operator.or_, has),
    }
    if op not in ops:
        raise ValueError(f"{op} does not fit {name}")
    return ops[op]()


def build_filter(p: SearchParams) -> tuple[Column, set[str]]:
    """The filter expression, and which derived tables it needs."""
    terms: list[Column] = []
    needs: set[str] = set()
    now = p.now or dt.datetime(2024, 1, 1)

    def use(name: str) -> Column:
        f = resolve(name)
        if f.needs:
            needs.add(f.needs)
        return f.column

    pattern, drives = p.pattern, [d.upper() for d in p.drives]
    if len(pattern) > 2 and pattern[1] == ":" and pattern[0].isalpha():
        drives, pattern = [*drives, pattern[0].upper()], pattern[2:].lstrip("\\/") or "*"
    if drives:
        terms.append(F.upper("drive").isin(drives))
    for prefix, mode in (("file:", "files"), ("dir:", "dirs")):
        if pattern.startswith(prefix):
            p, pattern = SearchParams(**{**p.__dict__, "mode": mode}), pattern[len(prefix) :]
    exact_case = p.case_sensitive or (p.smart_case and pattern != pattern.lower())
    if pattern.startswith("path:") or (not pattern.startswith(">") and ("\\" in pattern or "/" in pattern)):
        terms.append(match_path(use("path"), pattern.removeprefix("path:"), exact_case))
    elif pattern.startswith("*.") and pattern[2:].isalnum() and not exact_case:
        terms.append(F.col("ext") == pattern[2:].lower())  # a pure extension pattern reaches the scan as an equality
    elif pattern not in ("*", ""):
        terms.append(match(F.col("name"), pattern, exact_case, p.word))
    if p.mode != "all":
        terms.append(F.col("is_directory") == (p.mode == "dirs"))
    if p.ext or p.type:
        wanted = expand_extensions(p.ext) if p.ext else None
        if wanted is not None:
            terms.append(F.col("ext").isin(wanted))
        if p.type:
            terms.append(use("type") == p.type.lower())
    for spec in [*filter(None, p.exclude.split(",")), *([f"*{p.not_contains}*"] if p.not_contains else [])]:
        terms.append(~match(F.col("name"), spec.strip(), whole=True))
    if p.in_path:
        terms.append(match(use("path_only"), p.in_path.replace("/", "\\")))
    for part in filter(None, p.not_in_path.split(",")):
        terms.append(~match(use("path_only"), part.replace("/", "\\")))
    if p.hide_system:
        terms.append(~F.lower("name").isin(fixed.METAFILES))
    if p.hide_metadata:
        terms.append((F.col("frs") >= 16) | (F.col("frs") == 5))
    if p.hide_ads:
        terms.append(~F.col("name").contains(":"))
    if p.attr:
        need, ban = parse_attributes(p.attr)
        terms += [F.col("flags").bitwiseAND(F.lit(need)) == need] * bool(need) + [F.col("flags").bitwiseAND(F.lit(ban)) == 0] * bool(ban)
    if p.months:
        terms.append(F.coalesce(F.month("modified"), F.lit(1)).isin(parse_months(p.months)))
    for name, (low, high) in p.ranges.items():
        c, size = use(name), "size" in name or "allocated" in name
        if low is not None:
            terms.append(c >= F.lit(parse_size(low) if size else low))
        if high is not None:
            terms.append(c <= F.lit(parse_size(high) if size else high))
    for name, spec in p.newer.items():
        terms.append(use(name) >= F.lit(parse_time(spec, now)[0]))
    for name, spec in p.older.items():
        terms.append(use(name) < F.lit(parse_time(spec, now)[1]))
    if p.deleted is not None:
        terms.append(F.col("deleted") == p.deleted)
    if p.malformed is not None:
        terms.append(use("malformed") == p.malformed)
    for name, op, value in p.predicates:
        use(name)
        terms.append(predicate(name, op, value))
    return functools.reduce(operator.and_, terms, F.lit(True)), needs


def build_sort(spec: str) -> tuple[list[Column], set[str]]:
    """`a:asc,-b,c`: the first field ascends unless told, later ones take their default; names, then ids, break ties. No spec: modified, newest first."""
    keys, needs, named = [], set(), False
    for k, word in enumerate(filter(None, (w.strip() for w in (spec or "modified:desc").split(",")))):
        name, _, way = word.lstrip("-").partition(":")
        f = resolve(name)
        if not f.sortable:
            continue
        down = word.startswith("-") or way == "desc" or (not way and k > 0 and f.descending)
        needs |= {f.needs} - {""}
        named |= f.name == "name"
        cols = [F.upper(f.column), f.column] if f.kind == "string" else [f.column]
        keys += [c.desc() if down else c.asc() for c in cols]
    if not named:
        keys += [F.upper("name").asc(), F.col("name").asc()]
    return [*keys, F.col("drive").asc(), F.col("frs").asc()], needs


def derived(files: DataFrame, what: set[str], chains: DataFrame | None = None, metrics: DataFrame | None = None, of: DataFrame | None = None) -> DataFrame:
    """Rows of `of` (files itself if not given) with the path and tree columns asked for, made from files unless they are given."""
    rows = files if of is None else of
    if what and chains is None:
        chains = directory_chains(files)
    if "path" in what:
        rows = with_paths(rows, chains)
    return with_tree(rows, tree_metrics(files, chains) if metrics is None else metrics) if "tree" in what else rows


def matched(files: DataFrame, p: SearchParams, chains: DataFrame | None = None, metrics: DataFrame | None = None) -> DataFrame:
    """The rows that a search finds, unsorted and uncut, with the derived columns that its filters read: what aggregates run over."""
    where, needs = build_filter(p)
    return derived(complete(files), needs, chains, metrics).filter(where)


def search(files: DataFrame, p: SearchParams, chains: DataFrame | None = None, metrics: DataFrame | None = None) -> DataFrame:
    """Filters, sorts, cuts and projects, in the order asked for. Paths and tree sums are joined before the cut only if a filter or sort reads them, else to
    the winners alone. `chains` and `metrics` are those of a stored catalog; without them they are made anew."""
    files = complete(files)
    where, need_filter = build_filter(p)
    keys, need_sort = build_sort(p.sort)
    fields = [resolve(c) for c in (p.columns or ["drive", "path", "name", "size", "modified"])]
    need_show = {f.needs for f in fields} - {""}
    if chains is None and need_filter | need_sort | need_show:
        chains = directory_chains(files)
    early = need_filter | need_sort
    rows = derived(files, early, chains, metrics).filter(where)
    if p.sort or p.limit:
        rows = rows.orderBy(*keys)
    if p.offset:
        rows = rows.offset(p.offset)
    if p.limit:
        rows = rows.limit(p.limit)
    if need_show - early:
        rows = derived(files, need_show - early, chains, metrics, of=rows)
        if p.sort or p.limit:
            rows = rows.orderBy(*keys)  # joins keep no order
    return rows.select(*[f.column.alias(f.name) for f in fields])
