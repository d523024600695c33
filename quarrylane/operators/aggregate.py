"""Facet aggregation: specs, presets, top hits, duplicates, pages. One plan a spec; partial sums come before every shuffle."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions.registry import resolve
from ..plans.search import SearchParams, matched

SHARES = 64
KINDS = ("count", "stats", "terms", "hist", "datehist", "range", "missing", "distinct", "rollup", "duplicates")


@dataclass
class Spec:
    kind: str
    field: str = ""
    options: dict[str, str] = dataclasses.field(default_factory=dict)


def parse_spec(text: str) -> Spec:
    """`kind:field,key=value,...`; unknown kinds, fields and fields that don't fit are errors."""
    head, *rest = text.split(",")
    kind, _, name = head.strip().partition(":")
    kind = {"facet": "terms"}.get(kind, kind)
    if kind not in KINDS:
        raise ValueError(f"unknown aggregate: {kind}")
    options = dict(r.split("=", 1) if "=" in r else (r.strip(), "true") for r in rest)
    if kind in ("stats", "terms", "hist", "datehist", "range", "missing", "distinct"):
        f = resolve(name)
        fits = {"stats": f.kind == "number", "hist": f.kind == "number", "range": f.kind in ("number", "time"), "datehist": f.kind == "time", "terms": f.group, "distinct": f.group}
        if not fits.get(kind, True):
            raise ValueError(f"{kind} does not fit {name}")
    return Spec(kind, name, options)


def waste_percent(total: Column, held: Column) -> Column:
    return F.when(held > 0, F.greatest(held - total, F.lit(0)) * 100.0 / held).otherwise(F.lit(0.0))


def bucket_metrics() -> list[Column]:
    total, held = F.sum("size"), F.sum("allocated")
    waste = F.greatest(held - total, F.lit(0))
    return [F.count(F.lit(1)).alias("count"), total.alias("total_bytes"), held.alias("total_allocated"), waste.alias("waste_bytes"), waste_percent(total, held).alias("waste_pct"), F.avg("size").alias("avg_size"), F.min("size").alias("min_size"), F.max("size").alias("max_size")]


def terms(files: DataFrame, name: str, top: int = 20, sample: int = 0, sub: str = "") -> DataFrame:
    """key, metrics and shares of the top groups by count, ties by key; `other_count` and `total_groups` say what is left out.

    The rows are aggregated once. Groups are dealt to SHARES by hash, each of which gives its best `top` and its totals, so that one task ranks at most
    SHARES * top rows however many groups there are. With `sample`, the best rows of each group as formatted fields; with `sub`, a terms or stats spec, its
    buckets within each group."""
    column = resolve(name).column.cast("string")
    groups = files.groupBy(column.alias("key")).agg(*bucket_metrics()).withColumn("_p", F.pmod(F.xxhash64("key"), F.lit(SHARES)))
    share, whole = Window.partitionBy("_p"), Window.partitionBy()
    sums = {"_n": F.sum("count"), "_b": F.sum("total_bytes"), "_g": F.count(F.lit(1))}
    best = groups.withColumns({k: v.over(share) for k, v in sums.items()} | {"_r": F.row_number().over(share.orderBy(F.desc("count"), "key"))}).filter(F.col("_r") <= top)
    best = best.withColumns({k: F.sum(F.when(F.col("_r") == 1, F.col(k))).over(whole) for k in sums} | {"_o": F.row_number().over(Window.orderBy(F.desc("count"), "key"))})
    shown = best.filter(F.col("_o") <= top)
    part = lambda c, t: F.when(F.col(t) == 0, F.lit(0.0)).otherwise(F.col(c) * 100.0 / F.col(t))
    shown = shown.withColumns({"share_count": part("count", "_n"), "share_bytes": part("total_bytes", "_b"), "total_groups": F.col("_g"), "other_count": F.col("_n") - F.sum("count").over(whole)})
    shown = shown.drop("_p", "_r", "_o", *sums)
    if sample:
        shown = shown.join(samples(files, name, sample), "key", "left")
    if sub:
        shown = shown.join(sub_buckets(files, column, parse_spec(sub)), "key", "left")
    return shown


def samples(files: DataFrame, name: str, n: int, sort: str = "size", shown: tuple[str, ...] = ("name", "size")) -> DataFrame:
    """key, samples: the n best rows of each bucket, their fields as text."""
    hits = top_hits(files, name, n, sort, shown=shown)
    row = F.struct("rank", *[F.col(c).cast("string").alias(c) for c in shown])
    return hits.groupBy("key").agg(F.sort_array(F.collect_list(row)).alias("samples"))  # at most n rows each


def sub_buckets(files: DataFrame, key: Column, spec: Spec) -> DataFrame:
    """key, sub_buckets of a terms spec (the top ones by count), or key, sub_stats of a stats spec."""
    if spec.kind == "stats":
        c = resolve(spec.field).column
        return files.groupBy(key.alias("key")).agg(F.struct(F.sum(c).alias("sum"), F.min(c).alias("min"), F.max(c).alias("max")).alias("sub_stats"))
    if spec.kind != "terms":
        raise ValueError("sub: terms or stats")
    flat = files.groupBy(key.alias("key"), resolve(spec.field).column.cast("string").alias("sub")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    w = Window.partitionBy("key").orderBy(F.desc("n"), "sub")
    few = flat.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= int(spec.options.get("top", 20)))
    return few.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("r", "sub", "n", "bytes"))).alias("sub_buckets"))


def drill_down(buckets: DataFrame, name: str, query: list[tuple[str, str, str]] = ()) -> DataFrame:
    """Buckets with `predicates`: the query's own (field, op, value) and `field eq key`, which together name a bucket's rows."""
    one = lambda f, o, v: F.struct(F.lit(f).alias("field"), F.lit(o).alias("op"), v.alias("value"))
    own = [one(f, o, F.lit(str(v))) for f, o, v in query]
    return buckets.withColumn("predicates", F.array(*own, one(resolve(name).name, "eq", F.col("key"))))


def query_predicates(p: SearchParams) -> list[tuple[str, str, str]]:
    """The predicates that name a search's rows, for drill-down."""
    found = [("name", "match", p.pattern)] if p.pattern not in ("", "*") else []
    found += [("extension", "in", p.ext)] if p.ext else []
    found += [("type", "eq", p.type)] if p.type else []
    found += [("directory_flag", "eq", str(p.mode == "dirs").lower())] if p.mode != "all" else []
    for name, (low, high) in p.ranges.items():
        found += [(name, "gte", low)] * (low is not None) + [(name, "lte", high)] * (high is not None)
    return found + [(f, o, v) for f, o, v in p.predicates]


def stats(files: DataFrame, name: str) -> DataFrame:
    c = resolve(name).column
    return files.agg(F.count(F.lit(1)).alias("count"), F.sum(c).alias("sum"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("avg"), F.sum("allocated").alias("total_allocated"), F.greatest(F.sum("allocated") - F.sum("size"), F.lit(0)).alias("waste_bytes"), waste_percent(F.sum("size"), F.sum("allocated")).alias("waste_pct"))


def histogram(files: DataFrame, name: str, interval: int = 1 << 20) -> DataFrame:
    c = resolve(name).column
    return files.groupBy((F.floor(c / interval) * interval).cast("long").alias("bucket")).agg(*bucket_metrics())


def date_histogram(files: DataFrame, name: str, calendar: str = "month", parity: bool = False) -> DataFrame:
    """By calendar unit; with parity, months, quarters and years are blocks of 30, 90 and 365 days from 1601."""
    c = resolve(name).column
    days = {"month": 30, "quarter": 90, "year": 365}.get(calendar)
    if parity and days:
        start = F.lit("1601-01-01").cast("date")
        key = F.date_format(F.date_add(start, (F.floor(F.datediff(c.cast("date"), start) / days) * days).cast("int")), "yyyy-MM-dd")
    else:
        key = F.date_format(F.date_trunc(calendar, c), "yyyy-MM-dd HH:00" if calendar == "hour" else "yyyy-MM-dd")
    return files.groupBy(key.alias("key")).agg(*bucket_metrics())


def ranges(files: DataFrame, name: str, bounds: list[int]) -> DataFrame:
    """Upper-exclusive buckets `< a`, `a - b`, `>= z`; empty ones are left out. Times are compared as Unix microseconds."""
    f, cuts = resolve(name), sorted(set(bounds))
    c = F.unix_micros(f.column.cast("timestamp")) if f.kind == "time" else f.column
    key = F.when(c < cuts[0], F.lit(f"< {cuts[0]}"))
    for a, b in zip(cuts, cuts[1:]):
        key = key.when(c < b, F.lit(f"{a} - {b}"))
    return files.groupBy(key.otherwise(F.lit(f">= {cuts[-1]}")).alias("key")).agg(*bucket_metrics())


def missing(files: DataFrame, name: str) -> DataFrame:
    f = resolve(name)
    empty = f.column == "" if f.kind == "string" else f.column.isNull() | (f.column == 0) if f.kind == "number" else f.column.isNull()
    return files.agg(F.count_if(empty).alias("missing"))


def distinct(files: DataFrame, name: str) -> DataFrame:
    return files.select(resolve(name).column.alias("k")).distinct().agg(F.count(F.lit(1)).alias("distinct"))


def top_hits(files: DataFrame, name: str, n: int = 2, sort: str = "size", descending: bool = True, shown: tuple[str, ...] = ("frs", "name", "size")) -> DataFrame:
    """The n best rows of each bucket by a sort field, ties by id; a window of rank <= n is cut before its shuffle."""
    f = resolve(sort)
    if not 1 <= n <= 5 or not f.sortable:
        raise ValueError("top hits: 1 to 5 rows by a sortable field")
    w = Window.partitionBy("_key").orderBy(F.desc("_s") if descending else F.asc("_s"), "frs")
    rows = files.withColumns({"_key": resolve(name).column.cast("string"), "_s": f.column})
    rows = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return rows.select(F.col("_key").alias("key"), "rank", *[(F.col(c) if c == "frs" else resolve(c).column).alias(c) for c in shown])


def nested_terms(files: DataFrame, outer: str, inner: str) -> DataFrame:
    """Buckets with an array of sub-buckets."""
    flat = files.groupBy(resolve(outer).column.cast("string").alias("key"), resolve(inner).column.cast("string").alias("sub")).agg(F.count(F.lit(1)).alias("n"))
    return flat.groupBy("key").agg(F.sum("n").alias("count"), F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("order"), "sub", "n"))).alias("sub_buckets"))


def duplicates(files: DataFrame, keys: list[str], top: int = 100, max_groups: int = 0, sample: int = 0) -> DataFrame:
    """Groups of files with equal keys, size > 0, by reclaimable bytes: the best `top`, of `max_groups` at most. Counts are summed before the shuffle, so no
    group is gathered; `sample` shows that many of its names (the least ids)."""
    cols = [(F.lower(resolve(k).column) if resolve(k).kind == "string" else resolve(k).column).alias(f"key_{k}") for k in keys]
    rows = files.filter("NOT is_directory AND size > 0")
    names = [f"key_{k}" for k in keys]
    groups = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("count"), F.sum("size").alias("total_bytes"), F.min("frs").alias("first_frs")).filter("count > 1")
    most = min(top, max_groups) if max_groups else top
    best = groups.withColumn("reclaimable", F.expr("total_bytes - total_bytes div count")).orderBy(F.desc("reclaimable"), *names).limit(most)
    if not sample:
        return best
    w = Window.partitionBy(*names).orderBy("frs")
    few = rows.select(*cols, "frs", "name").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= sample)
    return best.join(few.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("frs", "name"))).alias("samples")), names, "left")


def verified_duplicates(content: DataFrame, keys: list[str], text: str, first_bytes: int = 4096, how: str = "sha256") -> DataFrame:
    """Candidate groups whose contents all agree: by their first bytes or by SHA-256. Groups with a mismatch are dropped."""
    mark = F.sha2(F.col(text), 256) if how == "sha256" else F.sha2(F.substring(F.col(text).cast("binary"), 1, first_bytes), 256)
    marked = content.select(*keys, mark.alias("m"))
    groups = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.min("m").alias("a"), F.max("m").alias("b")).filter("count > 1 AND a = b")
    return groups.select(*keys, "count", F.lit(True).alias("verified"))


def within_budget(groups: DataFrame, most_bytes: int) -> DataFrame:
    """Marks groups, by falling reclaimable bytes, whose running total stays in a verification budget. Groups are already cut to a top list."""
    w = Window.orderBy(F.desc("reclaimable"), "first_frs").rowsBetween(Window.unboundedPreceding, 0)
    return groups.withColumn("in_budget", F.sum("total_bytes").over(w) <= most_bytes)


def facet_values(files: DataFrame, name: str, prefix: str = "", top: int = 50) -> DataFrame:
    c = resolve(name).column.cast("string")
    return files.filter(F.lower(c).startswith(prefix.lower())).groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(top)


def page(buckets: DataFrame, cursor: str | None = None, size: int = 20) -> DataFrame:
    """The rows a cursor `result:offset:size` names, with `total` and the `next_cursor` (null on the last page). Buckets go by count, ties by key."""
    try:
        result, offset, size = (int(x) for x in (cursor or f"0:0:{size}").split(":"))
    except ValueError:
        raise ValueError(f"bad cursor: {cursor}") from None
    w = Window.orderBy(F.desc("count"), "key")
    placed = buckets.withColumns({"_r": F.row_number().over(w), "total": F.count(F.lit(1)).over(Window.partitionBy())})
    more = F.when(F.col("total") > offset + size, F.lit(f"{result}:{offset + size}:{size}"))
    return placed.filter((F.col("_r") > offset) & (F.col("_r") <= offset + size)).withColumn("next_cursor", more).drop("_r")


def from_wire(spec: dict) -> list[str]:
    """Text specs of a wire spec: kind, and field, top, interval, calendar, bounds, keys, mode and the like; or a preset's."""
    kind = {"facet": "terms", "histogram": "hist", "date_histogram": "datehist"}.get(spec.get("kind"), spec.get("kind"))
    if kind == "preset":
        if spec.get("preset") not in PRESETS:
            raise ValueError(f"unknown preset: {spec.get('preset')}")
        return list(PRESETS[spec["preset"]])
    if kind not in KINDS:
        raise ValueError(f"unknown aggregate: {kind}")
    head = "+".join(spec.get("keys", [])) if kind == "duplicates" else spec.get("mode", "") if kind == "rollup" else spec.get("field", "")
    if not head and kind not in ("count", "duplicates"):
        raise ValueError(f"{kind} wants a field")
    options = {k: spec[k] for k in ("top", "interval", "calendar", "depth", "record", "drive", "sample", "sub", "max_groups", "verify") if spec.get(k) is not None}
    if spec.get("bounds"):
        options["bins"] = "+".join(str(b) for b in spec["bounds"])
    text = ",".join([f"{kind}:{head}" if head else kind, *[f"{k}={v}" for k, v in options.items()]])
    parse_spec(text)
    return [text]


def run(files: DataFrame, text: str, where: SearchParams | None = None, content: str = "") -> DataFrame:
    """The DataFrame of one text spec, over the rows that a search finds if one is given. `content` is the column that duplicates' `verify` reads."""
    spec = parse_spec(text)
    o = spec.options
    if where is not None:
        files = matched(files, where)
    return {
        "count": lambda: files.agg(F.count(F.lit(1)).alias("count")),
        "stats": lambda: stats(files, spec.field),
        "terms": lambda: terms(files, spec.field, int(o.get("top", 20)), int(o.get("sample", 0)), o.get("sub", "")),
        "hist": lambda: histogram(files, spec.field, int(o.get("interval", 1 << 20))),
        "datehist": lambda: date_histogram(files, spec.field, o.get("calendar", "month"), o.get("parity") == "true"),
        "range": lambda: ranges(files, spec.field, sorted({int(b) for part in o["bins"].split("+") for b in part.split("..") if b and int(b)})),
        "missing": lambda: missing(files, spec.field),
        "distinct": lambda: distinct(files, spec.field),
        "rollup": lambda: _rollup(files, spec),
        "duplicates": lambda: _duplicates(files, spec, content),
    }[spec.kind]()


def _duplicates(files: DataFrame, spec: Spec, content: str) -> DataFrame:
    keys, o = (spec.field or "size+name").split("+"), spec.options
    found = duplicates(files, keys, int(o.get("top", 100)), int(o.get("max_groups", 0)), int(o.get("sample", 0)))
    if o.get("verify", "none") == "none":
        return found
    if not content:
        raise ValueError("verify wants a column of contents")
    cols = [(F.lower(resolve(k).column) if resolve(k).kind == "string" else resolve(k).column).alias(f"key_{k}") for k in keys]
    rows = files.filter("NOT is_directory AND size > 0").select(*cols, content)
    good = verified_duplicates(rows, [f"key_{k}" for k in keys], content, how="sha256" if o["verify"] == "sha256" else "first_bytes")
    return found.join(good.drop("count"), [f"key_{k}" for k in keys])


def _rollup(files: DataFrame, spec: Spec) -> DataFrame:
    """Groups by falling total_bytes, ties by key, the best `top`; with `sub`, sub-buckets within each drive."""
    from .tree import rollup_ancestor, rollup_path

    top = int(spec.options.get("top", 50))
    if spec.field == "drive":
        groups = files.groupBy(F.col("drive").alias("key")).agg(*bucket_metrics()).orderBy(F.desc("total_bytes"), "key").limit(top)
        sub = spec.options.get("sub")
        return groups.join(sub_buckets(files, F.col("drive"), parse_spec(sub)), "key", "left") if sub else groups
    if spec.field in ("ancestor", "drilldown"):
        if "record" not in spec.options or "drive" not in spec.options:
            raise ValueError("rollup:ancestor wants a record and a drive")
        return rollup_ancestor(files, spec.options["drive"], int(spec.options["record"])).orderBy(F.desc("total_bytes"), "child").limit(top)
    if spec.field not in ("path", "folder", "dir"):
        raise ValueError(f"unknown rollup: {spec.field}")
    return rollup_path(files, int(spec.options.get("depth", 1))).orderBy(F.desc("total_bytes"), "drive", "ancestor").limit(top)


_SIZES = "range:size,bins=" + "+".join(str(b) for b in fixed.SIZE_BOUNDS)
PRESETS = {
    "overview": ["count", "terms:directory_flag,top=2", "stats:size", "terms:type,top=30", "terms:drive,top=26", "datehist:modified,calendar=month"],
    "by_type": ["terms:type,top=30"],
    "by_extension": ["terms:extension,top=50"],
    "by_drive": ["terms:drive,top=26"],
    "by_size": [_SIZES, "stats:size"],
    "by_age": ["datehist:modified,calendar=month"],
    "storage": ["stats:size", "stats:size_on_disk", "terms:drive,top=26", "terms:extension,top=20"],
    "activity": ["datehist:modified", "datehist:created", "datehist:accessed"],
    "top_folders": ["rollup:path,depth=1"],
    "duplicates": ["duplicates:size+name,top=100"],
    "media": ["terms:type,top=12", "stats:size", "terms:extension,top=30", "datehist:created"],
    "cleanup": ["missing:extension", "missing:size", "distinct:extension", "count"],
}


def preset(files: DataFrame, name: str) -> dict[str, DataFrame]:
    return {text: run(files, text) for text in PRESETS[name]}


def catalog_statistics(files: DataFrame) -> DataFrame:
    """One pass of conditional sums over eight size classes by powers of ten."""
    names = ["under_1k", "to_10k", "to_100k", "to_1m", "to_10m", "to_100m", "to_1g", "over_1g"]
    cuts = [0, *[10**k for k in range(3, 10)], None]
    edges = list(zip(names, cuts, cuts[1:]))
    c = F.col("size")
    return files.agg(F.count(F.lit(1)).alias("records"), F.count_if("is_directory").alias("directories"), F.sum("size").alias("bytes"), F.sum(F.when(F.col("flags").bitwiseAND(F.lit(2)) != 0, c).otherwise(0)).alias("hidden_bytes"), *[F.count_if((c >= a) & ((c < b) if b else F.lit(True)) & ~F.col("is_directory")).alias(n) for n, a, b in edges])


def drive_statistics(files: DataFrame) -> DataFrame:
    """Totals of each volume."""
    return files.groupBy("drive").agg(F.count(F.lit(1)).alias("records"), F.count_if(~F.col("is_directory")).alias("files"), F.count_if("is_directory").alias("directories"), F.sum("size").alias("bytes"), F.sum("allocated").alias("allocated"))


def top_extensions(files: DataFrame, n: int, by: str = "bytes") -> DataFrame:
    """(ext, count, bytes) of the n first extensions by `bytes` or `count`; the empty one is one of them, ties go by name."""
    if by not in ("bytes", "count"):
        raise ValueError(f"top extensions go by bytes or count, not {by}")
    groups = files.groupBy("ext").agg(F.count(F.lit(1)).alias("count"), F.sum("size").alias("bytes"))
    return groups.orderBy(F.desc(by), "ext").limit(n)


def table_summary(files: DataFrame) -> DataFrame:
    """One row of a stored table: its rows, directories and sizes, and rows with each attribute; records of several links where the table has `links`."""
    marks = [F.count_if(F.col("flags").bitwiseAND(F.lit(bit)) != 0).alias(f"with_{name}") for name, bit in fixed.ATTRIBUTES.items()]
    many = [F.count_if(F.col("links") > 1).alias("multi_link")] if "links" in files.columns else []
    return files.agg(F.count(F.lit(1)).alias("records"), F.count_if("is_directory").alias("directories"), F.sum("size").alias("bytes"), F.sum("allocated").alias("allocated"), F.max("size").alias("largest"), *marks, *many)
