"""Scalar column functions over the files schema; all run inside the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def extension(name: Column) -> Column:
    """Lower-case text after the last dot; '' for dotless, leading-dot-only and trailing-dot names."""
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))


def file_type(ext: Column, is_directory: Column) -> Column:
    kinds = F.when(is_directory, F.lit("directory")).when(ext == "", F.lit("file"))
    for kind, names in fixed.TYPE_EXTENSIONS.items():
        kinds = kinds.when(ext.isin(names), F.lit(kind))
    return kinds.otherwise(F.lit("other"))


def has_bits(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) == F.lit(mask)


def ratio_scaled(allocated: Column, size: Column) -> Column:
    """allocated * 1e6 div size in decimals, 0 where size is 0."""
    wide = allocated.cast("decimal(38,0)") * F.lit(fixed.BULKINESS_SCALE).cast("decimal(38,0)")
    return F.when(size == 0, F.lit(0)).otherwise(F.floor(wide / F.when(size != 0, size).cast("decimal(20,0)"))).cast("long")


def whole(value: Column, by: int) -> Column:
    """Integer division towards zero, without a double in between."""
    return ((value.cast("decimal(20,0)") - value.cast("decimal(20,0)") % F.lit(by)) / F.lit(by)).cast("long")


def filetime_to_timestamp(ticks: Column) -> Column:
    """Unix time of 100 ns ticks since 1601, in whole microseconds."""
    since = ticks - F.lit(fixed.FILETIME_EPOCH)
    return F.timestamp_micros(whole(since, 10))


def filetime_with_bias(ticks: Column, seconds: Column | int) -> Column:
    return ticks + (seconds if isinstance(seconds, Column) else F.lit(seconds)).cast("long") * F.lit(10_000_000).cast("long")


def filetime_calendar(ticks: Column) -> Column:
    """year, month, day, hour, minute, second; null where unset (0)."""
    at = filetime_to_timestamp(ticks)
    return F.when(ticks != 0, F.struct(*[f(at).alias(f.__name__) for f in (F.year, F.month, F.dayofmonth, F.hour, F.minute, F.second)]))


def frame_extension(name: Column) -> Column:
    """As `extension`, but null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1)), F.lit(""))


def age_class(at: Column, now: Column) -> Column:
    """The age class of a time, by whole microseconds before `now`."""
    day = 86_400_000_000
    return classes(F.unix_micros(now) - F.unix_micros(at), [(n, None if d is None else d * day) for n, d in fixed.AGE_BUCKETS])


def malformed(name_bytes: Column) -> Column:
    return ~F.is_valid_utf8(name_bytes.cast("string"))


def shown_as_directory(is_directory: Column, name: Column) -> Column:
    """Stream rows (`name:stream`) are shown as files even where their record is a directory."""
    return is_directory & ~name.contains(":")


def pack_reference(seq: Column, frs: Column) -> Column:
    return F.shiftleft(seq.cast("long"), 48).bitwiseOR(frs.cast("long"))


def reference_frs(ref: Column) -> Column:
    return ref.bitwiseAND(F.lit((1 << 48) - 1))


def reference_seq(ref: Column) -> Column:
    return F.shiftrightunsigned(ref, 48)


def classes(value: Column, bounds: list[tuple[str, int | None]]) -> Column:
    out = None
    for name, top in bounds:
        if top is None:
            return out.otherwise(F.lit(name))
        out = F.when(value < top, F.lit(name)) if out is None else out.when(value < top, F.lit(name))
    return out


def link_share(value: Column, index: Column, links: Column) -> Column:
    """What link `index` of `links` takes of a value, so that shares add up exactly."""
    part = lambda i: F.floor((value.cast("decimal(38,0)") * i) / links)
    return F.when(links == 0, F.lit(0)).otherwise(part(index + 1) - part(index)).cast("long")


def human_size(value: Column) -> Column:
    out = F.concat(value.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(value >= 1 << (10 * power), F.concat(F.format_string("%.1f", value / float(1 << (10 * power))), F.lit(f" {unit}"))).otherwise(out)
    return out


def name_hex(name_bytes: Column) -> Column:
    return F.lower(F.hex(name_bytes))


def render_malformed(name_bytes: Column, normalised: bool = False) -> Column:
    """Text of name bytes: U+FFFD for each bad unit, or with `normalised` <BAD:HHHH> for a lone surrogate and <BAD> for any other bad byte."""

    @F.pandas_udf("string")
    def shown(names: pd.Series) -> pd.Series:
        return names.map(lambda b: None if b is None else rendered(bytes(b), normalised))

    return F.when(malformed(name_bytes), shown(name_bytes)).otherwise(name_bytes.cast("string"))


def rendered(raw: bytes, normalised: bool) -> str:
    out = ""
    while raw:
        try:
            return out + raw.decode()
        except UnicodeDecodeError as e:
            out += raw[: e.start].decode()
            bad = raw[e.start :]
            lone = len(bad) > 2 and bad[0] == 0xED and 0xA0 <= bad[1] <= 0xBF and 0x80 <= bad[2] <= 0xBF
            unit = f"{0xD000 | (bad[1] & 0x3F) << 6 | bad[2] & 0x3F:04X}" if lone else ""
            out += "\ufffd" if not normalised else f"<BAD:{unit}>" if lone else "<BAD>"
            raw = bad[3 if lone else max(e.end - e.start, 1) :]
    return out
