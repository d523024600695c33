"""Text specs of sizes, times, months and attributes."""

from __future__ import annotations

import datetime as dt
import re

from ..functions import fixed

UNITS = {"": 1, "b": 1, "kb": 1 << 10, "k": 1 << 10, "mb": 1 << 20, "m": 1 << 20, "gb": 1 << 30, "g": 1 << 30, "tb": 1 << 40, "t": 1 << 40}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def parse_size(spec: str | int) -> int:
    if isinstance(spec, int):
        return spec
    m = re.fullmatch(r"(\d+)\s*([a-z]*)", spec.strip().lower())
    if not m or m[2] not in UNITS or int(m[1]) * UNITS[m[2]] >= 2**64:
        raise ValueError(f"bad size: {spec}")
    return int(m[1]) * UNITS[m[2]]


def parse_time(spec: str, now: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    """(newer bound, older bound) of a time spec; a bad one is an error, never a filter that vanishes."""
    s, day = spec.strip().lower(), now.replace(hour=0, minute=0, second=0, microsecond=0)
    if m := re.fullmatch(r"(\d+)([smhdw])", s):
        at = now - dt.timedelta(seconds=int(m[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}[m[2]])
        return at, at
    if m := re.fullmatch(r"last_(\d+)d", s):
        at = now - dt.timedelta(days=int(m[1]))
        return at, at
    if re.fullmatch(r"\d{4}-\d\d-\d\d", s):
        at = dt.datetime.fromisoformat(s)
        return at, at
    week, month, year = day - dt.timedelta(days=day.weekday()), day.replace(day=1), day.replace(month=1, day=1)
    shift = lambda d, n: (d.replace(day=1) + dt.timedelta(days=32 * n)).replace(day=1) if n > 0 else (d - dt.timedelta(days=1)).replace(day=1)
    days = lambda n: dt.timedelta(days=n)
    named = {
        "today": (day, day), "yesterday": (day - days(1), day), "this_week": (week, week), "this_month": (month, month), "this_year": (year, year), "ytd": (year, year),
        "last_week": (week - days(7), week), "last_month": (shift(month, -1), month), "last_year": (year.replace(year=year.year - 1), year),
        "next_day": (day + days(1), day + days(2)), "tomorrow": (day + days(1), day + days(2)), "next_week": (week + days(7), week + days(14)),
        "next_month": (shift(month, 1), shift(shift(month, 1), 1)), "next_year": (year.replace(year=year.year + 1), year.replace(year=year.year + 2)),
    }
    if s not in named:
        raise ValueError(f"bad time: {spec}")
    return named[s]


def parse_months(spec: str) -> list[int]:
    out: set[int] = set()
    for word in spec.lower().split(","):
        w = word.strip()
        if re.fullmatch(r"q[1-4]", w):
            out |= {3 * int(w[1]) - 2, 3 * int(w[1]) - 1, 3 * int(w[1])}
        elif w[:3] in MONTHS:
            out.add(MONTHS.index(w[:3]) + 1)
        else:
            raise ValueError(f"bad month: {word}")
    return sorted(out)


def parse_attributes(spec: str) -> tuple[int, int]:
    """(required, excluded) masks of `hidden,!system`; presets are names with a dash."""
    presets = {"system-files": "hidden,system", "user-files": "!hidden,!system", "compressed-encrypted": "compressed,encrypted"}
    need, ban = 0, 0
    for word in presets.get(spec.lower(), spec).lower().split(","):
        w = word.strip()
        bit = fixed.ATTRIBUTES.get(w.lstrip("!"))
        if bit is None:
            raise ValueError(f"bad attribute: {word}")
        need, ban = (need, ban | bit) if w.startswith("!") else (need | bit, ban)
    return need, ban


def expand_extensions(spec: str) -> list[str]:
    out: list[str] = []
    for token in (t.strip().lower().lstrip(".") for t in spec.split(",")):
        if token in ("executables", "exec"):
            out += fixed.EXECUTABLE_COLLECTION
        elif token in fixed.COLLECTIONS:
            out += fixed.TYPE_EXTENSIONS[fixed.COLLECTIONS[token]]
        elif token:
            out.append(token)
    return list(dict.fromkeys(out))
