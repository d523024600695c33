"""Sinks: text, CSV, JSON, Parquet and aggregate exports, written by executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.registry import fields, resolve

SEPARATORS = {"TAB": "\t", "NEWLINE": "\n", "SPACE": " ", "RETURN": "\r", "DOUBLE": '"', "SINGLE": "'", "NULL": "\0"}


def parse_columns(spec: str) -> list[str]:
    """Known names of a list; `all`, or a list without a known name, is every field."""
    names = []
    for word in spec.split(","):
        try:
            names.append(resolve(word).name)
        except ValueError:
            continue
    return list(fields()) if spec.strip().lower() == "all" or not names else names


def text_lines(df: DataFrame, columns: list[str], separator: str = ",", quote: str = '"', pos: str = "1", neg: str = "0", tz_minutes: int = 0) -> DataFrame:
    """One `value` column of formatted rows; times are shown at one fixed offset."""
    sep = SEPARATORS.get(separator.upper(), separator)

    def show(name: str) -> Column:
        kind = dict(df.dtypes)[name]
        if kind == "boolean":
            return F.when(F.col(name), F.lit(pos)).otherwise(F.lit(neg))
        if kind.startswith("timestamp"):
            return F.date_format(F.col(name) + F.expr(f"INTERVAL {tz_minutes} MINUTES"), "yyyy-MM-dd HH:mm:ss")
        if kind == "string":
            return F.concat(F.lit(quote), F.coalesce(F.col(name), F.lit("")), F.lit(quote))
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    return df.select(F.concat_ws(sep, *[show(c) for c in columns]).alias("value"))


COLUMN_ORDERS = {"baseline": fixed.BASELINE_COLUMNS, "parity": fixed.PARITY_COLUMNS}


def header_lines(columns: list[str], separator: str = ",", quote: str = '"') -> list[str]:
    """The header of a text export and the blank line after it."""
    return [SEPARATORS.get(separator.upper(), separator).join(f"{quote}{c}{quote}" for c in columns), ""]


def with_header(lines: DataFrame, columns: list[str], separator: str = ",", quote: str = '"') -> DataFrame:
    """(part, value): header lines in part 0, rows in part 1, so that a writer that partitions or sorts by part puts the header first."""
    head = lines.sparkSession.createDataFrame([(t,) for t in header_lines(columns, separator, quote)], "value string")
    return head.select(F.lit(0).alias("part"), "value").unionByName(lines.select(F.lit(1).alias("part"), "value"))


def table_lines(df: DataFrame, most: int = 1000) -> list[str]:
    """A printed table of the first `most` rows: names, a rule, values in columns as wide as their longest."""
    rows = [tuple("" if v is None else str(v) for v in r) for r in df.limit(most).collect()]
    widths = [max(map(len, c)) for c in zip(df.columns, *rows)]
    show = lambda r: "  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip()
    return [show(df.columns), "  ".join("-" * w for w in widths), *map(show, rows)]


def paths_blob(df: DataFrame, column: str = "path") -> DataFrame:
    """Rows of paths alone, as a path-only reply has them."""
    return df.select(F.col(column).alias("value"))


def export(df: DataFrame, path: str, kind: str) -> None:
    writer = df.write.mode("overwrite")
    {"parquet": writer.parquet, "json": writer.json, "csv": writer.option("header", True).csv, "tsv": writer.option("header", True).option("sep", "\t").csv, "text": writer.text}[kind](path)
