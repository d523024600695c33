"""A fluent query over a files table; each step returns a new query, and nothing runs before the DataFrame is used."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .patterns import glob_regex, match


@dataclass(frozen=True)
class Query:
    files: DataFrame

    def where(self, condition: Column) -> Query:
        return replace(self, files=self.files.filter(condition))

    # names
    def glob(self, pattern: str) -> Query:
        return self.where(F.col("name").rlike("(?i)" + glob_regex(pattern)))

    def regex(self, pattern: str, case_sensitive: bool = True) -> Query:
        return self.where(F.col("name").rlike(pattern if case_sensitive else f"(?i){pattern}"))

    def contains(self, text: str) -> Query:
        return self.where(F.lower("name").contains(text.lower()))

    def exact_name(self, name: str) -> Query:
        return self.where(F.col("name") == name)

    def pattern(self, text: str) -> Query:
        return self.where(match(F.col("name"), text))

    def extensions(self, *names: str) -> Query:
        """By the end of the name."""
        found = F.lit(False)
        for n in names:
            found = found | F.lower("name").endswith("." + n.lower().lstrip("."))
        return self.where(found)

    # kinds
    def files_only(self) -> Query:
        return self.where(~F.col("is_directory"))

    def directories_only(self) -> Query:
        return self.where(F.col("is_directory"))

    def hide_system_files(self) -> Query:
        return self.where(~F.lower("name").isin(fixed.METAFILES))

    def hide_metadata_records(self) -> Query:
        return self.where((F.col("frs") >= 16) | (F.col("frs") == 5))

    def hide_system(self) -> Query:
        return self.hide_metadata_records().hide_system_files()

    # sizes and times
    def min_size(self, size: int) -> Query:
        return self.where(F.col("size") >= size)

    def max_size(self, size: int) -> Query:
        return self.where(F.col("size") <= size)

    def after(self, field: str, at: dt.datetime) -> Query:
        """Strictly later, in microseconds."""
        return self.where(F.col(field) > F.lit(at))

    def before(self, field: str, at: dt.datetime) -> Query:
        return self.where(F.col(field) < F.lit(at))

    # order
    def sort_by(self, field: str, descending: bool = False) -> Query:
        return replace(self, files=self.files.orderBy(F.col(field).desc() if descending else F.col(field).asc(), "drive", "frs"))

    def limit(self, n: int) -> Query:
        return replace(self, files=self.files.limit(n))

    def select(self, *columns: str) -> Query:
        return replace(self, files=self.files.select(*columns))

    def dataframe(self) -> DataFrame:
        return self.files
