"""Snapshot comparison and multiset parity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def snapshot_diff(baseline: DataFrame, current: DataFrame, key: str = "file_ref", compared: tuple[str, ...] = ("size", "modified"), order: str | None = None, none: int | None = 0) -> DataFrame:
    """(key, change): deleted, added or modified. The baseline's side is its first row per key, by column `order` (null last), else as it is read; key `none`
    and null are no reference. With `none` None every key is one, 0 and null too. One join of both sides."""
    place = F.col(order) if order else F.monotonically_increasing_id()
    real = F.lit(True) if none is None else F.col(key) != none
    numbered = baseline.filter(real).select(key, F.struct(*compared).alias("old"), F.struct(place.isNull(), place).alias("place"))
    first = numbered.groupBy(key).agg(F.min_by("old", "place").alias("old"))
    now = current.filter(real).select(F.col(key).alias("_now"), F.struct(*compared).alias("new"))
    kind = F.when(F.col("new").isNull(), F.lit("deleted")).when(F.col("old").isNull(), F.lit("added")).when(F.col("old") != F.col("new"), F.lit("modified"))
    return first.join(now, F.col(key).eqNullSafe(F.col("_now")), "full_outer").select(F.coalesce(key, "_now").alias(key), kind.alias("change")).filter(F.col("change").isNotNull())


def limited(delta: DataFrame, most: int, key: str = "file_ref") -> DataFrame:
    """At most `most` rows of each class, by key, and whether the class was cut."""
    w = Window.partitionBy("change").orderBy(key)
    counts = delta.groupBy("change").agg((F.count(F.lit(1)) > most).alias("truncated"))
    return delta.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r").join(F.broadcast(counts), "change")


def deleted_rows(baseline: DataFrame, current: DataFrame, key: str = "file_ref") -> DataFrame:
    """Baseline rows that the current snapshot has no more; a search over them is the search for deleted files."""
    return baseline.filter(F.col(key) != 0).join(current.select(key).distinct(), key, "left_anti").select(*baseline.columns)


def parity(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Multiset comparison of two exports: common, only_a and only_b counts."""
    both = a.select(*columns, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(*columns, F.lit(0).alias("x"), F.lit(1).alias("y")))
    rows = both.groupBy(*columns).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return rows.agg(F.sum(F.least("x", "y")).alias("common"), F.sum(F.greatest(F.col("x") - F.col("y"), F.lit(0))).alias("only_a"), F.sum(F.greatest(F.col("y") - F.col("x"), F.lit(0))).alias("only_b"))
