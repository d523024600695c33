"""Stored catalogs: a version's files with its directory chains and subtree sums, written once and read by every query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import tree
from ..plans.search import SearchParams, search
from .catalog import complete


@dataclass(frozen=True)
class Catalog:
    files: DataFrame
    chains: DataFrame
    metrics: DataFrame

    def search(self, p: SearchParams) -> DataFrame:
        return search(self.files, p, self.chains, self.metrics)


def build(files: DataFrame, folder: str) -> Catalog:
    """Writes a catalog version; its folder must be new. Files are sorted by extension and size within their tasks, so that row groups can be skipped by both."""
    spark = files.sparkSession
    complete(files).sortWithinPartitions("ext", "size").write.parquet(f"{folder}/files")
    stored = spark.read.parquet(f"{folder}/files")
    tree.directory_chains(stored).write.parquet(f"{folder}/chains")
    chains = spark.read.parquet(f"{folder}/chains")
    tree.tree_metrics(stored, chains).write.parquet(f"{folder}/metrics")
    return load(spark, folder)


def load(spark: SparkSession, folder: str) -> Catalog:
    return Catalog(*(spark.read.parquet(f"{folder}/{name}") for name in ("files", "chains", "metrics")))
