"""A training corpus from raw documents: each stage's decisions take effect on what the stage before it kept.

Every stage but the last returns the columns of `documents`. Stages take empty tables, null texts and ids, and repeated rows as their operators define;
rows without an id pass the near-duplicate stage, as none can stand for another there. An empty table gives no rows at every stage, and stages keep the
other columns of documents, whatever they are called."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.llm import jaccard, packing, quality, substring_dedup, toxicity
from quarrylane.llm.common import Scratch, give_back


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are toxic with a probability of 0.3 or more."""
    model = toxicity.fit(docs, _labels(spark, sf_dir))
    return toxicity.score_documents(docs, model).filter(~F.col("toxic")).select(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose calibrated quality is under 0.3."""
    model = quality.fit(docs, _labels(spark, sf_dir))
    return quality.score_documents(docs, model).filter("predicted = 1").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates: sets of 5-word shingles with a Jaccard similarity of 0.8 or more.

    Of repeated rows (one id, one text) one stays. An id with several texts goes if any of them is a copy of a document with a smaller id."""
    groups = jaccard.jaccard_components(docs, n=5, percent=80)
    seen = groups.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("doc_id") != F.col("component_id")).alias("_gone"), (F.count(F.lit(1)) > 1).alias("_again"))
    seen = Scratch(spark, "near").write(seen.filter("_gone OR _again"), "seen")
    kept = docs.join(seen.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.join(seen.filter("NOT _gone").select("doc_id"), "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return kept.unionByName(repeated)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words of 20-word windows that start earlier; untouched texts stay as they are."""
    kept = substring_dedup.remove_repeats(docs, with_text=True)
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return packing.pack(docs)


def _from_small_heaps(stage: Callable) -> Callable:
    """The same stage, begun when executors have given back what the stage before left in their heaps; else its own workers come on top of that."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", _from_small_heaps(one_of_each_group)),
    ("substring_dedup", _from_small_heaps(drop_repeated_passages)),
    ("packing", _from_small_heaps(pack)),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
