"""Change log: classification, net changes, apply, cursor reads and the Structured Streaming loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scalars import extension


def classify(reason: Column) -> Column:
    """Of a reason mask: deleted > created > renamed > size_changed > metadata_changed > other."""
    has = lambda m: reason.bitwiseAND(F.lit(m).cast("long")) != 0
    return (
        F.when(has(fixed.REASON_DELETE), "deleted").when(has(fixed.REASON_CREATE), "created").when(has(fixed.REASON_RENAME_NEW), "renamed")
        .when(has(fixed.REASON_DATA_EXTEND | fixed.REASON_DATA_TRUNCATION), "size_changed").when(has(fixed.REASON_BASIC_INFO), "metadata_changed").otherwise("other")
    )


def is_close(reason: Column) -> Column:
    return reason.bitwiseAND(F.lit(fixed.REASON_CLOSE).cast("long")) != 0


def _key(df: DataFrame) -> list[str]:
    """Records are told apart by volume and number; a log or table of one volume may leave the volume out."""
    return ["drive", "frs"] if "drive" in df.columns else ["frs"]


def net_changes(log: DataFrame, order: str = "usn") -> DataFrame:
    """One row per record: the last of create, delete and rename wins; size and metadata changes add up; latest parent and latest non-empty name.

    A hash aggregate with partial sums: a key with very many events is folded before the shuffle."""
    state = F.col("kind").isin("created", "deleted", "renamed")
    return log.groupBy(*_key(log)).agg(
        F.max_by(F.when(state, F.col("kind")), F.when(state, F.col(order))).alias("state"),
        F.bool_or(F.col("kind") == "size_changed").alias("size_changed"),
        F.bool_or(F.col("kind") == "metadata_changed").alias("metadata_changed"),
        F.max_by("parent_frs", order).alias("parent_frs"),
        F.max_by(F.when(F.col("name") != "", F.col("name")), F.when(F.col("name") != "", F.col(order))).alias("name"),
        F.max(order).alias("last"),
    )


def apply_changes(files: DataFrame, net: DataFrame) -> DataFrame:
    """files after net changes: deletes drop rows, renames and creates upsert, and a new name brings its extension; an empty name or an unknown delete is skipped.

    Records are matched by (drive, frs) where both tables have a volume. A record that a create reuses or adds has no size, time, flag or directory mark until a
    read of the volume brings them."""
    key = _key(net) if "drive" in files.columns else ["frs"]
    n = net.select(*key, "state", F.col("parent_frs").alias("_p"), F.col("name").alias("_n"))
    joined = files.join(n, key, "left").filter(F.coalesce(F.col("state") != "deleted", F.lit(True)))
    moved = F.col("state").isin("renamed", "created") & F.col("_n").isNotNull()
    reused = (F.col("state") == "created") & F.col("_n").isNotNull()
    blank = {"size": 0, "allocated": 0, "flags": 0, "is_directory": False}
    types = dict(files.dtypes)

    def column(c: str) -> Column:
        new = {"name": F.col("_n"), "parent_frs": F.coalesce("_p", "parent_frs"), "ext": extension(F.col("_n")), "name_bytes": F.col("_n").cast("binary")}
        if c in new:
            return F.when(moved, new[c]).otherwise(F.col(c)).alias(c)
        return F.when(reused, F.lit(blank[c]).cast(types[c])).otherwise(F.col(c)).alias(c) if c in blank else F.col(c)

    fresh = n.filter(reused).join(files.select(*key).distinct(), key, "left_anti")
    made = {"parent_frs": F.col("_p"), "name": F.col("_n"), "ext": extension(F.col("_n")), "name_bytes": F.col("_n").cast("binary"), "seq": F.lit(1)} | {k: F.lit(v) for k, v in blank.items()} | {k: F.col(k) for k in key}
    added = fresh.select(*[made.get(c, F.lit(None)).cast(types[c]).alias(c) for c in files.columns])
    return joined.select(*[column(c) for c in files.columns]).unionByName(added)


def changed_since(log: DataFrame, cursor: int | None, first_usn: int, most: int = 262_144, journal: int | None = None, known_journal: int | None = None) -> tuple[DataFrame | None, bool]:
    """(delta, complete): no cursor, one before the log's first entry, or one of another journal is incomplete and wants a rebuild. The delta holds the `most`
    earliest rows, and in `truncated` whether there are more."""
    if cursor is None or cursor < first_usn or (known_journal is not None and journal != known_journal):
        return None, False
    rows = log.filter(F.col("usn") >= cursor).orderBy("usn").limit(most + 1)
    more = rows.agg((F.count(F.lit(1)) > most).alias("truncated"))
    return rows.orderBy("usn").limit(most).join(F.broadcast(more)), True


def stream_changes(spark, path: str, schema, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False, files_per_trigger: int = 100):
    """Reads a log folder as a stream; each micro-batch is folded to net changes and handed to `sink`. The checkpoint is the cursor: a batch replays whole."""

    def each(batch: DataFrame, number: int) -> None:
        sink(net_changes(batch), number)

    writer = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="500 milliseconds")).start()
