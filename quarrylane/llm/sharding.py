"""Shards of near equal bytes by histogram sort, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

DIGIT = 12  # bits a probing round adds to each open splitter: 4096 exact counts
BUCKETS = 512  # slot buckets per shard


def _u(col: str) -> Column:
    """Signed order of `col` as an unsigned pattern, whose leading bits are the probes."""
    return F.col(col).bitwiseXOR(F.lit(-(2**63)))


def _signed(u: int) -> int:
    return u - 2**63


class _Splitter:
    def __init__(self, target: float):
        self.target, self.prefix, self.below, self.at = target, 0, 0, None


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int | None]]:
    """(key, id) boundaries: shard s starts at the s-th. Exact byte counts below candidate boundaries are refined by 12 key bits a round; where one key alone is too heavy (copies of one text), by id.

    Each round brings at most (shards - 1) * 4096 counts to the driver, whatever the input."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    near = tolerance * total / shards
    cuts = [_Splitter(total * s / shards) for s in range(1, shards)]
    if not total:
        return []
    out: list[tuple[int, int | None]] = [(2**63 - 1, None)] * len(cuts)
    used = 0
    while used < 64 and any(c.at is None for c in cuts):
        step = min(DIGIT, 64 - used)
        opened = sorted({c.prefix for c in cuts if c.at is None})
        part = keys if not used else keys.filter(F.shiftrightunsigned(_u("key"), 64 - used).isin(opened))
        head = F.lit(0).cast("long") if not used else F.shiftrightunsigned(_u("key"), 64 - used)
        digit = F.shiftrightunsigned(_u("key"), 64 - used - step).bitwiseAND(F.lit((1 << step) - 1))
        bins: dict[int, dict[int, int]] = {}
        single: set[tuple[int, int]] = set()
        for r in part.groupBy(head.alias("head"), digit.alias("digit")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect():
            bins.setdefault(r.head, {})[r.digit] = r["size"]
            if r.n == 1:
                single.add((r.head, r.digit))
        used += step
        for i, c in enumerate(cuts):
            if c.at is None:
                below, last = c.below, max(bins[c.prefix])
                for d, size in sorted(bins[c.prefix].items()):
                    if below + size >= c.target or d == last:
                        low, high = c.target - below, below + size - c.target
                        alone = (c.prefix, d) in single
                        c.prefix, c.below = (c.prefix << step) | d, below
                        if alone or min(low, high) <= near:
                            c.at = int(high < low)
                            at = _signed((c.prefix + c.at) << (64 - used))
                            out[i] = (at, None) if at < 2**63 else (2**63 - 1, 2**63 - 1)
                        break
                    below += size
    for i, c in enumerate(cuts):
        if c.at is None:
            out[i] = (_signed(c.prefix), _id_boundary(keys.filter(F.col("key") == _signed(c.prefix)), c, near))
    return out


def _id_boundary(rows: DataFrame, cut: _Splitter, near: float) -> int | None:
    """Within one key: halves the id range into 4096 equal steps a round until a boundary is near enough or ids are single."""
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    while True:
        width = max(1, -(-(high - low + 1) // 4096))
        at = ((F.col("id").cast("decimal(38,0)") - F.lit(low).cast("decimal(38,0)")) / F.lit(width).cast("decimal(38,0)")).alias("at")
        part = rows.filter(F.col("id").between(low, high)).groupBy(F.floor(at).cast("long").alias("at")).agg(F.sum("size").alias("size"))
        bins, below = {r["at"]: r["size"] for r in part.collect()}, cut.below
        for d in sorted(bins):
            if below + bins[d] >= cut.target or d == max(bins):
                low_gap, high_gap = cut.target - below, below + bins[d] - cut.target
                if min(low_gap, high_gap) <= near or width == 1:
                    return low + (d + int(high_gap < low_gap)) * width
                low, high, cut.below = low + d * width, min(high, low + (d + 1) * width - 1), below
                break
            below += bins[d]


def _not_before(boundary: tuple[int, int | None]) -> Column:
    key, at = boundary
    if at is None:
        return F.col("key") >= F.lit(key)
    return (F.col("key") > F.lit(key)) | ((F.col("key") == F.lit(key)) & (F.col("id") >= F.lit(at)))


def assign_shards(df: DataFrame, size: Column, key: Column, id_col: str, shards: int = 24, tolerance: float = 0.002) -> DataFrame:
    """df with `shard` (0 to shards - 1) and `slot` (gapless from 0 in its shard); sizes near equal by bytes.

    Rows are ordered by `key`, then id, so copies of one text lie together and a shard boundary cuts a group only where its bytes demand it.
    Null sizes count 0; null ids sort first and are kept; repeated rows get slots of their own; an empty table gives no rows. Columns `shard` and
    `slot` of df are replaced; others keep their names and values, whatever they are called. Repeated rows of one id and key lie in one shard. Rows are exchanged once, by (shard, bucket); the narrow (key, id, size) table is probed before."""
    keys = df.select(F.coalesce(size, F.lit(0)).alias("size"), key.alias("key"), F.coalesce(F.col(id_col), F.lit(-(2**63))).alias("id"))
    cuts = splitters(keys, shards, tolerance)
    names = [c for c in df.columns if c not in ("shard", "slot")]
    placed = df.select(F.struct(*names).alias("row"), key.alias("key"), F.coalesce(F.col(id_col), F.lit(-(2**63))).alias("id"))
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + _not_before(cut).cast("int")
    placed = placed.withColumn("shard", shard.cast("int")).withColumn("bucket", F.pmod(F.xxhash64("key", "id"), F.lit(BUCKETS)).cast("int"))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))  # at most shards * BUCKETS rows
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("key", "id"))
    return placed.withColumn("within", within).join(F.broadcast(first), ["shard", "bucket"]).select("row.*", "shard", (F.col("first") + F.col("within") - 1).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str) -> None:
    """Whole rows to one folder per shard; a shard is written by as many tasks as its size asks for."""
    df.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)


def shard_documents(df: DataFrame, shards: int = 24, tolerance: float = 0.002) -> DataFrame:
    """Digest rows of sharded documents: doc_id, size (UTF-8 bytes + 8; null text: 8), text_crc32, law, shard, slot, grown_shard (null).

    Law: `bytes`. Copies of one text sort together; a hot group is cut by doc_id. Null ids and repeated rows get slots of their own; an empty table gives no
    rows; other columns are ignored."""
    spark, text = df.sparkSession, F.coalesce(F.col("text"), F.lit(""))
    narrow = df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),
    )
    narrow = Scratch(spark, "shards").write(narrow, "narrow")
    out = assign_shards(narrow, F.col("size"), F.col("text_key"), "doc_id", shards, tolerance)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
