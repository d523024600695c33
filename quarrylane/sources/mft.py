"""Offline decoding of NTFS master file table records into a files table."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import extension, filetime_to_timestamp

# Fixed values. Attribute types, record flags and the name space that only repeats a long name.
STANDARD_INFORMATION, FILE_NAME, DATA, END = 0x10, 0x30, 0x80, 0xFFFFFFFF
IN_USE, DIRECTORY = 0x1, 0x2
DOS_ONLY = 2
SECTOR = 512
FRS_MASK = (1 << 48) - 1

NAMES = "array<struct<name:string,name_bytes:binary,parent_frs:bigint>>"
STREAMS = "array<struct<name:string,size:bigint,allocated:bigint>>"
SCHEMA = f"frs long, seq int, base_frs long, status string, in_use boolean, is_directory boolean, flags int, created long, modified long, accessed long, size long, allocated long, names {NAMES}, streams {STREAMS}"


def fixed_up(raw: bytes) -> bytes | None:
    """The record with the last two bytes of each sector put back; None where a sector's check value is torn or the header is none."""
    if len(raw) < 48 or raw[:4] != b"FILE":
        return None
    at, count = struct.unpack_from("<HH", raw, 4)
    if count < 2 or at + 2 * count > len(raw):
        return None
    out, check = bytearray(raw), raw[at : at + 2]
    for k in range(1, count):
        end = k * SECTOR
        if end > len(raw):
            break
        if raw[end - 2 : end] != check:
            return None
        out[end - 2 : end] = raw[at + 2 * k : at + 2 * k + 2]
    return bytes(out)


def _attributes(rec: bytes) -> Iterator[tuple[int, str, bool, int, int]]:
    """(type, name, resident, place of the attribute, place of a resident value) of each attribute that lies within the record."""
    (at,), (used,) = struct.unpack_from("<H", rec, 0x14), struct.unpack_from("<I", rec, 0x18)
    used = min(used, len(rec))
    while at + 16 <= used:
        kind, size = struct.unpack_from("<II", rec, at)
        if kind == END or size < 16 or at + size > len(rec):
            return
        chars, name_at = rec[at + 9], struct.unpack_from("<H", rec, at + 10)[0]
        name = rec[at + name_at : at + name_at + 2 * chars].decode("utf-16-le", "replace")
        resident = rec[at + 8] == 0
        yield kind, name, resident, at, at + struct.unpack_from("<H", rec, at + 0x14)[0] if resident and size >= 24 else at
        at += size


def decode(raw: bytes, frs: int) -> dict:
    """One record: its names (without those that only repeat a long one), streams and times. `status` is ok, corrupt or empty."""
    row = dict(frs=frs, seq=0, base_frs=0, status="ok", in_use=False, is_directory=False, flags=0, created=0, modified=0, accessed=0, size=0, allocated=0, names=[], streams=[])
    if not any(raw[:4]):
        return row | {"status": "empty"}
    rec = fixed_up(raw)
    if rec is None:
        return row | {"status": "corrupt"}
    row["seq"], (state,), (base,) = struct.unpack_from("<H", rec, 0x10)[0], struct.unpack_from("<H", rec, 0x16), struct.unpack_from("<Q", rec, 0x20)
    row |= {"base_frs": base & FRS_MASK, "in_use": bool(state & IN_USE), "is_directory": bool(state & DIRECTORY)}
    try:
        for kind, name, resident, at, value in _attributes(rec):
            if kind == STANDARD_INFORMATION:
                row["created"], row["modified"], _, row["accessed"], row["flags"] = struct.unpack_from("<qqqqI", rec, value)
            elif kind == FILE_NAME and rec[value + 0x41] != DOS_ONLY:
                parent = struct.unpack_from("<Q", rec, value)[0] & FRS_MASK
                units = rec[value + 0x42 : value + 0x42 + 2 * rec[value + 0x40]].decode("utf-16-le", "surrogatepass")
                row["names"].append({"name": units.encode("utf-8", "replace").decode(), "name_bytes": units.encode("utf-8", "surrogatepass"), "parent_frs": parent})
            elif kind == DATA:
                if resident:
                    size = allocated = struct.unpack_from("<I", rec, at + 0x10)[0]
                elif struct.unpack_from("<Q", rec, at + 0x10)[0]:  # a later extent of a stream repeats no sizes
                    continue
                else:
                    allocated, size = struct.unpack_from("<QQ", rec, at + 0x28)
                if name:
                    row["streams"].append({"name": name, "size": size, "allocated": allocated})
                else:
                    row["size"], row["allocated"] = size, allocated
    except (struct.error, IndexError, UnicodeDecodeError):
        return row | {"status": "corrupt", "names": [], "streams": []}
    row["flags"] = (row["flags"] | (0x10 if row["is_directory"] else 0)) & 0x7FFFFFFF
    return row


def raw_records(spark: SparkSession, path: str, record_size: int = 1024) -> DataFrame:
    """(frs, raw) of a dumped table: fixed-length records in splits, so that a large file is read by many tasks. Records are numbered by their place."""
    rows = spark.sparkContext.binaryRecords(path, record_size).zipWithIndex().map(lambda r: (r[1], bytearray(r[0])))
    return spark.createDataFrame(rows, "frs long, raw binary")


def decoded(raw: DataFrame) -> DataFrame:
    """Records of (frs, raw), corrupt and empty ones with their status; extension records not yet merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [decode(b or b"", f) for f, b in zip(batch.column("frs").to_pylist(), batch.column("raw").to_pylist())]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=wanted)

    text, many = pa.string(), lambda **k: pa.list_(pa.struct(list(k.items())))
    number, flag = pa.int64(), pa.bool_()
    kinds = [number, pa.int32(), number, text, flag, flag, pa.int32(), number, number, number, number, number, many(name=text, name_bytes=pa.binary(), parent_frs=number), many(name=text, size=number, allocated=number)]
    wanted = pa.schema(list(zip([c.split()[0] for c in SCHEMA.split(", ")], kinds)))
    return raw.select("frs", "raw").mapInArrow(run, SCHEMA)


def merged(records: DataFrame) -> DataFrame:
    """Base records with the names, streams and sizes that their extension records hold; one shuffle of the extension records, which are few."""
    good = records.filter("status = 'ok'")
    more = good.filter("base_frs <> 0").groupBy(F.col("base_frs").alias("frs")).agg(
        F.flatten(F.collect_list("names")).alias("more_names"), F.flatten(F.collect_list("streams")).alias("more_streams"), F.max("size").alias("more_size"), F.max("allocated").alias("more_allocated")
    )
    base = good.filter("base_frs = 0").join(more, "frs", "left")
    both = lambda a, b: F.concat(a, F.coalesce(b, F.filter(a, lambda x: F.lit(False))))
    return base.select(
        "frs", "seq", "in_use", "is_directory", "flags", "created", "modified", "accessed", F.greatest("size", F.coalesce("more_size", F.lit(0))).alias("size"), F.greatest("allocated", F.coalesce("more_allocated", F.lit(0))).alias("allocated"),
        both(F.col("names"), F.col("more_names")).alias("names"), both(F.col("streams"), F.col("more_streams")).alias("streams"),
    )


def files_of(records: DataFrame, drive: str, with_deleted: bool = False) -> DataFrame:
    """A files table of merged records: a row a link, then a row a link and stream; records without a name are dropped, ones not in use unless asked for."""
    live = records if with_deleted else records.filter("in_use")
    times = {c: filetime_to_timestamp(F.col(c)) for c in ("created", "modified", "accessed")}
    links = live.withColumns(times).select("frs", "seq", "is_directory", "flags", *times, "size", "allocated", "streams", (~F.col("in_use")).alias("deleted"), F.explode("names").alias("l"))
    own = links.select(F.lit(drive).alias("drive"), "frs", "seq", "l.parent_frs", "l.name", "l.name_bytes", "size", "allocated", *times, "flags", "is_directory", "deleted", extension(F.col("l.name")).alias("ext"))
    named = links.select("*", F.explode("streams").alias("s"))
    text = F.concat("l.name", F.lit(":"), "s.name")
    more = named.select(F.lit(drive).alias("drive"), "frs", "seq", "l.parent_frs", text.alias("name"), text.cast("binary").alias("name_bytes"), "s.size", "s.allocated", *times, "flags", "is_directory", "deleted", F.lit("").alias("ext"))
    return own.unionByName(more)


def deleted_records(records: DataFrame) -> DataFrame:
    return records.filter("NOT in_use")


def load(spark: SparkSession, path: str, drive: str, record_size: int = 1024, with_deleted: bool = False) -> DataFrame:
    """A files table straight from a dumped table."""
    return files_of(merged(decoded(raw_records(spark, path, record_size))), drive, with_deleted)
