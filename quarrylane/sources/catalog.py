"""Catalog sources: files tables from Parquet, CSV or JSON, and the catalog that the star-schema test tables describe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import extension

FILES = "drive frs seq parent_frs name size allocated created modified accessed flags is_directory ext".split()


def load(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True) if kind == "csv" else spark.read.format(kind).load(path)


def complete(files: DataFrame) -> DataFrame:
    """files with the columns that a catalog may leave out: name bytes as the name has them, and no row deleted."""
    absent = {"name_bytes": F.col("name").cast("binary"), "deleted": F.lit(False)}
    return files.withColumns({k: v for k, v in absent.items() if k not in files.columns})


def drop_invalid(records: DataFrame) -> DataFrame:
    """Without records that have no name, or whose parent is no record of their volume; roots (0 or their own parent) stay."""
    known = records.select("drive", F.col("frs").alias("parent_frs")).distinct()
    root = (F.col("parent_frs") == 0) | (F.col("parent_frs") == F.col("frs"))
    named = records.filter(F.coalesce(F.col("name"), F.lit("")) != "")
    return named.filter(root).unionByName(named.filter(~root).join(known, ["drive", "parent_frs"], "left_semi").select(*named.columns))


def overlay(base: DataFrame, delta: DataFrame, gone: DataFrame, key: tuple[str, ...] = ("drive", "frs")) -> DataFrame:
    """A base table under a delta: rows of `gone` and rows that the delta has anew are masked. `compact` writes it as the next base."""
    masked = gone.select(*key).unionByName(delta.select(*key)).distinct()
    return base.join(masked, list(key), "left_anti").select(*base.columns).unionByName(delta.join(gone.select(*key).distinct(), list(key), "left_anti").select(*base.columns))


def compact(base: DataFrame, delta: DataFrame, gone: DataFrame, path: str) -> DataFrame:
    overlay(base, delta, gone).write.mode("errorifexists").parquet(path)
    return base.sparkSession.read.parquet(path)


def tagged(df: DataFrame, drive: str) -> DataFrame:
    """Adds the volume's name as first column."""
    return df.select(F.lit(drive).alias("drive"), *[c for c in df.columns if c != "drive"])


def union_volumes(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def with_extension(df: DataFrame) -> DataFrame:
    return df.withColumn("ext", extension(F.col("name")))


def expand_links(records: DataFrame) -> DataFrame:
    """A row per hard link of `links` (array of name, parent_frs), in order; all of a record's other columns repeat."""
    return records.select(*[c for c in records.columns if c not in ("links", "name", "parent_frs")], F.posexplode("links").alias("link", "l")).select("*", F.col("l.name").alias("name"), F.col("l.parent_frs").alias("parent_frs")).drop("l")


def expand_streams(records: DataFrame) -> DataFrame:
    """A row `name:stream` for each alternate stream (array of name, size) beside the record's own; stream rows have no extension.
    After expand_links each link's name meets each stream."""
    rest = [c for c in records.columns if c not in ("streams", "name", "size", "ext")]
    own = records.select(*rest, "name", "size", extension(F.col("name")).alias("ext"))
    more = records.select(*rest, "name", F.explode("streams").alias("s")).select(*rest, F.concat("name", F.lit(":"), "s.name").alias("name"), F.col("s.size").alias("size"), F.lit("").alias("ext"))
    return own.unionByName(more)


def star_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A files catalog: regions are drives, nations and customers directories, orders files."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    region, nation, customer, orders = t("region"), t("nation"), t("customer"), t("orders")
    day = F.lit("1995-01-01").cast("timestamp")

    def directory(drive, frs, parent, name):
        return [drive.alias("drive"), frs.cast("long").alias("frs"), F.lit(1).alias("seq"), parent.cast("long").alias("parent_frs"), name.alias("name"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("allocated"), day.alias("created"), day.alias("modified"), day.alias("accessed"), F.lit(0x10).alias("flags"), F.lit(True).alias("is_directory"), F.lit("").alias("ext")]

    where = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_regionkey", "n_name", "r_name")
    homes = customer.join(where, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "r_name")
    key = F.col("o_orderkey")
    kind = F.element_at(F.create_map(*[F.lit(x) for p in (("1-URGENT", "exe"), ("2-HIGH", "TXT"), ("3-MEDIUM", "jpg"), ("4-NOT SPECIFIED", "rs"), ("5-LOW", "zip")) for x in p]), F.col("o_orderpriority"))
    size = F.when(key % 97 == 0, F.lit(0)).otherwise(F.floor("o_totalprice")).cast("long")
    stamp = F.col("o_orderdate").cast("timestamp")
    files = orders.join(homes, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("r_name").alias("drive"), (F.lit(10_000_000).cast("long") + key).alias("frs"), F.lit(1).alias("seq"), (F.lit(1000).cast("long") + F.col("o_custkey")).alias("parent_frs"),
        F.when(key % 89 == 0, F.concat(F.lit("order_"), key.cast("string"))).otherwise(F.concat(F.lit("order_"), key.cast("string"), F.lit("."), kind)).alias("name"),
        size.alias("size"), (F.ceil(size / 4096) * 4096).cast("long").alias("allocated"), F.expr("o_orderdate - INTERVAL 30 DAYS").cast("timestamp").alias("created"), stamp.alias("modified"), F.expr("o_orderdate + INTERVAL 7 DAYS").cast("timestamp").alias("accessed"),
        F.when(F.col("o_orderstatus") == "F", 0x20).when(F.col("o_orderstatus") == "O", 0x22).otherwise(0x1).alias("flags"), F.lit(False).alias("is_directory"), F.when(key % 89 == 0, F.lit("")).otherwise(F.lower(kind)).alias("ext"),
    )
    roots = region.select(*directory(F.col("r_name"), F.col("r_regionkey") + 1, F.lit(0), F.col("r_name")))
    nations = where.select(*directory(F.col("r_name"), F.col("n_nationkey") + 100, F.col("n_regionkey") + 1, F.col("n_name")))
    customers = homes.select(*directory(F.col("r_name"), F.col("c_custkey") + 1000, F.col("c_nationkey") + 100, F.concat(F.lit("cust_"), F.col("c_custkey").cast("string"))))
    return roots.unionByName(nations).unionByName(customers).unionByName(files)
