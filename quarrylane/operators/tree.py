"""Hierarchy: paths, ancestors, subtree sums, rollups. Directories are joined to their ancestors once a catalog; files join their parent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import link_share

MAX_DEPTH = 256
SEP = "\\"


def directory_chains(files: DataFrame) -> DataFrame:
    """(drive, frs, chain, path, bad): chain lists ancestors from the root to the directory; bad tells whether a name on it is malformed. Missing parents give
    `<unknown:N>`; directories on or below a cycle, or deeper than MAX_DEPTH, have no chain.

    Pointer doubling over directories alone: a round joins each part of a chain to the part above it, so depth d takes log2(d) joins. Each round is cut off
    from its lineage by checkpoint()."""
    spark = files.sparkSession
    raw = F.col("name_bytes").cast("string") if "name_bytes" in files.columns else F.col("name")
    dirs = files.filter("is_directory").select("drive", "frs", "parent_frs", "name", (~F.is_valid_utf8(raw)).alias("bad")).dropDuplicates(["drive", "frs"])
    key = dirs.select("drive", F.col("frs").alias("parent_frs"), F.lit(True).alias("known"))
    is_root = (F.col("parent_frs") == 0) | (F.col("parent_frs") == F.col("frs"))
    lost = F.concat(F.lit("<unknown:"), F.col("parent_frs").cast("string"), F.lit(">" + SEP), F.col("name"))
    text = F.when(is_root, F.concat("name", F.lit(":"))).when(F.col("known").isNull(), lost).otherwise(F.col("name"))
    state = dirs.join(key, ["drive", "parent_frs"], "left").select("drive", "frs", F.when(~is_root & F.col("known"), F.col("parent_frs")).alias("top"), F.array("frs").alias("chain"), text.alias("path"), "bad")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"))
    state = state.checkpoint()
    for _ in range(MAX_DEPTH.bit_length() - 1):
        if state.filter("top IS NOT NULL").isEmpty():
            break
        over = state.select("drive", F.col("frs").alias("top"), F.col("top").alias("t"), F.col("chain").alias("c"), F.col("path").alias("p"), F.col("bad").alias("b"))
        joined = state.filter("top IS NOT NULL").join(over, ["drive", "top"]).select("drive", "frs", F.col("t").alias("top"), F.concat("c", "chain").alias("chain"), F.concat("p", F.lit(SEP), "path").alias("path"), (F.col("b") | F.col("bad")).alias("bad"))
        state = state.filter("top IS NULL").unionByName(joined).checkpoint()
    return state.filter("top IS NULL").drop("top")


def with_paths(files: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """files with path, path_only, chain (ancestor directories, root first) and malformed_path."""
    chains = directory_chains(files) if chains is None else chains
    raw = F.col("name_bytes").cast("string") if "name_bytes" in files.columns else F.col("name")
    up = chains.select("drive", F.col("frs").alias("parent_frs"), F.col("path").alias("dir_path"), F.col("chain").alias("chain"), F.col("bad").alias("dir_bad"))
    joined = files.join(up, ["drive", "parent_frs"], "left")
    root = F.col("parent_frs").isin(0) | (F.col("parent_frs") == F.col("frs"))
    base = F.when(root, F.lit("")).otherwise(F.coalesce("dir_path", F.concat(F.lit("<unknown:"), F.col("parent_frs").cast("string"), F.lit(">"))))
    path = F.when(root & F.col("is_directory"), F.concat("name", F.lit(":"))).when(root, F.col("name")).otherwise(F.concat(base, F.lit(SEP), "name"))
    above = F.when(root, F.array().cast("array<long>")).otherwise(F.coalesce("chain", F.array().cast("array<long>")))
    bad = ~F.is_valid_utf8(raw) | (~root & F.coalesce("dir_bad", F.lit(False)))
    return joined.select(*files.columns, path.alias("path"), base.alias("path_only"), above.alias("chain"), bad.alias("malformed_path"))


def record_info(files: DataFrame, path: str, chains: DataFrame | None = None) -> DataFrame:
    """All columns and the path of the rows at a path, whatever its case: its directory is found among directories, its last segment among that one's children,
    so no file's path is built. A bare volume is no record."""
    chains = directory_chains(files) if chains is None else chains
    above, _, leaf = path.replace("/", SEP).rstrip(SEP).rpartition(SEP)
    up = chains.filter(F.lower("path") == F.lower(F.lit(above))).select("drive", F.col("frs").alias("parent_frs"), F.col("path").alias("_up"))
    found = files.filter(F.lower("name") == F.lower(F.lit(leaf))).join(up, ["drive", "parent_frs"])
    return found.select(*files.columns, F.concat("_up", F.lit(SEP), "name").alias("path"))


def tree_metrics(files: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """(drive, frs, descendants, treesize, tree_allocated) of directories. Files sum up to their parent first, so a hot directory is pre-aggregated before
    anything is multiplied by depth; then each directory's own sum goes to all its ancestors."""
    chains = directory_chains(files) if chains is None else chains
    own = files.groupBy("drive", F.col("parent_frs").alias("frs")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"), F.sum("allocated").alias("a"))
    spread = chains.join(own, ["drive", "frs"]).select("drive", F.explode("chain").alias("frs"), "n", "s", "a")
    sums = spread.groupBy("drive", "frs").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("a").alias("a"))
    return chains.select("drive", "frs").join(sums, ["drive", "frs"], "left").select("drive", "frs", *[F.coalesce(x, F.lit(0)).cast("long").alias(y) for x, y in (("n", "descendants"), ("s", "treesize"), ("a", "tree_allocated"))])


def shared_links(files: DataFrame) -> DataFrame:
    """Link rows (`link` of `links`, from 0) with their exact share of size and allocated, so that subtree sums count a record once however many links it has."""
    return files.withColumns({c: link_share(F.col(c), F.col("link"), F.col("links")) for c in ("size", "allocated")})


def with_tree(files: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    metrics = tree_metrics(files) if metrics is None else metrics
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = files.join(metrics, ["drive", "frs"], "left")
    return out.select(*files.columns, zero("descendants").alias("descendants"), F.when(F.col("is_directory"), zero("treesize")).otherwise(F.col("size")).alias("treesize"), F.when(F.col("is_directory"), zero("tree_allocated")).otherwise(F.col("allocated")).alias("tree_allocated"))


def rollup_path(files: DataFrame, depth: int, chains: DataFrame | None = None) -> DataFrame:
    """(drive, ancestor, count, total_bytes, total_allocated) by the ancestor directory at `depth` (the root is 0), or the row itself where it lies higher."""
    rows = with_paths(files, chains)
    at = F.when(F.size("chain") > depth, F.element_at("chain", depth + 1)).otherwise(F.col("frs"))
    return rows.groupBy("drive", at.alias("ancestor")).agg(F.count(F.lit(1)).alias("count"), F.sum("size").alias("total_bytes"), F.sum("allocated").alias("total_allocated"))


def labelled(groups: DataFrame, files: DataFrame, record: str = "ancestor") -> DataFrame:
    """Rollup rows with `label` (`drive:\\name`) of their record."""
    names = files.groupBy("drive", F.col("frs").alias(record)).agg(F.min("name").alias("name"))
    return groups.join(names, ["drive", record], "left").withColumn("label", F.concat("drive", F.lit(":" + SEP), "name")).drop("name")


def rollup_ancestor(files: DataFrame, drive: str, record: int, chains: DataFrame | None = None) -> DataFrame:
    """By the child of `record` on the way down to each row; rows not below it group as themselves."""
    rows = with_paths(files.filter(F.col("drive") == drive), chains)
    place = F.array_position("chain", record)
    child = F.when(place == 0, F.col("frs")).when(place < F.size("chain"), F.element_at("chain", (place + 1).cast("int"))).otherwise(F.col("frs"))
    return rows.groupBy(child.alias("child")).agg(F.count(F.lit(1)).alias("count"), F.sum("size").alias("total_bytes"))


def descendants_of(files: DataFrame, matches: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """Rows that lie under a matched directory, and the matches, once each."""
    rows = with_paths(files, chains)
    under = rows.select("drive", "frs", "parent_frs", "name", F.explode("chain").alias("up")).join(matches.select("drive", F.col("frs").alias("up")).distinct(), ["drive", "up"], "left_semi")
    keys = under.select("drive", "frs", "parent_frs", "name").unionByName(matches.select("drive", "frs", "parent_frs", "name")).distinct()
    return files.join(keys, ["drive", "frs", "parent_frs", "name"], "left_semi")


def tree_bulkiness(files: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """(drive, frs, bulkiness): a folder's children's bulkiness after dropping children of 1 % or more of its tree_allocated, level by level from below."""
    chains = directory_chains(files) if chains is None else chains
    metrics = tree_metrics(files, chains)
    dirs = files.filter("is_directory").select("drive", "frs", "parent_frs").join(metrics, ["drive", "frs"]).join(chains.select("drive", "frs", F.size("chain").alias("depth")), ["drive", "frs"])
    deepest = dirs.agg(F.max("depth")).first()[0] or 0
    limit = dirs.select("drive", F.col("frs").alias("parent_frs"), F.col("tree_allocated").alias("whole"))
    kept = lambda rows: rows.join(limit, ["drive", "parent_frs"]).filter(F.col("mine") * 100 < F.col("whole"))
    leaf = kept(files.filter("NOT is_directory").select("drive", "parent_frs", F.col("allocated").alias("mine"), F.col("allocated").alias("b"))).groupBy("drive", "parent_frs").agg(F.sum("b").alias("b"))
    below, out = None, None
    for depth in range(deepest, 0, -1):
        at = dirs.filter(F.col("depth") == depth)
        sums = leaf if below is None else leaf.unionByName(kept(below).groupBy("drive", "parent_frs").agg(F.sum("b").alias("b")))
        sums = sums.groupBy("drive", F.col("parent_frs").alias("frs")).agg(F.sum("b").alias("b"))
        here = at.join(sums, ["drive", "frs"], "left").select("drive", "frs", "parent_frs", F.col("tree_allocated").alias("mine"), F.coalesce("b", F.lit(0)).cast("long").alias("b"))
        below, out = here, here if out is None else out.unionByName(here)
    return (out if out is not None else dirs.select("drive", "frs", F.lit(0).cast("long").alias("b"))).select("drive", "frs", F.col("b").alias("bulkiness"))
