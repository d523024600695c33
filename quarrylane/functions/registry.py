"""Field registry: one entry drives parsing, validation, filters, sorts and projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .scalars import file_type, has_bits, malformed, name_hex, ratio_scaled


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # string, number, time, bool, bits
    column: Column
    aliases: tuple[str, ...] = ()
    sortable: bool = True
    descending: bool = False
    group: bool = False
    needs: str = ""  # "path" or "tree": which derived table the field comes from


def _flag(name: str, bit: str, *aliases: str) -> Field:
    return Field(name, "bool", has_bits(F.col("flags"), fixed.ATTRIBUTES[bit]), aliases, descending=True, group=True)


def fields() -> dict[str, Field]:
    """Canonical name -> field. Columns are unresolved expressions over the files schema."""
    c, number = F.col, lambda n, col, *a, needs="": Field(n, "number", col, a, descending=True, needs=needs)
    sums = lambda own, tree: F.when(c("is_directory"), c(tree)).otherwise(c(own))
    # Fixed values. Canonical names and aliases are the interface.
    listed = [
        Field("drive", "string", c("drive"), ("drv",), group=True),
        Field("path", "string", c("path"), needs="path"),
        Field("name", "string", c("name"), group=True),
        Field("path_only", "string", c("path_only"), ("pathonly", "path only"), group=True, needs="path"),
        number("size", c("size")),
        number("size_on_disk", c("allocated"), "sizeondisk", "size on disk", "allocated"),
        Field("created", "time", c("created"), descending=True),
        Field("modified", "time", c("modified"), ("written", "date"), descending=True),
        Field("accessed", "time", c("accessed"), descending=True),
        Field("extension", "string", c("ext"), ("ext",), group=True),
        Field("type", "string", file_type(c("ext"), c("is_directory")), ("folder",), group=True),
        Field("attributes", "bits", c("flags"), ("attrs",), sortable=False),
        Field("attribute_value", "bits", c("flags"), ("attributevalue", "attrval"), sortable=False),
        _flag("hidden", "hidden", "h"), _flag("system", "system", "s"), _flag("archive", "archive", "a"), _flag("read_only", "readonly", "readonly", "read-only", "read only", "r"),
        _flag("compressed", "compressed"), _flag("encrypted", "encrypted"), _flag("sparse", "sparse"), _flag("reparse", "reparse"), _flag("offline", "offline", "o"),
        _flag("not_indexed", "notindexed"), _flag("temporary", "temporary", "temp"), _flag("virtual", "virtual"), _flag("pinned", "pinned"), _flag("unpinned", "unpinned"),
        number("descendants", c("descendants"), "decendents", needs="tree"),
        number("tree_size", c("treesize"), "treesize", needs="tree"),
        number("tree_allocated", sums("allocated", "tree_allocated"), "treeallocated", needs="tree"),
        number("bulkiness", ratio_scaled(sums("allocated", "tree_allocated"), sums("size", "treesize")), needs="tree"),
        _flag("integrity", "integrity"), _flag("no_scrub", "noscrub", "noscrub", "no scrub", "no scrub file"),
        Field("directory_flag", "bool", c("is_directory"), ("directoryflag", "directory flag", "directory", "dir"), descending=True, group=True),
        _flag("recall_on_open", "recall_on_open", "recallonopen", "recall on open"), _flag("recall_on_data_access", "recall_on_data_access", "recallondataaccess", "recall on data access"),
        Field("parity_attributes", "bits", c("flags").bitwiseAND(F.lit(fixed.PARITY_MASK)), ("parityattributes",), sortable=False),
        number("name_length", F.length("name"), "namelength", "name_len", "namelen"),
        number("path_length", F.least(F.length("path"), F.lit(65535)), "pathlength", "path_len", "pathlen", needs="path"),
        Field("malformed", "bool", malformed(c("name_bytes")), ("ill_formed", "illformed", "bad_name"), descending=True, group=True),
        Field("malformed_path", "bool", c("malformed_path"), ("malformedpath", "ill_formed_path", "bad_path"), descending=True, group=True, needs="path"),
        Field("name_hex", "string", name_hex(c("name_bytes")), ("namehex", "name_bytes_hex"), sortable=False),
    ]
    return {f.name: f for f in listed}


def resolve(name: str) -> Field:
    """By canonical name or alias, whatever its case; an unknown name is an error."""
    known, key = fields(), name.strip().lower()
    if key in known:
        return known[key]
    for f in known.values():
        if key in f.aliases:
            return f
    raise ValueError(f"unknown field: {name}")
