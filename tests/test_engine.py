import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrylane import queries as Q
from quarrylane.functions.registry import fields, resolve
from quarrylane.operators import aggregate as agg
from quarrylane.operators import diff, tree
from quarrylane.functions.scalars import filetime_to_timestamp, rendered
from quarrylane.plans import specs
from quarrylane.plans.cli import parse_args
from quarrylane.plans.patterns import match
from quarrylane.plans.search import SearchParams, predicate, search
from quarrylane.sources.catalog import star_catalog
from quarrylane.streaming import changes

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["search_flagship", "search_glob", "search_path_pattern", "tree_metrics", "rollup_ancestor", "terms_type", "snapshot_diff", "net_changes", "text_export"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "events"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = con.sql(Q.ORACLES[name]).df(), Q.QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    tidy = lambda df: df[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert tidy(got).equals(tidy(want))


def test_registry(spark):
    assert len(fields()) == 42 and resolve("EXT").name == "extension" and resolve("allocated").name == "size_on_disk"
    with pytest.raises(ValueError):
        resolve("nothing")


def test_patterns(spark):
    df = spark.createDataFrame([("main.rs",), ("README.md",), ("a[b].txt",)], "name string")
    names = lambda p, **k: {r[0] for r in df.filter(match(F.col("name"), p, **k)).collect()}
    assert names("*.RS") == {"main.rs"} and names("readme") == {"README.md"} and names("*.rs|*.md") == {"main.rs", "README.md"}
    assert names(">^m.*s$") == {"main.rs"} and names("[!m]*.md") == {"README.md"} and names("readme", case_sensitive=True) == set() and names("*") == {"main.rs", "README.md", "a[b].txt"}


def test_specs(spark):
    now = dt.datetime(2024, 3, 13, 12)
    assert specs.parse_size("2KB") == 2048 and specs.parse_time("7d", now)[0] == now - dt.timedelta(days=7)
    assert specs.parse_time("last_month", now) == (dt.datetime(2024, 2, 1), dt.datetime(2024, 3, 1)) and specs.parse_months("q1,may") == [1, 2, 3, 5]
    assert specs.parse_attributes("hidden,!system") == (2, 4) and "pdf" in specs.expand_extensions("documents,rs")
    for bad in (lambda: specs.parse_size("x"), lambda: specs.parse_time("soon", now), lambda: agg.parse_spec("bad:size"), lambda: agg.parse_spec("stats:name")):
        with pytest.raises(ValueError):
            bad()


def _files(spark, rows):
    return spark.createDataFrame([("C", f, p, n, s, a, d) for f, p, n, d, s, a in rows], "drive string, frs long, parent_frs long, name string, size long, allocated long, is_directory boolean")


def test_tree(spark):
    df = _files(spark, [(5, 0, "C", True, 0, 0), (100, 5, "Users", True, 0, 0), (101, 100, "john", True, 0, 0), (102, 101, "a.txt", False, 1000, 4096), (103, 77, "lost.txt", False, 1, 1)])
    paths = {r.frs: r.path for r in tree.with_paths(df).collect()}
    assert paths[102] == "C:\\Users\\john\\a.txt" and paths[103] == "<unknown:77>\\lost.txt"
    sums = {r.frs: (r.descendants, r.treesize, r.tree_allocated) for r in tree.tree_metrics(df).collect()}
    assert sums[5] == (3, 1000, 4096) and sums[101] == (1, 1000, 4096)
    many = _files(spark, [(1, 0, "C", True, 0, 0), *[(k, 1, f"f{k}", False, 100, 100) for k in range(2, 12)], (50, 1, "big", False, 10000, 10000)])
    assert tree.tree_bulkiness(many).first().bulkiness == 1000


def test_changes(spark):
    log = spark.createDataFrame([(10, 1, "deleted", 5, ""), (11, 2, "renamed", 5, "bar2.rs"), (13, 3, "created", 5, "new.txt"), (99, 4, "deleted", 5, ""), (11, 5, "size_changed", 5, "")], "frs long, usn long, kind string, parent_frs long, name string")
    net = changes.net_changes(log)
    files = spark.createDataFrame([(10, 5, "foo.rs"), (11, 5, "bar.rs"), (12, 5, "baz.rs")], "frs long, parent_frs long, name string")
    assert {(r.frs, r.name) for r in changes.apply_changes(files, net).collect()} == {(11, "bar2.rs"), (12, "baz.rs"), (13, "new.txt")}
    assert changes.changed_since(log, None, 1) == (None, False) and changes.changed_since(log, 2, 1, journal=8, known_journal=7) == (None, False)
    delta, complete = changes.changed_since(log, 2, 1, most=2)
    assert complete and [(r.usn, r.truncated) for r in delta.orderBy("usn").collect()] == [(2, True), (3, True)]
    assert [r.k for r in spark.range(1).select(changes.classify(F.lit(0x300).cast("long")).alias("k")).collect()] == ["deleted"]


def test_changes_stay_on_their_volume(spark):
    files = spark.createDataFrame([("C", 10, 5, "a.txt", "txt", 7, False), ("D", 10, 5, "b.txt", "txt", 8, False), ("C", 11, 5, "c.txt", "txt", 9, False)], "drive string, frs long, parent_frs long, name string, ext string, size long, is_directory boolean")
    log = spark.createDataFrame([("C", 10, 1, "deleted", 5, ""), ("C", 11, 2, "renamed", 6, "c.rs"), ("D", 10, 3, "renamed", 5, ""), ("D", 12, 4, "created", 5, "n.md")], "drive string, frs long, usn long, kind string, parent_frs long, name string")
    got = {tuple(r) for r in changes.apply_changes(files, changes.net_changes(log)).collect()}
    assert got == {("D", 10, 5, "b.txt", "txt", 8, False), ("C", 11, 6, "c.rs", "rs", 9, False), ("D", 12, 5, "n.md", "md", 0, False)}
    masks = [(0x1000, "other"), (0x1, "other"), (0x2000, "renamed"), (0x4, "size_changed"), (0x8000, "metadata_changed"), (0x800, "other")]
    assert [spark.range(1).select(changes.classify(F.lit(m).cast("long")).alias("k")).first().k for m, _ in masks] == [k for _, k in masks]


def test_search_order_survives_joins(spark):
    for wanted, low in (({"columns": ["drive", "path", "name", "size"]}, None), ({"columns": ["drive", "name", "size", "descendants"]}, 1)):
        found = search(star_catalog(spark, SF), SearchParams(sort="size:desc", limit=40, mode="files", **wanted)).collect()
        keys = [(-r["size"], r["name"].upper(), r["name"], r["drive"]) for r in found]
        assert keys == sorted(keys) and len(keys) == 40


def test_deep_and_cyclic_chains(spark):
    rows = [("C", 1, 0, "C", True)] + [("C", k, k - 1, f"d{k}", True) for k in range(2, 201)] + [("C", 900, 901, "x", True), ("C", 901, 900, "y", True), ("C", 902, 5000, "lost", True)]
    chains = {r.frs: r for r in tree.directory_chains(spark.createDataFrame(rows, "drive string, frs long, parent_frs long, name string, is_directory boolean")).collect()}
    assert len(chains) == 201 and chains[200].chain == list(range(1, 201)) and chains[200].path == "C:\\" + "\\".join(f"d{k}" for k in range(2, 201)) and chains[902].path == "<unknown:5000>\\lost"


def test_malformed_names(spark):
    bad = b"a\xed\xa0\x81b"
    rows = [("C", 1, 0, "C", b"C", True, 0), ("C", 2, 1, "?", bad, True, 0), ("C", 3, 2, "f.txt", b"f.txt", False, 5)]
    files = spark.createDataFrame(rows, "drive string, frs long, parent_frs long, name string, name_bytes binary, is_directory boolean, size long").withColumns({"modified": F.lit("2020-01-01").cast("timestamp"), "ext": F.lit(""), "flags": F.lit(0), "allocated": F.lit(0)})
    by = lambda **k: [r["name_hex"] for r in search(files, SearchParams(columns=["name_hex", "malformed_path"], **k)).collect()]
    assert by(malformed=True) == [bad.hex()] and set(by(predicates=[("malformed_path", "eq", True)])) == {bad.hex(), b"f.txt".hex()} and by(deleted=True) == []
    assert rendered(bad, False) == "a\ufffdb" and rendered(bad, True) == "a<BAD:D801>b" and rendered(b"\xff", True) == "<BAD>"


def test_predicates_refuse_what_does_not_fit():
    for name, op, value in (("attributes", "eq", ["hidden"]), ("size", "contains", "x"), ("hidden", "lt", True), ("name", "between", "x")):
        with pytest.raises(ValueError):
            predicate(name, op, value)


def test_times(spark):
    ticks = [133_496_544_000_000_000 + k * 1_234_567 for k in range(300)]
    got = [r.u for r in spark.createDataFrame([(t,) for t in ticks], "t long").select(F.unix_micros(filetime_to_timestamp(F.col("t"))).alias("u")).collect()]
    assert got == [(t - 116_444_736_000_000_000) // 10 for t in ticks]


def test_diff_takes_the_first_baseline_row(spark):
    old = spark.createDataFrame([(1, 9, 9, 0), (1, 2, 2, 1), (2, 1, 1, 2)], "file_ref long, size long, modified long, place int").coalesce(1)
    now = spark.createDataFrame([(1, 9, 9), (2, 1, 2), (3, 0, 0)], "file_ref long, size long, modified long")
    for order in ("place", None):
        assert {tuple(r) for r in diff.snapshot_diff(old, now, order=order).collect()} == {(2, "modified"), (3, "added")}


def test_diff_of_repeated_keys_keeps_every_key(spark, tmp_path):
    rows = [(3, 0), (4, 0), (9, None), (5, 7), (6, 7), (1, 8), (None, 2), (-3, -1), (-6, -1)]
    spark.createDataFrame(rows, "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(Q.ORACLES["snapshot_diff_repeated_keys"]).fetchall()
    assert {(0, "modified"), (None, "modified"), (-1, "modified")} == set(want)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in Q.QUERIES["snapshot_diff_repeated_keys"](spark, str(tmp_path)).collect())


def test_cli(spark):
    p, aggs = parse_args(["C:*.dll", "--exact-descendants", "3", "--facet", "type", "--count", "--between", "2020-01-01,2021-01-01", "--newer", "2020-06-01"])
    assert (p.drives, p.ext, p.pattern, p.ranges, aggs) == (["C"], "dll", "*", {"descendants": (3, 3)}, ["count", "terms:type,top=20"])
    assert p.newer == {"modified": "2020-06-01"} and p.older == {"modified": "2021-01-01"} and parse_args(["--ends-with", "x"])[0].pattern == "*x"
    for words in (["--name-only", "a\\b"], ["--nosuch"], ["--limit", "x"]):
        with pytest.raises(ValueError):
            parse_args(words)


def test_aggregate_cursor_and_wire(spark):
    buckets = spark.createDataFrame([(f"k{k}", 10 - k) for k in range(5)], "key string, count long")
    first = agg.page(buckets, None, 2).collect()
    assert [r["key"] for r in first] == ["k0", "k1"] and first[0].next_cursor == "0:2:2"
    last = agg.page(buckets, "0:4:2").collect()
    assert [r["key"] for r in last] == ["k4"] and last[0].next_cursor is None
    assert agg.from_wire({"kind": "hist", "field": "size", "interval": 10}) == ["hist:size,interval=10"] and agg.from_wire({"kind": "preset", "preset": "by_type"}) == ["terms:type,top=30"]
    for bad in (lambda: agg.page(buckets, "x"), lambda: agg.from_wire({"kind": "terms"}), lambda: agg.from_wire({"kind": "preset", "preset": "x"})):
        with pytest.raises(ValueError):
            bad()


def test_duplicates_options(spark):
    rows = [("C", k, 5, "a.txt", 10, 10, "same" if k < 3 else "other", False) for k in range(4)] + [("C", 9 + k, 5, "b.txt", 20, 20, "b", False) for k in range(2)]
    files = spark.createDataFrame(rows, "drive string, frs long, parent_frs long, name string, size long, allocated long, text string, is_directory boolean")
    assert [(r.key_name, r["count"], [s.frs for s in r.samples]) for r in agg.run(files, "duplicates:size+name,sample=2,max_groups=1").collect()] == [("a.txt", 4, [0, 1])]
    assert [r.key_name for r in agg.run(files, "duplicates:size+name,verify=sha256", content="text").collect()] == ["b.txt"]


def test_stream_equals_batch(spark, tmp_path):
    log = spark.createDataFrame([(k % 3, k, "renamed", 5, f"n{k}") for k in range(30)], "frs long, usn long, kind string, parent_frs long, name string")
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    got = []
    changes.stream_changes(spark, str(tmp_path / "log"), log.schema, lambda df, n: got.extend(df.collect()), str(tmp_path / "cp"), available_now=True).awaitTermination(60)
    assert sorted(got) == sorted(changes.net_changes(log).collect())


def test_diff_and_parity(spark):
    a = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "k int, v int")
    b = spark.createDataFrame([(1, 1), (3, 1)], "k int, v int")
    assert tuple(diff.parity(a, b, ["k", "v"]).first()) == (1, 2, 1)


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def _record(frs, parent=5, name="", flags=1, data=b"", base=0, streams=(), extra_names=(), size=None):
    """A record as a volume holds it: header, standard information, names, data, update sequence."""
    import struct

    def resident(kind, value, label=""):
        text = label.encode("utf-16-le")
        head = 24 + len(text) + (-len(text) % 8)
        total = head + len(value) + (-len(value) % 8)
        body = struct.pack("<IIBBHHHIHH", kind, total, 0, len(label), 24, 0, 0, len(value), head, 0) + text
        return (body.ljust(head, b"\0") + value).ljust(total, b"\0")

    def file_name(text, up, space):
        units = text if isinstance(text, bytes) else text.encode("utf-16-le")
        return resident(0x30, struct.pack("<Q", up | 1 << 48) + bytes(56) + bytes([len(units) // 2, space]) + units)

    out = resident(0x10, struct.pack("<qqqqI", *[133_496_544_000_000_010 + k for k in range(4)], 0x20) + bytes(12))
    for text, up, space in ([(name, parent, 1)] if name else []) + list(extra_names):
        out += file_name(text, up, space)
    if size is not None:
        out += struct.pack("<IIBBHHHQQHHIQQQ", 0x80, 72, 1, 0, 64, 0, 0, 0, 0, 64, 0, 0, size[1], size[0], size[0]).ljust(72, b"\0")
    elif data:
        out += resident(0x80, data)
    for label, value in streams:
        out += resident(0x80, value, label)
    out += struct.pack("<I", 0xFFFFFFFF)
    head = struct.pack("<4sHHQHHHHIIQHHI", b"FILE", 48, 3, 0, 7, 1, 56, flags, 56 + len(out), 1024, base, 0, 0, frs)
    raw = bytearray((head.ljust(56, b"\0") + out).ljust(1024, b"\0"))
    raw[48:50] = b"\xab\xcd"
    for k in (1, 2):
        raw[48 + 2 * k : 50 + 2 * k] = raw[512 * k - 2 : 512 * k]
        raw[512 * k - 2 : 512 * k] = b"\xab\xcd"
    return bytes(raw)


def test_master_file_table(spark, tmp_path):
    from quarrylane.sources import mft

    torn = bytearray(_record(4, name="torn.txt"))
    torn[510] ^= 1
    lone = "a".encode("utf-16-le") + b"\x01\xd8" + "b".encode("utf-16-le")
    records = {
        5: _record(5, 5, ".", flags=3), 6: _record(6, 5, "docs", flags=3, data=b""), 7: _record(7, 6, "note.TXT", data=b"x" * 300, streams=[("meta", b"12345")], extra_names=[("NOTE~1.TXT", 6, 2), ("link.md", 5, 1)]),
        8: _record(8, 6, "big.bin", base=0), 9: _record(9, base=8 | 1 << 48, extra_names=[("big2.bin", 5, 1)], size=(70_000, 73_728)), 10: _record(10, 5, "gone.log", flags=0, data=b"zz"), 11: _record(11, 5, lone),
    }
    (tmp_path / "mft.bin").write_bytes(b"".join(records.get(k, bytes(torn) if k == 4 else bytes(1024)) for k in range(12)))
    status = {r.frs: r.status for r in mft.decoded(mft.raw_records(spark, str(tmp_path / "mft.bin"))).collect()}
    assert status[4] == "corrupt" and status[0] == "empty" and all(status[k] == "ok" for k in records)
    rows = mft.load(spark, str(tmp_path / "mft.bin"), "C", with_deleted=True)
    got = {(r.frs, r["name"]): r for r in rows.collect()}
    assert set(got) == {(5, "."), (6, "docs"), (7, "note.TXT"), (7, "link.md"), (7, "note.TXT:meta"), (7, "link.md:meta"), (8, "big.bin"), (8, "big2.bin"), (10, "gone.log"), (11, "a?b")}
    assert got[7, "note.TXT"]["size"] == 300 and got[7, "note.TXT"].ext == "txt" and got[7, "link.md:meta"]["size"] == 5 and got[7, "link.md"].parent_frs == 5
    assert (got[8, "big2.bin"]["size"], got[8, "big.bin"].allocated) == (70_000, 73_728) and got[10, "gone.log"].deleted and got[6, "docs"].is_directory and got[6, "docs"].flags == 0x30
    paths = {r.frs: r.path for r in tree.with_paths(rows).filter("name = 'note.TXT'").collect()}
    assert paths == {7: ".:\\docs\\note.TXT"}
    assert [r["name_hex"] for r in search(rows, SearchParams(malformed=True, columns=["name_hex"])).collect()] == ["61eda08162"]
    assert mft.load(spark, str(tmp_path / "mft.bin"), "C").filter("deleted").count() == 0
