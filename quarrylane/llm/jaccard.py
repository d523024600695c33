"""N-gram Jaccard join by token-combination prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import U64, Scratch, mix, n_grams, partitions_for, steps, text_bytes, tidy, word_hashes
from .components import components

SLOTS = 18  # log2 of the counters that part rare from frequent shingles
SLICES = 16
NARROW, MIDDLE = 512, 2048  # least bits of a parity bitmap; bits from which the one that buckets compare grows by half a bit to a bit an item, not by 2 to 4
#: A broadcast of class keys is used up to this many rows (16 bytes each); beyond, rows are shuffled.
BROADCAST_ROWS = 400_000
SALTS = 4
BLOCK = 20_000  # classes of a hot signature or an open group that one task compares with as many others


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Fewer than n words: the whole sequence as one; no words: empty."""
    flat, counts = word_hashes(texts, lower=True)
    grams = n_grams(flat, n) if len(flat) else flat
    out, at = [], 0
    for k in counts.tolist():
        if k >= n:
            out.append(_distinct(grams[at : at + k - n + 1]))
        elif k:
            out.append(mix(n_grams(flat[at : at + k], k)[:1] + U64(k)))
        else:
            out.append(flat[:0])
        at += k
    return out


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def class_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit key of each set."""
    keys = np.zeros(len(sets), dtype=np.uint64)
    for k, s in enumerate(sets):
        if len(s):
            keys[k] = (int(s.sum(dtype=np.uint64)) + len(s) * int(np.bitwise_xor.reduce(s))) & (2**64 - 1)
    return mix(keys)


def bitmap(s: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set, in 64-bit words; its length is a power of two."""
    bits = max(NARROW, 1 << (2 * len(s) - 1).bit_length()) if len(s) else NARROW
    odd = np.bincount((s & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The parity bitmap of `words` words from one that is as long or longer."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def narrow(s: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The bitmap that travels to buckets: the whole one up to MIDDLE bits, then a fold. Bitmaps of unrelated sets differ in more places than a link allows
    up to 3 items a bit; those of sets just below the threshold do so at half an item a bit."""
    return fold(bits, min(len(bits), max(MIDDLE, 1 << (len(s) // 2).bit_length()) // 64))


def within(differ: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether bitmaps leave room for a link: it has |difference| <= (100 - p) / (100 + p) * (|x| + |y|), and bitmaps differ in no more places."""
    return differ * (100 + percent) <= (100 - percent) * sizes


def signatures(s: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Prefix signatures of one set. Rare shingles stand first and are indexed singly; where they don't suffice, the prefix is extended by frequent ones,
    indexed as pairs within hashed classes. A class of pairs lets one shared shingle go unseen, so the prefix grows by one for each class used: two sets
    that reach the threshold then share a single or a pair. The number of classes depends on a size band; a set near the next band emits for both."""
    spare = len(s) - (percent * len(s) + 99) // 100
    often = frequent[(s >> U64(64 - SLOTS)).astype(np.int64)]
    rare = s[~often]
    if len(rare) > spare:
        return rare[: spare + 1]
    dense = s[often]
    band = len(s).bit_length() - 1
    out = [rare]
    for b in (band, band + 1) if len(s) * 100 >= percent * (1 << (band + 1)) else (band,):
        if b < 6:
            out.append(mix(dense[: spare + 1 - len(rare)] + U64(1)))
            continue
        classes = 1 << (b - 5)
        of = (mix(dense + U64(3)) & U64(classes - 1)).astype(np.int64)
        # tokens after the first of their class each add one to what the prefix must reach
        first = np.zeros(len(dense), dtype=bool)
        first[np.unique(of, return_index=True)[1]] = True
        need = spare + 1 - len(rare)
        reach = int(np.searchsorted(np.cumsum(~first), need)) + 1
        tokens, of = dense[:reach], of[:reach]
        order = np.argsort(of, kind="stable")
        tokens, of = tokens[order], of[order]
        gap = 1
        while gap < len(tokens):
            same = of[gap:] == of[:-gap]
            if not same.any():
                break
            out.append(mix(tokens[:-gap][same] * U64(0x9E3779B97F4A7C15) + tokens[gap:][same] + U64(b)))
            gap += 1
    return np.unique(np.concatenate(out))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _gather(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    parts = [[b.column(n).to_numpy(zero_copy_only=False) for n in names] for b in batches if b.num_rows]
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64) for _ in names]


def _fits(small: np.ndarray, large: np.ndarray, percent: int) -> np.ndarray:
    return small * 100 >= large * percent


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id: documents linked when 100 * |intersection| >= percent * |union| of their n-word shingle sets.

    Copies (equal sets) become one class before anything is indexed. Signature buckets give each class one partner to verify; classes that this leaves in
    different components but in one bucket are all compared by the bound that parity bitmaps set on the overlap, and a forest of those it can't part is verified
    on their sets, again where links of the forest fail. So what leaves a bucket grows with its classes, not with its pairs, and no link between components is lost.
    Null and empty texts have 0 shingles and are alone; texts of under n words are one shingle; repeated rows each get a row; a null id is kept as null and
    counts as the largest; an empty table gives no rows; other columns are ignored. Sets are held by 64-bit hashes of words and shingles."""
    spark = df.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("own", F.coalesce("doc_id", F.xxhash64("text")))  # what sets are fetched by; rows without an id have their text's hash

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << SLOTS, dtype=np.int64)
        names = ["doc_id", "own", "n", "cls", "bits", "wide", "slice", "counts"]
        for batch in steps(batches):
            sets = shingle_sets(text_bytes(batch.column("text")), n)
            keys, maps = class_keys(sets), [bitmap(s) for s in sets]
            _, once = np.unique(keys, return_index=True)
            counters += np.bincount(np.concatenate([(sets[k] >> U64(64 - SLOTS)).astype(np.int64) for k in once]), minlength=1 << SLOTS)
            size = len(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("own"), pa.array([len(s) for s in sets], pa.int64()), pa.array(_signed(keys)), pa.array([narrow(s, r).tobytes() for s, r in zip(sets, maps)], pa.binary()), pa.array([r.tobytes() for r in maps], pa.binary()), pa.array(np.full(size, -1), pa.int32()), pa.nulls(size, pa.binary())], names=names
            )
        if counters.any():
            parts = [p.astype("<i4").tobytes() for p in np.split(counters, SLICES)]
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.binary()), pa.nulls(SLICES, pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=names)

    first = scratch.write(docs.mapInArrow(tidy(measure), "doc_id long, own long, n long, cls long, bits binary, wide binary, slice int, counts binary"), "measured")
    rows = first.filter("slice < 0").select("doc_id", "own", "n", "cls", "bits", "wide")

    def add_up(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = np.zeros((1 << SLOTS) // SLICES, dtype=np.int64)
        for blob in table.column("counts"):
            total += np.frombuffer(blob.as_py(), "<i4")
        return pa.table({"slice": [key[0].as_py()], "counts": [total.tobytes()]}, schema=pa.schema([("slice", pa.int32()), ("counts", pa.binary())]))

    summed = first.filter("slice >= 0").select("slice", "counts").groupBy("slice").applyInArrow(add_up, "slice int, counts binary").collect()
    counts = np.zeros(1 << SLOTS, dtype=np.int64)
    for r in summed:
        counts[r["slice"] * len(counts) // SLICES :][: len(counts) // SLICES] = np.frombuffer(r.counts, np.int64)
    frequent = counts > max(64, 4 * counts.mean())  # well above what chance puts into a counter
    shared = spark.sparkContext.broadcast(np.packbits(frequent))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.unpackbits(shared.value).astype(bool)
        done: set[int] = set()
        for batch in steps(batches):
            sets = shingle_sets(text_bytes(batch.column("text")), n)
            keys = class_keys(sets)
            sig, cls, size = [], [], []
            for k, s in zip(keys.tolist(), sets):
                if len(s) and k not in done:
                    if len(done) > 1_000_000:
                        done.clear()
                    done.add(k)
                    found = signatures(s, frequent, percent)
                    sig.append(found)
                    cls.append(np.full(len(found), k, dtype=np.uint64))
                    size.append(np.full(len(found), len(s), dtype=np.int32))
            if sig:
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(sig))), pa.array(_signed(np.concatenate(cls))), pa.array(np.concatenate(size))], names=["sig", "cls", "size"])

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, cls, size = _gather(batches, ["sig", "cls", "size"])
        if not len(sig):
            return
        order = np.lexsort((cls, size, sig))
        sig, cls, size = sig[order], cls[order], size[order].astype(np.int64)
        new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])))
        sig, cls, size = sig[new], cls[new], size[new]
        next_same = np.append(sig[1:] == sig[:-1], False)
        member = next_same | np.append(False, next_same[:-1])
        a = np.flatnonzero(next_same)
        a = a[_fits(size[a], size[a + 1], percent)]
        pairs, times = np.unique(np.stack([cls[a], cls[a + 1]], axis=1), axis=0, return_counts=True) if len(a) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
        for at in range(0, len(pairs), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(times[part]), pa.int64()), pa.array(pairs[part, 0]), pa.array(pairs[part, 1]), pa.array(times[part]), pa.nulls(len(times[part]), pa.list_(pa.int64()))], names=fields)
        keep = np.flatnonzero(member)
        keep = keep[np.argsort(cls[keep], kind="stable")]
        yield from _members(TaskContext.get().partitionId(), cls[keep], sig[keep])

    fields = ["part", "x", "y", "c", "sigs"]
    parts = partitions_for(spark)
    signed = scratch.write(docs.mapInArrow(tidy(index), "sig long, cls long, size int"), "signed")
    met = scratch.write(_dealt(signed, scratch).repartition(parts, "sig").mapInArrow(tidy(bucket), "part long, x long, y long, c long, sigs array<long>"), "met")
    scratch.drop("signed", "hot")
    tried = met.filter("part IS NULL").groupBy("x", "y").agg(F.sum("c").alias("c")).groupBy("y").agg(F.max_by("x", F.struct("c", "x")).alias("x"))
    tried = scratch.write(tried.select(F.col("x").alias("a"), F.col("y").alias("b")), "tried")
    classes = scratch.write(rows.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("own").alias("own"), F.any_value("n").alias("n"), F.any_value("bits").alias("bits"), F.any_value("wide").alias("wide")), "classes")
    near = scratch.write(_thinned(classes, tried, percent), "near").select("a", "b")
    links = _verified(docs, classes, near, n, percent, scratch, "first")
    roots = components(links, scratch, "first")
    # Every pair of a bucket is now refuted by bitmaps, in one component, or joined by a chain of provisional links. Those are verified; where some fail,
    # the classes that they held together are compared again without them, as one bucket, until no chain has an unverified link.
    members, failed, turn, most = met.filter("part IS NOT NULL").select("part", F.col("x").alias("cls"), "sigs"), None, 0, 1
    refuted = near.join(links, ["a", "b"], "left_anti")
    while True:
        facts = classes.select("cls", "n", "bits").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        tried = scratch.write(_compared(members, facts, failed, most, percent, parts).distinct(), f"tried-{turn}")
        if tried.isEmpty():
            break
        near = scratch.write(_thinned(classes, tried, percent), f"near-{turn}")
        now = near.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("apart", "a"))).filter(F.col("r") <= most).select("a", "b")
        now = scratch.write(now, f"now-{turn}")
        good = _verified(docs, classes, now, n, percent, scratch, f"turn-{turn}")
        groups = components(links.unionAll(tried), scratch, f"groups-{turn}").select(F.col("node").alias("cls"), F.col("root").alias("group"))
        links = scratch.write(links.unionAll(good), f"links-{turn}")
        roots = components(links, scratch, f"roots-{turn}")
        refuted = refuted.unionAll(tried.join(near, ["a", "b"], "left_anti")).unionAll(now.join(good, ["a", "b"], "left_anti"))
        refuted = scratch.write(refuted, f"refuted-{turn}")
        members, failed = _open_groups(groups, roots, refuted, scratch, f"open-{turn}")
        if members.isEmpty():
            break
        turn, most = turn + 1, most * 8
    named = classes.select("cls", "rep").join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "rep", F.coalesce("root", "cls").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    final = scratch.write(named.join(least, "root").select("cls", "component_id"), "named")
    scratch.keep("measured", "named")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "cls").join(final, "cls", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _members(part: int, cls: np.ndarray, sig: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(part, x, sigs): the signatures that each class of a part has there; `cls` is sorted."""
    edges = np.append(np.flatnonzero(np.append(True, cls[1:] != cls[:-1])), len(cls)) if len(cls) else np.zeros(1, np.int64)
    for at in range(0, len(edges) - 1, 20_000):
        own = edges[at : at + 20_001]
        size = len(own) - 1
        sigs = pa.ListArray.from_arrays(pa.array(own - own[0], pa.int32()), pa.array(sig[own[0] : own[-1]], pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(size, part)), pa.array(cls[own[:-1]]), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()), sigs], names=["part", "x", "y", "c", "sigs"])


def _cells(key: str, share: Column, shares: Column) -> Column:
    """The cells of a grid that a share of a hot key lies in: one with each share, so that two rows of a key meet whatever their shares are."""
    return F.transform(F.sequence(F.lit(0), shares - 1), lambda o: F.xxhash64(F.col(key), F.least(share, o), F.greatest(share, o)))


def _dealt(signed: DataFrame, scratch: Scratch) -> DataFrame:
    """(sig, cls, size) with every signature of over BLOCK rows replaced by cells of a grid, each with the classes of two of its shares, so that no bucket is
    larger and no two classes that share a signature are kept apart. The hot signatures are under 1 in BLOCK of the rows; Spark broadcasts their table only
    where its written size allows."""
    hot = signed.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).select("sig", F.ceil(F.col("n") / BLOCK).cast("int").alias("shares"))
    hot = scratch.write(hot, "hot")
    if hot.isEmpty():
        return signed
    share = F.pmod(F.xxhash64("cls"), "shares").cast("int")
    cells = F.when(F.col("shares").isNull(), F.array("sig")).otherwise(_cells("sig", share, F.col("shares")))
    return signed.join(hot, "sig", "left").select(F.explode(cells).alias("sig"), "cls", "size")


def _open_groups(groups: DataFrame, roots: DataFrame, refuted: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Members (part, cls, sigs) and refuted pairs (part, a, b) of the groups that verified links leave in several components.

    A group of over BLOCK classes is dealt by hash to a grid of cells, each with the classes of two of its shares, so that no task holds more."""
    known = groups.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    mixed = known.groupBy("group").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("n")).filter("x <> y")
    mixed = mixed.select("group", F.ceil(F.col("n") / BLOCK).cast("int").alias("shares"))
    own = known.join(mixed, "group").select("cls", "group", "shares", F.pmod(F.xxhash64("cls"), "shares").cast("int").alias("share"))
    own = scratch.write(own, name)

    every, one = _cells("group", F.col("share"), F.col("shares")), F.xxhash64("group", F.least("share", "other"), F.greatest("share", "other"))
    members = own.select(F.explode(every).alias("part"), "cls").select("part", "cls", F.array("part").alias("sigs"))
    pairs = refuted.join(own.withColumnRenamed("cls", "a"), "a").join(own.select(F.col("cls").alias("b"), F.col("share").alias("other"), F.col("group").alias("its")), "b").filter("group = its")
    return members, pairs.select("a", "b", F.explode(F.when(F.col("share") == F.col("other"), every).otherwise(F.array(one))).alias("part"))


def _compared(members: DataFrame, facts: DataFrame, failed: DataFrame | None, most: int, percent: int, parts: int) -> DataFrame:
    """Compares the classes of each signature by bitmaps: pairs (a, b), provisional links between components.

    A part keeps one forest over its components, so its links are fewer than its classes, however many pairs a bucket has (`most` a class beyond the first
    round, whose groups hold refuted links). A class travels once to each part it has signatures in. `failed` pairs are no links."""
    rows = members.join(facts, "cls").select("part", "cls", "sigs", "n", "bits", "root")
    if failed is not None:
        rows = rows.unionAll(failed.select("part", F.col("a").alias("cls"), F.lit(None).cast("array<long>").alias("sigs"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("bits"), F.col("b").alias("root")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        known = table.filter(pc.is_valid(table.column("sigs"))).combine_chunks()
        if not known.num_rows:
            return
        lost = table.filter(pc.is_null(table.column("sigs")))
        refuted = _pair_keys(lost.column("cls").to_numpy(), lost.column("root").to_numpy())
        lists = known.column("sigs").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        cls, first, who = np.unique(known.column("cls").to_numpy(), return_index=True, return_inverse=True)
        size, root = known.column("n").to_numpy()[first], known.column("root").to_numpy()[first]
        bits = known.column("bits").take(pa.array(first)).to_pylist()
        sig, who = lists.flatten().to_numpy(), np.repeat(who, lengths)
        order = np.lexsort((who, size[who], sig))
        sig, who = sig[order], who[order]
        names, label = np.unique(root, return_inverse=True)
        label, parent, started = label.copy(), np.arange(len(names)), label
        new = np.append(True, sig[1:] != sig[:-1])
        bucket_of = np.cumsum(new) - 1
        mixed = np.bincount(bucket_of, label[who] != label[who[new]][bucket_of]) > 0  # the others are in one component already
        keep = mixed[bucket_of]
        sig, who = sig[keep], who[keep]
        words = np.fromiter(map(len, bits), dtype=np.int64, count=len(bits)) // 8
        # bitmaps by length; one also stands, folded, among those of half its length, for the shorter sets it may meet
        place, maps = {}, {}
        for w in np.unique(words).tolist():
            same, longer = np.flatnonzero(words == w), np.flatnonzero(words == 2 * w)
            place[w] = np.full(len(bits), -1, dtype=np.int32)
            place[w][same], place[w][longer] = np.arange(len(same)), len(same) + np.arange(len(longer))
            far = np.frombuffer(b"".join([bits[i] for i in longer]), np.uint64).reshape(-1, 2, w)
            maps[w] = np.concatenate([np.frombuffer(b"".join([bits[i] for i in same]), np.uint64).reshape(-1, w), far[:, 0] ^ far[:, 1]])
        del bits, known, table, held

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        found: list[tuple[int, int]] = []
        degree = np.zeros(len(cls), dtype=np.int64)
        k, gap = np.arange(len(sig)), 1
        while len(k):  # rows of a bucket stand by size, so a row is done at the first one that is too large or in the next bucket
            k = k[k + gap < len(sig)]
            k = k[(sig[k] == sig[k + gap]) & _fits(size[who[k]], size[who[k + gap]], percent)]
            i, j = who[k], who[k + gap]
            apart = label[i] != label[j]
            if most > 1:
                apart |= (started[i] != started[j]) & (degree[j] < most - 1)
            i, j = i[apart], j[apart]
            joined = False
            for w in maps:
                own = np.flatnonzero(words[i] == w)
                for at in range(0, len(own), 50_000):
                    x, y = i[own[at : at + 50_000]], j[own[at : at + 50_000]]
                    differ = np.bitwise_count(maps[w][place[w][x]] ^ maps[w][place[w][y]]).sum(axis=1, dtype=np.int64)
                    good = within(differ, size[x] + size[y], percent) | (place[w][y] < 0)  # lengths further apart are left to the exact check
                    good[good] = ~np.isin(_pair_keys(cls[x[good]], cls[y[good]]), refuted)
                    for p, q in zip(x[good].tolist(), y[good].tolist()):
                        rp, rq = top(started[p]), top(started[q])
                        if rp != rq or degree[q] < most - 1:
                            parent[max(rp, rq)] = min(rp, rq)
                            found.append((p, q))
                            degree[q] += 1
                            joined = True
            if joined:
                label = _tops(parent)[started]
            gap += 1
        if not found:
            return
        pairs = np.unique(np.array(found), axis=0)
        for at in range(0, len(pairs), 50_000):
            x, y = cls[pairs[at : at + 50_000, 0]], cls[pairs[at : at + 50_000, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return rows.repartition(parts, "part").mapInArrow(tidy(compare), "a long, b long")


def _tops(parent: np.ndarray) -> np.ndarray:
    while (parent[parent] != parent).any():
        parent = parent[parent]
    return parent


def _pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a.view(np.uint64)) + b.view(np.uint64))


def _thinned(classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b, apart): the pairs whose wide bitmaps leave room for a link, with the share of their sizes in which these differ."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sizes, differ = batch.column("n").to_numpy(), np.zeros(batch.num_rows, dtype=np.int64)
                for k, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    words = min(len(x), len(y))
                    differ[k] = np.bitwise_count(fold(x, words) ^ fold(y, words)).sum(dtype=np.int64)
                out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(differ / np.maximum(sizes, 1))], names=["a", "b", "apart"])
                yield out.filter(pa.array(within(differ, sizes, percent)))

    x = classes.select(F.col("cls").alias("a"), F.col("n").alias("nx"), F.col("wide").alias("x"))
    y = classes.select(F.col("cls").alias("b"), F.col("n").alias("ny"), F.col("wide").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", (F.col("nx") + F.col("ny")).alias("n"), "x", "y").mapInArrow(tidy(thin), "a long, b long, apart double")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, n: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) of class keys whose sets reach the threshold. A set travels once for each pair it is the second of."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes.select("cls", "own"), "cls")
    wanted = scratch.write(wanted.select("cls", "own"), f"{name}-wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            sets = shingle_sets(text_bytes(batch.column("text")), n)
            keys = class_keys(sets)
            same = _signed(keys) == batch.column("cls").to_numpy()  # an id may stand on rows with other texts
            yield pa.RecordBatch.from_arrays([pa.array(_signed(keys)[same]), pa.array([s.tobytes() for s, k in zip(sets, same) if k], pa.binary())], names=["cls", "items"])

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        good = []
        if left.num_rows and right.num_rows:
            x = np.frombuffer(left.column("items")[0].as_py(), np.uint64)
            for b, y in zip(right.column("b").to_pylist(), right.column("other")):
                y = np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    good.append((left.column("cls")[0].as_py(), b))
        return pa.table([pa.array([g[k] for g in good], pa.int64()) for k in (0, 1)], names=["a", "b"])

    sets = scratch.write(docs.join(wanted, "own").mapInArrow(tidy(make), "cls long, items binary").dropDuplicates(["cls"]), f"{name}-sets")
    # the second class of a pair travels to the first; a first class with very many partners is parted by hash
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS))
    second = pairs.select("a", "b").join(sets.select(F.col("cls").alias("b"), F.col("items").alias("other")), "b").select(F.col("a").alias("first"), salt.alias("part"), "b", "other")
    used = pairs.select(F.col("a").alias("cls"), salt.alias("salt")).distinct().join(sets, "cls")
    found = used.groupBy("cls", "salt").cogroup(second.groupBy("first", "part")).applyInArrow(check, "a long, b long")
    out = scratch.write(found, f"{name}-links")
    scratch.drop(f"{name}-sets", f"{name}-wanted")
    return out
