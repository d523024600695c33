"""Removal of repeated passages by relative Lempel-Ziv factors against content-routed reference blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, n_grams, partitions_for, sliding, steps, text_bytes, tidy, word_hashes

ANCHOR = 8  # words of the run whose least hash names the block of a window
HOT = 1000  # texts with one anchor from which its windows are dealt one by one, each to a block of its own hash
ROOM = 100_000_000  # bytes of phrases that a task holds to meet their repeats before they are sent


def phrases(text: bytes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts a text's windows into phrases: stretches of windows that have one anchor (the least hash of their ANCHOR-word runs).

    Returns the start window of each phrase (and one past the last), its anchor, the hash of every window, and of every run.
    Equal windows have equal anchors."""
    words, _ = word_hashes([text])
    count = len(words) - window + 1
    if count < 1:
        return np.zeros(1, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    short = min(ANCHOR, window)
    runs = n_grams(words, short)[: len(words) - short + 1]
    anchor = sliding(runs, window - short + 1, np.minimum)
    edges = np.concatenate(([0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [count]))
    return edges, anchor[edges[:-1]], n_grams(words, window)[:count], runs


class _Local(dict):
    """The earliest holder of each phrase a task has met; phrases met again are repeats at once and never leave the task, so copies are no hot group."""

    def meet(self, anchor: int, blob: bytes, holder: tuple) -> tuple | None:
        """Files the phrase; the later of two holders, if there are two. A repeated row brings the same holder again, which is no second one."""
        key = (anchor, hashlib.blake2b(blob, digest_size=12).digest())
        old = self.get(key)
        if old is None:
            self[key] = (*holder, blob)
            return None
        if old[:4] == holder:
            return None
        if old[:2] <= holder[:2]:
            return holder
        self[key] = (*holder, blob)
        return old


def factors(own: np.ndarray, first: int, source: np.ndarray, reference: np.ndarray, stops: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy relative Lempel-Ziv parse of one phrase, in windows: (start, length, place in the reference) of each factor; windows without a source are literals.

    `own` are the phrase's windows, which stand at `first` in the block's `reference`; source[i] is the earliest place there of window i, stops[i] where the phrase
    of that place ends. A factor takes its source's windows as long as they go on alike. The window after it spans its border, and is looked up anew, so a
    passage that two factors make up together is whole."""
    out, late = [], np.flatnonzero(source != first + np.arange(len(own)))
    at = 0
    while True:
        at += int(np.searchsorted(late[at:], out[-1][0] + out[-1][1])) if out else 0
        if at >= len(late):
            return out
        i = int(late[at])
        j = int(source[i])
        room = min(len(own) - i, int(stops[i]) - j)
        differ = own[i : i + room] != reference[j : j + room]
        out.append((i, int(differ.argmax()) if differ.any() else room, j))


def remove_repeats(df: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """df's columns with n_words, n_removed, kept_sha256 (and the kept text): words of a window whose word sequence starts earlier are removed.

    Earlier is a smaller id, or the same document and an earlier start; windows are judged on the input. Words are runs without ASCII white space.
    1. Each distinct text is judged once, as the row with its smallest id; other rows of it repeat it wholly.
    2. Anchors met in one place alone are dropped by a count; they can't belong to a repeated window.
    3. The phrases of the other anchors go to the reference block of their anchor, which so holds every earlier phrase a window could repeat. The block's
       index gives each window's earliest place; phrases are parsed greedily against it, and factors, which are a window long at least, are the spans to
       remove. Windows of an anchor that over HOT texts share go to blocks by their own hash.
    Null and empty texts have no words. Rows with one id and one text are judged alike; with one id and other texts, only by start. Null ids come first.
    An empty table gives no rows. Words are compared by 64-bit hashes, windows by two of these (a window's own and
    its anchor's)."""
    spark = df.sparkSession
    scratch, parts = Scratch(spark, "repeats"), partitions_for(spark)
    names = [c for c in df.columns if c not in ("n_words", "n_removed", "kept_sha256")]
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text")).withColumn("_key", F.xxhash64("_text"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in steps(batches, "_text"):
            a, key, many = [], [], []
            for k, text in zip(batch.column("_key").to_pylist(), text_bytes(batch.column("_text"))):
                if k in done:
                    continue
                if len(done) > 1_000_000:
                    done.clear()
                done.add(k)
                _, anchor, _, runs = phrases(text, window)
                if len(anchor):
                    once, runs = np.unique(anchor), np.sort(runs)
                    a.append(once)
                    key.append(np.full(len(once), k, dtype=np.int64))
                    many.append(np.searchsorted(runs, once, "right") - np.searchsorted(runs, once) > 1)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(key)), pa.array(np.concatenate(many))], names=["a", "key", "many"])

    met = scratch.write(rows.select("_key", "_text").mapInArrow(tidy(anchors), "a long, key long, many boolean"), "anchors")
    again = met.groupBy("a").agg(F.min("key").alias("x"), F.max("key").alias("y"), F.max("many").alias("many"), F.count(F.lit(1)).alias("n")).filter("x <> y OR many")
    kept = met.join(again.select("a", (F.col("n") > HOT).alias("hot")), "a").groupBy("key").agg(F.collect_set("a").alias("wanted"), F.collect_set(F.when(F.col("hot"), F.col("a"))).alias("hot"))
    first = rows.groupBy("_key").agg(F.min("_id").alias("rep"))  # one row a text from each task
    wanted = scratch.write(kept.join(first.withColumnRenamed("_key", "key"), "key").select("key", "rep", "wanted", "hot"), "wanted")
    scratch.drop("anchors")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, room = _Local(), 0
        fields = ["kind", "block", "a", "key", "rep", "start", "stop", "windows"]

        def pack(items: list[tuple]) -> pa.RecordBatch:
            types = [pa.int32(), *[pa.int64()] * 6, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([i[k] for i in items], t) for k, t in enumerate(types)], names=fields)

        def flush() -> Iterator[pa.RecordBatch]:
            items = [(0, v[3], k[0], v[2], v[0], v[1], v[1] + len(v[4]) // 8, v[4]) for k, v in local.items()]
            local.clear()
            for at in range(0, len(items), 20_000):
                yield pack(items[at : at + 20_000])

        for batch in steps(batches, "_text"):
            spans = []
            for key, rep, text, want, hot in zip(batch.column("_key").to_pylist(), batch.column("rep").to_pylist(), text_bytes(batch.column("_text")), batch.column("wanted").to_pylist(), batch.column("hot").to_pylist()):
                edges, anchor, windows, _ = phrases(text, window)
                signed, common = anchor.view(np.int64), set(hot)
                for p in np.flatnonzero(np.isin(signed, np.array(want, dtype=np.int64))).tolist():
                    a, first, last = int(signed[p]), int(edges[p]), int(edges[p + 1])
                    for start, stop in [(k, k + 1) for k in range(first, last)] if a in common else [(first, last)]:
                        blob = windows[start:stop].tobytes()
                        late = local.meet(a, blob, (rep, start, key, int(windows[start].view(np.int64)) if a in common else a))
                        room += len(blob) + 250
                        if late is not None:
                            spans.append((1, 0, 0, late[2], late[0], late[1], late[1] + len(blob) // 8, b""))
            if spans:
                yield pack(spans)
            if room > ROOM:
                yield from flush()
                room = 0
        yield from flush()

    holders = rows.join(wanted.select(F.col("rep").alias("_id"), F.col("key").alias("_key"), "rep", "wanted", "hot").hint("shuffle_hash"), ["_id", "_key"])
    holders = holders.select("_key", "rep", "_text", "wanted", "hot")
    routed = scratch.write(holders.mapInArrow(tidy(route), "kind int, block long, a long, key long, rep long, start long, stop long, windows binary"), "routed")

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        key, rep, start, anchor = (table.column(c).to_numpy() for c in ("key", "rep", "start", "a"))
        blobs = table.column("windows").combine_chunks()
        blobs = blobs.chunk(0) if isinstance(blobs, pa.ChunkedArray) else blobs
        windows = np.frombuffer(b"".join(b.as_buffer() for b in blobs), np.uint64)
        sizes = pc.binary_length(blobs).to_numpy().astype(np.int64) // 8
        del held, table, blobs
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(windows)) - np.repeat(ends - sizes, sizes) + start[owner]
        order = np.lexsort((place, rep[owner], anchor[owner], windows))  # the block's index: windows by hash and anchor, the earliest place first
        h, a = windows[order], anchor[owner[order]]
        head = np.concatenate(([True], (h[1:] != h[:-1]) | (a[1:] != a[:-1])))
        lead = order[np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))]
        same = (rep[owner[order]] == rep[owner[lead]]) & (place[order] == place[lead])  # a place that stands twice is no source of itself
        source = np.empty(len(order), dtype=np.int64)
        source[order] = np.where(same, order, lead)
        del order, head, lead, same, h, a
        some = np.flatnonzero(np.bincount(owner, source != np.arange(len(source)), len(sizes)) > 0)
        out = []
        for i in some.tolist():
            first, last = int(ends[i] - sizes[i]), int(ends[i])
            for f, n, _ in factors(windows[first:last], first, source[first:last], windows, ends[owner[source[first:last]]]):
                out.append((int(key[i]), int(rep[i]), int(start[i]) + f, int(start[i]) + f + n))
        for k in range(0, len(out), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out[k : k + 50_000]], pa.int64()) for c in range(4)], names=["key", "rep", "start", "stop"])

    found = routed.filter("kind = 0").select("key", "rep", "block", "a", "start", "windows").repartition(parts, "block").drop("block").mapInArrow(tidy(factor), "key long, rep long, start long, stop long")
    spans = found.unionByName(routed.filter("kind = 1").select("key", "rep", "start", "stop")).groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    judged = first.select(F.col("_key").alias("key"), "rep").join(spans, "key", "left")
    judged = scratch.write(judged, "judged")
    scratch.drop("routed", "wanted")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "_text"):
            n_words, n_removed, digest, texts = [], [], [], []
            for i, rep, text, spans in zip(batch.column("_id").to_pylist(), batch.column("rep").to_pylist(), text_bytes(batch.column("_text")), batch.column("spans").to_pylist()):
                words = text.split()
                n_words.append(len(words))
                if i != rep and len(words) >= window:
                    words = []
                elif spans and i == rep:
                    gone = bytearray(len(words))
                    for s in spans:
                        a, b = s["start"], s["stop"] - 1 + window
                        gone[a:b] = b"\x01" * (b - a)
                    words = [w for w, g in zip(words, gone) if not g]
                n_removed.append(n_words[-1] - len(words))
                whole = b" ".join(words)
                digest.append(hashlib.sha256(whole).hexdigest())
                if with_text:
                    texts.append(text if not n_removed[-1] else whole)
            own = batch.column("row").flatten()
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if with_text and c == text_col else own[k] for k, c in enumerate(kept_names)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest)], names=[*kept_names, "n_words", "n_removed", "kept_sha256"])

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    kept_names = names if with_text else [c for c in names if c != text_col]
    source = df.select(F.struct(*kept_names).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text")).withColumn("_key", F.xxhash64("_text"))
    joined = source.join(judged.withColumnRenamed("key", "_key").hint("shuffle_hash"), "_key", "left").drop("_key")
    schema = StructType([f for f in df.schema.fields if f.name in kept_names] + [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())])
    return joined.mapInArrow(tidy(keep), schema)


def digest_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row, as `remove_repeats` says; null texts have no words, repeated rows are judged alike."""
    return remove_repeats(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")
