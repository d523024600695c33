"""Language-model scoring by a hashed maximum-entropy model with class-factored softmax, under word n-gram and skip counts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, mix, steps, text_bytes, tidy, word_hashes

HEAD = 65_536  # words the softmax models one by one; all others share a class, whose members go by their exact counts
CLUSTERS, BINS = 8, 15
CLASSES = 128  # of which CLUSTERS * BINS hold head words; then the rare words', then the end's
RARE, END_CLASS = CLUSTERS * BINS, CLUSTERS * BINS + 1
NEAR, SKIP, GROUPS = 1024, 32, 64  # feature buckets: previous word, word before it, group of the previous word for the in-class softmax
SLICES = 64
FOLD = 7
PLACES = 18  # log2 of the slots that look up head words
CHUNK_BYTES = 3_000_000  # text that is looked up in the n-gram table at a time
KEY_BITS, KINDS = 48, 4  # bits of an n-gram's hash; its last two tell its kind: pair, skip pair, word, context of skip pairs
SLICE_TOKENS = 1_000_000  # tokens to a slice of the n-gram table
BACK_OFF = 4.0  # tokens of the class model that every context is given
END = mix(np.array([2**63 + 1], dtype=np.uint64))[0]


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLD == 2


class Structure:
    """Head words with their classes and feature buckets; of a fixed size."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, clusters: np.ndarray):
        n = len(hashes)
        self.counts = counts
        self.rank = np.argsort(hashes.view(np.uint64))
        self.sorted = hashes.view(np.uint64)[self.rank]
        self.first = np.searchsorted(self.sorted >> U64(64 - PLACES), np.arange(1 << PLACES, dtype=np.uint64))
        self.longest = int(np.bincount((self.sorted >> U64(64 - PLACES)).astype(np.int64)).max()) if n else 0
        self.end = int(self.place(np.array([END]))[0])
        bins = np.zeros(n, np.int64)
        for k in range(CLUSTERS):
            own = np.flatnonzero(clusters == k)  # by falling count
            mass = np.cumsum(np.sqrt(counts[own]))
            bins[own] = np.minimum((mass - np.sqrt(counts[own])) / max(mass[-1] if len(own) else 1, 1e-9) * BINS, BINS - 1).astype(np.int64)
        classes = clusters * BINS + bins
        if self.end < n:
            classes[self.end] = END_CLASS
        self.classes = np.append(classes, RARE)  # the last entry stands for every rare word
        at = np.arange(n + 1)
        fixed = NEAR - CLASSES
        self.near = np.where(at < min(fixed, n), at, fixed + self.classes)
        coarse = np.where(self.classes < RARE, self.classes // BINS * (SKIP // CLUSTERS) + self.classes % BINS * (SKIP // CLUSTERS - 1) // BINS, SKIP - 1)
        self.skip = coarse
        self.group = np.where(self.classes < RARE, self.classes // BINS * 7 + self.classes % BINS * 7 // BINS, 56 + self.classes - RARE)
        self.order = np.argsort(self.classes[:-1], kind="stable")  # head words class by class, for segment sums
        self.bounds = np.concatenate(([0], np.cumsum(np.bincount(self.classes[:-1], minlength=CLASSES))))


    def place(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash among the head words, else their number."""
        out, at = np.full(len(h), len(self.sorted), dtype=np.int64), self.first[(h >> U64(64 - PLACES)).astype(np.int64)]
        for k in range(self.longest):
            there = np.minimum(at + k, len(self.sorted) - 1)
            hit = np.flatnonzero(self.sorted[there] == h)
            out[hit] = self.rank[there[hit]]
        return out


def _tokens(shared, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, head places with rare ones as the last place, and the number of tokens of each text."""
    words, counts = word_hashes(texts, lower=True)
    raw = np.insert(words, np.cumsum(counts), END)
    return raw, shared.value.place(raw), counts + 1


def _contexts(s: Structure, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The previous word and the one before it; a text begins after two ends."""
    return _before(ids, lengths, s.end if s.end < len(s.counts) else len(s.counts))


def _before(ids: np.ndarray, lengths: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    first = np.cumsum(lengths) - lengths
    one, two = np.roll(ids, 1), np.roll(ids, 2)
    one[first] = two[first] = end
    two[(first + 1)[lengths > 1]] = end
    return one, two


def _summed(rows: DataFrame) -> DataFrame:
    """Adds up (which, slice, blob) arrays of 32-bit counts, a group to a task; arrays have a fixed length."""

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = None
        for blob in table.column("blob"):
            part = np.frombuffer(zlib.decompress(blob.as_py()), np.int64)
            total = part.copy() if total is None else total + part
        return pa.table([[key[0].as_py()], [key[1].as_py()], [zlib.compress(total.tobytes(), 1)]], schema=pa.schema([("which", pa.int32()), ("slice", pa.int32()), ("blob", pa.binary())]))

    return rows.groupBy("which", "slice").applyInArrow(add, "which int, slice int, blob binary")


def _blobs(which: int, counts: np.ndarray, slices: int) -> pa.RecordBatch:
    parts = [(k, zlib.compress(p.astype(np.int64).tobytes(), 1)) for k, p in enumerate(np.split(counts, slices)) if p.any()]
    return pa.RecordBatch.from_arrays([pa.array([which] * len(parts), pa.int32()), pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], names=["which", "slice", "blob"])


def _keys(raw: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The n-gram table's keys of each token, a kind after another."""
    one, two = _before(raw, lengths, END)
    kinds = (mix(one + U64(1)) + raw, mix(two + U64(2)) + raw, raw + U64(3), two + U64(4))
    return np.concatenate([mix(k) >> U64(64 - KEY_BITS) & ~U64(KINDS - 1) | U64(i) for i, k in enumerate(kinds)])


def _packed(x: np.ndarray, noise: bool = False) -> bytes:
    """Unsigned numbers in the fewest bytes that hold them all, which the first byte tells; bytes of one weight stand together, the highest first. Of `noise`
    only the highest are compressed."""
    size = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T[::-1])
    dense = 1 if noise else size
    return bytes([size]) + zlib.compress(planes[:dense], 1) + planes[dense:].tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    size, stream = blob[0], zlib.decompressobj()
    planes = np.frombuffer(stream.decompress(blob[1:]) + stream.unused_data, np.uint8).reshape(size, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :size] = planes[::-1].T
    return out.view("<u8").reshape(-1)


def _chunks(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of some documents each; their texts are held compressed."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 33
        for k, batch in enumerate(steps(batches, limit=CHUNK_BYTES)):
            texts = text_bytes(batch.column("text"))
            blob = pa.compress(b"".join(texts), codec="zstd", asbytes=True)
            columns = [[part + k], [batch.column("doc_id").to_pylist()], [batch.column("held_out").to_pylist()], [[len(t) for t in texts]], [blob]]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["chunk", "doc_id", "held_out", "sizes", "texts"])

    return scratch.write(docs.mapInArrow(tidy(cut), "chunk long, doc_id array<long>, held_out array<boolean>, sizes array<long>, texts binary"), "chunks")


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def _texts(sizes: list[int], blob: bytes) -> list[bytes]:
    whole, ends = pa.decompress(blob, decompressed_size=sum(sizes), codec="zstd", asbytes=True) if sum(sizes) else b"", np.cumsum(sizes)
    return [whole[e - n : e] for e, n in zip(ends.tolist(), sizes)]


def n_grams_met(chunks: DataFrame, total: int) -> DataFrame:
    """(chunk, slice, counts, pairs, skips): for the sorted keys of each chunk, slice by slice, their counts over all training tokens. Rows of chunk -1
    have the number of a slice's pairs and skip pairs that occur once. The table's slices grow in number with the input; none is broadcast or collected."""
    bits = KEY_BITS - max(8, (total // SLICE_TOKENS).bit_length())

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                words, counts = word_hashes(_texts(row["sizes"], row["texts"]), lower=True)
                keys = _keys(np.insert(words, np.cumsum(counts), END), counts + 1)
                learnt = np.tile(np.repeat(~np.array(row["held_out"]), counts + 1), KINDS)
                once, at = np.unique(keys, return_inverse=True)
                times = np.bincount(at, learnt, minlength=len(once)).astype(np.int64)
                new = np.flatnonzero(np.diff((once >> U64(bits)).astype(np.int64), prepend=-1))
                slices = (once[new] >> U64(bits)).astype(np.int32)
                gaps = np.diff(once, prepend=U64(0))
                gaps[new] = once[new] & U64((1 << bits) - 1)
                keys, times = ([_packed(p, noise) for p in np.split(x, new[1:])] for x, noise in ((gaps, True), (times, False)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(new), row["chunk"])), pa.array(slices), pa.array(keys, pa.binary()), pa.array(times, pa.binary())], names=["chunk", "slice", "keys", "times"])

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys = [np.cumsum(_unpacked(k), dtype=np.uint64) for k in table.column("keys").to_pylist()]
        once, at = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(at, np.concatenate([_unpacked(t) for t in table.column("times").to_pylist()])).astype(np.int64)
        single = np.bincount((once[counts == 1] & U64(KINDS - 1)).astype(np.int64), minlength=KINDS)
        own = [_packed(c) for c in np.split(counts[at], np.cumsum([len(k) for k in keys])[:-1])]
        n = len(own)
        columns = [[*table.column("chunk").to_pylist(), -1], [key[0].as_py()] * (n + 1), [*own, b""], [0] * n + [int(single[0])], [0] * n + [int(single[1])]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()))], names=["chunk", "slice", "counts", "pairs", "skips"])

    met = chunks.mapInArrow(tidy(gather), "chunk long, slice int, keys binary, times binary")
    return met.groupBy("slice").applyInArrow(add, "chunk long, slice int, counts binary, pairs long, skips long")


def _backed(pair: np.ndarray, context: np.ndarray, rarely: float, lower: np.ndarray) -> np.ndarray:
    """Probabilities by counts over those of a lower order, which get `rarely` to 1 of a context's tokens (Good and Turing's share of the unseen) and BACK_OFF."""
    own = BACK_OFF + rarely * context
    return (pair + own * lower) / (context + own)


def _clusters(docs: DataFrame, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """k-means of head words by the common words before them, counted over all of `docs`."""
    spark, contexts = docs.sparkSession, 64
    structure = Structure(hashes, counts, np.zeros(len(hashes), np.int64))
    shared = spark.sparkContext.broadcast(structure)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(shared.value.counts)
        total = np.zeros(HEAD * contexts, np.int64)
        for batch in steps(batches):
            _, ids, lengths = _tokens(shared, text_bytes(batch.column("text")))
            one, _ = _contexts(shared.value, ids, lengths)
            good = (one < min(contexts, n)) & (ids < n)
            total += np.bincount(ids[good] * contexts + one[good], minlength=len(total))
        if total.any():
            yield _blobs(0, total, 16)

    x = np.zeros((HEAD, contexts))
    for r in _summed(docs.mapInArrow(tidy(count), "which int, slice int, blob binary")).collect():
        x.reshape(16, -1)[r["slice"]] = np.frombuffer(zlib.decompress(r.blob), np.int64)
    x = np.sqrt(x[: len(hashes)])
    norm = np.linalg.norm(x, axis=1)
    x /= np.maximum(norm, 1e-9)[:, None]
    weight = np.where(norm > 0, np.sqrt(counts), 0)
    chosen = [0]
    for _ in range(CLUSTERS - 1):  # far apart and frequent
        nearest = np.max(x @ x[chosen].T, axis=1)
        chosen.append(int(np.argmax((1 - nearest) * weight)))
    centre = x[chosen]
    for _ in range(12):
        at = np.argmax(x @ centre.T, axis=1)
        for k in range(CLUSTERS):
            m = (x[at == k] * weight[at == k][:, None]).sum(axis=0)
            if m.any():
                centre[k] = m / np.linalg.norm(m)
    return at


def _log_softmax(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=-1, keepdims=True)
    return x - top - np.log(np.exp(x - top).sum(axis=-1, keepdims=True))


class Model:
    """Natural-log probabilities by context: of classes (NEAR * SKIP x CLASSES) and of head words in their class (GROUPS x words)."""

    def __init__(self, by_class: np.ndarray, in_class: np.ndarray):
        self.by_class, self.in_class = by_class.astype(np.float32), in_class.astype(np.float32)


def train(docs: DataFrame, scratch: Scratch, s: Structure, rounds: int = 10, prior: float = 1.0) -> Model:
    """Feature counts are gathered over all of `docs` once; each round's gradient is summed over the slices of that table by a Spark job.

    Class softmax: bias + previous-word feature + skip feature. In-class softmax: word bias + (previous word's group, word) feature. Both with a Gaussian
    prior; steps are scaled by the gradient's diagonal curvature."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(s)
    n = len(s.counts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        classes, words = np.zeros(NEAR * SKIP * CLASSES, np.int32), np.zeros(GROUPS * HEAD, np.int32)
        for batch in steps(batches):
            _, ids, lengths = _tokens(shared, text_bytes(batch.column("text")))
            one, two = _contexts(s, ids, lengths)
            at, times = np.unique((s.near[one] * SKIP + s.skip[two]) * CLASSES + s.classes[ids], return_counts=True)
            classes[at] += times.astype(np.int32)
            head = ids < n
            at, times = np.unique(s.group[one[head]] * HEAD + ids[head], return_counts=True)
            words[at] += times.astype(np.int32)
        if classes.any():
            yield _blobs(0, classes, SLICES)
            yield _blobs(1, words, SLICES)

    table = scratch.write(_summed(docs.mapInArrow(tidy(count), "which int, slice int, blob binary")), "features")
    near_rows = NEAR // SLICES
    bias, near, skip = np.zeros(CLASSES), np.zeros((NEAR, CLASSES)), np.zeros((SKIP, CLASSES))
    for step in range(rounds + 1):
        params = spark.sparkContext.broadcast((bias, near, skip))

        def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bias, near, skip = params.value
            for batch in batches:
                for k, blob in zip(batch.column("slice").to_pylist(), batch.column("blob").to_pylist()):
                    seen = np.frombuffer(zlib.decompress(blob), np.int64).reshape(near_rows, SKIP, CLASSES)
                    own = near[k * near_rows : (k + 1) * near_rows]
                    p = np.exp(_log_softmax(bias + own[:, None, :] + skip[None, :, :])) * seen.sum(axis=2, keepdims=True)
                    out = np.concatenate([a.reshape(-1) for a in (seen.sum(axis=1), p.sum(axis=1), seen.sum(axis=0), p.sum(axis=0))]).astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["slice", "g"])

        seen1, p1 = np.zeros((NEAR, CLASSES)), np.zeros((NEAR, CLASSES))
        seen2, p2 = np.zeros((SKIP, CLASSES)), np.zeros((SKIP, CLASSES))
        for r in table.filter("which = 0").mapInArrow(tidy(gradient), "slice int, g binary").collect():
            g, size = np.frombuffer(r.g), near_rows * CLASSES
            rows = slice(r["slice"] * near_rows, (r["slice"] + 1) * near_rows)
            seen1[rows], p1[rows] = g[:size].reshape(-1, CLASSES), g[size : 2 * size].reshape(-1, CLASSES)
            seen2 += g[2 * size : 2 * size + SKIP * CLASSES].reshape(SKIP, CLASSES)
            p2 += g[2 * size + SKIP * CLASSES :].reshape(SKIP, CLASSES)
        if step == 0:  # start from what the bias alone explains
            bias = np.log((seen2.sum(axis=0) + 0.5) / (seen2.sum() + 0.5 * CLASSES))
            share = np.exp(bias)
            near = np.log((seen1 + 4 * share) / (seen1.sum(axis=1, keepdims=True) + 4)) - bias
            continue
        near = near + 0.5 * np.clip((seen1 - p1 - prior * 0.1 * near) / (p1 + prior), -1, 1)
        skip = skip + 0.5 * np.clip((seen2 - p2 - prior * 0.1 * skip) / (p2 + prior), -1, 1)
    by_class = _log_softmax(bias + near[:, None, :] + skip[None, :, :]).reshape(NEAR * SKIP, CLASSES)

    group_rows = GROUPS // SLICES
    order, bounds, base = s.order, s.bounds, np.log(s.counts + 1.0)
    sizes = np.diff(bounds)
    starts = bounds[:-1][sizes > 0]

    def segment(x: np.ndarray, how) -> np.ndarray:
        return np.repeat(how.reduceat(x, starts), sizes[sizes > 0])

    def normal(line: np.ndarray) -> np.ndarray:
        e = line - segment(line, np.maximum)
        return e - np.log(segment(np.exp(e), np.add))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, blob in zip(batch.column("slice").to_pylist(), batch.column("blob").to_pylist()):
                seen = np.frombuffer(zlib.decompress(blob), np.int64).reshape(group_rows, HEAD)
                out = []
                for row in seen:
                    got, line0 = row[:n][order].astype(np.float64), base[order]
                    total, weight = segment(got, np.add), np.zeros(n)
                    for _ in range(8):
                        p = total * np.exp(normal(line0 + weight))
                        weight = weight + np.clip((got - p - 2.0 * weight) / (p + 2.0), -1, 1) * 0.8
                    done = np.empty(n)
                    done[order] = normal(line0 + weight)
                    out.append(done.astype(np.float32))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(np.array(out).tobytes(), 1)], pa.binary())], names=["slice", "g"])

    default = np.empty(n)
    default[order] = normal(base[order])
    in_class = np.tile(default.astype(np.float32), (GROUPS, 1))
    for r in table.filter("which = 1").mapInArrow(tidy(members), "slice int, g binary").collect():
        in_class[r["slice"] * group_rows : (r["slice"] + 1) * group_rows] = np.frombuffer(zlib.decompress(r.g), np.float32).reshape(group_rows, n)
    return Model(by_class, in_class)


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: log10 probabilities of whole texts under an add-one unigram base and the model.

    Learns from documents outside the held-out fold; counts, word contexts and feature counts cover all of them. Outcomes are the V training tokens (words, the end) and
    one for unknown words, as in the base, so both are proper distributions over the same outcomes. The model of classes
    and head words has a fixed size; over it stand the counts of all training word pairs, at a distance of one and of two, in a table that grows with the
    input and is joined by chunks of documents, as are the words' own counts. Neither is broadcast. Null and empty texts are one end token; repeated rows are scored each; a null id is trained on (its fold
    is unknown, held_out false); an empty table gives no rows; with nothing to train on the score is the base's. Words are told apart by 64-bit hashes."""
    spark = df.sparkSession
    scratch = Scratch(spark, "maxent")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"))
    learn = docs.filter(~F.col("held_out"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, times, held = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            once, at = np.unique(np.concatenate(words), return_inverse=True)
            return once, np.bincount(at, np.concatenate(times)).astype(np.int64)

        def sent(once: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(once), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(once[a : a + 100_000].view(np.int64)), pa.array(n[a : a + 100_000])], names=["h", "c"])

        for batch in steps(batches):
            texts = text_bytes(batch.column("text"))
            once, n = np.unique(word_hashes(texts, lower=True)[0], return_counts=True)
            words += [once, np.array([END])]
            times += [n, np.array([len(texts)])]
            held += len(once)
            if held > 2_000_000:
                once, n = merged()
                words, times, held = [once], [n], len(once)
                if held > 1_500_000:
                    yield from sent(once, n)
                    words, times, held = [], [], 0
        if words:
            yield from sent(*merged())

    counts = scratch.write(learn.select("text").mapInArrow(tidy(count), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    if not total:
        spread = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long") + 1
        return docs.select("doc_id", "held_out", spread.alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    top = counts.orderBy(F.desc("c"), "h").limit(HEAD).collect()
    hashes, head_counts = np.array([r.h for r in top], dtype=np.int64), np.array([r.c for r in top], dtype=np.int64)
    del top
    structure = Structure(hashes, head_counts, _clusters(learn, hashes, head_counts))
    model = train(learn, scratch, structure)
    scratch.drop("counts", "features")
    rest = float(total - head_counts.sum() + (distinct - len(hashes)) + 1)  # add-one mass of the words beyond the head and of the unknown one
    shared, fitted = spark.sparkContext.broadcast(structure), spark.sparkContext.broadcast(model)
    floor = np.log10(float(total + distinct + 1))

    chunks = _chunks(docs, scratch)
    met = scratch.write(n_grams_met(chunks, total), "met")
    once = met.filter("chunk < 0").agg(F.sum("pairs"), F.sum("skips")).first()
    rarely = [n / max(total - n, 1) for n in once]
    scratch.drop()
    met = met.filter("chunk >= 0").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("slice", "counts"))).alias("met"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, m = shared.value, fitted.value
        n = len(s.counts)
        for batch in batches:
            for row in _rows(batch):
                raw, ids, lengths = _tokens(shared, _texts(row["sizes"], row["texts"]))
                _, at = np.unique(_keys(raw, lengths), return_inverse=True)
                counts = np.concatenate([_unpacked(x["counts"]) for x in row["met"]])[at].astype(np.float64)
                pair, skip, word, far = np.split(counts, KINDS)
                near, _ = _before(word, lengths, word[lengths[0] - 1])  # a text ends and begins with the end
                one, two = _contexts(s, ids, lengths)
                first = np.cumsum(lengths) - lengths
                line = m.by_class[s.near[one] * SKIP + s.skip[two], s.classes[ids]].astype(np.float64)
                head = ids < n
                line[head] += m.in_class[s.group[one[head]], ids[head]]
                line[~head] += np.log((word[~head] + 1) / rest)
                p = _backed(pair, near, rarely[0], _backed(skip, far, rarely[1], np.exp(line)))
                base = np.log10(word + 1) - floor
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_id"], pa.int64()), pa.array(row["held_out"], pa.bool_()), pa.array(lengths.astype(np.int64)), pa.array(np.add.reduceat((word > 0).astype(np.int64), first)),
                        pa.array(np.full(len(lengths), int(total))), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(np.log10(p), first)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return chunks.join(met, "chunk").mapInArrow(tidy(score), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
