"""Shared plumbing of the training-data operators: written tables, tokens and hashes."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
MULT = U64(0x9E3779B97F4A7C15)
#: Bytes of text that one numpy step works on at a time; arrays of a step stay near ten times this.
STEP_BYTES = 2_000_000
#: As many for steps that look up distinct words.
WORD_STEP = 6_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else one beside the warehouse's tables."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    return found.rstrip("/") if found else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor then costs one task, not the chain before it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def keep(self, *names: str) -> None:
        """Deletes all tables but these."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        found = root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(root)
        self.drop(*[f.getPath().getName() for f in found if f.getPath().getName() not in names])

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads (or none), and lets Spark clear the shuffle files of ended jobs."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)
        jvm.System.gc()


def give_back(spark: SparkSession) -> None:
    """Executors collect garbage, a task to a core: a heap that an earlier step has filled shrinks, and its memory goes back to the system."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("reflect('java.lang.System', 'gc')")).collect()


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def tidy(work: Callable) -> Callable:
    """The same work on Arrow batches; memory it has freed goes back to the system at its end, not with the worker, which Spark keeps for later tasks."""

    def run(*batches):
        try:
            yield from work(*batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches by rows so that a step holds about `limit` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([0 if n is None else n for n in pc.binary_length(batch.column(text)).to_pylist()], dtype=np.int64)
        group = (np.cumsum(sizes) - sizes) // limit
        edges = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]))
        for a, b in zip(edges[:-1], edges[1:]):
            yield batch.slice(a, b - a)


class Words:
    """The runs without ASCII white space of a text column, as codes of the distinct ones; the empty run that stands at a border is one of them."""

    def __init__(self, column: pa.Array):
        lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        coded = lists.flatten().dictionary_encode()
        self.codes, self.bounds = coded.indices, lists.offsets.to_numpy() - lists.offsets[0].as_py()
        self.distinct: list[bytes] = coded.dictionary.cast(pa.binary()).to_pylist()

    def joined(self, values: list[bytes]) -> tuple[memoryview, np.ndarray]:
        """The distinct runs' values put in place of the runs: all texts' bytes one after another, and where each text begins and the last one ends."""
        out = pa.array(values, pa.large_binary()).take(self.codes)
        offsets = np.frombuffer(out.buffers()[1], np.int64)[: len(out) + 1]
        return memoryview(out.buffers()[2] or b""), offsets[self.bounds]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


VALUES = mix((np.arange(256, dtype=np.uint64) + U64(1)) * MULT)
LOWERED = VALUES.copy()
LOWERED[65:91] = VALUES[97:123]
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BLOCK = 1 << 18
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of MULT and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.multiply.accumulate(np.full(max(n, BLOCK), f, dtype=np.uint64)) for f in (MULT, U64(pow(int(MULT), -1, 1 << 64)))]
    return _POWERS


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without ASCII white space) of all texts, one after another, and the number of words of each text.

    A word's hash is a difference of two prefix sums of its block, moved to the word's start. Blocks end between words, so a word hashes alike anywhere."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    values = LOWERED if lower else VALUES
    hashes, starts, at = [], [], 0
    while at < len(data):
        to = min(at + BLOCK, len(data))
        while not SPACE[data[to - 1]]:
            gap = SPACE[data[to : to + BLOCK]]
            to += int(gap.argmax()) + 1 if gap.any() else len(gap)
        part = data[at:to]
        space = SPACE[part]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edges = np.concatenate(([0], edges))
        power, inverse = _powers(len(part))
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(values[part] * power[: len(part)], out=sums[1:])
        first, last = edges[0::2], edges[1::2]
        hashes.append(mix((sums[last] - sums[first]) * inverse[first]))
        starts.append(first + at)
        at = to
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64))
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), ends), prepend=0)


def n_grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n hashes; as long as the input, the last n - 1 entries are not runs."""
    out, have = words.copy(), 1
    result, done = None, 0
    while True:  # doubling: runs of 1, 2, 4... joined to runs of n
        if n & have:
            if result is None:
                result, done = out.copy(), have
            else:
                moved = np.zeros_like(out)
                moved[: max(len(out) - have, 0)] = result[have:]
                factor = _power(done)
                result, done = out * factor + moved, done + have
        if done == n:
            return mix(result)
        moved = np.zeros_like(out)
        moved[: max(len(out) - have, 0)] = out[have:]
        out, have = out * _power(have) + moved, have * 2


def _power(k: int) -> np.uint64:
    return U64(pow(int(MULT), k, 1 << 64))


def sliding(x: np.ndarray, n: int, take) -> np.ndarray:
    """take (np.minimum or np.maximum) over x[i : i + n]; result has len(x) - n + 1 entries."""
    out, have = x, 1
    while have * 2 <= n:
        out = take(out[: len(out) - have], out[have:])
        have *= 2
    rest = n - have
    return take(out[: len(out) - rest], out[rest:]) if rest else out


def row_key(id_col: str, text_col: str) -> F.Column:
    """Tells rows apart that share an id but not a text."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
