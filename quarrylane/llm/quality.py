"""Quality classifier: random Fourier features of document statistics, ridge by partition-summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch, steps, text_bytes, tidy

#: Labelled rows to fit on at most, the first in hash order.
SAMPLE = 40_000
PARTS = 16
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r", b".,;:", b"!?", b"|", b"&$#%*@^~=+<>\\/_", b"()[]{}'\"`-", b"aeiouAEIOU", bytes(range(128, 256)), bytes(range(32)) + b"\x7f"]
MEMBERS = np.array([[float(c in group) for group in _CLASSES] for c in range(256)])


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of statistics per whole text; finite for any text, the empty one included."""
    hist = np.array([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in texts], dtype=np.float64).reshape(len(texts), 256)
    n = hist.sum(axis=1)
    share = hist / np.maximum(n, 1)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.nansum(np.where(share > 0, share * np.log2(share), 0.0), axis=1)
    out = np.empty((len(texts), 10))
    for row, t in zip(out, texts):
        words, lines = t.split(), t.split(b"\n")
        seen, k = set(words), max(len(words), 1)
        once, m = set(lines), len(lines)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
        unique = {w.strip(b".,").lower() for w in seen}
        row[:] = (np.log1p(len(words)), len(seen) / k, len(unique) / k, lengths.mean(), np.log1p(lengths.max()), (lengths <= 3).mean(), np.log1p(m), 1 - len(once) / m, np.log1p(k / m), len(unique) / np.sqrt(k))
    return np.hstack([np.log1p(n)[:, None], entropy[:, None], np.sqrt(share @ MEMBERS), out])


def held_out(id_col: str, fold: int = 5) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % fold == 0


def isotonic(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins sorted by score: (mean score, share of ones) of each pool, both rising."""
    pools: list[list[float]] = []
    for s, y, w in zip(score, label, weight):
        pools.append([s * w, y * w, w])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


class QualityModel:
    """Fitted parts, all of a fixed size; `score` maps statistics to 0..1."""

    def __init__(self, centre, spread, waves, phases, weights, knots, values):
        self.centre, self.spread, self.waves, self.phases, self.weights, self.knots, self.values = centre, spread, waves, phases, weights, knots, values

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.spread, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.phases)) * np.cos(z @ self.waves + self.phases), z / 10, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return np.clip(0.998 * np.interp(raw, self.knots, self.values) + 0.002 / (1 + np.exp(-np.clip(4 * raw, -50, 50))), 0, 1)


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, sample: int, wanted: Column) -> DataFrame:
    """(_id, y, text) of documents with a 0/1 label: at most `sample` labels in hash order, so the broadcast side has a fixed bound. A document labelled twice
    takes the larger label; a repeated document has a row each time, which callers fold by _id."""
    few = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).filter(wanted)
    few = few.groupBy("_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(few), "_id")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", waves: int = 384, ridge: float = 1e-3, sample: int = SAMPLE) -> QualityModel | None:
    """Fits on labels outside the held-out fold: ridge on three folds of five, isotonic calibration on the fourth. None if no labelled document exists or all have one label."""
    schema = "_id long, fold int, y int, x binary"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            x = statistics(text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("_id").cast(pa.int64()), batch.column("fold"), batch.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["_id", "fold", "y", "x"])

    rows = labelled(docs, labels, label_col, id_col, text_col, sample, ~held_out("_id")).select("_id", (F.crc32(F.col("_id").cast("string").cast("binary")) % 5).cast("int").alias("fold"), "y", "text")
    rows = rows.mapInArrow(tidy(measure), schema).groupBy("_id").agg(F.min(F.struct("fold", "y", "x")).alias("r")).select("r.*")  # a repeated document counts once
    rows = Scratch(docs.sparkSession, "quality").write(rows.repartition(PARTS), "rows")

    def summed(work):
        """A matrix summed within each of PARTS partitions, then over them: what reaches the driver has a fixed size."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    x = np.frombuffer(b"".join(batch.column("x").to_pylist())).reshape(batch.num_rows, -1)
                    part = work(batch.column("fold").to_numpy(), batch.column("y").to_numpy().astype(np.float64), x)
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([total.shape[1]], pa.int32())], names=["m", "w"])

        found = rows.mapInArrow(tidy(run), "m binary, w int").collect()
        return sum(np.frombuffer(r.m).reshape(-1, r.w) for r in found) if found else None

    moments = summed(lambda fold, y, x: np.vstack([x.sum(axis=0), (x * x).sum(axis=0), np.full(x.shape[1], len(x)), np.full(x.shape[1], y.sum())]))
    if moments is None or moments[3, 0] in (0, moments[2, 0]):
        return None
    n, centre = moments[2, 0], moments[0] / moments[2, 0]
    spread = np.sqrt(np.maximum(moments[1] / n - centre**2, 1e-6))
    rng = np.random.default_rng(7)
    model = QualityModel(centre, spread, rng.normal(0, 1 / np.sqrt(len(centre)), (len(centre), waves)), rng.uniform(0, 2 * np.pi, waves), None, None, None)
    rare = np.clip(0.5 * n / np.array([n - moments[3, 0], moments[3, 0]]), 0.5, 4)  # balances the two labels' weights

    def normal(fold, y, x):
        use = fold != 4
        z, t = model.features(x[use]), y[use]
        zw = z * np.where(t > 0, rare[1], rare[0])[:, None]
        return np.hstack([z.T @ zw, (zw.T @ t)[:, None]])

    system = summed(normal)
    model.weights = np.linalg.solve(system[:, :-1] + ridge * n * np.eye(len(system)), system[:, -1])
    edges = np.linspace(-1.5, 2.5, 2001)

    def binned(fold, y, x):
        use = fold == 4
        raw = model.raw(x[use])
        at = np.clip(np.searchsorted(edges, raw), 0, len(edges))
        return np.vstack([np.bincount(at, w, len(edges) + 1) for w in (None, raw, y[use])])

    count, raw, ones = summed(binned)
    some = count > 0
    if some.any():
        model.knots, model.values = isotonic(raw[some] / count[some], ones[some] / count[some], count[some])
    else:
        model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score_documents(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """docs with `score` and `predicted` (1 if score >= cut). Null and empty texts have a score as any other; without a model all score 1."""
    others = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text_col):
            x = statistics(text_bytes(batch.column(text_col)))
            score = np.ones(len(x)) if model is None else model.score(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(score), pa.array((score >= cut).astype(np.int32))], names=[*others, "score", "predicted"])

    kept = docs.select(*others)
    return kept.mapInArrow(tidy(run), StructType(list(kept.schema.fields)).add("score", "double").add("predicted", "integer"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document. Labels, lang, source and ids are no inputs of a score; null and empty texts are scored as any
    other, repeated rows each; a null id is not held out; an empty table gives no rows; other columns are ignored."""
    scored = score_documents(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")
