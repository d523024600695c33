"""Toxicity: cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import steps, text_bytes, tidy
from .quality import held_out, labelled

#: Labelled rows to fit on at most, the first in hash order; and terms kept as features.
SAMPLE = 20_000
TERMS = 1024
#: Squared deviations from its expected count that a term needs to become a feature.
CHANCE = 11.0
WORD = re.compile(rb"[a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class OrdinalModel:
    """P(grade > j) = sigmoid(w . x - threshold_j): one weight vector for all ordered thresholds."""

    def __init__(self, terms: list[bytes], weights: np.ndarray, thresholds: np.ndarray):
        self.terms, self.weights, self.thresholds = {t: i for i, t in enumerate(terms)}, weights, thresholds

    def sparse(self, text: bytes) -> tuple[list[int], list[float]]:
        found = Counter([i for i in map(self.terms.get, words_of(text)) if i is not None])
        return list(found), [float(np.log1p(c)) for c in found.values()]

    def beyond(self, texts: list[bytes]) -> np.ndarray:
        """P(grade > j) for each text (rows) and threshold j."""
        line = np.zeros(len(texts))
        for k, t in enumerate(texts):
            at, x = self.sparse(t)
            if at:
                line[k] = self.weights[at] @ np.array(x)
        return 1 / (1 + np.exp(-np.clip(line[:, None] - self.thresholds[None, :], -60, 60)))


def fit_ordinal(rows: list[int], columns: list[int], values: list[float], grade: np.ndarray, n_features: int, rounds: int = 250, ridge: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood by Adam; thresholds stay ordered as a first value plus exponentials. Grades 0..K; returns weights and K thresholds."""
    n, top = len(grade), int(grade.max())
    r, c, v = np.array(rows, dtype=np.int64), np.array(columns, dtype=np.int64), np.array(values)
    share = np.array([(grade > j).mean() for j in range(top)]).clip(1e-4, 1 - 1e-4)
    start = np.log((1 - share) / share)
    params = np.concatenate([np.zeros(n_features), [start[0]], np.log(np.maximum(np.diff(start), 0.05))])
    m, s = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        w, first, gaps = params[:n_features], params[n_features], np.exp(params[n_features + 1 :])
        theta = first + np.concatenate([[0], np.cumsum(gaps)])
        line = np.bincount(r, v * w[c], n) if len(r) else np.zeros(n)
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        low, high = edge[grade] - line, edge[grade + 1] - line  # P(y) = F(high) - F(low)
        f_low, f_high = (1 / (1 + np.exp(-np.clip(e, -60, 60))) for e in (low, high))
        p = np.maximum(f_high - f_low, 1e-12)
        d_low, d_high = f_low * (1 - f_low) / p, f_high * (1 - f_high) / p
        g_line = d_high - d_low  # of the negative log likelihood
        g_theta = np.array([d_low[grade == j + 1].sum() - d_high[grade == j].sum() for j in range(top)]) / n
        g_w = (np.bincount(c, v * g_line[r], n_features) if len(r) else np.zeros(n_features)) / n + ridge * w / n_features
        after = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([g_w, [after[0]], after[1:] * gaps])
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        rate = 0.1 * max(1 - step / rounds, 0.02)  # falls, so that the last rounds settle
        params = params - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    theta = params[n_features] + np.concatenate([[0], np.cumsum(np.exp(params[n_features + 1 :]))])
    return params[:n_features], theta


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, terms: int = TERMS) -> OrdinalModel | None:
    """Grades: 0 for label 0; a document of label 1 gets 1 to 3 by tertiles of how many marked words it has (words that label 1 makes far likelier).
    Learns from labels outside the held-out fold. None if no labelled document exists or all have one label."""
    rows = labelled(docs, labels, label_col, id_col, text_col, sample, ~held_out("_id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, all_, n, n1 = Counter(), Counter(), 0, 0
        for batch in steps(batches):
            for y, t in zip(batch.column("y").to_pylist(), text_bytes(batch.column("text"))):
                seen = set(words_of(t))
                all_.update(seen)
                n, n1 = n + 1, n1 + y
                if y:
                    ones.update(seen)
        items = [(w, ones[w], c) for w, c in all_.items()] + [(b"", n1, n)]
        yield pa.RecordBatch.from_arrays([pa.array([i[k] for i in items], pa.binary() if not k else pa.int64()) for k in range(3)], names=["term", "n1", "n"])

    counts = rows.mapInArrow(tidy(count), "term binary, n1 long, n long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n").alias("n"))
    total = counts.filter(F.length("term") == 0).first()
    if total is None or total.n1 in (0, total.n):
        return None
    odds = F.log((F.col("n1") + 0.5) / (F.lit(float(total.n1)) + 1)) - F.log((F.col("n") - F.col("n1") + 0.5) / (F.lit(float(total.n - total.n1)) + 1))
    gain = F.abs(F.col("n1") / total.n1 - (F.col("n") - F.col("n1")) / (total.n - total.n1)) * F.abs(odds)
    p = total.n1 / total.n
    chance = (F.col("n1") - F.col("n") * p) ** 2 / (F.col("n") * p * (1 - p))  # terms that chance explains are no features
    chosen = counts.filter((F.length("term") > 0) & (F.col("n") >= 3) & (chance >= CHANCE)).select("term", odds.alias("odds"), "n1", gain.alias("gain")).orderBy(F.desc("gain"), "term").limit(terms).collect()
    names = [bytes(r.term) for r in chosen]
    marked = {i for i, r in enumerate(chosen) if r.odds > 2 and r.n1 >= 0.02 * total.n1}
    blank = OrdinalModel(names, np.zeros(len(names)), np.zeros(1))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = [blank.sparse(t) for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("_id").cast(pa.int64()), batch.column("y"), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))], names=["_id", "y", "at", "x"])

    found = rows.mapInArrow(tidy(vectors), "_id long, y int, at array<int>, x array<float>")
    once = found.groupBy("_id").agg(F.min(F.struct("y", "at", "x")).alias("r")).orderBy("_id").select("r.*")  # a repeated document counts once
    taken = once.collect()  # at most `sample` rows of at most `terms` features
    hits = np.array([sum(np.expm1(x) for i, x in zip(r["at"], r.x) if i in marked) for r in taken])
    label = np.array([r.y for r in taken])
    bounds = np.quantile(hits[label == 1], [1 / 3, 2 / 3])
    grade = np.where(label == 1, 1 + (hits > bounds[0]) + (hits > bounds[1]), 0)
    grade = np.unique(grade, return_inverse=True)[1]  # grades without rows close up
    r = [k for k, row in enumerate(taken) for _ in row["at"]]
    weights, thresholds = fit_ordinal(r, [i for row in taken for i in row["at"]], [x for row in taken for x in row.x], grade, len(names))
    return OrdinalModel(names, weights, thresholds)


def score_documents(docs: DataFrame, model: OrdinalModel | None, text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """docs with `severity` (expected grade), `p_toxic` = P(grade > 0) and `toxic` (p_toxic >= cut).

    Null and empty texts have no features: the base rate, not toxic. Without a model all are 0. Repeated rows are scored each; other columns stay."""
    added = ("severity", "p_toxic", "toxic")
    others = [c for c in docs.columns if c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text_col):
            beyond = np.zeros((batch.num_rows, 1)) if model is None else model.beyond(text_bytes(batch.column(text_col)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(beyond.sum(axis=1)), pa.array(beyond[:, 0].copy()), pa.array(beyond[:, 0] >= cut)], names=[*others, *added])

    kept = docs.select(*others)
    return kept.mapInArrow(tidy(run), StructType(list(kept.schema.fields)).add("severity", "double").add("p_toxic", "double").add("toxic", "boolean"))


def grade_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, severity, p_toxic, toxic for every document. The labels are 0 and 1: grades 1 to 3 are tertiles of how many marked words a document of label 1 has.

    Null and empty texts have the base rate; repeated rows are graded each, null ids too; an empty table gives no rows; other columns are ignored."""
    return score_documents(docs.select("doc_id", "text"), fit(docs, labels)).select("doc_id", "severity", "p_toxic", "toxic")
