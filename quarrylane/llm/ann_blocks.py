"""Nearest neighbours by a block matrix join: int8 product tiles with error bounds, then exact recomputation."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .vectors import valid_vectors

TILE = 512


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the scale of each row, and the norm of what rounding left out."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    codes = np.rint(x / scale[:, None]).clip(-127, 127).astype(np.int8)
    return codes, scale, np.linalg.norm(x - codes * scale[:, None], axis=1)


def exact_dot(a: np.ndarray, b: np.ndarray) -> float:
    """The inner product rounded once: products of 32-bit floats are exact in doubles, and fsum adds them exactly."""
    return math.fsum((a * b).tolist())


def search_block(qi: np.ndarray, q: np.ndarray, xi: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, id, score) of each query's k best in one block of data."""
    xc, xs, xe = quantise(x)
    xn, wide = np.linalg.norm(x, axis=1), xc.astype(np.float32)
    out = []
    for a in range(0, len(q), TILE):
        part, ids = q[a : a + TILE], qi[a : a + TILE]
        qc, qs, qe = quantise(part)
        qn = np.linalg.norm(part, axis=1)
        # |127 * 127 * d| stays below 2^24 up to 1040 dimensions, so float32 tiles of int8 codes are exact sums
        tile = (qc.astype(np.float32) @ wide.T if x.shape[1] <= 1000 else qc.astype(np.float64) @ xc.astype(np.float64).T).astype(np.float64)
        near = tile * qs[:, None] * xs[None, :]
        # |q.x - q'.x'| <= |q| |x - x'| + |q - q'| |x'| , with |x'| <= |x| + |x - x'|
        error = qn[:, None] * xe[None, :] + qe[:, None] * (xn + xe)[None, :]
        error = error * (1 + 1e-9) + 1e-12 * (qn[:, None] * xn[None, :])
        for r in range(len(part)):
            other = xi != ids[r]
            low = np.where(other, near[r] - error[r], -np.inf)
            n = int(other.sum())
            floor = np.partition(low, len(low) - k)[len(low) - k] if n > k else -np.inf
            alive = np.flatnonzero(other & (near[r] + error[r] >= floor))
            rough = x[alive] @ part[r]
            if len(alive) > k:  # a first float pass leaves those within rounding of the k-th
                worst = np.partition(rough, len(rough) - k)[len(rough) - k]
                alive = alive[rough >= worst - 1e-12 * (abs(worst) + qn[r] * xn.max())]
            heap: list[tuple[float, int]] = []
            for j in alive[np.argsort(xi[alive])].tolist():
                item = (exact_dot(part[r], x[j]), -int(xi[j]))
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
            out += [(int(ids[r]), -i, s) for s, i in heap]
    return out


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20, data_block: int = 8192, query_block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest by inner product (queries: ids divisible by `every`), nearest first, ties to the smaller id.

    Data and queries are dealt to a grid of blocks by id hash; a cell holds about `data_block` rows and `query_block` queries, so memory doesn't grow with
    the table. Every pair's int8 tile value is computed; only pairs whose upper bound misses the k-th lower bound of the block are left out, so the result
    is exact (recall 1). A cell sends k rows a query; a bounded merge per query follows. Null ids, null, empty, zero or non-finite vectors take no part;
    vectors of another dimension are no candidates; repeated rows are each candidates, but ask once; an empty table gives no rows; other columns are ignored."""
    total, asked = df.agg(F.count(F.lit(1)), F.count_if(F.col(id_col) % every == 0)).first()
    rows, columns = max(1, -(-total // data_block)), max(1, -(-asked // query_block))

    def deal(own: int, others: int, queries: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for d, (ids, x) in valid_vectors(batch, id_col, vec_col, keep_zero=False).items():
                    if queries:
                        asked = ids % every == 0
                        ids, x = ids[asked], x[asked]
                    block = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(own)
                    for b in np.unique(block):
                        part = block == b
                        blob, of = x[part].tobytes(), ids[part].tobytes()
                        cells = [(int(b), o) if not queries else (o, int(b)) for o in range(others)]
                        yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.int32()), pa.array([d] * len(cells), pa.int32()), pa.array([of] * len(cells), pa.binary()), pa.array([blob] * len(cells), pa.binary())], names=["row", "col", "d", "ids", "x"])

        return run

    schema = "row int, col int, d int, ids binary, x binary"
    source = df.select(id_col, vec_col)
    data = source.mapInArrow(deal(rows, columns, False), schema)
    queries = source.filter(F.col(id_col) % every == 0).mapInArrow(deal(columns, rows, True), schema)

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            d = left.column("d")[0].as_py()
            (qi, q), (xi, x) = (
                (np.frombuffer(b"".join(t.column("ids").to_pylist()), np.int64), np.frombuffer(b"".join(t.column("x").to_pylist()), np.float64).reshape(-1, d)) for t in (left, right)
            )
            # repeated rows of a query are dealt to one cell of each block of data, where one of them asks
            _, once = np.unique(np.ascontiguousarray(np.column_stack([qi.view(np.float64), q])).view(f"V{8 * d + 8}").ravel(), return_index=True)
            out = search_block(qi[once], q[once], xi, x, k)
        return pa.Table.from_pylist([dict(zip(("query_id", "vec_id", "score"), r)) for r in out], schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    found = queries.groupBy("row", "col", "d").cogroup(data.groupBy("row", "col", "d")).applyInArrow(cell, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
