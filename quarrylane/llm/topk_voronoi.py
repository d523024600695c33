"""Exact top-k by inner product: a Voronoi kNN join over integer vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, tidy
from .vectors import valid_vectors

EXACT = 2.0**53
LONGEST = 2.0**31  # norm of a scaled vector from which inner products may not fit a long


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T without rounding: in float64 while sums stay below 2^53, else in int64, which holds every score (see LONGEST)."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if top < EXACT else a @ b.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        worst = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= worst)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _pack(x: np.ndarray) -> bytes:
    return x.astype("<i8").tobytes()


class _Summary:
    """Of one dimension: pivots, radii and sizes of data cells, pivots, radii and bounds of query groups, and which cells a group needs."""

    def __init__(self, cells: list, groups: list, centres: np.ndarray | None, d: int, cell_rows: int):
        place = lambda r, at: centres[at] if centres is not None and at >= 0 else np.zeros(d)
        self.cells, self.groups = [r.cell for r in cells], [r.grp for r in groups]
        self.row_of, self.group_of = {c: i for i, c in enumerate(self.cells)}, {g: i for i, g in enumerate(self.groups)}
        self.pivots_of_cells = np.array([place(r, r.cell) for r in cells], dtype=np.float64).reshape(-1, d)
        self.pivots_of_groups = np.array([place(r, r.grp) for r in groups], dtype=np.float64).reshape(-1, d)
        self.radius, self.far = np.array([r.radius for r in cells]), np.array([r.radius for r in groups])
        self.bounds, self.shares = np.array([r.bound for r in groups]), np.array([-(-r.n // cell_rows) for r in cells])
        with np.errstate(invalid="ignore"):
            c, p = np.linalg.norm(self.pivots_of_cells, axis=1)[:, None], np.linalg.norm(self.pivots_of_groups, axis=1)[None, :]
            most = self.pivots_of_cells @ self.pivots_of_groups.T + p * self.radius[:, None] + self.far[None, :] * c + self.far[None, :] * self.radius[:, None]
            self.needed = _upper(most) >= self.bounds[None, :]


def _upper(most: np.ndarray) -> np.ndarray:
    """An upper bound with room for float rounding; where it is unknown, nothing is dropped."""
    return np.where(np.isfinite(most), most + 1e-9 * np.abs(most) + 1.0, np.inf)


def _summaries(cells: list, groups: list, centres: dict[int, np.ndarray], cell_rows: int) -> dict[int, _Summary]:
    return {d: _Summary([r for r in cells if r.d == d], [r for r in groups if r.d == d], centres.get(d), d, cell_rows) for d in {r.d for r in groups}}


def top_k(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = 5, scale: float = 256.0, pivots: int = 1024, cell_rows: int = 8192, group_queries: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products (queries: ids divisible by `every`).

    1. Equal vectors become one class holding its 2 * k smallest ids, an id k times at most: enough for any query, itself left out. A hot vector is so one row.
    2. The first `pivots` classes in hash order are Voronoi pivots. Data classes are grouped by the nearest of the first of them (one for each `cell_rows`
       rows), queries by the nearest of the first few (one for each `group_queries`). A data cell's summary is its pivot and radius R, a query group's its
       pivot p, radius r and the least of its queries' bounds; a query's bound is its k-th score over all pivots, which its true k-th score is not below.
    3. No query of a group scores a row x of a cell with pivot c above  p.c + |p| R + r |c| + r R  (Cauchy-Schwarz). Cells that stay below a group's bound are
       not sent to it; of a cell that is, only the rows with  p.x + r |x|  at the bound or above go, and only to it go the queries with  q.c + |q| R  there.
    4. A group and a share of a cell (large ones are split by hash) are solved by themselves; classes are expanded to ids, ranked, and cut to k.

    Driver and broadcast hold pivots and summaries, at most `pivots` of each kind and dimension. Null ids, null, empty or non-finite vectors take no part,
    nor do vectors whose scaled norm is LONGEST or more, as a long may not hold their scores; vectors of other dimensions are no candidates of a query;
    repeated (id, vector) rows count as separate candidates by id, and a query that stands m times meets each candidate m times among its k rows, as in the
    SQL; ties go to the smaller id; an empty table gives no rows; other columns are ignored. Where data has no clusters no bound can part them: every cell then
    goes to every group, and the work is that of all pairs."""
    spark, keep = df.sparkSession, 2 * k

    def capped(ids: list[int]) -> list[int]:
        ids = sorted(ids)
        return [i for n, i in enumerate(ids) if n < k or ids[n - k] != i]

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, (ids, x) in valid_vectors(batch, id_col, vec_col, keep_zero=True).items():
                rows: dict[bytes, list[int]] = {}
                with np.errstate(over="ignore"):
                    x = np.floor(x * scale)
                    good = np.linalg.norm(x, axis=1) < LONGEST
                for i, v in zip(ids[good].tolist(), x[good]):
                    rows.setdefault(_pack(v), []).append(i)
                yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.binary()), pa.array([capped(r)[:keep] for r in rows.values()], pa.list_(pa.int64())), pa.array([sorted(i for i in r if i % every == 0) for r in rows.values()], pa.list_(pa.int64()))], names=["v", "ids", "asked"])

    scratch = Scratch(spark, "voronoi")
    local = df.select(id_col, vec_col).mapInArrow(tidy(classes), "v binary, ids array<long>, asked array<long>")
    # ids of a class: at most 2 * k from each input batch, so no list grows with a class's copies; `asked` ids are explode-joined by class below
    merged = local.groupBy("v").agg(F.sort_array(F.flatten(F.collect_list("ids"))).alias("ids"), F.max(F.size("asked") > 0).alias("is_query"))
    merged = merged.withColumn("ids", F.slice(F.filter("ids", lambda x, n: (n < k) | (F.get(F.col("ids"), n - k) != x)), 1, keep))
    data = scratch.write(merged, "classes")
    asked = local.select("v", F.explode("asked").alias("query_id")).groupBy("v", "query_id").agg(F.count(F.lit(1)).cast("int").alias("times"))

    centre_rows = data.select("v", "ids").orderBy(F.xxhash64("v"), "v").limit(pivots).collect()
    if not centre_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = {len(r.v) // 8 for r in centre_rows}
    centres = {d: np.array([np.frombuffer(r.v, "<i8") for r in centre_rows if len(r.v) == 8 * d]) for d in dims}
    n_rows, n_queries = data.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    n_cells, n_groups = (min(pivots, -(-n // size)) or 1 for n, size in ((n_rows, cell_rows), (n_queries, group_queries)))
    splits = -(-n_queries // (n_groups * group_queries)) or 1  # of a group beyond what pivots allow, by hash

    def nearest(x: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gap = (x * x).sum(axis=1)[:, None] - 2 * (x @ heads.T) + (heads * heads).sum(axis=1)
        at = gap.argmin(axis=1)
        return at, np.linalg.norm(x - heads[at], axis=1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vs = np.array(batch.column("v").to_pylist(), dtype=object)
            sizes = np.array([len(v) // 8 for v in vs])
            for d in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == d)
                for part in np.split(own, range(1024, len(own), 1024)):
                    whole, c = np.array([np.frombuffer(v, "<i8") for v in vs[part]]), centres.get(d)
                    x, asks = whole.astype(np.float64), batch.column("is_query").to_numpy(zero_copy_only=False)[part]
                    cell, group, gap, far, bound = np.full(len(x), -1), np.full(len(x), -1), np.full(len(x), np.inf), np.full(len(x), np.inf), np.full(len(x), -np.inf)
                    if c is not None:
                        cell, gap = nearest(x, c[:n_cells].astype(np.float64))
                        group, far = nearest(x, c[:n_groups].astype(np.float64))
                        if len(c) > k and asks.any():
                            scores = _products(whole[asks], c).astype(np.float64)
                            for row, v in zip(scores, whole[asks]):  # the query's own class is no candidate
                                row[(c == v).all(axis=1)] = -np.inf
                            bound[asks] = np.partition(scores, len(c) - k, axis=1)[:, len(c) - k]
                    columns = [pa.array(np.full(len(x), d), pa.int32()), pa.array(cell, pa.int64()), pa.array(gap), pa.array(group, pa.int64()), pa.array(far), pa.array(bound)]
                    kept = batch.select(["v", "ids", "is_query"]).take(pa.array(part))
                    yield pa.RecordBatch.from_arrays([*kept.columns, *columns], names=["v", "ids", "is_query", "d", "cell", "gap", "grp", "far", "bound"])

    placed = scratch.write(data.mapInArrow(tidy(assign), "v binary, ids array<long>, is_query boolean, d int, cell long, gap double, grp long, far double, bound double"), "placed")
    cells = placed.groupBy("d", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")).collect()
    groups = placed.filter("is_query").groupBy("d", "grp").agg(F.max("far").alias("radius"), F.min("bound").alias("bound")).collect()
    shared = spark.sparkContext.broadcast(_summaries(cells, groups, centres, cell_rows))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of `side` 0 to the groups that need them, queries (side 1) to the cells that they need."""
        names = ["side", "d", "cell", "share", "grp", "split", "v", "ids"]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        for batch in batches:
            out: list[tuple] = []
            for v, ids, asks, d, cell, grp, bound in zip(*(batch.column(c).to_pylist() for c in ("v", "ids", "is_query", "d", "cell", "grp", "bound"))):
                if d not in shared.value:
                    continue
                s, x, h = shared.value[d], np.frombuffer(v, "<i8").astype(np.float64), xxhash.xxh3_64_intdigest(v)
                norm, at = np.linalg.norm(x), s.row_of[cell]
                most = s.pivots_of_groups @ x + s.far * norm
                for g in np.flatnonzero(s.needed[at] & (_upper(most) >= s.bounds)).tolist():
                    out += [(0, d, cell, h % int(s.shares[at]), int(s.groups[g]), split, v, ids) for split in range(splits)]
                if asks:
                    most = s.pivots_of_cells @ x + s.radius * norm
                    for c in np.flatnonzero(s.needed[:, s.group_of[grp]] & (_upper(most) >= bound)).tolist():
                        out += [(1, d, int(s.cells[c]), share, grp, h % splits, v, None) for share in range(int(s.shares[c]))]
                if len(out) > 4096:
                    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=names)

    sent = scratch.write(placed.mapInArrow(tidy(send), "side int, d int, cell long, share long, grp long, split long, v binary, ids array<long>"), "sent")

    scratch.keep("sent")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        qv, xv, ids = left.column("v").to_pylist(), right.column("v").to_pylist(), right.column("ids").to_pylist()
        out: list[tuple] = []
        if qv and xv:
            q, x = (np.array([np.frombuffer(v, "<i8") for v in vs]) for vs in (qv, xv))
            least = np.array([i[0] for i in ids])
            for a in range(0, len(q), 256):
                for row, v in zip(_products(q[a : a + 256], x), qv[a : a + 256]):
                    # k + 1 classes hold k candidates besides the query at least; a tie among classes goes by smallest id, and a class's further ids may precede another's
                    top = _best(row, least, k + 1)
                    ties = np.flatnonzero(row >= row[top].min()) if len(top) == k + 1 else top
                    found = sorted((-int(row[c]), i) for c in ties for i in ids[c])[:keep]
                    out += [(v, i, -s) for s, i in found]
        return pa.Table.from_pylist([dict(zip(("v", "vec_id", "score"), r)) for r in out], schema=pa.schema([("v", pa.binary()), ("vec_id", pa.int64()), ("score", pa.int64())]))

    at = ["d", "cell", "share", "grp", "split"]
    solved = sent.filter("side = 1").groupBy(*at).cogroup(sent.filter("side = 0").groupBy(*at)).applyInArrow(solve, "v binary, vec_id long, score long")
    best = Window.partitionBy("v").orderBy(F.desc("score"), "vec_id")  # rank <= 2 * k is cut before the shuffle
    solved = solved.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= keep)
    lists = solved.groupBy("v").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("top"))
    others = F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, k)
    answers = asked.join(lists, "v").select("query_id", F.slice(F.flatten(F.transform(others, lambda t: F.array_repeat(t, F.least(F.col("times"), F.lit(k))))), 1, k).alias("top"))
    return answers.select("query_id", F.posexplode("top").alias("p", "t")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.s")).alias("score"))
