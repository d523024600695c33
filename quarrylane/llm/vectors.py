"""Vector columns as blocks of numbers, shared by the two searches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def valid_vectors(batch: pa.RecordBatch, id_col: str, vec_col: str, keep_zero: bool) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """dimension -> (ids, float64 rows) of a batch's usable vectors: not null or empty, no null or non-finite component, an id; zero vectors only if asked for."""
    ids, vectors = batch.column(id_col).to_pylist(), batch.column(vec_col)
    flat = vectors.flatten()
    lengths = np.array([-1 if n is None else n for n in vectors.value_lengths().to_pylist()], dtype=np.int64)
    if flat.null_count or (lengths < 0).any() or None in ids or len(set(lengths.tolist())) > 1:
        found: dict[int, tuple[list, list]] = {}
        for i, v in zip(ids, vectors.to_pylist()):
            if i is not None and v and None not in v:
                a, b = found.setdefault(len(v), ([], []))
                a.append(i)
                b.append(v)
        blocks = {d: (np.array(a, dtype=np.int64), np.array(b, dtype=np.float64)) for d, (a, b) in found.items()}
    else:
        d = int(lengths[0]) if len(lengths) else 0
        blocks = {d: (np.array(ids, dtype=np.int64), flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d))} if d else {}
    out = {}
    for d, (i, x) in blocks.items():
        good = np.isfinite(x).all(axis=1)
        if not keep_zero:
            good &= (x != 0).any(axis=1)
        if good.any():
            out[d] = (i[good], x[good])
    return out
