"""Embedding rows as packed binary: validity, packing, rotation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches


def dimension(emb: DataFrame, column: str = "embedding") -> int:
    """The most frequent vector length (0 for an empty table)."""
    row = (emb.filter(F.size(column) > 0).groupBy(F.size(column).alias("d")).count()
           .orderBy(F.desc("count"), "d").first())
    return row["d"] if row else 0


def packed(emb: DataFrame, d: int, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, packed) of the usable rows: id known, length ``d``, finite, not zero.

    ``packed`` holds the components as little-endian doubles or, for a float
    column, floats, so nothing is lost.
    """
    kind = "<f4" if "float" in dict(emb.dtypes)[column] else "<f8"

    def run(batch):
        ids, vectors = batch.column("vec_id"), batch.column("v")
        use = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False)
                             & vectors.is_valid().to_numpy(zero_copy_only=False))
        vectors = vectors.take(pa.array(use))
        use = use[vectors.value_lengths().to_numpy() == d]
        flat = batch.column("v").take(pa.array(use)).flatten()
        x = flat.to_numpy(zero_copy_only=False).reshape(-1, d)  # null components become NaN
        wide = x.astype(np.float64)
        good = np.isfinite(wide).all(axis=1) & (wide != 0).any(axis=1)
        x = np.ascontiguousarray(x[good].astype(kind))
        return {"vec_id": ids.take(pa.array(use[good])),
                "packed": pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(x.itemsize * d), len(x), [None, pa.py_buffer(x)]).cast(pa.binary())}

    return map_batches(emb.select(F.col(id_col).cast("long").alias("vec_id"), F.col(column).alias("v")),
                       "vec_id long, packed binary", run)


def unpack(values, d: int) -> np.ndarray:
    """Rows of doubles from packed binary (a list or Series of bytes)."""
    values = list(values)
    if not values:
        return np.empty((0, d))
    kind = "<f4" if len(values[0]) == 4 * d else "<f8"
    return np.frombuffer(b"".join(values), dtype=kind).reshape(-1, d).astype(np.float64)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def rotation(d: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))
