"""Small dense algebra over tall tables: rows stay distributed, and only matrices of columns by columns reach the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _block(batch: pa.RecordBatch, skip: int = 0) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[skip:]])


def gram(table: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    """left' right over the rows of a table: each partition sums its part, and Spark adds the parts entry by entry."""
    names = list(dict.fromkeys([*left, *right]))
    at_left, at_right = [names.index(c) for c in left], [names.index(c) for c in right]

    def run(batches):
        total = np.zeros((len(at_left), len(at_right)))
        for batch in batches:
            x = _block(batch)
            total += x[:, at_left].T @ x[:, at_right]
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "v"])

    parts = table.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(run, "i int, j int, v double")
    out = np.zeros((len(left), len(right)))
    for i, j, v in parts.groupBy("i", "j").agg(F.sum("v")).collect():  # columns by columns
        out[i, j] = v
    return out


def times(table: DataFrame, key: str, names: list[str], w: np.ndarray, out: list[str]) -> DataFrame:
    """(key, out...): the named columns times ``w``."""
    kind = dict(table.dtypes)[key]

    def run(batches):
        for batch in batches:
            x = _block(batch, 1) @ w
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x[:, j]) for j in range(x.shape[1])]], [key, *out])

    rows = table.select(key, *[F.col(c).cast("double").alias(c) for c in names])
    return rows.mapInArrow(run, ", ".join([f"{key} {kind}", *[f"{c} double" for c in out]]))


def orthonormal(table: DataFrame, key: str, names: list[str], cut: float = 1e-10) -> tuple[DataFrame, list[str], np.ndarray]:
    """An orthonormal basis of the columns through their Gram matrix, its names, and the eigenvalues kept, descending."""
    e, q = np.linalg.eigh(gram(table, names, names))
    kept = [i for i in np.argsort(e)[::-1] if e[i] > cut * max(e[-1], 0.0)]
    basis = [f"q_{i}" for i in range(len(kept))]
    return times(table, key, names, q[:, kept] / np.sqrt(e[kept]), basis), basis, e[kept]
