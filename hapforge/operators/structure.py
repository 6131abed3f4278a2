"""Leading singular vectors and principal components by block Lanczos steps over products."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hapforge.operators.association import hashed_normal
from hapforge.operators.dense import gram, orthonormal, times
from hapforge.operators.matrix import GenotypeMatrix
from hapforge.shared import materialize


def _leading(matrix: GenotypeMatrix, k: int, steps: int, seed: int, tolerance: float) -> tuple[np.ndarray, DataFrame, list[str]]:
    """Leading eigenvalues of Z Z' and the haplotype vectors.

    Each step multiplies a block of k + 2 columns and adds what is new to the basis, in whose span the
    problem is solved exactly (Rayleigh and Ritz). It ends when no leading vector leaves a residual
    over ``tolerance`` of the largest value; RuntimeError if ``steps`` don't get there. The basis is a
    table with a row for each haplotype; only matrices of columns by columns reach the driver.
    """
    width = min(k + 2, *matrix.shape)
    names = [f"u_{i}" for i in range(width)]
    x = matrix.haps.select("hap_idx", *[hashed_normal(F.col("hap_idx").cast("string"), seed + 31 * i).alias(v) for i, v in enumerate(names)])
    x, block, _ = orthonormal(materialize(x, "start"), "hap_idx", names)
    basis, qs, ys = None, [], []
    for step in range(steps):
        own, image = [f"q{step}_{i}" for i in range(len(block))], [f"y{step}_{i}" for i in range(len(block))]
        x = x.select("hap_idx", *[F.col(c).alias(q) for c, q in zip(block, own, strict=True)])
        y = matrix.grm_matmat(x, own).select("hap_idx", *[F.col(q).alias(v) for q, v in zip(own, image, strict=True)])
        both = x.join(y, "hap_idx")
        basis = materialize(both if basis is None else basis.join(both, "hap_idx"), "basis")
        qs, ys = qs + own, ys + image
        got = gram(basis, [*qs, *ys], [*qs, *ys])
        n = len(qs)
        unit, small, square = got[:n, :n], got[:n, n:], got[n:, n:]
        g, v = np.linalg.eigh(unit)  # the identity but for rounding
        root = v / np.sqrt(g)
        e, w = np.linalg.eigh(root.T @ (small + small.T) / 2 @ root)
        order = np.argsort(e)[::-1][:k]
        e, w = e[order], root @ w[:, order]
        rest = np.maximum(np.einsum("ij,ik,kj->j", w, square, w) - e**2, 0.0)  # |Z Z' u - e u|^2 of u = basis w
        left = float(np.sqrt(rest.max()) / max(e[0], 1e-300))
        if left <= tolerance:
            break
        fresh = np.vstack([-np.linalg.solve(unit, small[:, n - len(own) :]), np.eye(len(own))])
        x, block, size = orthonormal(materialize(times(basis, "hap_idx", [*qs, *image], fresh, image), "fresh"), "hap_idx", image)
        if not len(size) or size[0] <= 1e-18 * e[0] ** 2:  # the span is invariant: nothing is new
            break
    else:
        raise RuntimeError(f"a residual of {left:.1e} is left after {steps} steps")
    out = [f"u_{i}" for i in range(len(e))]
    return np.maximum(e, 0.0), times(basis, "hap_idx", qs, w, out), out


def _check(k: int, most: int) -> None:
    if not isinstance(k, int) or isinstance(k, bool) or not 1 <= k < most:
        raise ValueError(f"k must be a whole number from 1 to {most - 1}, not {k!r}")


def pca(matrix: GenotypeMatrix, k: int, steps: int = 60, seed: int = 1, tolerance: float = 1e-3) -> tuple[np.ndarray, DataFrame]:
    """(eigenvalues, descending; (hap_idx, u_0 ...)) of the relationship matrix Z Z'."""
    _check(k, matrix.n)
    values, vectors, _ = _leading(matrix.stored(), k, steps, seed, tolerance)
    return values, vectors


def svd(matrix: GenotypeMatrix, k: int, steps: int = 60, seed: int = 1, tolerance: float = 1e-3) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """(left (hap_idx, u_i), singular values, right (variant_idx, u_i)) of the normalized matrix."""
    _check(k, min(matrix.shape))
    matrix = matrix.stored()
    values, left, names = _leading(matrix, k, steps, seed, tolerance)
    s = np.sqrt(np.maximum(values, 0.0))
    right = matrix.normalized_rmatmat(left, names)
    return left, s, right.select("variant_idx", *[(F.col(v) / F.lit(float(x) if x else 1.0)).alias(v) for v, x in zip(names, s, strict=True)])
