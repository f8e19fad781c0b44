"""Leading eigenvectors of a symmetric matrix by spectral divide and conquer.

The polar factor of the shifted matrix (QR-based dynamically weighted Halley iterations) has the eigenvalues +1 above and
-1 below the shift, so half of it plus the identity projects on the subspace above.  A basis of that subspace and of the
rest splits the matrix in two, which are split in turn until one dimension (or a multiple of the identity) is left."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
MAX_STEPS = 40


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a square matrix (directions of singular value zero stay zero)."""
    k = len(a)
    norm = np.linalg.norm(a)
    if norm == 0:
        return np.zeros_like(a)
    x, low, one = a / norm, EPS, np.eye(k)
    for _ in range(MAX_STEPS):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2)
        root = np.sqrt(1 + d)
        p = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * root)))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        ortho, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, one]))
        new = q / r * x + (p - q / r) / np.sqrt(r) * ortho[:k] @ ortho[k:].T
        low = min(1.0, low * (p + q * square) / (1 + r * square))
        moved, x = np.linalg.norm(new - x), new
        if moved <= np.cbrt(EPS) and abs(1 - low) <= 10 * EPS:
            break
    return x


def _split(a: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift; None where no shift parts the spectrum."""
    k, one = len(a), np.eye(len(a))
    mean = np.trace(a) / k
    spread = np.linalg.norm(a - mean * one) / np.sqrt(k)
    for shift in (np.median(np.diag(a)), *(mean + t * spread for t in (0, 0.13, -0.13, 0.29, -0.29, 0.47, -0.47))):
        u = polar(a - shift * one)
        u = (u + u.T) / 2
        above = int(round((np.trace(u) + k) / 2))
        if not 0 < above < k or np.linalg.norm(u @ u - one) > 1e-9 * k:
            continue  # the shift is an eigenvalue, or outside of them
        projector = (u + one) / 2
        basis = np.linalg.qr(projector @ rng.standard_normal((k, above)))[0]
        basis = np.linalg.qr(projector @ basis, mode="complete")[0]
        return basis[:, :above], basis[:, above:]
    return None


def leading_eigenvectors(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues of a symmetric ``v``, falling, and their unit eigenvectors in columns (largest entry positive)."""
    rng, scale = np.random.default_rng(0), np.linalg.norm(v)
    found: list[np.ndarray] = []
    left = [np.eye(len(v))] if len(v) else []
    while left and sum(f.shape[1] for f in found) < most:  # the subspace of the largest eigenvalues is always last
        basis = left.pop()
        a = basis.T @ v @ basis
        a = (a + a.T) / 2
        flat = np.linalg.norm(a - np.trace(a) / len(a) * np.eye(len(a))) <= 4 * EPS * scale
        parts = None if len(a) == 1 or flat else _split(a, rng)
        if parts is None:
            found.append(basis)
        else:
            left += [basis @ parts[1], basis @ parts[0]]
    vectors = np.hstack(found)[:, :most] if found else np.zeros((len(v), 0))
    vectors /= np.linalg.norm(vectors, axis=0, keepdims=True)
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]) if vectors.size else 1.0
    return values[order], vectors * sign
