"""Numpy kernels of the vector engine; each works on a bounded block."""

from __future__ import annotations

import numpy as np

from .vectors import padded_dim

#: 1 / alpha * 2 with the fixed alpha 0.8 of the score, times the query's scale; see :func:`approximate`.
QUERY_SCALE = -10.0


def rotation_diagonal(p: int) -> np.ndarray:
    """Signs of the rotation over sqrt(p)."""
    bits = np.array([(j * 2654435761 & 0xFFFFFFFF).bit_count() for j in range(p)])
    return (1 - 2 * (bits % 2)) / np.sqrt(p)


def seeded_diagonal(p: int, seed: int) -> np.ndarray:
    """Random signs over sqrt(p), the same for a seed."""
    return (1 - 2 * np.random.default_rng(seed).integers(2, size=p)) / np.sqrt(p)


def rotate(x: np.ndarray, diagonal: np.ndarray | None = None) -> np.ndarray:
    """Rows padded to a power of two, scaled by the diagonal (the fixed one unless given), through the fast Hadamard transform."""
    n, d = x.shape
    p = padded_dim(d)
    if diagonal is not None and len(diagonal) != p:
        raise ValueError(f"a diagonal of {len(diagonal)} for {p} dimensions")
    y = np.zeros((n, p))
    y[:, :d] = x
    y *= rotation_diagonal(p) if diagonal is None else diagonal
    h = 1
    while h < p:
        z = y.reshape(n, p // (2 * h), 2, h)
        y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], 2).reshape(n, p)
        h *= 2
    return y


def encode(rotated: np.ndarray, center: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits of the unit residuals and their factor, for rotated rows and their rotated centre.

    A row equal to the centre has no direction: no bit is set and the factor is sqrt(P).
    """
    p = rotated.shape[1]
    r = rotated - center
    n = np.sqrt((r * r).sum(1))
    u = r / np.where(n > 0, n, 1)[:, None]
    bits = u > 0
    s = 2.0 * bits - 1
    x0, x1 = (u * s).sum(1) / np.sqrt(p), (s @ center) / np.sqrt(p)
    size = np.sqrt((u * u).sum(1))
    x0 = x0 / np.where(size > 0, size, 1)
    factor = np.where(n > 0, (size * size + 2 * size / np.where(x0 != 0, x0, 1) * x1) * np.sqrt(p), np.sqrt(p))
    return bits, factor


def approximate(bits: np.ndarray, factor: np.ndarray, rotated_queries: np.ndarray) -> np.ndarray:
    """Scores (queries by rows): factor + (2 * the scaled query's sum over set bits - its sum) / 4; smaller is nearer."""
    q = rotated_queries * QUERY_SCALE
    return factor[None, :] + (2 * (q @ bits.T.astype(np.float64)) - q.sum(1)[:, None]) / 4


def approximate_whole(bits: np.ndarray, factor: np.ndarray, rotated_queries: np.ndarray) -> np.ndarray:
    """:func:`approximate` in whole numbers: factors, the scaled query and its sum are cut towards zero, the quarter is rounded down.

    Components and sums need to fit in 16 bits, factors in 32; others raise an error instead of wrapping round.
    """
    q = rotated_queries * QUERY_SCALE
    whole, total, f = np.trunc(q), np.trunc(q.sum(1)), np.trunc(factor)
    for v, top in ((whole, 1 << 15), (total, 1 << 15), (f, 1 << 31)):
        if v.size and (v.min() < -top or v.max() >= top):
            raise OverflowError(f"a value beyond {top}")
    # sums of whole doubles this small are exact
    return f[None, :] + np.floor((2 * (whole @ bits.T.astype(np.float64)) - total[:, None]) / 4)


def pack(bits: np.ndarray) -> list[bytes]:
    return [b.tobytes() for b in np.packbits(bits, axis=1)]


def unpack(codes: list[bytes], p: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1), axis=1)[:, :p].astype(bool)


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By direct differences, in blocks of rows of x."""
    out = np.empty((len(x), len(y)))
    step = max(1, (1 << 22) // max(1, y.size))
    for i in range(0, len(x), step):
        d = x[i : i + step, None, :] - y[None]
        out[i : i + step] = np.einsum("abd,abd->ab", d, d)
    return out


def nearest(x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int, spare: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the k rows of y nearest by squared distance: their ids and distances, ties to smaller ids.

    A product finds k + ``spare`` rows, direct differences order them.
    """
    k = min(k, len(y))
    w = min(len(y), k + spare)
    out_i, out_d = np.empty((len(x), k), np.int64), np.empty((len(x), k))
    norms = (y * y).sum(1)
    for i in range(0, len(x), 256):
        part = x[i : i + 256]
        rough = norms - 2 * (part @ y.T)
        at = np.argpartition(rough, w - 1, axis=1)[:, :w]
        diff = part[:, None, :] - y[at]
        dist = np.einsum("abd,abd->ab", diff, diff)
        order = np.lexsort((ids[at], dist), axis=1)[:, :k]
        out_i[i : i + 256] = np.take_along_axis(ids[at], order, 1)
        out_d[i : i + 256] = np.take_along_axis(dist, order, 1)
    return out_i, out_d
