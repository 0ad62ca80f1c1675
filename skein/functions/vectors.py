"""Vector arithmetic as column expressions (JVM side, double precision, left folds).

These serve projections and small joins; the searches use :mod:`.kernels`.
Vectors are arrays of numbers; a null vector gives null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _total(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def l2_sqr(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return _total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def inner(a: Column, b: Column) -> Column:
    return _total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm_sqr(v: Column) -> Column:
    return _total(F.transform(doubles(v), lambda x: x * x))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = F.sqrt(norm_sqr(v))
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def padded_dim(dim: int) -> int:
    """The power of two that a rotation needs, 64 at least."""
    return max(64, 1 << max(0, (dim - 1).bit_length()))


def pad(v: Column, to: int) -> Column:
    return F.concat(doubles(v), F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(to) - F.size(v))))


def rotation_sign(j: Column) -> Column:
    """The fixed sign of dimension j in the rotation's diagonal."""
    return F.lit(1) - F.lit(2) * (F.bit_count((j.cast("long") * F.lit(2654435761)).bitwiseAND(F.lit(4294967295))) % 2)


def rotate(v: Column, dim: int) -> Column:
    """H (D x): signs scaled by 1 / sqrt(P), then the Hadamard matrix in natural order; v is padded to P."""
    p = padded_dim(dim)
    # `dim` is the padded dimension of the index; arithmetic is a left fold over dimensions
    scaled = F.transform(pad(v, p), lambda x, j: x * rotation_sign(j) / F.lit(math.sqrt(p)))
    parity = lambda i, j: F.lit(1) - F.lit(2) * (F.bit_count(i.bitwiseAND(j)) % 2)
    return F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: _total(F.transform(scaled, lambda x, j: x * parity(i, j))))


def sign_bits(v: Column) -> Column:
    """1 where a component is above zero, else 0."""
    return F.transform(v, lambda x: F.when(x > 0, 1).otherwise(0))


def packed_bits(bits: Column, dim: int, word: int = 32) -> Column:
    """Bits packed into words, the first bit of a word the highest; words of 32 bits stay positive."""
    fold = lambda at: F.aggregate(F.slice(bits, at + 1, F.lit(word)), F.lit(0).cast("long"), lambda c, b: c * 2 + b)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1), F.lit(word)), fold)


def popcount(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda s, w: s + F.bit_count(w))


def scalar_quantized(v: Column, levels: int) -> Column:
    """Codes 0 to levels - 1 of the components between the vector's least and largest; 0 where they are equal."""
    lo, hi = F.array_min(doubles(v)), F.array_max(doubles(v))
    width = (hi - lo) / F.lit(float(levels - 1))
    return F.transform(doubles(v), lambda x: F.when(width > 0, F.floor((x - lo) / width + 0.5)).otherwise(0).cast("int"))


def fixed(x: Column, digits: int = 6) -> Column:
    """Rounded half up, the same in any engine with IEEE doubles."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def fixed_all(v: Column, digits: int = 6) -> Column:
    return F.transform(v, lambda x: fixed(x, digits))
