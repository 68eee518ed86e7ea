"""Arithmetic on probability vectors and feature vectors held as `array<double>` columns.

Everything is a higher-order function inside the JVM; vectors are short (regions or feature dimensions).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def vsum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return vsum(F.zip_with(a, b, lambda x, y: x * y))


def norm2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(p: Column, eps: float = EPS, posinf: float = 1.0) -> Column:
    """Replace NaN, null and -inf by eps and +inf by `posinf`, clip from below at eps, divide by the sum."""
    finite = F.transform(
        p,
        lambda x: F.when(x.isNull() | F.isnan(x), F.lit(eps))
        .when(x == float("inf"), F.lit(posinf))
        .otherwise(F.greatest(x, F.lit(eps))),
    )
    total = vsum(finite)
    return F.transform(finite, lambda x: x / total)


def soft_cross_entropy(p: Column, q: Column) -> Column:
    return -vsum(F.zip_with(p, q, lambda x, y: x * F.ln(F.greatest(y, F.lit(EPS)))))


def kl_divergence(p: Column, q: Column) -> Column:
    return vsum(
        F.zip_with(
            p,
            q,
            lambda x, y: F.when(x > 0, x * (F.ln(F.greatest(x, F.lit(EPS))) - F.ln(F.greatest(y, F.lit(EPS)))))
            .otherwise(F.lit(0.0)),
        )
    )


def jensen_shannon(p: Column, q: Column, base2: bool = False) -> Column:
    mid = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    value = (kl_divergence(p, mid) + kl_divergence(q, mid)) / 2
    if not base2:
        return value
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value / F.ln(F.lit(2.0))))


def brier(p: Column, q: Column) -> Column:
    return vsum(F.zip_with(p, q, lambda x, y: (x - y) * (x - y)))


def entropy(p: Column, bits: bool = False) -> Column:
    log = F.log2 if bits else F.ln
    return -vsum(F.transform(p, lambda x: F.when(x > 0, x * log(x)).otherwise(F.lit(0.0))))


def top_index(p: Column) -> Column:
    """0-based argmax, lowest index on ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("long")


def hit_at(p: Column, index: Column, k: int) -> Column:
    """1.0 when fewer than k entries come before `index` in the (value desc, position asc) order."""
    own = F.element_at(p, (index + 1).cast("int"))
    before = F.size(F.filter(p, lambda x: x > own)) + F.size(
        F.filter(F.slice(p, F.lit(1), index.cast("int")), lambda x: x == own)
    )
    return F.when(before < k, F.lit(1.0)).otherwise(F.lit(0.0))


def overlap(p: Column, q: Column) -> Column:
    return vsum(F.zip_with(p, q, lambda x, y: F.least(x, y)))


def shares_top(p: Column, q: Column, tol: float = EPS) -> Column:
    """True when the tied top sets of both vectors intersect."""
    mp, mq = F.array_max(p), F.array_max(q)
    return F.exists(
        F.zip_with(p, q, lambda x, y: (F.abs(x - mp) <= tol) & (F.abs(y - mq) <= tol)), lambda b: b
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine with 0 for a zero vector."""
    scale = norm2(a) * norm2(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def mean_squared(a: Column, b: Column) -> Column:
    return vsum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))) / F.size(a)


def one_hot(index: Column, size: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == index, F.lit(1.0)).otherwise(F.lit(0.0))
    )


def softmax(z: Column) -> Column:
    top = F.array_max(z)
    e = F.transform(z, lambda x: F.exp(x - top))
    total = vsum(e)
    return F.transform(e, lambda x: x / total)


def log_clip(p: Column, eps: float = EPS) -> Column:
    return F.transform(p, lambda x: F.ln(F.greatest(x, F.lit(eps))))


def scaled_sum(a: Column, b: Column, wa: Column | float, wb: Column | float) -> Column:
    ca = wa if isinstance(wa, Column) else F.lit(float(wa))
    cb = wb if isinstance(wb, Column) else F.lit(float(wb))
    return F.zip_with(a, b, lambda x, y: ca * x + cb * y)


def dense(entries: Column, size: int) -> Column:
    """Dense vector of `size` from a map index -> value."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.coalesce(F.try_element_at(entries, i.cast("long")), F.lit(0.0)),
    )
