"""Column functions over factor arrays (``array<double>``).

Everything here is a Catalyst expression built from higher-order functions,
so it runs inside the JVM next to the scan and join that feed it; no Python
UDF is involved.  Functions take and return ``Column`` objects.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the deterministic factor rule (FIXTURES.md section 4).
DET_MODULUS = 10007
USER_A, USER_C = 7919, 104729
ITEM_A, ITEM_C = 6271, 15485863


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c, digits: int = 6) -> Column:
    """Round for result comparison; ``+ 0.0`` folds a negative zero."""
    return F.round(_col(c), digits) + F.lit(0.0)


def dot(a, b, start=None) -> Column:
    """Sum of p_f * q_f, accumulated left to right from ``start`` (default 0)."""
    init = F.lit(0.0) if start is None else _col(start).cast("double")
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), init, lambda acc, x: acc + x)


def biased_dot(mu, bu, bi, p, q) -> Column:
    """mu + b_u + b_i + p.q, with the bias sum as the accumulator start."""
    base = _col(bu) + _col(bi) + (F.lit(mu) if isinstance(mu, (int, float)) else _col(mu))
    return dot(p, q, start=base)


def scaled_terms(p, d, q) -> Column:
    """Per-factor terms p_k * d_k * q_k of a diagonal-scaled product."""
    return F.zip_with(F.zip_with(_col(p), _col(d), lambda x, y: x * y), _col(q), lambda x, y: x * y)


def diag_dot(p, d, q) -> Column:
    """Sum of p_k * d_k * q_k."""
    return F.aggregate(scaled_terms(p, d, q), F.lit(0.0), lambda acc, x: acc + x)


def scale_cap(x, scale: float = 100.0, cap: float = 5.0) -> Column:
    """x / scale, values above ``cap`` become ``cap``; no floor."""
    y = _col(x) / F.lit(float(scale))
    return F.when(y > F.lit(float(cap)), F.lit(float(cap))).otherwise(y)


def clamp_asym(x, low_to: float = 1.0, high: float = 5.0) -> Column:
    """Below 0 becomes ``low_to`` (1), above ``high`` becomes ``high``;
    values in 0..1 stay as they are."""
    c = _col(x)
    return (
        F.when(c < F.lit(0.0), F.lit(float(low_to)))
        .when(c > F.lit(float(high)), F.lit(float(high)))
        .otherwise(c)
    )


def running_clamp(terms, low: float = 1.0, high: float = 5.0) -> Column:
    """Ordered fold: after each term s = |s + x|, then s < low -> low,
    s > high -> high.  The array order is the factor order."""

    def step(s, x):
        t = F.abs(s + x)
        return F.when(t < F.lit(low), F.lit(low)).when(t > F.lit(high), F.lit(high)).otherwise(t)

    return F.aggregate(_col(terms), F.lit(0.0), step)


def norm2(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(_col(a), lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x))


def cosine(a, b, norm_a=None, norm_b=None) -> Column:
    """a.b / (|a| |b|); pass precomputed norms to avoid recomputing them per pair."""
    na = norm2(a) if norm_a is None else _col(norm_a)
    nb = norm2(b) if norm_b is None else _col(norm_b)
    return dot(a, b) / (na * nb)


def equal_width_bin(x, lo, hi, bins: int = 5) -> Column:
    """Bin into 1..bins with interval (hi + 1 - lo) / bins; the last bin takes
    everything else (including NaN).  Result is a double."""
    c = _col(x)
    lo_c = F.lit(float(lo)) if isinstance(lo, (int, float)) else _col(lo)
    hi_c = F.lit(float(hi)) if isinstance(hi, (int, float)) else _col(hi)
    interval = (hi_c + F.lit(1.0) - lo_c) / F.lit(float(bins))
    expr = None
    for b in range(1, bins):
        cond = (c >= lo_c + F.lit(float(b - 1)) * interval) & (c < lo_c + F.lit(float(b)) * interval)
        expr = F.when(cond, F.lit(float(b))) if expr is None else expr.when(cond, F.lit(float(b)))
    return expr.otherwise(F.lit(float(bins)))


def one_hot_argmax(a) -> Column:
    """1.0 at the first position of the row maximum, 0.0 elsewhere."""
    arr = _col(a)
    pos = F.array_position(arr, F.array_max(arr))
    return F.transform(arr, lambda x, i: F.when(i + F.lit(1) == pos, F.lit(1.0)).otherwise(F.lit(0.0)))


def one_hot_blockmax(a) -> Column:
    """1.0 wherever the value equals the row maximum (ties all set)."""
    arr = _col(a)
    return F.transform(arr, lambda x: F.when(x == F.array_max(arr), F.lit(1.0)).otherwise(F.lit(0.0)))


def deterministic_factors(id_col, rank: int, a: int, c: int) -> Column:
    """features[f] = ((id*a + f*c) % 10007) / 10007 / sqrt(rank), f = 0..rank-1,
    computed in double.  A repeatable stand-in for uniform random init."""
    ident = _col(id_col).cast("bigint")
    return F.transform(
        F.sequence(F.lit(0), F.lit(rank - 1)),
        lambda f: ((ident * F.lit(a) + f.cast("bigint") * F.lit(c)) % F.lit(DET_MODULUS)).cast("double")
        / F.lit(float(DET_MODULUS))
        / F.sqrt(F.lit(float(rank))),
    )


def user_init(id_col, rank: int) -> Column:
    return deterministic_factors(id_col, rank, USER_A, USER_C)


def item_init(id_col, rank: int) -> Column:
    return deterministic_factors(id_col, rank, ITEM_A, ITEM_C)


def blend(source, target, a: float = 0.5) -> Column:
    """(1 - a) * source + a * target, element-wise."""
    return F.zip_with(_col(source), _col(target), lambda s, t: F.lit(1.0 - a) * s + F.lit(a) * t)


def mix(a, b, weight: float = 1.0, shift: float = 0.0) -> Column:
    """weight * a + (1 - weight) * (b + shift)."""
    return F.lit(float(weight)) * _col(a) + F.lit(1.0 - float(weight)) * (_col(b) + F.lit(float(shift)))


def to_vector(a) -> Column:
    return array_to_vector(_col(a))


def to_array(v) -> Column:
    return vector_to_array(_col(v), "float64")
