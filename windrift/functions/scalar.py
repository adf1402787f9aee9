"""Scalar column expressions used by the statistics and drift code
(F2-F6, F12, F14).  All are built-in Spark expressions, so they stay inside
whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from windrift.functions.columns import qcol


def _c(x: Column | str) -> Column:
    return qcol(x) if isinstance(x, str) else x


def signed_cbrt(x: Column | str) -> Column:
    """``sign(x) * |x|^(1/3)`` (the scale-drift transform)."""
    c = _c(x)
    return F.signum(c) * F.pow(F.abs(c), F.lit(1.0 / 3.0))


def clip(x: Column | str, lo: float = 0.0, hi: float = 100.0) -> Column:
    """clip to ``[lo, hi]``; NULL stays NULL."""
    c = _c(x)
    return F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi)))


def standardize(x: Column | str, mean: Column | float, std: Column | float) -> Column:
    """``(x - mean) / std`` with scale 1 where the population std is 0."""
    m = mean if isinstance(mean, Column) else F.lit(float(mean))
    s = std if isinstance(std, Column) else F.lit(float(std))
    return (_c(x) - m) / F.when(s == 0, F.lit(1.0)).otherwise(s)


def change_pct(cur: Column | str, ref: Column | str) -> Column:
    """``(cur - ref) / ref * 100``; NULL when the reference is 0."""
    r = _c(ref)
    return (_c(cur) - r) / F.nullif(r, F.lit(0.0)) * F.lit(100.0)


def round2(x: Column | str) -> Column:
    """round half-up to two decimals."""
    return F.round(_c(x), 2)


def mean_change_flag(pct: Column | str, threshold: float = 10.0) -> Column:
    """a feature is flagged when its absolute mean change exceeds 10 %."""
    return F.abs(_c(pct)) > F.lit(float(threshold))


def gaussian(seed: int, *keys: Column | str) -> Column:
    """standard normal draw.

    Without keys it is ``randn(seed)`` (depends on partitioning).  With row
    keys the draw is a pure function of (keys, seed): two independent uniforms
    from 64-bit hashes, then Box-Muller, so a recomputed task yields the same
    noise.
    """
    if not keys:
        return F.randn(seed)
    ks = [_c(k) for k in keys]
    scale = F.lit(float(2 ** 53))
    u1 = (F.shiftrightunsigned(F.xxhash64(*ks, F.lit(seed), F.lit("u1")), 11).cast("double") + 1.0) / (scale + 1.0)
    u2 = F.shiftrightunsigned(F.xxhash64(*ks, F.lit(seed), F.lit("u2")), 11).cast("double") / scale
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * 3.141592653589793) * u2)
