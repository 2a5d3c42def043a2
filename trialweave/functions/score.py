"""Score intervals of two proportions (Farrington-Manning), by bisection on the result rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.functions.normal import critical
from trialweave.functions.ship import ship

STEPS = 80


def _bisect(f, lo, hi):
    """Where a decreasing function crosses 0, elementwise."""
    lo, hi = np.array(lo, float), np.array(hi, float)
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        up = f(mid) > 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return (lo + hi) / 2


def _slope(x, n, p):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(x > 0, x / p, 0.0) - np.where(n > x, (n - x) / (1 - p), 0.0)


def z_difference(x1, n1, x2, n2, delta):
    """Score statistic of p2 - p1 = delta, under the constrained maximum likelihood."""
    lo, hi = np.maximum(0.0, -delta), np.minimum(1.0, 1.0 - delta)
    s = _bisect(lambda p: _slope(x1, n1, p) + _slope(x2, n2, p + delta), lo, hi)
    t = s + delta
    return _z(x2 / n2 - x1 / n1 - delta, np.clip(s * (1 - s), 0, None) / n1 + np.clip(t * (1 - t), 0, None) / n2)


def z_ratio(x1, n1, x2, n2, theta):
    """Score statistic of p2 = theta p1."""
    hi = np.minimum(1.0, 1.0 / np.maximum(theta, 1e-300))

    def slope(p):
        with np.errstate(divide="ignore", invalid="ignore"):
            return (x1 + x2) / p - np.where(n1 > x1, (n1 - x1) / (1 - p), 0.0) - np.where(n2 > x2, (n2 - x2) * theta / (1 - theta * p), 0.0)

    s = _bisect(slope, np.zeros_like(hi), hi)
    t = theta * s
    return _z(x2 / n2 - theta * x1 / n1, np.clip(t * (1 - t), 0, None) / n2 + theta**2 * np.clip(s * (1 - s), 0, None) / n1)


def _z(num, var):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(var > 0, num / np.sqrt(np.where(var > 0, var, 1.0)), np.where(num == 0, 0.0, np.sign(num) * np.inf))


def interval_difference(x1, n1, x2, n2, c):
    one = np.ones_like(np.asarray(x1, float))
    find = lambda level: _bisect(lambda d: z_difference(x1, n1, x2, n2, d) - level, -one, one)
    return find(c), find(-c)


def interval_ratio(x1, n1, x2, n2, c):
    """Bounds of p2 / p1, searched on theta / (1 + theta)."""
    zero, one = np.zeros_like(np.asarray(x1, float)), np.ones_like(np.asarray(x1, float))
    find = lambda level: _bisect(lambda v: z_ratio(x1, n1, x2, n2, v / np.maximum(1 - v, 1e-16)) - level, zero, one)
    lo, hi = find(c), find(-c)
    return lo / (1 - lo), np.where(hi >= 1 - 1e-15, np.inf, hi / np.maximum(1 - hi, 1e-16))


def with_score_interval(df: DataFrame, test_type: str = "absolute", alpha: float = 0.05) -> DataFrame:
    """Replace a pooled z-test's interval; wants ``count_i``, ``nobs_i``.  Result rows only, never units."""
    ship(df.sparkSession)
    c = critical(alpha)

    @F.pandas_udf("lo double, hi double")
    def bounds(x1: pd.Series, n1: pd.Series, x2: pd.Series, n2: pd.Series) -> pd.DataFrame:
        v = [s.to_numpy(float) for s in (x1, n1, x2, n2)]
        lo, hi = (interval_difference if test_type == "absolute" else interval_ratio)(*v, c)
        if test_type == "relative":
            lo, hi = lo - 1, hi - 1
        ok = (v[1] > 0) & (v[3] > 0) & ((test_type == "absolute") | (v[0] > 0))
        clean = lambda x: np.where(ok & np.isfinite(x), x, np.nan)
        return pd.DataFrame({"lo": clean(lo), "hi": clean(hi)})

    out = df.withColumn("__b", bounds(*[F.col(k).cast("double") for k in ("count_1", "nobs_1", "count_2", "nobs_2")]))
    weak = F.lit(c) * F.sqrt(1.0 / F.col("count_1") + 1.0 / F.col("count_2")) > 0.5
    some = (F.col("count_1") > 0) & (F.col("count_2") > 0)
    return out.withColumns({
        "left_bound": F.nanvl("__b.lo", F.lit(None)), "right_bound": F.nanvl("__b.hi", F.lit(None)),
        "ci_length": F.nanvl(F.col("__b.hi") - F.col("__b.lo"), F.lit(None)),
        "weakly_identified": F.when(some, weak).otherwise(F.lit(True))}).drop("__b")
