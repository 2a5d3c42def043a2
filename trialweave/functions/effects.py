"""Effects, intervals and p-values as Column expressions, one version for all rows.

Each function returns a dict of named columns; ``named`` puts them on a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions.columns import div, finite
from trialweave.functions.normal import critical, two_sided

RESULT = ("effect", "left_bound", "right_bound", "ci_length", "pvalue", "reject")


def absolute(mean_1: Column, mean_2: Column, var_1: Column, var_2: Column) -> tuple[Column, Column]:
    """Difference of means and its variance; ``var_i`` are variances of the means."""
    return mean_2 - mean_1, var_1 + var_2


def relative_delta(num: Column, var_num: Column, den: Column, var_den: Column, cov: Column) -> tuple[Column, Column]:
    """num / den and its delta-method variance; null where den is 0."""
    d2 = den * den
    var = div(var_num, d2) + div(var_den * num * num, d2 * d2) - 2.0 * div(num * cov, d2 * den)
    return finite(div(num, den)), finite(var)


def normal_test(effect: Column, var: Column, alpha: float | Column) -> dict[str, Column]:
    """Interval and p-value of a Normal estimate.

    A variance that is not positive or finite keeps the effect, voids interval and p-value,
    and does not reject.
    """
    z = F.lit(critical(alpha)) if isinstance(alpha, float) else alpha
    level = F.lit(alpha) if isinstance(alpha, float) else None
    good = (var > 0) & finite(var).isNotNull() & effect.isNotNull()
    se = F.when(good, F.sqrt(var))
    p = two_sided(effect / se)
    return {
        "effect": effect, "left_bound": effect - z * se, "right_bound": effect + z * se, "ci_length": 2.0 * z * se,
        "pvalue": p, "reject": F.coalesce(p < level, F.lit(False))}


def fieller(num: Column, var_num: Column, den: Column, var_den: Column, cov: Column, alpha: float) -> dict[str, Column]:
    """Fieller's interval of a ratio of means, with the p-value of the difference ``num``.

    Bounds are null where the set is unbounded (``den**2 <= z**2 var_den``) or empty.
    """
    z2 = critical(alpha) ** 2
    lead = den * den - z2 * var_den
    mid = num * den - z2 * cov
    disc = z2 * (den * den * var_num - 2.0 * num * den * cov + num * num * var_den) - z2 * z2 * (var_num * var_den - cov * cov)
    ok = (lead > 0) & (disc >= 0)
    root = F.when(ok, F.sqrt(F.when(disc >= 0, disc)))
    lo, hi = div(mid - root, lead), div(mid + root, lead)
    p = F.when(var_num > 0, two_sided(num / F.sqrt(F.when(var_num > 0, var_num))))
    p = F.when(ok, p)
    return {
        "effect": finite(div(num, den)), "left_bound": lo, "right_bound": hi, "ci_length": hi - lo, "pvalue": p,
        "reject": F.coalesce(p < F.lit(alpha), F.lit(False))}


def named(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.withColumns(columns)
