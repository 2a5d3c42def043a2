"""Sample-ratio gates, multiple testing, always-valid inference."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions.columns import div, let
from trialweave.functions.normal import critical, phi

SRM_ALPHA = 0.001


def chi2_tail(x: Column, df: int) -> Column:
    """P(chi-square with ``df`` degrees of freedom > x), in closed form."""
    if df == 0:
        return F.lit(1.0)
    half = x / 2.0
    if df % 2:
        out = 2.0 * phi(-F.sqrt(x))
        terms = [(k + 0.5, math.gamma(k + 1.5)) for k in range((df - 1) // 2)]
    else:
        out = F.exp(-half)
        terms = [(k, math.gamma(k + 1)) for k in range(1, df // 2)]
    for power, scale in terms:
        out = out + F.exp(-half) * F.pow(half, F.lit(float(power))) / F.lit(scale)
    return out


def log_gamma(x: Column) -> Column:
    """ln Gamma for x > 0: Stirling's series after shifting the argument up to 8 or more."""
    def at(v: Column) -> Column:
        y = v + 8.0
        s = 1.0 / (y * y)
        series = (1 / 12 - s * (1 / 360 - s * (1 / 1260 - s * (1 / 1680 - s * (1 / 1188))))) / y
        steps = v
        for k in range(1, 8):
            steps = steps * (v + float(k))
        return (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series - F.log(steps)

    return let(x.cast("double"), at)


def srm(counts: DataFrame, split: Mapping[str, float], by: list[str], alpha: float = SRM_ALPHA) -> DataFrame:
    """Chi-square of ``n_units`` per variant against the expected split, and the oddest arm.

    Declared arms without units count as 0.
    """
    total = sum(split.values())
    shares = counts.sparkSession.createDataFrame([(i, v, s / total) for i, (v, s) in enumerate(split.items())], "ord int, variant string, share double")
    keys = counts.select(*by).distinct() if by else None
    full = (keys.crossJoin(F.broadcast(shares)) if by else shares).join(counts, [*by, "variant"], "left")
    full = full.withColumn("o", F.coalesce("n_units", F.lit(0)).cast("double"))
    every = Window.partitionBy(*by)
    full = full.withColumn("e", F.sum("o").over(every) * F.col("share"))
    resid = div(F.col("o") - F.col("e"), F.sqrt("e"))
    out = full.groupBy(*by).agg(
        F.sum("o").cast("long").alias("n_units"), F.sum(resid * resid).alias("chi2"),
        F.max_by("variant", F.struct(F.abs(resid), -F.col("ord"))).alias("culprit"))
    p = chi2_tail(F.col("chi2"), len(split) - 1)
    return out.withColumn("srm_pvalue", p).withColumn("srm_flag", F.coalesce(F.col("srm_pvalue") < alpha, F.lit(False)))


def srm_sequential(stream: DataFrame, split: Mapping[str, float], alpha: float = SRM_ALPHA, order: str = "look") -> DataFrame:
    """Dirichlet-multinomial e-process over cumulative counts: running largest Bayes factor, p = 1 / it."""
    total = sum(split.values())
    logs = F.create_map(*[x for v, s in split.items() for x in (F.lit(v), F.lit(math.log(s / total)))])
    k = len(split)
    n = F.col("n_units").cast("double")
    each = log_gamma(n + 1.0) - n * F.element_at(logs, F.col("variant"))
    by = stream.groupBy(order).agg(F.sum("n_units").alias("n_units"), F.sum(each).alias("terms"))
    log_bf = F.lit(math.lgamma(k)) - log_gamma(F.col("n_units") + F.lit(float(k))) + F.col("terms")
    best = F.max("log_bf").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    out = by.withColumn("log_bf", log_bf).withColumn("log_max", F.greatest(best, F.lit(0.0)))
    p = F.exp(-F.col("log_max"))
    return out.select(order, "n_units", "log_bf", "log_max", p.alias("srm_pvalue"), (F.col("log_max") >= math.log(1 / alpha)).alias("srm_flag"))


@dataclass(frozen=True)
class Levels:
    """The levels of main, secondary and guardrail comparisons."""

    main: float
    secondary: float
    guardrail: float


def n_pairs(arms: int, contrasts: str = "all_pairs") -> int:
    return arms - 1 if contrasts == "vs_control" else arms * (arms - 1) // 2


def levels(alpha: float, arms: int, others: int, scheme: str = "bonferroni", guardrail_alpha: float | None = None, contrasts: str = "all_pairs") -> Levels:
    """Two-tier levels: main by pairs, others by pairs x metrics; schemes of read time keep alpha."""
    if scheme != "bonferroni":
        return Levels(alpha, alpha, guardrail_alpha or alpha)
    pairs = n_pairs(arms, contrasts)
    second = alpha / (pairs * max(1, others))
    return Levels(alpha / pairs, second, guardrail_alpha or second)


def adjust(df: DataFrame, scheme: str, family: list[str], pvalue: str = "pvalue", tie: list[str] | None = None) -> DataFrame:
    """Add ``p_adjusted`` within each family; null p-values count for nothing and stay null."""
    tie = tie or []
    real = F.col(pvalue).isNotNull()
    m = F.count(pvalue).over(Window.partitionBy(*family))
    up = Window.partitionBy(*family).orderBy(F.col(pvalue).asc_nulls_last(), *tie)
    df = df.withColumn("__m", m).withColumn("__k", F.row_number().over(up))
    through = Window.partitionBy(*family).orderBy("__k")
    if scheme == "benjamini_hochberg":
        value = F.min(F.when(real, F.col(pvalue) * F.col("__m") / F.col("__k"))).over(through.rowsBetween(0, Window.unboundedFollowing))
    elif scheme == "holm":
        value = F.max(F.when(real, F.col(pvalue) * (F.col("__m") - F.col("__k") + 1))).over(through.rowsBetween(Window.unboundedPreceding, 0))
    elif scheme == "bonferroni":
        value = F.col(pvalue) * F.col("__m")
    else:
        value = F.col(pvalue)
    return df.withColumn("p_adjusted", F.when(real, F.least(value, F.lit(1.0)))).drop("__m", "__k")


def family_significance(df: DataFrame, scheme: str, alpha: float, family: list[str], tie: list[str], untiered: str | None = None) -> DataFrame:
    """``significant`` and ``sign`` per row; rows flagged by ``untiered`` are judged alone."""
    if untiered:
        df = df.withColumn("__p", F.when(~F.col(untiered), F.col("pvalue")))
        df = adjust(df, scheme, family, "__p", tie).withColumn("p_adjusted", F.coalesce("p_adjusted", "pvalue")).drop("__p")
    else:
        df = adjust(df, scheme, family, "pvalue", tie)
    sig = F.coalesce(F.col("p_adjusted") < alpha, F.lit(False))
    return df.withColumns({"significant": sig, "sign": F.when(sig, F.signum("effect").cast("int")).otherwise(0)})


def best_ratio(alpha: float) -> float:
    """u solving u = 2 ln(1/alpha) + ln(1 + u): the prior variance ratio that narrows the first look most."""
    u = 1.0
    for u in accumulate(range(200), lambda v, _: 2 * math.log(1 / alpha) + math.log1p(v), initial=1.0):
        pass
    return u


def _by_level(levels: list[float], value) -> Column:
    """A constant that goes with the row's ``alpha``."""
    out = F
    for a in levels:
        out = out.when(F.abs(F.col("alpha") - a) < 1e-12, F.lit(value(a)))
    return out


def with_tau2(series: DataFrame, by: list[str], levels: list[float], order: str = "look") -> DataFrame:
    """Add ``tau2``, frozen at each series' first usable look; earlier looks have none."""
    se = F.when(F.col("ci_length") > 0, F.col("ci_length") / (2.0 * _by_level(levels, critical)))
    so_far = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn("tau2", F.first(se * se * _by_level(levels, best_ratio), ignorenulls=True).over(so_far))


def always_valid(df: DataFrame, levels: list[float]) -> DataFrame:
    """Rewrite rows with ``tau2`` to the confidence sequence at their ``alpha``; others stay fixed."""
    v = F.pow(F.col("ci_length") / (2.0 * _by_level(levels, critical)), F.lit(2.0))
    t, e, alpha = F.col("tau2"), F.col("effect"), F.col("alpha")
    ok = t.isNotNull() & (v > 0)
    v = F.when(ok, v)
    radius = F.sqrt(2.0 * v * (v + t) / t * (-F.log(alpha) + 0.5 * F.log((v + t) / v)))
    p = F.least(F.lit(1.0), F.sqrt((v + t) / v) * F.exp(-t * e * e / (2.0 * v * (v + t))))
    put = lambda new, old: F.when(ok, new).otherwise(F.col(old))
    return df.withColumns({
        "left_bound": put(e - radius, "left_bound"), "right_bound": put(e + radius, "right_bound"), "pvalue": put(p, "pvalue"),
        "ci_length": put(2.0 * radius, "ci_length"), "reject": put(p < alpha, "reject"),
        "ci_kind": F.when(ok, F.lit("always_valid")).otherwise(F.lit("fixed"))})


def require_symmetric(interval: str, sequential: bool) -> None:
    if sequential and interval in ("score", "fieller", "percentile"):
        raise ValueError(f"an always-valid interval cannot be built on the asymmetric {interval} interval")
