"""The closed-form tests on paired-up arm moments (see ``moments.pair_up``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions.columns import div, floor0
from trialweave.functions.effects import absolute, fieller, normal_test, relative_delta
from trialweave.functions.normal import critical, two_sided
from trialweave.operators.moments import correlation

KINDS = ("absolute", "relative")


def _c(name: str) -> Column:
    return F.col(name)


def _n(k: int) -> Column:
    return _c(f"n_{k}").cast("double")


def _difference_test(df: DataFrame, mean, var, base, base_var, cov, test_type: str, interval: str, alpha: float) -> DataFrame:
    """A test of mean[1] - mean[0], absolute or relative to ``base``."""
    num, var_num = absolute(mean[0], mean[1], var[0], var[1])
    if test_type == "absolute":
        return df.withColumns(normal_test(num, var_num, alpha))
    if interval == "fieller":
        return df.withColumns(fieller(num, var_num, base, base_var, cov, alpha))
    effect, spread = relative_delta(num, var_num, base, base_var, cov)
    return df.withColumns(normal_test(effect, spread, alpha))


def t_test(df: DataFrame, test_type: str = "absolute", interval: str = "delta", alpha: float = 0.05, role: str = "value") -> DataFrame:
    """Welch's test on means with Normal quantiles; population variances."""
    m1, m2 = _c(f"mean_{role}_1"), _c(f"mean_{role}_2")
    s1, s2 = _c(f"m2_{role}_1") / _n(1) / _n(1), _c(f"m2_{role}_2") / _n(2) / _n(2)
    df = df.withColumns({"value_1": m1, "value_2": m2, "std_1": F.sqrt(s1 * _n(1)), "std_2": F.sqrt(s2 * _n(2))})
    return _difference_test(df, (m1, m2), (s1, s2), m1, s1, -s1, test_type, interval, alpha)


def z_test(df: DataFrame, test_type: str = "absolute", alpha: float = 0.05) -> DataFrame:
    """Pooled two-proportion test; wants ``count_i`` and ``nobs_i``.

    The relative form divides effect and standard error by the control's proportion and
    adds no term for the denominator.
    """
    p1, p2 = div(_c("count_1"), _c("nobs_1")), div(_c("count_2"), _c("nobs_2"))
    pooled = div(_c("count_1") + _c("count_2"), _c("nobs_1") + _c("nobs_2"))
    se = F.sqrt(floor0(pooled * (1.0 - pooled)) * (div(F.lit(1.0), _c("nobs_1")) + div(F.lit(1.0), _c("nobs_2"))))
    good = se > 0
    scale = F.lit(1.0) if test_type == "absolute" else p1
    effect, wide = div(p2 - p1, scale), div(se, F.abs(scale))
    half = F.when(good, critical(alpha) * wide)
    p = F.when(good, two_sided(div(p1 - p2, se)))
    std = [F.sqrt(floor0(div(p * (1.0 - p), _c(f"nobs_{k}")))) for k, p in ((1, p1), (2, p2))]
    return df.withColumns({
        "value_1": p1, "value_2": p2, "std_1": std[0], "std_2": std[1], "effect": effect, "left_bound": effect - half,
        "right_bound": effect + half, "ci_length": 2.0 * half, "pvalue": p, "reject": F.coalesce(p < F.lit(alpha), F.lit(False))})


def cuped(df: DataFrame, test_type: str = "absolute", interval: str = "delta", alpha: float = 0.05, role: str = "value", cov: str = "covariate") -> DataFrame:
    """Covariate-adjusted test: theta pools sample covariances over population variances of both arms.

    The relative form keeps the original control mean as its denominator.
    """
    c = [_c(f"c_{role}_{cov}_{k}") for k in (1, 2)]
    q = [_c(f"m2_{cov}_{k}") for k in (1, 2)]
    n = [_n(1), _n(2)]
    raw = [_c(f"m2_{role}_{k}") for k in (1, 2)]
    theta = div(div(c[0], n[0] - 1.0) + div(c[1], n[1] - 1.0), q[0] / n[0] + q[1] / n[1])
    df = df.withColumn("theta", theta)
    t = _c("theta")
    mean = [_c(f"mean_{role}_{k}") - t * _c(f"mean_{cov}_{k}") for k in (1, 2)]
    var = [floor0(raw[i] - 2.0 * t * c[i] + t * t * q[i]) / n[i] / n[i] for i in (0, 1)]
    m1 = _c(f"mean_{role}_1")
    shared = -div(raw[0] - t * c[0], n[0] - 1.0) / n[0]
    df = df.withColumns({
        "value_1": m1, "value_2": _c(f"mean_{role}_2"), "std_1": F.sqrt(raw[0] / n[0]), "std_2": F.sqrt(raw[1] / n[1]),
        "cov_value_1": _c(f"mean_{cov}_1"), "cov_value_2": _c(f"mean_{cov}_2"), "cov_std_1": F.sqrt(q[0] / n[0]), "cov_std_2": F.sqrt(q[1] / n[1]),
        "corr_coef_1": correlation(c[0], raw[0], q[0]), "corr_coef_2": correlation(c[1], raw[1], q[1])})
    df = df.withColumn("warnings", F.array_compact(F.array(*[
        F.when(_c(f"corr_coef_{k}") < 0.5, F.format_string("correlation of %s below 0.5", _c(f"name_{k}"))) for k in (1, 2)])))
    return _difference_test(df, mean, var, m1, raw[0] / n[0] / n[0], shared, test_type, interval, alpha)


def ratio_delta(df: DataFrame, test_type: str = "absolute", interval: str = "delta", alpha: float = 0.05, num: str = "num", den: str = "den") -> DataFrame:
    """Ratio of means with the variance of its linearisation; population moments throughout."""
    # Each step is a projection of its own, so that none stands in the next one several times.
    df = df.withColumns({f"value_{k}": div(_c(f"mean_{num}_{k}"), _c(f"mean_{den}_{k}")) for k in (1, 2)})
    spread = {}
    for k in (1, 2):
        r, md = _c(f"value_{k}"), _c(f"mean_{den}_{k}")
        line = floor0(_c(f"m2_{num}_{k}") - 2.0 * r * _c(f"c_{num}_{den}_{k}") + r * r * _c(f"m2_{den}_{k}"))
        spread[f"__var_{k}"] = div(line, _n(k) * md * md) / _n(k)
    df = df.withColumns(spread)
    var = [_c("__var_1"), _c("__var_2")]
    df = df.withColumns({f"std_{k}": F.sqrt(_c(f"__var_{k}") * _n(k)) for k in (1, 2)})
    return _difference_test(df, [_c("value_1"), _c("value_2")], var, _c("value_1"), var[0], -var[0], test_type, interval, alpha).drop(*spread)


def align(first: DataFrame, second: DataFrame, key: str, roles: list[str]) -> DataFrame:
    """Units of both arms on a shared pair id: ``<role>1`` and ``<role>2``."""
    a = first.select(F.col(key).alias("pair_id"), *[F.col(r).alias(f"{r}1") for r in roles])
    b = second.select(F.col(key).alias("pair_id"), *[F.col(r).alias(f"{r}2") for r in roles])
    return a.join(b, "pair_id")


def paired_t(pairs: DataFrame, by: list[str], test_type: str = "absolute", interval: str = "delta", alpha: float = 0.05) -> DataFrame:
    """Test on differences ``value2 - value1`` of aligned pairs.

    The relative form takes the covariance term with the sign of ``value1 - value2``.
    """
    d = F.col("value2") - F.col("value1")
    agg = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("md"), F.var_pop(d).alias("vd"), F.avg("value1").alias("m1"), F.avg("value2").alias("m2"),
        F.var_pop("value1").alias("v1"), F.var_pop("value2").alias("v2"), F.covar_samp(d, F.col("value1")).alias("cd1"))
    return _paired(agg, test_type, interval, alpha)


def _paired(agg: DataFrame, test_type: str, interval: str, alpha: float) -> DataFrame:
    n = _c("n").cast("double")
    df = agg.withColumns({"value_1": _c("m1"), "value_2": _c("m2"), "std_1": F.sqrt("v1"), "std_2": F.sqrt("v2")})
    zero = F.lit(0.0)
    return _difference_test(df, (zero, _c("md")), (zero, _c("vd") / n), _c("m1"), _c("v1") / n, -_c("cd1") / n, test_type, interval, alpha)


def paired_cuped(pairs: DataFrame, by: list[str], test_type: str = "absolute", interval: str = "delta", alpha: float = 0.05) -> DataFrame:
    """Differences adjusted by the covariate's differences; wants ``covariate1`` and ``covariate2``."""
    dy, dx = F.col("value2") - F.col("value1"), F.col("covariate2") - F.col("covariate1")
    agg = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value1").alias("m1"), F.avg("value2").alias("m2"), F.var_pop("value1").alias("v1"), F.var_pop("value2").alias("v2"),
        F.avg(dy).alias("my"), F.avg(dx).alias("mx"), F.var_pop(dy).alias("vy"), F.var_pop(dx).alias("vx"), F.covar_pop(dy, dx).alias("cyx"),
        F.covar_samp(dy, dx).alias("cs"), F.covar_samp(dy, F.col("value1")).alias("cy1"), F.covar_samp(dx, F.col("value1")).alias("cx1"))
    agg = agg.withColumn("theta", div(_c("cs"), _c("vx")))
    t = _c("theta")
    agg = agg.withColumns({
        "md": _c("my") - t * _c("mx"), "vd": floor0(_c("vy") - 2.0 * t * _c("cyx") + t * t * _c("vx")), "cd1": _c("cy1") - t * _c("cx1")})
    return _paired(agg, test_type, interval, alpha)
