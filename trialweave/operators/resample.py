"""Resampling tests.

Two families.  ``poisson_replicates`` is distributed: a unit's weight in a replicate is a
function of (unit, replicate, seed), so any partitioning gives the same replicates, and only
per-replicate sums are shuffled.  ``resampled`` draws from one numpy stream per comparison;
its arrays must fit a task, so it takes groups of at most ``MOST_UNITS`` units per arm and
refuses larger ones.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions.columns import div, finite
from trialweave.functions.identity import derive_seed
from trialweave.functions.ship import ship

MOST_UNITS = 200_000
#: Replicates drawn together; it fixes the stream, so results do not depend on memory.
QUANTUM = 128

STATISTICS = {"mean": lambda m: m.mean(axis=1), "median": lambda m: np.median(m, axis=1)}


def register_statistic(name: str, function) -> None:
    """A row-wise statistic of a replicate matrix; a name is never bound again."""
    if name in STATISTICS:
        raise ValueError(f"statistic {name!r} exists")
    STATISTICS[name] = function


def poisson_weight(key: Column, replicate: Column, seed: int) -> Column:
    """A Poisson(1) weight by inverse CDF of 52 hashed bits."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", key, replicate, F.lit(str(seed)))), 1, 13), 16, 10).cast("double")
    u = bits / F.lit(2.0**52)
    below, out = 0.0, F.lit(12)
    cuts = []
    for k in range(12):
        below += math.exp(-1) / math.factorial(k)
        cuts.append((below, k))
    for cut, k in reversed(cuts):
        out = F.when(u < cut, F.lit(k)).otherwise(out)
    return out


def poisson_replicates(units: DataFrame, by: list[str], replicates: int, seed: int = 0, value: str = "value", strata: str | None = None, key: str = "unit_id") -> DataFrame:
    """Weighted means per (``by``, variant, replicate); with ``strata``, units weigh 1 / their stratum's size.

    Equal keys in both arms share weights, which pairs the arms.
    """
    if strata:
        sizes = units.groupBy(*by, "variant", strata).agg(F.count(F.lit(1)).alias("__size")).withColumnRenamed(strata, "__s")
        units = units.join(sizes.withColumnsRenamed({c: f"__{c}" for c in [*by, "variant"]}), [
            *[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*by, "variant"]], F.col(strata).eqNullSafe(F.col("__s"))])
        scale = 1.0 / F.col("__size")
    else:
        scale = F.lit(1.0)
    rows = units.select(*by, "variant", key, F.col(value).alias("__v"), scale.alias("__scale"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    w = poisson_weight(F.col(key), F.col("replicate"), seed) * F.col("__scale")
    return rows.groupBy(*by, "variant", "replicate").agg((F.sum(w * F.col("__v")) / F.nullif(F.sum(w), F.lit(0.0))).alias("value"))


def replicate_effects(reps: DataFrame, by: list[str], pair: tuple[str, str], test_type: str) -> DataFrame:
    """Each replicate's effect for one pair of arms."""
    a = reps.filter(F.col("variant") == pair[0]).select(*by, "replicate", F.col("value").alias("v1"))
    b = reps.filter(F.col("variant") == pair[1]).select(*by, "replicate", F.col("value").alias("v2"))
    effect = F.col("v2") - F.col("v1")
    if test_type == "relative":
        effect = div(effect, F.col("v1"))
    return a.join(b, [*by, "replicate"]).select(*by, "replicate", finite(effect).alias("boot"))


def bootstrap_test(boots: DataFrame, by: list[str], alpha: float = 0.05, kind: str = "sign") -> DataFrame:
    """Percentile interval and p-value over replicates; one void replicate voids both."""
    n = F.count(F.lit(1))
    whole = F.count("boot") == n
    q = F.percentile("boot", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    if kind == "sign":
        p = 2.0 * F.least(F.count_if(F.col("boot") > 0), F.count_if(F.col("boot") < 0)) / n
    else:
        p = 2.0 * (F.least(F.count_if(F.col("boot") >= 0), F.count_if(F.col("boot") <= 0)) + 1) / (n + 1)
    out = boots.groupBy(*by).agg(
        n.alias("n_samples"), F.avg("boot").alias("boot_mean"), F.when(whole, q[0]).alias("left_bound"), F.when(whole, q[1]).alias("right_bound"),
        F.when(whole, F.least(p, F.lit(1.0))).alias("pvalue"))
    return out.withColumns({"ci_length": F.col("right_bound") - F.col("left_bound"), "reject": F.coalesce(F.col("pvalue") < alpha, F.lit(False))})


def apportion(shares: DataFrame, total: int, share: str = "share", order: str = "stratum") -> DataFrame:
    """Largest remainders over the rows of ``shares``; a stratum that gets none takes one from the largest."""
    every = Window.partitionBy()
    q = F.col(share) / F.sum(share).over(every) * F.lit(float(total))
    base = shares.withColumn("__q", q).withColumn("__c", F.floor("__q"))
    left = F.lit(total) - F.sum("__c").over(every)
    turn = F.row_number().over(Window.orderBy((F.col("__q") - F.col("__c")).desc(), order))
    base = base.withColumn("__n", F.col("__c") + F.when(turn <= left, 1).otherwise(0))
    none = F.sum(F.when(F.col("__n") == 0, 1).otherwise(0)).over(every)
    big = F.row_number().over(Window.orderBy(F.col("__n").desc(), order))
    taken = F.when(F.col("__n") == 0, 1).otherwise(F.col("__n") - F.when(big == 1, none).otherwise(0))
    return base.withColumn("n", taken.cast("long")).drop("__q", "__c", "__n")


def apportioned(shares: np.ndarray, total: int) -> np.ndarray:
    """:func:`apportion` of an array."""
    if total < len(shares):
        raise ValueError("fewer units than strata")
    quota = shares / shares.sum() * total
    out = np.floor(quota).astype(np.int64)
    out[np.argsort(out - quota, kind="stable")[: total - out.sum()]] += 1
    for i in np.flatnonzero(out == 0):
        out[out.argmax()] -= 1
        out[i] = 1
    return out


def _plan(strata: np.ndarray | None, names, shares, n: int):
    if strata is None:
        return [(np.arange(n), n)]
    return [(np.flatnonzero(strata == s), k) for s, k in zip(names, apportioned(shares, n))]


def _draws(rng, channels, plan, samples, statistic):
    """One statistic per replicate and channel; all channels of a stratum share the drawn indices."""
    out = [np.empty(samples) for _ in channels]
    for at in range(0, samples, QUANTUM):
        rows = min(QUANTUM, samples - at)
        index = np.concatenate([where[rng.integers(0, len(where), (rows, k))] for where, k in plan], axis=1)
        for o, c in zip(out, channels):
            o[at:at + rows] = statistic(c[index])
    return out


def _weighted(rng, channels, scale, samples):
    out = [np.empty(samples) for _ in channels]
    for at in range(0, samples, QUANTUM):
        rows = min(QUANTUM, samples - at)
        w = rng.poisson(1.0, (rows, len(channels[0]))).astype(float)
        if scale is not None:
            w *= scale
        with np.errstate(divide="ignore", invalid="ignore"):
            for o, c in zip(out, channels):
                o[at:at + rows] = (w @ c) / w.sum(axis=1)
    return out


METHODS = ("bootstrap", "poisson-bootstrap", "paired-bootstrap", "paired-poisson-bootstrap", "post-normed-bootstrap", "paired-post-normed-bootstrap")


def resample_pair(method: str, a: pd.DataFrame, b: pd.DataFrame, seed: int, samples: int, statistic: str = "mean", test_type: str = "relative", stratified: bool = False, weight_method: str = "min") -> tuple[np.ndarray, float]:
    """Replicate effects and the point estimate of one comparison; units come sorted by id."""
    rng = np.random.default_rng(seed)
    stat = STATISTICS[statistic]
    v = [x["value"].to_numpy(float) for x in (a, b)]
    strata = [x["stratum"].to_numpy() if stratified else None for x in (a, b)]
    names = shares = None
    if stratified:
        names = np.unique(strata[0])
        if list(names) != list(np.unique(strata[1])):
            raise ValueError("the arms have different strata")
        each = [np.array([(s == k).mean() for k in names]) for s in strata]
        shares = np.minimum(*each) if weight_method == "min" else (each[0] + each[1]) / 2
        shares = shares / shares.sum()
    paired = method.startswith("paired")
    if paired and (len(a) != len(b) or stratified and (strata[0] != strata[1]).any()):
        raise ValueError("pairs need arms of equal size and strata")
    plans = [_plan(s, names, shares, len(x)) for s, x in zip(strata, v)]
    scales = [None if s is None else 1.0 / pd.Series(s).map(pd.Series(s).value_counts()).to_numpy(float) for s in strata]
    if method == "bootstrap":
        boot = [_draws(rng, [x], p, samples, stat)[0] for x, p in zip(v, plans)]
    elif method == "poisson-bootstrap":
        boot = [_weighted(rng, [x], s, samples)[0] for x, s in zip(v, scales)]
    elif method == "paired-poisson-bootstrap":
        boot = _weighted(rng, v, scales[0], samples)
    elif method in ("paired-bootstrap", "paired-post-normed-bootstrap"):
        boot = _draws(rng, v, plans[0], samples, stat)
    elif method == "post-normed-bootstrap":
        if test_type != "relative":
            raise ValueError("the post-normed bootstrap is relative only")
        c = [x["covariate"].to_numpy(float) for x in (a, b)]
        one, two = (_draws(rng, [x, y], p, samples, stat) for x, y, p in zip(v, c, plans))
        with np.errstate(divide="ignore", invalid="ignore"):
            point = (stat(v[1][None])[0] / stat(v[0][None])[0]) / (stat(c[1][None])[0] / stat(c[0][None])[0]) - 1
            return (two[0] / one[0]) / (two[1] / one[1]) - 1, float(point)
    else:
        raise ValueError(f"no method {method!r}")
    with np.errstate(divide="ignore", invalid="ignore"):
        if method == "paired-post-normed-bootstrap":
            if test_type != "absolute":
                raise ValueError("the paired post-normed bootstrap is absolute only")
            z = [(x - x.mean()) / x.std() for x in boot]
            return z[1] - z[0], float((z[1] - z[0]).mean())
        point = [stat(x[None])[0] for x in v]
        if test_type == "relative":
            return boot[1] / boot[0] - 1, float(point[1] / point[0] - 1) if point[0] else math.nan
        return boot[1] - boot[0], float(point[1] - point[0])


def resampled(units: DataFrame, by: list[str], pair: tuple[str, str], method: str, samples: int = 1000, seed_parts: tuple = (), alpha: float = 0.05, kind: str = "sign", **options) -> DataFrame:
    """A resampling test per group of ``by``, each from its own seeded numpy stream.

    ``units`` has ``variant``, ``unit_id``, ``value`` and, if needed, ``covariate`` and
    ``stratum``.  Units are ordered by id, so the result does not depend on partitioning.
    """
    ship(units.sparkSession)
    kept = [c for c in (*by, "variant", "unit_id", "value", "covariate", "stratum") if c in units.columns]
    chosen = units.filter(F.col("variant").isin(*pair)).select(*kept)
    sizes = chosen.groupBy(*by, "variant").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if sizes > MOST_UNITS:
        raise ValueError(f"{sizes} units in an arm; use poisson_replicates, which is distributed")
    types = dict(chosen.dtypes)
    schema = ", ".join([*[f"{c} {types[c]}" for c in by], "effect double, left_bound double, right_bound double, pvalue double, boot_mean double, n_samples int"])

    def test(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("unit_id", kind="stable")
        a, b = (rows[rows["variant"] == v] for v in pair)
        if not len(a) or not len(b):
            return pd.DataFrame([(*key, None, None, None, None, None, samples)], columns=[*by, "effect", "left_bound", "right_bound", "pvalue", "boot_mean", "n_samples"])
        boot, effect = resample_pair(method, a, b, derive_seed(*seed_parts, *key, samples), samples, **options)
        if np.isfinite(boot).all():
            lo, hi = np.quantile(boot, [alpha / 2, 1 - alpha / 2])
            if kind == "sign":
                p = 2 * min((boot > 0).sum(), (boot < 0).sum()) / samples
            else:
                p = min(1.0, 2 * (min((boot >= 0).sum(), (boot <= 0).sum()) + 1) / (samples + 1))
        else:
            lo = hi = p = None
        effect = effect if math.isfinite(effect) else None
        return pd.DataFrame([(*key, effect, lo, hi, p, float(np.nanmean(boot)), samples)], columns=[*by, "effect", "left_bound", "right_bound", "pvalue", "boot_mean", "n_samples"])

    out = chosen.groupBy(*by).applyInPandas(test, schema)
    return out.withColumn("reject", F.coalesce(F.col("pvalue") < alpha, F.lit(False)))
