"""Planning: baselines from stored rows or overrides, powered sizes, and the sequential design's average size."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialweave.functions import power
from trialweave.functions.columns import finite
from trialweave.operators.corrections import best_ratio

#: What an override may state, by kind of metric.
OVERRIDES = {"sample": {"mean", "std", "n", "corr"}, "fraction": {"mean", "n"}, "ratio": {"mean", "std", "n"}}


@dataclass(frozen=True)
class Baseline:
    """A metric's control moments: ``corr`` is the covariate's, if one is used."""

    metric: str
    kind: str
    mean: float
    std: float
    n: float | None = None
    corr: float | None = None

    @property
    def variance(self) -> float:
        return power.base_variance(self.kind, self.mean, self.std, self.corr)


def parse_overrides(specs: Sequence[str]) -> dict[str, dict[str, float]]:
    """``metric:mean=1.5,std=2`` texts as numbers by metric; a metric or a field may not come twice."""
    out: dict[str, dict[str, float]] = {}
    for spec in specs:
        metric, colon, fields = spec.partition(":")
        if not colon or not metric.strip() or metric.strip() in out:
            raise ValueError(f"not metric:field=number,... or given twice: {spec!r}")
        own = out[metric.strip()] = {}
        for part in fields.split(","):
            name, equals, value = (x.strip() for x in part.partition("="))
            if not equals or name in own:
                raise ValueError(f"not field=number or given twice: {part!r}")
            own[name] = float(value)
            if not math.isfinite(own[name]):
                raise ValueError(f"{name} is not finite in {spec!r}")
    return out


def baseline_from_override(metric: str, kind: str, fields: dict[str, float]) -> Baseline:
    """An override as a baseline, or an error that says what it lacks."""
    if unknown := set(fields) - OVERRIDES[kind]:
        raise ValueError(f"a {kind} metric's baseline has no {sorted(unknown)}")
    need = {"mean"} if kind == "fraction" else {"mean", "std"}
    if lacking := need - set(fields):
        raise ValueError(f"the baseline of {metric} lacks {sorted(lacking)}")
    mean = fields["mean"]
    if kind == "fraction" and not 0 < mean < 1:
        raise ValueError("a proportion lies between 0 and 1")
    std = math.sqrt(mean * (1 - mean)) if kind == "fraction" else fields["std"]
    if std < 0 or abs(fields.get("corr", 0.0)) > 1 or fields.get("n", 1.0) <= 0:
        raise ValueError("a deviation below 0, a correlation beyond 1 or no units")
    return Baseline(metric, kind, mean, std, fields.get("n"), fields.get("corr"))


def baselines_from_results(results: DataFrame, by: tuple[str, ...] = ("metric", "kind", "name_1")) -> DataFrame:
    """Each series' control moments from its latest usable stored row: ``mean``, ``std``, ``n``, ``corr``, ``end_ts``.

    A proportion's trials are p (1 - p) / se squared, as its stored deviation is the standard error.
    """
    p, se = F.col("value_1"), F.col("std_1")
    trials = F.when(se > 0, F.round(p * (1 - p) / F.when(se > 0, se * se)))
    fraction = F.col("kind") == "fraction"
    rows = results.filter(~F.col("insufficient_data")).select(
        *by, "end_ts", p.alias("mean"), F.when(fraction, F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)))).otherwise(se).alias("std"),
        F.when(fraction, trials).otherwise(F.col("size_1").cast("double")).alias("n"), finite(F.col("corr_coef_1")).alias("corr"))
    usable = rows.filter(F.col("mean").isNotNull() & (F.col("std") > 0) & (F.col("n") > 1))
    return usable.groupBy(*by).agg(F.max_by(F.struct("mean", "std", "n", "corr", "end_ts"), "end_ts").alias("r")).select(*by, "r.*")


def target_difference(mean: Column, magnitude: Column, relative: bool) -> Column:
    """An effect on the difference's scale."""
    return F.abs(mean * magnitude) if relative else F.abs(magnitude)


def is_powered(n: Column, required: Column) -> Column:
    """Whether the units at hand suffice; null where either is unknown."""
    return n >= required


def sized(baselines: DataFrame, mde: float, kind: str = "relative", alpha: float = 0.05, target: float = 0.8) -> DataFrame:
    """Baselines with ``required_n``, ``achievable_mde``, ``achieved_power`` and ``powered``; the covariate deflates the deviation."""
    corr = F.col("corr")
    usable = 1.0 - corr * corr >= 1e-12
    rows = baselines.withColumn("__std", F.when(corr.isNotNull() & usable, F.col("std") * F.sqrt(1.0 - corr * corr)).otherwise(F.col("std"))).withColumn("__f", (F.col("kind") == "fraction").cast("int"))

    def need(mean, std, fraction):
        return power.fraction_sample_size(mean, mde, kind, alpha, target) if fraction else power.t_sample_size(mean, std, mde, kind, alpha, target)

    def least(mean, std, n, fraction):
        return power.fraction_mde(mean, n, kind, alpha, target) if fraction else power.t_mde(mean, std, n, kind, alpha, target)

    def achieved(mean, std, n, fraction):
        return power.fraction_achieved(mean, n, mde, kind, alpha) if fraction else power.t_achieved(mean, std, n, mde, kind, alpha)

    rows = power.with_solve(rows, "required_n", need, "mean", "__std", "__f")
    rows = power.with_solve(rows, "achievable_mde", least, "mean", "__std", "n", "__f")
    rows = power.with_solve(rows, "achieved_power", achieved, "mean", "__std", "n", "__f")
    return rows.withColumn("powered", is_powered(F.col("n"), F.col("required_n"))).drop("__std", "__f")


def average_size(spark: SparkSession, variance: float, difference: float, alpha: float, ratio: float, per_day: float, days: Sequence[float], trajectories: int = 20_000, seed: int = 20240706) -> DataFrame:
    """Average size of the always-valid design by simulation: ``hypothesis``, ``mean_n``, ``mean_days``, ``crossed``.

    At a look with n units the estimate's information is I = 1 / V(n); its score process has
    independent Normal steps of mean (effect x step of I) and variance (step of I).  A
    trajectory ends at the first look whose estimate lies beyond the always-valid radius, or
    at the last.  Normal numbers come from hashes of (trajectory, look, seed), so a
    trajectory is a window over its looks and any partitioning gives the same result.
    """
    looks = [d for k, d in enumerate(days) if d > 0 and per_day * d >= 1 and all(d > e for e in days[:k])]
    if len(looks) < 2 or difference <= 0 or variance <= 0 or per_day <= 0:
        return spark.createDataFrame([], "hypothesis string, mean_n double, mean_days double, crossed double")
    sizes = [per_day * d for d in looks]
    spread = [variance * (1 + 1 / ratio) / n for n in sizes]
    mixing = best_ratio(alpha) * spread[0]
    plan, before = [], 0.0
    for k, (n, v) in enumerate(zip(sizes, spread)):
        wide = v + mixing
        plan.append((k, n, v, 1 / v - before, math.sqrt(2 * v * wide / mixing * (math.log(1 / alpha) + math.log(wide / v) / 2))))
        before = 1 / v
    frame = F.broadcast(spark.createDataFrame(plan, "look int, n double, v double, step double, radius double"))
    rows = spark.range(trajectories).withColumnRenamed("id", "path").crossJoin(frame)
    rows = rows.withColumn("normal", hashed_normal(F.col("path"), F.col("look"), seed))
    rows = rows.select("*", F.explode(F.array(*[F.struct(F.lit(h).alias("hypothesis"), F.lit(d).alias("effect")) for h, d in (("h0", 0.0), ("h1", float(difference)))])).alias("h"))
    along = Window.partitionBy("h.hypothesis", "path").orderBy("look")
    score = F.sum(F.col("h.effect") * F.col("step") + F.sqrt("step") * F.col("normal")).over(along)
    rows = rows.select("h.hypothesis", "path", "look", "n", (F.abs(score * F.col("v")) > F.col("radius")).alias("beyond"))
    ends = rows.groupBy("hypothesis", "path").agg(F.coalesce(F.min(F.when(F.col("beyond"), F.col("n"))), F.max("n")).alias("n"), F.bool_or("beyond").alias("crossed"))
    return ends.groupBy("hypothesis").agg(F.avg("n").alias("mean_n"), (F.avg("n") / per_day).alias("mean_days"), F.avg(F.col("crossed").cast("double")).alias("crossed"))


def hashed_normal(path: Column, look: Column, seed: int) -> Column:
    """A standard Normal number for each (path, look, seed): two uniform halves of an MD5, by Box and Muller."""
    digest = F.md5(F.concat_ws("|", path, look, F.lit(str(seed))))
    u, v = ((F.conv(F.substring(digest, at, 13), 16, 10).cast("double") + 0.5) / float(1 << 52) for at in (1, 14))
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2 * math.pi * v)
