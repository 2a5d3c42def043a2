"""Reading stored rows again: replay windows, new levels, cached units, knobs and dashboard cells."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions.columns import finite
from trialweave.functions.normal import critical, phi
from trialweave.operators.readout import SERIES, latest, spark_series

# The dashboard's windows in hours.
WINDOWS = {"24h": 24, "7d": 168, "30d": 720, "90d": 2160, "all": None}
#: How a knob is answered: E from stored rows exactly, S from stored sums of squares, R from units again.
TIERS = {"alpha": "E", "test_type": "S", "interval": "S", "power": "E", "min_effect": "E", "correction": "E", "covariate_days": "R", "statistic": "R", "stratify": "R", "n_samples": "R"}


def replay(results: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Rows of looks within [start, end], both included."""
    ts = F.col("end_ts")
    for test in ([ts >= F.lit(start).cast("timestamp_ntz")] if start else []) + ([ts <= F.lit(end).cast("timestamp_ntz")] if end else []):
        results = results.filter(test)
    return results


def window_start(preset: str, now: datetime) -> datetime | None:
    """The lower bound of a preset window; null for all."""
    if preset not in WINDOWS:
        raise ValueError(f"a window is one of {list(WINDOWS)}")
    return None if WINDOWS[preset] is None else now - timedelta(hours=WINDOWS[preset])


def ship_decisions(verdicts: DataFrame, control: str) -> DataFrame:
    """Verdicts of the pairs that start from the control."""
    return verdicts.filter(F.col("name_1") == control)


def allowed(kind: Column, first: Column, second: Column) -> Column:
    """Whether both allow-lists let a kind pass; a null list lets all pass."""
    return F.coalesce(F.array_contains(first, kind), F.lit(True)) & F.coalesce(F.array_contains(second, kind), F.lit(True))


def combined_mde() -> Column:
    """A pair's detectable effect: the larger of its arms', if both are known."""
    return F.when(finite(F.col("mde_1")).isNotNull() & finite(F.col("mde_2")).isNotNull(), F.greatest(F.abs("mde_1"), F.abs("mde_2")))


def tests_at(boots: DataFrame, by: list[str], alphas: Sequence[float]) -> DataFrame:
    """Percentile intervals and decisions at many levels from one set of replicates, in one aggregation."""
    n = F.count(F.lit(1))
    cuts = [x for a in alphas for x in (a / 2, 1 - a / 2)]
    each = boots.groupBy(*by).agg(
        (F.count("boot") == n).alias("whole"), F.percentile("boot", F.array(*map(F.lit, cuts))).alias("q"),
        F.least(2.0 * F.least(F.count_if(F.col("boot") > 0), F.count_if(F.col("boot") < 0)) / n, F.lit(1.0)).alias("p"))
    rows = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.lit(2 * i).alias("at")) for i, a in enumerate(alphas)]))
    void = lambda c: F.when(F.col("whole"), c)
    out = each.select(*by, "whole", "q", "p", rows.alias("l")).select(
        *by, "l.alpha", void(F.get("q", F.col("l.at"))).alias("left_bound"), void(F.get("q", F.col("l.at") + 1)).alias("right_bound"), void(F.col("p")).alias("pvalue"))
    return out.withColumn("reject", F.coalesce(F.col("pvalue") < F.col("alpha"), F.lit(False)))


def pair_power(results: DataFrame, effect: float, alpha: float) -> DataFrame:
    """Each latest pair's power to find ``effect`` at ``alpha``, from its stored interval."""
    rows = latest(results.filter(F.col("ci_length").isNotNull()))
    known = rows.select("alpha").distinct().collect()  # a few configured levels
    wide = F.coalesce(*[F.when(F.col("alpha") == r["alpha"], F.lit(2 * critical(r["alpha"]))) for r in known], F.lit(None).cast("double")) if known else F.lit(None).cast("double")
    z = F.lit(abs(effect)) / (F.col("ci_length") / wide)
    return rows.select(*SERIES, F.when(F.col("ci_length") > 0, phi(z - critical(alpha)) + phi(-z - critical(alpha))).alias("power"))


def chips(results: DataFrame) -> DataFrame:
    """The numbers at each series' latest judged look."""
    rows = latest(results.filter(~F.col("insufficient_data")))
    return rows.select(*SERIES, "end_ts", "effect", (F.col("ci_length") / 2).alias("half_width"), "pvalue", (F.col("size_1") + F.col("size_2")).alias("units"), combined_mde().alias("mde"), "reject")


def tier(knob: str) -> str:
    """Whether a knob's change is answered exactly from rows (E), from sums (S) or from units (R)."""
    return TIERS.get(knob, "R")


def headline(verdicts: DataFrame, control: str) -> DataFrame:
    """One line per metric: the winner of the largest effect, else a loser, else the first reason."""
    ship = ship_decisions(verdicts, control)
    rank = F.when(F.col("verdict") == "WIN", 3).when(F.col("verdict") == "LOSE", 2).when(F.col("verdict") == "FLAT", 1).otherwise(0)
    order = F.struct(rank.alias("r"), F.coalesce(F.col("effect") * F.col("desired"), F.lit(0.0)).alias("gain"), "name_2")
    return ship.groupBy("metric").agg(F.max_by(F.struct("name_2", "verdict", "effect"), order).alias("h")).select("metric", "h.*")


def board(results: DataFrame, verdicts: DataFrame, control: str, buckets: int = 8) -> DataFrame:
    """The dashboard: each metric's headline with its size, gate and a short series of effects."""
    top = headline(verdicts, control)
    points = spark_series(results.filter(F.col("name_1") == control), buckets).groupBy("metric", "name_2").agg(F.sort_array(F.collect_list(F.struct("bucket", "effect"))).alias("s"))
    points = points.select("metric", "name_2", F.transform("s", lambda x: x["effect"]).alias("series"))
    last = latest(results.filter(F.col("name_1") == control)).select("metric", "name_2", "end_ts", (F.col("size_1") + F.col("size_2")).alias("units"), "srm_flag", "is_horizon")
    return top.join(last, ["metric", "name_2"]).join(points, ["metric", "name_2"], "left")


def signature_over_cooldown(kind: Column, verdict: Column) -> Column:
    """What a signal is known by between two runs."""
    return F.concat_ws(":", kind, verdict)


class Session:
    """Units kept for a reader's questions: relations by key, persisted up to a budget of entries, the oldest let go."""

    def __init__(self, budget: int = 8):
        self.budget, self.kept = budget, OrderedDict()

    def get(self, key: tuple, load: Callable[[], DataFrame]) -> DataFrame:
        if key not in self.kept:
            self.kept[key] = load().persist(StorageLevel.MEMORY_AND_DISK)
            while len(self.kept) > self.budget:
                self.kept.popitem(last=False)[1].unpersist()
        self.kept.move_to_end(key)
        return self.kept[key]

    def close(self) -> None:
        while self.kept:
            self.kept.popitem()[1].unpersist()
