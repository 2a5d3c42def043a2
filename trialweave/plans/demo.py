"""The experiment that the registered queries run on: a cohort and metrics over ``events``.

Arms go by ``user_id % 3``, a unit is exposed at its first click in the window, ``t2`` spends
60% more, amounts are converted at 1.0123456789, and the week before the start is the pre-period.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.operators import cohort as cohorts
from trialweave.operators import facts as fact_ops
from trialweave.operators.grid import make_grid
from trialweave.operators.moments import contrasts, moments_by_look, pair_up
from trialweave.plans.experiment import Comparison, Experiment, Metric

START, HORIZON = date(2024, 1, 8), date(2024, 1, 31)
VARIANTS = ("control", "t1", "t2")
GRID = make_grid(START, HORIZON, "1d")
PAIRS = contrasts(list(VARIANTS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with the metrics' inputs."""
    e = table(spark, sf_dir, "events")
    lift = F.when(F.col("user_id") % 3 == 2, 1.6).otherwise(1.0)
    return e.select(
        "user_id", "ts", "event_type", F.when(F.col("event_type") == "purchase", F.col("value") * 1.0123456789 * lift).otherwise(0.0).alias("spend"),
        (F.col("event_type") == "signup").cast("double").alias("signup"))


def variant():
    return F.when(F.col("user_id") % 3 == 0, "control").when(F.col("user_id") % 3 == 1, "t1").otherwise("t2")


def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter((F.col("event_type") == "click") & (F.col("ts") >= F.lit(GRID.start).cast("timestamp_ntz")))
    return e.select(F.col("user_id").cast("string").alias("unit_id"), variant().alias("variant"), F.col("ts").alias("exposure_ts"))


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.dedup(assignment(spark, sf_dir))


def metrics() -> list[Metric]:
    return [
        Metric("revenue", "sample", {"value": ("sum", "spend")}),
        Metric("signup", "fraction", {"count": ("max", "signup"), "nobs": ("max", "1.0D")}),
        Metric("spend_per_event", "ratio", {"num": ("sum", "spend"), "den": ("count", "1")}),
    ]


def experiment(**changes) -> Experiment:
    comparisons = (
        Comparison("revenue", "t-test", "main", {"test_type": "absolute"}),
        Comparison("signup", "z-test", "secondary", {"test_type": "absolute"}, desired=1),
        Comparison("spend_per_event", "ratio-delta", "guardrail", {"test_type": "absolute"}),
    )
    return Experiment(**{"name": "demo", "start": START, "horizon": HORIZON, "variants": VARIANTS, "comparisons": comparisons, "unit": "user_id"} | changes)


def exposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_ops.exposed(events(spark, sf_dir), cohort(spark, sf_dir), "user_id", "ts", GRID.start, GRID.horizon)


def covariate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_ops.covariate(events(spark, sf_dir), cohort(spark, sf_dir), "user_id", "ts", GRID, 7, F.sum("spend"))


def pairs(spark: SparkSession, sf_dir: str, roles: dict, with_covariate: bool = False) -> DataFrame:
    """Paired-up arm moments at every look."""
    running = fact_ops.running_units(exposed(spark, sf_dir), GRID, "ts", roles)
    fixed = ()
    if with_covariate:
        running, fixed = fact_ops.with_covariate(running, covariate(spark, sf_dir)), ("covariate",)
    arms = moments_by_look(running, len(GRID.ends), *roles, fixed=fixed)
    return pair_up(arms, PAIRS, ["look"])
