"""The assignment cohort: dedup, contracts, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.operators.grid import Grid

COLUMNS = ("unit_id", "variant", "exposure_ts")


class ContractError(ValueError):
    """A relation breaks a contract that must stop the run."""


def dedup(source: DataFrame, unit: str = "unit_id") -> DataFrame:
    """One row per (unit, variant): first exposure, least stratum, number of source rows.

    Partial aggregation reduces each task's rows first, so a repeated unit costs no skew.
    """
    missing = {unit, "variant", "exposure_ts"} - set(source.columns)
    if missing:
        raise ContractError(f"the assignment lacks {sorted(missing)}")
    stratum = [F.min("stratum").alias("stratum")] if "stratum" in source.columns else []
    return source.groupBy(F.col(unit).cast("string").alias("unit_id"), "variant").agg(
        F.min("exposure_ts").alias("exposure_ts"), *stratum, F.count(F.lit(1)).alias("n_rows"))


def conflicts(cohort: DataFrame) -> DataFrame:
    """Units in more than one variant."""
    return cohort.groupBy("unit_id").agg(F.countDistinct("variant").alias("n_variants")).filter("n_variants > 1")


def validate(cohort: DataFrame, variants: Sequence[str]) -> list[str]:
    """Raise on an empty cohort, an undeclared variant or a unit in two; warn of repeated rows.

    One aggregate over the cohort and one bounded probe; no unit reaches the driver but one example.
    """
    found = cohort.agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_rows").alias("rows"),
        F.count_if(~F.col("variant").isin(*variants) | F.col("variant").isNull()).alias("undeclared")).first()
    if not found["n"]:
        raise ContractError("the assignment is empty")
    if found["undeclared"]:
        raise ContractError(f"{found['undeclared']} units have an undeclared variant")
    if one := conflicts(cohort).limit(1).collect():
        raise ContractError(f"unit {one[0]['unit_id']!r} is in several variants")
    extra = found["rows"] - found["n"]
    return [f"{extra} repeated assignment rows"] if extra else []


def source(kept: DataFrame | None, assignment: DataFrame, experiment: str, until) -> tuple[DataFrame, str]:
    """The cohort to read, and from where: the kept copy if it reaches ``until``, else the assignment itself, made distinct."""
    if kept is not None:
        own = kept.filter(F.col("experiment") == experiment)
        newest = own.agg(F.max("exposure_ts")).first()[0]
        if newest is not None and newest >= until:
            return own.drop("experiment", "loaded_at"), "copy"
    return dedup(assignment), "direct"


def counts(cohort: DataFrame) -> DataFrame:
    return cohort.groupBy("variant").agg(F.count(F.lit(1)).alias("n_units"))


def arrival_rate(cohort: DataFrame) -> DataFrame:
    """Units per day and variant over the cohort's whole exposure window; null for an empty window."""
    each = cohort.filter("exposure_ts is not null").groupBy("variant").agg(
        F.count(F.lit(1)).alias("n"), F.min("exposure_ts").alias("lo"), F.max("exposure_ts").alias("hi"))
    every = Window.partitionBy()
    days = F.timestamp_diff("SECOND", F.min("lo").over(every), F.max("hi").over(every)) / F.lit(86400.0)
    return each.select("variant", F.when(days > 0, F.col("n") / F.when(days > 0, days)).alias("per_day"), days.alias("window_days"))


def counts_by_look(cohort: DataFrame, grid: Grid, variants: Sequence[str]) -> DataFrame:
    """Units exposed strictly before each look's end: ``look``, ``end_ts``, ``variant``, ``n_units``.

    Exposures are counted once per (look, variant) and summed up over the looks, so no unit
    is compared with every look.  Units exposed before the start count in all looks.
    """
    spark = cohort.sparkSession
    early = F.col("exposure_ts") < F.lit(grid.start).cast("timestamp_ntz")
    at = F.when(early, F.lit(0)).otherwise(grid.look_of(F.col("exposure_ts")))
    seen = cohort.withColumn("look", at).filter("look is not null").groupBy("look", "variant").agg(F.count(F.lit(1)).alias("n"))
    frame = spark.createDataFrame([(i, e, v) for i, e in enumerate(grid.ends) for v in variants], "look int, end_ts timestamp_ntz, variant string")
    total = Window.partitionBy("variant").orderBy("look")
    return frame.join(seen, ["look", "variant"], "left").select("look", "end_ts", "variant", F.sum(F.coalesce("n", F.lit(0))).over(total).alias("n_units"))
