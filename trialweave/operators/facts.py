"""Facts joined to the cohort, and per-unit metrics at every look in one pass."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.operators.grid import Grid

#: Aggregates that extend from look to look.
RUNNING = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def as_column(x: Column | str) -> Column:
    """A Column, or SQL text as one."""
    return F.expr(x) if isinstance(x, str) else x


def exposed(facts: DataFrame, cohort: DataFrame, unit: str, ts: str, start: datetime, end: datetime, after_exposure: bool = True, day: str | None = None) -> DataFrame:
    """Facts of the cohort's units in [start, end), not before each unit's exposure.

    The window is a plain predicate, so it reaches the scan; ``day`` adds an inclusive date
    predicate for a table partitioned by date.  Units without facts are absent.  Which side
    is broadcast, if any, is left to the optimizer and its size statistics.
    """
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    picked = facts.filter((F.col(ts) >= lo) & (F.col(ts) < hi))
    if day:
        picked = picked.filter(F.col(day).between(F.lit(start.date()), F.lit((end - timedelta(microseconds=1)).date())))
    arms = cohort.select(F.col("unit_id").alias("__unit"), F.col("variant").alias("__variant"), F.col("exposure_ts").alias("__exposed"))
    on = F.col(unit).cast("string") == F.col("__unit")
    if after_exposure:
        on = on & (F.col(ts) >= F.col("__exposed"))
    joined = picked.join(arms, on, "inner")
    return joined.withColumnsRenamed({"__unit": "unit_id"} if unit != "unit_id" else {}).withColumn("variant", F.col("__variant")).drop("__variant", "__exposed")


def population(facts: DataFrame, unit: str, ts: str, start: datetime, end: datetime) -> DataFrame:
    """All units' facts in [start, end) as one arm, without a cohort."""
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    return facts.filter((F.col(ts) >= lo) & (F.col(ts) < hi)).select("*", F.col(unit).cast("string").alias("unit_id"), F.lit("population").alias("variant"))


def unit_metric(facts: DataFrame, roles: Mapping[str, Column]) -> DataFrame:
    """One row per (variant, unit) in one window; ``roles`` are any aggregate expressions."""
    return facts.groupBy("variant", "unit_id").agg(*[c.alias(r) for r, c in roles.items()])


def running_units(facts: DataFrame, grid: Grid, ts: str, roles: Mapping[str, tuple[str, Column | str]]) -> DataFrame:
    """Per (variant, unit) and look with facts: each role's value up to that look, and ``is_new``.

    ``roles`` maps a name to (``sum``/``count``/``max``/``min``, Column or SQL text).  Facts are read
    once: aggregated by (unit, look), then extended along the unit's own looks.  A unit has a
    row only where its value may change.
    """
    at = facts.withColumn("look", grid.look_of(F.col(ts))).filter("look is not null")
    by = at.groupBy("variant", "unit_id", "look").agg(*[RUNNING[kind](as_column(c)).alias(r) for r, (kind, c) in roles.items()])
    along = Window.partitionBy("variant", "unit_id").orderBy("look")
    up = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    extend = {"count": F.sum}
    return by.select(
        "variant", "unit_id", "look", (F.row_number().over(along) == 1).alias("is_new"),
        *[extend.get(kind, RUNNING[kind])(r).over(up).alias(r) for r, (kind, _) in roles.items()])


def unit_panel(running: DataFrame, grid: Grid, roles) -> DataFrame:
    """:func:`running_units` with a row at every later look too (for resampling and audits)."""
    along = Window.partitionBy("variant", "unit_id").orderBy("look")
    until = F.coalesce(F.lead("look").over(along), F.lit(len(grid.ends))) - 1
    return running.withColumn("__until", until).withColumn("look", F.explode(F.sequence("look", "__until"))).select("variant", "unit_id", "look", *roles)


def unit_looks_any(facts: DataFrame, grid: Grid, ts: str, roles: Mapping[str, Column]) -> DataFrame:
    """Per (variant, unit, look) any aggregate over the look's whole window (distinct, median, ...).

    Each fact is repeated for the looks that hold it, so the cost is facts x looks; the other
    functions avoid that for aggregates that extend.
    """
    at = facts.withColumn("__first", grid.look_of(F.col(ts))).filter("__first is not null")
    wide = at.withColumn("look", F.explode(F.sequence(F.col("__first"), F.lit(len(grid.ends) - 1))))
    return wide.groupBy("variant", "unit_id", "look").agg(*[c.alias(r) for r, c in roles.items()])


def covariate(facts: DataFrame, cohort: DataFrame, unit: str, ts: str, grid: Grid, days: int, value: Column) -> DataFrame:
    """Each cohort unit's value over the ``days`` local days before the start; exposure does not clip it."""
    return covariates(facts, cohort, unit, ts, grid, days, {"covariate": value})


def covariates(facts: DataFrame, cohort: DataFrame, unit: str, ts: str, grid: Grid, days: int, values: Mapping[str, Column]) -> DataFrame:
    """:func:`covariate` for several values, from one scan."""
    from trialweave.operators.grid import local_day, local_instant

    end = local_instant(local_day(grid.start, grid.zone), grid.zone)
    start = local_instant(local_day(grid.start, grid.zone) - timedelta(days=days), grid.zone)
    return exposed(facts, cohort, unit, ts, start, end, after_exposure=False).groupBy("unit_id").agg(*[v.alias(k) for k, v in values.items()])


def with_covariate(units: DataFrame, cov: DataFrame) -> DataFrame:
    """Units with their covariate, 0 where there is none."""
    return with_covariates(units, cov)


def with_covariates(units: DataFrame, cov: DataFrame) -> DataFrame:
    """:func:`with_covariate` for all columns of ``cov``."""
    return units.join(cov, "unit_id", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in cov.columns if c != "unit_id"})
