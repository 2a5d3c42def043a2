"""Structured Streaming forms of the cohort copy and the daily state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from trialweave.operators.state import day_state


def exposures(stream: DataFrame, unit: str, variant: Column, ts: str) -> DataFrame:
    """First exposures: per unit and variant the smallest time so far, and the rows seen.

    A row that comes late lowers the time, so the result does not depend on the order of
    arrival.  Its state is a row per unit, as the cohort itself; write it in update or
    complete mode, and read the newest row of a unit.
    """
    rows = stream.select(F.col(unit).cast("string").alias("unit_id"), variant.alias("variant"), F.col(ts).alias("exposure_ts"))
    return rows.groupBy("unit_id", "variant").agg(F.min("exposure_ts").alias("exposure_ts"), F.count(F.lit(1)).alias("n_rows"))


def daily_totals(stream: DataFrame, variant: Column, ts: str, value: Column, lag: str) -> DataFrame:
    """Tumbling UTC days per variant: events, sum, sum of squares; a day is final ``lag`` after its end."""
    rows = stream.select(F.col(ts).cast("timestamp").alias("__ts"), variant.alias("variant"), value.cast("double").alias("__v")).withWatermark("__ts", lag)
    return rows.groupBy(F.window("__ts", "1 day").alias("w"), "variant").agg(
        F.count(F.lit(1)).alias("n"), F.sum("__v").alias("sum_value"), F.sum(F.col("__v") * F.col("__v")).alias("sum_value_sq")).select(
        F.to_date("w.start").alias("day"), "variant", "n", "sum_value", "sum_value_sq")


def keep_day_state(stream: DataFrame, store, series: tuple[str, str], zone: str, ts: str, value: Column, version: Column | None = None) -> DataStreamWriter:
    """Advance the day state by micro-batches.

    A batch's sums per (unit, day) are kept under its number, so a batch that runs again
    replaces itself.  The days it touches are then put together from all batches' sums:
    a day may come in any number of batches, late ones included.
    """

    def advance(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        here = type(store)(batch.sparkSession, store.database, store.prefix)  # a stream runs in a session of its own
        own = {"source_table": F.lit(series[0]), "column_set_id": F.lit(series[1])}
        parts = day_state(batch, zone, ts, value).select("unit_id", "day", "sum_value", "sum_cov", "sum_denominator").withColumns(own | {"batch": F.lit(batch_id)})
        here.replace_partitions("unit_state_batches", parts)
        touched = parts.select("day").distinct()
        kept = here.raw("unit_state_batches").filter((F.col("column_set_id") == series[1]) & (F.col("source_table") == series[0])).join(F.broadcast(touched), "day", "left_semi")
        v, x, d = (F.sum(c) for c in ("sum_value", "sum_cov", "sum_denominator"))
        rows = kept.groupBy("unit_id", "day").agg(
            F.lit(1).cast("long").alias("n"), v.alias("sum_value"), (v * v).alias("sum_value_sq"), x.alias("sum_cov"), (x * x).alias("sum_cov_sq"), (v * x).alias("sum_value_cov"),
            d.alias("sum_denominator"), (d * d).alias("sum_denominator_sq"), (v * d).alias("sum_value_denominator"))
        here.replace_day(rows.withColumns(own | {"version": version if version is not None else F.timestamp_seconds(F.lit(batch_id + 1))}))
        for table in ("unit_state", "unit_state_batches"):
            store.spark.catalog.refreshTable(store.name(table))

    return stream.writeStream.foreachBatch(advance)
