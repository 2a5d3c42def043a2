"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions.scratch import saved, scratch_dir  # noqa: F401  (used by the operators)

#: The six white-space characters of ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"


def hex_bucket(key: Column, digits: int) -> Column:
    """A string of ``digits`` hex digits spread evenly over the values of ``key``."""
    return F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, digits)


def ranked(df: DataFrame, group: str, order: list[str], bucket: Column, out: str) -> DataFrame:
    """Add ``out``: each row's rank in its group, gapless from 0.

    A group may hold any share of the rows.  It is split by ``bucket``; rows are numbered
    within (group, bucket), and the buckets' counts, a table of (groups x buckets) rows,
    give each bucket its start.  Rows rank by bucket, then by ``order``.
    """
    rows = df.withColumn("__b", bucket)
    sizes = rows.groupBy(group, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col(group).alias("__g"), F.col("__b").alias("__gb"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(group, "__b").orderBy(*order)
    numbered = rows.withColumn("__r", F.row_number().over(inside))
    joined = numbered.join(starts, (F.col(group) == F.col("__g")) & (F.col("__b") == F.col("__gb")))
    return joined.withColumn(out, F.col("__start") + F.col("__r") - 1).drop("__b", "__g", "__gb", "__start", "__r")


#: Ids that are broadcast at most.
SMALL_IDS = 1 << 20


def having(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``id`` is among the one column of ``ids``.

    The distinct ids are counted first: up to ``SMALL_IDS`` of them are broadcast, and ``df``
    does not move; beyond that both sides are dealt by id.
    """
    one = saved(ids.select(F.col(ids.columns[0]).alias("__one")).distinct())
    side = F.broadcast(one) if one.count() <= SMALL_IDS else one.hint("merge")
    return df.join(side, df["id"] == side["__one"], "left_semi")


def small_batches(batches, sizes, limit: int = 4 << 20, per_row: int = 64, per_byte: int = 1):
    """Slice Arrow batches so that each slice needs about ``limit`` bytes.

    A row needs ``per_row`` bytes, and ``per_byte`` for each byte of the column ``sizes``, or
    of several such columns.
    """
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = sizes if isinstance(sizes, tuple) else (sizes,)
        lengths = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
        part = np.cumsum(lengths * per_byte + per_row) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
