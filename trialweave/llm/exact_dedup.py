"""Exact dedup by a tree merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.common import BLANKS, saved


#: Runs that meet in one merge: two binomial exchanges at a time.
FAN = 4


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None) -> DataFrame:
    """Decide for every row whether it stays among the rows of equal text.

    Texts are equal when equal without white space (``[\\x20\\x09-\\x0D]``).  A text is known
    by its SHA-256 digest, verified at every level by its size in bytes and a second,
    independent hash: entries merge only where all three agree.  Rows are dealt to ``FAN **
    rounds`` runs, as many as the table has partitions, or more.  Every run is sorted and
    reduced to one entry for each text; then, in each round, ``FAN`` runs meet (run ``4i`` to
    ``4i+3``) and are merged, an entry keeping the best row so far and the number of rows
    seen.  A group with a third of all rows is thus spread over all runs first and only
    shrinks after that.  The winners go back down to the first runs, and a row looks up its
    text in its own run.

    Best is the row with the most code points, then the smallest id (a null id is last),
    then, of rows that repeat both, one.

    Returns ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, one row per
    input row; in each group exactly one row is kept.  Null text counts as empty; all empty
    texts are one group.  Other columns are not read, so their names cannot clash.  An empty
    table gives an empty result.
    """
    out = _judged(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), rounds)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _judged(docs: DataFrame, rounds: int | None, *more: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = F.translate(text, BLANKS, "")
    rows = saved(docs.select(
        "id", *more, F.unhex(F.sha2(plain, 256)).alias("digest"), F.octet_length(plain).alias("bytes"), F.xxhash64(plain).alias("check"),
        (-F.char_length(text)).alias("shorter"), F.monotonically_increasing_id().alias("row")))
    if rounds is None:
        # The row's number holds its partition's above 33 bits.
        runs, rounds = (rows.agg(F.max(F.shiftright("row", 33))).first()[0] or 0) + 1, 2
        while FAN ** rounds < runs:
            rounds += 1
    key = ["digest", "bytes", "check"]
    rows = rows.withColumn("run", F.pmod(F.xxhash64("row"), F.lit(FAN ** rounds)).cast("int"))
    rank = F.struct("shorter", F.col("id").isNull().alias("none"), "id", "row")
    level = leaves = rows.groupBy(*key, "run").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n"))
    for _ in range(rounds):
        level = level.groupBy(*key, F.floor(F.col("run") / FAN).cast("int").alias("run")).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    top = level.select(*[F.col(k).alias(f"t_{k}") for k in key], "best", F.col("n").alias("group_size"))
    down = leaves.select(*key, "run").join(top, _same(key, "t_")).select(*[F.col(f"t_{k}").alias(f"d_{k}") for k in key], F.col("run").alias("d_run"), "best", "group_size")
    found = rows.join(down, _same([*key, "run"], "d_"))
    return found.select("id", *more, F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "digest")


def _same(names: list[str], prefix: str):
    return functools.reduce(lambda a, b: a & b, (F.col(n) == F.col(prefix + n) for n in names))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None) -> DataFrame:
    """The rows that :func:`exact_dedup` keeps, one of each group; all columns stay."""
    kept = _judged(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")), rounds, "whole")
    return kept.filter("kept").select("whole.*")


ORACLE = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS body,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(body) DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM k
"""
