"""Line dedup over overlapping three-line windows, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.common import saved

#: Lines in a window.
SPAN = 3


def once(value, use):
    """``use(value)`` with ``value`` computed once in a row, however often ``use`` reads it, also in a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """Where later occurrences of repeated windows start: (``__id``, ``__starts`` sorted array of line numbers from 1).

    A window is ``span`` consecutive lines, known by two independent 64-bit hashes of its
    lines' hashes; each line is hashed once.  Its first occurrence has the smallest (id,
    line), a null id last; every other one is later.
    """
    lines = F.split(F.col("t"), "\n", -1)
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")).alias("solid")))

    def window(x, i):
        own = [F.get(x, i + k) for k in range(span)]
        solid = own[0]["solid"]
        for o in own[1:]:
            solid = solid | o["solid"]
        return F.struct((i + 1).alias("p"), solid.alias("solid"), F.xxhash64(*[o["a"] for o in own]).alias("h1"), F.xxhash64(F.lit(1), *[o["b"] for o in own]).alias("h2"))

    windows = once(hashed, lambda x: F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - F.lit(span), F.lit(0))), lambda i: window(x, i)), lambda w: w["solid"]))
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).filter(F.size(lines) >= span)
    found = saved(base.select("id", F.explode(windows).alias("x")).select("id", "x.p", "x.h1", "x.h2"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "p")
    groups = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last")
    groups = groups.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first")
    later = found.join(groups, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).filter(place > F.col("first"))
    return later.groupBy("id").agg(F.sort_array(F.collect_set("p")).alias("__starts")).withColumnRenamed("id", "__id")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """``docs`` with repeated passages of ``span`` or more lines cut from all but their first place.

    Lines end at ``\n``; windows of blank lines only do not count.  All lines that some
    later occurrence covers are removed, overlapping ones merged, and the rest joined by
    ``\n``; a text may become empty, its row stays.  What is left lies between the sorted
    starts of covered windows, so a text is put together from slices, in time linear in it.
    A null text, an empty one, and one of fewer than ``span`` lines stay as they are.  Rows
    that repeat an id are one document: their windows count at one place, and lines cut from
    one are cut from all.  Adds ``__n_lines`` and ``__n_removed``; other columns pass through
    whatever their names.  An empty table gives an empty result.
    """
    gone = repeated_lines(docs, id_col, text_col, span)
    joined = docs.join(gone, docs[id_col].eqNullSafe(gone["__id"]), "left")
    text = F.col(f"`{text_col}`")
    starts = F.col("__starts")

    def rest(lines):
        """The lines between one covered window's end and the next one's start, as (text, number)."""
        ranges = F.zip_with(
            F.concat(F.array(F.lit(1 - span)), starts), F.concat(starts, F.array(F.size(lines) + 1)),
            lambda before, after: F.struct((before + span).alias("at"), F.least(after, F.size(lines) + 1).alias("to")))
        kept = F.filter(ranges, lambda r: r["at"] < r["to"])
        pieces = F.flatten(F.transform(kept, lambda r: F.slice(lines, r["at"], r["to"] - r["at"])))
        return once(pieces, lambda x: F.struct(F.array_join(x, "\n").alias("text"), F.size(x).alias("n"), F.size(lines).alias("all")))

    whole = F.struct(text.alias("text"), F.size(F.split(text, "\n", -1)).alias("n"), F.size(F.split(text, "\n", -1)).alias("all"))
    done = joined.withColumn("__done", F.when(text.isNull() | starts.isNull(), whole).otherwise(once(F.split(text, "\n", -1), rest)))
    total = F.when(text.isNull(), F.lit(0)).otherwise(F.col("__done.all"))
    return done.select(
        *[(F.col("__done.text").alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns],
        total.alias("__n_lines"), F.when(text.isNull(), F.lit(0)).otherwise(F.col("__done.all") - F.col("__done.n")).alias("__n_removed"))


ORACLE = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (
  SELECT doc_id, p, lines[p] || chr(10) || lines[p + 1] || chr(10) || lines[p + 2] AS win
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS p FROM l WHERE len(lines) >= 3)),
o AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS k
  FROM w WHERE regexp_matches(win, '[^\x20\x09-\x0D]')),
c AS (SELECT DISTINCT doc_id, p + d AS p FROM o, (SELECT unnest([0, 1, 2]) AS d) WHERE k > 1),
g AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id)
SELECT l.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(lines) END AS n_lines, coalesce(len(gone), 0) AS n_removed,
       CASE WHEN gone IS NULL THEN text
            ELSE array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i: NOT list_contains(gone, i)), lambda i: lines[i]), chr(10)) END AS text
FROM l LEFT JOIN g USING (doc_id)
"""
