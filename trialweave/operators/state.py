"""Materialised state: versions, per-day unit state, incremental reads and their audit."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOMENTS = ("n", "sum_value", "sum_value_sq", "sum_cov", "sum_cov_sq", "sum_value_cov", "sum_denominator", "sum_denominator_sq", "sum_value_denominator")
REL, ABS = 1e-9, 1e-12


def last_write_wins(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest version of every key: one aggregate with partial combination."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r")).select(*keys, "r.*")


def day_state(facts: DataFrame, zone: str, ts: str, value: Column, denominator: Column | None = None, covariate: Column | None = None) -> DataFrame:
    """Additive per-(unit, local day) moments of a metric's daily value."""
    day = F.to_date(F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone)) if zone != "UTC" else F.to_date(ts)
    daily = facts.groupBy("variant", "unit_id", day.alias("day")).agg(
        value.alias("v"), (denominator if denominator is not None else F.lit(0.0)).alias("d"), (covariate if covariate is not None else F.lit(0.0)).alias("x"))
    v, d, x = F.col("v"), F.col("d"), F.col("x")
    return daily.select(
        "variant", "unit_id", "day", F.lit(1).cast("long").alias("n"), v.alias("sum_value"), (v * v).alias("sum_value_sq"), x.alias("sum_cov"), (x * x).alias("sum_cov_sq"),
        (v * x).alias("sum_value_cov"), d.alias("sum_denominator"), (d * d).alias("sum_denominator_sq"), (v * d).alias("sum_value_denominator"))


def cumulative(state: DataFrame, first: date, last: date) -> DataFrame:
    """Per-unit sums over closed days; the day predicate prunes partitions."""
    picked = state.filter(F.col("day").between(F.lit(first), F.lit(last)))
    return picked.groupBy("unit_id").agg(*[F.sum(c).alias(c) for c in MOMENTS])


def total(state: DataFrame, first: date, last: date) -> DataFrame:
    """Sums of the moment columns over a range of days."""
    return state.filter(F.col("day").between(F.lit(first), F.lit(last))).agg(*[F.sum(c).alias(c) for c in MOMENTS])


def with_tail(closed: DataFrame, tail: DataFrame, cohort: DataFrame) -> DataFrame:
    """Closed-day sums plus the open day's, mapped to the live cohort's arms; unmapped units drop."""
    both = closed.select("unit_id", *MOMENTS).unionByName(tail.select("unit_id", *MOMENTS)).groupBy("unit_id").agg(*[F.sum(c).alias(c) for c in MOMENTS])
    return both.join(cohort.select("unit_id", "variant"), "unit_id")


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str], rel: float = REL, absolute: float = ABS) -> DataFrame:
    """Keys whose rows differ beyond tolerance, or exist on one side only."""
    left = a.select(*keys, *[F.col(f).alias(f"{f}_a") for f in fields], F.lit(True).alias("in_a"))
    right = b.select(*keys, *[F.col(f).alias(f"{f}_b") for f in fields], F.lit(True).alias("in_b"))
    near = F.lit(True)
    for f in fields:
        x, y = F.col(f"{f}_a"), F.col(f"{f}_b")
        close = F.abs(x - y) <= F.greatest(F.lit(rel) * F.greatest(F.abs(x), F.abs(y)), F.lit(absolute))
        near = near & F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).otherwise(close)
    joined = left.join(right, keys, "full")
    status = F.when(F.col("in_a").isNull(), "only_b").when(F.col("in_b").isNull(), "only_a").when(near, "equal").otherwise("different")
    return joined.withColumn("status", status).drop("in_a", "in_b")


def complete_looks(results: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Looks that carry every declared pair (relational division)."""
    spark = results.sparkSession
    need = F.broadcast(spark.createDataFrame(pairs, "name_1 string, name_2 string"))
    have = results.select("metric", "end_ts", "name_1", "name_2").join(need, ["name_1", "name_2"], "left_semi")
    return have.groupBy("metric", "end_ts").agg(F.countDistinct("name_1", "name_2").alias("n_pairs")).filter(F.col("n_pairs") == len(pairs))


def settled(stored: DataFrame, sequential: bool, interval_free: list[str] | None = None) -> DataFrame:
    """Keys of the stored rows that stand: judged rows whose kind of interval is the one now asked for.

    Series that have changed between fixed and always-valid intervals are computed anew as a
    whole.  ``interval_free`` are method identities that have fixed intervals either way.
    """
    keys = ["metric", "method_config_id", "name_1", "name_2"]
    wanted = F.when(F.col("method_config_id").isin(interval_free or []), "fixed").otherwise("always_valid" if sequential else "fixed")
    judged = ~F.col("insufficient_data") & F.col("left_bound").isNotNull()
    changed = stored.filter(judged & (F.col("ci_kind") != wanted)).select(*keys).distinct()
    return stored.join(changed, keys, "left_anti").select(*keys, "end_ts")


def orphans(stored: DataFrame, configured: DataFrame, keys: list[str]) -> DataFrame:
    """Stored series that no configuration claims, with their rows."""
    return stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).join(configured.select(*keys).distinct(), keys, "left_anti")


def counts_per_table(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per experiment in each keyed table."""
    parts = [df.groupBy("experiment").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("table", F.lit(name)) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Aggregates whose per-day values add up.
ADDITIVE = frozenset({"sum", "count"})


def aggregates_of(spark, expression: str) -> set[str]:
    """The names of the functions that SQL text calls, from the parser's tree."""
    found, stack = set(), [spark._jsparkSession.sessionState().sqlParser().parseExpression(expression)]
    while stack:
        node = stack.pop()
        if node.nodeName() == "UnresolvedFunction":
            names = node.nameParts()
            found.add(names.apply(names.size() - 1).lower())
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return found


def additive_text(spark, expression: str) -> bool:
    """Whether SQL text sums or counts only: its outermost function does, and no other aggregate stands in it."""
    functions = aggregates_of(spark, expression)
    known = {r[0].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()}
    others = functions & known & {"avg", "mean", "max", "min", "median", "percentile", "approx_count_distinct", "stddev", "variance", "var_pop", "var_samp", "corr", "first", "last", "any_value", "collect_list", "collect_set", "count_distinct"}
    return bool(functions & ADDITIVE) and not others and "distinct" not in expression.lower().split("(", 1)[-1].split()


def backend(metrics: Mapping[str, Mapping[str, tuple[str, Column]]], has_state: bool) -> dict[str, tuple[str, str]]:
    """How each metric's looks are computed, and why: from day state where it adds up and is kept, else from facts."""
    out = {}
    for name, roles in metrics.items():
        if not is_additive(roles):
            out[name] = ("recompute", "an aggregate does not add up over days")
        else:
            out[name] = ("state", "sums of closed days and a tail") if has_state else ("recompute", "no day state is kept")
    return out


def is_additive(roles: Mapping[str, tuple[str, Column]]) -> bool:
    """Whether day state can serve a metric; declared kinds decide, no text is searched."""
    return bool(roles) and all(kind in ADDITIVE for kind, _ in roles.values())
