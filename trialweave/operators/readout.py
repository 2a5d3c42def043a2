"""Decisions at read time: verdicts, guardrails, rollups, and the dashboard relations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions.columns import finite

SERIES = ["metric", "name_1", "name_2"]
#: Looks that a verdict needs, and the days its stabilization window reaches back.
LEAST_LOOKS = 3


def latest(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The last row of each series, one aggregate and no sort."""
    by = by or SERIES
    rest = [c for c in results.columns if c not in by]
    return results.groupBy(*by).agg(F.max_by(F.struct(*rest), "end_ts").alias("r")).select(*by, "r.*")


def informative() -> Column:
    return ~F.col("insufficient_data") & finite(F.col("left_bound")).isNotNull() & finite(F.col("right_bound")).isNotNull()


def excludes_zero() -> Column:
    return F.coalesce((F.col("left_bound") > 0) | (F.col("right_bound") < 0), F.lit(False))


def declared_only(results: DataFrame, declared: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of declared series, and the keys of the others with their row counts."""
    known = declared.select(*keys).distinct()
    other = results.join(known, keys, "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return results.join(known, keys, "left_semi"), other


def stabilization(results: DataFrame, days: float, by: list[str] | None = None) -> DataFrame:
    """Per series over the informative looks of the last ``days`` (at least the last three): counts, significance, signs.

    Wants ``significant`` and ``sign`` per row.
    """
    by = by or SERIES
    last = F.max("elapsed_days").over(Window.partitionBy(*by))
    rows = results.withColumn("__last", last).filter(informative())
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("end_ts").desc()))
    window = rows.withColumn("__rank", rank).filter((F.col("elapsed_days") >= F.col("__last") - days) | (F.col("__rank") <= LEAST_LOOKS))
    return window.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_looks"), F.every("significant").alias("all_significant"), F.some("significant").alias("any_significant"),
        F.countDistinct("sign").alias("n_signs"), F.max("sign").alias("max_sign"))


def guardrails(results: DataFrame) -> DataFrame:
    """Each guardrail's status at its latest informative look: its own interval against the desired direction."""
    rows = latest(results.filter(F.col("is_guardrail") & informative()))
    worse = F.when(F.col("desired") >= 0, F.col("right_bound") < 0).otherwise(F.col("left_bound") > 0)
    return rows.select(*SERIES, "effect", "left_bound", "right_bound", F.when(worse, "regressed").otherwise("ok").alias("status"))


def verdicts(results: DataFrame, control: str, days: float = 7.0, policy: str = "block", read_time: bool = False) -> DataFrame:
    """WIN, LOSE, FLAT or INCONCLUSIVE for every (main metric, pair), with the deciding reason.

    ``results`` rows carry ``significant``, ``sign``, ``desired`` (+1 or -1), ``min_effect``,
    ``mde`` and the contract's flags.  The gates apply in a fixed order; the first that
    matches decides.
    """
    main = results.filter("is_main_metric")
    bad = guardrails(results).filter("status = 'regressed'").groupBy("name_1", "name_2").agg(F.sort_array(F.collect_set("metric")).alias("regressed"))
    row = latest(main).join(stabilization(main, days), SERIES, "left").join(bad, ["name_1", "name_2"], "left")
    wins = F.col("max_sign") == F.col("desired")
    blocked = F.col("regressed").isNotNull() & F.lit(policy == "block") & (F.col("name_1") == control)
    steady = F.coalesce("all_significant", F.lit(False)) & (F.col("n_signs") == 1)
    half = (F.col("right_bound") - F.col("left_bound")) / 2.0
    gates = [
        (F.col("srm_flag") | F.col("decision_blocked"), "INCONCLUSIVE", "srm"),
        (~F.col("is_horizon") & (F.col("ci_kind") == "fixed"), "INCONCLUSIVE", "before horizon"),
        (~informative(), "INCONCLUSIVE", "insufficient data"),
        (F.coalesce("n_looks", F.lit(0)) < LEAST_LOOKS, "INCONCLUSIVE", "too few looks"),
        (steady & wins & blocked, "INCONCLUSIVE", "guardrail"),
        (steady & wins, "WIN", "significant"),
        (steady, "LOSE", "significant"),
        (F.coalesce("any_significant", F.lit(False)), "INCONCLUSIVE", "unstable"),
        (F.lit(read_time) & excludes_zero(), "INCONCLUSIVE", "correction disagrees"),
        (F.col("min_effect").isNull(), "INCONCLUSIVE", "no minimum effect"),
        ((F.col("ci_kind") == "always_valid") & (half <= F.col("min_effect")), "FLAT", "narrow interval"),
        (F.col("ci_kind") == "always_valid", "INCONCLUSIVE", "wide interval"),
        (finite(F.col("mde")).isNull(), "INCONCLUSIVE", "no mde"),
        (F.col("mde") <= F.col("min_effect"), "FLAT", "powered"),
    ]
    verdict, reason = F, F
    for test, v, why in gates:
        verdict, reason = verdict.when(test, v), reason.when(test, why)
    return row.select(
        *SERIES, "end_ts", "effect", "left_bound", "right_bound", "desired", F.coalesce("n_looks", F.lit(0)).alias("n_looks"),
        verdict.otherwise("INCONCLUSIVE").alias("verdict"), reason.otherwise("underpowered").alias("reason"),
        F.coalesce("regressed", F.array().cast("array<string>")).alias("regressed"))


def rollup(verdict_rows: DataFrame, control: str, arms: list[str]) -> DataFrame:
    """Per main metric: the leader among winners, the losers, and whether the leader is separated from the others."""
    spark = verdict_rows.sparkSession
    order = F.broadcast(spark.createDataFrame([(i, a) for i, a in enumerate(arms)], "ord int, name_2 string"))
    ship = verdict_rows.filter(F.col("name_1") == control).join(order, "name_2")
    gain = F.col("effect") * F.col("desired")
    won = F.col("verdict") == "WIN"
    top = ship.groupBy("metric").agg(
        F.max_by("name_2", F.when(won, F.struct(gain, -F.col("ord")))).alias("leader"),
        F.sort_array(F.collect_list(F.when(won, F.col("name_2")))).alias("winners"),
        F.sort_array(F.collect_list(F.when(F.col("verdict") == "LOSE", F.col("name_2")))).alias("losers"))
    between = verdict_rows.filter((F.col("name_1") != control)).select(
        F.col("metric").alias("m"), F.col("name_1").alias("a"), F.col("name_2").alias("b"), "verdict")
    rival = top.select("metric", "leader", F.explode("winners").alias("rival")).filter("rival != leader")
    met = rival.join(between, (F.col("metric") == F.col("m")) & (
        (F.col("a") == F.col("rival")) & (F.col("b") == F.col("leader")) | (F.col("a") == F.col("leader")) & (F.col("b") == F.col("rival"))), "left")
    beats = F.when(F.col("b") == F.col("leader"), F.col("verdict") == "WIN").otherwise(F.col("verdict") == "LOSE")
    state = met.groupBy("metric").agg(F.every(F.col("m").isNotNull()).alias("tested"), F.every(F.coalesce(beats, F.lit(False))).alias("clear"))
    separation = (F.when(F.col("leader").isNull(), "no_leader").when(F.col("tested").isNull(), "separated")
                  .when(~F.col("tested"), "untested").when(F.col("clear"), "separated").otherwise("co_leaders"))
    return top.join(state, "metric", "left").select("metric", "leader", "winners", "losers", separation.alias("separation"))


def leaders_agree(rollups: DataFrame) -> DataFrame:
    """Whether all metrics with a leader name the same one; null with fewer than two."""
    return rollups.agg(F.when(F.count("leader") >= 2, F.countDistinct("leader") == 1).alias("leaders_agree"))


def srm_summary(results: DataFrame) -> DataFrame:
    """Whether any latest row is flagged, and the loudest flagged p-value."""
    return latest(results).agg(F.bool_or("srm_flag").alias("srm_flag"), F.min(F.when(F.col("srm_flag"), F.col("srm_pvalue"))).alias("srm_pvalue"))


def mixed_alphas(results: DataFrame) -> DataFrame:
    return results.agg((F.countDistinct("alpha") > 1).alias("mixed_alphas"))


def spark_series(results: DataFrame, buckets: int, by: list[str] | None = None) -> DataFrame:
    """Each series strided into at most ``buckets`` points: mean effect and last look."""
    by = by or SERIES
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("end_ts")) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    rows = results.filter(F.col("effect").isNotNull()).withColumn("__stride", F.ceil(n / F.lit(float(buckets)))).withColumn("bucket", F.floor(rank / F.col("__stride")).cast("int"))
    return rows.groupBy(*by, "bucket").agg(F.avg("effect").alias("effect"), F.max("end_ts").alias("end_ts"))


def clip_to_budget(results: DataFrame, points: int, by: list[str] | None = None) -> DataFrame:
    """The trailing points of each series under a budget shared evenly."""
    by = by or SERIES
    n = results.select(*by).distinct().agg(F.greatest(F.lit(1), F.floor(F.lit(points) / F.greatest(F.count(F.lit(1)), F.lit(1)))).alias("__allowed"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("end_ts").desc()))
    return results.withColumn("__rank", rank).crossJoin(F.broadcast(n)).filter("__rank <= __allowed").drop("__rank", "__allowed")


def scoreboard(results: DataFrame) -> DataFrame:
    """The headline table: latest row per series and a verdict at its own level."""
    row = latest(results)
    verdict = (F.when(F.col("insufficient_data"), "insufficient_data").when(F.col("decision_blocked") | F.col("srm_flag"), "blocked")
               .when(~F.col("is_horizon") & (F.col("ci_kind") == "fixed"), "running").when(~F.coalesce("reject", F.lit(False)), "no_difference")
               .when(F.col("effect") > 0, "up").otherwise("down"))
    return row.select(*SERIES, "is_main_metric", "is_guardrail", "end_ts", "effect", "left_bound", "right_bound", "pvalue", "alpha", verdict.alias("verdict"))


def report(results: DataFrame) -> DataFrame:
    """One JSON document per metric: its series in order."""
    point = F.struct("end_ts", "effect", "left_bound", "right_bound", "pvalue", "size_1", "size_2")
    series = results.groupBy(*SERIES).agg(F.sort_array(F.collect_list(point)).alias("points"))
    return series.groupBy("metric").agg(F.to_json(F.sort_array(F.collect_list(F.struct("name_1", "name_2", "points")))).alias("payload"))


def report_html(results: DataFrame, title: str = "Experiment") -> str:
    """A page of the latest rows; the table is small."""
    from html import escape

    rows = scoreboard(results).orderBy(F.col("is_main_metric").desc(), *SERIES).collect()
    head = "".join(f"<th>{escape(c)}</th>" for c in rows[0].asDict()) if rows else ""
    body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1><table><tr>{head}</tr>{body}</table>"


def rebuild_moments(results: DataFrame) -> DataFrame:
    """Arm moments of a mean-type row: exact answers to new questions from persisted rows."""
    out = results
    for k in (1, 2):
        n = F.col(f"size_{k}").cast("double")
        out = out.withColumns({f"n_{k}": F.col(f"size_{k}"), f"mean_value_{k}": F.col(f"value_{k}"), f"m2_value_{k}": F.col(f"std_{k}") * F.col(f"std_{k}") * n})
    return out


def invert_fraction(results: DataFrame) -> DataFrame:
    """Counts and trials of a proportion row, from its value and standard error."""
    out = results
    for k in (1, 2):
        p, se = F.col(f"value_{k}"), F.col(f"std_{k}")
        nobs = F.when(se > 0, F.round(p * (1 - p) / F.when(se > 0, se * se)))
        out = out.withColumns({f"nobs_{k}": nobs, f"count_{k}": F.round(nobs * p)})
    return out


def invert_alpha(results: DataFrame, alpha: float) -> DataFrame:
    """Symmetric fixed intervals at a new level, from the stored width and level alone."""
    from trialweave.functions.normal import critical

    spark = results.sparkSession
    old = [r[0] for r in results.select("alpha").distinct().collect()]  # a few configured levels
    known = F.broadcast(spark.createDataFrame([(a, critical(a)) for a in old if a is not None], "a double, z double"))
    half = F.col("ci_length") / 2.0 * F.lit(critical(alpha)) / F.col("z")
    usable = F.col("ci_kind") == "fixed"
    put = lambda c: F.when(usable, c)
    return results.join(known, F.col("alpha") == F.col("a"), "left").withColumns({
        "left_bound": put(F.col("effect") - half), "right_bound": put(F.col("effect") + half), "ci_length": put(2.0 * half),
        "reject": F.coalesce(F.col("pvalue") < alpha, F.lit(False)), "alpha": F.lit(alpha)}).drop("a", "z")


def find_calibration(runs: DataFrame, alpha: float) -> DataFrame:
    """The newest successful calibration per (metric, method) at this level."""
    ok = runs.filter((F.abs(F.col("alpha") - alpha) < 1e-12) & (F.col("status") == "ok"))
    rest = [c for c in runs.columns if c not in ("metric", "method_config_id")]
    return ok.groupBy("metric", "method_config_id").agg(F.max_by(F.struct(*rest), "created_at").alias("r")).select("metric", "method_config_id", "r.*")


def announce(states: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Which verdicts differ from what was announced last."""
    old = states.select(*keys, F.col("last_verdict"), F.col("last_srm_flag"), F.col("last_rollup"))
    same = F.col("verdict").eqNullSafe(F.col("last_verdict")) & F.col("srm_flag").eqNullSafe(F.col("last_srm_flag")) & F.col("rollup").eqNullSafe(F.col("last_rollup"))
    return now.join(old, keys, "left").withColumn("announce", ~same).drop("last_verdict", "last_srm_flag", "last_rollup")


def cooled(last: Column, signature: Column, last_signature: Column, seconds: int, now: Column) -> Column:
    """Whether a recurring signal may be sent: a new signature, or the same after the cooldown."""
    return ~signature.eqNullSafe(last_signature) | last.isNull() | (F.timestamp_diff("SECOND", last, now) >= seconds)


def finite_or_infinite(x: float) -> float | None:
    return x if math.isfinite(x) else None


def ci_kinds(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The kinds of interval that each series carries over its judged rows; more than one asks for a new plan."""
    by = by or SERIES
    return results.filter(~F.col("insufficient_data")).groupBy(*by).agg(F.sort_array(F.collect_set("ci_kind")).alias("ci_kinds"))


def backlog_seconds(results: DataFrame, due: DataFrame) -> DataFrame:
    """How far the last computed look lies behind the last due one (not behind the clock, after the horizon)."""
    done = results.agg(F.max("end_ts").alias("done"))
    return due.agg(F.max("end_ts").alias("due")).crossJoin(done).select(F.timestamp_diff("SECOND", "done", "due").alias("backlog_seconds"))


def signals(verdict: Column, srm_flag: Column, regressed: Column) -> Column:
    """The kinds of signal that a verdict row raises."""
    return F.array_compact(F.array(
        F.when(verdict.isin("WIN", "LOSE", "FLAT"), F.lit("verdict")), F.when(srm_flag, F.lit("srm")), F.when(F.size(regressed) > 0, F.lit("guardrail"))))
