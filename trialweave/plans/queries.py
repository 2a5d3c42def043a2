"""The registered queries of the experiment engine, with SQL to check them."""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialweave.functions import identity, power
from trialweave.functions.columns import div, rounded
from trialweave.functions.normal import critical, two_sided
from trialweave.functions.scratch import saved
from trialweave.functions.score import with_score_interval
from trialweave.operators import calibrate, closed_form, corrections, readout, resample, state
from trialweave.operators import cohort as cohorts
from trialweave.operators import facts as fact_ops
from trialweave.operators.grid import closed_bound, make_grid, pending
from trialweave.operators.moments import arm_moments, contrasts, merge, moments_by_look, pair_up
from trialweave.plans import demo, oracles
from trialweave.plans.demo import GRID, PAIRS, VARIANTS, table
from trialweave.plans.experiment import results as run_results
from trialweave.plans.oracles import A, BASE, LATEST, RESULTS, on_results, r

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, digits: int = 6):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


VALUE = {"value": ("sum", "spend")}
RATIO = {"num": ("sum", "spend"), "den": ("count", "1")}
FRACTION = {"count": ("max", "signup"), "nobs": ("max", "1.0D")}
TEST = ["look", "name_1", "name_2", "effect", "left_bound", "right_bound", "ci_length", "pvalue", "reject"]


def fraction_pairs(spark, d):
    p = demo.pairs(spark, d, FRACTION)
    return p.withColumns({f"{k}_{i}": F.col(f"mean_{k}_{i}") * F.col(f"n_{i}") for k in ("count", "nobs") for i in (1, 2)})


# -- cohort ---------------------------------------------------------------------------------


@query(f"WITH {BASE} SELECT * FROM cohort")
def cohort_dedup(spark, d):
    return demo.cohort(spark, d)


@query("""WITH a AS (SELECT CAST(user_id AS VARCHAR) AS unit_id, CASE WHEN event_type = 'click' THEN 'a' ELSE 'b' END AS variant FROM events WHERE event_type IN ('click', 'view'))
SELECT unit_id, count(DISTINCT variant) AS n_variants FROM a GROUP BY 1 HAVING count(DISTINCT variant) > 1""")
def cohort_conflicts(spark, d):
    e = table(spark, d, "events").filter(F.col("event_type").isin("click", "view"))
    a = e.select(F.col("user_id").cast("string").alias("unit_id"), F.when(F.col("event_type") == "click", "a").otherwise("b").alias("variant"), F.col("ts").alias("exposure_ts"))
    return cohorts.conflicts(cohorts.dedup(a))


@query(f"WITH {BASE} SELECT variant, count(*) AS n_units FROM cohort GROUP BY 1")
def cohort_counts(spark, d):
    return cohorts.counts(demo.cohort(spark, d))


@query(f"""WITH {BASE}, w AS (SELECT date_diff('second', min(exposure_ts), max(exposure_ts)) AS s, epoch_us(max(exposure_ts)) - epoch_us(min(exposure_ts)) AS us FROM cohort)
SELECT variant, round(count(*) / (floor(us / 1e6) / 86400.0), 6) AS per_day, round(floor(us / 1e6) / 86400.0, 6) AS window_days FROM cohort, w GROUP BY variant, us""")
def arrival_rate(spark, d):
    return cohorts.arrival_rate(demo.cohort(spark, d))


@query(f"WITH {RESULTS} SELECT * FROM arm_counts")
def exposure_count_stream(spark, d):
    return cohorts.counts_by_look(demo.cohort(spark, d), GRID, VARIANTS)


# -- grid -----------------------------------------------------------------------------------


@query(f"WITH {BASE} SELECT look, end_ts, is_horizon, elapsed_days FROM looks")
def grid_daily(spark, d):
    return GRID.frame(spark)


@query("""WITH s AS (SELECT TIMESTAMP '2024-01-08' + i * INTERVAL 6 HOUR AS end_ts FROM range(1, 9) t(i) UNION SELECT TIMESTAMP '2024-01-08' + i * INTERVAL 1 DAY FROM range(3, 24) t(i))
SELECT CAST(row_number() OVER (ORDER BY end_ts) - 1 AS INTEGER) AS look, end_ts, end_ts = TIMESTAMP '2024-01-31' AS is_horizon, epoch(end_ts - TIMESTAMP '2024-01-08') / 86400 AS elapsed_days FROM s""")
def grid_schedule(spark, d):
    return make_grid(demo.START, demo.HORIZON, (("6h", "2d"), ("1d", None))).frame(spark)


@query("SELECT CAST(i AS INTEGER) AS look, (TIMESTAMP '2024-03-05 00:00:00' + i * INTERVAL 1 DAY - CASE WHEN i <= 5 THEN INTERVAL '-5' HOUR ELSE INTERVAL '-4' HOUR END) AS end_ts FROM range(10) t(i)")
def grid_local_days(spark, d):
    """New York days over the change to summer time of 2024-03-10."""
    return make_grid(date(2024, 3, 4), date(2024, 3, 14), "1d", "America/New_York").frame(spark).select("look", "end_ts")


@query(f"WITH {RESULTS} SELECT look, end_ts FROM looks WHERE end_ts <= TIMESTAMP '2024-01-28 12:00:00' AND end_ts NOT IN (SELECT end_ts FROM results WHERE is_main_metric AND end_ts < TIMESTAMP '2024-01-20')")
def pending_cutoffs(spark, d):
    done = results(spark, d).filter((F.col("is_main_metric")) & (F.col("end_ts") < F.lit(datetime(2024, 1, 20)).cast("timestamp_ntz")))
    return pending(GRID.frame(spark), done, datetime(2024, 1, 28, 12)).select("look", "end_ts")


# -- facts and units ------------------------------------------------------------------------


@query(f"WITH {BASE} SELECT unit_id, variant, ts, event_type, round(spend, 6) + 0.0 AS spend FROM x")
def exposed_facts(spark, d):
    x = demo.exposed(spark, d)
    return x.select("unit_id", "variant", "ts", "event_type", "spend")


@query(f"WITH {BASE} SELECT unit_id, round(covariate, 6) + 0.0 AS covariate FROM cov")
def preperiod_covariate(spark, d):
    return demo.covariate(spark, d)


@query(f"WITH {BASE} SELECT look, variant, unit_id, round(value, 6) + 0.0 AS value FROM units")
def unit_metric_sum(spark, d):
    return fact_ops.unit_panel(fact_ops.running_units(demo.exposed(spark, d), GRID, "ts", VALUE), GRID, VALUE)


@query(f"WITH {BASE} SELECT look, variant, unit_id, conv AS count FROM units")
def unit_metric_max(spark, d):
    roles = {"count": ("max", "signup")}
    return fact_ops.unit_panel(fact_ops.running_units(demo.exposed(spark, d), GRID, "ts", roles), GRID, roles)


@query(f"WITH {BASE} SELECT look, variant, unit_id, count(DISTINCT event_type) AS kinds, round(median(spend), 6) + 0.0 AS mid FROM looks JOIN x ON x.ts < looks.end_ts GROUP BY 1, 2, 3")
def unit_metric_distinct(spark, d):
    return fact_ops.unit_looks_any(demo.exposed(spark, d), GRID, "ts", {"kinds": F.countDistinct("event_type"), "mid": F.median("spend")})


@query("SELECT 'population' AS variant, CAST(user_id AS VARCHAR) AS unit_id, round(sum(CASE WHEN event_type = 'purchase' THEN value * 1.0123456789 * CASE WHEN user_id % 3 = 2 THEN 1.6 ELSE 1.0 END ELSE 0.0 END), 6) + 0.0 AS value FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-08' GROUP BY 2")
def population_baseline(spark, d):
    f = fact_ops.population(demo.events(spark, d), "user_id", "ts", datetime(2024, 1, 1), datetime(2024, 1, 8))
    return fact_ops.unit_metric(f, {"value": F.sum("spend")})


# -- moments --------------------------------------------------------------------------------


@query(f"WITH {BASE} SELECT look, variant, n::BIGINT AS n, {r('m', 5)}, round(sqrt(v), 5) + 0.0 AS std FROM arms", 5)
def arm_moments_by_look(spark, d):
    run = fact_ops.running_units(demo.exposed(spark, d), GRID, "ts", VALUE)
    return moments_by_look(run, len(GRID.ends), "value").select("look", "variant", "n", F.col("mean_value").alias("m"), F.sqrt(F.col("m2_value") / F.col("n")).alias("std"))


@query(f"WITH {BASE} SELECT look, variant, n::BIGINT AS n, round(sqrt(v), 5) + 0.0 AS std_num, round(sqrt(vd), 5) + 0.0 AS std_den, round(cvd, 5) + 0.0 AS cov FROM arms", 5)
def arm_comoments(spark, d):
    run = fact_ops.running_units(demo.exposed(spark, d), GRID, "ts", RATIO)
    m = moments_by_look(run, len(GRID.ends), "num", "den")
    return m.select(
        "look", "variant", "n", F.sqrt(F.col("m2_num") / F.col("n")).alias("std_num"), F.sqrt(F.col("m2_den") / F.col("n")).alias("std_den"), (F.col("c_num_den") / F.col("n")).alias("cov"))


@query(f"WITH {BASE} SELECT variant, n::BIGINT AS n, {r('m', 5)}, round(sqrt(v), 5) + 0.0 AS std, round(cvx, 5) + 0.0 AS cov FROM arms WHERE look = 22", 5)
def merged_moments(spark, d):
    """Moments of parts, merged."""
    units = fact_ops.running_units(demo.exposed(spark, d), GRID, "ts", VALUE)
    last = fact_ops.with_covariate(fact_ops.unit_panel(units, GRID, VALUE).filter("look = 22"), demo.covariate(spark, d))
    parts = arm_moments(last.withColumn("part", F.pmod(F.crc32(F.col("unit_id").cast("binary")), F.lit(5))), ["variant", "part"], "value", "covariate")
    m = merge(parts, ["variant"], "value", "covariate")
    return m.select("variant", "n", F.col("mean_value").alias("m"), F.sqrt(F.col("m2_value") / F.col("n")).alias("std"), (F.col("c_value_covariate") / F.col("n")).alias("cov"))


@query(f"WITH {BASE} SELECT look, name_1, name_2 FROM p")
def contrast_pairs_all(spark, d):
    return demo.pairs(spark, d, VALUE).select("look", "name_1", "name_2")


@query(f"WITH {BASE} SELECT look, name_1, name_2 FROM p WHERE name_1 = 'control'")
def contrast_pairs_vs_control(spark, d):
    run = fact_ops.running_units(demo.exposed(spark, d), GRID, "ts", VALUE)
    return pair_up(moments_by_look(run, len(GRID.ends), "value"), contrasts(list(VARIANTS), kind="vs_control"), ["look"]).select("look", "name_1", "name_2")


# -- closed-form tests ----------------------------------------------------------------------


@query(oracles.test(oracles.T_ABS))
def ttest_abs(spark, d):
    return closed_form.t_test(demo.pairs(spark, d, VALUE)).select(TEST)


@query(oracles.test(oracles.T_REL))
def ttest_rel_delta(spark, d):
    return closed_form.t_test(demo.pairs(spark, d, VALUE), "relative").select(TEST)


@query(oracles.fieller())
def ttest_rel_fieller(spark, d):
    return closed_form.t_test(demo.pairs(spark, d, VALUE), "relative", "fieller").select(TEST)


@query(f"WITH {BASE}, {oracles.z_test('absolute')} {oracles._OUT}")
def ztest_abs(spark, d):
    return closed_form.z_test(fraction_pairs(spark, d)).select(TEST)


@query(f"WITH {BASE}, {oracles.z_test('relative')} {oracles._OUT}")
def ztest_rel(spark, d):
    return closed_form.z_test(fraction_pairs(spark, d), "relative").select(TEST)


_WEAK = f"CASE WHEN k1 > 0 AND k2 > 0 THEN {critical(A):.17e} * sqrt(1 / k1 + 1 / k2) > 0.5 ELSE TRUE END AS weakly_identified"


@query(f"{oracles.score_interval('absolute')} SELECT look, name_1, name_2, {r('effect', 5)}, round(lo, 5) + 0.0 AS left_bound, round(hi, 5) + 0.0 AS right_bound, round(hi - lo, 5) + 0.0 AS ci_length, {r('pvalue', 5)}, reject, {_WEAK} FROM t JOIN e_ USING (look, name_1, name_2) JOIN p USING (look, name_1, name_2)", 5)
def ztest_score(spark, d):
    return with_score_interval(closed_form.z_test(fraction_pairs(spark, d))).select(*TEST, "weakly_identified")


@query(f"{oracles.score_interval('relative')} SELECT look, name_1, name_2, {r('effect', 4)}, round(lo, 4) + 0.0 AS left_bound, round(hi, 4) + 0.0 AS right_bound, {r('pvalue', 4)} FROM t JOIN e_ USING (look, name_1, name_2) JOIN p USING (look, name_1, name_2) WHERE k1 > 0 AND hi < 1e6", 4)
def ztest_score_relative(spark, d):
    """The ratio's interval where it has an upper bound."""
    rows = with_score_interval(closed_form.z_test(fraction_pairs(spark, d), "relative"), "relative")
    return rows.filter("count_1 > 0 and right_bound < 1e6").select("look", "name_1", "name_2", "effect", "left_bound", "right_bound", "pvalue")


@query(oracles.test(oracles.CUPED_ABS))
def cuped_abs(spark, d):
    return closed_form.cuped(demo.pairs(spark, d, VALUE, True)).select(TEST)


@query(oracles.test(oracles.CUPED_REL))
def cuped_rel(spark, d):
    return closed_form.cuped(demo.pairs(spark, d, VALUE, True), "relative").select(TEST)


@query(f"WITH {BASE}, c AS (SELECT look, name_1, name_2, cx1 / nullif(sqrt(greatest(v1 * vx1, 0)), 0) AS r1, cx2 / nullif(sqrt(greatest(v2 * vx2, 0)), 0) AS r2 FROM p) SELECT look, name_1, name_2, round(r1, 6) + 0.0 AS corr_coef_1, round(r2, 6) + 0.0 AS corr_coef_2, (CASE WHEN r1 < 0.5 THEN 1 ELSE 0 END + CASE WHEN r2 < 0.5 THEN 1 ELSE 0 END)::INTEGER AS n_warnings FROM c")
def cuped_correlation(spark, d):
    return closed_form.cuped(demo.pairs(spark, d, VALUE, True)).select("look", "name_1", "name_2", "corr_coef_1", "corr_coef_2", F.size("warnings").alias("n_warnings"))


@query(oracles.test(oracles.RATIO_ABS))
def ratio_abs(spark, d):
    return closed_form.ratio_delta(demo.pairs(spark, d, RATIO)).select(TEST)


@query(oracles.test(oracles.RATIO_REL))
def ratio_rel(spark, d):
    return closed_form.ratio_delta(demo.pairs(spark, d, RATIO), "relative").select(TEST)


def _paired(spark, d) -> DataFrame:
    """Users 3k and 3k + 2 as pairs, with pre-period covariates."""
    e = demo.events(spark, d)
    split = F.lit(datetime(2024, 1, 8)).cast("timestamp_ntz")
    unit = e.filter(F.col("user_id") % 3 != 1).groupBy("user_id").agg(
        F.sum(F.when(F.col("ts") >= split, F.col("spend")).otherwise(0.0)).alias("value"), F.sum(F.when(F.col("ts") < split, F.col("spend")).otherwise(0.0)).alias("covariate"))
    unit = unit.withColumn("pair_id", F.floor(F.col("user_id") / 3))
    a, b = unit.filter(F.col("user_id") % 3 == 0), unit.filter(F.col("user_id") % 3 == 2)
    return closed_form.align(a, b, "pair_id", ["value", "covariate"]).withColumn("metric", F.lit("revenue"))


PAIRED = """e AS (SELECT user_id, ts, CASE WHEN event_type = 'purchase' THEN value * 1.0123456789 * CASE WHEN user_id % 3 = 2 THEN 1.6 ELSE 1.0 END ELSE 0.0 END AS spend FROM events),
u AS (SELECT user_id, user_id // 3 AS pair_id, sum(CASE WHEN ts >= TIMESTAMP '2024-01-08' THEN spend ELSE 0.0 END) AS value, sum(CASE WHEN ts < TIMESTAMP '2024-01-08' THEN spend ELSE 0.0 END) AS cov FROM e GROUP BY 1),
pr AS (SELECT a.value AS y1, b.value AS y2, a.cov AS x1, b.cov AS x2 FROM u a JOIN u b USING (pair_id) WHERE a.user_id % 3 = 0 AND b.user_id % 3 = 2),
g AS (SELECT 'revenue' AS metric, count(*)::DOUBLE AS n, avg(y1) AS m1, avg(y2 - y1) AS md, var_pop(y2 - y1) AS vd, var_pop(y1) AS vy1, covar_samp(y2 - y1, y1) AS cd1,
      avg(x2 - x1) AS mx, var_pop(x2 - x1) AS vx, covar_pop(y2 - y1, x2 - x1) AS cyx, covar_samp(y2 - y1, x2 - x1) AS cs, covar_samp(x2 - x1, y1) AS cx1 FROM pr),
h AS (SELECT *, cs / nullif(vx, 0) AS th FROM g),
k AS (SELECT *, md - th * mx AS ad, vd - 2 * th * cyx + th * th * vx AS av, cd1 - th * cx1 AS ac FROM h)"""
_POUT = f"SELECT metric, {r('effect')}, {r('left_bound')}, {r('right_bound')}, {r('pvalue')}, reject FROM t"
PTEST = ["metric", "effect", "left_bound", "right_bound", "pvalue", "reject"]


def _psql(source: str) -> str:
    return f"WITH {PAIRED}, {oracles._normal(source, A, 'metric')} {_POUT}"


@query(_psql("SELECT metric, md AS effect, vd / n AS var FROM g"))
def paired_ttest(spark, d):
    return closed_form.paired_t(_paired(spark, d), ["metric"]).select(PTEST)


@query(_psql(oracles.relative("md", "vd / n", "m1", "vy1 / n", "-cd1 / n", "g", "metric")))
def paired_ttest_rel(spark, d):
    return closed_form.paired_t(_paired(spark, d), ["metric"], "relative").select(PTEST)


@query(_psql("SELECT metric, ad AS effect, av / n AS var FROM k"))
def paired_cuped(spark, d):
    return closed_form.paired_cuped(_paired(spark, d), ["metric"]).select(PTEST)


@query(_psql(oracles.relative("ad", "av / n", "m1", "vy1 / n", "-ac / n", "k", "metric")))
def paired_cuped_rel(spark, d):
    return closed_form.paired_cuped(_paired(spark, d), ["metric"], "relative").select(PTEST)


# -- gates and corrections ------------------------------------------------------------------


@query(f"WITH {RESULTS} SELECT look, n_units, round(chi2, 6) + 0.0 AS chi2, culprit, round(exp(-chi2 / 2), 6) + 0.0 AS srm_pvalue, exp(-chi2 / 2) < 0.001 AS srm_flag FROM srm_")
def srm_chi2(spark, d):
    counts = cohorts.counts_by_look(demo.cohort(spark, d), GRID, VARIANTS).drop("end_ts")
    return corrections.srm(counts, {v: 1 for v in VARIANTS}, ["look"])


@query(f"""WITH {RESULTS}, b AS (SELECT look, sum(n_units)::BIGINT AS n_units, lgamma(3) - lgamma(3 + sum(n_units)) + sum(lgamma(1 + n_units) - n_units * ln(1.0 / 3)) AS log_bf FROM arm_counts GROUP BY look),
m AS (SELECT *, greatest(max(log_bf) OVER (ORDER BY look), 0) AS log_max FROM b)
SELECT look, n_units, {r('log_bf')}, {r('log_max')}, round(exp(-log_max), 6) + 0.0 AS srm_pvalue, log_max >= ln(1000) AS srm_flag FROM m""")
def srm_sequential(spark, d):
    counts = cohorts.counts_by_look(demo.cohort(spark, d), GRID, VARIANTS).drop("end_ts")
    return corrections.srm_sequential(counts, {v: 1 for v in VARIANTS})


def _adjusted(scheme: str):
    def f(spark, d):
        rows = results(spark, d).select("look", "metric", "name_1", "name_2", "pvalue")
        return corrections.adjust(rows, scheme, ["look"], tie=["metric", "name_1", "name_2"])

    return f


_RANKED = f"WITH {RESULTS}, k AS (SELECT look, metric, name_1, name_2, pvalue, count(pvalue) OVER (PARTITION BY look) AS m, row_number() OVER (PARTITION BY look ORDER BY pvalue NULLS LAST, metric, name_1, name_2) AS i FROM results)"
_ADJ = f"SELECT look, metric, name_1, name_2, {r('pvalue')}, CASE WHEN pvalue IS NOT NULL THEN round(least(%s, 1), 6) + 0.0 END AS p_adjusted FROM k"
bh_adjust = query(_RANKED + _ADJ % "min(CASE WHEN pvalue IS NOT NULL THEN pvalue * m / i END) OVER (PARTITION BY look ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
holm_adjust = query(_RANKED + _ADJ % "max(CASE WHEN pvalue IS NOT NULL THEN pvalue * (m - i + 1) END) OVER (PARTITION BY look ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
for _name, _keep, _scheme in (("bh_adjust", bh_adjust, "benjamini_hochberg"), ("holm_adjust", holm_adjust, "holm")):
    _f = _adjusted(_scheme)
    _f.__name__ = _name
    _keep(_f)


# -- results --------------------------------------------------------------------------------


def results(spark, d, **changes) -> DataFrame:
    return run_results(demo.experiment(**changes), demo.metrics(), demo.events(spark, d), demo.cohort(spark, d))


CORE = ["metric", "name_1", "name_2", "look", "end_ts", "is_main_metric", "is_guardrail", "is_horizon", "elapsed_days", "size_1", "size_2", "alpha",
        "effect", "left_bound", "right_bound", "ci_length", "pvalue", "reject", "srm_flag", "srm_pvalue", "decision_blocked", "insufficient_data", "ci_kind"]
_CORE_SQL = ", ".join(r(c) if c in ("alpha", "effect", "left_bound", "right_bound", "ci_length", "pvalue", "srm_pvalue", "elapsed_days") else c for c in CORE)


@query(f"WITH {RESULTS} SELECT {_CORE_SQL} FROM results")
def results_contract(spark, d):
    return results(spark, d).select(CORE)


@query(f"WITH {RESULTS} SELECT metric, look, name_1, name_2, size_1 < 40 OR size_2 < 40 AS insufficient_data, CASE WHEN size_1 >= 40 AND size_2 >= 40 THEN reject END AS reject, CASE WHEN size_1 >= 40 AND size_2 >= 40 THEN round(effect, 6) + 0.0 END AS effect FROM results")
def small_sample_demotion(spark, d):
    return results(spark, d, min_units=40).select("metric", "look", "name_1", "name_2", "insufficient_data", "reject", "effect")


@query("""WITH v AS (SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY 1, 2)
SELECT e.user_id, e.event_type, e.ts, e.event_id, round(e.value, 6) + 0.0 AS value FROM events e JOIN v USING (user_id, event_type, ts)""")
def lww_dedup(spark, d):
    return state.last_write_wins(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], "ts").select("user_id", "event_type", "ts", "event_id", "value")


@query(f"WITH {RESULTS} SELECT metric, end_ts, count(DISTINCT (name_1, name_2)) AS n_pairs FROM results GROUP BY 1, 2 HAVING count(DISTINCT (name_1, name_2)) = 3")
def complete_cutoffs(spark, d):
    return state.complete_looks(results(spark, d), PAIRS)


@query(f"WITH {RESULTS} SELECT metric, count(*) AS n_rows FROM results WHERE metric NOT IN ('revenue') GROUP BY 1")
def orphan_series(spark, d):
    return state.orphans(results(spark, d), spark.createDataFrame([("revenue",)], "metric string"), ["metric"])


@query(f"WITH {RESULTS} SELECT metric, name_1, name_2, round(arg_min(ci_length / {2 * critical(oracles.MAIN):.17e}, look) ** 2 * {corrections.best_ratio(oracles.MAIN):.17e}, 4) + 0.0 AS tau2 FROM results WHERE is_main_metric AND ci_length > 0 GROUP BY ALL", 4)
def tau2_anchor(spark, d):
    rows = corrections.with_tau2(results(spark, d).filter("is_main_metric"), ["metric", "name_1", "name_2"], [oracles.MAIN])
    return rows.groupBy("metric", "name_1", "name_2").agg(F.max("tau2").alias("tau2"))


_AV = f"""WITH {RESULTS}, s AS (SELECT *, (ci_length / {2 * critical(oracles.MAIN):.17e}) * (ci_length / {2 * critical(oracles.MAIN):.17e}) AS v FROM results WHERE is_main_metric),
a AS (SELECT metric, name_1, name_2, arg_min(v, look) * {corrections.best_ratio(oracles.MAIN):.17e} AS t FROM s WHERE ci_length > 0 GROUP BY ALL),
j AS (SELECT s.*, CASE WHEN v > 0 THEN t END AS t FROM s LEFT JOIN a USING (metric, name_1, name_2)),
c AS (SELECT *, sqrt(2 * v * (v + t) / t * ({math.log(1 / oracles.MAIN):.17e} + 0.5 * ln((v + t) / v))) AS rad, least(1, sqrt((v + t) / v) * exp(-t * effect * effect / (2 * v * (v + t)))) AS p FROM j WHERE t IS NOT NULL)"""


@query(f"{_AV} SELECT metric, name_1, name_2, look, round(effect, 4) + 0.0 AS effect, round(effect - rad, 4) + 0.0 AS left_bound, round(effect + rad, 4) + 0.0 AS right_bound, round(p, 4) + 0.0 AS pvalue, p < {oracles.MAIN!r} AS reject, 'always_valid' AS ci_kind FROM c", 4)
def always_valid_series(spark, d):
    out = results(spark, d, sequential=True).filter("is_main_metric and ci_kind = 'always_valid'")
    return out.select("metric", "name_1", "name_2", "look", "effect", "left_bound", "right_bound", "pvalue", "reject", "ci_kind")


def one_method(spark, d, method: str, looks: int = 23, **params) -> DataFrame:
    """The demo's revenue by one method, through the experiment's plan; users 3k, 3k + 1 and 3k + 2 are matched."""
    cohort = demo.cohort(spark, d).withColumn("pair_id", F.floor(F.col("unit_id").cast("long") / 3))
    e = demo.experiment(comparisons=(demo.Comparison("revenue", method, "main", params),), correction="none", horizon=demo.START + timedelta(days=looks))
    return run_results(e, demo.metrics(), demo.events(spark, d), cohort).select("look", "name_1", "name_2", "size_1", "size_2", "effect", "left_bound", "right_bound", "pvalue", "reject")


_MATCHED = f"""WITH {BASE},
mt AS (SELECT a.look, a.variant AS name_1, b.variant AS name_2, a.unit_id::BIGINT // 3 AS pair_id, a.value AS y1, b.value AS y2, a.covariate AS x1, b.covariate AS x2
       FROM units a JOIN units b ON a.look = b.look AND a.unit_id::BIGINT // 3 = b.unit_id::BIGINT // 3 AND a.variant < b.variant),
g AS (SELECT look, name_1, name_2, count(*)::DOUBLE AS n, avg(y1) AS m1, avg(y2 - y1) AS md, var_pop(y2 - y1) AS vd, var_pop(y1) AS vy1, CASE WHEN count(*) > 1 THEN covar_pop(y2 - y1, y1) * count(*) / (count(*) - 1) END AS cd1,
      avg(x2 - x1) AS mx, var_pop(x2 - x1) AS vx, covar_pop(y2 - y1, x2 - x1) AS cyx, CASE WHEN count(*) > 1 THEN covar_pop(y2 - y1, x2 - x1) * count(*) / (count(*) - 1) END AS cs,
      CASE WHEN count(*) > 1 THEN covar_pop(x2 - x1, y1) * count(*) / (count(*) - 1) END AS cx1 FROM mt GROUP BY ALL),
h AS (SELECT *, cs / nullif(vx, 0) AS th FROM g),
k AS (SELECT *, md - th * mx AS ad, vd - 2 * th * cyx + th * th * vx AS av, cd1 - th * cx1 AS ac FROM h)"""
#: Rows of the plan: every pair of arms that has units, void below two pairs.
_MATCHED_OUT = """SELECT p.look, p.name_1, p.name_2, coalesce(g.n, p.n1)::BIGINT AS size_1, coalesce(g.n, p.n2)::BIGINT AS size_2, """ + ", ".join(
    f"CASE WHEN coalesce(g.n, p.n1) >= 2 AND coalesce(g.n, p.n2) >= 2 THEN {c} END AS {c.split('.')[1].split(',')[0].split(')')[0]}" for c in ("round(t.effect, 6) + 0.0", "round(t.left_bound, 6) + 0.0", "round(t.right_bound, 6) + 0.0", "round(t.pvalue, 6) + 0.0")) + """,
CASE WHEN coalesce(g.n, p.n1) >= 2 AND coalesce(g.n, p.n2) >= 2 THEN coalesce(t.reject, FALSE) END AS reject FROM p LEFT JOIN t USING (look, name_1, name_2) LEFT JOIN g USING (look, name_1, name_2)"""


@query(f"{_MATCHED}, {oracles._normal(oracles.relative('md', 'vd / n', 'm1', 'vy1 / n', '-cd1 / n', 'g'))} {_MATCHED_OUT}", 6)
def method_paired_ttest(spark, d):
    return one_method(spark, d, "paired-t-test")


@query(f"{_MATCHED}, {oracles._normal(f'SELECT {oracles.KEYS}, ad AS effect, av / n AS var FROM k')} {_MATCHED_OUT}", 6)
def method_paired_cuped(spark, d):
    return one_method(spark, d, "paired-cuped-t-test", test_type="absolute")


_POISSON = "CASE " + " ".join(f"WHEN u < {sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))!r} THEN {k}" for k in range(12)) + " ELSE 12 END"


def _poisson_sql(key: str, paired: bool, relative: bool) -> str:
    """The Poisson bootstrap through the plan: 40 replicates at the first two looks."""
    seeds = {p: identity.derive_seed("demo", "revenue", *p) for p in PAIRS}
    pick = " UNION ALL ".join(f"SELECT '{a}' AS name_1, '{b}' AS name_2, '{s}' AS seed" for (a, b), s in seeds.items())
    effect = "(b.value - a.value) / nullif(a.value, 0)" if relative else "b.value - a.value"
    return f"""{_MATCHED}, pk AS ({pick}),
us AS (SELECT pk.*, u.look, u.variant, {key} AS key, u.value FROM pk JOIN units u ON u.variant IN (pk.name_1, pk.name_2) WHERE u.look < 2 {'AND EXISTS (SELECT 1 FROM mt WHERE mt.look = u.look AND mt.name_1 = pk.name_1 AND mt.name_2 = pk.name_2 AND mt.pair_id = u.unit_id::BIGINT // 3)' if paired else ''}),
b AS (SELECT *, i AS replicate, ('0x' || substr(md5(key || '|' || i || '|' || seed), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM us, range(40) t(i)),
w AS (SELECT look, name_1, name_2, variant, replicate, sum(({_POISSON}) * value) / nullif(sum({_POISSON}), 0) AS value FROM b GROUP BY ALL),
f AS (SELECT a.look, a.name_1, a.name_2, {effect} AS boot FROM w a JOIN w b USING (look, name_1, name_2, replicate) WHERE a.variant = a.name_1 AND b.variant = a.name_2),
q AS (SELECT look, name_1, name_2, count(boot) = count(*) AS ok, quantile_cont(boot, 0.025) AS lo, quantile_cont(boot, 0.975) AS hi, least(2.0 * least(count_if(boot > 0), count_if(boot < 0)) / count(*), 1) AS pv FROM f GROUP BY ALL),
mn AS (SELECT look, name_1, name_2, avg(CASE WHEN variant = name_1 THEN value END) AS m1, avg(CASE WHEN variant = name_2 THEN value END) AS m2, count(*) FILTER (variant = name_1) AS n FROM us GROUP BY ALL),
z AS (SELECT p.look, p.name_1, p.name_2, {'coalesce(mn.n, p.n1)' if paired else 'p.n1'}::BIGINT AS size_1, {'coalesce(mn.n, p.n2)' if paired else 'p.n2'}::BIGINT AS size_2, {'(mn.m2 - mn.m1) / nullif(mn.m1, 0)' if relative else 'mn.m2 - mn.m1'} AS e, q.* EXCLUDE (look, name_1, name_2)
      FROM p LEFT JOIN q USING (look, name_1, name_2) LEFT JOIN mn USING (look, name_1, name_2) WHERE p.look < 2)
SELECT look, name_1, name_2, size_1, size_2, CASE WHEN s THEN round(CASE WHEN ok IS NOT NULL THEN e END, 6) + 0.0 END AS effect, CASE WHEN s AND ok THEN round(lo, 6) + 0.0 END AS left_bound, CASE WHEN s AND ok THEN round(hi, 6) + 0.0 END AS right_bound,
CASE WHEN s AND ok THEN round(pv, 6) + 0.0 END AS pvalue, CASE WHEN s THEN coalesce(ok AND pv < 0.05, FALSE) END AS reject FROM (SELECT *, size_1 >= 2 AND size_2 >= 2 AS s FROM z)"""


@query(_poisson_sql("u.unit_id", False, True))
def method_poisson_bootstrap(spark, d):
    return one_method(spark, d, "poisson-bootstrap", 2, n_samples=40)


@query(_poisson_sql("(u.unit_id::BIGINT // 3)::VARCHAR", True, False))
def method_paired_poisson_bootstrap(spark, d):
    return one_method(spark, d, "paired-poisson-bootstrap", 2, n_samples=40, test_type="absolute")


for _method, _type in (("bootstrap", "relative"), ("paired-bootstrap", "relative"), ("post-normed-bootstrap", "relative"), ("paired-post-normed-bootstrap", "absolute")):
    def _f(spark, d, method=_method, kind=_type):
        return one_method(spark, d, method, 2, n_samples=200, test_type=kind)

    _f.__name__ = f"method_{_method.replace('-', '_')}"
    query()(_f)


@query(f"WITH {BASE}, {oracles._normal(oracles.CUPED_ABS)}, cb AS (SELECT look, name_1, name_2, n1, n2, k1 / n1 AS c1_, k2 / n2 AS c2_ FROM p) SELECT 'revenue' AS metric, t.look, t.name_1, t.name_2, CASE WHEN n1 >= 2 AND n2 >= 2 THEN round(effect, 5) + 0.0 END AS effect, CASE WHEN n1 >= 2 AND n2 >= 2 THEN round(pvalue, 5) + 0.0 END AS pvalue FROM t JOIN cb USING (look, name_1, name_2)", 5)
def method_two_cuped(spark, d):
    """Two adjusted metrics in one plan."""
    more = demo.Metric("doubled", "sample", {"value": ("sum", "spend * 2")})
    e = demo.experiment(comparisons=tuple(demo.Comparison(m, "cuped", "main", {"test_type": "absolute"}) for m in ("revenue", "doubled")), correction="none")
    rows = run_results(e, [*demo.metrics(), more], demo.events(spark, d), demo.cohort(spark, d))
    both = rows.filter("metric = 'doubled'").select("look", "name_1", "name_2", (F.col("effect") / 2).alias("half"))
    return rows.filter("metric = 'revenue'").join(both, ["look", "name_1", "name_2"]).select("metric", "look", "name_1", "name_2", F.when(F.abs(F.col("effect") - F.col("half")) < 1e-6, F.col("effect")).alias("effect"), "pvalue")


# -- readout --------------------------------------------------------------------------------


def judged(spark, d, **changes) -> DataFrame:
    sign = F.when(F.col("reject"), F.signum("effect").cast("int")).otherwise(0)
    return saved(results(spark, d, **changes)).withColumns({"significant": F.coalesce("reject", F.lit(False)), "sign": sign, "mde": F.lit(None).cast("double")})


_VERDICT = f"""WITH {RESULTS}, {LATEST},
inf AS (SELECT *, row_number() OVER (PARTITION BY metric, name_1, name_2 ORDER BY end_ts DESC) AS k FROM results WHERE is_main_metric AND NOT insufficient_data AND left_bound IS NOT NULL),
st AS (SELECT metric, name_1, name_2, count(*) AS n_looks, bool_and(reject) AS alls, bool_or(reject) AS anys, count(DISTINCT CASE WHEN reject THEN sign(effect) ELSE 0 END) AS ns,
       max(CASE WHEN reject THEN sign(effect) ELSE 0 END) AS sg FROM inf WHERE elapsed_days >= 23 - 7 OR k <= 3 GROUP BY ALL),
gr AS (SELECT metric, name_1, name_2, CASE WHEN right_bound < 0 THEN 'regressed' ELSE 'ok' END AS status, effect, left_bound, right_bound FROM results WHERE is_guardrail AND NOT insufficient_data AND left_bound IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY metric, name_1, name_2 ORDER BY end_ts DESC) = 1),
vd AS (SELECT l.metric, l.name_1, l.name_2, l.end_ts, l.effect, coalesce(n_looks, 0) AS n_looks,
  CASE WHEN srm_flag THEN 'srm' WHEN left_bound IS NULL THEN 'insufficient data' WHEN coalesce(n_looks, 0) < 3 THEN 'too few looks'
       WHEN alls AND ns = 1 AND sg = 1 AND name_1 = 'control' AND EXISTS (SELECT 1 FROM gr WHERE gr.name_1 = l.name_1 AND gr.name_2 = l.name_2 AND status = 'regressed') THEN 'guardrail'
       WHEN alls AND ns = 1 AND sg = 1 THEN 'WIN' WHEN alls AND ns = 1 THEN 'LOSE' WHEN anys THEN 'unstable' ELSE 'no minimum effect' END AS why
  FROM latest l LEFT JOIN st USING (metric, name_1, name_2) WHERE is_main_metric),
v AS (SELECT metric, name_1, name_2, end_ts, effect, n_looks, CASE WHEN why IN ('WIN', 'LOSE') THEN why ELSE 'INCONCLUSIVE' END AS verdict, CASE WHEN why IN ('WIN', 'LOSE') THEN 'significant' ELSE why END AS reason FROM vd)
"""


@query(f"{_VERDICT} SELECT metric, name_1, name_2, end_ts, {r('effect')}, n_looks, verdict, reason FROM v")
def readout_verdicts(spark, d):
    return readout.verdicts(judged(spark, d), "control").select("metric", "name_1", "name_2", "end_ts", "effect", "n_looks", "verdict", "reason")


@query(f"{_VERDICT} SELECT metric, name_1, name_2, {r('effect')}, {r('left_bound')}, {r('right_bound')}, status FROM gr")
def guardrail_status(spark, d):
    return readout.guardrails(judged(spark, d))


@query(f"""{_VERDICT}, w AS (SELECT metric, arg_max(name_2, effect) FILTER (verdict = 'WIN') AS leader, coalesce(list_sort(list(name_2) FILTER (verdict = 'WIN')), []) AS winners,
coalesce(list_sort(list(name_2) FILTER (verdict = 'LOSE')), []) AS losers FROM v WHERE name_1 = 'control' GROUP BY 1)
SELECT metric, leader, array_to_string(winners, ',') AS winners, array_to_string(losers, ',') AS losers,
  CASE WHEN leader IS NULL THEN 'no_leader' WHEN len(winners) = 1 THEN 'separated'
       WHEN EXISTS (SELECT 1 FROM v WHERE v.metric = w.metric AND name_1 <> 'control' AND (verdict = 'WIN' AND name_2 = leader OR verdict = 'LOSE' AND name_1 = leader)) THEN 'separated' ELSE 'co_leaders' END AS separation FROM w""")
def metric_rollup(spark, d):
    out = readout.rollup(saved(readout.verdicts(judged(spark, d), "control")), "control", list(VARIANTS))
    return out.withColumns({c: F.array_join(c, ",") for c in ("winners", "losers")})


_BOARD = "CASE WHEN insufficient_data THEN 'insufficient_data' WHEN decision_blocked OR srm_flag THEN 'blocked' WHEN NOT is_horizon AND ci_kind = 'fixed' THEN 'running' WHEN NOT coalesce(reject, FALSE) THEN 'no_difference' WHEN effect > 0 THEN 'up' ELSE 'down' END AS verdict"


@query(on_results(f"SELECT metric, name_1, name_2, is_main_metric, is_guardrail, end_ts, {r('effect')}, {r('left_bound')}, {r('right_bound')}, {r('pvalue')}, {r('alpha')}, {_BOARD} FROM latest"))
def bi_latest(spark, d):
    return readout.scoreboard(results(spark, d))


@query(on_results(f"SELECT end_ts, {r('effect')}, {r('left_bound')}, {r('right_bound')}, is_horizon, ci_kind FROM results WHERE metric = 'revenue' AND name_1 = 'control' AND name_2 = 't2'"))
def bi_ci_band(spark, d):
    f = results(spark, d).filter("metric = 'revenue' and name_1 = 'control' and name_2 = 't2'")
    return f.select("end_ts", "effect", "left_bound", "right_bound", "is_horizon", "ci_kind").orderBy("end_ts")


@query(f"WITH {BASE} SELECT look, name_1, name_2, round(m1, 6) + 0.0 AS value_1, round(m2, 6) + 0.0 AS value_2, n1::BIGINT AS size_1, n2::BIGINT AS size_2 FROM p")
def bi_arm_values(spark, d):
    return results(spark, d).filter("metric = 'revenue'").select("look", "name_1", "name_2", "value_1", "value_2", "size_1", "size_2")


@query(on_results(f"SELECT metric, name_1, name_2, end_ts, {r('pvalue')}, {r('alpha')}, pvalue < alpha AS significant, CASE WHEN is_main_metric THEN 'main' WHEN is_guardrail THEN 'guardrail' ELSE 'secondary' END AS tier FROM results"))
def bi_significance(spark, d):
    tier = F.when(F.col("is_main_metric"), "main").when(F.col("is_guardrail"), "guardrail").otherwise("secondary")
    return results(spark, d).select("metric", "name_1", "name_2", "end_ts", "pvalue", "alpha", (F.col("pvalue") < F.col("alpha")).alias("significant"), tier.alias("tier"))


@query(on_results("SELECT name_2, count(*) AS n_metrics, count_if(reject) AS n_significant FROM latest WHERE name_1 = 'control' GROUP BY 1"))
def bi_scoreboard(spark, d):
    return readout.latest(results(spark, d)).filter("name_1 = 'control'").groupBy("name_2").agg(F.count(F.lit(1)).alias("n_metrics"), F.count_if("reject").alias("n_significant"))


@query(on_results("SELECT max(end_ts) AS last_end, count(DISTINCT metric) AS n_metrics, count(DISTINCT end_ts) AS n_looks FROM results"))
def bi_freshness(spark, d):
    return results(spark, d).agg(F.max("end_ts").alias("last_end"), F.countDistinct("metric").alias("n_metrics"), F.countDistinct("end_ts").alias("n_looks"))


@query(on_results("SELECT metric, name_1, name_2, srm_flag, round(size_2 / nullif(size_1 + size_2, 0), 6) + 0.0 AS share_2 FROM latest"))
def srm_board(spark, d):
    s = readout.latest(results(spark, d))
    return s.select("metric", "name_1", "name_2", "srm_flag", div(F.col("size_2").cast("double"), (F.col("size_1") + F.col("size_2")).cast("double")).alias("share_2"))


@query(f"WITH {RESULTS} SELECT look, variant, round(n_units / nullif(sum(n_units) OVER (PARTITION BY look), 0), 6) + 0.0 AS share FROM arm_counts")
def srm_share(spark, d):
    c = cohorts.counts_by_look(demo.cohort(spark, d), GRID, VARIANTS)
    total = F.sum("n_units").over(Window.partitionBy("look"))
    return c.select("look", "variant", div(F.col("n_units").cast("double"), total.cast("double")).alias("share"))


@query(on_results("SELECT count_if(srm_flag) AS n_flagged, count(*) AS n_series FROM latest"))
def srm_blocked(spark, d):
    return readout.latest(results(spark, d)).agg(F.count_if("srm_flag").alias("n_flagged"), F.count(F.lit(1)).alias("n_series"))


@query(on_results("""SELECT metric, name_1, name_2, bucket, round(avg(effect), 6) + 0.0 AS effect, max(end_ts) AS end_ts FROM (
SELECT *, CAST(floor((row_number() OVER w - 1) / ceil(count(*) OVER (PARTITION BY metric, name_1, name_2) / 5.0)) AS INTEGER) AS bucket FROM results WHERE effect IS NOT NULL WINDOW w AS (PARTITION BY metric, name_1, name_2 ORDER BY end_ts)) GROUP BY 1, 2, 3, 4"""))
def spark_buckets(spark, d):
    return readout.spark_series(results(spark, d), 5)


@query(on_results(f"SELECT metric, name_1, name_2, end_ts, {r('effect')} FROM results QUALIFY row_number() OVER (PARTITION BY metric, name_1, name_2 ORDER BY end_ts DESC) <= 40 // 9"))
def clip_budget(spark, d):
    return readout.clip_to_budget(results(spark, d), 40).select("metric", "name_1", "name_2", "end_ts", "effect")


@query(on_results(f"SELECT metric, name_1, name_2, look, round(effect - ci_length / 2 * {critical(0.1) / critical(oracles.MAIN):.17e}, 5) + 0.0 AS left_bound, coalesce(pvalue < 0.1, FALSE) AS reject FROM results WHERE is_main_metric"), 5)
def alpha_inversion(spark, d):
    out = readout.invert_alpha(results(spark, d).filter("is_main_metric"), 0.1)
    return out.select("metric", "name_1", "name_2", "look", "left_bound", "reject")


@query(f"WITH {BASE} SELECT look, name_1, name_2, CASE WHEN k1 > 0 AND k1 < n1 THEN n1 END AS nobs_1, CASE WHEN k1 > 0 AND k1 < n1 THEN k1 END AS count_1 FROM p")
def invert_fraction(spark, d):
    return readout.invert_fraction(results(spark, d).filter("metric = 'signup'")).select("look", "name_1", "name_2", "nobs_1", "count_1")


@query(oracles.test(oracles.T_REL))
def suffstats_from_row(spark, d):
    """A relative test answered from persisted absolute rows."""
    rows = readout.rebuild_moments(results(spark, d).filter("metric = 'revenue'"))
    return closed_form.t_test(rows, "relative").select(TEST)


@query(on_results("SELECT bool_or(srm_flag) AS srm_flag, min(srm_pvalue) FILTER (srm_flag) AS srm_pvalue FROM latest"))
def srm_summary(spark, d):
    return readout.srm_summary(results(spark, d))


# -- power and planning ---------------------------------------------------------------------


def _arms(spark, d) -> DataFrame:
    p = demo.pairs(spark, d, VALUE).filter("look = 22")
    return p.select(F.col("name_1").alias("variant"), F.col("mean_value_1").alias("mean"), F.sqrt(F.col("m2_value_1") / F.col("n_1")).alias("std"), F.col("n_1").alias("n")).distinct()


@query()
def ttest_mde(spark, d):
    return power.with_solve(_arms(spark, d), "mde", power.t_mde, "mean", "std", "n")


@query()
def required_n(spark, d):
    out = power.with_solve(_arms(spark, d), "required_n", power.t_sample_size, "mean", "std", mde=0.1)
    return power.with_solve(out, "power", power.t_achieved, "mean", "std", "n", mde=0.1)


@query()
def runtime_days(spark, d):
    need = power.with_solve(_arms(spark, d), "required_n", power.t_sample_size, "mean", "std", mde=0.1)
    rate = cohorts.arrival_rate(demo.cohort(spark, d)).select(F.col("variant").alias("v"), "per_day")
    return need.join(rate, F.col("variant") == F.col("v")).select("variant", "required_n", "per_day", div(F.col("required_n"), F.col("per_day")).alias("days"))


# -- resampling and calibration -------------------------------------------------------------


def final_units(spark, d) -> DataFrame:
    run = fact_ops.running_units(demo.exposed(spark, d), GRID, "ts", VALUE)
    out = fact_ops.with_covariate(fact_ops.unit_panel(run, GRID, VALUE).filter("look = 22"), demo.covariate(spark, d))
    return out.withColumn("metric", F.lit("revenue")).withColumn("stratum", F.pmod(F.col("unit_id").cast("long"), F.lit(2)).cast("string"))


_BOOT = f"""WITH {BASE}, b AS (SELECT variant, unit_id, value, i AS replicate, ('0x' || substr(md5(unit_id || '|' || i || '|7'), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM units, range(60) t(i) WHERE look = 22),
w AS (SELECT variant, replicate, sum(({_POISSON}) * value) / nullif(sum({_POISSON}), 0) AS value FROM b GROUP BY 1, 2)"""


@query(f"{_BOOT} SELECT variant, replicate::INTEGER AS replicate, {r('value')} FROM w")
def bootstrap_poisson_replicates(spark, d):
    reps = resample.poisson_replicates(final_units(spark, d), ["metric"], 60, seed=7)
    return reps.select("variant", "replicate", "value")


@query(f"""{_BOOT}, f AS (SELECT a.replicate, (b.value - a.value) / nullif(a.value, 0) AS boot FROM w a JOIN w b USING (replicate) WHERE a.variant = 'control' AND b.variant = 't2')
SELECT 'revenue' AS metric, count(*) AS n_samples, round(avg(boot), 6) AS boot_mean, CASE WHEN count(boot) = count(*) THEN round(quantile_cont(boot, 0.025), 6) END AS left_bound, CASE WHEN count(boot) = count(*) THEN round(quantile_cont(boot, 0.975), 6) END AS right_bound,
CASE WHEN count(boot) = count(*) THEN round(quantile_cont(boot, 0.975) - quantile_cont(boot, 0.025), 6) END AS ci_length, CASE WHEN count(boot) = count(*) THEN round(least(2.0 * least(count_if(boot > 0), count_if(boot < 0)) / count(*), 1), 6) + 0.0 END AS pvalue,
count(boot) = count(*) AND 2.0 * least(count_if(boot > 0), count_if(boot < 0)) / count(*) < 0.05 AS reject FROM f""")
def bootstrap_poisson(spark, d):
    reps = resample.poisson_replicates(final_units(spark, d), ["metric"], 60, seed=7)
    return resample.bootstrap_test(resample.replicate_effects(reps, ["metric"], ("control", "t2"), "relative"), ["metric"])


def _resampled(name: str, method: str, **options):
    def f(spark, d):
        return resample.resampled(final_units(spark, d), ["metric"], ("control", "t2"), method, 400, (name,), **options)

    f.__name__ = name
    query()(f)


_resampled("bootstrap_iid", "bootstrap")
_resampled("bootstrap_median", "bootstrap", statistic="median")
_resampled("bootstrap_stratified", "bootstrap", stratified=True)
_resampled("bootstrap_poisson_stream", "poisson-bootstrap", kind="plugin")


def _resampled_pairs(name: str, method: str, **options):
    def f(spark, d):
        p = _paired(spark, d)
        unit = F.lpad(F.col("pair_id").cast("string"), 12, "0").alias("unit_id")
        rows = p.select("metric", F.lit("control").alias("variant"), unit, F.col("value1").alias("value"), F.col("covariate1").alias("covariate")).union(
            p.select("metric", F.lit("t2").alias("variant"), unit, F.col("value2").alias("value"), F.col("covariate2").alias("covariate")))
        return resample.resampled(rows, ["metric"], ("control", "t2"), method, 400, (name,), **options)

    f.__name__ = name
    query()(f)


_resampled_pairs("bootstrap_paired", "paired-bootstrap")
_resampled_pairs("bootstrap_paired_poisson", "paired-poisson-bootstrap")
_resampled_pairs("bootstrap_post_normed", "post-normed-bootstrap")
_resampled_pairs("bootstrap_paired_post_normed", "paired-post-normed-bootstrap", test_type="absolute")


@query("""WITH s AS (SELECT c_mktsegment AS stratum, count(*)::DOUBLE AS share FROM customer GROUP BY 1), q AS (SELECT *, share / sum(share) OVER () * 97.0 AS q FROM s),
f AS (SELECT *, floor(q) AS c, 97 - sum(floor(q)) OVER () AS left_, row_number() OVER (ORDER BY q - floor(q) DESC, stratum) AS t FROM q)
SELECT stratum, (c + CASE WHEN t <= left_ THEN 1 ELSE 0 END)::BIGINT AS n FROM f""")
def hamilton_apportion(spark, d):
    s = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("stratum")).agg(F.count(F.lit(1)).cast("double").alias("share"))
    return resample.apportion(s, 97).select("stratum", "n")


@query("SELECT event_type, round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi FROM events GROUP BY 1")
def percentile_ci(spark, d):
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    return table(spark, d, "events").groupBy("event_type").agg(q[0].alias("lo"), q[1].alias("hi"))


@query("""WITH u AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS unit_id FROM events), m AS (SELECT unit_id, i::INTEGER AS iteration, row_number() OVER (PARTITION BY i ORDER BY md5(unit_id || '|' || i || '|3'), unit_id) AS k, count(*) OVER (PARTITION BY i) AS n FROM u, range(8) t(i))
SELECT unit_id, iteration, k <= round(n * 0.5) AS is_a FROM m""")
def placebo_split(spark, d):
    u = table(spark, d, "events").select(F.col("user_id").cast("string").alias("unit_id")).distinct()
    return calibrate.placebo_split(u, 8, 0.5, 3)


def panel(spark, d) -> DataFrame:
    run = fact_ops.running_units(demo.exposed(spark, d), GRID, "ts", VALUE)
    return fact_ops.with_covariate(fact_ops.unit_panel(run, GRID, VALUE), demo.covariate(spark, d)).select("unit_id", "look", "value", "covariate")


@query()
def placebo_fpr(spark, d):
    null = calibrate.placebo_effects(panel(spark, d), calibrate.iterations_for(A), "t", relative=True, seed=5)
    lift = calibrate.placebo_effects(panel(spark, d), calibrate.iterations_for(A), "t", relative=True, seed=5, delta=0.2)
    return calibrate.score(null, A, lift, 0.2, calibrate.tau2_of(null, A))


@query()
def placebo_cuped(spark, d):
    return calibrate.score(calibrate.placebo_effects(panel(spark, d), calibrate.iterations_for(A), "cuped", seed=5), A)


@query()
def peeking_curve(spark, d):
    return calibrate.peeking_curve(calibrate.placebo_effects(panel(spark, d), calibrate.iterations_for(A), seed=5), A)


@query()
def family_fwer(spark, d):
    p = panel(spark, d)
    members = []
    for name, kind in (("plain", "t"), ("adjusted", "cuped")):
        x = calibrate.placebo_effects(p, calibrate.iterations_for(A), kind, seed=9, looks=[22])
        members.append(x.select("iteration", F.lit(name).alias("member"), "effect", two_sided(F.col("effect") / F.col("se")).alias("pvalue")))
    return calibrate.family_rate(members[0].union(members[1]), "holm", A)


# -- state ----------------------------------------------------------------------------------


_DAY = f"dd AS (SELECT variant, unit_id, CAST(ts AS DATE) AS day, sum(spend) AS v FROM x GROUP BY 1, 2, 3)"


@query(f"WITH {BASE}, {_DAY} SELECT unit_id, day, 1::BIGINT AS n, round(v, 6) + 0.0 AS sum_value, round(v * v, 4) + 0.0 AS sum_value_sq FROM dd".replace("round(v, 6)", "round(v, 4)"), 4)
def day_state(spark, d):
    return state.day_state(demo.exposed(spark, d), "UTC", "ts", F.sum("spend")).select("unit_id", "day", "n", "sum_value", "sum_value_sq")


@query(f"WITH {BASE}, {_DAY} SELECT unit_id, count(*)::BIGINT AS n, round(sum(v), 4) + 0.0 AS sum_value FROM dd WHERE day BETWEEN DATE '2024-01-08' AND DATE '2024-01-20' GROUP BY 1", 4)
def state_cumulative(spark, d):
    s = state.day_state(demo.exposed(spark, d), "UTC", "ts", F.sum("spend"))
    return state.cumulative(s, date(2024, 1, 8), date(2024, 1, 20)).select("unit_id", "n", "sum_value")


@query(f"WITH {BASE}, c AS (SELECT unit_id, variant, min(exposure_ts) AS exposure_ts FROM cohort GROUP BY 1, 2) SELECT * FROM c WHERE exposure_ts < TIMESTAMP '2024-01-08' + INTERVAL 12 HOUR")
def closed_bucket_copy(spark, d):
    bound = closed_bound(GRID.start, datetime(2024, 1, 8, 15), 6 * 3600, 2 * 3600)
    c = demo.cohort(spark, d).select("unit_id", "variant", "exposure_ts")
    return c.filter(F.col("exposure_ts") < F.lit(bound).cast("timestamp_ntz"))


@query("SELECT CASE user_id % 3 WHEN 0 THEN 'control' WHEN 1 THEN 't1' ELSE 't2' END AS variant, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS sum_value, round(sum(value * value), 4) AS sum_value_sq FROM events GROUP BY 1, 2", 4)
def stream_daily_totals(spark, d):
    """The same daily totals from a stream over the files, run until it has caught up."""
    from trialweave.streaming.cohort import daily_totals

    kind = table(spark, d, "events").schema
    stream = spark.readStream.schema(kind).parquet(f"{d}/events.parquet*")
    totals = daily_totals(stream, demo.variant(), "ts", F.col("value"), "1 day")
    name = f"daily_totals_{abs(hash(d))}"
    run = totals.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


@query("SELECT CAST(user_id AS VARCHAR) AS unit_id, CASE user_id % 3 WHEN 0 THEN 'control' WHEN 1 THEN 't1' ELSE 't2' END AS variant, min(ts) AS exposure_ts, count(*) AS n_rows FROM events GROUP BY 1, 2")
def stream_exposures(spark, d):
    from trialweave.streaming.cohort import exposures

    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    name = f"exposures_{abs(hash(d))}"
    run = exposures(stream, "user_id", demo.variant(), "ts").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


from trialweave.plans import contracts, readings  # noqa: E402, F401  (they register more)
