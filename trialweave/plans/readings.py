"""Registered queries on stored rows, planning and calibration; :mod:`trialweave.plans.queries` imports them."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions import power
from trialweave.functions.columns import div
from trialweave.functions.normal import critical, phi_sql, two_sided
from trialweave.functions.text import gate_text
from trialweave.operators import calibrate, closed_form, corrections, explore, planning, readout, resample, state
from trialweave.operators import cohort as cohorts
from trialweave.operators import facts as fact_ops
from trialweave.operators.grid import make_grid, subsample
from trialweave.operators.moments import arm_moments, comoment, weights
from trialweave.plans import demo, oracles
from trialweave.plans.demo import GRID, VARIANTS
from trialweave.plans.experiment import results_of_many
from trialweave.plans.oracles import A, BASE, RESULTS, on_results, r
from trialweave.plans.queries import _BOOT, _VERDICT, VALUE, final_units, fraction_pairs, judged, query, results

# -- windows and lists ----------------------------------------------------------------------


@query(on_results(f"SELECT metric, name_1, name_2, end_ts, {r('effect')} FROM results WHERE end_ts BETWEEN TIMESTAMP '2024-01-15' AND TIMESTAMP '2024-01-20'"))
def replay_window(spark, d):
    return explore.replay(results(spark, d), datetime(2024, 1, 15), datetime(2024, 1, 20)).select("metric", "name_1", "name_2", "end_ts", "effect")


@query(on_results("""SELECT preset, count(*) AS n_rows, min(end_ts) AS first_end FROM results, (VALUES ('24h', 24), ('7d', 168), ('30d', 720), ('90d', 2160), ('all', 1000000)) w(preset, hours)
WHERE end_ts >= TIMESTAMP '2024-01-31' - hours * INTERVAL 1 HOUR GROUP BY 1"""))
def preset_windows(spark, d):
    rows = results(spark, d)
    parts = [explore.replay(rows, explore.window_start(p, datetime(2024, 1, 31))).agg(F.lit(p).alias("preset"), F.count(F.lit(1)).alias("n_rows"), F.min("end_ts").alias("first_end")) for p in explore.WINDOWS]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query(f"{_VERDICT} SELECT metric, name_2, verdict FROM v WHERE name_1 = 'control'")
def ship_verdicts(spark, d):
    return explore.ship_decisions(readout.verdicts(judged(spark, d), "control"), "control").select("metric", "name_2", "verdict")


@query("""WITH e AS (SELECT event_type, CASE user_id % 3 WHEN 0 THEN ['click', 'view'] WHEN 1 THEN ['purchase'] END AS a, CASE user_id % 2 WHEN 0 THEN ['view', 'purchase'] END AS b FROM events)
SELECT event_type, count(*) AS n FROM e WHERE (a IS NULL OR list_contains(a, event_type)) AND (b IS NULL OR list_contains(b, event_type)) GROUP BY 1""")
def allow_lists(spark, d):
    u = F.col("user_id")
    a = F.when(u % 3 == 0, F.array(F.lit("click"), F.lit("view"))).when(u % 3 == 1, F.array(F.lit("purchase")))
    b = F.when(u % 2 == 0, F.array(F.lit("view"), F.lit("purchase")))
    return demo.table(spark, d, "events").filter(explore.allowed(F.col("event_type"), a, b)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
SELECT CAST(user_id AS VARCHAR) AS unit_id FROM a UNION SELECT CAST(user_id AS VARCHAR) FROM b""")
def family_universe(spark, d):
    e = demo.table(spark, d, "events")
    parts = [e.filter(F.col("event_type") == k).select(F.col("user_id").cast("string").alias("unit_id")) for k in ("click", "purchase")]
    return parts[0].union(parts[1]).distinct()


# -- stored rows ----------------------------------------------------------------------------


@query(f"WITH {RESULTS} SELECT look, CASE WHEN srm_flag THEN printf('ratio mismatch (p = %.4f); most off: %s', p, culprit) ELSE printf('ratio as planned (p = %.4f)', p) END AS line FROM (SELECT look, culprit, exp(-chi2 / 2) AS p, exp(-chi2 / 2) < 0.001 AS srm_flag FROM srm_)")
def gate_lines(spark, d):
    counts = cohorts.counts_by_look(demo.cohort(spark, d), GRID, VARIANTS).drop("end_ts")
    return corrections.srm(counts, {v: 1 for v in VARIANTS}, ["look"]).select("look", gate_text(3).alias("line"))


@query(on_results(f"""SELECT metric, name_1, name_2, round({phi_sql('a')} + {phi_sql('b')}, 5) + 0.0 AS power FROM (
SELECT *, 5.0 / nullif(ci_length / CASE WHEN metric = 'revenue' THEN {2 * critical(oracles.MAIN):.17e} ELSE {2 * critical(oracles.OTHER):.17e} END, 0) AS z, z - {critical(0.1):.17e} AS a, -z - {critical(0.1):.17e} AS b FROM results
WHERE ci_length IS NOT NULL QUALIFY row_number() OVER (PARTITION BY metric, name_1, name_2 ORDER BY end_ts DESC) = 1)"""), 5)
def stored_pair_power(spark, d):
    return explore.pair_power(results(spark, d), 5.0, 0.1)


@query(on_results(f"SELECT metric, name_1, name_2, end_ts, {r('effect')}, round(ci_length / 2, 6) + 0.0 AS half_width, {r('pvalue')}, size_1 + size_2 AS units, reject FROM results WHERE NOT insufficient_data QUALIFY row_number() OVER (PARTITION BY metric, name_1, name_2 ORDER BY end_ts DESC) = 1"))
def latest_chips(spark, d):
    return explore.chips(results(spark, d)).drop("mde")


@query(f"""{_VERDICT} SELECT metric, name_2, verdict, {r('effect')} FROM v WHERE name_1 = 'control'
QUALIFY row_number() OVER (PARTITION BY metric ORDER BY CASE verdict WHEN 'WIN' THEN 3 WHEN 'LOSE' THEN 2 WHEN 'FLAT' THEN 1 ELSE 0 END DESC, coalesce(effect, 0) DESC, name_2 DESC) = 1""")
def dashboard_headline(spark, d):
    return explore.headline(readout.verdicts(judged(spark, d), "control"), "control")


@query(f"""{_VERDICT}, h AS (SELECT metric, name_2, verdict, effect FROM v WHERE name_1 = 'control'
QUALIFY row_number() OVER (PARTITION BY metric ORDER BY CASE verdict WHEN 'WIN' THEN 3 WHEN 'LOSE' THEN 2 WHEN 'FLAT' THEN 1 ELSE 0 END DESC, coalesce(effect, 0) DESC, name_2 DESC) = 1),
sp AS (SELECT metric, name_2, bucket, avg(effect) AS e FROM (SELECT metric, name_2, effect, CAST(floor((row_number() OVER w - 1) / ceil(count(*) OVER (PARTITION BY metric, name_2) / 8.0)) AS INTEGER) AS bucket
       FROM results WHERE effect IS NOT NULL AND name_1 = 'control' WINDOW w AS (PARTITION BY metric, name_2 ORDER BY end_ts)) GROUP BY ALL),
pt AS (SELECT metric, name_2, count(*) AS n_points, round(sum(e * (bucket + 1)), 4) + 0.0 AS weighed FROM sp GROUP BY ALL)
SELECT h.metric, h.name_2, h.verdict, round(h.effect, 4) + 0.0 AS effect, l.end_ts, l.size_1 + l.size_2 AS units, l.srm_flag, l.is_horizon, pt.n_points, pt.weighed
FROM h JOIN latest l ON l.metric = h.metric AND l.name_2 = h.name_2 AND l.name_1 = 'control' LEFT JOIN pt ON pt.metric = h.metric AND pt.name_2 = h.name_2""", 4)
def dashboard_board(spark, d):
    rows = judged(spark, d)
    out = explore.board(rows, readout.verdicts(rows, "control"), "control")
    weighed = F.aggregate(F.transform("series", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return out.withColumns({"n_points": F.size("series").cast("long"), "weighed": weighed}).drop("series")


@query(f"WITH {RESULTS}" + """, c AS (SELECT metric, name_1 || ':' || name_2 AS method_name, avg(reject::INT) AS fpr, max(abs(effect)) AS power, min(ci_length) AS achieved_mde FROM results GROUP BY ALL)
SELECT metric, method_name, coalesce(fpr <= 0.5, FALSE) AS in_budget FROM c QUALIFY row_number() OVER (PARTITION BY metric ORDER BY coalesce(fpr <= 0.5, FALSE) DESC, power DESC NULLS LAST, achieved_mde NULLS LAST, fpr NULLS LAST, method_name) = 1""")
def recommend_method(spark, d):
    """The recommendation's order, on cells made of the result rows."""
    cells = results(spark, d).groupBy("metric", F.concat_ws(":", "name_1", "name_2").alias("method_name")).agg(
        F.avg(F.col("reject").cast("int")).alias("fpr"), F.max(F.abs("effect")).alias("power"), F.min("ci_length").alias("achieved_mde"))
    return calibrate.recommend(cells, 0.5).select("metric", "method_name", "in_budget")


@query("""WITH n AS (SELECT 22 AS last_, 9 AS cap), k AS (SELECT i, last_, cap FROM n, range(cap) t(i)),
q AS (SELECT DISTINCT round_even((i / (cap - 1)) * (i / (cap - 1)) * last_, 0)::INTEGER AS look FROM k), f AS (SELECT i::INTEGER AS look, row_number() OVER (ORDER BY i) AS t FROM n, range(last_ + 1) t(i) WHERE i NOT IN (SELECT look FROM q))
SELECT look FROM q UNION ALL SELECT look FROM f WHERE t <= 9 - (SELECT count(*) FROM q)""")
def grid_subsample(spark, d):
    return spark.createDataFrame([(i,) for i in subsample(GRID, 9)], "look int")


@query(on_results("SELECT metric, look, array_to_string(list_sort(list_distinct(list(name_2))), chr(10)) AS signature FROM results WHERE reject GROUP BY 1, 2"))
def notify_signature(spark, d):
    from trialweave.functions.identity import signature

    hits = results(spark, d).filter("reject").groupBy("metric", "look").agg(F.collect_list("name_2").alias("items"))
    return hits.select("metric", "look", signature(F.col("items")).alias("signature"))


@query(on_results("SELECT CASE WHEN count(leader) >= 2 THEN count(DISTINCT leader) = 1 END AS leaders_agree FROM (SELECT metric, max_by(name_2, effect) AS leader FROM latest WHERE name_1 = 'control' AND effect > 0 GROUP BY 1)"))
def leaders_agree(spark, d):
    top = readout.latest(results(spark, d)).filter("name_1 = 'control' and effect > 0").groupBy("metric").agg(F.max_by("name_2", "effect").alias("leader"))
    return readout.leaders_agree(top)


@query(f"WITH {RESULTS}" + """, t AS (SELECT count(DISTINCT (name_1, name_2)) AS pairs, count(DISTINCT metric) FILTER (NOT is_main_metric) AS others FROM results)
SELECT DISTINCT metric, CASE WHEN is_main_metric THEN round(0.05::DOUBLE / pairs, 12) ELSE round(0.05::DOUBLE / (pairs * others), 12) END AS level FROM results, t""", 12)
def bonferroni_two_tier(spark, d):
    """The levels that the plan gave each metric, against pairs and metrics counted from the rows."""
    return results(spark, d).select("metric", F.col("alpha").alias("level")).distinct()


@query(on_results("""SELECT metric, name_2 AS method_config_id, round(arg_max(pvalue, end_ts), 6) + 0.0 AS fpr FROM results
WHERE metric <> 'signup' AND NOT coalesce(reject, FALSE) AND name_1 = 'control' AND pvalue IS NOT NULL GROUP BY 1, 2"""))
def find_calibration(spark, d):
    """The newest successful run per cell at a level, on runs made of the result rows."""
    rows = results(spark, d).filter("name_1 = 'control' and pvalue is not null")
    runs = rows.select(
        "metric", F.col("name_2").alias("method_config_id"), F.when(F.col("metric") == "signup", 0.1).otherwise(0.05).alias("alpha"),
        F.when(F.coalesce("reject", F.lit(False)), "failed").otherwise("ok").alias("status"), F.col("end_ts").alias("created_at"), F.col("pvalue").alias("fpr"))
    return readout.find_calibration(runs, 0.05).select("metric", "method_config_id", "fpr")


@query(on_results("SELECT metric, count(DISTINCT kind) AS n_ids FROM (SELECT metric, 'absolute' AS kind FROM results UNION ALL SELECT metric, 'relative' FROM results WHERE metric = 'revenue') GROUP BY 1 HAVING count(DISTINCT kind) > 1"))
def bi_drift(spark, d):
    """Metrics whose rows carry more than one method identity."""
    a, b = results(spark, d), results(spark, d, comparisons=(demo.Comparison("revenue", "t-test", "main", {"test_type": "relative"}),))
    return a.unionByName(b).groupBy("metric").agg(F.countDistinct("method_config_id").alias("n_ids")).filter("n_ids > 1")


@query(f"""WITH {BASE}, dd AS (SELECT unit_id, CAST(ts AS DATE) AS day, sum(spend) AS v FROM x GROUP BY 1, 2),
f AS (SELECT unit_id, sum(v) FILTER (day <= DATE '2024-01-29') AS c, sum(v) FILTER (day > DATE '2024-01-29') AS t FROM dd GROUP BY 1), w AS (SELECT unit_id, sum(spend) AS s FROM x GROUP BY 1)
SELECT unit_id, CASE WHEN abs(coalesce(c, 0) + coalesce(t, 0) - s) <= greatest(1e-9 * greatest(abs(coalesce(c, 0) + coalesce(t, 0)), abs(s)), 1e-12) THEN 'equal' ELSE 'different' END AS status FROM f JOIN w USING (unit_id)""")
def state_reconcile(spark, d):
    """Incremental sums (closed days and a tail) against a full recompute."""
    from datetime import date

    s = state.day_state(demo.exposed(spark, d), "UTC", "ts", F.sum("spend"))
    closed, tail = state.cumulative(s, date(2024, 1, 8), date(2024, 1, 29)), state.cumulative(s, date(2024, 1, 30), date(2024, 1, 30))
    fast = state.with_tail(closed, tail, demo.cohort(spark, d)).select("unit_id", F.col("sum_value").alias("value"))
    full = fact_ops.unit_metric(demo.exposed(spark, d), {"value": F.sum("spend")}).select("unit_id", "value")
    return state.reconcile(full, fast, ["unit_id"], ["value"]).select("unit_id", "status")


@query(f"WITH {RESULTS} SELECT 'demo' AS experiment, look, name_1, name_2, metric, round(effect, 6) + 0.0 AS effect FROM results UNION ALL SELECT 'again', look, name_1, name_2, metric, round(effect, 6) + 0.0 FROM results WHERE name_1 = 'control'")
def many_experiments(spark, d):
    """Two experiments over one cohort in one plan."""
    e = [demo.experiment(), demo.experiment(name="again", contrast_kind="vs_control")]
    out = results_of_many([(x, demo.metrics(), demo.events(spark, d), demo.cohort(spark, d)) for x in e])
    return out.select("experiment", "look", "name_1", "name_2", "metric", "effect")


@query(f"WITH {BASE}, s AS (SELECT * FROM cohort WHERE exposure_ts <= TIMESTAMP '2024-01-09') SELECT unit_id, variant, 'copy' AS origin FROM s UNION ALL SELECT unit_id, variant, 'direct' FROM cohort")
def cohort_origin(spark, d):
    """The kept copy where it reaches far enough, else the assignment itself."""
    whole = demo.cohort(spark, d)
    kept = whole.filter(F.col("exposure_ts") <= F.lit(datetime(2024, 1, 9)).cast("timestamp_ntz")).withColumns({"experiment": F.lit("demo"), "loaded_at": F.lit(1)})
    out = None
    for until in (datetime(2024, 1, 8), datetime(2024, 1, 20)):
        rows, origin = cohorts.source(kept, demo.assignment(spark, d), "demo", until)
        part = rows.select("unit_id", "variant", F.lit(origin).alias("origin"))
        out = part if out is None else out.union(part)
    return out


@query(f"WITH {BASE} SELECT variant, round(var_pop(2 * value - 3 * covariate) * count(*), 3) + 0.0 AS own, round(covar_pop(2 * value - 3 * covariate, value + covariate) * count(*), 3) + 0.0 AS both_ FROM units WHERE look = 22 GROUP BY 1", 3)
def combined_comoments(spark, d):
    m = arm_moments(final_units(spark, d), ["variant"], "value", "covariate")
    w, v = weights(["value", "covariate"], value=2, covariate=-3), weights(["value", "covariate"], value=1, covariate=1)
    return m.select("variant", comoment(w, w).alias("own"), comoment(w, v).alias("both_"))


# -- planning -------------------------------------------------------------------------------


def _latest_arms(most: int = 22) -> str:
    return f"""SELECT metric, name_1, arg_max(end_ts, end_ts) AS end_ts, arg_max(mean, end_ts) AS mean, arg_max(std, end_ts) AS std, arg_max(n, end_ts) AS n FROM (
SELECT 'revenue' AS metric, look, name_1, m1 AS mean, sqrt(v1) AS std, n1 AS n, n1, n2 FROM p UNION ALL SELECT 'signup', look, name_1, k1 / n1, sqrt(k1 / n1 * (1 - k1 / n1)), n1, n1, n2 FROM p
UNION ALL SELECT 'spend_per_event', look, name_1, m1 / d1, sqrt(greatest(v1 - 2 * (m1 / d1) * c1 + (m1 / d1) * (m1 / d1) * vd1, 0) / (d1 * d1)), n1, n1, n2 FROM p) JOIN looks USING (look)
WHERE look <= {most} AND n1 >= 2 AND n2 >= 2 AND std > 0 AND n > 1 GROUP BY 1, 2"""


@query(f"WITH {BASE} SELECT metric, name_1, end_ts, round(mean, 5) + 0.0 AS mean, round(std, 5) + 0.0 AS std, round(n, 0) + 0.0 AS n FROM ({_latest_arms()})", 5)
def stored_baselines(spark, d):
    return planning.baselines_from_results(results(spark, d)).select("metric", "name_1", "end_ts", "mean", "std", "n")


#: The standardised shift at which a two-sided Normal test at 0.05 has power 0.8.
_SHIFT = power.normal_effect(1.0, 0.05, 0.8, 1.0) * math.sqrt(0.5)


@query(f"""WITH {BASE}, a AS (SELECT DISTINCT look, name_1 AS variant, k1 / n1 AS prop, n1 AS n FROM p WHERE k1 / n1 > 0 AND k1 / n1 < 0.9),
h AS (SELECT *, abs(2 * (asin(sqrt(prop * 1.1)) - asin(sqrt(prop)))) * sqrt(n / 2) AS s FROM a)
SELECT look, variant, round(prop, 6) + 0.0 AS prop, n::BIGINT AS n, round({phi_sql('x')} + {phi_sql('y')}, 6) + 0.0 AS power FROM (SELECT *, s - {critical(0.05):.17e} AS x, -s - {critical(0.05):.17e} AS y FROM h)""")
def fraction_power(spark, d):
    arms = fraction_pairs(spark, d).select("look", F.col("name_1").alias("variant"), F.col("mean_count_1").alias("prop"), F.col("n_1").alias("n")).distinct()
    return power.with_solve(arms.filter("prop > 0 and prop < 0.9"), "power", power.fraction_achieved, "prop", "n", mde=0.1)


@query(f"""WITH {BASE}, a AS (SELECT DISTINCT look, name_1 AS variant, k1 / n1 AS prop, n1 AS n FROM p WHERE k1 > 0)
SELECT look, variant, round(prop, 5) + 0.0 AS prop, n::BIGINT AS n, round((pow(sin(asin(sqrt(prop)) + {_SHIFT:.17e} / sqrt(n / 2) / 2), 2) - prop) / prop, 5) + 0.0 AS mde FROM a""", 5)
def fraction_mde(spark, d):
    arms = fraction_pairs(spark, d).filter("mean_count_1 > 0").select("look", F.col("name_1").alias("variant"), F.col("mean_count_1").alias("prop"), F.col("n_1").alias("n")).distinct()
    return power.with_solve(arms, "mde", power.fraction_mde, "prop", "n")


@query(f"""WITH {BASE}, a AS (SELECT metric, name_1, mean, n, abs(2 * (asin(sqrt(least(mean * 1.01, 1))) - asin(sqrt(mean)))) AS h FROM ({_latest_arms(6)}) WHERE metric = 'signup' AND mean < 0.95)
SELECT metric, name_1, n >= 2 * pow({_SHIFT:.17e} / h, 2) AS powered FROM a""")
def powered_arms(spark, d):
    """Whether stored arms suffice for a lift of a hundredth."""
    base = planning.baselines_from_results(results(spark, d).filter("metric = 'signup' and look <= 6")).filter("mean < 0.95")
    return planning.sized(base, 0.01).select("metric", "name_1", "powered")


def _average_size_sql(trajectories: int) -> str:
    best = corrections.best_ratio(A)
    return f"""WITH {BASE}, c AS (SELECT v1 AS base, 0.2 * m1 AS diff FROM p WHERE look = 22 AND name_1 = 'control' AND name_2 = 't1'),
l AS (SELECT i::INTEGER AS look, 50.0 * (i + 1) AS n, base * 2 / (50.0 * (i + 1)) AS v, diff, {best:.17e} * base * 2 / 50.0 AS t FROM c, range(23) t(i)),
l2 AS (SELECT *, 1 / v - coalesce(lag(1 / v) OVER (ORDER BY look), 0) AS step, sqrt(2 * v * (v + t) / t * ({math.log(1 / A):.17e} + ln((v + t) / v) / 2)) AS radius FROM l),
r0 AS (SELECT *, j AS path, md5(j || '|' || look || '|20240706') AS h FROM l2, range({trajectories}) t(j)),
r1 AS (SELECT *, sqrt(-2 * ln((('0x' || substr(h, 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)) * cos({2 * math.pi!r}::DOUBLE * (('0x' || substr(h, 14, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) AS z FROM r0),
r2 AS (SELECT hypothesis, path, look, n, abs(sum(effect * step + sqrt(step) * z) OVER (PARTITION BY hypothesis, path ORDER BY look) * v) > radius AS beyond FROM (SELECT r1.*, hypothesis, CASE hypothesis WHEN 'h1' THEN diff ELSE 0 END AS effect FROM r1, (VALUES ('h0'), ('h1')) hh(hypothesis))),
r3 AS (SELECT hypothesis, path, coalesce(min(n) FILTER (beyond), max(n)) AS n, bool_or(beyond) AS crossed FROM r2 GROUP BY 1, 2)
SELECT hypothesis, round(avg(n), 3) + 0.0 AS mean_n, round(avg(n) / 50.0, 3) + 0.0 AS mean_days, round(avg(crossed::INT), 3) + 0.0 AS crossed FROM r3, c WHERE base > 0 AND diff > 0 GROUP BY 1"""


@query(_average_size_sql(20_000), 3)
def asn(spark, d):
    p = demo.pairs(spark, d, VALUE).filter("look = 22 and name_1 = 'control' and name_2 = 't1'")
    row = p.select((F.col("m2_value_1") / F.col("n_1")).alias("v"), "mean_value_1").first()
    v, m = (row["v"], row["mean_value_1"]) if row else (0.0, 0.0)
    return planning.average_size(spark, v, 0.2 * m, A, 1.0, 50.0, [float(i) for i in range(1, 24)])


# -- replicates and placebo splits ----------------------------------------------------------


@query(f"""{_BOOT}, f AS (SELECT a.replicate, (b.value - a.value) / nullif(a.value, 0) AS boot FROM w a JOIN w b USING (replicate) WHERE a.variant = 'control' AND b.variant = 't2'),
q AS (SELECT a AS alpha, count(boot) = count(*) AS ok, quantile_cont(boot, a / 2) AS lo, quantile_cont(boot, 1 - a / 2) AS hi, least(2.0 * least(count_if(boot > 0), count_if(boot < 0)) / count(*), 1) AS pv FROM f, (VALUES (0.01::DOUBLE)) t(a) GROUP BY a
      UNION ALL SELECT a, count(boot) = count(*), quantile_cont(boot, 0.05), quantile_cont(boot, 0.95), least(2.0 * least(count_if(boot > 0), count_if(boot < 0)) / count(*), 1) FROM f, (VALUES (0.1::DOUBLE)) t(a) GROUP BY a)
SELECT 'revenue' AS metric, alpha, CASE WHEN ok THEN round(lo, 6) + 0.0 END AS left_bound, CASE WHEN ok THEN round(hi, 6) + 0.0 END AS right_bound, CASE WHEN ok THEN round(pv, 6) + 0.0 END AS pvalue, coalesce(ok AND pv < alpha, FALSE) AS reject FROM q""".replace("quantile_cont(boot, a / 2)", "quantile_cont(boot, 0.005)").replace("quantile_cont(boot, 1 - a / 2)", "quantile_cont(boot, 0.995)"))
def alpha_grid(spark, d):
    """Two levels from one set of replicates."""
    reps = resample.poisson_replicates(final_units(spark, d), ["metric"], 60, seed=7)
    return explore.tests_at(resample.replicate_effects(reps, ["metric"], ("control", "t2"), "relative"), ["metric"], (0.01, 0.1))


_LOOKS = (4, 13, 22)
_SPLITS = 40
_SPLIT = f"""WITH {BASE}, un AS (SELECT DISTINCT unit_id FROM units), mk AS (SELECT unit_id, i::INTEGER AS iteration, row_number() OVER (PARTITION BY i ORDER BY md5(unit_id || '|' || i || '|3'), unit_id) <= round(count(*) OVER (PARTITION BY i) * 0.5) AS is_a FROM un, range({_SPLITS}) t(i)),
am AS (SELECT iteration, look, is_a, count(*)::DOUBLE AS n, avg(value) AS m, var_pop(value) AS v FROM units JOIN mk USING (unit_id) WHERE look IN {_LOOKS} GROUP BY ALL),
ef AS (SELECT a.iteration, a.look, b.m - a.m AS effect, CASE WHEN a.v / a.n + b.v / b.n > 0 THEN sqrt(a.v / a.n + b.v / b.n) END AS se FROM am a JOIN am b ON a.iteration = b.iteration AND a.look = b.look WHERE a.is_a AND NOT b.is_a),
ht AS (SELECT *, coalesce(abs(effect) > se * {critical(A):.17e}, FALSE) AS hit, 2 * ({phi_sql('(-abs(effect / se))')}) AS pvalue FROM ef)"""


def splits(spark, d) -> DataFrame:
    """Effects of exact-size hashed splits of the demo's units at three looks."""
    run = fact_ops.running_units(demo.exposed(spark, d), GRID, "ts", VALUE)
    units = fact_ops.unit_panel(run, GRID, VALUE).select("unit_id", "look", "value")
    masks = calibrate.placebo_split(units.select("unit_id").distinct(), _SPLITS, 0.5, 3)
    return calibrate.split_effects(units.filter(F.col("look").isin(*_LOOKS)), masks)


@query(f"{_SPLIT} SELECT iteration, look, round(effect, 5) + 0.0 AS effect, round(se, 5) + 0.0 AS se FROM ef", 5)
def placebo_split_effects(spark, d):
    return splits(spark, d)


@query(f"""{_SPLIT}, it AS (SELECT iteration, max_by(hit, look) AS last_, max_by(abs(effect) <= se * {critical(A):.17e}, look) AS cover, bool_or(hit) AS any_ FROM ht GROUP BY 1)
SELECT round(avg(last_::INT), 6) + 0.0 AS fpr, round(avg(any_::INT), 6) + 0.0 AS peeking_fpr, round(avg(cover::INT), 6) + 0.0 AS coverage FROM it""")
def placebo_split_score(spark, d):
    return calibrate.score(splits(spark, d), A).select("fpr", "peeking_fpr", "coverage")


@query(f"""{_SPLIT}, f AS (SELECT iteration, min(look) AS look FROM ht WHERE hit GROUP BY 1)
SELECT l.look, round(count(f.iteration) / {float(_SPLITS)}, 6) + 0.0 AS crossed FROM (SELECT DISTINCT look FROM ef) l LEFT JOIN f ON f.look <= l.look GROUP BY 1""")
def placebo_split_peeking(spark, d):
    return calibrate.peeking_curve(splits(spark, d), A)


@query(f"""{_SPLIT}, k AS (SELECT iteration, bool_or(hit) AS crossed, min(look) FILTER (hit) AS first_, max(look) AS last_, min(pvalue) AS least_pvalue FROM ht GROUP BY 1)
SELECT k.iteration, crossed, ht.look, round(effect, 5) + 0.0 AS effect, round(pvalue, 5) + 0.0 AS pvalue, round(least_pvalue, 5) + 0.0 AS least_pvalue FROM k JOIN ht ON ht.iteration = k.iteration AND ht.look = CASE WHEN crossed THEN first_ ELSE last_ END""", 5)
def placebo_split_peeked(spark, d):
    return calibrate.peeked(splits(spark, d), A)


@query(f"""{_SPLIT}, m AS (SELECT iteration, look AS member, effect, pvalue, count(pvalue) OVER w AS m, row_number() OVER (PARTITION BY iteration ORDER BY pvalue NULLS LAST, look) AS i FROM ht WINDOW w AS (PARTITION BY iteration)),
j AS (SELECT *, max(least(pvalue * (m - i + 1), 1)) OVER (PARTITION BY iteration ORDER BY i) < 0.05 AS sig FROM m),
it AS (SELECT iteration, coalesce(bool_or(sig), FALSE) AS any_ FROM j GROUP BY 1)
SELECT round(avg(any_::INT), 6) + 0.0 AS fwer, round(avg(any_::INT), 6) + 0.0 AS fdr, count(*) AS iterations FROM it""")
def placebo_split_family(spark, d):
    """The three looks as a family of null members."""
    rows = splits(spark, d).select("iteration", F.col("look").alias("member"), "effect", two_sided(F.col("effect") / F.col("se")).alias("pvalue"))
    return calibrate.family_rate(rows, "holm", A)


@query(on_results("SELECT metric, name_2 FROM latest WHERE name_1 = 'control' AND pvalue > 0.3"))
def red_calibration_cells(spark, d):
    """Cells beyond a budget, with the latest p-values for rates."""
    cells = readout.latest(results(spark, d)).filter("name_1 = 'control'").withColumn("fpr", F.col("pvalue"))
    return calibrate.red_cells(cells, 0.3).select("metric", "name_2")


@query(f"WITH {BASE} SELECT look, round(avg(value), 5) + 0.0 AS mean, round(sum(value) / nullif(sum(den), 0), 5) + 0.0 AS ratio FROM units WHERE variant IN ('control', 't1') GROUP BY 1", 5)
def pooled_estimates(spark, d):
    """The calibrated contrast's arms as one."""
    roles = {"value": ("sum", "spend"), "den": ("count", "1")}
    units = fact_ops.unit_panel(fact_ops.running_units(demo.exposed(spark, d), GRID, "ts", roles), GRID, roles)
    own = calibrate.pool(units, calibrate.calibrated_contrast(VARIANTS, "control"))
    return own.groupBy("look").agg(calibrate.pooled_estimate(own, "t").alias("mean"), calibrate.pooled_estimate(own, "ratio").alias("ratio"))
