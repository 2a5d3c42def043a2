"""Registered queries on contracts: identities, state sources, series and levels; :mod:`trialweave.plans.queries` imports them."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.functions import identity
from trialweave.operators import corrections, readout, resample, state
from trialweave.operators import facts as fact_ops
from trialweave.operators.grid import closed_days, make_grid
from trialweave.operators.moments import arm_moments, merge
from trialweave.plans import demo
from trialweave.plans.demo import GRID, PAIRS
from trialweave.plans.oracles import A, BASE, RESULTS, on_results, r
from trialweave.plans.queries import _POISSON, RATIO, final_units, query, results

# -- cohort and identities ------------------------------------------------------------------


@query(f"WITH {BASE} SELECT variant, unit_id::BIGINT % 2 AS stratum, count(*) AS n_units, min(exposure_ts) AS first_ts, max(exposure_ts) AS last_ts FROM cohort GROUP BY 1, 2")
def stratum_counts(spark, d):
    rows = demo.cohort(spark, d).withColumn("stratum", F.col("unit_id").cast("long") % 2)
    return rows.groupBy("variant", "stratum").agg(F.count(F.lit(1)).alias("n_units"), F.min("exposure_ts").alias("first_ts"), F.max("exposure_ts").alias("last_ts"))


@query("""WITH h AS (SELECT DISTINCT event_type, user_id, sha256('demo' || chr(31) || event_type || chr(31) || user_id) AS x FROM events)
SELECT event_type, user_id, (('0x' || substr(x, 1, 16))::UBIGINT >> 1)::BIGINT AS seed FROM h""")
def seed_column(spark, d):
    """Seeds of (experiment, metric, unit)."""
    e = demo.table(spark, d, "events").select("event_type", "user_id").distinct()
    return e.withColumn("seed", identity.derive_seed_column(F.lit("demo"), F.col("event_type"), F.col("user_id")))


@query("""SELECT DISTINCT event_type, sha256(event_type || '{"n":' || user_id % 5 || '}') AS config_id FROM events""")
def config_ids(spark, d):
    """The exact bytes behind a method's identity."""
    e = demo.table(spark, d, "events")
    params = F.concat(F.lit('{"n":'), F.col("user_id") % 5, F.lit("}"))
    return e.select("event_type", identity.method_config_id_column(F.col("event_type"), params).alias("config_id")).distinct()


@query(f"WITH {BASE}, d AS (SELECT i FROM range(12) t(i)) SELECT (DATE '2024-03-05' + i::INTEGER)::DATE AS day, TIMESTAMP '2024-03-05' + i * INTERVAL 1 DAY + CASE WHEN i <= 5 THEN INTERVAL 5 HOUR ELSE INTERVAL 4 HOUR END AS opens FROM d WHERE i < 8")
def closed_local_days(spark, d):
    """New York days that have closed by the watermark, over the change to summer time."""
    grid = make_grid(date(2024, 3, 5), date(2024, 3, 20), "1d", "America/New_York")
    return spark.createDataFrame([(day, a) for day, a, _ in closed_days(grid, datetime(2024, 3, 13, 6))], "day date, opens timestamp_ntz")


# -- state ----------------------------------------------------------------------------------


def sources(spark, d) -> DataFrame:
    """Day state of two sources; the second has every third unit's series."""
    s = state.day_state(demo.exposed(spark, d), "UTC", "ts", F.sum("spend")).withColumns({"source_table": F.lit("events"), "column_set_id": F.lit("spend")})
    other = s.filter(F.col("unit_id").cast("long") % 3 == 0).withColumns({"source_table": F.lit("clicks"), "column_set_id": F.concat(F.lit("arm:"), F.col("variant"))})
    return s.unionByName(other)


_SOURCES = f"""WITH {BASE}, dd AS (SELECT variant, unit_id, CAST(ts AS DATE) AS day, sum(spend) AS v FROM x GROUP BY 1, 2, 3),
ss AS (SELECT *, 'events' AS source_table, 'spend' AS column_set_id FROM dd UNION ALL SELECT *, 'clicks', 'arm:' || variant FROM dd WHERE unit_id::BIGINT % 3 = 0)"""


@query(f"{_SOURCES} SELECT source_table, count(DISTINCT column_set_id) AS n_series, max(day) AS last_day, count(*) AS n_rows FROM ss GROUP BY 1")
def state_sources(spark, d):
    return sources(spark, d).groupBy("source_table").agg(F.countDistinct("column_set_id").alias("n_series"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("n_rows"))


@query(f"{_SOURCES} SELECT column_set_id, count(*) AS n_rows FROM ss WHERE column_set_id <> 'spend' GROUP BY 1")
def state_orphans(spark, d):
    """State series that no live metric claims."""
    return state.orphans(sources(spark, d), spark.createDataFrame([("spend",)], "column_set_id string"), ["column_set_id"])


@query(f"{_SOURCES} SELECT count(*)::BIGINT AS n, round(sum(v), 3) + 0.0 AS sum_value, round(sum(v * v), 1) + 0.0 AS sum_value_sq FROM ss WHERE source_table = 'events' AND day BETWEEN DATE '2024-01-10' AND DATE '2024-01-19'", 3)
def state_total(spark, d):
    one = sources(spark, d).filter("source_table = 'events'")
    return state.total(one, date(2024, 1, 10), date(2024, 1, 19)).select("n", "sum_value", F.round("sum_value_sq", 1).alias("sum_value_sq"))


@query("""SELECT 'orders' AS "table", o_orderstatus AS experiment, count(*) AS n_rows FROM orders GROUP BY 2 UNION ALL SELECT 'events', event_type, count(*) FROM events GROUP BY 2""")
def rows_per_table(spark, d):
    o, e = demo.table(spark, d, "orders").withColumnRenamed("o_orderstatus", "experiment"), demo.table(spark, d, "events").withColumnRenamed("event_type", "experiment")
    return state.counts_per_table({"orders": o.select("experiment"), "events": e.select("experiment")})


@query(f"WITH {BASE} SELECT variant, n::BIGINT AS n, round(md, 5) + 0.0 AS mean_den, round(cvd * n, 3) + 0.0 AS co, round(vd * n, 3) + 0.0 AS m2_den FROM arms WHERE look = 22", 5)
def merged_ratio_moments(spark, d):
    """Ratio moments of parts, merged."""
    run = fact_ops.running_units(demo.exposed(spark, d), GRID, "ts", RATIO)
    last = fact_ops.unit_panel(run, GRID, RATIO).filter("look = 22").withColumn("part", F.pmod(F.crc32(F.col("unit_id").cast("binary")), F.lit(4)))
    m = merge(arm_moments(last, ["variant", "part"], "num", "den"), ["variant"], "num", "den")
    return m.select("variant", "n", "mean_den", F.round("c_num_den", 3).alias("co"), F.round("m2_den", 3).alias("m2_den"))


# -- series and levels ----------------------------------------------------------------------


@query(on_results("SELECT metric, look, name_1, name_2, reject AS alone, coalesce(p_adjusted < 0.05, FALSE) AS significant, CASE WHEN coalesce(p_adjusted < 0.05, FALSE) THEN sign(effect)::INTEGER ELSE 0 END AS sign FROM (SELECT *, CASE WHEN is_guardrail THEN pvalue ELSE least(pvalue * count(CASE WHEN NOT is_guardrail THEN pvalue END) OVER (PARTITION BY look), 1) END AS p_adjusted FROM results)"))
def tiered_significance(spark, d):
    """A family per look under Bonferroni, guardrails judged alone."""
    rows = results(spark, d)
    out = corrections.family_significance(rows, "bonferroni", A, ["look"], ["metric", "name_1", "name_2"], "is_guardrail")
    return out.select("metric", "look", "name_1", "name_2", F.col("reject").alias("alone"), "significant", "sign")


@query(on_results("SELECT metric, name_1, name_2, count(*) AS n_rows, max(end_ts) AS last_end, count(DISTINCT ci_kind) FILTER (NOT insufficient_data) AS n_kinds, any_value(alpha) FILTER (look = 22) AS alpha FROM results GROUP BY ALL"), 12)
def series_census(spark, d):
    rows = results(spark, d)
    kinds = readout.ci_kinds(rows).select(*readout.SERIES, F.size("ci_kinds").cast("long").alias("n_kinds"))
    each = rows.groupBy(*readout.SERIES).agg(F.count(F.lit(1)).alias("n_rows"), F.max("end_ts").alias("last_end"), F.max("alpha").alias("alpha"))
    return each.join(kinds, readout.SERIES, "left").withColumn("n_kinds", F.coalesce("n_kinds", F.lit(0).cast("long")))


@query(f"WITH {RESULTS} SELECT (SELECT count(DISTINCT alpha) > 1 FROM results) AS mixed_alphas, date_diff('second', (SELECT max(end_ts) FROM results WHERE end_ts <= TIMESTAMP '2024-01-25'), (SELECT max(end_ts) FROM looks)) AS backlog_seconds")
def alphas_and_backlog(spark, d):
    rows = results(spark, d)
    done = rows.filter(F.col("end_ts") <= F.lit(datetime(2024, 1, 25)).cast("timestamp_ntz"))
    return readout.mixed_alphas(rows).crossJoin(readout.backlog_seconds(done, GRID.frame(spark)))


@query(on_results("SELECT metric, name_1, name_2, count(*) AS n_rows, FALSE AS declared FROM results WHERE metric <> 'revenue' OR name_1 <> 'control' GROUP BY ALL UNION ALL SELECT metric, name_1, name_2, count(*), TRUE FROM results WHERE metric = 'revenue' AND name_1 = 'control' GROUP BY ALL"))
def declared_series(spark, d):
    """Rows of declared series, and the others' counts."""
    declared = spark.createDataFrame([("revenue", *p) for p in PAIRS if p[0] == "control"], "metric string, name_1 string, name_2 string")
    kept, other = readout.declared_only(results(spark, d), declared, readout.SERIES)
    mine = kept.groupBy(*readout.SERIES).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("declared", F.lit(True))
    return other.withColumn("declared", F.lit(False)).unionByName(mine)


_STRATA = f"""WITH {BASE}, su AS (SELECT variant, unit_id, value, unit_id::BIGINT % 2 AS st, 1.0::DOUBLE / count(*) OVER (PARTITION BY variant, unit_id::BIGINT % 2) AS sc FROM units WHERE look = 22),
b AS (SELECT variant, value, sc, i AS replicate, ('0x' || substr(md5(unit_id || '|' || i || '|9'), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM su, range(50) t(i)),
w AS (SELECT variant, replicate, sum(({_POISSON}) * sc * value) / nullif(sum(({_POISSON}) * sc), 0) AS value FROM b GROUP BY 1, 2),
f AS (SELECT b2.value - a.value AS boot FROM w a JOIN w b2 USING (replicate) WHERE a.variant = 'control' AND b2.variant = 't2')"""


@query(f"{_STRATA} SELECT 'revenue' AS metric, count(*) AS n_samples, CASE WHEN count(boot) = count(*) THEN round(quantile_cont(boot, 0.025), 6) + 0.0 END AS left_bound, CASE WHEN count(boot) = count(*) THEN round(least(2.0 * (least(count_if(boot >= 0), count_if(boot <= 0)) + 1) / (count(*) + 1), 1), 6) + 0.0 END AS pvalue FROM f")
def bootstrap_poststratified(spark, d):
    """Units weighted by their stratum's size, with the p-value that counts the sample itself."""
    reps = resample.poisson_replicates(final_units(spark, d), ["metric"], 50, seed=9, strata="stratum")
    out = resample.bootstrap_test(resample.replicate_effects(reps, ["metric"], ("control", "t2"), "absolute"), ["metric"], kind="plugin")
    return out.select("metric", "n_samples", "left_bound", "pvalue")


@query(f"WITH {BASE} SELECT look, name_1, name_2, round(x1, 5) + 0.0 AS cov_value_1, round(sqrt(vx1), 5) + 0.0 AS cov_std_1, round(x2, 5) + 0.0 AS cov_value_2, round(cx1 * n1, 2) + 0.0 AS c_1 FROM p WHERE n1 >= 2 AND n2 >= 2", 5)
def covariate_from_rows(spark, d):
    """Covariate moments rebuilt from persisted rows: c = r sd(y) sd(x) n."""
    rows = results(spark, d, comparisons=(demo.Comparison("revenue", "cuped", "main", {"test_type": "absolute"}),)).filter("not insufficient_data")
    c = F.coalesce(F.col("corr_coef_1"), F.lit(0.0)) * F.col("std_1") * F.col("cov_std_1") * F.col("size_1")
    return rows.select("look", "name_1", "name_2", "cov_value_1", "cov_std_1", "cov_value_2", F.round(c, 2).alias("c_1"))
