"""Registered queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

from trialweave.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "events customer orders"
#: One of each kind; the rest run in the driver's own comparison.
SOME = ["cohort_dedup", "arrival_rate", "exposure_count_stream", "grid_schedule", "grid_local_days", "exposed_facts", "unit_metric_sum", "unit_metric_distinct", "arm_comoments",
        "ttest_abs", "ttest_rel_fieller", "ztest_rel", "cuped_rel", "ratio_rel", "paired_cuped_rel", "srm_chi2", "srm_sequential", "holm_adjust", "results_contract",
        "always_valid_series", "readout_verdicts", "metric_rollup", "bi_latest", "bootstrap_poisson", "placebo_split", "state_reconcile", "stream_daily_totals",
        "method_paired_ttest", "method_paired_poisson_bootstrap", "placebo_split_peeked", "placebo_split_family", "asn", "ztest_score", "ztest_score_relative", "stored_baselines", "state_sources",
        "tiered_significance", "seed_column", "stream_exposures", "alpha_grid", "gate_lines", "fraction_mde"]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) + 0.0
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", SOME)
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    at = [want.columns.index(c) for c in order]
    key = lambda r: repr(r)
    assert sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=key) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)


def test_one_scan_of_the_facts_serves_all_looks(spark):
    """The executed plan reads facts, cohort and the cohort's counts, whatever the looks and metrics; the grand means reuse a shuffle."""
    rows = queries.results(spark, SF)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 3 and "ReusedExchange" in plan and "Cartesian" not in plan


@pytest.mark.parametrize("name", ("placebo_fpr", "placebo_cuped", "peeking_curve", "family_fwer"))
def test_calibration_runs_the_whole_number_of_iterations(spark, monkeypatch, name):
    from trialweave.operators import calibrate

    asked, effects = [], calibrate.placebo_effects
    monkeypatch.setattr(calibrate, "placebo_effects", lambda p, n, *a, **k: (asked.append(n), effects(p, 2, *a, **k))[1])
    queries.QUERIES[name](spark, SF)
    assert asked and set(asked) == {4000}
