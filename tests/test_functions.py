import math
from datetime import date, datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trialweave.functions import identity, power, score
from trialweave.functions.normal import critical, phi, phi_sql, two_sided
from trialweave.operators.corrections import best_ratio, chi2_tail, levels, log_gamma, require_symmetric
from trialweave.operators import planning
from trialweave.operators.grid import closed_bound, closed_days, make_grid, seconds, subsample
from trialweave.operators.moments import contrasts
from trialweave.operators.resample import apportion, apportioned


def normal_cdf(z):
    return 0.5 * math.erfc(-z / math.sqrt(2))


def test_phi_in_both_engines(spark):
    import duckdb

    zs = [-38.0, -20.0, -8.3, -5.7, -5.6, -3.0, -0.7, -0.67, -1e-9, 0.0, 0.3, 0.675, 1.96, 5.65, 5.66, 8.0, 30.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    for z, p, p2 in df.select("z", phi(F.col("z")), two_sided(F.col("z"))).collect():
        assert p == pytest.approx(normal_cdf(z), rel=1e-13) and p2 == pytest.approx(2 * normal_cdf(-abs(z)), rel=1e-13)
    for z in zs:
        assert duckdb.sql(f"SELECT {phi_sql('z')} FROM (SELECT {z!r}::DOUBLE AS z)").fetchall()[0][0] == pytest.approx(normal_cdf(z), rel=1e-13)
    odd = spark.createDataFrame([(None,), (math.nan,)], "z double").select(phi(F.col("z")).alias("p")).collect()
    assert [r.p for r in odd] == [None, None]


def test_chi2_and_log_gamma(spark):
    df = spark.createDataFrame([(x,) for x in (0.1, 1.0, 3.84, 10.0, 30.0)], "x double")
    rows = df.select("x", *[chi2_tail(F.col("x"), k) for k in (1, 2, 3, 4, 5)], log_gamma(F.col("x"))).collect()
    for r in rows:
        x = r[0]
        assert r[1] == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-12)
        assert r[2] == pytest.approx(math.exp(-x / 2), rel=1e-12)
        assert r[4] == pytest.approx(math.exp(-x / 2) * (1 + x / 2), rel=1e-12)
        assert r[3] == pytest.approx(math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2), rel=1e-12)
        assert r[6] == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-13)


def test_power_known_values():
    assert power.t_sample_size(0, 1, 0.5, "absolute") == 64
    assert power.t_power(0.5, 64, 0.05) == pytest.approx(0.8014596, abs=1e-6)
    assert power.t_power(0.5, 20, 0.05) == pytest.approx(0.3379390, abs=1e-6)
    assert power.t_quantile(0.975, 10) == pytest.approx(2.2281388520, rel=1e-9)
    assert power.t_quantile(0.975, 2) == pytest.approx(4.3026527297, rel=1e-6)
    d = power.t_effect(50.0, 0.05, 0.8, 1.0)
    assert power.t_power(d, 50, 0.05) == pytest.approx(0.8, abs=1e-9)
    assert power.t_mde(10, 0, 100) == math.inf and power.t_mde(10, 2, 1) == math.inf
    n = power.fraction_sample_size(0.1, 0.02, "absolute")
    assert power.fraction_achieved(0.1, n, 0.02, "absolute") == pytest.approx(0.8, abs=1e-3)
    assert power.fraction_sample_size(0.9, 0.2) == math.inf
    assert power.cuped_std(2.0, 0.6) == pytest.approx(1.6)
    assert power.runtime_days(100, 20) == 5 and power.runtime_days(math.inf, 20) == math.inf and power.runtime_days(None, 1) is None


def test_average_size_is_small_under_a_large_effect(spark):
    out = {r.hypothesis: r for r in planning.average_size(spark, 1.0, 0.5, 0.05, 1.0, 100, [1.0, 2.0, 4.0, 8.0], 4000).collect()}
    assert out["h1"].crossed > 0.95 and out["h1"].mean_n < out["h0"].mean_n and out["h0"].crossed < 0.05
    assert planning.average_size(spark, 1.0, 0.5, 0.05, 1.0, 100, [1.0]).collect() == []


def test_solves_run_once_for_equal_keys(spark):
    df = spark.createDataFrame([(1, 10.0, 2.0, 50.0), (2, 10.0, 2.0, 50.0), (3, None, 2.0, 50.0)], "i int, m double, s double, n double")
    got = {r.i: r.mde for r in power.with_solve(df, "mde", power.t_mde, "m", "s", "n").collect()}
    assert got[1] == got[2] == power.t_mde(10, 2, 50) and got[3] is None


@settings(max_examples=25, deadline=None)
@given(st.integers(20, 400), st.integers(20, 400), st.floats(0.05, 0.9), st.floats(0.05, 0.9))
def test_score_bounds_solve_their_equations(n1, n2, p1, p2):
    x1, x2 = max(1, round(n1 * p1)), max(1, round(n2 * p2))
    a = [np.array([float(v)]) for v in (x1, n1, x2, n2)]
    c = critical(0.05)
    lo, hi = score.interval_difference(*a, c)
    assert score.z_difference(*a, lo)[0] == pytest.approx(c, abs=1e-6) and score.z_difference(*a, hi)[0] == pytest.approx(-c, abs=1e-6)
    assert lo[0] < x2 / n2 - x1 / n1 < hi[0]
    lo, hi = score.interval_ratio(*a, c)
    assert lo[0] < (x2 / n2) / (x1 / n1) < hi[0] and score.z_ratio(*a, lo)[0] == pytest.approx(c, abs=1e-5)


def test_score_interval_of_all_or_none_has_two_sides():
    c = critical(0.05)
    for x1, x2 in ((5.0, 8.0), (0.0, 0.0)):
        lo, hi = score.interval_difference(*(np.array([v]) for v in (x1, 5.0, x2, 8.0)), c)
        a, b = (5.0, 8.0) if x1 == 0 else (8.0, 5.0)
        assert lo[0] == pytest.approx(-c * c / (a + c * c), abs=1e-9) and hi[0] == pytest.approx(c * c / (b + c * c), abs=1e-9)


def test_score_at_zero_is_the_pooled_statistic():
    x1, n1, x2, n2 = (np.array([v]) for v in (30.0, 200.0, 45.0, 210.0))
    p = (30 + 45) / 410
    assert score.z_difference(x1, n1, x2, n2, np.array([0.0]))[0] == pytest.approx((45 / 210 - 30 / 200) / math.sqrt(p * (1 - p) * (1 / 200 + 1 / 210)), rel=1e-9)


def test_durations():
    assert [seconds(x) for x in ("10min", "1h", "1d", "2w", "3 days", 90)] == [600, 3600, 86400, 1209600, 259200, 90]
    for bad in ("0d", "-1d", "x", "1y", 0, True):
        with pytest.raises(ValueError):
            seconds(bad)


def test_grid_crosses_summer_time():
    g = make_grid(date(2024, 3, 29), date(2024, 4, 3), "1d", "Europe/Berlin")
    assert [(b - a).total_seconds() / 3600 for a, b in zip((g.start, *g.ends), g.ends)] == [24, 24, 23, 24, 24]
    h = make_grid(datetime(2024, 3, 30, 12), datetime(2024, 4, 2, 12), "12h", "Europe/Berlin")
    assert {(b - a).total_seconds() for a, b in zip(h.ends, h.ends[1:-1])} == {43200.0}


def test_grid_edges():
    g = make_grid(date(2024, 1, 1), datetime(2024, 1, 4, 6), "1d")
    assert g.ends[-1] == datetime(2024, 1, 4, 6) and g.ends[-2] == datetime(2024, 1, 4)
    with pytest.raises(ValueError):
        make_grid(date(2024, 1, 2), date(2024, 1, 2))
    with pytest.raises(ValueError):
        make_grid(date(2024, 1, 1), date(2024, 2, 1), "1min")
    g = make_grid(date(2024, 1, 1), date(2024, 1, 10), (("1h", "1d"), ("1d", None)))
    assert len(g.ends) == 24 + 8


@settings(max_examples=50, deadline=None)
@given(st.integers(2, 60), st.integers(3, 300))
def test_subsample(cap, days):
    g = make_grid(date(2024, 1, 1), date.fromordinal(date(2024, 1, 1).toordinal() + days), "1d")
    picked = subsample(g, cap)
    assert len(picked) == min(cap, len(g.ends)) and picked[0] == 0 and picked[-1] == len(g.ends) - 1 and picked == sorted(set(picked))


def test_look_of_on_uneven_grids(spark):
    g = make_grid(date(2024, 1, 1), date(2024, 1, 5), (("6h", "1d"), ("1d", None)))
    ts = [datetime(2023, 12, 31), datetime(2024, 1, 1), datetime(2024, 1, 1, 5, 59), datetime(2024, 1, 1, 6), datetime(2024, 1, 2), datetime(2024, 1, 4, 23, 59), datetime(2024, 1, 5)]
    rows = spark.createDataFrame([(t,) for t in ts], "ts timestamp_ntz").select(g.look_of(F.col("ts")).alias("k")).collect()
    want = [next((i for i, e in enumerate(g.ends) if t < e), None) if t >= g.start else None for t in ts]
    assert [r.k for r in rows] == want


def test_closed_days_and_bounds():
    g = make_grid(date(2024, 1, 1), date(2024, 1, 5))
    assert [d for d, _, _ in closed_days(g, datetime(2024, 1, 3, 12))] == [date(2024, 1, 1), date(2024, 1, 2)]
    assert closed_bound(datetime(2024, 1, 1), datetime(2024, 1, 1, 5), 7200, 3600) == datetime(2024, 1, 1, 4)
    assert closed_bound(datetime(2024, 1, 1), datetime(2024, 1, 1, 1), 7200) is None


def test_identity(spark, monkeypatch):
    base = identity.method_config_id("t-test", {"test_type": "relative", "alpha": 0.01}, {"test_type": "relative"})
    assert base == identity.method_config_id("t-test", {}, {"test_type": "relative"}) != identity.method_config_id("t-test", {"test_type": "absolute"}, {"test_type": "relative"})
    assert identity.canonical_json({"b": 1, "a": [1.5, None]}) == '{"a":[1.5,null],"b":1}'
    with pytest.raises(ValueError):
        identity.canonical_json(math.nan)
    seed = identity.derive_seed("x", 1, "y")
    assert 0 <= seed < 2**63
    got = spark.range(1).select(identity.derive_seed_column(F.lit("x"), F.lit(1), F.lit("y")).alias("s")).first().s
    assert got == seed
    assert identity.normalized_sql("SELECT  a,\n 'x  y'  FROM t") == "SELECT a, 'x  y' FROM t"
    monkeypatch.setenv("WHERE_TO", "there")
    assert identity.from_environment({"a": ["${WHERE_TO}/${NOT_SET:-b}"]}) == {"a": ["there/b"]}
    with pytest.raises(KeyError):
        identity.from_environment("${NOT_SET}")
    assert identity.redacted("https://u:p@h.example:81/a?token=1#x") == "https://h.example:81/a"
    assert identity.method_name(" T_Test ") == "t-test"


def test_levels_and_contrasts():
    assert levels(0.05, 3, 2).main == 0.05 / 3 and levels(0.05, 3, 2).secondary == 0.05 / 6 and levels(0.05, 3, 2, contrasts="vs_control").main == 0.025
    assert levels(0.05, 3, 2, "holm").main == 0.05 and levels(0.05, 2, 1, guardrail_alpha=0.1).guardrail == 0.1
    assert contrasts(["a", "b", "c"], "b") == [("b", "a"), ("b", "c"), ("a", "c")]
    assert contrasts(["a", "b", "c"], "b", "vs_control") == [("b", "a"), ("b", "c")]
    u = best_ratio(0.05)
    assert u == pytest.approx(2 * math.log(20) + math.log1p(u), rel=1e-14)
    with pytest.raises(ValueError):
        require_symmetric("score", True)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=8), st.integers(8, 500))
def test_apportion_keeps_the_total(shares, total):
    out = apportioned(np.array(shares, float), total)
    assert out.sum() == total and out.min() >= 1


def test_apportion_in_both_forms(spark):
    shares = [0.5, 0.3, 0.19, 0.01]
    df = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(shares)], "stratum string, share double")
    got = [r.n for r in apportion(df, 13).orderBy("stratum").collect()]
    assert got == apportioned(np.array(shares), 13).tolist()
