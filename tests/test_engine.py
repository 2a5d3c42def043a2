import json
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.operators import calibrate, closed_form, cohort, corrections, facts, readout, resample, state
from trialweave.operators.grid import make_grid
from trialweave.operators.moments import arm_moments, merge, moments_by_look, pair_up
from trialweave.plans import experiment as ex
from trialweave.sources.tables import KEYS, Store, scan, schema

GRID = make_grid(date(2024, 1, 1), date(2024, 1, 5))


def assignment(spark, rows):
    return spark.createDataFrame([(u, v, datetime(2024, 1, 1, h)) for u, v, h in rows], "unit_id string, variant string, exposure_ts timestamp_ntz")


def test_cohort_contracts(spark):
    good = cohort.dedup(assignment(spark, [("a", "c", 1), ("a", "c", 0), ("b", "t", 2)]))
    assert cohort.validate(good, ["c", "t"]) == ["1 repeated assignment rows"]
    assert {(r.unit_id, r.exposure_ts.hour) for r in good.collect()} == {("a", 0), ("b", 2)}
    for rows, what in (([], "empty"), ([("a", "x", 1)], "undeclared"), ([("a", "c", 1), ("a", "t", 1)], "several")):
        with pytest.raises(cohort.ContractError, match=what):
            cohort.validate(cohort.dedup(assignment(spark, rows)), ["c", "t"])
    with pytest.raises(cohort.ContractError, match="lacks"):
        cohort.dedup(spark.createDataFrame([("a",)], "unit_id string"))


def panel_rows(spark, nulls=False):
    rng = np.random.default_rng(3)
    out = []
    for u in range(40):
        for _ in range(rng.integers(1, 6)):
            t = datetime(2024, 1, int(rng.integers(1, 5)), int(rng.integers(0, 24)))
            out.append((str(u), t, None if nulls and u == 7 else float(rng.normal(1000, 1))))
    return spark.createDataFrame(out, "user string, ts timestamp_ntz, value double")


def both_ways(spark, nulls):
    c = assignment(spark, [(str(u), "ct"[u % 2], u % 5) for u in range(40)])
    f = facts.exposed(panel_rows(spark, nulls), c, "user", "ts", GRID.start, GRID.horizon)
    roles = {"value": ("max", "value"), "k": ("count", "1")}
    run = facts.running_units(f, GRID, "ts", roles)
    fast = moments_by_look(run, len(GRID.ends), "value", "k")
    slow = arm_moments(facts.unit_panel(run, GRID, roles), ["look", "variant"], "value", "k")
    return [{(r.look, r.variant): r.asDict() for r in x.collect()} for x in (fast, slow)]


def test_moments_from_changes_equal_moments_of_the_panel(spark):
    fast, slow = both_ways(spark, False)
    assert fast.keys() == slow.keys()
    for k in slow:
        for c, v in slow[k].items():
            assert fast[k][c] == (v if isinstance(v, str) else pytest.approx(v, rel=1e-9, abs=1e-6)), (k, c)


def test_moments_of_a_large_mean_keep_their_digits(spark):
    """1,000 units at mean 1e9 with spread 1, at every look, and merged from parts."""
    rng = np.random.default_rng(8)
    values = 1e9 + rng.normal(0, 1, (2, 1000))
    rows = [(f"{v}{u}", v, k, k == 0, float(values[i, u]) - 3.0 * (k == 0)) for i, v in enumerate("ct") for u in range(1000) for k in (0, 1)]
    run = spark.createDataFrame(rows, "unit_id string, variant string, look int, is_new boolean, value double")
    got = {(r.variant, r.look): r for r in moments_by_look(run, 3, "value").collect()}
    parts = arm_moments(run.withColumn("part", F.pmod(F.hash("unit_id"), F.lit(7))), ["variant", "look", "part"], "value")
    whole = {(r.variant, r.look): r for r in merge(parts, ["variant", "look"], "value").collect()}
    for i, v in enumerate("ct"):
        for k in range(3):
            x = values[i] - 3.0 * (k == 0)
            for r, close in ((got[v, k], 1e-9), (whole.get((v, k), got[v, k]), 1e-7)):  # a part's own mean has 16 digits
                assert r.n == 1000 and r.m2_value == pytest.approx(((x - x.mean()) ** 2).sum(), rel=close)
                assert r.mean_value == pytest.approx(x.mean(), rel=1e-15)


def test_nulls_void_an_arm(spark):
    arms = spark.createDataFrame([("t", 1.0), ("t", None), ("c", 2.0), ("c", 4.0)], "variant string, value double")
    got = {r.variant: r for r in arm_moments(arms, ["variant"], "value").collect()}
    assert got["t"].mean_value is None and got["t"].n == 2 and got["c"].mean_value == 3.0


def test_degenerate_arms_keep_the_effect(spark):
    arms = spark.createDataFrame([("c", 0, 5, 2.0, 0.0), ("t", 0, 5, 3.0, 0.0)], "variant string, look int, n long, mean_value double, m2_value double")
    r = closed_form.t_test(pair_up(arms, [("c", "t")], ["look"])).first()
    assert r.effect == 1.0 and r.left_bound is None and r.pvalue is None and r.reject is False
    r = closed_form.t_test(pair_up(arms.withColumn("mean_value", F.lit(0.0)), [("c", "t")], ["look"]), "relative").first()
    assert r.effect is None and r.reject is False


def result_rows(spark, series, **changes):
    """Rows of one metric and pair; ``series`` are (effect, half width)."""
    base = {"metric": "m", "name_1": "c", "name_2": "t", "is_main_metric": True, "is_guardrail": False, "srm_flag": False, "srm_pvalue": 0.5, "decision_blocked": False,
            "ci_kind": "fixed", "insufficient_data": False, "desired": 1, "min_effect": None, "mde": None, "alpha": 0.05}
    rows = []
    for i, (e, h) in enumerate(series):
        lo, hi = (None, None) if h is None else (e - h, e + h)
        sig = h is not None and (lo > 0 or hi < 0)
        rows.append(base | {"end_ts": datetime(2024, 1, i + 2), "elapsed_days": float(i + 1), "is_horizon": i == len(series) - 1, "effect": e, "left_bound": lo, "right_bound": hi,
                            "significant": sig, "sign": (1 if e > 0 else -1) if sig else 0} | changes)
    kinds = {str: "string", bool: "boolean", float: "double", int: "int", datetime: "timestamp_ntz"}
    named = {"min_effect": "double", "mde": "double", "left_bound": "double", "right_bound": "double"}
    fields = ", ".join(f"{k} {named.get(k) or kinds[type(v)]}" for k, v in rows[-1].items())
    return spark.createDataFrame([tuple(r.values()) for r in rows], fields)


WIN, NONE = [(1.0, 0.5)] * 4, [(0.1, 0.5)] * 4


@pytest.mark.parametrize(("series", "changes", "verdict", "reason"), [
    (WIN, {}, "WIN", "significant"),
    (WIN, {"desired": -1}, "LOSE", "significant"),
    (WIN, {"srm_flag": True}, "INCONCLUSIVE", "srm"),
    (WIN, {"is_horizon": False}, "INCONCLUSIVE", "before horizon"),
    (WIN, {"is_horizon": False, "ci_kind": "always_valid"}, "WIN", "significant"),
    (WIN[:2], {}, "INCONCLUSIVE", "too few looks"),
    ([*WIN[:3], (1.0, None)], {}, "INCONCLUSIVE", "insufficient data"),
    ([(1.0, 0.5), (1.0, 0.5), (-1.0, 0.5)], {}, "INCONCLUSIVE", "unstable"),
    ([(0.1, 0.5), (1.0, 0.5), (1.0, 0.5)], {}, "INCONCLUSIVE", "unstable"),
    (NONE, {}, "INCONCLUSIVE", "no minimum effect"),
    (NONE, {"min_effect": 0.5}, "INCONCLUSIVE", "no mde"),
    (NONE, {"min_effect": 0.5, "mde": 0.4}, "FLAT", "powered"),
    (NONE, {"min_effect": 0.5, "mde": 0.6}, "INCONCLUSIVE", "underpowered"),
    (NONE, {"min_effect": 0.6, "ci_kind": "always_valid"}, "FLAT", "narrow interval"),
    (NONE, {"min_effect": 0.4, "ci_kind": "always_valid"}, "INCONCLUSIVE", "wide interval"),
])
def test_verdict_rules(spark, series, changes, verdict, reason):
    r = readout.verdicts(result_rows(spark, series, **changes), "c").first()
    assert (r.verdict, r.reason) == (verdict, reason)


def test_guardrail_policy(spark):
    guard = result_rows(spark, [(-1.0, 0.5)] * 4, metric="g", is_main_metric=False, is_guardrail=True)
    rows = result_rows(spark, WIN).unionByName(guard)
    assert readout.verdicts(rows, "c").first().verdict == "INCONCLUSIVE"
    assert readout.verdicts(rows, "c", policy="warn").first().verdict == "WIN"
    assert readout.verdicts(rows, "other").first().verdict == "WIN"


def test_rollup_separation(spark):
    rows = spark.createDataFrame(
        [("m", "c", "a", 1.0, 1, "WIN"), ("m", "c", "b", 2.0, 1, "WIN"), ("m", "a", "b", 1.0, 1, "WIN"), ("n", "c", "a", 1.0, 1, "WIN"), ("n", "c", "b", 1.0, 1, "WIN"),
         ("n", "a", "b", 0.0, 1, "INCONCLUSIVE"), ("o", "c", "a", 0.0, 1, "FLAT"), ("o", "c", "b", -1.0, 1, "LOSE")],
        "metric string, name_1 string, name_2 string, effect double, desired int, verdict string")
    got = {r.metric: r for r in readout.rollup(rows, "c", ["c", "a", "b"]).collect()}
    assert (got["m"].leader, got["m"].separation) == ("b", "separated")
    assert (got["n"].leader, got["n"].separation) == ("a", "co_leaders")
    assert (got["o"].leader, got["o"].separation, got["o"].losers) == (None, "no_leader", ["b"])
    assert readout.leaders_agree(readout.rollup(rows, "c", ["c", "a", "b"])).first()[0] is False


def test_corrections_by_hand(spark):
    p = [0.01, 0.04, 0.03, None, 0.005]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(p)], "family string, i int, pvalue double")
    want = {"benjamini_hochberg": [0.02, 0.04, 0.04, None, 0.02], "holm": [0.03, 0.06, 0.06, None, 0.02], "bonferroni": [0.04, 0.16, 0.12, None, 0.02]}
    for scheme, values in want.items():
        got = {r.i: r.p_adjusted for r in corrections.adjust(df, scheme, ["family"], tie=["i"]).collect()}
        for i, v in enumerate(values):
            assert got[i] is None if v is None else got[i] == pytest.approx(v)


def test_srm_counts_missing_arms(spark):
    counts = spark.createDataFrame([(0, "a", 100)], "look int, variant string, n_units long")
    r = corrections.srm(counts, {"a": 1, "b": 1}, ["look"]).first()
    assert r.srm_flag and r.chi2 == pytest.approx(100.0)


def units(spark, n=60, lift=0.0):
    rng = np.random.default_rng(1)
    rows = [("g", "ct"[i % 2], f"u{i:03d}", float(rng.normal(10, 2) + lift * (i % 2)), float(rng.normal(10, 1)), "xy"[i // 2 % 2]) for i in range(n)]
    return spark.createDataFrame(rows, "g string, variant string, unit_id string, value double, covariate double, stratum string")


@pytest.mark.parametrize("method", resample.METHODS)
def test_resampling_does_not_depend_on_partitions(spark, method):
    kind = {"test_type": "absolute"} if method == "paired-post-normed-bootstrap" else {}
    got = [resample.resampled(units(spark).repartition(n), ["g"], ("c", "t"), method, 200, ("s",), **kind).first() for n in (1, 5)]
    assert got[0] == got[1] and got[0].left_bound < got[0].right_bound


def test_resampling_finds_an_effect(spark):
    big = units(spark, 200, 3.0)
    for method in ("bootstrap", "poisson-bootstrap"):
        r = resample.resampled(big, ["g"], ("c", "t"), method, 500, test_type="absolute").first()
        assert r.reject and r.left_bound < 3.0 < r.right_bound
    reps = resample.poisson_replicates(big, ["g"], 200, strata="stratum")
    r = resample.bootstrap_test(resample.replicate_effects(reps, ["g"], ("c", "t"), "absolute"), ["g"]).first()
    assert r.reject and r.n_samples == 200
    with pytest.raises(ValueError):
        resample.resample_pair("paired-bootstrap", big.toPandas()[:3], big.toPandas()[:5], 1, 10)
    with pytest.raises(ValueError):
        resample.register_statistic("mean", None)


def test_poisson_weights_have_mean_one(spark):
    r = spark.range(20000).select(resample.poisson_weight(F.col("id").cast("string"), F.lit(0), 1).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(r[0] - 1) < 0.03 and abs(r[1] - 1) < 0.06


def test_calibration_rates(spark):
    rng = np.random.default_rng(2)
    rows = [(f"u{u}", k, float(v)) for u in range(200) for k, v in enumerate(np.cumsum(rng.normal(10, 3, 5)))]
    panel = spark.createDataFrame(rows, "unit_id string, look int, value double")
    null = calibrate.placebo_effects(panel, 600, "t", relative=True, seed=1)
    lift = calibrate.placebo_effects(panel, 600, "t", relative=True, seed=1, delta=0.1)
    r = calibrate.score(null, 0.05, lift, 0.1, calibrate.tau2_of(null, 0.05)).first()
    assert 0.02 < r.fpr < 0.09 and r.peeking_fpr > r.fpr and 0.9 < r.coverage < 0.99 and r.power > 0.9
    assert r.peeking_fpr_sequential <= 0.05 and abs(r.effect_exaggeration - 1) < 0.1
    curve = [x.crossed for x in calibrate.peeking_curve(null).orderBy("look").collect()]
    assert curve == sorted(curve) and curve[-1] == pytest.approx(r.peeking_fpr)


def test_store_keeps_versions_and_days(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS kept")
    store = Store(spark, "kept")
    when = datetime(2024, 1, 1)
    rows = lambda v, t: spark.createDataFrame([("e", "u1", v, when, t)], "experiment string, unit_id string, variant string, exposure_ts timestamp, loaded_at timestamp")
    store.append("exposures", rows("a", datetime(2024, 1, 2)))
    store.append("exposures", rows("b", datetime(2024, 1, 3)))
    assert [r.variant for r in store.read("exposures").collect()] == ["b"] and store.raw("exposures").count() == 2
    store.append("exposures", rows("c", datetime(2024, 1, 4)), "ignore")
    assert store.raw("exposures").count() == 2
    with pytest.raises(ValueError):
        store.append("exposures", rows("c", datetime(2024, 1, 4)), "fail")
    day = lambda d, v: spark.createDataFrame([("s", "k", "u", date(2024, 1, d), v, when)], "source_table string, column_set_id string, unit_id string, day date, sum_value double, version timestamp")
    store.replace_day(day(1, 5.0))
    store.replace_day(day(2, 7.0))
    store.replace_day(day(1, 6.0))
    assert state.total(store.raw("unit_state"), date(2024, 1, 1), date(2024, 1, 2)).first().sum_value == 13.0
    known = lambda s: spark.createDataFrame([("e", s)], "experiment string, status string")
    store.upsert("experiments", known("running"))
    store.upsert("experiments", known("done"))
    assert [r.status for r in store.read("experiments").collect()] == ["done"]
    store.delete("experiments", F.col("status") == "done")
    assert store.raw("experiments").count() == 0 and store.exists("experiments") and store.columns("experiments")[0] == "experiment"
    store.create("tasks")
    for d in (3, 4, 5):
        store.replace_day(day(d, 1.0))
    store.truncate_days("k", date(2024, 1, 4))
    assert sorted(r.day.day for r in store.raw("unit_state").collect()) == [1, 2, 3]
    store.delete("unit_state", F.col("day") == date(2024, 1, 2))
    assert sorted((r.day.day, r.sum_value) for r in store.raw("unit_state").collect()) == [(1, 6.0), (3, 1.0)]
    assert store.newest("exposures", "loaded_at") == datetime(2024, 1, 3) and store.newest("tasks", "updated_at") is None
    with pytest.raises(ValueError):
        store.add_columns("tasks", type(schema("tasks"))([type(schema("tasks")[0])("more", schema("tasks")[0].dataType, False)]))
    assert {r.experiment for r in store.known_experiments().collect()} == {"e"}
    assert set(KEYS) == {"experiments", "exposures", "unit_state", "unit_state_batches", "results", "aa_runs", "tasks", "notify_states"} and len(schema("results")) == 46


def test_scan_binds_parameters(spark):
    assert scan(spark, "SELECT :x AS x", x="a' OR 1=1").first().x == "a' OR 1=1"


CONFIG = {
    "name": "d", "start": "2024-01-01", "horizon": "2024-01-05", "variants": ["c", "t"], "unit": "user", "correction": "none", "mde_power": 0.8,
    "metrics": [{"name": "m", "kind": "sample", "roles": {"value": {"aggregate": "sum", "expression": "value"}}}],
    "comparisons": [{"metric": "m", "method": "ttest", "params": {"test_type": "absolute"}}]}


def test_configured_run(spark, tmp_path):
    raw = dict(CONFIG)
    e, metrics = ex.from_config(json.dumps(raw))
    c = assignment(spark, [(str(u), "ct"[u % 2], u % 5) for u in range(40)])
    out = ex.results(e, metrics, panel_rows(spark), c).collect()
    assert len(out) == 4 and all(r.mde_1 > 0 for r in out) and {r.alpha for r in out} == {0.05}
    due = ex.results(e, metrics, panel_rows(spark), c, watermark=datetime(2024, 1, 3, 12)).count()
    assert due == 2
    with pytest.raises(ValueError):
        ex.from_config(json.dumps(raw | {"comparisons": [{"metric": "nope", "method": "t-test"}]}))
    with pytest.raises(ValueError):
        ex.register_method("T_Test", "sample", None)
    with pytest.raises(ValueError):
        ex.Metric("m", "ratio", {"num": ("sum", "x")})
    assert ex.select({"a": ["x"], "b1": [], "b2": ["x"]}, ["b*", "tag:x"], ["b2"]) == ["a", "b1"]


def test_null_role_voids_results(spark):
    fast, _ = both_ways(spark, True)
    assert any(v["mean_value"] is None for v in fast.values()) and any(v["mean_value"] is not None for v in fast.values())


def test_reconcile(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (4, 1.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0 + 1e-13), (2, 2.1), (3, None), (5, 1.0)], "k int, v double")
    assert {r.k: r.status for r in state.reconcile(a, b, ["k"], ["v"]).collect()} == {1: "equal", 2: "different", 3: "equal", 4: "only_a", 5: "only_b"}


def test_command_line(spark, tmp_path, capsys):
    """Run twice, reconcile, report, clean."""
    from trialweave.__main__ import main
    from trialweave.sources.tasks import acquire, active, release

    spark.sql("CREATE DATABASE IF NOT EXISTS cli")
    config = tmp_path / "e.json"
    config.write_text(json.dumps(CONFIG | {"mde_power": None}))
    panel_rows(spark).write.parquet(str(tmp_path / "facts"))
    assignment(spark, [(str(u), "ct"[u % 2], u % 5) for u in range(40)]).write.parquet(str(tmp_path / "cohort"))
    where = [str(config), "--facts", str(tmp_path / "facts"), "--cohort", str(tmp_path / "cohort"), "--database", "cli"]
    store = Store(spark, "cli")
    assert main(["run", *where, "--now", "2024-01-03T12:00:00"]) == 0 and store.read("results").count() == 2
    assert main(["run", *where]) == 0 and store.raw("results").count() == 4
    assert main(["run", *where]) == 0 and store.raw("results").count() == 4
    assert main(["reconcile", *where]) == 0 and json.loads(capsys.readouterr().out.splitlines()[-1]) == {"equal": 4}
    assert main(["report", "d", "--database", "cli"]) == 0 and len(json.loads(capsys.readouterr().out)["m"][0]["points"]) == 4
    assert main(["report", "d", "--html", "--database", "cli"]) == 0 and "<table>" in capsys.readouterr().out
    config.write_text(json.dumps(CONFIG | {"comparisons": [{"metric": "m", "method": "t-test"}]}))
    assert main(["clean", str(config), "--database", "cli", "--execute"]) == 0 and store.raw("results").count() == 0
    assert main(["plan", "--mean", "10", "--std", "5", "--per-day", "100", "--n", "500"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["required_n"] > 100
    token = acquire(store, "x")
    assert token and acquire(store, "x") is None and active(store, "x") and not release(store, "other", "x") and release(store, token, "x") and active(store, "x") is None


def test_claims_are_never_lost(spark):
    from trialweave.sources import tasks

    spark.sql("CREATE DATABASE IF NOT EXISTS claims")
    store, t = Store(spark, "claims"), datetime(2024, 1, 1)
    tasks._put(store, "e", "all", "run", "running", t, t, "b", None, 3600)  # two claims that have met
    tasks._put(store, "e", "all", "run", "running", t, t, "a", None, 3600)
    assert tasks.active(store, "e", now=t)["locked_by"] == "a" and tasks.acquire(store, "e", now=t) is None
    assert tasks.release(store, "a", "e") and tasks.active(store, "e", now=t)["locked_by"] == "b"
    assert tasks.active(store, "e", now=datetime(2024, 1, 2)) is None  # stale
    token = tasks.acquire(store, "e", now=datetime(2024, 1, 2))
    assert token and tasks.acquire(store, "other", now=datetime(2024, 1, 2)) and not tasks.release(store, "x", "e") and tasks.release(store, "", "e", force=True)


def test_late_metrics_get_their_earlier_looks(spark):
    """Rows are pending by metric, method, pair and look; a change of the kind of interval recomputes a series."""
    spark.sql("CREATE DATABASE IF NOT EXISTS late")
    store = Store(spark, "late")
    c = assignment(spark, [(str(u), "ct"[u % 2], u % 5) for u in range(40)])
    two = CONFIG["metrics"] + [{"name": "k", "kind": "sample", "roles": {"value": {"aggregate": "count", "expression": "1"}}}]
    config = lambda names: ex.from_config(json.dumps(CONFIG | {"metrics": two, "comparisons": [{"metric": m, "method": "t-test", "params": {"test_type": "absolute"}} for m in names]}))
    e, metrics = config(["m"])
    store.save_results(ex.results(e, metrics, panel_rows(spark), c, watermark=datetime(2024, 1, 3, 12)), datetime(2024, 1, 3))
    e, metrics = config(["m", "k"])
    done = state.settled(store.read("results"), False).withColumn("end_ts", F.col("end_ts").cast("timestamp_ntz"))
    more = ex.results(e, metrics, panel_rows(spark), c, computed=done)
    assert sorted((r.metric, r.look) for r in more.collect()) == [("k", 0), ("k", 1), ("k", 2), ("k", 3), ("m", 2), ("m", 3)]
    store.save_results(more, datetime(2024, 1, 2))
    stamps = [r.created_at for r in store.raw("results").orderBy("created_at").collect()]
    assert len(set(stamps)) == 8 and stamps[2] > datetime(2024, 1, 3)
    assert state.settled(store.read("results"), False).count() == 8 and state.settled(store.read("results"), True).count() == 0


def test_streamed_day_state_and_exposures(spark, tmp_path):
    """A day over two micro-batches adds up, and an exposure is the first one in any order."""
    from trialweave.streaming.cohort import exposures, keep_day_state

    spark.sql("CREATE DATABASE IF NOT EXISTS streamed")
    store = Store(spark, "streamed")
    kind = "variant string, unit_id string, ts timestamp_ntz, value double"
    batches = [[("c", "u", datetime(2024, 1, 1, 9), 2.0), ("c", "v", datetime(2024, 1, 1, 9), 1.0)], [("c", "u", datetime(2024, 1, 1, 8), 3.0), ("c", "u", datetime(2024, 1, 2, 8), 4.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        keep_day_state(stream, store, ("s", "k"), "UTC", "ts", F.sum("value")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.unit_id, r.day.day): (r.n, r.sum_value, r.sum_value_sq) for r in store.raw("unit_state").collect()}
    assert got == {("u", 1): (1, 5.0, 25.0), ("v", 1): (1, 1.0, 1.0), ("u", 2): (1, 4.0, 16.0)}
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    exposures(stream, "unit_id", F.col("variant"), "ts").writeStream.outputMode("complete").format("memory").queryName("first_seen").trigger(availableNow=True).start().awaitTermination()
    assert {(r.unit_id, r.exposure_ts.hour, r.n_rows) for r in spark.table("first_seen").collect()} == {("u", 8, 3), ("v", 9, 1)}


def test_scanned_rows(spark, tmp_path):
    from trialweave.sources.tasks import scanned_rows

    spark.range(100).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).groupBy((F.col("id") % 3).alias("k")).count()
    df.collect()
    assert scanned_rows(df) == 100
