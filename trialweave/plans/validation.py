"""An experiment's A/A calibration: all cells of metrics and methods, and the family."""

from __future__ import annotations

import math
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.functions import identity, power
from trialweave.operators import calibrate
from trialweave.operators import facts as fact_ops
from trialweave.operators.grid import Grid, subsample
from trialweave.plans.experiment import Comparison, Experiment, Metric, method
from trialweave.sources.tables import SCHEMAS

#: Looks of a panel at most; the densest early part and the last one stay.
MOST_LOOKS = 100
#: The placebo engine's name of a method.
KINDS = {"t-test": "t", "cuped-t-test": "cuped", "z-test": "z", "ratio-delta": "ratio"}


def cells(experiment: Experiment, metrics: list[Metric], extra: tuple[str, ...] = ()) -> list[Comparison]:
    """Every (metric, method) once: the declared comparisons, then ``extra`` methods that fit a metric's kind."""
    kinds = {m.name: m.kind for m in metrics}
    out: dict[tuple[str, str], Comparison] = {}
    for c in experiment.comparisons:
        out.setdefault((c.metric, c.config_id()), c)
    for c in experiment.comparisons:
        for name in extra:
            if method(name)[1] == kinds[c.metric]:
                more = replace(c, method=name, params={k: v for k, v in c.params.items() if k == "test_type"})
                out.setdefault((more.metric, more.config_id()), more)
    return [c for c in out.values() if method(c.method)[0] in KINDS]


def panel(experiment: Experiment, metric: Metric, facts: DataFrame, cohort: DataFrame, adjusted: bool) -> DataFrame:
    """The pooled units of the calibrated contrast at up to ``MOST_LOOKS`` looks."""
    grid: Grid = experiment.grid()
    pair = calibrate.calibrated_contrast(experiment.variants, experiment.base)
    joined = fact_ops.exposed(facts, cohort, experiment.unit, experiment.ts, grid.start, grid.horizon)
    names = dict(zip(metric.roles, ("value", "den")))
    roles = {names[r]: v for r, v in metric.roles.items() if metric.kind != "fraction" or r == "count"}
    units = calibrate.pool(fact_ops.unit_panel(fact_ops.running_units(joined, grid, experiment.ts, roles), grid, roles), pair)
    if len(grid.ends) > MOST_LOOKS:
        units = units.filter(F.col("look").isin(list(subsample(grid, MOST_LOOKS))))
    if adjusted:
        value = F.sum(fact_ops.as_column(metric.roles["value"][1]))
        units = fact_ops.with_covariate(units, fact_ops.covariate(facts, cohort, experiment.unit, experiment.ts, grid, experiment.covariate_days, value))
    return units.drop("variant")


def achieved_mde(kind: str, units: DataFrame, share: float, alpha: float, relative: bool, target: float) -> float | None:
    """The effect that the latest look's control half would detect."""
    last = units.filter(F.col("look") == units.agg(F.max("look")).first()[0])
    row = last.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), *([F.corr("value", "covariate").alias("rho")] if kind == "cuped" else [])).first()
    n, ratio, test = row["n"] * share, (1 - share) / share, "relative" if relative else "absolute"
    try:
        if kind == "z":
            out = power.fraction_mde(row["mean"], n, test, alpha, target, ratio)
        elif kind == "ratio":
            return None
        else:
            std = power.cuped_std(row["std"], row["rho"]) if kind == "cuped" and row["rho"] is not None and power.corr_is_usable(row["rho"]) else row["std"]
            out = power.t_mde(row["mean"], std, n, test, alpha, target, ratio)
    except (TypeError, ValueError, ZeroDivisionError):
        return None
    return out if math.isfinite(out) else None


def calibrate_experiment(
        experiment: Experiment, metrics: list[Metric], facts: DataFrame, cohort: DataFrame, iterations: int | None = None, delta: float | None = None, extra: tuple[str, ...] = (),
        seed: int = 0, budget: float | None = None, run_id: str = "run", now: datetime | None = None) -> DataFrame:
    """Audit rows of all cells and, with two members or more, of the family.

    A cell that fails is a row of status ``failed`` with its error; the others go on.  With
    ``delta`` the treatment half is scaled by ``1 + delta`` in a second pass.
    """
    spark, now = facts.sparkSession, now or datetime.now()
    share = calibrate.control_share(experiment.shares(), calibrate.calibrated_contrast(experiment.variants, experiment.base))
    by_name, rows, family = {m.name: m for m in metrics}, [], {}
    for c in cells(experiment, metrics, extra):
        alpha, kind, relative = experiment.level(c), KINDS[method(c.method)[0]], c.resolved()["test_type"] == "relative"
        n = iterations or calibrate.iterations_for(alpha)
        limit = calibrate.fpr_budget(alpha, budget)
        row = {
            "experiment": experiment.name, "run_id": run_id, "metric": c.metric, "method_name": method(c.method)[0], "method_params": identity.canonical_json(c.resolved()),
            "method_config_id": c.config_id(), "mode": "aa" if delta is None else "aa+injection", "iterations": n, "alpha": alpha, "injected_effect": delta, "created_at": now}
        try:
            units = panel(experiment, by_name[c.metric], facts, cohort, kind == "cuped")
            pooled = units.groupBy("look").agg(calibrate.pooled_estimate(units, kind).alias("p")).orderBy(F.col("look").desc()).first()
            own = identity.derive_seed(experiment.name, c.metric, seed)
            null = calibrate.placebo_effects(units, n, kind, share, own, relative=relative)
            tau2 = calibrate.tau2_of(null, alpha) if experiment.sequential else None
            truth = None if delta is None else calibrate.injected_truth(delta, relative, pooled["p"])
            lift = None if truth is None else calibrate.placebo_effects(units, n, kind, share, own, delta, relative)
            found = calibrate.score(null, alpha, lift, truth or 0.0, tau2).first().asDict()
            inside = found["fpr"] is not None and found["fpr"] <= limit
            row |= found | {
                "tau2": tau2, "achieved_mde": achieved_mde(kind, units, share, alpha, relative, experiment.mde_power or 0.8), "status": "ok",
                "verdict": "no data" if found["fpr"] is None else f"{'within' if inside else 'over'} budget ({found['fpr']:.4f} of {limit:.4f})",
                "details": identity.canonical_json({"cell": calibrate.cell_hash(c.metric, c.config_id(), row["mode"], alpha), "clamped": calibrate.injection_clamped(kind, pooled["p"], delta or 0.0), "share": share})}
            if c.role != "guardrail":
                family[f"{c.metric}|{c.config_id()}"] = (units, kind)
        except Exception as e:  # one cell's failure is a row, not the run's end
            row |= {"status": "failed", "verdict": "failed", "details": "{}", "error_message": str(e)[:500]}
        rows.append(row)
    if len(family) > 1:
        n = iterations or calibrate.iterations_for(experiment.alpha)
        found = {r["view"]: r for r in calibrate.family_sweep(family, n, experiment.correction, experiment.alpha, seed, share).collect()}
        rows.append({
            "experiment": experiment.name, "run_id": run_id, "metric": calibrate.FAMILY, "method_name": experiment.correction, "method_params": "{}", "method_config_id": experiment.correction,
            "mode": "family", "iterations": n, "alpha": experiment.alpha, "fpr": found["horizon"]["fwer"], "peeking_fpr": found["peeking"]["fwer"], "status": "ok",
            "verdict": f"{found['horizon']['fwer']:.4f} of {calibrate.fpr_budget(experiment.alpha):.4f}",
            "details": identity.canonical_json({"fdr": found["horizon"]["fdr"], "peeking_fdr": found["peeking"]["fdr"], "members": sorted(family)}), "created_at": now})
    columns = [part.split()[:2] for part in SCHEMAS["aa_runs"].split(",")]
    values = [tuple(float(r[c]) if kind.startswith("double") and r.get(c) is not None else r.get(c) for c, kind in columns) for r in rows]
    return spark.createDataFrame(values, ", ".join(f"{c} {kind.rstrip('*')}" for c, kind in columns))
