"""Command line: ``python -m trialweave run|validate|report|plan|reconcile|clean ...``."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.functions import power
from trialweave.operators import cohort, planning, readout, state
from trialweave.plans import experiment as ex
from trialweave.plans import validation
from trialweave.sources.tables import Store, read_path
from trialweave.sources.tasks import acquire, release


def _inputs(spark: SparkSession, args) -> tuple[ex.Experiment, list[ex.Metric], DataFrame, DataFrame]:
    with open(args.config, encoding="utf-8") as f:
        experiment, metrics = ex.from_config(f.read())
    assigned = cohort.dedup(read_path(spark, args.cohort))
    for warning in cohort.validate(assigned, experiment.variants):
        print(f"warning: {warning}", file=sys.stderr)
    return experiment, metrics, read_path(spark, args.facts), assigned


def run(spark: SparkSession, args) -> int:
    """Compute the pending looks and append their rows."""
    experiment, metrics, facts, assigned = _inputs(spark, args)
    store = Store(spark, args.database)
    token = acquire(store, experiment.name)
    if token is None:
        print("another run holds the lock", file=sys.stderr)
        return 2
    try:
        done = None
        if store.exists("results") and not args.full_refresh:
            done = state.settled(store.read("results").filter(F.col("experiment") == experiment.name), experiment.sequential)
            done = done.withColumn("end_ts", F.col("end_ts").cast("timestamp_ntz"))
        now = args.now or datetime.now()
        rows = ex.results(experiment, metrics, facts, assigned, min(now, experiment.grid().horizon), done)
        store.save_results(rows, datetime.now())
        release(store, token, experiment.name)
    except Exception as e:
        release(store, token, experiment.name, status="failed", error=str(e)[:500])
        raise
    return 0


def validate(spark: SparkSession, args) -> int:
    """Score every metric and method on placebo splits, and the family; keep the audit rows."""
    experiment, metrics, facts, assigned = _inputs(spark, args)
    now = datetime.now()
    rows = validation.calibrate_experiment(experiment, metrics, facts, assigned, args.iterations, args.delta, run_id=now.isoformat(), now=now)
    store = Store(spark, args.database)
    store.append("aa_runs", rows)
    store.aa_runs(experiment.name).filter(F.col("run_id") == now.isoformat()).select("metric", "method_name", "fpr", "peeking_fpr", "coverage", "achieved_mde", "verdict").show(truncate=False)
    return 0


def report(spark: SparkSession, args) -> int:
    store = Store(spark, args.database)
    rows = store.read("results").filter(F.col("experiment") == args.experiment)
    print(readout.report_html(rows, args.experiment) if args.html else json.dumps({r["metric"]: json.loads(r["payload"]) for r in readout.report(rows).collect()}))
    return 0


def plan(spark: SparkSession, args) -> int:
    """Sizes from given baselines; nothing is written."""
    need = power.t_sample_size(args.mean, args.std, args.mde, args.kind, args.alpha, args.power)
    out = {"required_n": need, "days": power.runtime_days(need, args.per_day)}
    if args.n:
        out |= {"mde": power.t_mde(args.mean, args.std, args.n, args.kind, args.alpha, args.power), "power": power.t_achieved(args.mean, args.std, args.n, args.mde, args.kind, args.alpha)}
    if args.per_day:
        delta = args.mde * abs(args.mean) if args.kind == "relative" else args.mde
        found = planning.average_size(spark, args.std**2, delta, args.alpha, 1.0, args.per_day, [float(d) for d in range(1, args.days + 1)])
        out["average_size"] = {r["hypothesis"]: {"n": r["mean_n"], "days": r["mean_days"], "crossed": r["crossed"]} for r in found.collect()}
    print(json.dumps(out))
    return 0


def reconcile(spark: SparkSession, args) -> int:
    """Compare stored rows with a full recompute; 1 if any differ."""
    experiment, metrics, facts, assigned = _inputs(spark, args)
    fields = ["effect", "left_bound", "right_bound", "pvalue"]
    keys = ["metric", "name_1", "name_2", "end_ts"]
    stored = Store(spark, args.database).read("results").filter(F.col("experiment") == experiment.name).withColumn("end_ts", F.col("end_ts").cast("timestamp_ntz"))
    counts = {r["status"]: r["count"] for r in state.reconcile(ex.results(experiment, metrics, facts, assigned), stored, keys, fields).groupBy("status").count().collect()}
    print(json.dumps(counts))
    return int(bool(set(counts) - {"equal"}))


def clean(spark: SparkSession, args) -> int:
    """List, or with ``--execute`` remove, series that the configuration no longer has."""
    with open(args.config, encoding="utf-8") as f:
        experiment, _ = ex.from_config(f.read())
    store = Store(spark, args.database)
    known = spark.createDataFrame([(c.metric, c.config_id()) for c in experiment.comparisons], "metric string, method_config_id string")
    stored = store.read("results").filter(F.col("experiment") == experiment.name)
    lost = state.orphans(stored, known, ["metric", "method_config_id"]).collect()
    for r in lost:
        print(r["metric"], r["method_config_id"], r["n_rows"])
        if args.execute:
            store.delete("results", (F.col("experiment") == experiment.name) & (F.col("metric") == r["metric"]) & (F.col("method_config_id") == r["method_config_id"]))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="trialweave", description=__doc__)
    commands = top.add_subparsers(required=True)
    for f, inputs in ((run, True), (validate, True), (reconcile, True), (clean, False), (report, False), (plan, False)):
        p = commands.add_parser(f.__name__, help=(f.__doc__ or "").split("\n")[0])
        p.set_defaults(command=f)
        p.add_argument("--database", default="default")
        if inputs or f is clean:
            p.add_argument("config")
        if inputs:
            p.add_argument("--facts", required=True)
            p.add_argument("--cohort", required=True)
        if f is run:
            p.add_argument("--full-refresh", action="store_true")
            p.add_argument("--now", type=datetime.fromisoformat)
        if f is validate:
            p.add_argument("--iterations", type=int)
            p.add_argument("--delta", type=float)
        if f is clean:
            p.add_argument("--execute", action="store_true")
        if f is report:
            p.add_argument("experiment")
            p.add_argument("--html", action="store_true")
        if f is plan:
            for name, kind, default in (("mean", float, 1.0), ("std", float, 1.0), ("mde", float, 0.05), ("alpha", float, 0.05), ("power", float, 0.8), ("n", float, None), ("per-day", float, None), ("days", int, 28)):
                p.add_argument(f"--{name}", type=kind, default=default)
            p.add_argument("--kind", choices=("relative", "absolute"), default="relative")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.command(SparkSession.builder.getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
