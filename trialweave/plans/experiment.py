"""An experiment as one logical plan: cohort, facts, looks, tests, gates, result rows."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions import identity, power
from trialweave.functions.columns import div, finite
from trialweave.functions.score import with_score_interval
from trialweave.operators import closed_form, cohort as cohorts, corrections, facts as fact_ops, resample
from trialweave.operators.explore import combined_mde
from trialweave.operators.grid import Grid, looks_before_horizon, make_grid, seconds
from trialweave.operators.moments import contrasts, moments_by_look, pair_up

DEFAULTS = {"test_type": "relative", "interval": "delta"}
#: Defaults of methods that read units.
UNIT_DEFAULTS = {"test_type": "relative", "n_samples": 1000, "statistic": "mean", "stratify": False, "weight_method": "min", "pvalue_kind": "sign"}


@dataclass(frozen=True)
class Param:
    """What a parameter may be: a type, choices, or bounds (inclusive)."""

    kind: type
    choices: tuple = ()
    least: float | None = None
    most: float | None = None

    def validate(self, name: str, value: object, method: str) -> object:
        if self.kind is float and type(value) is int:
            value = float(value)
        if type(value) is not self.kind:
            raise ValueError(f"{method}: {name} is a {self.kind.__name__}, not {value!r}")
        if self.choices and value not in self.choices:
            raise ValueError(f"{method}: {name} is one of {list(self.choices)}, not {value!r}")
        if self.least is not None and value < self.least or self.most is not None and value > self.most:
            raise ValueError(f"{method}: {name} lies between {self.least} and {self.most}, not {value!r}")
        return value


PARAMS = {
    "test_type": Param(str, closed_form.KINDS), "interval": Param(str, ("delta", "fieller", "pooled", "score")), "covariate_days": Param(int, least=1, most=365),
    "n_samples": Param(int, least=2, most=100_000), "statistic": Param(str, tuple(resample.STATISTICS)), "stratify": Param(bool), "weight_method": Param(str, ("min", "mean")),
    "pvalue_kind": Param(str, ("sign", "plugin"))}


@dataclass(frozen=True)
class Metric:
    """``roles`` map a role to (running aggregate, expression): ``value``; ``count``, ``nobs``; or ``num``, ``den``."""

    name: str
    kind: str
    roles: dict[str, tuple[str, Column | str]]

    def __post_init__(self):
        need = {"sample": {"value"}, "fraction": {"count", "nobs"}, "ratio": {"num", "den"}}
        if self.kind not in need or set(self.roles) != need[self.kind]:
            raise ValueError(f"a {self.kind} metric has roles {sorted(need.get(self.kind, ()))}")


METHODS: dict[str, tuple[str, object]] = {
    "t-test": ("sample", closed_form.t_test), "cuped-t-test": ("sample", closed_form.cuped),
    "z-test": ("fraction", closed_form.z_test), "ratio-delta": ("ratio", closed_form.ratio_delta)}
ALIASES: dict[str, str] = {"ttest": "t-test", "ztest": "z-test", "cuped": "cuped-t-test"}
#: Methods that read units at every look: whether they want pairs, and a covariate.
UNIT_METHODS: dict[str, tuple[bool, bool]] = {
    "paired-t-test": (True, False), "paired-cuped-t-test": (True, True), "bootstrap": (False, False), "poisson-bootstrap": (False, False), "paired-bootstrap": (True, False),
    "paired-poisson-bootstrap": (True, False), "post-normed-bootstrap": (False, True), "paired-post-normed-bootstrap": (True, False)}
METHODS |= {name: ("sample", None) for name in UNIT_METHODS}
#: Test types that a method is confined to.
ONLY = {"post-normed-bootstrap": "relative", "paired-post-normed-bootstrap": "absolute"}


def register_method(name: str, kind: str, build, aliases: tuple[str, ...] = ()) -> None:
    """Add a test: ``build(df, test_type=..., alpha=..., ...)`` puts result columns on paired-up moments."""
    name = identity.method_name(name)
    for n in (name, *map(identity.method_name, aliases)):
        if n in METHODS or n in ALIASES:
            raise ValueError(f"method {n!r} exists")
    METHODS[name] = (kind, build)
    ALIASES.update((identity.method_name(a), name) for a in aliases)


def method(name: str) -> tuple[str, str, object]:
    name = identity.method_name(name)
    name = ALIASES.get(name, name)
    if name not in METHODS:
        raise ValueError(f"no method {name!r}")
    return (name, *METHODS[name])


@dataclass(frozen=True)
class Comparison:
    metric: str
    method: str
    role: str = "main"
    params: dict = field(default_factory=dict)
    min_effect: float | None = None
    desired: int = 1

    def resolved(self) -> dict:
        name = method(self.method)[0]
        defaults = self.defaults()
        if unknown := set(self.params) - set(defaults) - {"covariate_days"}:
            raise ValueError(f"{name} has no parameters {sorted(unknown)}")
        out = defaults | {k: PARAMS[k].validate(k, v, name) for k, v in self.params.items()}
        if out.get("interval") == "fieller" and out["test_type"] == "absolute":
            raise ValueError("fieller is for relative effects")
        if out["test_type"] != ONLY.get(name, out["test_type"]):
            raise ValueError(f"{name} is {ONLY[name]} only")
        return out

    def defaults(self) -> dict:
        name = method(self.method)[0]
        if name.startswith("paired") and name.endswith("t-test"):
            return DEFAULTS
        return UNIT_DEFAULTS | ({"test_type": ONLY[name]} if name in ONLY else {}) if name in UNIT_METHODS else DEFAULTS

    def adjusted(self) -> bool:
        """Whether the method wants the metric's pre-period value."""
        name = method(self.method)[0]
        return name == "cuped-t-test" or UNIT_METHODS.get(name, (False, False))[1]

    def config_id(self) -> str:
        return identity.method_config_id(method(self.method)[0], self.resolved(), self.defaults())


@dataclass(frozen=True)
class Experiment:
    name: str
    start: date | datetime
    horizon: date | datetime
    variants: tuple[str, ...]
    comparisons: tuple[Comparison, ...]
    unit: str = "unit_id"
    ts: str = "ts"
    cadence: object = "1d"
    zone: str = "UTC"
    control: str | None = None
    split: dict[str, float] | None = None
    alpha: float = 0.05
    correction: str = "bonferroni"
    guardrail_alpha: float | None = None
    contrast_kind: str = "all_pairs"
    sequential: bool = False
    srm_alpha: float = corrections.SRM_ALPHA
    sequential_srm: bool = False
    min_units: int = 2
    data_lag: str | int | None = None
    covariate_days: int = 7
    mde_power: float | None = None

    def __post_init__(self):
        if len(self.variants) < 2 or len(set(self.variants)) != len(self.variants):
            raise ValueError("an experiment has two different variants at least")
        for c in self.comparisons:
            corrections.require_symmetric(c.resolved().get("interval", "percentile" if method(c.method)[0] in UNIT_METHODS else "delta"), self.sequential)

    @property
    def base(self) -> str:
        return self.control or self.variants[0]

    def grid(self) -> Grid:
        return make_grid(self.start, self.horizon, self.cadence, self.zone)

    def pairs(self) -> list[tuple[str, str]]:
        return contrasts(list(self.variants), self.base, self.contrast_kind)

    def shares(self) -> dict[str, float]:
        return self.split or {v: 1.0 for v in self.variants}

    def level(self, comparison: Comparison) -> float:
        others = sum(c.role != "main" and not (c.role == "guardrail" and self.guardrail_alpha) for c in self.comparisons)
        found = corrections.levels(self.alpha, len(self.variants), others, self.correction, self.guardrail_alpha, self.contrast_kind)
        return getattr(found, comparison.role)


#: What names a series of result rows.
KEY = ("metric", "method_config_id", "name_1", "name_2")
NUMBERS = ("value_1", "value_2", "std_1", "std_2", "cov_value_1", "cov_value_2", "cov_std_1", "cov_std_2", "corr_coef_1", "corr_coef_2",
           "effect", "left_bound", "right_bound", "ci_length", "pvalue")


def _from_units(experiment: Experiment, metric: Metric, c: Comparison, panel: DataFrame) -> DataFrame:
    """(look, name_1, name_2, effect, ...) of a method that reads units (``panel``), for every look and pair."""
    name, _, _ = method(c.method)
    params, alpha, out = c.resolved(), experiment.level(c), None
    paired, adjusted = UNIT_METHODS[name]
    # A paired method knows a unit by its pair.
    units = panel.select(
        "look", "variant", (F.col("pair_id") if paired else F.col("unit_id")).cast("string").alias("unit_id"), F.col(f"{metric.name}__value").alias("value"),
        *([F.col(f"{metric.name}__covariate").alias("covariate")] if adjusted else []), *(["stratum"] if params.get("stratify") else []))
    for pair in experiment.pairs():
        a, b = (units.filter(F.col("variant") == v) for v in pair)
        if paired:
            both = a.select("look", "unit_id").intersect(b.select("look", "unit_id"))
        if name in ("paired-t-test", "paired-cuped-t-test"):
            one, two = (x.select("look", "unit_id", *[F.col(r).alias(f"{r}{k}") for r in ("value", *["covariate"] * adjusted)]) for k, x in ((1, a), (2, b)))
            test = closed_form.paired_cuped if adjusted else closed_form.paired_t
            found = test(one.join(two, ["look", "unit_id"]), ["look"], params["test_type"], params["interval"], alpha).withColumn("pairs", F.col("n"))
        else:
            own = units.filter(F.col("variant").isin(*pair))
            own = own.join(both, ["look", "unit_id"], "left_semi") if paired else own
            sizes = both.groupBy("look").agg(F.count(F.lit(1)).alias("pairs")) if paired else None
            if name.endswith("poisson-bootstrap"):
                reps = resample.poisson_replicates(own, ["look"], params["n_samples"], identity.derive_seed(experiment.name, metric.name, *pair), strata="stratum" if params["stratify"] else None)
                found = resample.bootstrap_test(resample.replicate_effects(reps, ["look"], pair, params["test_type"]), ["look"], alpha, params["pvalue_kind"])
                means = own.groupBy("look").agg(*[F.avg(F.when(F.col("variant") == v, F.col("value"))).alias(f"__m{k}") for k, v in enumerate(pair)])
                effect = F.col("__m1") - F.col("__m0")
                found = found.join(means, "look").withColumn("effect", finite(div(effect, F.col("__m0")) if params["test_type"] == "relative" else effect))
            else:
                found = resample.resampled(
                    own, ["look"], pair, name, params["n_samples"], (experiment.name, metric.name, *pair), alpha, params["pvalue_kind"], statistic=params["statistic"],
                    test_type=params["test_type"], stratified=params["stratify"], weight_method=params["weight_method"])
            found = found.withColumn("ci_length", F.col("right_bound") - F.col("left_bound"))
            found = found.join(sizes, "look", "left") if paired else found.withColumn("pairs", F.lit(None).cast("long"))
        found = found.select("look", F.lit(pair[0]).alias("name_1"), F.lit(pair[1]).alias("name_2"), "effect", "left_bound", "right_bound", "ci_length", "pvalue", "reject", F.col("pairs").cast("long").alias("pairs"))
        out = found if out is None else out.union(found)
    return out


def _tested(experiment: Experiment, metric: Metric, c: Comparison, paired: DataFrame, out: str, panel: DataFrame | None = None) -> DataFrame:
    """Add one comparison's result as the struct ``out``, from the metric's prefixed moments or from units."""
    name, kind, build = method(c.method)
    if metric.kind != kind:
        raise ValueError(f"{name} wants a {kind} metric")
    params, alpha, kept = c.resolved(), experiment.level(c), paired.columns
    roles = [*metric.roles, *(["covariate"] if f"mean_{metric.name}__covariate_1" in kept else [])]
    own = {r: f"{metric.name}__{r}" for r in roles}
    names = {f"{m}_{r}_{k}": f"{m}_{own[r]}_{k}" for m in ("mean", "m2") for r in roles for k in (1, 2)}
    names |= {f"c_{a}_{b}_{k}": f"c_{own[a]}_{own[b]}_{k}" for a in roles for b in roles for k in (1, 2)}
    df = paired.withColumns({new: F.col(old) for new, old in names.items() if old in kept and new != old})
    if name in UNIT_METHODS:
        found = _from_units(experiment, metric, c, panel)
        at = {k: f"__u_{k}" for k in ("look", "name_1", "name_2")}
        df = df.join(F.broadcast(found.withColumnsRenamed(at)), [F.col(k) == F.col(v) for k, v in at.items()], "left").drop(*at.values())
        df = df.withColumns({x: F.col(y) for k in (1, 2) for x, y in ((f"value_{k}", f"mean_value_{k}"),)} | {f"std_{k}": F.sqrt(F.col(f"m2_value_{k}") / F.col(f"n_{k}")) for k in (1, 2)})
        df = df.withColumn("reject", F.coalesce("reject", F.lit(False)))
    elif kind == "fraction":
        df = df.withColumns({f"{r}_{k}": F.col(f"mean_{r}_{k}") * F.col(f"n_{k}") for r in ("count", "nobs") for k in (1, 2)})
        df = build(df, params["test_type"], alpha)
        if params["interval"] == "score":
            df = with_score_interval(df, params["test_type"], alpha)
    else:
        df = build(df, params["test_type"], "fieller" if params["interval"] == "fieller" else "delta", alpha)
    notes = F.col("warnings") if "warnings" in df.columns else F.array().cast("array<string>")
    result = F.struct(
        F.lit(metric.name).alias("metric"), F.lit(kind).alias("kind"), F.lit(c.role == "main").alias("is_main_metric"), F.lit(c.role == "guardrail").alias("is_guardrail"),
        F.lit(name).alias("method_name"), F.lit(identity.canonical_json(params)).alias("method_params"), F.lit(c.config_id()).alias("method_config_id"),
        *[(finite(F.col(k)) if k in df.columns else F.lit(None).cast("double")).alias(k) for k in NUMBERS], F.col("reject").alias("reject"),
        F.lit(alpha).alias("alpha"), F.lit("fixed").alias("ci_kind"), F.to_json(notes).alias("warnings"),
        F.lit(c.min_effect).cast("double").alias("min_effect"), F.lit(c.desired).alias("desired"), (F.col("pairs") if "pairs" in df.columns else F.lit(None).cast("long")).alias("pairs"))
    return df.withColumn(out, result).select(*kept, out)


def results(experiment: Experiment, metrics: list[Metric], facts: DataFrame, cohort: DataFrame, watermark: datetime | None = None, computed: DataFrame | None = None) -> DataFrame:
    """The result rows of all comparisons, looks and pairs.

    All metrics and looks come from one scan of the facts and one aggregation by (unit,
    look); after it only looks x variants rows remain, and every test is a projection of
    them.  Looks after the watermark are left out, and so are the rows that ``computed``
    has: it names them by any of ``end_ts``, ``metric``, ``method_config_id``, ``name_1`` and
    ``name_2``, so a metric, method or pair added late gets its earlier looks.
    """
    spark, grid = facts.sparkSession, experiment.grid()
    looks = grid.frame(spark)
    if watermark is not None and experiment.data_lag:
        watermark -= timedelta(seconds=seconds(experiment.data_lag))
    used = [m for m in metrics if any(c.metric == m.name for c in experiment.comparisons)]
    roles = {f"{m.name}__{r}": v for m in used for r, v in m.roles.items()}
    groups = [tuple(f"{m.name}__{r}" for r in m.roles) for m in used]
    joined = fact_ops.exposed(facts, cohort, experiment.unit, experiment.ts, grid.start, grid.horizon)
    running = fact_ops.running_units(joined, grid, experiment.ts, roles)
    adjusted = {c.metric for c in experiment.comparisons if c.adjusted()}
    own = {f"{m.name}__covariate": F.sum(fact_ops.as_column(m.roles["value"][1])) for m in used if m.name in adjusted}
    groups = [(*g, f"{m.name}__covariate") if m.name in adjusted else g for g, m in zip(groups, used)]
    fixed = tuple(own)
    if own:
        running = fact_ops.with_covariates(running, fact_ops.covariates(facts, cohort, experiment.unit, experiment.ts, grid, experiment.covariate_days, own))
    panel = None
    if any(method(c.method)[0] in UNIT_METHODS for c in experiment.comparisons):
        more = [x for x in ("pair_id", "stratum") if x in cohort.columns]
        panel = fact_ops.unit_panel(running, grid, [*roles, *fixed])
        panel = panel.join(cohort.select("unit_id", *more), "unit_id") if more else panel
    paired = pair_up(moments_by_look(running, len(grid.ends), *roles, fixed=fixed, groups=groups), experiment.pairs(), ["look"])
    by_name = {m.name: m for m in used}
    for i, c in enumerate(experiment.comparisons):
        paired = _tested(experiment, by_name[c.metric], c, paired, f"__r{i}", panel)
    tested = F.explode(F.array(*[f"__r{i}" for i in range(len(experiment.comparisons))])).alias("r")
    rows = paired.select("look", "name_1", "name_2", F.col("n_1").cast("long").alias("size_1"), F.col("n_2").cast("long").alias("size_2"), tested)
    rows = rows.select("look", "name_1", "name_2", *[F.coalesce("r.pairs", s).alias(s) for s in ("size_1", "size_2")], "r.*").drop("pairs")
    rows = _with_mde(experiment, rows)
    if experiment.sequential:
        levels = sorted({experiment.level(c) for c in experiment.comparisons})
        rows = corrections.always_valid(corrections.with_tau2(rows, ["metric", "method_config_id", "name_1", "name_2"], levels), levels)
    counts = cohorts.counts_by_look(cohort, grid, experiment.variants)
    gate = (corrections.srm_sequential(counts, experiment.shares(), experiment.srm_alpha) if experiment.sequential_srm
            else corrections.srm(counts, experiment.shares(), ["look"], experiment.srm_alpha)).select("look", "srm_flag", "srm_pvalue")
    due = looks if watermark is None else looks.filter(F.col("end_ts") <= F.lit(watermark).cast("timestamp_ntz"))
    out = rows.join(F.broadcast(due), "look").join(F.broadcast(gate), "look")
    if computed is not None:
        known = [c for c in ("end_ts", *KEY) if c in computed.columns]
        out = out.join(computed.select(*known).distinct(), known, "left_anti")
    few = (F.col("size_1") < experiment.min_units) | (F.col("size_2") < experiment.min_units)
    void = lambda c: F.when(~few, F.col(c))
    return out.withColumns({
        "experiment": F.lit(experiment.name), "start_ts": F.lit(grid.start).cast("timestamp_ntz"), "window_seconds": F.round(F.col("elapsed_days") * 86400).cast("long"),
        "insufficient_data": few, "decision_blocked": F.col("srm_flag"), **{c: void(c) for c in ("effect", "left_bound", "right_bound", "ci_length", "pvalue", "reject")},
        "watermark_ts": F.lit(watermark or grid.horizon).cast("timestamp_ntz")})


def results_of_many(runs: list[tuple[Experiment, list[Metric], DataFrame, DataFrame]], watermark: datetime | None = None) -> DataFrame:
    """The result rows of several experiments as one plan; its branches run side by side."""
    out = None
    for experiment, metrics, facts, cohort in runs:
        rows = results(experiment, metrics, facts, cohort, watermark)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def untiered(experiment: Experiment) -> frozenset[str]:
    """Metrics outside the corrected family: guardrails with a level of their own."""
    return frozenset(c.metric for c in experiment.comparisons if c.role == "guardrail" and experiment.guardrail_alpha)


def pair_mde(experiment: Experiment, rows: DataFrame) -> DataFrame:
    """Rows with ``mde``: the larger of the arms', stored or, where not stored, solved at power 0.8 from the row itself."""
    solved = _with_mde(dataclasses.replace(experiment, mde_power=experiment.mde_power or 0.8), rows.drop("mde_1", "mde_2")).select(
        *KEY, "end_ts", F.col("mde_1").alias("__m1"), F.col("mde_2").alias("__m2"))
    found = rows.join(solved, [*KEY, "end_ts"], "left").withColumns({f"mde_{k}": F.coalesce(f"mde_{k}", f"__m{k}") for k in (1, 2)})
    return found.withColumn("mde", combined_mde()).drop("__m1", "__m2")


def check(experiment: Experiment, metrics: list[Metric], facts: DataFrame, cohort: DataFrame) -> list[str]:
    """What is wrong with a configuration, from names and the analysed plan; nothing is executed."""
    found = [f"the cohort lacks {c}" for c in ("unit_id", "variant", "exposure_ts") if c not in cohort.columns]
    found += [f"the facts lack {c}" for c in (experiment.unit, experiment.ts) if c not in facts.columns]
    found += [f"no metric {c.metric}" for c in experiment.comparisons if c.metric not in {m.name for m in metrics}]
    if any(UNIT_METHODS.get(method(c.method)[0], (False,))[0] for c in experiment.comparisons) and "pair_id" not in cohort.columns:
        found.append("the cohort lacks pair_id, which paired methods join on")
    if not looks_before_horizon(experiment.grid()):
        found.append("no look comes before the horizon")
    if not found or found == ["no look comes before the horizon"]:
        try:
            results(experiment, metrics, facts, cohort).schema  # noqa: B018
        except Exception as e:  # noqa: BLE001
            found.append(str(e).splitlines()[0])
    return found


def _with_mde(experiment: Experiment, rows: DataFrame) -> DataFrame:
    if not experiment.mde_power:
        return rows.withColumns({f"mde_{k}": F.lit(None).cast("double") for k in (1, 2)})
    target = experiment.mde_power
    relative = F.get_json_object("method_params", "$.test_type") == "relative"
    rows = rows.withColumns({"__rel": relative.cast("int"), "__frac": (F.col("kind") == "fraction").cast("int")})

    def solve(value, std, n, alpha, rel, frac):
        kind = "relative" if rel else "absolute"
        return power.fraction_mde(value, n, kind, alpha, target) if frac else power.t_mde(value, std, n, kind, alpha, target)

    for k in (1, 2):
        rows = power.with_solve(rows, f"mde_{k}", solve, f"value_{k}", f"std_{k}", f"size_{k}", "alpha", "__rel", "__frac")
        rows = rows.withColumn(f"mde_{k}", F.when(F.col("kind") != "ratio", F.col(f"mde_{k}")))
    return rows.drop("__rel", "__frac")


def from_config(text: str, metrics_text: dict[str, str] | None = None) -> tuple[Experiment, list[Metric]]:
    """An experiment and its metrics from YAML (or JSON) documents; expressions are Spark SQL."""
    try:
        from yaml import safe_load
    except ImportError:  # JSON is YAML
        safe_load = json.loads
    raw = identity.from_environment(safe_load(text))
    raw = raw.get("experiment", raw)
    found = [identity.from_environment(safe_load(t)) for t in (metrics_text or {}).values()] + raw.pop("metrics", [])
    metrics = [Metric(m["name"], m["kind"], {r: (x["aggregate"], x["expression"]) for r, x in m["roles"].items()}) for m in (f.get("metric", f) for f in found)]
    comparisons = tuple(Comparison(**c) for c in raw.pop("comparisons"))
    known = {m.name for m in metrics}
    if missing := {c.metric for c in comparisons} - known:
        raise ValueError(f"no metric {sorted(missing)}")
    raw["variants"] = tuple(raw["variants"])
    raw |= {k: _edge(raw[k]) for k in ("start", "horizon") if k in raw}
    if isinstance(raw.get("cadence"), list):
        raw["cadence"] = tuple(s if isinstance(s, (str, int)) else (s["every"], s.get("until")) for s in raw["cadence"])
    return Experiment(comparisons=comparisons, **raw), metrics


def _edge(value) -> date | datetime:
    """A date, or a date and time without an offset, to the second."""
    if isinstance(value, str):
        value = date.fromisoformat(value) if len(value) == 10 else datetime.fromisoformat(value)
    if not isinstance(value, date) or isinstance(value, datetime) and (value.tzinfo or value.microsecond):
        raise ValueError(f"a window's edge is a local date or time: {value!r}")
    return value


def select(names: dict[str, list[str]], patterns: list[str], exclude: list[str] = ()) -> list[str]:
    """Experiments by name, glob or ``tag:...``; ``names`` maps a name to its tags."""
    from fnmatch import fnmatch

    def hits(name: str, tags: list[str], pattern: str) -> bool:
        return pattern[4:] in tags if pattern.startswith("tag:") else fnmatch(name, pattern)

    return [n for n, tags in names.items() if any(hits(n, tags, p) for p in patterns) and not any(hits(n, tags, p) for p in exclude)]
