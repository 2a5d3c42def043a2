"""A/A calibration by placebo splits, spread over iterations."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialweave.functions.normal import critical, two_sided
from trialweave.functions.scratch import saved
from trialweave.functions.ship import ship
from trialweave.operators import closed_form
from trialweave.operators.corrections import best_ratio, family_significance
from trialweave.operators.moments import arm_moments, pair_up
from trialweave.operators.state import last_write_wins

#: Units x looks of a block, and units x masks handled together; units of a block at least, and masks of a task.
BLOCK_CELLS, LEAST_UNITS, TOGETHER = 1_500_000, 4096, 4096
#: Units x looks of a panel at most: a permutation of its units is drawn in one task.
PANEL_CELLS = 400_000_000


#: The metric name of rows that hold a family's rates.
FAMILY = "__family__"


def iterations_for(alpha: float, per_alpha: int = 200) -> int:
    return max(2000, math.ceil(per_alpha / alpha))


def placebo_split(units: DataFrame, iterations: int, share: float = 0.5, seed: int = 0, unit: str = "unit_id") -> DataFrame:
    """``iteration``, ``unit``, ``is_a``: exact-size random splits, the same for any partitioning.

    The units with the smallest hashes of (unit, iteration, seed) are in ``a``.  Every row is
    repeated ``iterations`` times, but no iteration is sorted: counts by the hash's first
    digits tell in which of 4,096 parts the cut lies, and only that part's units are ranked.
    """
    rows = units.select("*", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iteration"))
    lot = F.md5(F.concat_ws("|", F.col(unit), F.col("iteration"), F.lit(str(seed))))
    rows = rows.withColumn("__lot", lot).withColumn("__part", F.substring("__lot", 1, 3))
    counts = rows.groupBy("iteration", "__part").agg(F.count(F.lit(1)).alias("__m"))
    up = Window.partitionBy("iteration").orderBy("__part")
    n = F.sum("__m").over(Window.partitionBy("iteration"))
    until = F.sum("__m").over(up)
    cuts = counts.select(F.col("iteration").alias("__i"), F.col("__part").alias("__p"), (F.round(n * share) - (until - F.col("__m"))).alias("__room"), "__m")
    joined = rows.join(cuts, (F.col("iteration") == F.col("__i")) & (F.col("__part") == F.col("__p")))
    mixed = (F.col("__room") > 0) & (F.col("__room") < F.col("__m"))
    rank = F.row_number().over(Window.partitionBy("iteration", "__part").orderBy("__lot", unit))
    kept = [*units.columns, "iteration"]
    return joined.filter(~mixed).select(*kept, (F.col("__room") > 0).alias("is_a")).union(
        joined.filter(mixed).withColumn("is_a", rank <= F.col("__room")).select(*kept, "is_a"))


def split_effects(panel: DataFrame, masks: DataFrame, kind: str = "t", relative: bool = False) -> DataFrame:
    """(iteration, look, effect, se) of a panel under given splits (:func:`placebo_split`), by joins and moments only."""
    roles = ("value", "covariate") if kind == "cuped" else ("value",)
    arms = panel.join(masks.withColumn("variant", F.when(F.col("is_a"), "a").otherwise("b")).select("unit_id", "iteration", "variant"), "unit_id")
    paired = pair_up(arm_moments(arms, ["iteration", "look", "variant"], *roles), [("a", "b")], ["iteration", "look"])
    test = closed_form.cuped if kind == "cuped" else closed_form.t_test
    found = test(paired, "relative" if relative else "absolute")
    return found.select("iteration", "look", "effect", (F.col("ci_length") / (2 * critical(0.05))).alias("se"))


def placebo_sums(panel: DataFrame, iterations: int, share: float = 0.5, seed: int = 0, relative: bool = False) -> DataFrame:
    """(iteration, look, effect, se) of t-tests on hashed placebo splits of a panel of any size.

    A unit is in ``a`` if a hash of (unit, iteration, seed) says so, so arms have binomial
    sizes, no unit leaves its task, and a task hands on one row of sums per iteration and
    look.  Values are centred on their look's mean before they are squared.
    """
    from pyspark.sql import types as T

    ship(panel.sparkSession)
    looks = panel.groupBy(F.col("look").alias("l")).agg(F.avg("value").alias("shift"))
    at = sorted(r["l"] for r in looks.select("l").collect())
    centred = panel.join(F.broadcast(looks), F.col("look") == F.col("l")).select("unit_id", "look", (F.col("value") - F.col("shift")).alias("v"))
    wide = centred.groupBy("unit_id").agg(F.map_from_entries(F.collect_list(F.struct("look", "v"))).alias("m"))
    wide = wide.select(F.xxhash64("unit_id", F.lit(seed)).alias("h"), F.array(*[F.try_element_at("m", F.lit(k)) for k in at]).alias("v"))
    limit, names = np.uint64(min(share, 1.0) * (2**64 - 1)), ("n1", "s1", "q1", "n2", "s2", "q2")

    def run(batches):
        import pyarrow as pa

        sums = np.zeros((6, iterations, len(at)))
        with np.errstate(over="ignore"):
            salt = _mixed((np.arange(iterations, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(h), len(at))
            present = ~np.isnan(x)
            x = np.where(present, x, 0.0)
            for k in range(0, len(h), 512):
                part = slice(k, k + 512)
                mask = (_mixed(h[part] ^ salt[:, None]) <= limit).astype(float)
                for i, y in enumerate((present[part].astype(float), x[part], x[part] ** 2)):
                    one = mask @ y
                    sums[i] += one
                    sums[i + 3] += y.sum(axis=0) - one
        yield pa.RecordBatch.from_pydict({
            "iteration": np.repeat(np.arange(iterations), len(at)), "look": np.tile(np.array(at, np.int32), iterations), **{c: s.ravel() for c, s in zip(names, sums)}})

    schema = T.StructType([T.StructField("iteration", T.LongType()), T.StructField("look", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in names)])
    total = wide.mapInArrow(run, schema).groupBy("iteration", "look").agg(*[F.sum(c).alias(c) for c in names]).filter("n1 >= 2 and n2 >= 2").join(F.broadcast(looks), F.col("look") == F.col("l"))
    for k in (1, 2):
        n, off = F.col(f"n{k}"), F.col(f"s{k}") / F.col(f"n{k}")
        total = total.withColumns({f"n_{k}": n, f"mean_value_{k}": F.col("shift") + off, f"m2_value_{k}": F.greatest(F.col(f"q{k}") - n * off * off, F.lit(0.0))})
    found = closed_form.t_test(total, "relative" if relative else "absolute")
    return found.select("iteration", "look", "effect", (F.col("ci_length") / (2 * critical(0.05))).alias("se"))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _products(kind: str, value: np.ndarray, other: np.ndarray | None) -> np.ndarray:
    """Columns whose sums over an arm are its moments, look by look; NaN is an absent unit, the rest is centred."""
    present = ~np.isnan(value)
    c = np.where(present, value, 0.0)
    out = [present.astype(float), c, c * c]
    if other is not None:
        x = np.where(present, np.nan_to_num(other), 0.0)
        out += [x, x * x, x * c]
    return np.hstack(out)


def _estimates(kind: str, a: list[np.ndarray], b: list[np.ndarray], shift: np.ndarray, shift_d: np.ndarray, delta: float, relative: bool) -> tuple[np.ndarray, np.ndarray]:
    """Effects and variances from both arms' sums of centred values; the treatment is scaled by ``1 + delta``."""
    (n1, s1, q1), (n2, s2, q2) = a[:3], b[:3]
    with np.errstate(divide="ignore", invalid="ignore"):
        m1, m2 = s1 / n1 + shift, s2 / n2 + shift
        v1, v2 = np.maximum(q1 / n1 - (s1 / n1) ** 2, 0), np.maximum(q2 / n2 - (s2 / n2) ** 2, 0)
        scale = 1 + delta
        if kind == "cuped":
            (xs1, xq1, xy1), (xs2, xq2, xy2) = a[3:], b[3:]
            c1, c2 = xy1 - xs1 * s1 / n1, (xy2 - xs2 * s2 / n2) * scale
            d1, d2 = xq1 - xs1**2 / n1, xq2 - xs2**2 / n2
            m2, v2 = m2 * scale, v2 * scale**2
            theta = (c1 / (n1 - 1) + c2 / (n2 - 1)) / (d1 / n1 + d2 / n2)
            a1, a2 = m1 - theta * (xs1 / n1), m2 - theta * (xs2 / n2)
            w1 = np.maximum(v1 * n1 - 2 * theta * c1 + theta**2 * d1, 0) / n1**2
            w2 = np.maximum(v2 * n2 - 2 * theta * c2 + theta**2 * d2, 0) / n2**2
            effect, var, base, base_var, cov = a2 - a1, w1 + w2, m1, v1 / n1, -(v1 * n1 - theta * c1) / (n1 - 1) / n1
        elif kind == "ratio":
            r, w = [], []
            for (n, s, q, sd, qd, cd), k in ((a, 1.0), (b, scale)):
                md = sd / n + shift_d
                mn = (s / n + shift) * k
                spread = np.maximum((q - s * s / n) * k * k - 2 * mn / md * (cd - s * sd / n) * k + (mn / md) ** 2 * (qd - sd * sd / n), 0)
                r.append(mn / md)
                w.append(spread / (n * md * md) / n)
            effect, var, base, base_var, cov = r[1] - r[0], w[0] + w[1], r[0], w[0], -w[0]
        elif kind == "z":
            p2 = np.minimum(m2 * scale, 1.0)
            pooled = (m1 * n1 + p2 * n2) / (n1 + n2)
            var = pooled * (1 - pooled) * (1 / n1 + 1 / n2)
            effect = p2 - m1
            if relative:
                return effect / m1, np.where(var > 0, var / m1**2, np.nan)
            return effect, np.where(var > 0, var, np.nan)
        else:
            m2, v2 = m2 * scale, v2 * scale**2
            effect, var, base, base_var, cov = m2 - m1, v1 / n1 + v2 / n2, m1, v1 / n1, -v1 / n1
        if relative:
            var = var / base**2 + base_var * effect**2 / base**4 - 2 * effect / base**3 * cov
            effect = effect / base
        good = (n1 >= 2) & (n2 >= 2) & (var > 0) & np.isfinite(var)
        return effect, np.where(good, var, np.nan)


def _numbered(units: DataFrame) -> tuple[DataFrame, int]:
    """``unit_id`` and its place ``__at`` among the sorted distinct ids, and their number; no task sorts all."""
    dealt = saved(units.select("unit_id").filter("unit_id is not null").distinct().repartitionByRange(32, "unit_id").withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__m"))
    starts = sizes.select(F.col("__part").alias("__p"), (F.sum("__m").over(Window.orderBy("__part")) - F.col("__m")).alias("__start"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy("unit_id"))
    ranked = dealt.withColumn("__rank", rank).join(F.broadcast(starts), F.col("__part") == F.col("__p"))
    return ranked.select("unit_id", (F.col("__start") + F.col("__rank") - 1).alias("__at")), dealt.count()


_ROWS = "iteration long, look int, effect double, se double"


def placebo_effects(panel: DataFrame, iterations: int, kind: str = "t", share: float = 0.5, seed: int = 0, delta: float = 0.0, relative: bool = False, looks: list[int] | None = None, universe: DataFrame | None = None) -> DataFrame:
    """(iteration, look, effect, se) of placebo splits of a panel (``unit_id``, ``look``, ``value``, optional ``covariate`` or ``den``).

    The panel never goes to the driver.  Units are numbered in order and dealt in blocks; each
    mask, a permutation of the numbers seeded by its own number, is drawn once and dealt as bits
    of these blocks; a task adds a block's values under its part of the masks, and the sums of
    all blocks give effects.  So no result depends on partitioning.  Only the looks and their
    means go to the driver.  A panel of more than ``PANEL_CELLS`` units x looks, whose
    permutations would outgrow a task, is refused (:func:`placebo_sums` draws none).  With
    ``universe`` (``unit_id``) splits are drawn over those units, of which the panel may hold
    some: the members of a family share their splits so.  The effects are a scratch table, so
    what reads them repeats no split.
    """
    spark: SparkSession = panel.sparkSession
    ship(spark)
    more = {"cuped": "covariate", "ratio": "den"}.get(kind)
    panel = panel if looks is None else panel.filter(F.col("look").isin(looks))
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c)
    panel = saved(panel.select("unit_id", F.col("look").cast("int").alias("look"), number("value"), *([number(more)] if more else [])))
    means = {r["look"]: r for r in panel.groupBy("look").agg(F.avg("value").alias("value"), *([F.avg(more).alias(more)] if more else [])).collect()}
    at = np.array(sorted(looks if looks is not None else means), np.int32)
    if not len(at):
        return spark.createDataFrame([], _ROWS)
    numbered, n = _numbered(panel if universe is None else universe)
    if (cells := n * len(at)) > PANEL_CELLS:
        raise ValueError(f"a panel of {cells} cells is too large to permute; use placebo_sums")
    mean = lambda c: np.array([(means[k][c] if k in means else None) or 0.0 for k in at.tolist()])
    shift, shift_m = mean("value"), mean(more) if more else np.zeros(len(at))
    shift_m = shift_m if kind == "ratio" else np.full(len(at), shift_m.mean())
    block = max(1, min(max(LEAST_UNITS, -(-n // 16)), BLOCK_CELLS // len(at)))
    n_a, runs = round(n * share), -(-iterations // TOGETHER)

    def draw(batches):
        import pyarrow as pa

        for batch in batches:
            for i in batch.column(0).to_pylist():
                mask = np.zeros(n, bool)
                mask[np.random.default_rng([seed, i]).permutation(n)[:n_a]] = True
                parts = [np.packbits(mask[k:k + block]).tobytes() for k in range(0, max(n, 1), block)]
                yield pa.RecordBatch.from_pydict({
                    "block": np.arange(len(parts)), "run": np.full(len(parts), i // TOGETHER, np.int32), "iteration": np.full(len(parts), i), "bits": pa.array(parts, pa.binary())})

    width = 6 if more else 3
    names = [f"{arm}{k}" for arm in "ab" for k in range(width)]

    def add(masks, rows):
        import pyarrow as pa

        ids, first = masks["iteration"].to_numpy(), masks["block"][0].as_py() * block
        size = max(0, min(block, n - first))
        where = (rows["__at"].to_numpy() - first) * len(at) + np.searchsorted(at, rows["look"].to_numpy())
        if len(np.unique(where)) < len(where):
            raise ValueError("a unit has several rows at one look")
        value, other = np.full(size * len(at), np.nan), None
        value[where] = rows["value"].to_numpy(zero_copy_only=False) if len(where) else []
        value = value.reshape(size, len(at)) - shift
        if more:
            other = np.full(size * len(at), np.nan)
            other[where] = rows[more].to_numpy(zero_copy_only=False) if len(where) else []
            other = np.nan_to_num(other.reshape(size, len(at))) - shift_m
        x = _products(kind, value, other)
        bits = np.frombuffer(b"".join(masks["bits"].to_pylist()), np.uint8).reshape(len(ids), -1)
        sums = np.empty((2, len(ids), x.shape[1]))
        step = max(1, BLOCK_CELLS // max(size, 1))
        for k in range(0, len(ids), step):
            sums[0, k:k + step] = np.unpackbits(bits[k:k + step], axis=1)[:, :size].astype(float) @ x
        sums[1] = x.sum(axis=0) - sums[0]
        columns = sums.reshape(2, len(ids), width, len(at)).transpose(0, 2, 1, 3).reshape(2 * width, -1)
        return pa.table({"iteration": np.repeat(ids, len(at)), "look": np.tile(at, len(ids)), **dict(zip(names, columns))})

    def finish(batches):
        import pyarrow as pa

        for batch in batches:
            ids, look, *sums = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            k = np.searchsorted(at, look)
            effect, var = _estimates(kind, sums[:width], sums[width:], shift[k], shift_m[k], delta, relative)
            yield pa.RecordBatch.from_pydict({"iteration": ids, "look": look, "effect": effect, "se": np.sqrt(var)})

    parts = max(1, min(spark.sparkContext.defaultParallelism, iterations))
    masks = spark.range(0, iterations, 1, parts).mapInArrow(draw, "block long, run int, iteration long, bits binary")
    place = F.floor(F.col("__at") / block).cast("long")
    rows = panel.join(numbered, "unit_id").select(place.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), "__at", "look", "value", *([more] if more else []))
    added = masks.groupBy("block", "run").cogroup(rows.groupBy("block", "run")).applyInArrow(add, "iteration long, look int, " + ", ".join(f"{c} double" for c in names))
    out = added.groupBy("iteration", "look").agg(*[F.sum(c).alias(c) for c in names]).mapInArrow(finish, _ROWS)
    clean = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return saved(out.select("iteration", "look", clean("effect"), clean("se")))


def tau2_of(effects: DataFrame, alpha: float) -> float | None:
    """The cell's frozen tau2: the first usable look of the first iteration."""
    row = effects.filter("iteration = 0 and se > 0").orderBy("look").first()
    return None if row is None else row["se"] ** 2 * best_ratio(alpha)


def _radius(se: Column, tau2: float, alpha: float) -> Column:
    v = se * se
    return F.sqrt(2.0 * v * (v + tau2) / tau2 * (F.lit(math.log(1 / alpha)) + 0.5 * F.log((v + tau2) / v)))


def score(null: DataFrame, alpha: float = 0.05, injected: DataFrame | None = None, truth: float = 0.0, tau2: float | None = None) -> DataFrame:
    """One row: false-positive rates at the horizon and under peeking, coverage, power, exaggeration, and sequential twins."""
    z = critical(alpha)

    def summary(df: DataFrame, true: float, sequential: bool, *wanted: str) -> DataFrame:
        half = _radius(F.col("se"), tau2, alpha) if sequential else F.col("se") * z
        rows = df.withColumn("half", half).withColumn("hit", F.abs("effect") > F.col("half")).withColumn("cover", F.abs(F.col("effect") - true) <= F.col("half"))
        each = rows.groupBy("iteration").agg(F.max_by(F.struct("hit", "cover", "half", "effect"), "look").alias("l"), F.bool_or("hit").alias("any"))
        hit = F.col("l.hit").cast("int")
        stats = {
            "fpr": F.avg(hit), "peeking_fpr": F.avg(F.col("any").cast("int")), "coverage": F.avg(F.col("l.cover").cast("int")), "power": F.avg(hit),
            "ci_width": F.avg(F.col("l.half") * 2), "effect_exaggeration": F.avg(F.when(hit == 1, F.abs("l.effect"))) / F.lit(abs(true) or None)}
        return each.agg(*[stats[k].alias(k + "_sequential" * sequential) for k in wanted])

    out = None
    for sequential in (False, True) if tau2 is not None else (False,):
        parts = [summary(null, 0.0, sequential, "fpr", "peeking_fpr", "coverage", "ci_width")]
        if injected is not None:
            parts.append(summary(injected, truth, sequential, "power", "effect_exaggeration"))
        for part in parts:
            out = part if out is None else out.crossJoin(part)
    return out


def peeking_curve(effects: DataFrame, alpha: float = 0.05, crossed: Column | None = None) -> DataFrame:
    """Per look, the share of iterations that have crossed by then."""
    hit = crossed if crossed is not None else F.abs("effect") > F.col("se") * critical(alpha)
    n = F.col("n")
    total = effects.agg(F.countDistinct("iteration").alias("n"))
    first = effects.filter(hit).groupBy("iteration").agg(F.min("look").alias("look")).groupBy("look").agg(F.count(F.lit(1)).alias("k"))
    looks = effects.select("look").distinct().join(first, "look", "left").crossJoin(total)
    up = Window.orderBy("look").rowsBetween(Window.unboundedPreceding, 0)
    return looks.select("look", (F.sum(F.coalesce("k", F.lit(0))).over(up) / n).alias("crossed"))


def peeked(effects: DataFrame, alpha: float = 0.05, by: tuple[str, ...] = ("iteration",)) -> DataFrame:
    """What one who peeks reports: effect and p-value of the first look that crosses, else of the latest, and the least p-value."""
    rows = effects.withColumn("pvalue", two_sided(F.col("effect") / F.col("se"))).withColumn("__hit", F.coalesce(F.abs("effect") > F.col("se") * critical(alpha), F.lit(False)))
    own = F.struct("effect", "pvalue", "look")
    out = rows.groupBy(*by).agg(F.min_by(own, F.when(F.col("__hit"), F.col("look"))).alias("first"), F.max_by(own, "look").alias("last"), F.bool_or("__hit").alias("crossed"), F.min("pvalue").alias("least_pvalue"))
    pick = F.when(F.col("crossed"), F.col("first")).otherwise(F.col("last"))
    return out.select(*by, "crossed", pick["look"].alias("look"), pick["effect"].alias("effect"), pick["pvalue"].alias("pvalue"), "least_pvalue")


def family_sweep(members: dict[str, tuple[DataFrame, str]], iterations: int, scheme: str, alpha: float = 0.05, seed: int = 0, share: float = 0.5) -> DataFrame:
    """Composed error rates of a family at the horizon and under peeking: ``view``, ``fwer``, ``fdr``, ``iterations``.

    ``members`` are (panel, kind) by name.  All share their splits, drawn over the union of
    their units.
    """
    universe = None
    for p, _ in members.values():
        ids = p.select("unit_id")
        universe = ids if universe is None else universe.union(ids)
    universe = universe.distinct()
    horizon = looks = None
    for name, (p, kind) in sorted(members.items()):
        rows = placebo_effects(p, iterations, kind, share, seed, universe=universe).withColumn("member", F.lit(name))
        looks = rows if looks is None else looks.unionByName(rows)
    horizon = looks.groupBy("iteration", "member").agg(F.max_by(F.struct("effect", "se"), "look").alias("r")).select(
        "iteration", "member", "r.effect", two_sided(F.col("r.effect") / F.col("r.se")).alias("pvalue"))
    seen = peeked(looks, alpha, ("iteration", "member")).select("iteration", "member", "effect", "pvalue")
    out = None
    for view, rows in (("horizon", horizon), ("peeking", seen)):
        part = family_rate(rows, scheme, alpha).withColumn("view", F.lit(view))
        out = part if out is None else out.unionByName(part)
    return out


def family_rate(members: DataFrame, scheme: str, alpha: float = 0.05) -> DataFrame:
    """Family-wise error and false discovery rate over (iteration, member, effect, pvalue)."""
    judged = family_significance(members, scheme, alpha, ["iteration"], ["member"])
    each = judged.groupBy("iteration").agg(F.bool_or("significant").alias("any"), F.count_if("significant").alias("k"), F.count(F.lit(1)).alias("m"))
    return each.agg(F.avg(F.col("any").cast("int")).alias("fwer"), F.avg(F.when(F.col("k") > 0, F.lit(1.0)).otherwise(0.0)).alias("fdr"), F.count(F.lit(1)).alias("iterations"))


def recommend(cells: DataFrame, budget: float) -> DataFrame:
    """The cell to use per metric: within budget first, then power, small MDE, small FPR."""
    inside = F.coalesce(F.col("fpr") <= budget, F.lit(False))
    order = Window.partitionBy("metric").orderBy(inside.desc(), F.col("power").desc_nulls_last(), F.col("achieved_mde").asc_nulls_last(), F.col("fpr").asc_nulls_last(), "method_name")
    return cells.withColumn("in_budget", inside).withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


def sign_lean(positive: Column, hits: Column) -> Column:
    """Whether hits lean to one side beyond three sigma, with at least 100 hits."""
    return F.when(hits >= 100, F.abs(positive - hits / 2.0) > 1.5 * F.sqrt(hits.cast("double"))).otherwise(F.lit(False))


def pooled_estimate(panel: DataFrame, kind: str) -> Column:
    """Aggregate: the pooled mean, proportion or ratio of a panel's latest values."""
    return F.sum("value") / F.nullif(F.sum("den"), F.lit(0.0)) if kind == "ratio" else F.avg("value")


def injected_truth(delta: float, relative: bool, pooled: float | None) -> float | None:
    """The effect that scaling by ``1 + delta`` puts in, on the test's own scale."""
    return delta if relative else None if pooled is None else delta * pooled


def injection_clamped(kind: str, pooled: float | None, delta: float) -> bool:
    """Whether an injected lift takes a proportion beyond 1."""
    return kind == "z" and pooled is not None and pooled * (1 + delta) > 1.0


def calibrated_contrast(variants: tuple[str, ...], control: str) -> tuple[str, str]:
    """The control and the first treatment."""
    return control, next(v for v in variants if v != control)


def control_share(shares: dict[str, float], pair: tuple[str, str]) -> float:
    """The control's share inside its pair, kept within 0.01 and 0.99."""
    a, b = (shares[v] for v in pair)
    return min(0.99, max(0.01, a / (a + b)))


def pool(units: DataFrame, arms: tuple[str, ...] | None = None) -> DataFrame:
    """Units of all arms, or of ``arms``, as one."""
    return units if arms is None else units.filter(F.col("variant").isin(*arms))


def cell_hash(metric: str, method_config_id: str, mode: str, alpha: float) -> str:
    """A cell's identity."""
    return hashlib.sha256("|".join((metric, method_config_id, mode, repr(float(alpha)))).encode()).hexdigest()[:16]


def red_cells(cells: DataFrame, budget: float) -> DataFrame:
    """Cells whose false-positive rate is beyond the budget."""
    return cells.filter(F.col("fpr") > budget)


def matrix(runs: DataFrame) -> DataFrame:
    """The newest run of each metric's cell and level: a row of the calibration matrix."""
    cells = runs.filter((F.col("metric") != FAMILY) & (F.col("status") == "ok"))
    rest = [c for c in runs.columns if c not in ("metric", "method_config_id", "alpha")]
    return cells.groupBy("metric", "method_config_id", "alpha").agg(F.max_by(F.struct(*rest), "created_at").alias("r")).select("metric", "method_config_id", "alpha", "r.*")


def family_block(runs: DataFrame) -> DataFrame:
    """The newest rows that hold a family's composed rates."""
    return last_write_wins(runs.filter(F.col("metric") == FAMILY), ["experiment", "method_config_id"], "created_at")


def run_records(cells: DataFrame, experiment: str, run_id: str, alpha: float, iterations: int, budget: float) -> DataFrame:
    """Scored cells (``metric``, ``method_name``, rates) as audit rows with a plain verdict."""
    inside = F.col("fpr") <= budget
    verdict = F.when(F.col("fpr").isNull(), "no data").when(inside, F.format_string("within budget (%.4f <= %.4f)", F.col("fpr"), F.lit(budget))).otherwise(
        F.format_string("over budget (%.4f > %.4f)", F.col("fpr"), F.lit(budget)))
    return cells.withColumns({
        "experiment": F.lit(experiment), "run_id": F.lit(run_id), "alpha": F.lit(alpha), "iterations": F.lit(iterations), "verdict": verdict, "status": F.lit("ok"),
        "mode": F.lit("aa"), "details": F.to_json(F.struct("fpr"))})


def fpr_budget(alpha: float, metric_budget: float | None = None, project_budget: float | None = None, headroom: float = 1.5) -> float:
    return metric_budget or project_budget or headroom * alpha
