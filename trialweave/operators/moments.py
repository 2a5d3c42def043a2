"""Mergeable sufficient statistics of arms."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions.columns import div, finite, floor0

#: The share of a sum of squares below which its centred part is rounding.
ROUNDING = 1e-13


def moments(*roles: str) -> list[Column]:
    """Aggregates ``n``, ``mean_<role>``, ``m2_<role>`` and ``c_<a>_<b>`` (centred sums).

    The built-in buffers are centred and merge pairwise, so partial aggregation is exact and
    stable.  A null role value voids its statistics: it is not skipped.
    """
    n = F.count(F.lit(1))
    out = [n.alias("n")]
    whole = {r: F.count(r) == n for r in roles}
    for r in roles:
        out += [F.when(whole[r], F.avg(r)).alias(f"mean_{r}"), F.when(whole[r], F.var_pop(r) * n).alias(f"m2_{r}")]
    for a, b in combinations_with_replacement(roles, 2):
        if a != b:
            out.append(F.when(whole[a] & whole[b], F.covar_pop(a, b) * n).alias(f"c_{a}_{b}"))
    return out


def arm_moments(units: DataFrame, by: list[str], *roles: str) -> DataFrame:
    return units.groupBy(*by).agg(*moments(*roles))


def moments_by_look(running: DataFrame, n_looks: int, *roles: str, fixed: tuple[str, ...] = (), groups: list[tuple[str, ...]] | None = None) -> DataFrame:
    """Arm moments at every look from rows where a unit's value changed.

    At a look a unit adds the change of its values, squares and products; the changes are
    summed per (variant, look), a table of looks x variants rows, and then along the looks.
    Units x looks rows never exist.  ``fixed`` roles (a covariate) do not change after a
    unit's first row.  Products are kept within each of ``groups`` (default: one group of
    all roles).  Every role is centred on its grand mean, one row that is broadcast, before
    anything is squared, so a mean that is large against the spread costs no digits.  The
    mean's branch of the plan reuses the shuffle of the other: facts are read once.
    """
    every = [*roles, *fixed]
    running = running.crossJoin(F.broadcast(running.agg(*[F.coalesce(finite(F.avg(F.col(r).cast("double"))), F.lit(0.0)).alias(f"shift_{r}") for r in every])))
    pairs = sorted({p for g in groups or [tuple(every)] for p in combinations_with_replacement(g, 2)}, key=lambda p: (every.index(p[0]), every.index(p[1])))
    along = Window.partitionBy("variant", "unit_id").orderBy("look")
    moved = {r: F.coalesce(F.col(r).cast("double") - F.col(f"shift_{r}"), F.lit(0.0)) for r in every}
    bad = {r: F.col(r).isNull().cast("int") for r in every}
    known = running.select(
        "variant", "look", "is_new", *[f"shift_{r}" for r in every], *[bad[r].alias(f"bad_{r}") for r in every], *[moved[r].alias(r) for r in every],
        *[F.lag(moved[r]).over(along).alias(f"was_{r}") for r in every], *[F.lag(bad[r]).over(along).alias(f"wasbad_{r}") for r in every])

    def change(now: Column, was: Column) -> Column:
        return F.sum(now - F.when(F.col("is_new"), 0).otherwise(was))

    sums = known.groupBy("variant", "look").agg(
        F.count_if("is_new").alias("n"), *[F.min(f"shift_{r}").alias(f"shift_{r}") for r in every],
        *[change(F.col(f"bad_{r}"), F.col(f"wasbad_{r}")).alias(f"b_{r}") for r in every],
        *[change(F.col(r), F.col(f"was_{r}")).alias(f"s_{r}") for r in every],
        *[change(F.col(a) * F.col(b), F.col(f"was_{a}") * F.col(f"was_{b}")).alias(f"p_{a}_{b}") for a, b in pairs])
    # Looks without a change repeat the last totals: each row is stretched to the next one.
    up = Window.partitionBy("variant").orderBy("look")
    shifts = [f"shift_{r}" for r in every]
    total = sums.select("variant", *shifts, F.col("look").alias("__from"), F.lead("look").over(up).alias("__next"), *[F.sum(c).over(up).alias(c) for c in sums.columns if c not in ("variant", "look", *shifts)])
    total = total.withColumn("look", F.explode(F.sequence("__from", F.coalesce("__next", F.lit(n_looks)) - 1)))
    n = F.col("n")
    good = {r: F.col(f"b_{r}") == 0 for r in every}
    out = [F.when(good[r], F.col(f"s_{r}") / n + F.col(f"shift_{r}")).alias(f"mean_{r}") for r in every]

    def centred(a: str, b: str) -> Column:
        return F.col(f"p_{a}_{b}") - F.col(f"s_{a}") * F.col(f"s_{b}") / n

    # What rounding leaves of equal values is no spread.
    spread = {a: centred(a, a) > F.col(f"p_{a}_{a}") * ROUNDING for a, b in pairs if a == b}
    for a, b in pairs:
        name = f"m2_{a}" if a == b else f"c_{a}_{b}"
        out.append(F.when(good[a] & good[b], F.when(spread[a] & spread[b], centred(a, b)).otherwise(0.0)).alias(name))
    return total.select("variant", "look", "n", *out)


def merge(parts: DataFrame, by: list[str], *roles: str) -> DataFrame:
    """Merge persisted partial moments: spreads about the merged means (Chan et al.), which are found first."""
    whole = Window.partitionBy(*by)
    total = F.sum("n").over(whole).cast("double")
    parts = parts.select("*", *[div(F.sum(F.col("n") * F.col(f"mean_{r}")).over(whole), total).alias(f"__g_{r}") for r in roles])
    off = {r: F.col(f"mean_{r}") - F.col(f"__g_{r}") for r in roles}
    out = [F.sum("n").alias("n")]
    for r in roles:
        out += [F.min(f"__g_{r}").alias(f"mean_{r}"), F.sum(F.col(f"m2_{r}") + F.col("n") * off[r] * off[r]).alias(f"m2_{r}")]
    for a, b in combinations_with_replacement(roles, 2):
        if a != b:
            out.append(F.sum(F.col(f"c_{a}_{b}") + F.col("n") * off[a] * off[b]).alias(f"c_{a}_{b}"))
    return parts.groupBy(*by).agg(*out)


def pair_up(arms: DataFrame, pairs: list[tuple[str, str]], by: list[str]) -> DataFrame:
    """One row per (``by``, declared pair): columns ``*_1`` of the first arm and ``*_2`` of the second.

    The arms of a ``by`` group, as many as the experiment has, are gathered once and picked
    from, so what stands below is computed once and not joined with itself.
    """
    values = [c for c in arms.columns if c not in (*by, "variant")]
    gathered = arms.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("variant", F.struct(*values).alias("v")))).alias("__arms"))
    declared = F.array(*[F.struct(F.lit(i).alias("pair"), F.lit(a).alias("name_1"), F.lit(b).alias("name_2")) for i, (a, b) in enumerate(pairs)])
    out = gathered.select(*by, "__arms", F.explode(declared).alias("__p")).select(
        *by, "__p.*", F.try_element_at("__arms", F.col("__p.name_1")).alias("__1"), F.try_element_at("__arms", F.col("__p.name_2")).alias("__2"))
    out = out.filter(F.col("__1").isNotNull() & F.col("__2").isNotNull())
    return out.select(*by, "pair", "name_1", "name_2", *[F.col(f"__{k}.{c}").alias(f"{c}_{k}") for k in (1, 2) for c in values])


def contrasts(variants: list[str], control: str | None = None, kind: str = "all_pairs") -> list[tuple[str, str]]:
    """Declared pairs, the control always first."""
    control = control or variants[0]
    order = [control, *(v for v in variants if v != control)]
    if kind == "vs_control":
        return [(control, v) for v in order[1:]]
    return [(a, b) for i, a in enumerate(order) for b in order[i + 1:]]


def weights(labels: list[str], **coefficients: float) -> dict[str, float]:
    """A weight for each label, 0 where none is given."""
    if unknown := set(coefficients) - set(labels):
        raise ValueError(f"no labels {sorted(unknown)}")
    return {x: float(coefficients.get(x, 0.0)) for x in labels}


def comoment(left: dict[str, float], right: dict[str, float]) -> Column:
    """The co-moment of two linear combinations of roles, from ``m2_*`` and ``c_*_*`` columns."""
    order, out = list(left), F.lit(0.0)
    for i, a in enumerate(order):
        for j, b in enumerate(order):
            w = left[a] * right.get(b, 0.0)
            if w:
                x, y = order[min(i, j)], order[max(i, j)]
                out = out + F.lit(w) * F.col(f"m2_{a}" if a == b else f"c_{x}_{y}")
    return out


def correlation(c: Column, m2_a: Column, m2_b: Column) -> Column:
    """Null if either variance is 0."""
    return div(c, F.sqrt(floor0(m2_a * m2_b)))
