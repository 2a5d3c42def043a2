"""SQL that recomputes the registered queries from scratch, window by window."""

from __future__ import annotations

from trialweave.functions.normal import critical, phi_sql

A = 0.05
#: Levels of main and other comparisons under Bonferroni with three arms and two other metrics.
MAIN, OTHER = A / 3, A / 6

BASE = """
e AS (SELECT user_id, ts, event_type, CASE WHEN event_type = 'purchase' THEN value * 1.0123456789 * CASE WHEN user_id % 3 = 2 THEN 1.6 ELSE 1.0 END ELSE 0.0 END AS spend,
             CASE WHEN event_type = 'signup' THEN 1.0 ELSE 0.0 END AS signup,
             CASE user_id % 3 WHEN 0 THEN 'control' WHEN 1 THEN 't1' ELSE 't2' END AS variant FROM events),
cohort AS (SELECT CAST(user_id AS VARCHAR) AS unit_id, variant, min(ts) AS exposure_ts, count(*) AS n_rows FROM e
           WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-08' GROUP BY ALL),
looks AS (SELECT CAST(i AS INTEGER) AS look, TIMESTAMP '2024-01-08' + (i + 1) * INTERVAL 1 DAY AS end_ts, i = 22 AS is_horizon, CAST(i + 1 AS DOUBLE) AS elapsed_days FROM range(23) t(i)),
x AS (SELECT e.*, c.unit_id FROM e JOIN cohort c ON CAST(e.user_id AS VARCHAR) = c.unit_id
      WHERE e.ts >= TIMESTAMP '2024-01-08' AND e.ts < TIMESTAMP '2024-01-31' AND e.ts >= c.exposure_ts),
cov AS (SELECT c.unit_id, sum(spend) AS covariate FROM e JOIN cohort c ON CAST(e.user_id AS VARCHAR) = c.unit_id
        WHERE e.ts >= TIMESTAMP '2024-01-01' AND e.ts < TIMESTAMP '2024-01-08' GROUP BY 1),
units AS (SELECT look, x.variant, x.unit_id, sum(spend) AS value, max(signup) AS conv, count(*)::DOUBLE AS den, coalesce(max(covariate), 0.0) AS covariate
          FROM looks JOIN x ON x.ts < looks.end_ts LEFT JOIN cov ON cov.unit_id = x.unit_id GROUP BY 1, 2, 3),
arms AS (SELECT look, variant, count(*)::DOUBLE AS n, avg(value) AS m, var_pop(value) AS v, sum(conv) AS k, avg(den) AS md, var_pop(den) AS vd, covar_pop(value, den) AS cvd,
                avg(covariate) AS mx, var_pop(covariate) AS vx, covar_pop(value, covariate) AS cvx,
                CASE WHEN count(*) > 1 THEN covar_pop(value, covariate) * count(*) / (count(*) - 1) END AS cs,
                CASE variant WHEN 'control' THEN 0 WHEN 't1' THEN 1 ELSE 2 END AS ord FROM units GROUP BY 1, 2),
p AS (SELECT a.look, a.variant AS name_1, b.variant AS name_2, a.n AS n1, b.n AS n2, a.m AS m1, b.m AS m2, a.v AS v1, b.v AS v2, a.k AS k1, b.k AS k2,
             a.md AS d1, b.md AS d2, a.vd AS vd1, b.vd AS vd2, a.cvd AS c1, b.cvd AS c2, a.mx AS x1, b.mx AS x2, a.vx AS vx1, b.vx AS vx2,
             a.cvx AS cx1, b.cvx AS cx2, a.cs AS cs1, b.cs AS cs2
      FROM arms a JOIN arms b ON a.look = b.look AND a.ord < b.ord)
"""


def r(column: str, digits: int = 6) -> str:
    return f"round({column}, {digits}) + 0.0 AS {column.split('.')[-1]}"


def _normal(source: str, alpha: float = A, keys: str = "look, name_1, name_2") -> str:
    """Result columns from ``effect`` and ``var``."""
    z = f"{critical(alpha):.17e}"
    good = "var > 0 AND isfinite(var)"
    return f"""
n1_ AS ({source}),
n2_ AS (SELECT {keys}, effect, CASE WHEN {good} THEN sqrt(var) END AS se FROM n1_),
n3_ AS (SELECT *, -abs(effect / se) AS zz FROM n2_),
n4_ AS (SELECT {keys}, effect, effect - {z} * se AS left_bound, effect + {z} * se AS right_bound, 2 * {z} * se AS ci_length, 2 * ({phi_sql('zz')}) AS pvalue FROM n3_),
t AS (SELECT *, coalesce(pvalue < {alpha!r}, FALSE) AS reject FROM n4_)
"""


_OUT = f"SELECT look, name_1, name_2, {r('effect')}, {r('left_bound')}, {r('right_bound')}, {r('ci_length')}, {r('pvalue')}, reject FROM t"


def test(source: str, alpha: float = A) -> str:
    return f"WITH {BASE}, {_normal(source, alpha)} {_OUT}"


KEYS = "look, name_1, name_2"
_S = "(v1 / n1)", "(v2 / n2)"


def relative(num: str, var_num: str, den: str, var_den: str, cov: str, source: str, keys: str = KEYS) -> str:
    d = f"nullif({den}, 0)"
    return f"SELECT {keys}, {num} / {d} AS effect, ({var_num}) / ({d} * {d}) + ({var_den}) * ({num}) * ({num}) / ({d} * {d} * {d} * {d}) - 2 * ({num}) * ({cov}) / ({d} * {d} * {d}) AS var FROM {source}"


T_ABS = f"SELECT {KEYS}, m2 - m1 AS effect, {_S[0]} + {_S[1]} AS var FROM p"
T_REL = relative("(m2 - m1)", f"{_S[0]} + {_S[1]}", "m1", _S[0], f"-{_S[0]}", "p")
_THETA = f"(SELECT *, (cs1 + cs2) / nullif(vx1 + vx2, 0) AS th FROM p)"
_CUPED = f"(SELECT *, m2 - th * x2 - (m1 - th * x1) AS a, (v1 - 2 * th * cx1 + th * th * vx1) / n1 + (v2 - 2 * th * cx2 + th * th * vx2) / n2 AS va, -(v1 - th * cx1) / nullif(n1 - 1, 0) AS cc FROM {_THETA})"
CUPED_ABS = f"SELECT {KEYS}, a AS effect, va AS var FROM {_CUPED}"
CUPED_REL = relative("a", "va", "m1", "v1 / n1", "cc", _CUPED)
_RATIO = "(SELECT *, m1 / d1 AS r1, m2 / d2 AS r2, greatest(v1 - 2 * (m1 / d1) * c1 + (m1 / d1) * (m1 / d1) * vd1, 0) / (n1 * d1 * d1) AS w1, greatest(v2 - 2 * (m2 / d2) * c2 + (m2 / d2) * (m2 / d2) * vd2, 0) / (n2 * d2 * d2) AS w2 FROM p)"
RATIO_ABS = f"SELECT {KEYS}, r2 - r1 AS effect, w1 + w2 AS var FROM {_RATIO}"
RATIO_REL = relative("(r2 - r1)", "w1 + w2", "r1", "w1", "-w1", _RATIO)


def z_test(kind: str, alpha: float = A) -> str:
    scale = "1e0" if kind == "absolute" else "nullif(p1, 0)"
    z = f"{critical(alpha):.17e}"
    return f"""
z1_ AS (SELECT {KEYS}, n1, n2, k1 / n1 AS p1, k2 / n2 AS p2, (k1 + k2) / (n1 + n2) AS pp FROM p),
z2_ AS (SELECT *, sqrt(pp * (1 - pp) * (1 / n1 + 1 / n2)) AS se FROM z1_),
z3_ AS (SELECT *, CASE WHEN se > 0 THEN -abs((p1 - p2) / se) END AS zz, (p2 - p1) / {scale} AS effect, CASE WHEN se > 0 THEN {z} * se / abs({scale}) END AS h FROM z2_),
z4_ AS (SELECT {KEYS}, effect, effect - h AS left_bound, effect + h AS right_bound, 2 * h AS ci_length, 2 * ({phi_sql('zz')}) AS pvalue FROM z3_),
t AS (SELECT *, coalesce(pvalue < {alpha!r}, FALSE) AS reject FROM z4_)
"""


def score_interval(kind: str) -> str:
    """The score interval by bisection, outer steps as recursion and inner ones as a fold; both as fixed numbers of halvings."""
    c = f"{critical(A):.17e}"
    slope = "CASE WHEN {x} > 0 THEN {x} / greatest({p}, 1e-300) ELSE 0e0 END - CASE WHEN {n} > {x} THEN ({n} - {x}) / greatest(1 - ({p}), 1e-300) ELSE 0e0 END"
    m = "((s.lo + s.hi) / 2)"
    if kind == "absolute":
        delta, low, high = "((lo + hi) / 2)", "-1e0", "1e0"
        ends = f"{{'lo': greatest(0e0, -d), 'hi': least(1e0, 1 - d)}}"
        test = f"{slope.format(x='k1', n='n1', p=m)} + {slope.format(x='k2', n='n2', p=f'{m} + d')} > 0"
        top, var = "k2 / n2 - k1 / n1 - d", "greatest(s * (1 - s), 0) / n1 + greatest((s + d) * (1 - s - d), 0) / n2"
        out = "v"
    else:
        delta, low, high = "((lo + hi) / 2) / greatest(1 - (lo + hi) / 2, 1e-16)", "0e0", "1e0"
        ends = "{'lo': 0e0, 'hi': least(1e0, 1 / greatest(d, 1e-300))}"
        test = f"(k1 + k2) / greatest({m}, 1e-300) - CASE WHEN n1 > k1 THEN (n1 - k1) / greatest(1 - {m}, 1e-300) ELSE 0e0 END - CASE WHEN n2 > k2 THEN (n2 - k2) * d / greatest(1 - d * {m}, 1e-300) ELSE 0e0 END > 0"
        top, var = "k2 / n2 - d * k1 / n1", "greatest(d * s * (1 - d * s), 0) / n2 + d * d * greatest(s * (1 - s), 0) / n1"
        out = "v / greatest(1 - v, 1e-16) - 1"
    fold = f"list_reduce(list_transform(range(70), lambda i: {{'lo': 0e0, 'hi': 0e0}}), lambda s, i: CASE WHEN {test} THEN {{'lo': {m}, 'hi': s.hi}} ELSE {{'lo': s.lo, 'hi': {m}}} END, {ends})"
    return f"""WITH RECURSIVE {BASE}, {z_test(kind)},
b0_ AS (SELECT {KEYS}, n1, n2, k1, k2, side, {c} * side AS level, 0 AS step, {low} AS lo, {high} AS hi FROM p, (VALUES (1), (-1)) q(side)),
bs_ AS (SELECT * FROM b0_ UNION ALL SELECT {KEYS}, n1, n2, k1, k2, side, level, step + 1, CASE WHEN z > level THEN (lo + hi) / 2 ELSE lo END, CASE WHEN z > level THEN hi ELSE (lo + hi) / 2 END FROM (
  SELECT *, CASE WHEN var > 0 THEN ({top}) / sqrt(var) WHEN {top} = 0 THEN 0 ELSE sign({top}) * 'inf'::DOUBLE END AS z FROM (SELECT *, {var} AS var FROM (SELECT *, (f.lo + f.hi) / 2 AS s FROM (SELECT *, {fold} AS f FROM (SELECT *, {delta} AS d FROM bs_ WHERE step < 48)))))),
e_ AS (SELECT {KEYS}, max(CASE WHEN side = 1 THEN {out.replace('v', '((lo + hi) / 2)')} END) AS lo, max(CASE WHEN side = -1 THEN {out.replace('v', '((lo + hi) / 2)')} END) AS hi FROM bs_ WHERE step = 48 GROUP BY ALL)"""


def fieller() -> str:
    z2 = f"{critical(A) ** 2:.17e}"
    s1, s2 = _S
    return f"""WITH {BASE},
f1 AS (SELECT {KEYS}, m2 - m1 AS a, {s1} + {s2} AS va, m1 AS b, {s1} AS vb, -{s1} AS c FROM p),
f2 AS (SELECT *, b * b - {z2} * vb AS lead_, a * b - {z2} * c AS mid, {z2} * (b * b * va - 2 * a * b * c + a * a * vb) - {z2} * {z2} * (va * vb - c * c) AS disc FROM f1),
f3 AS (SELECT *, lead_ > 0 AND disc >= 0 AS ok FROM f2),
f4 AS (SELECT *, CASE WHEN ok THEN (mid - sqrt(greatest(disc, 0))) / nullif(lead_, 0) END AS left_bound, CASE WHEN ok THEN (mid + sqrt(greatest(disc, 0))) / nullif(lead_, 0) END AS right_bound,
       a / nullif(b, 0) AS effect, CASE WHEN ok AND va > 0 THEN -abs(a / sqrt(greatest(va, 1e-300))) END AS zz FROM f3),
f5 AS (SELECT *, right_bound - left_bound AS ci_length, 2 * ({phi_sql('zz')}) AS pvalue FROM f4),
t AS (SELECT *, coalesce(pvalue < {A!r}, FALSE) AS reject FROM f5) {_OUT}"""


def _metric(name: str, main: bool, guard: bool, alpha: float) -> str:
    return (f"SELECT '{name}' AS metric, {str(main).upper()} AS is_main_metric, {str(guard).upper()} AS is_guardrail, {alpha!r}::DOUBLE AS alpha, t.*, p.n1::BIGINT AS size_1, p.n2::BIGINT AS size_2 "
            f"FROM {name}_ t JOIN p USING ({KEYS})")


def _tests_named(name: str, body: str) -> str:
    import re

    return re.sub(r"\b(n1_|n2_|n3_|n4_|z1_|z2_|z3_|z4_)\b", lambda m: f"{name}_{m[1]}", body).replace("\nt AS (", f"\n{name}_ AS (")


#: Rows of arms with fewer than two units have no result.
_VOID = ", ".join(f"CASE WHEN size_1 >= 2 AND size_2 >= 2 THEN {c} END AS {c}" for c in ("effect", "left_bound", "right_bound", "ci_length", "pvalue", "reject"))

#: All result rows of the demo experiment, as relation ``results``.
RESULTS = f"""{BASE},
{_tests_named('revenue', _normal(T_ABS, MAIN))},
{_tests_named('signup', z_test('absolute', OTHER))},
{_tests_named('spend_per_event', _normal(RATIO_ABS, OTHER))},
rows_ AS ({_metric('revenue', True, False, MAIN)} UNION ALL BY NAME {_metric('signup', False, False, OTHER)} UNION ALL BY NAME {_metric('spend_per_event', False, True, OTHER)}),
arm_counts AS (SELECT look, end_ts, v.variant, (SELECT count(*) FROM cohort c WHERE c.variant = v.variant AND c.exposure_ts < looks.end_ts) AS n_units
               FROM looks, (VALUES ('control'), ('t1'), ('t2')) v(variant)),
srm_a AS (SELECT look, variant, n_units::DOUBLE AS o, sum(n_units) OVER (PARTITION BY look) / 3 AS ex FROM arm_counts),
srm_ AS (SELECT look, sum(o)::BIGINT AS n_units, sum((o - ex) * (o - ex) / ex) AS chi2, max_by(variant, abs(o - ex) / sqrt(ex) - CASE variant WHEN 'control' THEN 0 WHEN 't1' THEN 1e-9 ELSE 2e-9 END) AS culprit FROM srm_a GROUP BY look),
results AS (SELECT rows_.* REPLACE ({_VOID}), looks.end_ts, looks.is_horizon, looks.elapsed_days, exp(-chi2 / 2) AS srm_pvalue, exp(-chi2 / 2) < 0.001 AS srm_flag, exp(-chi2 / 2) < 0.001 AS decision_blocked,
            size_1 < 2 OR size_2 < 2 AS insufficient_data, 'fixed' AS ci_kind FROM rows_ JOIN looks USING (look) JOIN srm_ USING (look))
"""
LATEST = "latest AS (SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY metric, name_1, name_2 ORDER BY end_ts DESC) = 1)"
SERIES = "metric, name_1, name_2"


def on_results(select: str) -> str:
    return f"WITH {RESULTS}, {LATEST} {select}"
