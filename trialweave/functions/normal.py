"""The Normal distribution: its CDF as a Column or SQL text, and quantiles as literals."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialweave.functions.columns import let

# Coefficients of the rational approximations of W. J. Cody (1969), as published.
A = (2.2352520354606839287, 161.02823106855587881, 1067.6894854603709582, 18154.981253343561249, 0.065682337918207449113)
B = (47.20258190468824187, 976.09855173777669322, 10260.932208618978205, 45507.789335026729956)
C = (0.39894151208813466764, 8.8831497943883759412, 93.506656132177855979, 597.27027639480026226, 2494.5375852903726711,
     6848.1904505362823326, 11602.651437647350124, 9842.7148383839780218, 1.0765576773720192317e-8)
D = (22.266688044328115691, 235.38790178262499861, 1519.377599407554805, 6485.558298266760755, 18615.571640885098091,
     34900.952721145977266, 38912.003286093271411, 19685.429676859990727)
P = (0.21589853405795699, 0.1274011611602473639, 0.022235277649736872, 0.001421619193227893466, 2.9112874951168792e-5, 0.02307344176494017303)
Q = (1.28426009614491121, 0.468238212480865118, 0.0659881378689285515, 0.00378239633202758244, 7.29751555083966205e-5)
INNER, MIDDLE, DENSITY0 = 0.67448975, 5.656854249492380195, 0.398942280401432677939946


def _ladder(lead, start, steps, x):
    """Horner with the leading coefficient first: ((lead x + s0) x + s1) x ..."""
    out = lead * x if start is None else start
    for s in steps:
        out = (out + s) * x
    return out


def _upper(y, exp, trunc):
    """The upper tail at y > INNER, in whichever algebra ``y`` lives."""
    base = trunc(y)
    shape = exp(base * base * -0.5) * exp((y - base) * (y + base) * -0.5)
    middle = (_ladder(C[8], None, C[:7], y) + C[7]) / (_ladder(1.0, y, D[:7], y) + D[7])
    w = 1.0 / (y * y)
    far = (DENSITY0 - w * (_ladder(P[5], None, P[:4], w) + P[4]) / (_ladder(1.0, w, Q[:4], w) + Q[4])) / y
    return shape, middle, far


def phi(z: Column) -> Column:
    """P(N(0, 1) <= z); null for null or NaN."""

    def at(x: Column) -> Column:
        y, s = F.abs(x), x * x
        inner = 0.5 + x * (_ladder(A[4], None, A[:3], s) + A[3]) / (_ladder(1.0, s, B[:3], s) + B[3])
        safe = F.greatest(y, F.lit(INNER))
        shape, middle, far = _upper(safe, F.exp, lambda v: F.floor(v * 16.0) / 16.0)
        tail = shape * F.when(safe <= MIDDLE, middle).otherwise(far)
        return F.when(y <= INNER, inner).when(x < 0, tail).when(x >= 0, 1.0 - tail)

    clean = F.when(z.isNotNull() & ~F.isnan(z), F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0)))
    return let(clean, at)


class _Sql:
    """Arithmetic that writes SQL text."""

    def __init__(self, text):
        self.text = text

    def _make(a, op, b):  # noqa: N805
        return _Sql(f"({_sql(a)} {op} {_sql(b)})")

    def __add__(self, o):
        return _Sql._make(self, "+", o)

    def __radd__(self, o):
        return _Sql._make(o, "+", self)

    def __sub__(self, o):
        return _Sql._make(self, "-", o)

    def __rsub__(self, o):
        return _Sql._make(o, "-", self)

    def __mul__(self, o):
        return _Sql._make(self, "*", o)

    def __rmul__(self, o):
        return _Sql._make(o, "*", self)

    def __truediv__(self, o):
        return _Sql._make(self, "/", o)

    def __rtruediv__(self, o):
        return _Sql._make(o, "/", self)


def _sql(x) -> str:
    return x.text if isinstance(x, _Sql) else f"{float(x):.17e}"


def phi_sql(z: str) -> str:
    """:func:`phi` as SQL text on the column or expression ``z``."""
    x = _Sql(f"greatest(least({z}, 4e1), -4e1)")
    y, s = _Sql(f"greatest(abs({x.text}), {INNER:.17e})"), x * x
    inner = 0.5 + x * (_ladder(A[4], None, A[:3], s) + A[3]) / (_ladder(1.0, s, B[:3], s) + B[3])
    shape, middle, far = _upper(y, lambda v: _Sql(f"exp({v.text})"), lambda v: _Sql(f"(floor({(v * 16.0).text}) / 1.6e1)"))
    tail = f"({shape.text} * CASE WHEN {y.text} <= {MIDDLE:.17e} THEN {middle.text} ELSE {far.text} END)"
    return f"CASE WHEN {z} IS NULL THEN NULL WHEN abs({x.text}) <= {INNER:.17e} THEN {inner.text} WHEN {z} < 0 THEN {tail} ELSE 1e0 - {tail} END"


def two_sided(z: Column) -> Column:
    """The two-sided p-value of a z statistic, from the smaller tail."""
    return let(-F.abs(z), lambda x: 2.0 * phi(x))


def quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def critical(alpha: float) -> float:
    return quantile(1 - alpha / 2)
