"""Column expressions of the indicators; all stay within generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.functions.spec import Aggregation, MetricSpec, require, simplex, steepest

P = [f"p{k}" for k in range(1, 7)]


def _sum(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def transform(x: Column, agg: Aggregation) -> Column:
    return x if agg.kind == "linear" else F.expm1(-agg.rho * x) / F.lit(math.expm1(-agg.rho))


def dhi_symmetric(spec: MetricSpec) -> Column:
    gap = _sum([F.abs(F.col(p) - q) for p, q in zip(P, spec.reference, strict=True)]) / 2
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - gap / (1 - min(spec.reference))))


def dhi_asymmetric(spec: MetricSpec) -> Column:
    top = max(*spec.shortage, *spec.excess)
    gap = _sum([a / top * F.greatest(q - F.col(p), F.lit(0.0)) + b / top * F.greatest(F.col(p) - q, F.lit(0.0)) for p, q, a, b in zip(P, spec.reference, spec.shortage, spec.excess, strict=True)])
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - gap / spec.worst_asymmetric()))


def dhi_legacy(reference) -> Column:
    return 1 - _sum([F.abs(F.col(p) - q) for p, q in zip(P, reference, strict=True)]) / 2


def utility(level: Column, utilities) -> Column:
    return F.element_at(F.array(*[F.lit(float(u)) for u in utilities]), level)


def transition(first: Column, last: Column, utilities) -> Column:
    return 0.5 + 0.5 * (utility(last, utilities) - utility(first, utilities))


def breadth(count: Column, most: int) -> Column:
    return F.log1p(count) / math.log1p(most)


def contributions(values: list[Column], weights, agg: Aggregation) -> list[Column]:
    """100 * weight * g(value); 0 for a weight of 0, null for a missing value."""
    return [F.lit(0.0) if w == 0 else 100 * w * transform(v, agg) for v, w in zip(values, weights, strict=True)]


def composite(values: list[Column], weights, agg: Aggregation) -> tuple[Column, Column, Column]:
    """(score, lower bound, upper bound). The score needs every indicator of
    positive weight; without one of them the bounds take its place."""
    parts = contributions(values, weights, agg)
    known = F.least(F.lit(100.0), _sum([F.coalesce(p, F.lit(0.0)) for p in parts]))
    open_ = _sum([F.when(v.isNull(), F.lit(float(w))).otherwise(F.lit(0.0)) for v, w in zip(values, weights, strict=True)])
    gap = F.lit(False)
    for p in parts:
        gap = gap | p.isNull()
    return F.when(~gap, known), F.when(gap, known), F.when(gap, F.least(F.lit(100.0), known + 100 * open_))


def feature_bound(errors: list[Column], weights, agg: Aggregation) -> Column:
    """The most that a score changes when each indicator is off by its error; null
    where an error is unknown."""
    simplex(weights, 4)
    require(len(errors) == 4, "INVALID_INDICATOR_COUNT")
    return 100 * steepest(agg) * _sum([F.abs(e) * w for e, w in zip(errors, weights, strict=True)])


def hashed(*parts) -> Column:
    """The 13 hexadecimal digits that ``uniform`` is made of."""
    key = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.substring(F.md5(key), 1, 13)


def bar(t: Column) -> Column:
    """``hashed(...) < bar(t)`` as texts if and only if ``uniform(...) < t``: rows that only
    compare their number need not compute it."""
    n = F.ceil(t * float(1 << 52))
    return F.when(n >= 1 << 52, "g").otherwise(F.lower(F.lpad(F.hex(F.greatest(n, F.lit(0).cast("long"))), 13, "0")))


def uniform(*parts) -> Column:
    """A uniform number in [0, 1) from a key: 52 bits of its MD5 digest, the same in
    any engine and whatever the order of rows."""
    return F.conv(hashed(*parts), 16, 10).cast("double") / float(1 << 52)


def csv_safe(c: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets a leading apostrophe."""
    return F.when(F.ltrim(c).rlike("^[=+\\-@]"), F.concat(F.lit("'"), c)).otherwise(c)
