"""Attribution of a day's GMV change to visitors, conversion and order value, by logarithmic means.

GMV = visitors * (buyers / visitors) * (gmv / buyers). With w the logarithmic mean of both days' GMV, factor k adds
w * ln(k1 / k0) / g0, and the three add up to the change exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FACTORS = ["visitors", "conversion_rate", "avg_order_value"]


def contributions(g1: Column, v1: Column, b1: Column, g0: Column, v0: Column, b0: Column) -> dict[str, Column]:
    """gmv_dod, a contribution for each factor and the driver; all NULL unless all six inputs are over 0."""
    g1, v1, b1, g0, v0, b0 = (F.coalesce(c.cast("double"), F.lit(0.0)) for c in (g1, v1, b1, g0, v0, b0))
    ok = F.least(g1, v1, b1, g0, v0, b0) > 0
    safe = lambda c: F.when(ok, c)
    w = F.when(F.abs(g1 - g0) < 1e-9, g0).otherwise((g1 - g0) / F.ln(g1 / g0))
    part = lambda now, base: F.round(safe(w * F.ln(now / base) / g0), 4)
    v, c, a = part(v1, v0), part(b1 / v1, b0 / v0), part(g1 / b1, g0 / b0)
    dod = F.round(safe((g1 - g0) / g0), 4)
    first = lambda best: F.when(v == best, FACTORS[0]).when(c == best, FACTORS[1]).otherwise(FACTORS[2])
    raw = safe((g1 - g0) / g0)
    driver = F.when(raw < -0.005, first(F.least(v, c, a))).when(raw > 0.005, first(F.greatest(v, c, a))).when(raw.isNotNull(), "stable")
    return {"gmv_dod": dod, **dict(zip(FACTORS, (v, c, a), strict=True)), "primary_driver": driver}
