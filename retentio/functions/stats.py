"""Statistical scalar functions as column expressions.

Spark SQL has no error function or normal CDF, so the two-sided normal tail is
written with a published rational approximation of erfc (Abramowitz & Stegun
7.1.26, absolute error <= 1.5e-7). Normal quantiles of *parameters* (alpha,
power) are scalars computed once on the driver with the standard library and
enter the plan as literals; no data passes through the driver.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published constants of the approximation (Abramowitz & Stegun 7.1.26).
ERFC_P = 0.3275911
ERFC_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_quantile(q: float) -> float:
    """Inverse standard-normal CDF of a parameter (driver-side scalar)."""
    return NormalDist().inv_cdf(q)


def erfc_nonneg(x: Column) -> Column:
    """erfc(x) for x >= 0 as a column expression."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERFC_P) * x)
    a1, a2, a3, a4, a5 = ERFC_A
    poly = t * (F.lit(a1) + t * (F.lit(a2) + t * (F.lit(a3) + t * (F.lit(a4) + t * F.lit(a5)))))
    return poly * F.exp(-(x * x))


def two_sided_p(z: Column) -> Column:
    """Two-sided p-value of a standard-normal statistic: erfc(|z| / sqrt 2)."""
    return erfc_nonneg(F.abs(z) / F.lit(math.sqrt(2.0)))


def erfc_python(x: float) -> float:
    """Same approximation in Python (used by tests to check the column version)."""
    ax = abs(x)
    t = 1.0 / (1.0 + ERFC_P * ax)
    a1, a2, a3, a4, a5 = ERFC_A
    y = t * (a1 + t * (a2 + t * (a3 + t * (a4 + t * a5)))) * math.exp(-ax * ax)
    return y if x >= 0 else 2.0 - y


def two_sided_p_sql(z: str) -> str:
    """SQL text of :func:`two_sided_p` (same operations, same order)."""
    x = f"(abs({z}) / {math.sqrt(2.0)!r}D)"
    t = f"(1.0D / (1.0D + {ERFC_P!r}D * {x}))"
    a1, a2, a3, a4, a5 = (f"{a!r}D" for a in ERFC_A)
    poly = f"({t} * ({a1} + {t} * ({a2} + {t} * ({a3} + {t} * ({a4} + {t} * {a5})))))"
    return f"({poly} * exp(-({x} * {x})))"
