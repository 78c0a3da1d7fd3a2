"""Delta-method ratio of means, as aggregate columns.

Variances are population variances while the covariance is the sample one; the
results to match are defined that way, so the two are kept apart on purpose.
All parts merge map-side, so a group of any size is never brought together.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_of_means(x: Column, y: Column) -> Column:
    """avg(x)/avg(y); 0 when avg(y) is 0."""
    x, y = x.cast("double"), y.cast("double")
    return F.coalesce(F.try_divide(F.avg(x), F.avg(y)), F.lit(0.0))


def ratio_variance(x: Column, y: Column) -> Column:
    """Delta-method variance of ratio_of_means; 0 when avg(y) is 0 or there is one row."""
    x, y = x.cast("double"), y.cast("double")
    return combine(
        F.avg(x), F.avg(y), F.var_pop(x), F.var_pop(y), F.covar_samp(x, y), F.count(y)
    )


def combine(mx: Column, my: Column, vx: Column, vy: Column, cxy: Column, n: Column) -> Column:
    """The variance from means, population variances, sample covariance and row count."""
    spread = (
        F.try_divide(vx, my * my)
        + F.try_divide(vy * mx * mx, my * my * my * my)
        - F.try_divide(F.lit(2.0) * cxy * mx, my * my * my)
    )
    defined = (n > 1) & (my != 0)
    return F.coalesce(F.when(defined, F.try_divide(spread, n)), F.lit(0.0))
