"""Alpha policies for repeated looks: plain functions (peek, n, peeks) -> alpha.

Those of this module are known as columns too (COLUMNS), so that no Python runs per peek. Any other callable runs inside
tasks; the module is shipped with the tasks, so executors need nothing installed.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable
from statistics import NormalDist

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import normal

ALPHA = 0.05
RHO = 0.5


def naive_alpha(peek: int, n: int, peeks, alpha: float = ALPHA) -> float:
    return alpha


def bonferroni_alpha(peek: int, n: int, peeks, alpha: float = ALPHA) -> float:
    return alpha / len(peeks)


def obrien_fleming_alpha(peek: int, n: int, peeks, alpha: float = ALPHA, rho: float = RHO) -> float:
    """Alpha spent up to a peek at share t of the steps: 4 - 4 cdf(z / t^(rho/2))."""
    boundary = NormalDist().inv_cdf(1 - alpha / 4) / (peek / n) ** (rho / 2)
    # The lower tail by its complement, so that small alphas keep their digits.
    return 2 * math.erfc(boundary / math.sqrt(2))


def z_for(alpha: float) -> float:
    """Two-sided z, worked out in the lower tail, where small alphas keep their digits."""
    return -NormalDist().inv_cdf(alpha / 2) if alpha > 0 else math.inf


def _obrien_fleming(peek: Column, n: Column, peeks: Column) -> Column:
    share = peek.cast("double") / n.cast("double")
    return 4 * normal.cdf_column(-normal.quantile(1 - ALPHA / 4) / F.pow(share, F.lit(RHO / 2)))


#: The policies of this module with their default parameters, from peek, steps and number of peeks as columns.
COLUMNS: dict[Callable, Callable[[Column, Column, Column], Column]] = {
    naive_alpha: lambda peek, n, peeks: F.lit(ALPHA),
    bonferroni_alpha: lambda peek, n, peeks: F.lit(ALPHA) / peeks.cast("double"),
    obrien_fleming_alpha: _obrien_fleming,
}


def z_column(alpha: Column) -> Column:
    return -normal.quantile_column(alpha / 2)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
