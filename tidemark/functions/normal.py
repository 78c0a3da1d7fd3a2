"""Normal quantile and distribution function.

Scalars come from the standard library on the driver; row values are a column expression.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

_NORMAL = NormalDist()


def quantile(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def two_sided_z(confidence: float) -> float:
    """z for a two-sided interval; confidence in percent, for example 95."""
    return quantile(1 - (1 - confidence / 100) / 2)


def cdf(x: float) -> float:
    return _NORMAL.cdf(x)


# Algorithm AS 241 (PPND16) of Wichura, 1988, highest power first: numerator and denominator near the
# middle, in the tails, and far out.
_MIDDLE = (
    (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4,
     1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0),
    (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4,
     5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0),
)
_TAIL = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0,
     3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
     6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0),
)
_FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2,
     2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0),
    (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4,
     1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0),
)
# The rational form of the normal tail by Hart, 1968, highest power first.
_HART = (
    (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931,
     220.206867912376),
    (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831,
     793.826512519948, 440.413735824752),
)


def _polynomial(x: Column, factors: tuple[float, ...]) -> Column:
    total = F.lit(factors[0])
    for factor in factors[1:]:
        total = total * x + factor
    return total


def _ratio(x: Column, pair: tuple[tuple[float, ...], tuple[float, ...]]) -> Column:
    return _polynomial(x, pair[0]) / _polynomial(x, pair[1])


def quantile_column(p: Column) -> Column:
    """Normal quantile of 0 < p < 1 to 15 digits; infinite at 0 and 1, NULL outside. Small p keep their digits."""
    q = p - 0.5
    tail = F.sqrt(-F.log(F.when(q <= 0, p).otherwise(1 - p)))
    outer = F.when(tail <= 5, _ratio(tail - 1.6, _TAIL)).otherwise(_ratio(tail - 5, _FAR))
    inner = q * _ratio(0.180625 - q * q, _MIDDLE)
    ends = F.when(p == 0, -math.inf).when(p == 1, math.inf)
    inside = F.when(F.abs(q) <= 0.425, inner).when(q < 0, -outer).otherwise(outer)
    return F.when((p > 0) & (p < 1), inside).otherwise(ends)


def cdf_column(x: Column) -> Column:
    """Normal distribution function; in the lower tail with the digits of the tail itself."""
    size = F.abs(x)
    near = _ratio(size, _HART)
    # A continued fraction from 4 on, where the other form begins to lose digits of the tail: 12 digits on both sides.
    far = size + 0.65
    for step in range(24, 0, -1):
        far = size + F.lit(float(step)) / far
    tail = F.exp(-x * x / 2) * F.when(size < 4, near).otherwise(1 / (far * math.sqrt(2 * math.pi)))
    return F.when(x < 0, tail).otherwise(1 - tail)
