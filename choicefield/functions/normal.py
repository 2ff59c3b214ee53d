"""Normal density, distribution and quantile as pure Column expressions.

Spark has no ``erf``; the rational approximations below are good to about
1e-15 (absolute) and stay inside whole-stage codegen. They mention their argument
about 25 times, so give them a column, not a long expression (``withColumn`` first).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hart's double-precision rational for the normal integral.
HART_NUM = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
            112.079291497871, 221.213596169931, 220.206867912376]
HART_DEN = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
            296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
HART_SPLIT = 7.07106781186547

# Wichura's AS241 rationals for the normal quantile (highest power first).
AS241_CENTRE = (
    [2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
     13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.3871328727963666080],
    [5226.4952788528545610, 28729.085735721942674, 39307.895800092710610, 21213.794301586595867,
     5394.1960214247511077, 687.18700749205790830, 42.313330701600911252, 1.0])
AS241_MIDDLE = (
    [7.74545014278341407640e-4, 0.0227238449892691845833, 0.241780725177450611770,
     1.27045825245236838258, 3.64784832476320460504, 5.76949722146069140550,
     4.63033784615654529590, 1.42343711074968357734],
    [1.05075007164441684324e-9, 5.47593808499534494600e-4, 0.0151986665636164571966,
     0.148103976427480074590, 0.689767334985100004550, 1.67638483018380384940,
     2.05319162663775882187, 1.0])
AS241_TAIL = (
    [2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.00124266094738807843860,
     0.0265321895265761230930, 0.296560571828504891230, 1.78482653991729133580,
     5.46378491116411436990, 6.65790464350110377720],
    [2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5,
     7.86869131145613259100e-4, 0.0148753612908506148525, 0.136929880922735805310,
     0.599832206555887937690, 1.0])

SQRT_2PI = math.sqrt(2 * math.pi)


def _poly(coefs: list[float], x: Column) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2.0) / SQRT_2PI


def norm_cdf(x: Column) -> Column:
    a = F.abs(x)
    e = F.exp(-a * a / 2.0)
    near = e * _poly(HART_NUM, a) / _poly(HART_DEN, a)
    frac = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        frac = a + F.lit(k) / frac
    tail = F.when(a > 37.0, 0.0).when(a < HART_SPLIT, near).otherwise(e / frac / SQRT_2PI)
    # |1 - tail| above 0, |0 - tail| below: the long expression appears once
    return F.abs(F.when(x > 0, 1.0).otherwise(0.0) - tail)


def two_sided_p(z: Column) -> Column:
    """2(1 - Phi(|z|)), taken from the lower tail so that it does not cancel."""
    return 2.0 * norm_cdf(-F.abs(z))


def _ppf(p: Column, q: Column, r: Column) -> Column:
    rc = 0.180625 - q * q
    centre = q * _poly(AS241_CENTRE[0], rc) / _poly(AS241_CENTRE[1], rc)
    middle = _poly(AS241_MIDDLE[0], r - 1.6) / _poly(AS241_MIDDLE[1], r - 1.6)
    tail = _poly(AS241_TAIL[0], r - 5.0) / _poly(AS241_TAIL[1], r - 5.0)
    outer = F.when(r <= 5.0, middle).otherwise(tail)
    return (F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
            .when(F.abs(q) <= 0.425, centre).otherwise(F.signum(q) * outer))


def _tail_arg(p: Column) -> Column:
    return F.sqrt(-F.log(F.least(p, 1.0 - p)))


def norm_ppf(p: Column) -> Column:
    return _ppf(p, p - 0.5, _tail_arg(p))


def with_normals(df: DataFrame, uniforms: dict[str, Column]) -> DataFrame:
    """Adds name = Phi^-1(uniform); uniform, tail argument and quantile are separate projections."""
    out = df.withColumns({f"__u_{n}": u for n, u in uniforms.items()})
    out = out.withColumns({f"__r_{n}": _tail_arg(F.col(f"__u_{n}")) for n in uniforms})
    out = out.withColumns({n: _ppf(F.col(f"__u_{n}"), F.col(f"__u_{n}") - 0.5, F.col(f"__r_{n}")) for n in uniforms})
    return out.drop(*[f"__{x}_{n}" for n in uniforms for x in ("u", "r")])
