"""Normal distribution as Column expressions that stay inside whole-stage codegen.

Cumulative probabilities follow Hart's rational approximation in double precision
(West 2005), quantiles follow Wichura's AS 241 (PPND16).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published approximations.
CDF_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
PPF_MID_NUM = (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608)
PPF_MID_DEN = (5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0)
PPF_NEAR_NUM = (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734)
PPF_NEAR_DEN = (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0)
PPF_FAR_NUM = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772)
PPF_FAR_DEN = (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0)
SQRT_TWO_PI = 2.5066282746310002


def horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    """The polynomial with these coefficients, highest power first."""
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def norm_pdf(x: Column) -> Column:
    """Density of the standard normal."""
    return F.exp(-x * x / 2) / SQRT_TWO_PI


def norm_cdf(x: Column) -> Column:
    """Cumulative probability of the standard normal; exact 0 and 1 at the infinities, null for null.

    The upper tail stands in the expression once, so that generated methods stay small
    enough for the JVM to compile.
    """
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    tail = a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))
    upper = F.when(a > 37.0, 0.0).when(a < 7.07106781186547, e * horner(a, CDF_NUM) / horner(a, CDF_DEN)).otherwise(e / tail / 2.506628274631)
    return F.when(x > 0, 1.0).otherwise(0.0) + F.when(x > 0, -1.0).otherwise(1.0) * upper


def norm_ppf(p: Column) -> Column:
    """Quantile of the standard normal; minus and plus infinity at 0 and 1, null outside.

    The variable of the polynomials, which depends on the region, stands in the first
    condition: so it is worked out once for all of them, and the generated method
    stays small enough for the JVM to compile.
    """
    q = p - 0.5
    middle = F.abs(q) <= 0.425
    tail = F.sqrt(-F.coalesce(F.ln(F.least(p, 1 - p)), F.lit(float("-inf"))))
    r = F.when(middle, 0.180625 - q * q).otherwise(tail)
    near, far = ((horner(r - at, n), horner(r - at, d)) for at, n, d in ((1.6, PPF_NEAR_NUM, PPF_NEAR_DEN), (5.0, PPF_FAR_NUM, PPF_FAR_DEN)))
    sign = F.when(q < 0, -1.0).otherwise(1.0)
    return (
        F.when(F.isnan(r) | (r > 1e3), F.when(p == 0, float("-inf")).when(p == 1, float("inf")))  # at and beyond the ends
        .when(middle, q * horner(r, PPF_MID_NUM) / horner(r, PPF_MID_DEN))
        .when(r <= 5.0, sign * near[0] / near[1])
        .otherwise(sign * far[0] / far[1])
    )
