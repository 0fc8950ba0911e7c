"""Number coercion, rounding and the normal distribution as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Fixed pattern: what counts as a number in text. Spark's own cast also takes
# a type suffix ("12d"), which must become null here.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def to_number(c: Column | str) -> Column:
    """Double value of a text column; anything that is not a number is null."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def half_even(c: Column, scale: int = 0) -> Column:
    return F.bround(c, scale)


def half_up(c: Column) -> Column:
    """Nearest whole number, halves upwards (also for negatives)."""
    return F.floor(c + F.lit(0.5))


def _horner(x: Column, coefficients: list[float]) -> Column:
    """Polynomial with the highest power first."""
    return reduce(lambda acc, k: acc * x + F.lit(k), coefficients[1:], F.lit(coefficients[0]))


# The two polynomials of Hart's double-precision normal integral,
# as published by West, "Better approximations to cumulative normal functions" (2005).
_CDF_TOP = [
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
_CDF_BOTTOM = [
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]


def with_normal_cdf(df: DataFrame, z: str, output: str) -> DataFrame:
    """Add the standard normal distribution function of ``z`` (absolute error
    about 1e-15). Repeated terms are columns of their own, so that the generated code
    stays small enough to be compiled."""
    rows = df.withColumn("_a", F.abs(F.col(z).cast("double")))
    rows = rows.withColumn("_d", F.exp(-F.col("_a") * F.col("_a") / F.lit(2.0)))
    a, density = F.col("_a"), F.col("_d")
    tail = a + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = a + F.lit(k) / tail
    rows = rows.withColumn(
        "_u",
        F.when(a > 37.0, F.lit(0.0))
        .when(a < 7.07106781186547, density * _horner(a, _CDF_TOP) / _horner(a, _CDF_BOTTOM))
        .otherwise(density / tail / F.lit(2.506628274631)),
    )
    upper = F.col("_u")
    return rows.withColumn(output, F.when(F.col(z) > 0.0, F.lit(1.0) - upper).otherwise(upper)).drop("_a", "_d", "_u")


# Wichura's algorithm AS 241 (PPND16), "The percentage points of
# the normal distribution", Applied Statistics 37 (1988). Highest power first.
_PPF_CENTRE = (
    [2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4,
     4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3,
     1.3314166789178437745e2, 3.3871328727963666080e0],
    [5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4,
     2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2,
     4.2313330701600911252e1, 1.0],
)
_PPF_MIDDLE = (
    [7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1,
     1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0,
     4.63033784615654529590e0, 1.42343711074968357734e0],
    [1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2,
     1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0,
     2.05319162663775882187e0, 1.0],
)
_PPF_TAIL = (
    [2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3,
     2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0,
     5.46378491116411436990e0, 6.65790464350110377720e0],
    [2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5,
     7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1,
     5.99832206555887937690e-1, 1.0],
)


def with_normal_ppf(df: DataFrame, p: str, output: str) -> DataFrame:
    """Add the inverse of the normal distribution function, null unless 0 < p < 1."""
    inner = F.when((F.col(p) > 0.0) & (F.col(p) < 1.0), F.col(p))
    rows = df.withColumns({"_q": inner - F.lit(0.5), "_t": F.least(inner, F.lit(1.0) - inner)})
    q = F.col("_q")
    rows = rows.withColumns({"_c": F.lit(0.180625) - q * q, "_r": F.sqrt(-F.ln("_t"))})
    rows = rows.withColumns({"_m": F.col("_r") - F.lit(1.6), "_f": F.col("_r") - F.lit(5.0)})
    ratio = lambda c, k: _horner(F.col(c), k[0]) / _horner(F.col(c), k[1])
    rows = rows.withColumn(
        "_s",
        F.when(F.abs(q) <= 0.425, F.abs(q) * ratio("_c", _PPF_CENTRE))
        .when(F.col("_r") <= 5.0, ratio("_m", _PPF_MIDDLE))
        .otherwise(ratio("_f", _PPF_TAIL)),
    )
    signed = F.when(q < 0.0, -F.col("_s")).otherwise(F.col("_s"))
    return rows.withColumn(output, signed).drop("_q", "_t", "_c", "_r", "_m", "_f", "_s")
