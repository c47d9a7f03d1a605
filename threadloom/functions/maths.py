"""Numeric column expressions and the few that Spark lacks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log_columns(df: DataFrame, *columns: str) -> DataFrame:
    """log(x + 1) of each column, as <column>_log."""
    return df.withColumns({f"{c}_log": F.log1p(c) for c in columns})


def positive_log(c: str) -> Column:
    """Natural log for display; null at 0 and below."""
    return F.when(F.col(c) > 0, F.ln(c))


def display_log(c: str) -> Column:
    """Natural log as it is drawn: minus infinity at 0, NaN below."""
    x = F.col(c).cast("double")
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.ln(x))


def squeeze(c: str, eps: float = 1e-6) -> Column:
    """A utility in [-1, 1] as a share inside [eps, 1 - eps]."""
    return F.least(F.greatest((F.col(c) + 1) / 2, F.lit(eps)), F.lit(1 - eps))


def score_change(c: str) -> Column:
    """A logit coefficient as change of a score in [-1, 1]: (e^x - 1) / (e^x + 1)."""
    return F.tanh(F.col(c) / 2)


def intervals(df: DataFrame, estimate: str = "estimate", error: str = "std_error") -> DataFrame:
    """Normal intervals at 95 and 99 percent."""
    out = {}
    for level, z in ((95, 1.96), (99, 2.576)):
        out |= {f"ci_lower_{level}": F.col(estimate) - z * F.col(error), f"ci_upper_{level}": F.col(estimate) + z * F.col(error)}
    return df.withColumns(out)


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0, in built-in functions: its small values don't vanish.

    Below 3 the series of erf, whose terms are all positive; from there on the
    continued fraction of erfc, from its far end.
    """
    twice = 2 * x * x
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def grow(s: Column, n: Column) -> Column:
        term = s["term"] * twice / (2 * n + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(80)), start, grow)["sum"]
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1)), x, lambda k, n: x + n / (2 * k))
    tail = F.exp(-x * x)
    return F.when(x < 3, 1 - 2 / math.sqrt(math.pi) * x * tail * series).otherwise(tail / (math.sqrt(math.pi) * fraction))


def two_sided_p(z: str) -> Column:
    """2 * (1 - Phi(|z|)); NaN of NaN, null of null."""
    return erfc(F.abs(F.col(z).cast("double")) / math.sqrt(2))


def correlation_p(r: str, n: str, steps: int = 2000) -> Column:
    """Two-sided p of a correlation r of n rows against none; null for fewer than 3 rows.

    The share of the angles 0 to arccos |r| in the integral of sin ^ (n - 3), by
    Simpson's rule; beyond 10,000 rows that of the normal distribution, for t made normal.
    """
    value, free = F.col(r).cast("double"), F.col(n) - 2
    weights = F.sequence(F.lit(0), F.lit(steps))

    def integral(upto: Column) -> Column:
        def term(s: Column, k: Column) -> Column:
            weight = F.when((k == 0) | (k == steps), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0)
            # sin ^ 0 is 1 at the angle 0 too
            return s + weight * F.pow(F.sin(upto * k / steps), free - 1.0)

        return upto * F.aggregate(weights, F.lit(0.0), term)

    exact = integral(F.acos(F.least(F.abs(value), F.lit(1.0)))) / integral(F.lit(math.pi / 2))
    # t as a normal value: the square root of (free - 1/2) * log(1 + t ^ 2 / free)
    normal = erfc(F.sqrt((0.5 - free) * F.log1p(-value * value)) / math.sqrt(2))
    known = value.isNotNull() & (free > 0)
    return F.when(known & (F.col(n) <= 10_000), exact).when(known, F.when(F.abs(value) < 1, normal).otherwise(F.lit(0.0)))


def exact_mean(c: str) -> Column:
    """Aggregate: the mean of numbers, the same in whatever order they are added, so that equal means are equal.

    Numbers of up to six decimals are added as whole millionths; a group that holds
    others (more decimals, NaN, 9e9 and more) has the plain mean.
    """
    x = F.col(c).cast("double")
    units = F.rint(x * 1e6)
    units = F.when((F.abs(units) < 2**53) & (units / 1e6 == x), units.cast("long"))
    mean = F.try_sum(units) / F.nullif(F.count(c), F.lit(0)) / 1e6
    return F.coalesce(F.when(F.count(units) == F.count(c), mean), F.avg(c))


def rmsle(truth: str, guess: str) -> Column:
    """Aggregate: root mean squared error of log(x + 1); guesses below 0 count as 0."""
    return F.sqrt(F.avg(F.pow(F.log1p(F.greatest(F.col(guess), F.lit(0.0))) - F.log1p(truth), F.lit(2))))


def squared_log_gradient(truth: str, guess: str) -> Column:
    """Gradient and hessian of half the squared log error, guesses at least -1 + 1e-6."""
    g = F.greatest(F.col(guess), F.lit(-1 + 1e-6))
    d = F.log1p(g) - F.log1p(truth)
    return F.struct((d / (g + 1)).alias("gradient"), ((1 - d) / F.pow(g + 1, F.lit(2))).alias("hessian"))


def trapezoid(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Area under points (x, y), by groups; the sign is that of the direction of x.

    Points must go one way in x; where they don't the area is null.
    """
    order = Window.partitionBy(*by).orderBy("_at") if by else Window.orderBy("_at")
    steps = df.withColumn("_dx", F.col(x) - F.lag(x).over(order)).withColumn("_mean", (F.col(y) + F.lag(y).over(order)) / 2)
    agg = [F.sum(F.col("_dx") * F.col("_mean")).alias("area"), F.min("_dx").alias("low"), F.max("_dx").alias("high")]
    out = steps.groupBy(*by).agg(*agg) if by else steps.agg(*agg)
    area = F.when(F.col("low") >= 0, F.col("area")).when(F.col("high") <= 0, -F.col("area"))
    return out.select(*by, area.alias("area"))
