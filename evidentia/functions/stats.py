"""Statistics as column expressions, so they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Coefficients of the rational fit of erfc, from the constant term up.
ERFC_COEFFICIENTS = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * F.abs(x))
    inner: Column = F.lit(ERFC_COEFFICIENTS[-1])
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        inner = F.lit(c) + t * inner
    tau = t * F.exp(-x * x + inner)
    return F.when(x >= 0, tau).otherwise(F.lit(2.0) - tau)


def normal_cdf(z: Column) -> Column:
    return F.lit(0.5) * erfc(-z / F.sqrt(F.lit(2.0)))


def kolmogorov_q(lam: Column) -> Column:
    """Tail of the Kolmogorov distribution; 1 below 0.2, where the series does not settle."""
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
        lambda s, j: s + F.lit(2.0) * F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(F.lit(-2.0) * j * j * lam * lam),
    )
    return F.when(F.isnan(lam) | lam.isNull() | (lam < 0.2), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), terms)))


def round_half_up(x: Column, digits: int = 3) -> Column:
    """Half goes up also below zero, unlike round()."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def ks_two_sample(values: DataFrame, keys: list[str], side: str, value: str) -> DataFrame:
    """Kolmogorov-Smirnov for each key: rows hold `side` (0 or 1) and a value -> n, m, d, p_value.

    Counts per distinct value come first, so the ordered window runs over distinct values only.
    """
    counts = values.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, value).agg(
        F.sum(F.when(F.col(side) == 0, 1).otherwise(0)).alias("__a"), F.sum(F.when(F.col(side) == 1, 1).otherwise(0)).alias("__b"))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    steps = counts.select(*keys, F.sum("__a").over(upto).alias("ca"), F.sum("__b").over(upto).alias("cb"), F.sum("__a").over(whole).alias("n"), F.sum("__b").over(whole).alias("m"))
    steps = steps.where("n > 0 AND m > 0")
    out = steps.groupBy(*keys).agg(F.max("n").alias("n"), F.max("m").alias("m"), F.max(F.abs(F.col("ca") / F.col("n") - F.col("cb") / F.col("m"))).alias("d"))
    root = F.sqrt(F.col("n") * F.col("m") / (F.col("n") + F.col("m")))
    return out.withColumn("p_value", kolmogorov_q((root + 0.12 + F.lit(0.11) / root) * F.col("d")))


def benjamini_hochberg(tests: DataFrame, p: str, order: list[str], q: float = 0.05, keys: list[str] | None = None) -> DataFrame:
    """Step-up control of the false discovery rate: adds bh_rank, bh_threshold, rejected."""
    clean = F.when(F.col(p).isNull() | F.isnan(p), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(p))))
    part = Window.partitionBy(*(keys or []))
    ranked = tests.withColumn("__p", clean).withColumn("bh_rank", F.row_number().over(part.orderBy("__p", *order)))
    ranked = ranked.withColumn("bh_threshold", F.col("bh_rank") / F.count("*").over(part) * F.lit(q))
    last = F.max(F.when(F.col("__p") <= F.col("bh_threshold"), F.col("bh_rank")).otherwise(0)).over(part)
    return ranked.withColumn("rejected", F.col("bh_rank") <= last).drop("__p")


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c discordant pairs: twice the lower binomial tail.

    Terms follow from the largest one, that of the smaller count, downwards by their ratios; that one is taken by logarithms, as 2^-n is no double from n = 1075 on.
    """
    n, low = b + c, F.least(b, c).cast("int")
    first = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term"))
    tail = F.aggregate(
        F.sequence(F.lit(0), low), first,
        lambda s, k: F.struct((s["sum"] + s["term"]).alias("sum"), (s["term"] * (low - k) / (n - low + k + F.lit(1))).alias("term")), lambda s: s["sum"],
    )
    largest = F.exp(_log_factorial(n) - _log_factorial(low) - _log_factorial(n - low) + n * F.log(F.lit(0.5)))
    return F.when(n == 0, F.lit(None).cast("double")).otherwise(F.least(F.lit(1.0), F.lit(2.0) * tail * largest))


def _log_factorial(n: Column) -> Column:
    """ln n!: by the product up to 20, by Stirling's series beyond (an error below 1e-13)."""
    x = n.cast("double")
    series = x * F.log(x) - x + F.lit(0.5) * F.log(F.lit(2.0) * F.pi() * x) + F.lit(1.0) / (12 * x) - F.lit(1.0) / (360 * x * x * x) + F.lit(1.0) / (1260 * x * x * x * x * x)
    return F.when(n <= 20, F.log(F.factorial(n.cast("int")).cast("double"))).otherwise(series)
