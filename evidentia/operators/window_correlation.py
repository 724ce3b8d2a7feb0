"""What changed in a window: volume and distribution tests of a highlight window against the baseline before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import stats

#: Least events of a kind for the volume test, least values a side for the distribution test, default discovery rate.
MIN_VOLUME_EVENTS, MIN_KS_SAMPLES, DEFAULT_Q = 25, 8, 0.05


def _windows(t0: int, t1: int, multiplier: float) -> tuple[int, int, float]:
    lo, hi = min(t0, t1), max(t0, t1)
    return lo, hi, lo - multiplier * (hi - lo)


def _side(t0: int, t1: int, multiplier: float) -> Column:
    """0: baseline, open at its end; 1: highlight, closed at both."""
    lo, hi, base = _windows(t0, t1, multiplier)
    return F.when((F.col("t") >= base) & (F.col("t") < lo), 0).when((F.col("t") >= lo) & (F.col("t") <= hi), 1)


def _direction(before: Column, after: Column) -> Column:
    return F.when(after > before, "increase").when(after < before, "decrease").otherwise("flat")


def volume_delta(events: DataFrame, t0: int, t1: int, multiplier: float = 4.0, least: int = MIN_VOLUME_EVENTS) -> DataFrame:
    """Continuity-corrected normal test of each kind's count, given the total."""
    lo, _, base = _windows(t0, t1, multiplier)
    side = _side(t0, t1, multiplier)
    counts = events.where(side.isNotNull() & (F.col("k") != "")).groupBy("k").agg(F.count_if(side == 0).alias("b"), F.count_if(side == 1).alias("h")).where(F.col("b") + F.col("h") >= least)
    p0 = 1 / (1 + multiplier)
    total = F.col("b") + F.col("h")
    z = (F.abs(F.col("h") - total * p0) - 0.5) / F.sqrt(total * (p0 * (1 - p0)))
    expected = F.col("b") / multiplier
    return counts.select(
        F.lit("volume").alias("dimension"), F.col("k").alias("kind"), F.lit("count").alias("field"), F.least(F.lit(1.0), F.lit(2.0) * stats.normal_cdf(-F.greatest(F.lit(0.0), z))).alias("p_value"),
        _direction(expected, F.col("h")).alias("direction"), stats.round_half_up(expected).alias("baseline_stat"), F.col("h").cast("double").alias("highlight_stat"),
    ) if lo > base else counts.limit(0).selectExpr("'' AS dimension", "k AS kind", "'' AS field", "0D AS p_value", "'' AS direction", "0D AS baseline_stat", "0D AS highlight_stat")


def distribution_shift(events: DataFrame, fields: dict[str, list[str]], t0: int, t1: int, multiplier: float = 4.0, least: int = MIN_KS_SAMPLES) -> DataFrame:
    """Two-sample test of each declared numeric field of each kind, with medians of both windows."""
    side = _side(t0, t1, multiplier)
    pairs = [(k, f) for k, fs in fields.items() for f in fs]
    values = F.explode(F.array(*[F.when(F.col("k") == k, F.struct(F.lit(k).alias("kind"), F.lit(f).alias("field"), F.col(f).cast("double").alias("v"))) for k, f in pairs]))
    rows = events.where(side.isNotNull() & F.col("k").isin(*fields)).select(side.alias("side"), values.alias("x")).where("x IS NOT NULL").select("side", "x.kind", "x.field", "x.v")
    rows = rows.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf")))
    tests = stats.ks_two_sample(rows, ["kind", "field"], "side", "v").where((F.col("n") >= least) & (F.col("m") >= least))
    middle = rows.groupBy("kind", "field").agg(F.median(F.when(F.col("side") == 0, F.col("v"))).alias("b"), F.median(F.when(F.col("side") == 1, F.col("v"))).alias("h"))
    return tests.join(middle, ["kind", "field"]).select(
        F.lit("distribution").alias("dimension"), "kind", "field", "p_value", _direction(F.col("b"), F.col("h")).alias("direction"), stats.round_half_up(F.col("b")).alias("baseline_stat"), stats.round_half_up(F.col("h")).alias("highlight_stat"))


def correlate_window(events: DataFrame, t0: int, t1: int, fields: dict[str, list[str]] | None = None, multiplier: float = 4.0, q: float = DEFAULT_Q) -> DataFrame:
    """Both scorers, with false discoveries controlled over all tests that ran."""
    tests = volume_delta(events, t0, t1, multiplier)
    if fields:
        tests = tests.unionByName(distribution_shift(events, fields, t0, t1, multiplier))
    return stats.benjamini_hochberg(tests, "p_value", ["kind", "field"], q)
