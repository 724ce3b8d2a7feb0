"""Ordered patterns over an entity's events: steps, bounds between them, and what must not come between.

A pattern is data. A step is matched by its latest earlier predecessor, which is complete: of all earlier matches the latest one is within any bound
that another is within, and has the least between it and the step. So each step is one running window over the entity's events in order, all
steps of all patterns share one shuffle and one sort, and no entity's events are gathered.

A step of session scope (another entity's doing, or nobody's) may stand between two steps: it is met if such an event lies between them. The latest
of these events before a row leaves most room, so the row's predecessor is the latest match before that event: what had matched when the
entity's rows entered the stretch that the event began.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """One of `symbols`, at most `within_ms` after the step before it (any time, if None); of the session if not of the entity."""

    symbols: tuple[str, ...]
    within_ms: int | None = None
    of_session: bool = False


@dataclass(frozen=True)
class Pattern:
    """`steps` in order, with none of the `forbidden` symbols of the entity between two of them."""

    name: str
    steps: tuple[Step, ...]
    forbidden: tuple[str, ...] = ()

    def __post_init__(self):
        if self.steps[0].of_session or self.steps[-1].of_session or any(a.of_session and b.of_session for a, b in zip(self.steps, self.steps[1:], strict=False)):
            raise ValueError("a step of session scope stands between two steps of the entity")
        if any(s.of_session and s.within_ms is not None for s in self.steps):
            raise ValueError("a step of session scope has no bound of its own")


def match_patterns(rows: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """rows(session_id, entity, t, seq, symbol) -> session_id, entity, pattern, first_t, t, seq: the rows that complete a pattern, and when it began.

    Rows without an entity are seen by steps of session scope only. Order is by t, then seq; rows that are equal in both come in no order.
    """
    place = F.struct("t", "seq")
    session = Window.partitionBy("session_id").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, -1)
    entity = Window.partitionBy("session_id", "entity").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, -1)
    ambient = sorted({step.symbols for p in patterns for step in p.steps if step.of_session})
    seen = rows.select("session_id", "entity", F.col("t").cast("long").alias("t"), F.col("seq").cast("long").alias("seq"), "symbol")
    for i, symbols in enumerate(ambient):
        seen = seen.withColumn(f"s{i}", F.count_if(F.col("symbol").isin(*symbols)).over(session))
    seen = seen.where("entity IS NOT NULL")
    out = None
    for n, p in enumerate(patterns):
        m, name = seen, f"m{n}"
        if p.forbidden:
            m = m.withColumn("bar", F.last(F.when(F.col("symbol").isin(*p.forbidden), place), ignorenulls=True).over(entity))
        m = m.withColumn(name, F.when(F.col("symbol").isin(*p.steps[0].symbols), F.struct(F.col("t").alias("first_t"), "t", "seq")))
        between: Step | None = None
        for step in p.steps[1:]:
            if step.of_session:
                between = step
                continue
            m = m.withColumn("before", F.last(name, ignorenulls=True).over(entity))
            if between is not None:
                stretch = Window.partitionBy("session_id", "entity", f"s{ambient.index(between.symbols)}").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
                m = m.withColumn("before", F.first("before").over(stretch))
            fits = F.col("symbol").isin(*step.symbols) & F.col("before").isNotNull()
            if step.within_ms is not None:
                fits &= F.col("t") - F.col("before.t") <= step.within_ms
            if p.forbidden:
                fits &= ~F.coalesce(F.col("bar") > F.struct(F.col("before.t").alias("t"), F.col("before.seq").alias("seq")), F.lit(False))
            m = m.withColumn(name, F.when(fits, F.struct(F.col("before.first_t").alias("first_t"), "t", "seq")))
            between = None
        done = m.where(F.col(name).isNotNull()).select("session_id", "entity", F.lit(p.name).alias("pattern"), F.col(f"{name}.first_t").alias("first_t"), "t", "seq")
        out = done if out is None else out.unionByName(done)
    return out
