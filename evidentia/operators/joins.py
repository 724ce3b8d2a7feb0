"""Temporal and relational joins over session logs. All are equi joins or windows keyed by session; none is a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_responses(events: DataFrame) -> DataFrame:
    """Every response with the latest earlier request of its id, in file order (null if there is none)."""
    before = Window.partitionBy("session_id", "id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    req = F.last(F.when(F.col("k") == "net.req", F.struct("seq", "t", "url")), ignorenulls=True).over(before)
    rows = events.where(F.col("k").isin("net.req", "net.res", "net.err")).withColumn("req", req).where("k <> 'net.req'")
    return rows.select("session_id", "seq", "t", "k", "id", "st", "dur", F.col("req.seq").alias("req_seq"), F.col("req.t").alias("req_t"), F.col("req.url").alias("url"), (F.col("t") - F.col("req.t")).alias("wait_ms"))


def first_aliases(events: DataFrame) -> DataFrame:
    """session_id, id, request_id: the first request id seen with each browser id."""
    return events.where(F.col("k").isin("net.req", "net.res", "net.err") & F.col("id").isNotNull() & F.col("request_id").isNotNull()).groupBy("session_id", "id").agg(F.min_by("request_id", "seq").alias("request_id"))


def nearest_before(events: DataFrame, effect: Column, trigger: Column, within_ms: int, order: list[str] | None = None) -> DataFrame:
    """Every effect row with its nearest earlier trigger of the session, if it lies within the bound."""
    w = Window.partitionBy("session_id").orderBy(*(order or ["t", "seq"])).rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("trigger", F.last(F.when(trigger, F.struct("seq", "t", "k")), ignorenulls=True).over(w)).where(effect)
    near = F.col("t") - F.col("trigger.t") <= within_ms
    return rows.withColumn("trigger", F.when(near, F.col("trigger"))).withColumn("delta_ms", F.col("t") - F.col("trigger.t"))


def nearest_after(events: DataFrame, source: Column, target: Column, within_ms: int, order: list[str] | None = None) -> DataFrame:
    """Every source row with the nearest later target of the session, if it lies within the bound."""
    w = Window.partitionBy("session_id").orderBy(*(order or ["t", "seq"])).rowsBetween(1, Window.unboundedFollowing)
    rows = events.withColumn("target", F.first(F.when(target, F.struct("seq", "t", "k")), ignorenulls=True).over(w)).where(source)
    near = F.col("target.t") - F.col("t") <= within_ms
    return rows.withColumn("target", F.when(near, F.col("target"))).withColumn("delta_ms", F.col("target.t") - F.col("t"))


def range_join(left: DataFrame, right: DataFrame, keys: list[str], left_t: str, right_t: str, before_ms: int, after_ms: int) -> DataFrame:
    """Rows of right with right_t in [left_t - before, left_t + after]: time buckets make it an equi join, then the exact bound holds.

    A bucket is as wide as the window, so a left row meets two or three buckets whatever the data's density.
    """
    width = max(1, before_ms + after_ms)
    lo, hi = F.floor((F.col(left_t) - before_ms) / width), F.floor((F.col(left_t) + after_ms) / width)
    wide = left.withColumn("__bucket", F.explode(F.sequence(lo, hi)))
    near = right.withColumn("__bucket", F.floor(F.col(right_t) / width))
    return wide.join(near, [*keys, "__bucket"]).where(F.col(right_t).between(F.col(left_t) - before_ms, F.col(left_t) + after_ms)).drop("__bucket")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, strict: bool = True) -> DataFrame:
    """Every left row with `match`: the latest right row of its keys, as a struct (null if none), before its `at` (or not after it).

    Both sides are ordered together once by key and time, so a key with many rows on both sides makes no pairs.
    """
    own = [F.col(k).alias(k) for k in keys]
    a = left.select(*own, F.col(at).alias("__at"), F.lit(0 if strict else 1).alias("__side"), F.struct(F.lit(True).alias("__is"), *[c for c in left.columns if c not in keys]).alias("__left"))
    b = right.select(*own, F.col(at).alias("__at"), F.lit(1 if strict else 0).alias("__side"), F.struct(*right.columns).alias("__right"))
    rows = a.withColumn("__right", F.lit(None).cast(b.schema["__right"].dataType)).unionByName(b.withColumn("__left", F.lit(None).cast(a.schema["__left"].dataType)))
    w = Window.partitionBy(*keys).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("match", F.last("__right", ignorenulls=True).over(w)).where("__left IS NOT NULL").select(*[F.col(c).cast(left.schema[c].dataType).alias(c) if c in keys else F.col(f"__left.`{c}`") for c in left.columns], "match")


def near_join(left: DataFrame, right: DataFrame, keys: list[str], value: str, other: str, tolerance: float) -> DataFrame:
    """Rows of equal keys whose numbers differ by the tolerance at most: an equi join on buckets as wide as it, then the exact bound.

    A left row meets its own bucket and the two beside it, so pairs grow with the rows that really are near; a null or NaN number meets none.
    """
    bucket = lambda c: F.floor(F.col(c).cast("double") / (tolerance * (1 + 1e-6)))
    near = F.abs(F.col(value) - F.col(other)) <= tolerance + 1e-9 * F.greatest(F.abs(F.col(value)), F.lit(1.0))
    wide = left.where(~F.isnan(value)).withColumn("__bucket", F.explode(F.sequence(bucket(value) - 1, bucket(value) + 1)))
    return wide.join(right.where(~F.isnan(other)).withColumn("__bucket", bucket(other)), [*keys, "__bucket"]).where(near).drop("__bucket")


def error_context(events: DataFrame, window_ms: int = 2000, cap: int = 100) -> DataFrame:
    """For each error the events within the window, the nearest `cap` of them."""
    errors = events.where(F.col("k").isin("err", "rej")).select("session_id", F.col("seq").alias("err_seq"), F.col("t").alias("err_t"))
    context = events.select("session_id", "seq", "t", "k")
    joined = range_join(errors, context, ["session_id"], "err_t", "t", window_ms, window_ms).where("seq <> err_seq")
    nearest = Window.partitionBy("session_id", "err_seq").orderBy(F.abs(F.col("t") - F.col("err_t")), "seq")
    return joined.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= cap)


def full_stack(frontend: DataFrame, backend: DataFrame) -> DataFrame:
    """Frontend requests against backend requests by request id: linked, or a gap with its type.

    frontend(session_id, request_id, seq, t), backend(session_id, request_id, t, status). Of repeated frontend rows of a request the last
    counts for the link, and all are covered by it; a backend row whose session differs keeps its frontend inside one gap.
    """
    last = Window.partitionBy("request_id").orderBy(F.desc("seq"))
    keyed = frontend.where("request_id IS NOT NULL").withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")
    f = keyed.select("request_id", F.col("session_id").alias("f_session"), F.col("t").alias("f_t"), F.lit(True).alias("has_f"))
    b = backend.where("request_id IS NOT NULL").select("request_id", F.col("session_id").alias("b_session"), F.col("t").alias("b_t"), "status", F.lit(True).alias("has_b"))
    joined = f.join(b, "request_id", "full_outer")
    has_f, has_b = F.col("has_f").isNotNull(), F.col("has_b").isNotNull()  # a row without a time is a row
    linked = has_f & has_b & F.col("f_session").isNotNull() & (F.col("f_session") == F.col("b_session"))
    named = {"generated-request-id": "backend-generated-request-id", "missing-session": "backend-missing-session", "missing-request-id": "backend-missing-request-id",
             "missing-session-and-request-id": "backend-missing-session-and-request-id"}
    by_status = F.create_map(*[F.lit(x) for p in named.items() for x in p])[F.coalesce("status", F.lit(""))]
    kind = F.when(linked, "linked").when(~has_b, "frontend-only").otherwise(F.coalesce(by_status, F.lit("backend-only")))
    out = joined.select(kind.alias("type"), "request_id", F.coalesce("b_session", "f_session").alias("session_id"), F.coalesce("f_t", "b_t").alias("t"))
    no_id = frontend.where("request_id IS NULL").select(F.lit("client-missing-request-id").alias("type"), "request_id", "session_id", "t")
    no_id_b = backend.where("request_id IS NULL").select(F.lit("backend-missing-request-id").alias("type"), "request_id", "session_id", "t")
    return out.unionByName(no_id).unionByName(no_id_b)


#: Kinds of gaps, so that the histogram is dense.
GAP_TYPES = ("frontend-only", "backend-only", "backend-generated-request-id", "backend-missing-session", "backend-missing-request-id", "backend-missing-session-and-request-id", "client-missing-request-id")


def gap_histogram(joined: DataFrame) -> DataFrame:
    """Count of every gap type, zeros included."""
    types = joined.sparkSession.createDataFrame([(g,) for g in GAP_TYPES], "type string")
    counts = joined.where("type <> 'linked'").groupBy("type").agg(F.count("*").alias("n"))
    return types.join(counts, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))


def fifo_match(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The k-th row of a key on one side pairs with the k-th on the other; the rest is missing or added."""
    w = Window.partitionBy(*keys).orderBy(order)
    a = left.withColumn("__k", F.row_number().over(w)).select(*[F.col(k).alias(f"__a{i}") for i, k in enumerate(keys)], F.col("__k").alias("__ka"), F.struct(*left.columns).alias("a"))
    b = right.withColumn("__k", F.row_number().over(w)).select(*[F.col(k).alias(f"__b{i}") for i, k in enumerate(keys)], F.col("__k").alias("__kb"), F.struct(*right.columns).alias("b"))
    same = F.col("__ka") == F.col("__kb")
    for i in range(len(keys)):
        same &= F.col(f"__a{i}").eqNullSafe(F.col(f"__b{i}"))  # an unknown part of a key is equal to an unknown one
    joined = a.join(b, same, "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "missing").otherwise("paired")
    return joined.select(*[F.coalesce(f"__a{i}", f"__b{i}").alias(k) for i, k in enumerate(keys)], "a", "b", change.alias("change"))


def env_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """key, value tables of two sessions -> added, removed and changed keys. A key whose value is null is there."""
    one = left.select("key", F.col("value").alias("before"), F.lit(True).alias("__l"))
    joined = one.join(right.select("key", F.col("value").alias("after"), F.lit(True).alias("__r")), "key", "full_outer")
    change = F.when(F.col("__l").isNull(), "added").when(F.col("__r").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return joined.withColumn("change", change).where("change IS NOT NULL").drop("__l", "__r")
