"""Sinks: capped append, sealed cold plane, overwrite by session, and the manifest of what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.session import Tables, delete_path, job, path_exists


def cap_bytes(events: DataFrame, line: str, limit: int = 50 << 20) -> tuple[DataFrame, DataFrame]:
    """(events that fit each session's byte limit in order, accepted and dropped counts of each session)."""
    upto = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    sized = events.withColumn("__total", F.sum(F.octet_length(line) + 1).over(upto))
    counts = sized.groupBy("session_id").agg(F.count_if(F.col("__total") <= limit).alias("accepted"), F.count_if(F.col("__total") > limit).alias("dropped"))
    return sized.where(F.col("__total") <= limit).drop("__total"), counts.withColumn("truncated", F.col("dropped") > 0)


def append_log(events: DataFrame, path: str) -> None:
    events.write.mode("append").partitionBy("date").parquet(path)


def seal(events: DataFrame, path: str, partitions: tuple[str, ...] = ("app", "date")) -> None:
    """Write the cold plane: columnar, zstd, clustered by session inside each partition so that one session is a few row groups."""
    events.repartition(*partitions, F.col("session_id")).sortWithinPartitions(*partitions, "session_id", "seq").write.mode("overwrite").option("compression", "zstd").partitionBy(*partitions).parquet(path)


#: Files of a date: sessions are dealt over so many by hash, and a file is what is rewritten at once.
SESSION_BUCKETS = 64


def overwrite_sessions(table: DataFrame, path: str, partition: str = "date", buckets: int = SESSION_BUCKETS) -> None:
    """Replace the rows of the table's sessions, wherever they stand; all other sessions stay as they are. A second finalize is idempotent.

    Rows are kept by date and session bucket. The buckets that hold the sessions, now or before, are rewritten: their other rows and the new ones
    are written aside first, then put in their place. A null session is a session. If it is cut short, running it again completes it.
    """
    spark = table.sparkSession
    new = table.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int"))
    with job(spark):
        tables = Tables(spark, "sessions")
        new = tables.store("new", new)
        rows, emptied = new, []
        if path_exists(spark, path):
            old = spark.read.schema(new.schema).parquet(path)
            ids = new.select(F.col("session_id").alias("__id"), F.col("bucket").alias("__bucket")).distinct()
            same = F.col("session_id").eqNullSafe(F.col("__id")) & (F.col("bucket") == F.col("__bucket"))
            places = new.select(partition, "bucket").unionByName(old.join(ids, same, "left_semi").select(partition, "bucket")).distinct()
            at = F.col(partition).eqNullSafe(F.col("__p")) & (F.col("bucket") == F.col("__b"))
            touched = tables.store("places", places.select(F.col(partition).alias("__p"), F.col("bucket").alias("__b")))
            kept = old.join(touched, at, "left_semi").join(ids, same, "left_anti")
            rows = tables.store("rows", kept.unionByName(new))
            # a bucket whose sessions have all moved to another date is written no more: its folder goes (a row for each folder)
            emptied = touched.join(rows.select(F.col(partition), "bucket").distinct(), at, "left_anti").collect()
        rows.repartition(partition, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition, "bucket").parquet(path)
        for r in emptied:
            name = "__HIVE_DEFAULT_PARTITION__" if r["__p"] is None else r["__p"]
            delete_path(spark, f"{path}/{partition}={name}/bucket={r['__b']}")


def read_sessions(spark, path: str, schema=None) -> DataFrame:
    """What `overwrite_sessions` has written, without its bucket."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path).drop("bucket")


def manifest(tables: dict[str, DataFrame], line_bytes: dict[str, str] | None = None) -> DataFrame:
    """artifact, rows, raw_bytes of each derived table."""
    out = None
    for name, df in tables.items():
        size = F.sum(F.octet_length(F.to_json(F.struct(*df.columns))) + 1) if not line_bytes or name not in line_bytes else F.sum(F.octet_length(line_bytes[name]))
        row = df.agg(F.lit(name).alias("artifact"), F.count("*").alias("rows"), F.coalesce(size, F.lit(0)).cast("long").alias("raw_bytes"))
        out = row if out is None else out.unionByName(row)
    return out
