"""Session builder and the helpers that depend on cluster settings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(master)
        .appName("evidentia")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only where it is unset and the session is local (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="evidentia-checkpoint-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the reliable checkpoint folder and go on from there: lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    held = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, held)


def small_methods(spark: SparkSession) -> AbstractContextManager[None]:
    """What is written inside runs no stage as one method of over 8,000 bytes, which the JVM never compiles: it runs as many small ones."""
    return _setting(spark, "spark.sql.codegen.hugeMethodLimit", "8000")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What is written inside sends whole texts to Python so many rows at a time: a batch is held several times over, on both sides."""
    with _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)):
        yield


#: Rows that a task holds back while it writes a job's table: small, as its memory is for the work.
ROW_GROUP_BYTES = 16 << 20
#: Files that a task has open at once where a table is written by the values of a column: beyond them Spark sorts a task's other rows. Their row groups are smaller.
OPEN_FILES, OPEN_GROUP_BYTES = 32, 8 << 20


class Tables:
    """Written tables of one job under the shared folder: compressed, with sizes that the optimizer knows. They belong to the innermost open `job`, if any."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        owner = _owner.get()
        (_unowned if owner is None else owner).append(self.folder)

    def store(self, name: str, df: DataFrame, partition: str | None = None) -> DataFrame:
        """Write the rows (by the values of a column, if named) and go on from the files: lost executors cost no recomputation."""
        path = f"{self.folder}/{name}"
        if partition is None:
            df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
        else:
            # without files side by side, each task would sort all of its rows by the column
            with _setting(self.spark, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_FILES)):
                df.write.option("parquet.block.size", OPEN_GROUP_BYTES).partitionBy(partition).parquet(path)
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        delete_path(self.spark, f"{self.folder}/{name}")

    def close(self) -> None:
        """Delete all of them."""
        delete_path(self.spark, self.folder)


#: Folders that the open job has to delete, and folders of this process that no job owns.
_owner: ContextVar[list[str] | None] = ContextVar("owner", default=None)
_unowned: list[str] = []


@contextmanager
def job(spark: SparkSession) -> Iterator[None]:
    """Tables made inside are deleted at its end, whatever happens; those of other jobs, and of results still to be read, are left alone."""
    own: list[str] = []
    token = _owner.set(own)
    try:
        yield
    finally:
        _owner.reset(token)
        for folder in own:
            delete_path(spark, folder)


@contextmanager
def made() -> Iterator[list[str]]:
    """The folders of the tables made inside; they belong to the open job as they would without this."""
    own: list[str] = []
    token = _owner.set(own)
    try:
        yield own
    finally:
        _owner.reset(token)
        owner = _owner.get()
        (_unowned if owner is None else owner).extend(own)


def drop_tables(spark: SparkSession) -> None:
    """Delete the tables that no job owns: for a caller who has read all results of this process."""
    while _unowned:
        delete_path(spark, _unowned.pop())


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def modified(spark: SparkSession, path: str) -> int:
    """When a file or folder was last written, in epoch milliseconds; 0 if it is not there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime() if path_exists(spark, path) else 0


def delete_path(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
