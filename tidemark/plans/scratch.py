"""Intermediate tables in the folder that driver and executors share.

Long plans are cut by writing Parquet below ``spark.checkpoint.dir`` instead of
keeping lineage or executor-local blocks: a lost executor then costs the tasks
it was running, and nothing that was finished.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; on a local master without that setting, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # a stopped session has no file system to ask
        try:
            _delete(spark, path)
        except Exception:  # the JVM may have gone before us
            return


class Scratch:
    """A folder of intermediate tables for one operator call; it goes when the process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.held: list[str] = []
        atexit.register(_delete_at_exit, spark, self.path)

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df and return the table read back, with its plan cut.

        Spark deletes the shuffle files of the write as soon as it ends, rather
        than when the driver's collector finds its plan unreachable.
        """
        self.count += 1
        path = f"{self.path}/{self.count:03d}-{name}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        self.held.append(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for t in tables:
            _delete(self.spark, t._scratch_path)
            self.held.remove(t._scratch_path)

    def leave(self, table: DataFrame) -> DataFrame:
        """Delete all tables but this one, and return it."""
        for path in [p for p in self.held if p != table._scratch_path]:
            _delete(self.spark, path)
        self.held = [table._scratch_path]
        return table
