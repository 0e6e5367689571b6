"""Written tables between the steps of an operator, in the cluster's shared folder.

A step whose result is read again is written as Parquet under the folder that the
session names in spark.checkpoint.dir, so a lost executor costs its running tasks
only, and no lineage grows with the number of rounds. Where the setting is absent
a folder of this machine serves, which is right for a local master only.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file of a table whose size is known, and files that it may have anyway.
ROWS_PER_FILE, FEWEST_FILES = 1_000_000, 12

_local: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; for a local master without one, a
    temporary folder. A cluster without the setting is an error."""
    global _local
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _local is None:
        _local = tempfile.mkdtemp(prefix="loomsearch-")
    return f"file://{_local}"


class Scratch:
    """The written tables of one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def _until_exit(self) -> None:
        """What is not dropped before goes when the driver ends."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)

    def write(self, df: DataFrame, step: str, rows: int | None = None, per_file: int = ROWS_PER_FILE, compression: str = "zstd") -> DataFrame:
        """Writes df and returns the written table. rows: a bound on its rows; there are
        then no more files than they fill, lest a small table be as many small files as
        there are shuffle partitions."""
        path = f"{self.folder}/{step}"
        if rows is not None:
            df = df.coalesce(max(FEWEST_FILES, -(-rows // per_file)))
        df.write.option("compression", compression).parquet(path)
        self._until_exit()
        return self.spark.read.schema(df.schema).parquet(path)

    def write_bucketed(self, df: DataFrame, step: str, key: str, buckets: int) -> DataFrame:
        """Writes df bucketed by key, so that joins on the key need no shuffle of it."""
        table = f"loom_{uuid.uuid4().hex}"
        df.write.format("parquet").option("path", f"{self.folder}/{step}").option("compression", "zstd").bucketBy(buckets, key).saveAsTable(table)
        self._until_exit()
        written = self.spark.table(table)
        written.schema  # resolved, so the entry in the catalog is no longer needed
        self.spark.sql(f"DROP TABLE {table}")
        return written

    def drop(self, *steps: str) -> None:
        """Removes written tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for step in steps:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{step}")
            path.getFileSystem(conf).delete(path, True)


def hashed_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The `rows` rows with the smallest hash of the keys, or all of fewer. Of many more
    rows only about twice as many as are wanted are compared, by a threshold on another
    hash, so the last task reads no more the more partitions there are."""
    n = df.count()
    if n > 4 * rows:
        span = 1 << 30
        df = df.where(F.pmod(F.xxhash64(F.lit(17), *keys), F.lit(span)) < int(span * 2 * rows / n))
    return df.orderBy(F.xxhash64(*keys), *keys).limit(rows)


@contextmanager
def batches_of(spark: SparkSession, records: int):
    """While a step is written, Arrow batches hold at most so many records: for
    rows that are blocks of some megabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(records))
    try:
        yield
    finally:
        spark.conf.set(key, before)
