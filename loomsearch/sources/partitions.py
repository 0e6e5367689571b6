"""Partitions of small inputs, and tables that are part of a plan."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Inputs beyond this are left as they are, and bytes that are worth a task.
SMALL_BYTES, TASK_BYTES = 64 << 20, 256 << 10


def spread(df: DataFrame) -> DataFrame:
    """A small table in as many partitions as there are cores, or as its size is worth.
    It may be a single row group, which one task would read while the others wait. A
    larger one, as the plan's estimate says, or one in partitions enough comes back as
    it is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES)
    if size > SMALL_BYTES or wanted < 2:
        return df
    there = df.select(F.spark_partition_id().alias("p")).agg(F.count_distinct("p")).first()[0]
    return df if there >= wanted else df.repartition(wanted)


def local_table(spark: SparkSession, rows: list, schema: str | StructType) -> DataFrame:
    """A few rows as a table that is part of the plan itself, so no task reads it."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = zip(*rows, strict=True) if rows else [()] * len(kind)
    arrow = to_arrow_schema(kind)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow), kind)
