"""Running totals and ranks over a whole table without gathering it into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discatlas.runtime import cut


def running(df: DataFrame, order: list[Column], amount: Column, out: str) -> DataFrame:
    """df with the sum of amount over all rows up to and with each, in an order that must be total.

    Rows are partitioned by range; each partition sums by itself and begins at
    the total of those before it. Only one total per partition goes through one task.
    """
    ranged = cut(df.withColumn("__amount", amount).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy("__part").agg(F.sum("__amount").alias("__sum"))
    before = sums.select("__part", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.sum("__amount").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    # One row per partition of this job: broadcast is bounded by the number of tasks.
    return ranged.withColumn("__within", within).join(F.broadcast(before), "__part").withColumn(out, F.col("__before") + F.col("__within")).drop("__part", "__amount", "__within", "__before")


def numbered(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """df with each row's number from 1 within its keys, in an order total within them; null keys are a key.

    Numbers come from one running count over the table, less the smallest of the
    key, so that a key of any size is spread over tasks.
    """
    sort = [F.col(k).asc_nulls_first() for k in keys]
    counted = running(df, [*sort, *order], F.lit(1).cast("long"), "__nth")
    first = counted.groupBy(*keys).agg((F.min("__nth") - 1).alias("__first")).select(*(F.col(k).alias(f"__key_{i}") for i, k in enumerate(keys)), "__first")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__key_{i}")) for i, k in enumerate(keys)))
    return counted.join(first, same).select(*df.columns, (F.col("__nth") - F.col("__first")).alias(out))
