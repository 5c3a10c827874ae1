"""Dense numbers in an order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Where a local run's checkpoints go if spark.checkpoint.dir is unset.
LOCAL_DIR = "/tmp/checkpoints"


def kept(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder that the cluster names in spark.checkpoint.dir."""
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not context.master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share (master is {context.master})")
        context.setCheckpointDir(where or LOCAL_DIR)
    return df.checkpoint(eager=True)


def numbered(rows: DataFrame, order: list[str], name: str, amount: str | None = None) -> DataFrame:
    """rows with a number by order, from 1: the count of rows up to the own one, or the sum of an amount before it.

    Give only the columns that are needed; order tells all rows apart. The rows are dealt out by ranges once, kept, and
    counted on from the totals of the ranges before, which are as few as the partitions.
    """
    each = F.lit(1) if amount is None else F.col(amount)
    ranged = kept(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(F.sum(each).alias("_total"))
    before = totals.select("_range", (F.sum("_total").over(Window.orderBy("_range")) - F.col("_total")).alias("_before"))
    upto = F.sum(each).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    own = upto if amount is None else upto - each
    return ranged.join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + own).cast("long")).drop("_range", "_before")
