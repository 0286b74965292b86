"""Scan policies: stride, skip, sample, file lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.session import cut


def numbered(df: DataFrame, order: str, name: str = "row_no") -> DataFrame:
    """Rows numbered from 0 in the order of a unique column, without one task that holds all rows.

    Rows are range-partitioned by ``order``, numbered per partition, and each partition is moved by the rows before it.
    """
    placed = cut(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return placed.withColumn("_local", local).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")


def running_total(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Rows with ``name``, the sum of ``value`` over the rows before it and itself in the order of a unique column; as ``numbered``, without
    one task that holds all rows. Nulls count as 0."""
    placed = cut(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    x = F.coalesce(F.col(value), F.lit(0))
    sums = placed.groupBy("_part").agg(F.sum(x).alias("_n"))
    before = sums.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row per partition
    local = F.sum(x).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_local", local).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")


def numbered_within(df: DataFrame, by: str, order: list[str], name: str, buckets: int = 64) -> DataFrame:
    """Rows numbered from 1 within each ``by``, in an order whose first column is a whole number from 0 on.

    A frequent ``by`` is split into up to ``buckets`` ranges of that number, which are numbered apart and moved by the counts before them.
    """
    top = df.agg(F.max(order[0])).first()[0] or 0
    placed = df.withColumn("_bucket", F.floor(F.col(order[0]) / (top // buckets + 1)))
    counts = placed.groupBy(by, "_bucket").agg(F.count("*").alias("_n"))
    before = counts.select(by, "_bucket", (F.sum("_n").over(Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(*order))
    return placed.withColumn("_local", local).join(before, [by, "_bucket"]).withColumn(name, F.col("_before") + F.col("_local")).drop("_bucket", "_local", "_before")


def strided(df: DataFrame, order: str, start: int, stride: int) -> DataFrame:
    """Rows start, start + stride, ... in the order of a unique column."""
    return numbered(df, order, "_row_no").where((F.col("_row_no") >= start) & ((F.col("_row_no") - start) % stride == 0)).drop("_row_no")


def skip(df: DataFrame, order: str, n: int) -> DataFrame:
    return numbered(df, order, "_row_no").where(F.col("_row_no") >= n).drop("_row_no")


def subsample(df: DataFrame, key: str, rate: float, seed: int = 0) -> DataFrame:
    """Rows kept with probability ``rate``, decided by their key and the seed alone, so equally on every run and partitioning."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_003)) < rate * 1_000_003)


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Rows in a random order that depends on their key and the seed alone."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)


def expand_fofn(spark: SparkSession, path: str) -> list[str]:
    """Paths listed in a file of file names, one a line; blank lines are skipped. A path that isn't such a list stands for itself."""
    if not path.endswith(".fofn"):
        return [path]
    return [r.value.strip() for r in spark.read.text(path).collect() if r.value.strip()]
