"""Global order without one task: range partitions, then each row's place from sums over partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from precinct.blocks.shared import materialize


def global_cumulate(df: DataFrame, order: list[Column], sums: dict[str, str], rank: str = "rank") -> DataFrame:
    """df with `rank` (from 1) in the given order and running totals {new column: column}; order must be total.

    Range partitions are written once, so that their numbers hold; only a row of totals a partition meets in one task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = materialize(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    totals = parts.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{k}") for k, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a row a partition
    bases = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"), *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums])
    inside = Window.partitionBy("_part").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = parts.withColumns({"_r": F.row_number().over(inside), **{f"_c_{k}": F.sum(c).over(running) for k, c in sums.items()}})
    out = out.join(F.broadcast(bases), "_part")
    made = {rank: F.col("_b") + F.col("_r"), **{k: F.col(f"_b_{k}") + F.col(f"_c_{k}") for k in sums}}
    return out.withColumns(made).select(*df.columns, *made)
