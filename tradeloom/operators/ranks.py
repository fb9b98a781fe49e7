"""Ranks, running sums and exact quantiles over a whole table without a task that holds it all.

Rows are ranged by the order into as many partitions as the session shuffles into; each partition counts and sums itself, the totals of the
partitions before it (one row per partition) are added, so any number of rows is ranked in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.session import checkpointed, partitions


def ranked(df: DataFrame, order: Sequence[Column], rank: str = "rank", sums: dict[str, str] | None = None) -> DataFrame:
    """df with its rank from 1 in a total order, and running sums (new name: column) up to and with the row."""
    sums = sums or {}
    n = max(2, partitions(df.sparkSession))
    x = checkpointed(df.repartitionByRange(n, *order).withColumn("part__", F.spark_partition_id()))  # written, so a row stays in its part
    of = x.groupBy("part__").agg(F.count(F.lit(1)).alias("n__"), *[F.sum(c).alias(f"s__{name}") for name, c in sums.items()])
    prior = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    of = of.select("part__", F.coalesce(F.sum("n__").over(prior), F.lit(0)).alias("n__"), *[F.coalesce(F.sum(f"s__{name}").over(prior), F.lit(0)).alias(f"s__{name}") for name in sums])
    own = Window.partitionBy("part__").orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    x = x.join(F.broadcast(of), "part__")  # as many rows as partitions
    x = x.withColumn(rank, F.row_number().over(own) + F.col("n__")).withColumns({name: F.coalesce(F.sum(c).over(upto), F.lit(0)) + F.col(f"s__{name}") for name, c in sums.items()})
    return x.drop("part__", "n__", *[f"s__{name}" for name in sums])


def quantiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row with the exact quantiles (name: share) of the values that are not null, with linear interpolation; nulls if there are none."""
    x = ranked(df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v__")), [F.col("v__")])
    n = x.agg(F.count(F.lit(1)).alias("n__"))
    x = x.crossJoin(F.broadcast(n))  # one row
    out = []
    for name, q in shares.items():
        at = (F.col("n__") - 1) * q
        low = F.max(F.when(F.col("rank") == F.floor(at) + 1, F.col("v__")))
        high = F.max(F.when(F.col("rank") == F.ceil(at) + 1, F.col("v__")))
        out.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return x.agg(*out)
