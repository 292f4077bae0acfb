"""Positions, running sums and top-k without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.functions.session import cut


def placed(df: DataFrame, order: list[Column], size: Column | None = None) -> DataFrame:
    """Adds pos, the row's place from 0 in ``order``, and with ``size`` also start, the sum of sizes before it.

    Rows are dealt by ranges of the order and written once; partitions count and sum themselves, and only
    these totals, one row for each partition, meet in one task. ``order`` must be total.
    """
    spread = df.withColumn("__size", F.lit(1) if size is None else size)
    spread = cut(spread.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    within = Window.partitionBy("__part").orderBy(*order)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = spread.groupBy("__part").agg(F.count("*").alias("__n"), F.sum("__size").alias("__s"))
    totals = totals.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__s"))
    own = spread.withColumn("pos", F.row_number().over(within) - 1).withColumn("start", F.sum("__size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size"))
    out = own.join(F.broadcast(totals), "__part").withColumn("pos", F.col("pos") + F.col("__n")).withColumn("start", F.col("start") + F.col("__s"))
    return out.drop("__part", "__size", "__n", "__s", *([] if size is not None else ["start"]))


def ranked(df: DataFrame, by: list[str], order: list[Column], k: int | None = None) -> DataFrame:
    """Adds rank from 1 within ``by``; with ``k`` only the first so many, which are cut before the shuffle too."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if k is None else out.filter(F.col("rank") <= k)


def first_wins(df: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    keys = [f"__key{i}" for i in range(len(key))]
    return ranked(df.select("*", *(k.alias(n) for k, n in zip(key, keys, strict=True))), keys, order, 1).drop("rank", *keys)


def evenly_spaced(n: int, k: int) -> list[int]:
    """``k`` places from the first of ``n`` to the last, cut to whole numbers."""
    k = min(k, n)
    return [int(i * ((n - 1) / (k - 1))) if k > 1 else 0 for i in range(k)]
