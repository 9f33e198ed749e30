"""Windows that pick or number rows: latest per key, first per key, best and runner-up, islands, take-while, chunks.

Every order is completed to a total one by the caller; picks are row_number = 1, which Spark limits per group before
the shuffle (WindowGroupLimit).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first k rows of each key in an order; their number as column `rank` where one is named."""
    name = rank or "__rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def latest_by(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The row with the largest values of the order columns for each key."""
    return top_by(df, keys, [F.col(c).desc_nulls_last() for c in order])


def without_newer(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """latest_by() as an anti-join against the greatest order value of each key."""
    newest = df.groupBy(*keys).agg(F.max(order).alias("__newest"))
    older = df.join(newest, [*keys]).where(F.col(order) < F.col("__newest")).select(*keys, order)
    return df.join(older, [*keys, order], "left_anti")


def margin(df: DataFrame, keys: Sequence[str], score: str, *ties: str) -> DataFrame:
    """The best row of each key with `runner_up` and `margin`; a lone row's margin is its score."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), *(F.col(c).asc() for c in ties))
    both = df.withColumn("runner_up", F.lead(score).over(w)).withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")
    return both.withColumn("margin", F.col(score) - F.coalesce("runner_up", F.lit(0.0)))


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], stop: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows between rows where `stop` holds; a stopping row begins the next island."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(stop, 1).otherwise(0)).over(w))


def take_while(df: DataFrame, keys: Sequence[str], order: Column, stop: Column) -> DataFrame:
    """Rows of each key before the first one where `stop` holds."""
    first = df.where(stop).groupBy(*keys).agg(F.min(order).alias("__stop"))
    return df.join(first, [*keys], "left").where(F.col("__stop").isNull() | (order < F.col("__stop"))).drop("__stop")


def chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, name: str = "chunk") -> DataFrame:
    """Numbers batches of `size` rows in an order within each key."""
    return df.withColumn(name, F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size).cast("long"))
