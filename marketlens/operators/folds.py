"""Ordered folds over the rows of a key that do not need the key's rows in one task: runs, cooldowns and halts.

Rows are cut into buckets by a column that grows with the order (a day, say). Each bucket is summed up in one row, a window
over those rows says what each bucket begins with, and the rows of a bucket go on from there. So a task has one bucket of
one key, however many rows the key has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def halts(rows: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], stop: Column, name: str = "halted") -> DataFrame:
    """Each row with whether a row before it, of its key, stops the rest (the row that stops is not halted itself)."""
    marked = rows.withColumn("__stop", F.coalesce(stop, F.lit(False)))
    first = marked.where("__stop").groupBy(*keys).agg(F.min(bucket).alias("__first"))
    w = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = marked.withColumn("__inside", F.coalesce(F.max("__stop").over(w), F.lit(False))).join(first, [*keys], "left")
    after = F.coalesce(F.col(bucket) > F.col("__first"), F.lit(False)) | F.col("__inside")
    return joined.withColumn(name, after).drop("__stop", "__first", "__inside")


def failure_runs(rows: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], failed: Column, after: int) -> DataFrame:
    """Each row with `run`, the failures in a row up to it, which a success and a cooldown set back to zero, and whether a cooldown follows.

    A cooldown comes after `after` failures, so only the number of failures since the last success counts, taken modulo
    `after`. A bucket passes on its failures after its last success; without one, those it began with and its own.
    """
    marked = rows.withColumn("__failed", F.coalesce(failed, F.lit(False)))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = marked.withColumns({"__wins": F.sum(F.when(F.col("__failed"), 0).otherwise(1)).over(inside), "__fails": F.sum(F.col("__failed").cast("long")).over(inside)})
    last = counted.withColumn("__base", F.max(F.when(~F.col("__failed"), F.col("__fails"))).over(inside))
    streak = F.col("__fails") - F.coalesce("__base", F.lit(0))
    sums = last.groupBy(*keys, bucket).agg(F.max("__wins").alias("__all_wins"), F.max("__fails").alias("__all_fails"), F.max("__base").alias("__last_base"))
    # over the few rows of the buckets: failures since the last bucket with a success, with its own rest
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    upto = sums.withColumns({"__group": F.coalesce(F.sum((F.col("__all_wins") > 0).cast("long")).over(before), F.lit(0)), "__rest": F.col("__all_fails") - F.coalesce("__last_base", F.lit(0))})
    same = Window.partitionBy(*keys, "__group").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    # a bucket with a success ends its group; the next group begins with that bucket's rest
    ended = Window.partitionBy(*keys).orderBy(bucket)
    start = F.coalesce(F.sum("__rest").over(same), F.lit(0))
    opened = upto.withColumns({"__within": start, "__ended": F.last(F.when(F.col("__all_wins") > 0, F.col("__rest")), True).over(ended.rowsBetween(Window.unboundedPreceding, -1))})
    carried = opened.select(*keys, bucket, (F.col("__within") + F.coalesce("__ended", F.lit(0))).alias("__carry"))
    joined = last.join(carried, [*keys, bucket])
    whole = streak + F.when(F.col("__wins") == 0, F.col("__carry")).otherwise(0)
    run = F.when(F.col("__failed"), F.pmod(whole - 1, F.lit(after)) + 1).otherwise(0).cast("long")
    return joined.withColumn("run", run).withColumn("cooldown", F.col("run") == after).drop("__failed", "__wins", "__fails", "__base", "__carry")


def queue_runs(attempts: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], failed: Column, limited: Column, after: int) -> DataFrame:
    """Attempts of each queue with `halted`, `run` and `cooldown`: after the first rate limit nothing of the queue runs, so those rows have neither."""
    known = halts(attempts, keys, bucket, order, limited)
    ran = failure_runs(known.where("not halted"), keys, bucket, order, failed, after)
    rest = known.where("halted").withColumns({"run": F.lit(None).cast("long"), "cooldown": F.lit(None).cast("boolean")})
    return ran.unionByName(rest)
