"""Write semantics as DataFrame algebra: old and new rows in, the next generation out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import top_by


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep_old: Sequence[str] = (), first_wins: Sequence[str] = (), sticky: dict[str, str] | None = None) -> DataFrame:
    """Full outer merge: new values win (D1), in keep_old only where they are not null (D2), in first_wins never (creation times).

    sticky maps a column to the value that, once reached, stays (D3). new has one row for each key.
    """
    values = [c for c in old.columns if c not in keys]
    a = old.select(*keys, *(F.col(c).alias(f"__old_{c}") for c in values), F.lit(True).alias("__was"))
    b = new.select(*keys, *(F.col(c).alias(f"__new_{c}") for c in values), F.lit(True).alias("__is"))
    both = a.join(b, [*keys], "full_outer")

    def value(c: str) -> Column:
        x, y = F.col(f"__old_{c}"), F.col(f"__new_{c}")
        if c in first_wins:
            out = F.when(F.col("__was"), x).otherwise(y)
        elif c in keep_old:
            out = F.coalesce(y, x)
        else:
            out = F.when(F.col("__is"), y).otherwise(x)
        return F.when(x == F.lit(sticky[c]), x).otherwise(out) if sticky and c in sticky else out

    return both.select(*keys, *(value(c).alias(c) for c in values))


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of new whose key old lacks, the first of each key in an order."""
    return top_by(new.join(old.select(*keys), [*keys], "left_anti"), keys, order)


def append_new(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return old.unionByName(insert_or_ignore(old, new, keys, order).select(*old.columns))


def replace_children(old: DataFrame, new: DataFrame, parent: Sequence[str], touched: DataFrame | None = None) -> DataFrame:
    """Children of parents that are touched come from new alone, all others stay."""
    parents = (new if touched is None else touched).select(*parent).distinct()
    return old.join(parents, [*parent], "left_anti").unionByName(new.select(*old.columns))


def drop_stale(old: DataFrame, desired: DataFrame, keys: Sequence[str], scope: Sequence[str]) -> DataFrame:
    """Within the scopes that desired has, rows whose key it lacks go."""
    stale = old.join(desired.select(*scope).distinct(), [*scope], "left_semi").join(desired.select(*keys), [*keys], "left_anti")
    return old.join(stale.select(*keys), [*keys], "left_anti")


def single_primary(df: DataFrame, group: Sequence[str], order: Sequence[Column], flag: str = "is_primary") -> DataFrame:
    """Sets a flag on the first row of each group in an order and clears it on the others."""
    from pyspark.sql import Window

    return df.withColumn(flag, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) == 1)


def union_by_priority(parts: Sequence[DataFrame], keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of several tables, one of each key: from the earliest table that has it, there the first in an order (U4)."""
    tagged = [p.withColumn("__priority", F.lit(i)) for i, p in enumerate(parts)]
    whole = tagged[0]
    for p in tagged[1:]:
        whole = whole.unionByName(p)
    return top_by(whole, keys, [F.col("__priority"), *order]).drop("__priority")


def transition(df: DataFrame, when: Column, **values: object) -> DataFrame:
    """Rewrites columns of the rows where a condition holds."""
    return df.select(*(F.when(when, F.lit(values[c]).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns))
