"""Filters as reusable Column expressions, facets and pages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_SIZE, MOST_PAGE_SIZE = 24, 60


def all_of(conditions: Sequence[Column | None]) -> Column:
    """Conjunction; None stands for a filter that is not asked for."""
    return reduce(Column.__and__, (c for c in conditions if c is not None), F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(Column.__or__, conditions, F.lit(False))


def text_search(q: str | None, *columns: str) -> Column | None:
    """Case-insensitive substring of any column; % and _ in q are wild cards."""
    return any_of([F.col(c).ilike(f"%{q}%") for c in columns]) if q else None


def contains(column: str, text: str, ignore_case: bool = False) -> Column:
    """Substring in which % and _ stand for themselves."""
    x = F.col(column)
    return F.lower(x).contains(text.lower()) if ignore_case else x.contains(text)


def begins(column: str, prefix: str) -> Column:
    """Prefix in which % and _ stand for themselves."""
    return F.col(column).startswith(prefix)


def missing_image(sets: Sequence[str] | None = None, language: str = "ja") -> Column:
    """Complete cards of a language, of some sets where they are named, that have no picture."""
    return all_of([F.col("language") == language, F.col("detail_status") == "hydrated", F.col("image_url").isNull(), None if sets is None else F.col("source_set_id").isin(*sets)])


def equals(values: dict[str, object]) -> Column:
    """Equalities of the values that are given."""
    return all_of([None if v is None else F.col(c).isin(*v) if isinstance(v, list | tuple | set) else F.col(c) == F.lit(v) for c, v in values.items()])


def ranges(bounds: dict[str, tuple[object, object]]) -> Column:
    """Closed ranges with optional ends; a null metric fails any of them."""
    return all_of([x for c, (low, high) in bounds.items() for x in (None if low is None else F.col(c) >= F.lit(low), None if high is None else F.col(c) <= F.lit(high))])


def within(end: Column, now: Column, margin_minutes: int = 0, hours: int = 72) -> Column:
    """now + margin < end <= now + hours."""
    return (end > now + F.make_dt_interval(mins=F.lit(margin_minutes))) & (end <= now + F.make_dt_interval(hours=F.lit(hours)))


def trusted_match(tiers: Sequence[str] = ("exact", "strong"), statuses: Sequence[str] = ("matched", "manual")) -> Column:
    """A listing's match that figures may use (P5)."""
    return F.col("match_status").isin(*statuses) & F.col("match_tier").isin(*tiers) & ~F.coalesce("flagged", F.lit(False)) & ~F.col("match_method").eqNullSafe(F.lit("cluster-propagate"))


def live_auction(now: Column, margin_minutes: int = 0, hours: int = 72) -> Column:
    """The one definition of a live auction (P4): proven variant, grade 10, no lot, trusted, an auction with a bid that ends soon."""
    return all_of([
        F.col("variant_id").isNotNull(), F.col("grade") == 10, ~F.coalesce("is_lot", F.lit(False)), trusted_match(),
        F.array_contains("buying_options", "AUCTION"), F.col("bid_count") >= 1, within(F.col("item_end_date"), now, margin_minutes, hours),
    ])


def due(last: Column, minutes: Column, now: Column) -> Column:
    """Never done, or the interval is over."""
    return last.isNull() | (last + F.make_dt_interval(mins=minutes) <= now)


def first_rule(rules: Sequence[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The name of the first rule that holds."""
    out = F.when(rules[0][0], rules[0][1])
    for condition, name in rules[1:]:
        out = out.when(condition, name)
    return out.otherwise(otherwise)


def facets(columns: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """facet, value: the distinct values of several columns, without blanks."""
    parts = [df.select(F.lit(name).alias("facet"), F.col(c).cast("string").alias("value")).where("value <> ''").distinct() for name, (df, c) in columns.items()]
    return reduce(DataFrame.unionByName, parts)


def page(ordered: DataFrame, page: int = 1, size: int = PAGE_SIZE, total: int | None = None) -> DataFrame:
    """One page of an ordered table; where the total is known, a page beyond the last one is the last."""
    size = min(max(size, 1), MOST_PAGE_SIZE)
    last = max(1, -(-total // size)) if total is not None else page
    return ordered.offset((min(max(page, 1), last) - 1) * size).limit(size)
