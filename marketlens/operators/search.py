"""Card and variant search, details and facets (M1, M3, M4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import natural_key, variant_label
from .predicates import all_of, equals, page, ranges, text_search

CARD_SORTS: dict[str, list[Column | str]] = {
    "release_desc": ["-release_date"], "release_asc": ["+release_date"], "name_asc": ["+name_key"], "name_desc": ["-name_key"], "set_asc": ["+set_key"], "number_asc": ["+local_sort_key"], "number_desc": ["-local_sort_key"],
}
VARIANT_SORTS = CARD_SORTS | {f"{m}_{d}": [f"{'-' if d == 'desc' else '+'}{m}"] for m in ("population10", "gem_rate", "guide_price", "latest_sale_price") for d in ("asc", "desc")}


def _order(sorts: dict, name: str, tie: str) -> list[Column]:
    """Nulls come last in both directions; the number and a key complete the order (O1, O2)."""
    return [*(F.desc_nulls_last(c[1:]) if c[0] == "-" else F.asc_nulls_last(c[1:]) for c in sorts[name]), F.asc("local_sort_key"), F.asc(tie)]


def card_base(cards: DataFrame, sets: DataFrame, variants: DataFrame) -> DataFrame:
    """Cards with their set and number of variants; unknown, not zero, for stubs."""
    counts = variants.groupBy("card_id").agg(F.count("*").alias("n"))
    s = sets.select("set_id", "language", "source_set_id", F.col("name").alias("set_name"), "series", "release_date")
    rows = cards.join(s, "set_id").join(counts, "card_id", "left")
    known = F.when(F.col("detail_status") == "hydrated", F.coalesce("n", F.lit(0))).cast("long")
    return rows.withColumns({"variant_count": known, "local_sort_key": natural_key(F.col("local_id")), "name_key": F.lower("name"), "set_key": F.lower("set_name")}).drop("n")


def _where(filters: dict) -> Column:
    wanted = filters.get("set")
    return all_of([text_search(filters.get("q"), "name", "set_name", "local_id"), equals({k: filters.get(k) for k in ("language", "category", "rarity")}), None if wanted is None else (F.col("source_set_id") == wanted) | (F.col("set_name") == wanted)])


def card_search(base: DataFrame, filters: dict | None = None, sort: str = "release_desc", number: int = 1, size: int = 24) -> tuple[DataFrame, int]:
    """(one page, total) (M1)."""
    found = base.where(_where(filters or {}))
    total = found.count()
    return page(found.orderBy(*_order(CARD_SORTS, sort, "card_id")), number, size, total), total


def variant_search(base: DataFrame, variants: DataFrame, metrics: DataFrame, filters: dict | None = None, bounds: dict | None = None, sort: str = "release_desc", number: int = 1, size: int = 24) -> tuple[DataFrame, int]:
    """Variants with their figures; a figure that is missing fails any range (M3)."""
    rows = variants.select("variant_id", "card_id", "finish", "print_run_marker").join(base, "card_id").join(metrics, "variant_id", "left")
    found = rows.where(_where(filters or {}) & ranges(bounds or {}))
    total = found.count()
    return page(found.orderBy(*_order(VARIANT_SORTS, sort, "variant_id")), number, size, total), total


def card_detail(base: DataFrame, variants: DataFrame, card_id: int) -> DataFrame:
    """One card with its variants as an array and the same number's cards in other languages."""
    one = base.where(F.col("card_id") == card_id)
    own = variants.where(F.col("card_id") == card_id).groupBy("card_id").agg(F.array_sort(F.collect_list(F.struct("variant_id", "finish", "print_run_marker"))).alias("variants"))
    key = one.select(F.col("card_id").alias("own_card"), "source_set_id", "local_id")
    others = base.select(F.col("card_id").alias("other"), F.col("language").alias("other_language"), "source_set_id", "local_id").join(key, ["source_set_id", "local_id"]).where("other <> own_card")
    printed = others.groupBy(F.col("own_card").alias("card_id")).agg(F.array_sort(F.collect_list(F.struct("other", "other_language"))).alias("also_printed"))
    return one.join(own, "card_id", "left").join(printed, "card_id", "left")


def also_printed(base: DataFrame) -> DataFrame:
    """card_id, other, other_language: the cards of the same set and number in other languages, for all cards."""
    other = base.select(F.col("card_id").alias("other"), F.col("language").alias("other_language"), "source_set_id", "local_id")
    return base.select("card_id", "source_set_id", "local_id").join(other, ["source_set_id", "local_id"]).where("card_id <> other").select("card_id", "other", "other_language")


def references(links: DataFrame, records: DataFrame, target_type: str) -> DataFrame:
    """target_id, source, namespace, source_key, match_status: the source records linked to targets of one type.

    links: source_record_id, target_type, target_id, match_status; records: source_record_id, source, namespace, source_key.
    """
    return links.where(F.col("target_type") == target_type).join(records, "source_record_id").select("target_id", "source", "namespace", "source_key", "match_status")


def variant_detail(variants: DataFrame, base: DataFrame, metrics: DataFrame, links: DataFrame, records: DataFrame, assets: DataFrame) -> DataFrame:
    """Every variant with its card, label, figures, references and numbers of matched sources and pictures; for one filter by variant_id.

    assets: target_type, target_id.
    """
    refs = references(links, records, "variant").groupBy(F.col("target_id").alias("variant_id")).agg(F.count_if(F.col("match_status").isin("matched", "manual")).alias("matched_sources"), F.array_sort(F.collect_list(F.struct("source", "namespace", "source_key", "match_status"))).alias("references"))
    stored = assets.where("target_type = 'variant'").groupBy(F.col("target_id").alias("variant_id")).agg(F.count("*").alias("assets"))
    label = variant_label(F.col("finish"), F.col("print_run_marker"), F.col("micro_variant"), F.col("size"), F.col("stamps"))
    rows = variants.select("variant_id", "card_id", "variant_key", label.alias("label")).join(base.select("card_id", "name", "set_name", "language", "release_date"), "card_id").join(metrics, "variant_id", "left").join(refs, "variant_id", "left").join(stored, "variant_id", "left")
    zero = F.lit(0).cast("long")
    return rows.withColumns({"matched_sources": F.coalesce("matched_sources", zero), "assets": F.coalesce("assets", zero)})
