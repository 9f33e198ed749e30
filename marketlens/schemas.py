"""Schemas of the curated tables and raw payloads, and rule checks (Parquet has no constraints)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SETS = "set_id long, language string, source_set_id string, name string, series string, release_date string, total_cards int, official_cards int"
CARDS = "card_id long, set_id long, local_id string, name string, category string, rarity string, dex_ids array<int>, hp int, illustrator string, image_url string, detail_status string"
VARIANTS = "variant_id long, card_id long, variant_key string, finish string, print_run_marker string, micro_variant string, size string, stamps array<string>, identity_status string, population10 long"
SPECS = "spec_pk long, namespace string, spec_id string, variant_id long, match_status string, finish string, micro_variant string, fetched_at timestamp"
POPULATION = "spec_pk long, grade_key string, grade_value double, qualified boolean, population_count long, total_population long, half_grade_count long, observed_at timestamp"
PRICES = "spec_pk long, grade_key string, most_recent_price double, average_price double, psa_price double, observed_at timestamp"
SALES = "spec_pk long, sale_item_id string, sale_date date, sale_price double, grade_value double"
LISTINGS = "listing_id long, title string, variant_id long, card_id long, grade double, is_lot boolean, flagged boolean, match_status string, match_tier string, match_method string, score double"
PRICE_HISTORY = "observation_id long, listing_id long, observed_at timestamp, price double, current_bid double, currency string, bid_count int, buying_options array<string>, item_end_date timestamp"
OBSERVATIONS = "observation_id long, hash string, observed_at timestamp, entity_type string, scope_key string"
RATES = "rate_date date, base string, quote string, rate double"
#: Raw payloads, read with these and never inferred.
RAW_SET = "id string, name string, serie struct<id:string,name:string>, releaseDate string, cardCount struct<total:int,official:int>, cards array<struct<id:string,localId:string,name:string,image:string>>"
RAW_CARD = "id string, localId string, name string, category string, rarity string, image string, set struct<id:string>, hp int, illustrator string, dexId array<int>, variants map<string,boolean>, variants_detailed array<struct<type:string,subtype:string,size:string,stamp:array<string>>>"
RAW_LISTING = "itemId string, title string, description string, conditionId string, quantity int, localizedAspects array<struct<name:string,value:string>>, price struct<value:string,currency:string>, bidCount int, buyingOptions array<string>, itemEndDate string, shippingOptions array<struct<type:string,shippingCost:struct<value:string,currency:string>>>"
RAW_POPULATION = "psaSpecId long, fetchedAt string, populationRaw string, priceRows array<struct<gradeText:string,mostRecentText:string,averageText:string,psaPriceText:string>>"


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n: how many rows break each rule; null counts as broken."""
    counts = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()))
    return counts.unpivot([], list(rules), "rule", "n")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has; null keys are equal to each other."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def require(*checks: DataFrame) -> None:
    """Raises where a check has rows with n > 0."""
    broken = reduce(DataFrame.unionByName, checks).where("n > 0").collect()  # one row for each rule
    if broken:
        raise ValueError(f"rules broken: {[(r.rule, r.n) for r in broken]}")
