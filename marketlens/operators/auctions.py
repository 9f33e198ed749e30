"""Live auctions, listing funnels, targets and coverage (M24 to M29). `now` is always a parameter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import compared, or_unknown, rate_age_days
from .latest import latest_by, top_by
from .predicates import all_of, first_rule, live_auction, text_search, trusted_match

SORTS = {
    "opportunity_desc": [F.desc_nulls_last, "discount"], "ending_soon": [F.asc_nulls_first, "item_end_date"], "bids_desc": [F.desc_nulls_last, "bid_count"],
    "bid_asc": [F.asc_nulls_last, "bid"], "bid_desc": [F.desc_nulls_last, "bid"], "psa_price_desc": [F.desc_nulls_last, "guide_price"],
}


def current_prices(history: DataFrame) -> DataFrame:
    """The latest observation of each listing."""
    return latest_by(history, ["listing_id"], "observed_at", "observation_id")


def latest_rate(rates: DataFrame) -> DataFrame:
    """One row: the newest rate from euros to dollars."""
    return rates.where("base = 'EUR' and quote = 'USD'").orderBy(F.desc("rate_date")).limit(1).select("rate_date", "rate")


def live_auctions(listings: DataFrame, history: DataFrame, metrics: DataFrame, rates: DataFrame, now: Column, margin_minutes: int = 0, hours: int = 72) -> DataFrame:
    """Live auctions with their current bid, the guide price in dollars, in euros and in the bid's currency, and the discount."""
    rows = listings.join(current_prices(history), "listing_id").where(live_auction(now, margin_minutes, hours)).withColumn("bid", F.coalesce("current_bid", "price"))
    rated = rows.join(metrics.select("variant_id", "guide_price"), "variant_id", "left").join(F.broadcast(latest_rate(rates)), how="left")  # one rate
    usable = F.coalesce(F.greatest(rate_age_days(F.col("rate_date"), now), F.lit(0)) <= 7, F.lit(False))
    value, discount, euros = compared(F.col("guide_price"), F.col("bid"), F.col("currency"), F.col("rate"), usable)
    return rated.withColumns({"comparable": value, "discount": discount, "guide_euros": euros, "stale_rate": rate_age_days(F.col("rate_date"), now) > 1, "stale": F.col("observed_at") < now - F.make_dt_interval(hours=F.lit(6))})


def with_catalogue(auctions: DataFrame, variants: DataFrame, base: DataFrame) -> DataFrame:
    """Auctions with their card's name, number, set and language; base as search.card_base() gives it."""
    return auctions.drop("card_id").join(variants.select("variant_id", "card_id"), "variant_id").join(base.select("card_id", "name", "local_id", "set_name", "source_set_id", "language"), "card_id")


def filtered(auctions: DataFrame, now: Column, q: str | None = None, ending_hours: int | None = None, guide: bool | None = None, least_discount: float | None = None, bids: tuple[float | None, float | None] = (None, None), sort: str = "opportunity_desc", language: str | None = None, set_name: str | None = None) -> DataFrame:
    """The list's filters and sorts, of equal opportunities the one that ends first; searched are the title and what with_catalogue() adds."""
    hours = 72 if ending_hours is None else min(max(ending_hours, 1), 72)
    wanted = all_of([
        text_search(q, *(c for c in ("title", "name", "set_name", "local_id") if c in auctions.columns)), F.col("item_end_date") <= now + F.make_dt_interval(hours=F.lit(hours)),
        None if guide is None else F.col("guide_price").isNotNull() == F.lit(guide), None if least_discount is None else F.col("discount") >= least_discount,
        None if bids[0] is None else F.col("bid") >= bids[0], None if bids[1] is None else F.col("bid") <= bids[1],
        None if language is None else F.col("language") == language, None if set_name is None else (F.col("source_set_id") == set_name) | (F.col("set_name") == set_name),
    ])
    direction, column = SORTS[sort if sort in SORTS else "opportunity_desc"]
    ends = [F.asc_nulls_first("item_end_date")] if column == "discount" else []
    return auctions.where(wanted).orderBy(direction(column), *ends, F.asc("listing_id"))


def auction_facets(auctions: DataFrame) -> DataFrame:
    """facet, id, name, language: the languages and the sets of live auctions with their catalogue."""
    languages = auctions.select(F.lit("language").alias("facet"), F.col("language").alias("id"), F.col("language").alias("name"), "language")
    sets = auctions.select(F.lit("set").alias("facet"), F.col("source_set_id").alias("id"), F.col("set_name").alias("name"), "language")
    return languages.unionByName(sets).distinct()


def summary(auctions: DataFrame, now: Column) -> DataFrame:
    """Count, those with a guide price, comparable ones, median discount, those that end within a day and the last observation, in one pass."""
    soon = F.col("item_end_date") <= now + F.make_dt_interval(hours=F.lit(24))
    return auctions.agg(F.count("*").alias("live"), F.count("guide_price").alias("with_guide"), F.count("discount").alias("comparable"), F.median("discount").alias("median_discount"), F.count_if(soon).alias("ending_24h"), F.max("observed_at").alias("last_observed"))


def auction_history(history: DataFrame, listing_id: int) -> DataFrame:
    return history.where(F.col("listing_id") == listing_id).orderBy("observed_at", "observation_id")


def append_price(history: DataFrame, new: DataFrame) -> DataFrame:
    """Observations whose fingerprint the listing has not had."""
    from ..functions.values import fingerprint, number_text
    from .merge import append_new

    def keyed(df: DataFrame) -> DataFrame:
        parts = [number_text(F.col("price")), F.col("currency"), F.col("bid_count"), F.array_join(F.array_sort("buying_options"), ","), F.date_format("item_end_date", "yyyy-MM-dd'T'HH:mm:ss")]
        return df.withColumn("fingerprint", fingerprint(*parts))

    return append_new(keyed(history), keyed(new), ["listing_id", "fingerprint"], [F.asc("observation_id")]).drop("fingerprint")


def cheapest_shipping(items: DataFrame) -> DataFrame:
    """The least cost of each item; options without a cost go."""
    costs = F.transform("shippingOptions", lambda o: o["shippingCost"]["value"].try_cast("double"))
    return items.withColumn("shipping_cost", F.array_min(F.filter(costs, lambda c: c.isNotNull())))


STATES = ("pending", "identity_missing", "raw_missing", "raw_present", "processed", "no_data", "rate_limited", "failed")


def listing_states(members: DataFrame, listings: DataFrame, work: DataFrame, coverage: DataFrame, specs: DataFrame, population: DataFrame, prices: DataFrame, sales: DataFrame) -> DataFrame:
    """Each member of a search with how far it has come: acquisition, identity, and a state of each phase.

    members: keys of their own and item_id; listings: listing_id equal to the item that was fetched. work: item_id, state,
    last_error. coverage: listing_id, phase, status, created_at, of which the newest known state counts; without one, a
    listing whose variant has a matched population spec is processed where rows of grade ten (or any population) are there.
    """
    done = specs.where(F.col("match_status").isin("matched", "manual") & F.col("variant_id").isNotNull())
    of = lambda rows, name: rows.select("spec_pk").join(done.select("spec_pk", "variant_id"), "spec_pk").select("variant_id", F.lit(True).alias(name)).distinct()
    have = {"has_identity": done.where("namespace = 'population'").select("variant_id", F.lit(True).alias("has_identity")).distinct(), "has_population": of(population, "has_population"), "has_guide": of(prices.where("grade_key = '10'"), "has_guide"), "has_sales": of(sales.where("grade_value = 10"), "has_sales")}
    newest = latest_by(coverage, ["listing_id", "phase"], "created_at").where(F.col("status").isin(*STATES)).groupBy("listing_id").agg(*(F.max(F.when(F.col("phase") == p, F.col("status"))).alias(f"told_{p}") for p in ("population", "guide", "sales")))
    rows = members.join(listings.select(F.col("listing_id").alias("item_id"), "variant_id", "match_tier", "flagged", F.lit(True).alias("fetched")), "item_id", "left").join(work.select("item_id", "state", "last_error"), "item_id", "left").join(newest.withColumnRenamed("listing_id", "item_id"), "item_id", "left")
    for df in have.values():
        rows = rows.join(df, "variant_id", "left")
    acquisition = first_rule([(F.col("fetched"), "fetched"), (limited(F.col("last_error")), "rate_limited"), (F.col("state") == "permanent_failed", "failed")], "pending")
    matched = F.coalesce(F.col("match_tier").isin("exact", "strong"), F.lit(False))
    known = matched & ~F.coalesce("flagged", F.lit(False)) & F.coalesce("has_identity", F.lit(False))
    phase = lambda p: F.coalesce(F.col(f"told_{p}"), F.when(~known, "identity_missing").when(F.col(f"has_{p}"), "processed").otherwise("raw_missing")).alias(p)
    return rows.select(*members.columns, "variant_id", "match_tier", acquisition.alias("acquisition"), matched.alias("matched"), F.when(known, "processed").otherwise("identity_missing").alias("identity"), *(phase(p) for p in ("population", "guide", "sales")))


def funnel(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Members of each search (filter the states before, by tier, state or text), those fetched, matched, matched without an identity, and with each phase processed."""
    flags = {"fetched": F.col("acquisition") == "fetched", "matched": F.col("matched"), "identity_missing": F.col("matched") & (F.col("identity") == "identity_missing")} | {p: F.col(p) == "processed" for p in ("population", "guide", "sales")}
    return states.groupBy(*keys).agg(F.count("*").alias("members"), *(F.count_if(c).alias(k) for k, c in flags.items()))


def matched_targets(listings: DataFrame, history: DataFrame, specs: DataFrame, variants: DataFrame, cards: DataFrame, sets: DataFrame, now: Column, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(specs to fetch, those that end soonest first, without a future end last; variants without a spec by set): one predicate, its matches and the rest."""
    trusted = listings.where(trusted_match() & F.col("variant_id").isNotNull() & (F.col("grade") == 10) & ~F.coalesce("is_lot", F.lit(False))).join(current_prices(history).select("listing_id", "item_end_date"), "listing_id", "left")
    spec = top_by(specs.where("variant_id is not null and namespace = 'population'"), ["variant_id"], [F.desc_nulls_last("fetched_at"), F.desc("spec_pk")]).select("variant_id", "spec_pk", "spec_id")
    counted = trusted.groupBy("variant_id").agg(F.count_distinct("listing_id").alias("listings"), F.min(F.when(F.col("item_end_date") > now, F.col("item_end_date"))).alias("next_end"))
    named = variants.select("variant_id", "card_id", or_unknown(F.col("finish")).alias("finish"), or_unknown(F.col("print_run_marker")).alias("print_run_marker")).join(cards.select("card_id", "set_id", "local_id"), "card_id").join(sets.select("set_id", "source_set_id"), "set_id")
    targets = counted.join(spec, "variant_id").join(named, "variant_id").select("spec_id", "spec_pk", "variant_id", "source_set_id", "local_id", "finish", "print_run_marker", "listings", "next_end")
    gaps = counted.join(spec, "variant_id", "left_anti").join(named, "variant_id").groupBy("source_set_id").agg(F.count("*").alias("variants"), F.sum("listings").alias("listings"))
    ordered = targets.orderBy(F.asc_nulls_last("next_end"), "source_set_id", "local_id", "spec_id")
    return (ordered if limit is None else ordered.limit(limit)), gaps


def snapshot_manifest(manifest: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets that are new or whose content changed, with the next revision."""
    newest = latest_by(manifest, ["spec_id"], "revision").select("spec_id", "revision", F.col("listings").alias("old_listings"), F.col("next_end").alias("old_end"))
    both = targets.join(newest, "spec_id", "left")
    changed = F.col("revision").isNull() | ~F.col("listings").eqNullSafe(F.col("old_listings")) | ~F.col("next_end").eqNullSafe(F.col("old_end"))
    return both.where(changed).select("spec_id", (F.coalesce("revision", F.lit(0)) + 1).cast("int").alias("revision"), "listings", "next_end")


def limited(error: Column) -> Column:
    """An error that tells of a rate limit."""
    return F.coalesce(error.rlike("(?i)429|rate.?limit"), F.lit(False))


def coverage_status(targets: DataFrame, rows: DataFrame, raw: DataFrame, work: DataFrame) -> DataFrame:
    """target_id, phase, n, status of the population, guide and sales of each target.

    targets: target_id, spec_id, sales_spec_id. rows: spec_id, phase, one for each curated row. raw: spec_id, kind (population
    or sales) of captured files; a file without rows is raw_present for the population and no_data for the others. work:
    spec_id, kind, state, last_error of the collectors' items. Without rows and file a permanent failure counts before a
    rate limit, and that before work that is still to do; what nobody has fetched or asked for is raw_missing.
    """
    phases = targets.select("target_id", F.inline(F.array(*(F.struct(F.lit(p).alias("phase"), F.lit("sales" if p == "sales" else "population").alias("kind"), F.col("sales_spec_id" if p == "sales" else "spec_id").alias("spec_id")) for p in ("population", "guide", "sales")))))
    counted = rows.groupBy("spec_id", "phase").agg(F.count("*").alias("n"))
    have = raw.select("spec_id", "kind", F.lit(True).alias("has_raw")).distinct()
    whole = phases.join(counted, ["spec_id", "phase"], "left").join(have, ["spec_id", "kind"], "left").join(work.select("spec_id", "kind", "state", "last_error"), ["spec_id", "kind"], "left")
    open_ = F.col("state").isin("pending", "leased", "running", "retryable_failed", "partial")
    status = first_rule([
        (F.col("n") > 0, "processed"), (F.col("has_raw") & (F.col("phase") == "population"), "raw_present"), (F.col("has_raw"), "no_data"), (F.col("state") == "permanent_failed", "failed"), (limited(F.col("last_error")), "rate_limited"), (open_, "pending"),
    ], "raw_missing")
    return whole.select("target_id", "phase", F.coalesce("n", F.lit(0)).cast("long").alias("n"), status.alias("status"))
