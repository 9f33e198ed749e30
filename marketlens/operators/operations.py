"""Reports, gates and queues over the operational tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import or_unknown
from .latest import latest_by
from .merge import transition, upsert
from .predicates import due, first_rule

#: Fixed value: the series of cards that are not printed.
DIGITAL_SERIES = "Pokémon TCG Pocket"


def group_counts(df: DataFrame, *columns: str) -> DataFrame:
    """dimension, value, n for several columns."""
    parts = [df.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("dimension"), "value", "n") for c in columns]
    return reduce(DataFrame.unionByName, parts)


def match_report(listings: DataFrame) -> DataFrame:
    return group_counts(listings, "match_tier", "match_status", "match_method")


def source_status(work: DataFrame, observations: DataFrame, objects: DataFrame) -> DataFrame:
    """Work by state, distinct contents and their bytes for each source; a content counts once."""
    states = work.groupBy("source").agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("pending", "leased", "succeeded", "failed_retryable", "failed_permanent")))
    contents = observations.select("source", "hash").distinct().join(objects.select("hash", "byte_size"), "hash").groupBy("source").agg(F.count("*").alias("contents"), F.sum("byte_size").alias("bytes"))
    last = observations.groupBy("source").agg(F.max("observed_at").alias("last_observed"))
    return states.join(contents, "source", "left").join(last, "source", "left")


def run_report(attempts: DataFrame, observations: DataFrame) -> DataFrame:
    """Attempts and bytes by outcome, with the bytes of contents seen first."""
    first = observations.where("is_first_observation_of_hash").select("attempt_id", F.lit(True).alias("is_new")).distinct()
    return attempts.join(first, "attempt_id", "left").groupBy("run_id", "outcome").agg(F.count("*").alias("attempts"), F.sum("byte_size").alias("bytes"), F.sum(F.when(F.col("is_new"), F.col("byte_size")).otherwise(0)).alias("new_bytes"))


def failures(attempts: DataFrame, source: str | None = None) -> DataFrame:
    """Newest failures first (P20)."""
    rows = attempts.where(F.col("outcome").isin("failed_retryable", "failed_permanent"))
    return (rows if source is None else rows.where(F.col("source") == source)).orderBy(F.desc("attempted_at"), F.desc("attempt_id"))


def claimable(work: DataFrame, now: Column) -> DataFrame:
    """Work that is due, by priority and age; taking it is for a queue outside Spark."""
    ready = F.col("state").isin("pending", "failed_retryable") & (F.coalesce("available_at", now) <= now) | (F.col("state") == "leased") & (F.col("lease_expires_at") < now)
    return work.where(ready).orderBy(F.desc("priority"), F.asc("created_at"), F.asc("work_item_id"))


def due_terms(terms: DataFrame, now: Column) -> DataFrame:
    return terms.where(due(F.col("last_enqueued_at"), F.col("refresh_minutes"), now)).orderBy(F.desc("priority"), "term_id")


def stage_decision(stages: DataFrame, now: Column) -> DataFrame:
    """run, parked or waiting for each stage: a manual poke, then parking, then back-off."""
    rule = first_rule([(F.coalesce("poked", F.lit(False)), "run"), (F.col("parked_until") > now, "parked"), (F.col("next_tick_at") > now, "waiting")], "run")
    return stages.select("stage", rule.alias("decision"))


GAP_TIERS = ("catalogue-gap", "card-level", "flagged", "review", "out-of-scope", "lot")


def gaps(listings: DataFrame, unresolved: DataFrame) -> DataFrame:
    """gap_type, listing_id, subject: listings whose tier is no plain match, and sets with trusted variants that no spec is known for.

    unresolved: the second table of auctions.matched_targets().
    """
    tiers = listings.where(F.col("match_tier").isin(*GAP_TIERS)).select(F.col("match_tier").alias("gap_type"), "listing_id", F.col("title").alias("subject"))
    return tiers.unionByName(unresolved.select(F.lit("psa-identity-gap").alias("gap_type"), F.lit(None).cast("long").alias("listing_id"), F.col("source_set_id").alias("subject")))


def coverage_report(headings: DataFrame, specs: DataFrame, variants: DataFrame, cards: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts of headings by status; source_set_id with headings, matched headings, specs, matched specs and English cards, zero where one of the three has no such set).

    headings: heading_id, source_set_id, match_status.
    """
    done = F.col("match_status").isin("matched", "manual")
    status = F.when(done, "matched").when(F.col("match_status") == "ambiguous", "ambiguous").otherwise("unmatched")
    counts = headings.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
    by_heading = headings.where("source_set_id <> ''").groupBy("source_set_id").agg(F.count("*").alias("headings"), F.count_if(done).alias("matched_headings"))
    of_set = cards.select("card_id", "set_id").join(sets.select("set_id", "source_set_id", "language"), "set_id")
    linked = specs.where("namespace = 'population' and variant_id is not null").select("variant_id").join(variants.select("variant_id", "card_id"), "variant_id").join(of_set, "card_id")
    by_spec = linked.groupBy("source_set_id").agg(F.count("*").alias("specs"))
    totals = of_set.where("language = 'en'").groupBy("source_set_id").agg(F.count("*").alias("cards"))
    return counts, union_of_keys({"headings": by_heading, "specs": by_spec, "cards": totals}, "source_set_id")


def union_of_keys(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Every key that one of the tables has, with all their counts; zero where a table lacks the key."""
    whole = reduce(lambda a, b: a.join(b, key, "full_outer"), tables.values())
    return whole.select(key, *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in whole.columns if c != key))


def verify(objects: DataFrame, files: DataFrame, observations: DataFrame, work: DataFrame, coverage: DataFrame, now: Column) -> DataFrame:
    """problem, n of the raw store: contents that are missing or do not hash to their name, files that nothing names, observations without a content or work item, complete coverage without evidence; and, as no problem, leases that are over.

    objects: hash, storage_path; files: storage_path, body (binary); work: work_item_id, state, lease_expires_at;
    coverage: status, evidence.
    """
    hashed = files.select("storage_path", F.sha2("body", 256).alias("found"))
    both = objects.join(hashed, "storage_path", "full_outer")
    stored = both.agg(
        F.count_if(F.col("hash").isNotNull() & F.col("found").isNull()).alias("missing"), F.count_if(F.col("hash") != F.col("found")).alias("mismatch"),
        F.count_if(F.col("hash").isNull() & ~F.col("storage_path").startswith("tmp/")).alias("orphan"))
    known, items = objects.select("hash", F.lit(True).alias("o")).distinct(), work.select("work_item_id", F.lit(True).alias("w")).distinct()
    broken = observations.select("hash", "work_item_id").join(known, "hash", "left").join(items, "work_item_id", "left").agg(F.count_if(F.col("o").isNull() | F.col("w").isNull()).alias("broken_observation"))
    claimed = coverage.agg(F.count_if((F.col("status") == "complete") & F.col("evidence").isNull()).alias("no_evidence"))
    leases = work.agg(F.count_if(F.col("state").isin("leased", "running") & (F.col("lease_expires_at") < now)).alias("expired_lease"))
    return reduce(DataFrame.unionByName, (t.unpivot([], t.columns, "problem", "n") for t in (stored, broken, claimed, leases)))


def term_funnels(terms: DataFrame, items: DataFrame, listings: DataFrame, targets: DataFrame, history: DataFrame, coverage: DataFrame, now: Column) -> DataFrame:
    """For each search term how many items it found, which have details, are trusted, are live targets, and have each phase processed.

    terms: term_id; items: term_id, listing_id (null without details), found once for each; targets: listing_id, target_id;
    coverage: target_id, phase, status.
    """
    from .auctions import current_prices

    rows = items.join(listings.select("listing_id", "match_tier", "flagged"), "listing_id", "left")
    trusted = F.col("match_tier").isin("exact", "strong") & ~F.col("flagged")
    found = rows.groupBy("term_id").agg(F.count("*").alias("found"), F.count("match_tier").alias("detailed"), F.count_if(trusted).alias("matched"))
    phases = coverage.where("status = 'processed'").groupBy("target_id").agg(*(F.bool_or(F.col("phase") == p).alias(p) for p in ("population", "guide", "sales")))
    aimed = items.join(targets, "listing_id").join(current_prices(history).select("listing_id", "item_end_date"), "listing_id", "left").join(phases, "target_id", "left")
    each = lambda c: F.count_distinct(F.when(c, F.col("target_id")))
    reached = aimed.groupBy("term_id").agg(each(F.col("item_end_date") > now).alias("live_targets"), *(each(F.col(p)).alias(p) for p in ("population", "guide", "sales")))
    whole = terms.select("term_id").join(found, "term_id", "left").join(reached, "term_id", "left")
    return whole.select("term_id", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in whole.columns if c != "term_id"))


def stage_status(stages: DataFrame, work: DataFrame) -> DataFrame:
    """Each stage with its queue's depth, work in flight, retryable and permanent failures, and items a minute.

    stages: stage, queue, items_done, window_items, window_seconds; work: queue, state.
    """
    groups = {"pending": ("pending",), "in_flight": ("leased", "running"), "retryable": ("retryable_failed",), "failed": ("permanent_failed",)}
    counts = work.groupBy("queue").agg(*(F.count_if(F.col("state").isin(*states)).alias(k) for k, states in groups.items()))
    per_minute = F.when(F.col("window_seconds") > 0, F.col("window_items") * 60.0 / F.col("window_seconds"))
    return stages.join(counts, "queue", "left").select("stage", "items_done", per_minute.alias("per_minute"), *(F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in groups))


def last_executions(executions: DataFrame, keys: Sequence[str], row: str) -> DataFrame:
    """One row of each key: that of the greatest id."""
    values = [c for c in executions.columns if c not in keys]
    return executions.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(row)).alias("r")).select(*keys, "r.*")


def first_manifests(targets: DataFrame, listings: DataFrame) -> DataFrame:
    """The first manifest revision of runs from before there were revisions (A22). targets: run_id, target_id, created_at; listings: target_id, listing_id."""
    rows = targets.join(listings.select("target_id", "listing_id"), "target_id", "left")
    return rows.groupBy("run_id").agg(F.lit(1).alias("revision"), F.lit(False).alias("complete"), F.count_distinct("target_id").alias("new_targets"), F.count_distinct("listing_id").alias("listings"), F.min("created_at").alias("created_at"))


def listing_page(listings: DataFrame, live: str = "live", end: str = "item_end_date") -> DataFrame:
    """Live listings first, then those that end soonest, without an end last, newest id first."""
    return listings.orderBy(F.desc(F.coalesce(live, F.lit(False))), F.asc_nulls_last(end), F.desc_nulls_last("listing_id"))


def coverage_matrix(coverage: DataFrame) -> DataFrame:
    """status_key (phase:status), n."""
    return coverage.groupBy(F.concat_ws(":", "phase", "status").alias("status_key")).agg(F.count("*").alias("n"))


def reset(tables: dict[str, DataFrame], changes: dict[str, tuple[Column, dict[str, object]]], dry_run: bool = True) -> dict[str, DataFrame] | DataFrame:
    """For each table the rows to rewrite and their new values: a dry run counts them (table_name, n), otherwise the tables as they become are returned."""
    if dry_run:
        return reduce(DataFrame.unionByName, (tables[t].agg(F.count_if(when).alias("n")).select(F.lit(t).alias("table_name"), "n") for t, (when, _) in changes.items()))
    return {t: transition(df, changes[t][0], **changes[t][1]) if t in changes else df for t, df in tables.items()}


def cancel(work: DataFrame, which: Column) -> DataFrame:
    """Work that is not done is cancelled and its leases end, where there are such columns."""
    ended = {c: None for c in ("lease_owner", "lease_expires_at") if c in work.columns}
    return transition(work, which & (F.col("state") != "succeeded"), state="cancelled", **ended)


def resume(work: DataFrame, which: Column, **values: object) -> DataFrame:
    """Cancelled work is pending again, with other columns as given (attempts set back, say)."""
    return transition(work, which & (F.col("state") == "cancelled"), state="pending", **values)


def cooldowns(attempts: DataFrame, keys: Sequence[str], order: Sequence[str], failed: Column, after: int) -> DataFrame:
    """Each row with `run`, its number of failures in a row, which a success and a cooldown set back to zero, and whether a cooldown follows."""
    from .latest import islands

    marked = islands(attempts.withColumn("__failed", failed), keys, order, ~F.col("__failed"), "__island")
    w = Window.partitionBy(*keys, "__island").orderBy(*order)
    streak = F.sum(F.col("__failed").cast("int")).over(w)
    run = F.when(F.col("__failed"), F.pmod(streak - 1, F.lit(after)) + 1).otherwise(0).cast("long")
    return marked.withColumn("run", run).withColumn("cooldown", F.col("run") == after).drop("__failed", "__island")


def publication(dirty: Column, last: Column, next_end: Column, now: Column, wait_seconds: int = 120, urgent_hours: int = 6) -> Column:
    """publish, debounce or nothing: changes go out at most every so many seconds, at once where a target ends soon."""
    waited = F.coalesce(last <= now - F.make_dt_interval(secs=F.lit(wait_seconds)), F.lit(True))
    urgent = F.coalesce(next_end.between(now, now + F.make_dt_interval(hours=F.lit(urgent_hours))), F.lit(False))
    return F.when(~dirty, "nothing").when(waited | urgent, "publish").otherwise("debounce")


def gate(listings: DataFrame, cards: DataFrame, sets: DataFrame, variants: DataFrame | None = None, specs: DataFrame | None = None, campaigns: DataFrame | None = None) -> DataFrame:
    """rule, n: what must be zero before a snapshot is published.

    Searches that are not complete (campaigns: status, coverage_status); listings in a trusted tier whose variant is not
    proven, as it is null, flagged or taken over from a cluster; listings without a tier; rows whose parent is missing; and
    a catalogue without cards.
    """
    from ..schemas import orphans

    unproven = F.col("variant_id").isNull() | F.coalesce("flagged", F.lit(False)) | F.coalesce(F.col("match_method") == "cluster-propagate", F.lit(False))
    counted = {"trusted_unproven": F.count_if(F.col("match_tier").isin("exact", "strong") & unproven), "no_tier": F.count_if(F.col("match_tier").isNull())}
    parts = [listings.agg(*(c.alias(k) for k, c in counted.items())).unpivot([], list(counted), "rule", "n")]
    number = lambda rule, df: df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    if campaigns is not None:
        parts.append(number("campaign_incomplete", campaigns.where(~F.coalesce((F.col("status") == "complete") & (F.col("coverage_status") == "complete"), F.lit(False)))))
    parts.append(number("card_without_set", orphans(cards, sets, "set_id")))
    if variants is not None:
        parts += [number("variant_without_card", orphans(variants, cards, "card_id")), number("listing_without_variant", orphans(listings, variants, "variant_id"))]
        parts += [number("spec_without_variant", orphans(specs, variants, "variant_id"))] if specs is not None else []
    parts.append(cards.agg((F.count("*") == 0).cast("long").alias("n")).select(F.lit("empty_catalogue").alias("rule"), "n"))
    return reduce(DataFrame.unionByName, parts)


def language_summary(sets: DataFrame, cards: DataFrame, variants: DataFrame) -> DataFrame:
    """Sets, cards and variants of each language."""
    rows = sets.select("language", "set_id").join(cards.select("set_id", "card_id"), "set_id", "left").join(variants.select("card_id", "variant_id"), "card_id", "left")
    return rows.groupBy("language").agg(F.count_distinct("set_id").alias("sets"), F.count_distinct("card_id").alias("cards"), F.count_distinct("variant_id").alias("variants"))


def open_reviews(decisions: DataFrame, actions: DataFrame, limit: int = 200) -> DataFrame:
    """Listings whose latest decision asks for review and that nobody has resolved or dismissed, newest first."""
    newest = latest_by(decisions, ["listing_id"], "decided_at", "revision").where(F.col("match_tier").isin("review", "flagged"))
    done = latest_by(actions, ["listing_id"], "acted_at").where(F.col("action").isin("resolve", "dismiss"))
    return newest.join(done.select("listing_id"), "listing_id", "left_anti").orderBy(F.desc("decided_at"), F.desc("listing_id")).limit(limit)


def links_to_images(cards: DataFrame, assets: DataFrame) -> DataFrame:
    """Cards without a picture take the newest stored one."""
    newest = latest_by(assets, ["card_id"], "stored_at", "hash").select("card_id", F.col("url").alias("found_url"))
    return cards.join(newest, "card_id", "left").withColumn("image_url", F.coalesce("image_url", "found_url")).drop("found_url")


def link_assets(cards: DataFrame, assets: DataFrame, observations: DataFrame, attempts: DataFrame, objects: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(cards, assets) after the pictures that a source has found are linked.

    The newest observation of each scope `card:N` counts, with the url and kind of match of the last attempt that gave its
    content. Only cards without a picture take one; it becomes the card's primary asset, other urls of the card lose the flag.
    assets: card_id, hash, url, rendition, media_type, is_primary. observations: observation_id, work_item_id, scope_key,
    hash; attempts: attempt_id, work_item_id, hash, url, match_kind; objects: hash, media_type.
    """
    newest = latest_by(observations, ["scope_key"], "observation_id").select("work_item_id", "hash", F.regexp_extract("scope_key", "^card:([0-9]+)$", 1).try_cast("long").alias("card_id"))
    tried = latest_by(attempts, ["work_item_id", "hash"], "attempt_id").select("work_item_id", "hash", "url", F.concat(F.lit(f"{source}:"), F.coalesce("match_kind", F.lit("exact"))).alias("rendition"))
    bare = cards.where("image_url is null").select("card_id")
    found = newest.where("card_id > 0").join(tried, ["work_item_id", "hash"]).join(objects.select("hash", "media_type"), "hash").join(bare, "card_id", "left_semi").select("card_id", "hash", "url", "rendition", "media_type", F.lit(True).alias("is_primary"))
    taken = found.select("card_id", F.col("url").alias("new_url"))
    kept = assets.join(taken, "card_id", "left").withColumn("is_primary", F.col("is_primary") & (F.col("new_url").isNull() | (F.col("new_url") == F.col("url")))).drop("new_url")
    linked = upsert(kept.select(*found.columns), found, ["card_id", "url", "rendition"])
    return cards.join(taken, "card_id", "left").withColumn("image_url", F.coalesce("image_url", "new_url")).drop("new_url"), linked


def specs_by_year(specs: DataFrame, variants: DataFrame, cards: DataFrame, sets: DataFrame, year: int | None) -> DataFrame:
    """One row for each population spec to fetch: of English cards that are printed, up to a year where one is given, with the sales spec of its variant, else its own."""
    done = specs.where(F.col("match_status").isin("matched", "manual") & F.col("variant_id").isNotNull())
    wanted = sets.where((F.col("language") == "en") & (F.col("series") != DIGITAL_SERIES))
    wanted = wanted if year is None else wanted.where(F.col("release_date").cast("string") < f"{year + 1}-01-01")
    placed = variants.select("variant_id", "card_id", or_unknown(F.col("finish")).alias("finish"), or_unknown(F.col("print_run_marker")).alias("print_run_marker"), F.col("micro_variant"))
    placed = placed.join(cards.select("card_id", "set_id", "local_id"), "card_id").join(wanted.select("set_id", F.col("source_set_id").alias("release")), "set_id")
    sold = done.where("namespace = 'sales'").groupBy("variant_id").agg(F.max("spec_id").alias("sales_spec"))
    rows = done.where("namespace = 'population'").select("spec_id", "variant_id").join(placed, "variant_id").join(sold, "variant_id", "left")
    return rows.select("spec_id", "release", F.concat_ws("-", "release", "local_id").alias("source_card_id"), "finish", "print_run_marker", "micro_variant", F.coalesce("sales_spec", "spec_id").alias("sales_spec_id"))
